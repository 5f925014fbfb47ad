"""Calls to models from outside, and what keeps them few: a table of vectors by text, and defaults for what no answer names."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.text import text_hash
from stepweave.operators import ordering


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All distinct non-null texts (text_hash, text, vector), and of those the ones that the cache (text_hash, vector) lacked.

    embed gets text_hash and text of what is missing and adds vector. The second result is for the cache; a costly embed is called
    once if it writes what it has found and returns what it reads back.
    """
    asked = texts.where(F.col(text).isNotNull()).select(text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text")).distinct()
    held = cache.select("text_hash", "vector").dropDuplicates(["text_hash"])
    new = embed(asked.join(held, "text_hash", "left_anti")).select("text_hash", "text", "vector")
    return asked.join(held, "text_hash").select("text_hash", "text", "vector").unionByName(new), new


def read_answer(text: str | None) -> dict | None:
    """The JSON object that a model's answer is, or else the first that stands in it; null if there is none."""
    plain = re.sub(r"^```(?:json)?|```$", "", (text or "").strip()).strip()
    try:
        whole = json.loads(plain)
        return whole if isinstance(whole, dict) else None
    except ValueError:
        pass
    begin = plain.find("{")
    try:
        return json.JSONDecoder().raw_decode(plain, begin)[0] if begin >= 0 else None
    except ValueError:
        return None


def asked(generate: Callable[[str], str], prompt: str, tries: int = 2, wait: float = 4.0) -> str:
    """An answer of generate, asked again after ever longer waits (20 s at most); the last failure is raised."""
    for k in range(1, tries + 1):
        try:
            return generate(prompt)
        except Exception:
            if k == tries:
                raise
            time.sleep(min(20.0, wait * k))
    raise ValueError("tries must be positive")


def filled(template: str, **values: object) -> str:
    """A template with __NAME__ replaced by the value of that name, texts as they are and all else as JSON."""
    for name, value in values.items():
        template = template.replace(f"__{name}__", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2))
    return template


REQUEST = "domain_id string, batch long, candidate_ids array<string>, prompt string, request string"


def model_requests(candidates: DataFrame, template: str, size: int = 8, model: str = "default") -> DataFrame:
    """The prompts about candidates (domain_id, candidate_id, payload as JSON): domain_id, batch, candidate_ids, prompt, request.

    Up to `size` candidates of one domain share a prompt, in the order of their ids, wherever they lie (ordering.ranked), so the same candidates
    give the same prompts in each run; request is the digest of model and prompt. A candidate that stands twice is asked about once.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    asking = candidates.where("candidate_id IS NOT NULL AND payload IS NOT NULL").groupBy("domain_id", "candidate_id").agg(F.min("payload").alias("payload"))
    placed = ordering.ranked(asking, ["domain_id"], ["candidate_id"])
    batches = placed.groupBy("domain_id", F.floor((F.col("n") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("candidate_id", "payload"))).alias("c"))  # `size` a batch

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for domain, batch, listed in frame[["domain_id", "batch", "c"]].itertuples(index=False):
                prompt = filled(template, DOMAIN_ID=str(domain), CANDIDATES_JSON=[json.loads(x["payload"]) for x in listed])
                rows.append((domain, batch, [x["candidate_id"] for x in listed], prompt, hashlib.sha256(f"{model}\0{prompt}".encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REQUEST.split(", ")])

    return batches.select("domain_id", "batch", F.transform("c", lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["payload"].alias("payload"))).alias("c")).mapInPandas(told, REQUEST)


def answered(requests: DataFrame, generate: Callable[[str], str], path: str | None = None, tries: int = 2, wait: float = 4.0) -> DataFrame:
    """requests (request, prompt, ...) with raw_response, what the model says.

    With a path (a folder that all executors share, by a path or an address that pyarrow's file systems know), each answer is kept there under its request as soon as it is there:
    a task that runs again, a failed run and a later one ask only for what is missing. Without one, each read of the result asks again.
    """
    columns = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if path else (None, "")
        for frame in frames:
            answers = []
            for request, prompt in zip(frame["request"], frame["prompt"], strict=True):
                name = f"{root}/{request[:2]}/{request}"
                if files and files.get_file_info(name).type == fs.FileType.File:
                    with files.open_input_file(name) as kept:
                        answers.append(kept.readall().decode())
                    continue
                answers.append(asked(generate, prompt, tries, wait))
                if files:
                    # Written whole under another name first: a task that dies leaves no half of an answer.
                    files.create_dir(f"{root}/{request[:2]}", recursive=True)
                    part = f"{name}.{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as out:
                        out.write(answers[-1].encode())
                    files.move(part, name)
            yield frame.assign(raw_response=answers)

    kinds = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in columns)
    return requests.mapInPandas(run, f"{kinds}, raw_response string")


_ANSWER = "domain_id string, candidate_id string, route string, parent_anchor string, reject_reason string, confidence double, justification string, raw_response string"


def read_decisions(told: DataFrame) -> DataFrame:
    """What answers (domain_id, candidate_ids, raw_response) decide: of the candidates asked about, those they name, the last of each id; an answer without JSON fails the task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for domain, ids, raw in frame[["domain_id", "candidate_ids", "raw_response"]].itertuples(index=False):
                answer, known = read_answer(raw), set(ids)
                if answer is None:
                    raise ValueError(f"no JSON in the answer: {raw[:240]}")
                named = {d.get("candidate_id"): d for d in answer.get("decisions") or [] if isinstance(d, dict) and d.get("candidate_id") in known}
                rows += [(domain, i, d.get("route"), d.get("parent_anchor"), d.get("reject_reason"), float(d.get("confidence") or 0), d.get("justification"), raw) for i, d in named.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWER.split(", ")])

    return told.select("domain_id", "candidate_ids", "raw_response").mapInPandas(read, _ANSWER)


def model_decisions(candidates: DataFrame, template: str, generate: Callable[[str], str], size: int = 8, tries: int = 2, wait: float = 4.0, path: str | None = None, model: str = "default") -> DataFrame:
    """What a model decides on candidates (domain_id, candidate_id, payload as JSON), with its raw answer: model_requests(), answered() and read_decisions() in one.

    decisions.complete() fills what no answer names. Without a path, write the result before it is read twice: each read asks again.
    """
    requests = model_requests(candidates, template, size, model)
    spread = requests.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request")
    return read_decisions(answered(spread, generate, path, tries, wait))


def embed_texts(missing: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str | None = None, model: str = "default", size: int = 32, tries: int = 2, wait: float = 4.0) -> DataFrame:
    """missing (text_hash, text) with vector from a model that takes lists of texts: batches of `size` by the order of their digests, kept under a path as answered() keeps answers."""
    rows = ordering.ranked(missing.select("text_hash", "text"), [], ["text_hash"])
    batches = rows.groupBy(F.floor((F.col("n") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("text_hash", "text"))).alias("t"))
    prompt = F.to_json(F.transform("t", lambda x: x["text"]))
    requests = batches.select("batch", F.col("t.text_hash").alias("hashes"), F.col("t.text").alias("texts"), prompt.alias("prompt"), F.sha2(F.concat_ws("\0", F.lit(model), prompt), 256).alias("request"))
    spread = requests.repartition(int(missing.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request")

    def generate(prompt: str) -> str:
        texts = json.loads(prompt)
        made = embed(texts)
        if len(made) != len(texts):
            raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
        return json.dumps([[float(x) for x in v] for v in made])

    told = answered(spread, generate, path, tries, wait)
    vectors = F.from_json("raw_response", "array<array<double>>")
    flat = told.select(F.explode(F.arrays_zip(F.col("hashes").alias("text_hash"), F.col("texts").alias("text"), vectors.alias("vector"))).alias("x"))
    return flat.select("x.text_hash", "x.text", "x.vector")
