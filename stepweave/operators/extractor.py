"""Concepts and relations of documents by a model, and whole evidence records from them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.operators import providers
from stepweave.operators.records import Extracted, compose_records

#: What an answer holds.
PAYLOAD = (
    "struct<concepts:array<struct<label:string,description:string,surface_form:string,node_worthy:boolean,semantic_type_hint:string,shared_hypernym:string>>,relations:array<struct<label:string,family:string,head:string,tail:string>>,"
    "state_transitions:array<struct<from_state:string,to_state:string,trigger_step:string,evidence_label:string>>,diagnostic_edges:array<struct<evidence_label:string,indicated_label:string,mechanism:string>>,extraction_quality:string>"
)


def answers(documents: DataFrame, template: str, generate: Callable[[str], str], path: str | None = None, model: str = "default", families: tuple[str, ...] = tuple(K.TYPE_CONSTRAINTS), backbone: tuple[str, ...] = K.ANCHORS, tries: int = 2, wait: float = 4.0) -> DataFrame:
    """doc_id and payload (PAYLOAD, null for a null content) of documents (doc_id, content): a prompt each, kept under a path as providers.answered() keeps answers.

    The template's __DOCUMENT_CONTENT__, __BACKBONE_CONCEPTS_JSON__ and __RELATION_FAMILIES_JSON__ are filled in. An answer without JSON fails the task.
    """

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = [providers.filled(template, BACKBONE_CONCEPTS_JSON=list(backbone), RELATION_FAMILIES_JSON=list(families), DOCUMENT_CONTENT=c) for c in frame["content"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "prompt": prompts, "request": [hashlib.sha256(f"{model}\0{p}".encode()).hexdigest() for p in prompts]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for doc, raw in zip(frame["doc_id"], frame["raw_response"], strict=True):
                answer = providers.read_answer(raw)
                if answer is None:
                    raise ValueError(f"no JSON in the answer on {doc}: {raw[:240]}")
                found.append(json.dumps(answer))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "payload": found})

    asking = documents.where("content IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    spread = asking.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    requests = spread.mapInPandas(told, "doc_id string, prompt string, request string")
    kept = providers.answered(requests, generate, path, tries, wait).mapInPandas(read, "doc_id string, payload string")
    return kept.select("doc_id", F.from_json("payload", PAYLOAD).alias("payload"))


def extracted(told: DataFrame) -> Extracted:
    """The four tables of answers() that records.compose_records() takes."""
    listed = lambda name: told.select("doc_id", F.posexplode(f"payload.{name}").alias("pos", "x")).where("x IS NOT NULL")
    x = F.col("x")
    concepts = listed("concepts").select("doc_id", "pos", x["label"].alias("label"), x["description"].alias("description"), x["surface_form"].alias("surface_form"), x["node_worthy"].alias("node_worthy"), x["semantic_type_hint"].alias("hint"), x["shared_hypernym"].alias("hypernym"))
    return Extracted(concepts, *(listed(name).select("doc_id", "pos", "x.*") for name in ("relations", "state_transitions", "diagnostic_edges")))


def records_of_documents(documents: DataFrame, template: str, generate: Callable[[str], str], path: str | None = None, **how) -> DataFrame:
    """Evidence records of documents (doc_id, domain_id, role, doc_type, timestamp, content): what a model finds in them, composed."""
    told = answers(documents, template, generate, path, **how).checkpoint()
    return compose_records(documents, extracted(told))
