"""MinHash near-duplicates by a signature-coordinate inverted join (operator 9).

A document's set holds its distinct shingles of five lower-cased words. Documents of equal sets
form a class, and one of them stands for it. Each of these is posted under its 64 signature
coordinates, as (coordinate, value) pairs. A pair of similarity 0.75 agrees on 48 coordinates on
average, on fewer than ``MATCHES`` with a chance below 1e-5; agreements are counted over posting
lists, and every pair kept is confirmed on its full sets. No list is paired with itself whole:

1. Star: in each list all are paired with the list's most central document; pairs met in several
   lists are confirmed and joined to components. This takes in large groups of copies, a pair a posting.
2. Skip merging: in lists of at most ``SHORT`` that still hold two components, pairs from
   different components are counted. Longer lists are skipped: a pair needs the matches less
   the fewer of its two documents' long lists, so none is missed while that is above 0.
3. Prefix merging: documents with so many long lists that step 2 could miss a pair of theirs,
   mostly made of very common passages, are posted under their shingles, rarest first. Two of
   similarity p share one of the first n - ceil(p n) + 1 of the larger's and the first
   m - ceil(2 p m / (1 + p)) + 1 of the smaller's. Each list is paired with its document of fewest
   own shingles first; then pairs of components that are still different are confirmed. For that, lists
   are cut by bands of set size, of which alike sets are in one or in neighbours, and what is still
   longer than DEAL is dealt to as many blocks, each met by the list in a task of its own.

Links inside a component are not needed to know the component, and are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.components import connected_components
from stepweave.llm.shared import WordHasher, blocks, materialize, mix, release

COORDINATES, MATCHES, SHORT, DEAL, SHINGLE, PERCENT = 64, 32, 32, 512, 5, 75


def _distinct(hasher: WordHasher, column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, _, data, offsets in blocks(column):
        starts, ends, first = hasher.bounds(data, offsets)
        shingles, at = hasher.shingles(hasher(data, starts, ends), first, size)
        for r in range(len(offsets) - 1):
            yield np.unique(shingles[at[r] : at[r + 1]])


def profiler(coordinates: int = COORDINATES, size: int = SHINGLE):
    """mapInArrow function: (id, text) to (id, n_shingles, two words of the set's digest, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        factors = np.random.default_rng(909).integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            ids, n, d1, d2, sigs = batch.column(0), [], [], [], []
            for group in _grouped(_distinct(hasher, batch.column(1), size)):
                counts = np.array([len(x) for x in group])
                full = np.flatnonzero(counts)
                sig = np.zeros((len(group), coordinates), np.int64)
                one, two = np.zeros(len(group), np.uint64), np.zeros(len(group), np.uint64)
                if len(full):
                    everything = np.concatenate(group)
                    cuts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                    one[full] = mix(np.add.reduceat(mix(everything ^ np.uint64(0x5851F42D4C957F2D)), cuts))
                    two[full] = mix(np.add.reduceat(mix(everything + np.uint64(0x14057B7EF767814F)), cuts))
                    for k, factor in enumerate(factors):
                        sig[full, k] = np.minimum.reduceat(everything * factor, cuts) >> np.uint64(32)
                n.append(counts), d1.append(one.view(np.int64)), d2.append(two.view(np.int64)), sigs.append(sig)
            flat = pa.array(np.concatenate(sigs).ravel() if sigs else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * coordinates), flat)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, cat(n), cat(d1), cat(d2), lists], names=["doc", "n", "d1", "d2", "sig"])

    return run


def _grouped(sets: Iterator[np.ndarray], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    group, held = [], 0
    for x in sets:
        group.append(x)
        held += len(x)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def setter(size: int = SHINGLE):
    """mapInArrow function: (id, text) to (id, the set's sorted hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            packed = [x.tobytes() for x in _distinct(hasher, batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "set"])

    return run


def shingler(size: int = SHINGLE):
    """mapInArrow function: (id, text) to a row (id, set size, hash) per distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for group in _grouped(_distinct(hasher, batch.column(1), size)):
                n = np.array([len(x) for x in group])
                rows = np.repeat(np.arange(at, at + len(group)), n)
                at += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(np.repeat(n, n)), pa.array(np.concatenate(group).view(np.int64))], names=["node", "n", "s"])

    return run


def confirmer(percent: int = PERCENT):
    """mapInArrow function: (a, b, set of a, set of b) to the pairs of at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; sets are made of the paired texts only.

    A node that is in very many pairs is a hot key of one join; adaptive execution splits it.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = texts.join(ends, texts["doc"] == ends["node"], "left_semi")
    sets = materialize(wanted.mapInArrow(setter(size), "node long, set binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    found = materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(confirmer(percent), "a long, b long"), "links")
    release(sets)
    return found


def alike(x, y, percent: int = PERCENT):
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def prefix_links(hot: DataFrame, texts: DataFrame, so_far: DataFrame, size: int, percent: int, deal: int = DEAL) -> DataFrame:
    """Step 3: components of the links so far and of all links between hot documents (node, component).

    Tables that two sides of a join read are written first, so that adaptive execution can split the
    tasks of a very common shingle.
    """
    members = texts.join(hot, texts["doc"] == hot["node"], "left_semi").mapInArrow(shingler(size), "node long, n long, s long")
    members = materialize(members.join(hot, "node"), "members")
    common = materialize(members.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "common")
    own = Window.partitionBy("node")
    ranked = members.join(common, "s").withColumn("lone", F.col("n") - F.count("*").over(own))
    ranked = ranked.withColumn("rank", F.col("lone") + F.row_number().over(own.orderBy("df", "s")))
    # Of sets of sizes m <= n, the smaller shares at least 2p / (1 + p) of itself, the larger p: the rest + 1 is the prefix.
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("s", "node", "n", "component", "lone", "rank")
    prefix = materialize(prefix, "prefix")
    release(members, common)

    # A star first, around the document of fewest own shingles in each list: what it links needs no pairs any more.
    least = prefix.groupBy("s").agg(F.min(F.struct("lone", F.xxhash64(F.lit(7), "node").alias("h"), F.col("node"), F.col("n"), F.col("component"))).alias("hub"))
    least = materialize(least, "least")
    star = prefix.join(least, "s").where((F.col("node") != F.col("hub.node")) & (F.col("component") != F.col("hub.component")) & alike(F.col("n"), F.col("hub.n"), percent))
    around = confirm(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), texts, size, percent)
    joined = connected_components(around.union(so_far))
    release(least)

    # Alike sizes are in one band or in neighbours; lists of one component in such bands are done.
    step = F.lit(100.0 / percent)
    left = prefix.drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = materialize(left.withColumn("band", F.floor(F.log("n") / F.log(step))), "left")
    release(prefix)
    of_band = left.groupBy("s", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    near = of_band.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    lists = near.groupBy("s", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size")).where("lo <> hi")
    lists = materialize(lists.select("s", "band", F.ceil(F.col("size") / deal).alias("blocks")), "lists")
    # x is the smaller set: its own band meets sets of this band and of the next, and each block of them.
    small = F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    x = left.where(small).join(lists, ["s", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).alias("x")
    y = left.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).join(lists, ["s", "band"])
    y = y.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("y")
    most = F.least(F.col("x.n") - F.col("x.lone"), F.col("y.n") - F.col("y.lone"))
    before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    # At a pair's first common shingle no more can be common than what follows it in either; other rows of the pair may go.
    follows = 1 + F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))
    enough = (100 + percent) * F.least(follows, most) >= percent * (F.col("x.n") + F.col("y.n"))
    possible = enough & before & (F.col("x.component") != F.col("y.component")) & alike(F.col("x.n"), F.col("y.n"), percent)
    same = (F.col("x.s") == F.col("y.s")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block"))
    pairs = x.join(y, same & possible).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    third = confirm(pairs, texts, size, percent)
    out = joined if third.isEmpty() else connected_components(third.union(joined.select("node", "component")))
    if out is not joined:
        release(joined)
    release(around, left, lists, third)
    return out


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, short: int = SHORT) -> DataFrame:
    """id_col, n_shingles, class_id, component_id, kept, a row per row of documents.

    class_id is the smallest id with the same set, component_id the smallest id reachable over
    links, kept says that a document is its component's smallest id. A null or wordless text has
    no shingles and is linked with nothing; fewer than `size` words make one shingle; repeated
    rows share a class; a null id is never the smallest, and its row is kept only if its class
    has no id at all. Ids are taken to name one text each. An empty table gives no rows. Columns
    other than these two may have any name.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    profile = materialize(texts.mapInArrow(profiler(coordinates, size), "doc long, n long, d1 long, d2 long, sig array<long>"), "profile")
    classes = materialize(profile.where("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("class_id")), "classes")
    named = profile.join(classes.where("class_id IS NOT NULL").select(F.col("class_id").alias("doc")).distinct(), "doc", "left_semi").where("n > 0")
    mixed = lambda c: F.xxhash64(F.lit(7), c)
    postings = materialize(
        named.select(F.col("doc").alias("node"), "n", F.posexplode("sig").alias("c", "v")).select("node", "n", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("key")), "postings"
    )
    lists = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(postings.join(lists, "key").select("key", "node", "n", "size"), "shared")
    release(postings)

    # A list's most central document is in the most lists of about its size: in a group of near copies, one with few changes.
    sized = shared.withColumn("band", F.floor(F.log2("size")))
    central = sized.groupBy("node", "band").agg(F.count("*").alias("score"))
    hubs = sized.join(central, ["node", "band"]).groupBy("key").agg(F.max(F.struct("score", mixed("node").alias("h"), F.col("node"), F.col("n"))).alias("hub"))
    star = shared.join(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "key")
    star = star.where((F.col("node") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"), percent)).groupBy("hub", "node").agg(F.count("*").alias("met")).where("met >= 4")
    links = confirm(star.select(F.col("hub").alias("a"), F.col("node").alias("b")), texts, size, percent)
    found = connected_components(links)

    def unsettled(links_so_far: DataFrame) -> DataFrame:
        """Postings of lists that hold two components at least."""
        held = shared.select("key", "node", "n", "size").join(links_so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return held.join(open_, "key")

    open_lists = materialize(unsettled(found), "open")
    long_lists = open_lists.where(F.col("size") > short).groupBy("node").agg(F.count("*").alias("skipped"))
    brief = open_lists.where(F.col("size") <= short).select("key", "node", "n", "component")
    x, y = brief.alias("x"), brief.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & alike(F.col("x.n"), F.col("y.n"), percent))
    met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("met"))
    skipped = lambda c: long_lists.select(F.col("node").alias(c), F.col("skipped").alias(f"skipped_{c}"))
    met = met.join(skipped("a"), "a", "left").join(skipped("b"), "b", "left")
    enough = F.col("met") + F.least(F.coalesce("skipped_a", F.lit(0)), F.coalesce("skipped_b", F.lit(0))) >= matches
    second = confirm(met.where(enough).select("a", "b"), texts, size, percent)

    hot = long_lists.where(F.col("skipped") >= matches).select("node").join(found, "node", "left")
    hot = materialize(hot.select("node", F.coalesce("component", "node").alias("component")), "hot")
    release(open_lists, shared)
    so_far = second.union(links).union(found.select("node", "component"))
    if hot.isEmpty():
        joined = found if second.isEmpty() else connected_components(so_far)
    else:
        joined = prefix_links(hot, texts, so_far, size, percent)
    if joined is not found:
        release(found)
    release(hot, links, second)
    classes = classes.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select("d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = profile.select("doc", F.col("n").alias("n_shingles"), "d1", "d2").join(classes, ["d1", "d2"], "left")
    out = out.withColumn("empty", F.col("n_shingles") == 0)
    out = out.select(F.col("doc").alias(id_col), "n_shingles", F.when(F.col("empty"), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("empty"), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


#: Exact links over all pairs that share a shingle; {src} is a table with doc_id and text.
LINKS_SQL = r"""
s_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {src}),
s_sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM s_words),
s_sizes AS (SELECT doc_id, count(*) AS n FROM s_sets GROUP BY doc_id),
s_all AS (SELECT doc_id, coalesce(n, 0) AS n FROM {src} LEFT JOIN s_sizes USING (doc_id)),
s_met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s_sets a JOIN s_sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
s_links AS (SELECT a, b FROM s_met JOIN s_sizes x ON x.doc_id = a JOIN s_sizes y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
s_both AS (SELECT a, b FROM s_links UNION ALL SELECT b, a FROM s_links),
s_reach AS (SELECT doc_id AS a, doc_id AS b FROM s_all UNION SELECT r.a, l.b FROM s_reach r JOIN s_both l ON r.b = l.a),
s_component AS (SELECT a AS doc_id, min(b) AS component_id FROM s_reach GROUP BY a),
s_class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY set_of) AS class_id FROM (SELECT doc_id, list_sort(list(s)) AS set_of FROM s_sets GROUP BY doc_id))
"""
ORACLE = "WITH RECURSIVE " + LINKS_SQL.format(src="documents") + "SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept, coalesce(class_id, doc_id) AS class_id FROM s_all JOIN s_component USING (doc_id) LEFT JOIN s_class USING (doc_id)"
