"""Queries that apply the operators to whole tables, each with its twin in DuckDB SQL.

Tables stand in for the graph's own: conversations for procedures (a turn is a step), documents
and parts for concepts, languages and sources for domains, events for facts about users,
regions to suppliers for structural edges, embeddings for candidates and anchors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions import procedures
from stepweave.functions import text as T
from stepweave.operators import assembly, attachment, audits, evidence, extraction, graph, metrics, providers, records, routing, temporal, vector_search, versions
from stepweave.session import ensure_checkpoint_dir
from stepweave.streaming.steps import windowed_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_words(words: str) -> str:
    return f"'(?i)(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)'"


def sql_case(column: str, table_: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {sql_words(w)}) THEN '{n}'" for n, w in table_) + " END"


def spoken(table_: tuple) -> list[str]:
    """Every word of a table of word lists, and one that stands in none: rows that get them by their keys reach every branch."""
    return [w for _, words in table_ for w in words.split("|")] + ["plain"]


def sql_spoken(table_: tuple, key: str) -> str:
    words = spoken(table_)
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({key}) % {len(words)} + 1]"


def word_of(table_: tuple, key) -> Column:
    words = spoken(table_)
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


@query("SELECT conv_id, 'T' || (turn + 1) AS step_id, lead('T' || (turn + 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS next_step FROM conversations")
def step_sequence_edges(spark, sf_dir):
    name = F.concat(F.lit("T"), (F.col("turn") + 1).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", name.alias("step_id"), F.lead(name).over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_step"))


@query(f"SELECT coalesce({sql_case('said', K.PHASES)}, 'none') AS phase, count(*) AS steps, count(DISTINCT conv_id) AS procedures FROM (SELECT conv_id, text || ' ' || {sql_spoken(K.PHASES, 'conv_id * 7 + turn')} AS said FROM conversations) GROUP BY 1")
def step_phase_distribution(spark, sf_dir):
    """Turns, each with a further word by its key, so that every word of every phase is met."""
    said = F.concat("text", F.lit(" "), word_of(K.PHASES, F.col("conv_id") * 7 + F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy(F.coalesce(T.step_phase(said), F.lit("none")).alias("phase")).agg(F.count("*").alias("steps"), F.count_distinct("conv_id").alias("procedures"))


@query(r"SELECT conv_id || ':T' || (turn + 1) AS label, 'conversations::node::' || conv_id || ':T' || (turn + 1) AS node_id, CAST(turn + 1 AS INTEGER) AS order_index, " + f"{sql_case('text', K.PHASES)} AS step_phase FROM conversations")
def workflow_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("domain_id"), F.col("conv_id").cast("string").alias("evidence_id"), F.lit("").alias("timestamp"), F.lit(1).alias("record_idx"), F.col("turn").cast("int").alias("step_pos"), F.struct(F.concat(F.lit("T"), (F.col("turn") + 1).cast("string")).alias("step_id"), T.step_phase(F.col("text")).alias("step_phase")).alias("step"))
    return graph.workflow_nodes(c).select("label", "node_id", "order_index", "step_phase")


@query(f"SELECT doc_id, md5(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(12288) || chr(160)) ELSE text END, '{T.BLANKS}', ' ', 'g'))) AS digest FROM documents")
def normalize_whitespace(spark, sf_dir):
    """Documents, a third of them with other blanks than those of ASCII."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\u3000\u00a0"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_space(text).cast("binary")).alias("digest"))


@query("SELECT text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash FROM documents) GROUP BY 1")
def text_hash_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.text_hash(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT p_partkey, CASE WHEN length(last) > 4 AND last LIKE '%ies' THEN before || substr(last, 1, length(last) - 3) || 'y' WHEN length(last) > 2 AND last LIKE '%es' THEN before || substr(last, 1, length(last) - 2) WHEN length(last) > 2 AND last LIKE '%s' AND last NOT LIKE '%ss' AND last NOT LIKE '%us' AND last NOT LIKE '%is' THEN before || substr(last, 1, length(last) - 1) ELSE label END AS label FROM (SELECT p_partkey, label, split_part(label, ' ', 2) AS last, split_part(label, ' ', 1) || ' ' AS before FROM (SELECT p_partkey, p_name || 's' AS label FROM part))")
def canonical_part_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_label(F.concat("p_name", F.lit("s"))).alias("label"))


_HINTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, {sql_words(w)}) THEN '{n}' END" for n, w in K.HINT_WORDS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_HINTS}, ',') AS hints FROM (SELECT doc_id, concat(text, ' ', {sql_spoken(K.HINT_WORDS, 'doc_id')}, ', ', {sql_spoken(K.HINT_WORDS, 'doc_id * (doc_id % 2)')}) AS said FROM documents)")
def type_hint_candidates(spark, sf_dir):
    """Documents, each with two further words by its id, so that every word of every type is met, and pairs of types."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), word_of(K.HINT_WORDS, F.col("doc_id")), F.lit(", "), word_of(K.HINT_WORDS, F.col("doc_id") * (F.col("doc_id") % 2)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.hint_candidates(said), ",").alias("hints"))


@query(
    f"SELECT coalesce(CASE WHEN doc_id % 11 = 0 THEN 'Signal' END, CASE WHEN doc_id % 7 = 0 THEN 'Seal' END, {sql_case('said', K.ANCHOR_WORDS)}, 'none') AS anchor, count(*) AS documents FROM (SELECT doc_id, concat(text, ' ', {sql_spoken(K.ANCHOR_WORDS, 'doc_id')}) AS said FROM documents) GROUP BY 1"
)
def preferred_anchor(spark, sf_dir):
    """Documents with a hint, a hypernym or neither by their ids, and a further word."""
    key = F.col("doc_id")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), word_of(K.ANCHOR_WORDS, key))
    anchor = attachment.preferred_anchor(F.when(key % 11 == 0, "Signal"), F.when(key % 7 == 0, "Seal"), said)
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(anchor, F.lit("none")).alias("anchor")).agg(F.count("*").alias("documents"))


def _part_mentions(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("orders").alias("domain_id"), F.col("p_name").alias("label"), F.col("l_orderkey").alias("record_idx"), F.lit(1).alias("origin"), F.col("l_linenumber").alias("step_pos"), F.col("l_partkey").alias("pos"), F.col("p_type").alias("description"))


@query(f"WITH m AS (SELECT *, p_partkey FROM (SELECT l.l_orderkey AS rec, l.l_linenumber AS pos, p.p_partkey, p.p_name AS label, p.p_type AS descr FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)), c AS (SELECT label, descr, count(*) AS n, min((rec, pos, p_partkey)) AS f FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, f) AS k FROM c) SELECT label, CAST(sum(n) AS BIGINT) AS support, max(CASE WHEN k = 1 THEN descr END) AS description FROM r GROUP BY label")
def candidate_aggregation(spark, sf_dir):
    rows = _part_mentions(spark, sf_dir)
    best = evidence.majority(rows, ["domain_id", "label"], "description", ["record_idx", "step_pos", "pos"], "description")
    return rows.groupBy("domain_id", "label").agg(F.count("*").alias("support")).join(best, ["domain_id", "label"]).select("label", "support", "description")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM c) SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS hint, string_agg(event_type, ',' ORDER BY event_type) AS candidates FROM t WHERE n = top GROUP BY user_id")
def dominant_hint(spark, sf_dir):
    out = evidence.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", "hint")
    return out.select("user_id", "hint", F.array_join("hint_candidates", ",").alias("candidates"))


_ANCHOR_SQL = "anchors AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), a AS (SELECT anchors.label, embedding AS av FROM anchors JOIN embeddings USING (vec_id)), scores AS (SELECT vec_id AS candidate_id, a.label AS anchor, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(av AS DOUBLE[])), 5) AS score FROM embeddings, a)"


def _anchors(e: DataFrame) -> DataFrame:
    return e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("m")).select(F.col("label").alias("anchor"), F.col("label").alias("position"), F.col("m.embedding").alias("anchor_vector"))


@query(f"WITH {_ANCHOR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, anchor) AS rank FROM scores) SELECT candidate_id, anchor, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def anchor_topk(spark, sf_dir):
    """Scores are ranked as they are given, to five digits."""
    e = table(spark, sf_dir, "embeddings")
    return routing.rank_anchors(e.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector")), _anchors(e), ranked_by=5)


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0) SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def nearest_vectors(spark, sf_dir):
    """The ten nearest of all vectors for those whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    found = vector_search.nearest(e.where("vec_id % 50 = 0"), e, 10, "vec_id", "embedding")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def indexed_vectors(spark, sf_dir):
    """The same through an inverted file, with as many probes as a sample of the queries needs for a recall of 0.95."""
    ensure_checkpoint_dir(spark)
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0")
    index = vector_search.build(e, f"{spark.sparkContext.getCheckpointDir()}/inverted-file-{uuid.uuid4().hex}", None, "vec_id", "embedding")
    probes = vector_search.probes_for(index, queries, 10, 0.95, id_col="vec_id", vector="embedding")
    found = vector_search.search(index, queries, 10, probes, "vec_id", "embedding")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


#: An inverted file's lists depend on its fit: no SQL; its recall is tested.
QUERIES["indexed_vectors"] = indexed_vectors


_RERANK_SQL = "p AS (SELECT label, embedding AS av FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 3), s AS (SELECT vec_id AS candidate_id, p.label AS anchor, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(av AS DOUBLE[])) AS c, CASE WHEN e.label = p.label THEN 0.2 ELSE 0 END AS adj FROM embeddings e, p), j AS (SELECT candidate_id, anchor, round(0.75 * max(c) + 0.25 * avg(c) + first(adj), 5) AS score FROM s GROUP BY ALL)"


@query(f"WITH {_RERANK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, anchor) AS rank FROM j) SELECT candidate_id, anchor, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def anchor_rerank(spark, sf_dir):
    """Scores are ranked as they are given, to five digits."""
    e = table(spark, sf_dir, "embeddings")
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("k <= 3")
    anchors = first.groupBy(F.col("label").alias("position")).agg(F.collect_list("embedding").alias("prototypes")).withColumn("anchor", F.col("position").cast("string"))
    none = F.lit(None).cast("array<string>")
    candidates = e.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("hint"), none.alias("hint_candidates"), F.lit(None).cast("string").alias("hypernym"), none.alias("families"))
    return routing.rerank_anchors(candidates, anchors, ranked_by=5).withColumn("anchor", F.col("anchor").cast(e.schema["label"].dataType))


_EDGES_SQL = "edges AS (SELECT r_name AS head, n_name AS tail, 'Asset' AS head_type, 'Component' AS tail_type, 'structural' AS family FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, s_name, 'Component', 'Connector', 'structural' FROM nation JOIN supplier ON n_nationkey = s_nationkey UNION ALL SELECT n_name, c_name, 'Component', 'Signal', 'structural' FROM nation JOIN customer ON n_nationkey = c_nationkey)"


def _edges(spark, sf_dir) -> DataFrame:
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    made = lambda df, h, t, ht, tt: df.select(F.col(h).alias("head"), F.col(t).alias("tail"), F.lit(ht).alias("head_type"), F.lit(tt).alias("tail_type"), F.lit("structural").alias("family"))
    return (
        made(region.join(nation, region["r_regionkey"] == nation["n_regionkey"]), "r_name", "n_name", "Asset", "Component")
        .unionByName(made(nation.join(supplier, nation["n_nationkey"] == supplier["s_nationkey"]), "n_name", "s_name", "Component", "Connector"))
        .unionByName(made(nation.join(customer, nation["n_nationkey"] == customer["c_nationkey"]), "n_name", "c_name", "Component", "Signal"))
    )


@query(f"WITH {_EDGES_SQL} SELECT head, tail, 'geo::edge::' || head || '::contains::' || tail AS edge_id FROM edges")
def structural_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("head", "tail", F.concat_ws("::", F.lit("geo"), F.lit("edge"), "head", F.lit("contains"), "tail").alias("edge_id"))


def sql_type_reason(family: str, head: str, tail: str) -> str:
    out = ""
    for name, ends in K.TYPE_CONSTRAINTS.items():
        for end, value, allowed in (("head", head, ends[0]), ("tail", tail, ends[1])):
            told = f" not allowed for family '{name}' (allowed: {list(allowed)})".replace("'", "''")
            among = ", ".join(f"'{x}'" for x in allowed)
            out += f" WHEN {family} = '{name}' AND coalesce({value}, 'Unknown') NOT IN ({among}) THEN '{end} type ' || chr(39) || coalesce({value}, 'Unknown') || chr(39) || '{told}'"
    return f"CASE{out} END"


@query(f"WITH {_EDGES_SQL} SELECT head_type, tail_type, {sql_type_reason('family', 'head_type', 'tail_type')} AS invalid_reason, count(*) AS n FROM edges GROUP BY ALL")
def type_constraints(spark, sf_dir):
    return graph.split_by_types(_edges(spark, sf_dir)).groupBy("head_type", "tail_type", "invalid_reason").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS targets, count(*) AS relations FROM lineitem GROUP BY ALL) SELECT l_returnflag AS family, CAST(sum(CASE WHEN targets > 1 THEN relations ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(relations) AS BIGINT) AS relations FROM t GROUP BY 1")
def multi_target_reject(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count_distinct("l_suppkey").alias("targets"), F.count("*").alias("relations"))
    return t.groupBy(F.col("l_returnflag").alias("family")).agg(F.sum(F.when(F.col("targets") > 1, F.col("relations")).otherwise(0)).alias("rejected"), F.sum("relations").alias("relations"))


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS first_id, arg_min(value, event_id) AS first_value, arg_min(value, event_id) FILTER (WHERE value > 50) AS first_high, count(*) AS mentions FROM events GROUP BY ALL")
def edge_upsert_first_nonnull(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("first_id"), F.col("event_id").alias("seq"), F.col("value").alias("first_value"), F.when(F.col("value") > 50, F.col("value")).alias("first_high"))
    out = graph.upsert_edges(e, ["first_id", "first_value"], ["first_high"], keys=("user_id", "event_type"))
    return out.select("user_id", "event_type", "first_id", "first_value", "first_high", "mentions")


_TRIPLES_SQL = "triples AS (SELECT l_returnflag AS domain_id, CASE WHEN l_quantity < 10 THEN 'structural_low_value_tail' WHEN l_quantity < 20 THEN 'structural_self_loop' END AS reject_reason FROM lineitem)"


@query(f"WITH {_TRIPLES_SQL} SELECT domain_id, reject_reason, CAST(2 * grouping(domain_id) + grouping(reject_reason) AS BIGINT) AS level, count(*) AS n FROM triples GROUP BY GROUPING SETS ((domain_id), (reject_reason), (domain_id, reject_reason))")
def reject_audit(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("domain_id"), F.when(q < 10, "structural_low_value_tail").when(q < 20, "structural_self_loop").alias("reject_reason"))
    return graph.reject_audit(rows)


_STREAM_SQL = f"c AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, text, 'T' || (turn + 1) AS s, lead('T' || (turn + 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, {sql_case('text', K.PHASES)} AS phase FROM conversations), r AS (SELECT conv_id, 0 AS o, turn, 0 AS k, 'triggers' AS label, s AS head, nx AS tail FROM c WHERE nx IS NOT NULL UNION ALL SELECT conv_id, 0, turn, 1, coalesce(phase, 'observes'), s, role FROM c UNION ALL SELECT conv_id, 1, turn, 0, 'contains', role, 'conversation' FROM c UNION ALL SELECT conv_id, 1, turn, 1, 'indicates', role, 'question' FROM c WHERE contains(text, '?') UNION ALL SELECT conv_id, 1, turn, 2, 'transitionsTo', 'start', role FROM c WHERE turn = 0 UNION ALL SELECT conv_id, 2, min(turn), 0, 'indicates', role, 'conversation' FROM c GROUP BY conv_id, role)"


def _conversation_records(spark, sf_dir) -> DataFrame:
    """Conversations as evidence records: turns are steps that act on their role, questions are diagnostics."""
    name = F.concat(F.lit("T"), (F.col("turn") + 1).cast("string"))
    c = table(spark, sf_dir, "conversations").withColumn("next", F.lead(name).over(Window.partitionBy("conv_id").orderBy("turn")))
    text = lambda value, as_: (F.lit(value) if isinstance(value, str) or value is None else value).cast("string").alias(as_)
    relation = lambda label, family, head, tail: F.struct(text(label, "label"), text(family, "family"), text(head, "head"), text(tail, "tail"))
    some = lambda when, x: F.filter(F.array(x), lambda _: when)
    role = F.col("role")
    step = F.struct(
        "turn", name.alias("step_id"), F.col("next").alias("sequence_next"), F.array(F.struct(F.coalesce(T.step_phase(F.col("text")), F.lit("observes")).alias("action_type"), role.alias("target_label"))).alias("step_actions"),
        F.array(relation("contains", "structural", role, "conversation")).alias("relation_mentions"), F.filter(F.array(relation("", "", "", "")), lambda _: F.lit(False)).alias("structural_edges"),
        some(F.contains(F.col("text"), F.lit("?")), F.struct(text(role, "evidence_label"), text("question", "indicated_label"), text(None, "mechanism"))).alias("diagnostic_edges"),
        some(F.col("turn") == 0, F.struct(text("start", "from_state"), text(role, "to_state"), text(None, "trigger_step"), text(None, "evidence_label"))).alias("state_transitions"),
    )
    told = c.select("conv_id", step.alias("step"), F.struct("turn", relation("indicates", "communication", role, "conversation").alias("r")).alias("told"))
    grouped = told.groupBy(F.col("conv_id").cast("string").alias("evidence_id")).agg(F.array_sort(F.collect_list("step")).alias("step_records"), F.array_sort(F.collect_list("told")).alias("told"))
    crossing = "array<struct<label:string,family:string,head:string,tail:string,head_step:string,tail_step:string>>"
    return grouped.select(
        F.lit("conversations").alias("domain_id"), "evidence_id", F.lit(1).alias("record_idx"), F.lit("").alias("timestamp"), "step_records",
        F.transform("told", lambda t: t["r"]).alias("document_relation_mentions"), F.array().cast(crossing).alias("cross_step_relations"),
    )


@query(f"WITH {_STREAM_SQL} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o, turn, k) AS seq, label, head, tail FROM r")
def relation_stream(spark, sf_dir):
    out = assembly.relation_stream(_conversation_records(spark, sf_dir))
    return out.select(F.col("evidence_id").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "label", "head", "tail")


_JUDGED_SQL = f"""nodes AS (
  SELECT DISTINCT 'p' || (p_partkey % 40) AS label, CASE p_partkey % 4 WHEN 0 THEN 'Component' WHEN 1 THEN 'Signal' WHEN 2 THEN 'Fault' ELSE 'Asset' END AS type, (p_partkey % 40) * 10 AS first FROM part
  UNION SELECT DISTINCT 's' || (s_suppkey % 30), CASE s_suppkey % 3 WHEN 0 THEN 'Component' WHEN 1 THEN 'State' ELSE 'Fault' END, 0 FROM supplier),
stream AS (
  SELECT l_orderkey AS rec, l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'document' WHEN 'N' THEN 'step' ELSE 'workflow' END AS origin, 'relates' AS label,
    CASE l_linenumber WHEN 2 THEN 'communication' WHEN 3 THEN 'propagation' WHEN 4 THEN 'lifecycle' WHEN 5 THEN 'task_dependency' WHEN 6 THEN 'odd' ELSE 'structural' END AS family,
    'p' || (l_partkey % 40) AS head, CASE WHEN l_linenumber = 7 THEN 'p' || (l_partkey % 40) ELSE 's' || (l_suppkey % 30) END AS tail FROM lineitem),
joined AS (
  SELECT s.*, h.type AS ht, t.type AS tt, h.label IS NOT NULL AS hin, t.label IS NOT NULL AS tin, min(s.tail) OVER w <> max(s.tail) OVER w AS several
  FROM stream s LEFT JOIN nodes h ON s.head = h.label AND h.first <= s.rec LEFT JOIN nodes t ON s.tail = t.label AND t.first <= s.rec WINDOW w AS (PARTITION BY s.rec, s.origin, s.head, s.label, s.family)),
judged AS (SELECT *, CASE WHEN family = 'odd' THEN 'invalid_relation_family' WHEN origin = 'document' AND family IN ('communication', 'propagation') AND several THEN 'multi_target_diagnostic_hypothesis'
    WHEN family = 'structural' AND head = tail THEN 'structural_self_loop' WHEN family = 'task_dependency' AND hin AND tin THEN 'task_dependency_requires_workflow_head'
    WHEN family = 'task_dependency' THEN concat_ws(';', CASE WHEN NOT hin THEN 'head:not_in_graph' END, CASE WHEN NOT tin THEN 'tail:not_in_graph' END)
    WHEN NOT (hin AND tin) THEN 'semantic_relation_requires_semantic_nodes' WHEN family = 'structural' AND NOT (ht IN ('Asset', 'Component') AND tt IN ('Asset', 'Component')) THEN 'structural_requires_stable_components'
    ELSE 'type_constraint:' || {sql_type_reason('family', 'ht', 'tt')} END AS reject_reason FROM joined)"""


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Order lines as relations of parts to suppliers, one record per order, judged; and the nodes."""
    part, supplier, line = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    named = lambda letter, key, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
    among = lambda key, *types: F.element_at(F.array(*map(F.lit, types)), (F.col(key) % len(types) + 1).cast("int"))
    nodes = part.select(named("p", "p_partkey", 40).alias("label"), among("p_partkey", "Component", "Signal", "Fault", "Asset").alias("parent_anchor"), (F.col("p_partkey") % 40 * 10).alias("first_record_idx"))
    nodes = nodes.union(supplier.select(named("s", "s_suppkey", 30), among("s_suppkey", "Component", "State", "Fault"), F.lit(0).cast("long"))).distinct()
    nodes = nodes.select(F.lit("d").alias("domain_id"), "label", F.lit("semantic").alias("layer"), "parent_anchor", "first_record_idx")
    n, flag, head = F.col("l_linenumber"), F.col("l_returnflag"), named("p", "l_partkey", 40)
    family = F.when(n == 2, "communication").when(n == 3, "propagation").when(n == 4, "lifecycle").when(n == 5, "task_dependency").when(n == 6, "odd").otherwise("structural")
    stream = line.select(
        F.lit("d").alias("domain_id"), F.col("l_orderkey").cast("string").alias("evidence_id"), F.col("l_orderkey").alias("record_idx"), F.lit("").alias("timestamp"), n.alias("seq"),
        F.when(flag == "A", "document").when(flag == "N", "step").otherwise("workflow").alias("origin"), F.lit("relates").alias("label"), family.alias("family"), head.alias("head"),
        F.when(n == 7, head).otherwise(named("s", "l_suppkey", 30)).alias("tail"), *(F.lit(None).cast("string").alias(c) for c in ("head_step", "tail_step", "source_field", "mechanism", "evidence_label")),
    )
    return graph.judge_relations(stream, nodes), nodes


@query(f"WITH {_JUDGED_SQL} SELECT rec, CAST(seq AS BIGINT) AS seq, CASE WHEN reject_reason IS NULL THEN 'accepted' WHEN reject_reason LIKE 'type_constraint:%' THEN 'rejected_type' ELSE 'rejected' END AS status, reject_reason, 'd::triple::' || rec || '::' || seq AS triple_id FROM judged")
def judged_relations(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select(F.col("record_idx").alias("rec"), F.col("seq").cast("long").alias("seq"), "status", "reject_reason", "triple_id")


@query(f"WITH {_JUDGED_SQL}, rows AS (SELECT head, label, tail, family, rec FROM judged WHERE reject_reason IS NULL UNION ALL SELECT label, 'is_a', type, 'is_a', first FROM nodes) SELECT 'd::edge::' || head || '::' || label || '::' || tail AS edge_id, arg_min(family, rec) AS family, count(*) AS mentions, min(rec) AS first_record_idx, array_to_string(list_sort(list(DISTINCT rec)), ',') AS provenance FROM rows GROUP BY head, label, tail")
def assembled_edges(spark, sf_dir):
    out = assembly.graph_edges(*_shown(spark, sf_dir))
    return out.select("edge_id", "family", "mentions", "first_record_idx", F.array_join("provenance", ",").alias("provenance"))


def _shown(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Judged relations as triples, and the anchored nodes."""
    judged, nodes = _judged(spark, sf_dir)
    none = F.lit(None).cast("string")
    shown = judged.select("*", F.col("label").alias("display_label"), none.alias("salience"), F.lit(True).alias("display_admitted"), none.alias("hidden"))
    zero = lambda name: F.lit(0).alias(name)
    anchored = nodes.select(
        "domain_id", "label", "parent_anchor", F.col("first_record_idx").cast("string").alias("evidence_id"), F.col("first_record_idx").alias("record_idx"), F.lit("").alias("timestamp"),
        F.struct(F.col("first_record_idx").alias("record_idx"), zero("origin"), zero("step_pos"), zero("pos")).alias("at"),
    )
    return shown, anchored


@query(
    f"WITH {_JUDGED_SQL}, rows AS (SELECT head, label, tail, family, rec FROM judged WHERE reject_reason IS NULL UNION ALL SELECT label, 'is_a', type, 'is_a', first FROM nodes), per AS (SELECT head, label, tail, rec, count(*) AS m FROM rows GROUP BY ALL), "
    "firsts AS (SELECT head, label, tail, arg_min(family, rec) AS family FROM rows GROUP BY ALL) SELECT 'd::edge::' || head || '::' || label || '::' || tail AS edge_id, family, CAST(row_number() OVER w AS BIGINT) AS version, rec AS from_idx, CAST(lead(rec) OVER w AS VARCHAR) AS to_idx, "
    "CAST(rec AS VARCHAR) AS evidence_id, CAST(sum(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS mentions, CAST(row_number() OVER w AS BIGINT) AS evidence_count FROM per JOIN firsts USING (head, label, tail) WINDOW w AS (PARTITION BY head, label, tail ORDER BY rec)"
)
def versioned_edges(spark, sf_dir):
    """Every edge in every interval of records in which it stood unchanged."""
    rows = assembly.edge_observations(*_shown(spark, sf_dir))
    held = versions.versions(rows, assembly.EDGE_KEYS)
    out = versions.with_values(held, assembly.merged_edges(rows), assembly.EDGE_KEYS)
    return out.select("edge_id", "family", "version", "from_idx", F.col("to_idx").cast("string").alias("to_idx"), "evidence_id", "mentions", "evidence_count")


@query("SELECT event_id, event_type AS domain_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS record_idx, props AS raw_text FROM events")
def record_order(spark, sf_dir):
    """Events as records of the domain of their type, in order of time."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_id").alias("input_pos"), F.col("event_id").cast("string").alias("evidence_id"), "event_id", F.col("props").alias("raw_text"))
    return evidence.order_records(e).select("event_id", "domain_id", "record_idx", "raw_text")




@query(f"WITH {_JUDGED_SQL}, told AS (SELECT unnest([{{'property': 'status', 'value': CASE WHEN reject_reason IS NULL THEN 'accepted' WHEN reject_reason LIKE 'type_constraint:%' THEN 'rejected_type' ELSE 'rejected' END}}, {{'property': 'family', 'value': family}}, {{'property': 'graph_layer', 'value': 'semantic'}}, {{'property': 'reject_reason', 'value': reject_reason}}, {{'property': 'display_action', 'value': label}}]) AS p FROM judged) SELECT p.property AS property, p.value AS value, count(*) AS n FROM told WHERE p.value IS NOT NULL GROUP BY ALL")
def relation_audit(spark, sf_dir):
    none = F.lit(None).cast("string")
    shown = _judged(spark, sf_dir)[0].select("*", F.col("label").alias("display_label"), none.alias("salience"), F.lit(True).alias("display_admitted"), none.alias("hidden"))
    return graph.relation_audit(shown).select("property", "value", "n")


def _facts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("fact_id"), F.col("ts").alias("at"), F.col("event_type").alias("label"))


@query("SELECT user_id AS object_id, event_id AS fact_id, lag(event_id) OVER w AS supersedes, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def assertions_valid_time(spark, sf_dir):
    return temporal.assertions(_facts(spark, sf_dir)).select("object_id", "fact_id", "supersedes", "valid_to")


@query("SELECT p.event_id AS probe_id, p.user_id AS object_id, s.event_id AS snapshot_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') p ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') s ON p.user_id = s.user_id AND p.ts >= s.ts")
def asof_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    snaps = e.where("event_type = 'view'").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    probes = e.where("event_type = 'error'").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("object_id"), F.col("ts").alias("at"))
    return temporal.as_of(snaps, probes).select("probe_id", "object_id", "snapshot_id")


_MIDDLE_SQL = "m AS (SELECT floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2) AS t FROM events)"


@query(f"WITH {_MIDDLE_SQL}, b AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events, m WHERE epoch_us(ts) <= t GROUP BY 1), a AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT user_id, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a USING (user_id) WHERE b.v IS DISTINCT FROM a.v")
def snapshot_diff(spark, sf_dir):
    """What changed from the middle of the time to its end."""
    e = table(spark, sf_dir, "events")
    middle = e.agg(F.floor((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).alias("t"))
    state = lambda df: df.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("v"))
    return temporal.diff(state(e.join(F.broadcast(middle)).where(F.unix_micros(F.col("ts").cast("timestamp")) <= F.col("t"))), state(e), "user_id", "v")


@query("SELECT event, count(*) AS n, count(DISTINCT user_id) AS objects FROM (SELECT user_id, 'creation' AS event FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 UNION ALL SELECT user_id, 'update' FROM events WHERE value > 50 UNION ALL SELECT user_id, 'fault_occurrence' FROM events WHERE event_type = 'error') GROUP BY 1")
def lifecycle_events(spark, sf_dir):
    """Events of a high value stand for facts that supersede another."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_id")).alias("supersedes"))
    facts = _facts(spark, sf_dir).withColumn("label", F.when(F.col("label") == "error", "Causes").otherwise(F.col("label")))
    facts = facts.join(e, facts["fact_id"] == e["event_id"]).drop("event_id")
    return temporal.lifecycle_events(facts).groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("objects"))


@query("WITH h AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS s, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS e FROM events), m AS (SELECT user_id, e > lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS o, s > lead(s) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM h) SELECT user_id AS object_id, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS overlaps, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS backward FROM m GROUP BY 1")
def temporal_consistency(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    held = table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("assertion_id"), iso(F.col("ts")).alias("valid_from"), iso(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("valid_to"), iso(F.col("ts")).alias("transaction_time"))
    return temporal.consistency(held)


@query("SELECT node_id, seq, old_parent, new_parent FROM (SELECT user_id AS node_id, event_id AS seq, lag(event_type) OVER w AS old_parent, event_type AS new_parent, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 1 AND old_parent IS DISTINCT FROM new_parent")
def knowledge_conflicts(spark, sf_dir):
    return temporal.conflicts(table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("parent_anchor")))


@query("SELECT user_id AS object_id, event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS root FROM events")
def supersedes_roots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("supersedes"))
    return e.select("object_id", "id").join(temporal.supersede_roots(e.select("id", "supersedes")), "id").select("object_id", "id", "root")


@query("WITH g AS (SELECT d.source AS domain_id, d.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS want FROM documents d JOIN labels USING (doc_id)), p AS (SELECT source AS domain_id, doc_id, CASE WHEN n_chars > 1000 THEN 'good' ELSE 'bad' END AS got FROM documents WHERE n_chars > 300), f AS (SELECT coalesce(g.domain_id, p.domain_id) AS domain_id, g.doc_id AS g, p.doc_id AS p, want, got FROM g FULL JOIN p ON g.domain_id = p.domain_id AND g.doc_id = p.doc_id) SELECT domain_id, count(g) AS gold, count(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN 1 END) AS matched, count(CASE WHEN want = got THEN 1 END) AS correct, count(CASE WHEN want <> got THEN 1 END) AS wrong, count(CASE WHEN p IS NULL THEN 1 END) AS missing, count(CASE WHEN g IS NULL THEN 1 END) AS extra FROM f GROUP BY 1")
def gold_evaluation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    gold = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("domain_id"), F.col("doc_id").alias("label"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("parent_anchor"))
    got = d.where("n_chars > 300").select(F.col("source").alias("domain_id"), F.col("doc_id").alias("label"), F.when(F.col("n_chars") > 1000, "good").otherwise("bad").alias("parent_anchor"))
    return metrics.gold_evaluation(gold, got).drop("coverage", "accuracy")


@query("SELECT text AS label, count(DISTINCT source) AS domains, count(DISTINCT lang) AS distinct_values, count(DISTINCT lang) <= 1 AS consistent FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def cross_domain_consistency(spark, sf_dir):
    return metrics.shared_labels(table(spark, sf_dir, "documents").withColumnRenamed("text", "label"), "label", "source", "lang")


@query("WITH i AS (SELECT DISTINCT CAST(s_suppkey * 37 AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 3 > 0) SELECT p_partkey, p_name AS label FROM part WHERE EXISTS (SELECT 1 FROM i WHERE contains(id, CAST(p_partkey * 11 AS VARCHAR)) OR contains(CAST(p_partkey * 11 AS VARCHAR), id))")
def gold_by_document(spark, sf_dir):
    """Parts as gold labels of documents, suppliers as evidence: numbers that lie within each other."""
    gold = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), (F.col("p_partkey") * 11).cast("string").alias("source_doc"))
    ids = table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select((F.col("s_suppkey") * 37).cast("string").alias("evidence_id"))
    return metrics.gold_of_documents(gold, ids).select("p_partkey", "label")


@query(f"WITH {_EDGES_SQL}, shown AS (SELECT * FROM edges WHERE tail_type <> 'Signal') SELECT 'nodes' AS kind, count(*) AS n FROM (SELECT head AS x FROM shown UNION SELECT tail FROM shown) UNION ALL SELECT 'edges', count(*) FROM shown")
def readable_graph(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("domain_id", F.lit("geo")).withColumn("display_admitted", F.col("tail_type") != "Signal")
    nodes = edges.select("domain_id", F.col("head").alias("label")).union(edges.select("domain_id", "tail")).distinct()
    own, shown = graph.readable(nodes, edges)
    return own.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).union(shown.agg(F.lit("edges"), F.count("*")))


#: Labels, descriptions, routes and parents that reach each branch of the rules; a route of None is left to propose(), a label of None is the part's name.
_PROPOSED = [
    ("Asset", None, None, None), ("pump seal", None, None, None), ("Dr. Smith", None, "vertical_specialize", "Component"), ("John Smith", "lead engineer", "vertical_specialize", "Component"),
    ("John Smith", "a river", "vertical_specialize", "Component"), ("service report", None, "vertical_specialize", "Component"), ("failure", None, "vertical_specialize", "Fault"), ("odd thing", None, "reuse_backbone", None),
    ("odd thing", None, "vertical_specialize", ""), ("odd thing", None, "vertical_specialize", "Nowhere"), ("odd thing", None, "reject", "too_vague"), ("odd thing", None, "reject", None), ("odd thing", None, "merge", "Component"),
    ("bleed port", None, "vertical_specialize", " Signal "), ("e1:T3 report", None, "vertical_specialize", "Component"), ("shift engineer", None, "reject", None), (None, None, None, None), ("Seal", "anything", "reject", "too_vague"),
]
_ANCHOR_LIST = ", ".join(f"'{a}'" for a in K.ANCHORS)
_GIVEN = "[" + ", ".join("{" + ", ".join(f"'{n}': " + ("NULL::VARCHAR" if v is None else f"'{v}'") for n, v in zip("ldrp", row, strict=True)) + "}" for row in _PROPOSED) + f"][p_partkey % {len(_PROPOSED)} + 1]"
_PERSON = f"regexp_matches(label, '{K.PERSON_TITLE}') OR regexp_matches(label, {sql_words(K.PERSON_ROLE)}) OR (regexp_matches(label, '{K.PERSON_NAME.replace(chr(39), chr(39) * 2)}') AND regexp_matches(coalesce(description, ''), {sql_words(K.PERSON_ROLE)}))"


@query(
    f"WITH g AS (SELECT p_partkey, p_name, {_GIVEN} AS x FROM part), c AS (SELECT p_partkey, coalesce(x.l, p_name) AS label, x.d AS description, x.r AS given, x.p AS told, {sql_case('concat_ws(chr(32), coalesce(x.l, p_name), x.d)', K.ANCHOR_WORDS)} AS a FROM g), "
    f"d AS (SELECT *, label IN ({_ANCHOR_LIST}) AS own, coalesce(given, CASE WHEN label IN ({_ANCHOR_LIST}) THEN 'reuse_backbone' WHEN a IS NOT NULL THEN 'vertical_specialize' ELSE 'reject' END) AS route, trim(coalesce(CASE WHEN given IS NULL THEN a WHEN given <> 'reject' THEN told END, '')) AS parent, "
    "CASE WHEN given IS NULL THEN CASE WHEN a IS NULL THEN 'cannot_anchor_backbone' END WHEN given = 'reject' THEN told END AS why FROM c), "
    f"r AS (SELECT *, CASE WHEN own THEN NULL WHEN route NOT IN ('reuse_backbone', 'vertical_specialize', 'reject') THEN 'route_not_allowed' WHEN {_PERSON} THEN 'person_name' WHEN NOT regexp_matches(label, '(?i)(^|:)T\\d+([^A-Za-z0-9_]|$)') AND regexp_matches(concat_ws(' ', label, description), {sql_words(K.DOCUMENT_WORDS)}) THEN 'document_title' "
    f"WHEN regexp_matches(trim(label), '{K.PLACEHOLDER}') THEN 'low_graph_value' WHEN route = 'reuse_backbone' THEN 'backbone_label_mismatch' WHEN route = 'vertical_specialize' AND parent NOT IN ({_ANCHOR_LIST}) THEN 'invalid_backbone_parent' WHEN route = 'reject' THEN coalesce(why, 'low_graph_value') END AS reject_reason FROM d) "
    "SELECT p_partkey, label, CASE WHEN own THEN 'reuse_backbone' WHEN reject_reason IS NULL THEN route ELSE 'reject' END AS route, CASE WHEN reject_reason IS NULL AND NOT own AND parent <> '' THEN parent END AS parent_anchor, reject_reason FROM r"
)
def rule_attachment(spark, sf_dir):
    """Parts with labels and proposals by their keys, so that the rules' every branch has rows."""
    given = F.element_at(F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip("ldrp", row, strict=True))) for row in _PROPOSED)), (F.col("p_partkey") % len(_PROPOSED) + 1).cast("int"))
    none, x = F.lit(None).cast("string"), F.col("x")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", given.alias("x"))
    proposed = attachment.propose(part.select("p_partkey", F.coalesce(x["l"], "p_name").alias("label"), x["d"].alias("description"), none.alias("hint"), none.alias("hypernym"), "x"))
    told = x["r"].isNotNull()
    proposed = proposed.withColumns({
        "parent_anchor": F.when(told, F.when(x["r"] != "reject", x["p"])).otherwise(F.col("parent_anchor")), "reject_reason": F.when(told, F.when(x["r"] == "reject", x["p"])).otherwise(F.col("reject_reason")), "route": F.coalesce(x["r"], "route"),
    })
    return attachment.decide(proposed).select("p_partkey", "label", "route", "parent_anchor", "reject_reason")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT page_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\n{3,}', chr(10) || chr(10), 'g'), '(?s)```.*?```', '', 'g'), '<[^>]+>', '', 'g'), '(?m)^#{2,6}[ \\t\\n\\x0B\\f\\r]+', '# ', 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), 1, 20000)) AS digest FROM pages")
def normalized_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(procedures.normalize_content(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 1 THEN 'causes' WHEN l_linenumber % 4 = 2 THEN 'hasState' WHEN l_linenumber % 4 = 3 THEN 'triggers' ELSE 'odd label' END AS label, CASE WHEN l_linenumber % 4 = 1 THEN 'propagation' WHEN l_linenumber % 4 = 2 THEN 'lifecycle' WHEN l_linenumber % 4 = 3 AND l_returnflag <> 'A' THEN 'task_dependency' WHEN l_linenumber % 4 = 3 THEN 'propagation' WHEN l_returnflag = 'A' THEN 'propagation' ELSE 'structural' END AS family, CASE WHEN l_linenumber % 4 = 1 THEN l_suppkey ELSE l_partkey END AS head, CASE WHEN l_linenumber % 4 = 1 THEN l_partkey ELSE l_suppkey END AS tail FROM lineitem")
def relation_rewrite(spark, sf_dir):
    mode = F.col("l_linenumber") % 4
    raw = F.struct(F.when(mode == 1, "Caused-By").when(mode == 2, "has_state").when(mode == 3, " triggers ").otherwise("odd label").alias("label"), F.when(F.col("l_returnflag") == "A", "propagation").otherwise("").alias("family"), F.col("l_partkey").cast("string").alias("head"), F.col("l_suppkey").cast("string").alias("tail"))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", procedures.relation_entry(raw).alias("r"))
    return out.select("l_orderkey", "l_linenumber", "r.label", "r.family", F.col("r.head").cast("long").alias("head"), F.col("r.tail").cast("long").alias("tail"))


@query("WITH m AS (SELECT conv_id, role AS label, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS d FROM conversations) SELECT conv_id, label, md5(arg_min(d, turn) FILTER (d <> '')) AS description, min(turn) AS first_turn, bool_or(turn > 1) AS node_worthy FROM m GROUP BY 1, 2")
def merged_mentions(spark, sf_dir):
    none = F.lit(None).cast("string")
    found = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("label"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("description"), none.alias("surface_form"), none.alias("hint"), none.alias("hypernym"), (F.col("turn") > 1).alias("node_worthy"))
    out = extraction.merge_mentions(found, ("conv_id", "label"))
    return out.select("conv_id", "label", F.md5(F.col("description").cast("binary")).alias("description"), F.col("pos").alias("first_turn"), "node_worthy")


@query("WITH l AS (SELECT p_brand AS doc_id, p_name AS label FROM part UNION SELECT p_brand, p_type || ' ' || p_name FROM part), t AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS n FROM l) SELECT a.doc_id, a.label, min(b.label) AS alias_of FROM t a JOIN t b ON a.doc_id = b.doc_id AND len(string_split(b.n, ' ')) > len(string_split(a.n, ' ')) AND regexp_matches(' ' || b.n || ' ', ' ' || replace(a.n, ' ', ' (.* )?') || ' ') WHERE a.n LIKE '% %' GROUP BY 1, 2 HAVING count(*) = 1")
def label_aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    labels = part.select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("label")).union(part.select("p_brand", F.concat_ws(" ", "p_type", "p_name")))
    return extraction.aliases(labels.select("doc_id", "label", F.lit(None).cast("string").alias("hint"), F.lit(None).cast("int").alias("pos")))


@query(r"WITH s AS (SELECT conv_id AS doc_id, turn AS step_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS row_text FROM conversations), l AS (SELECT DISTINCT conv_id AS doc_id, regexp_extract(text, '^[^ \n]+ [^ \n]+', 0) AS label FROM conversations), q AS (SELECT *, lower(label) AS n FROM l WHERE length(label) >= 5) SELECT q.doc_id, label, min(step_id) AS step_id FROM q JOIN s ON q.doc_id = s.doc_id AND regexp_matches(row_text, '(^|[^\p{L}\p{M}\p{N}_])' || regexp_escape(n) || '($|[^\p{L}\p{M}\p{N}_])') GROUP BY 1, 2 HAVING count(DISTINCT step_id) = 1")
def surface_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    labels = c.select(F.col("conv_id").alias("doc_id"), F.regexp_extract("text", r"^[^ \n]+ [^ \n]+", 0).alias("label"))
    return extraction.surface_steps(labels, c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("step_id"), "text"))


_ENDS_SQL = "r AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey % 7 AS head, l_quantity::INT % 5 AS tail, CASE l_returnflag WHEN 'A' THEN 'communication' WHEN 'N' THEN 'propagation' ELSE 'structural' END AS family FROM lineitem), c AS (SELECT l_orderkey AS doc_id, l_linenumber AS step_id, l_suppkey % 6 AS label FROM lineitem)"


def _ends(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    family = F.when(F.col("l_returnflag") == "A", "communication").when(F.col("l_returnflag") == "N", "propagation").otherwise("structural")
    relations = lines.select("doc_id", F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 7).alias("head"), (F.col("l_quantity").cast("int") % 5).cast("long").alias("tail"), family.alias("family"))
    return relations, lines.select("doc_id", F.col("l_linenumber").alias("step_id"), F.col("l_linenumber").alias("step_pos"), (F.col("l_suppkey") % 6).alias("label"))


@query(f"WITH {_ENDS_SQL}, last AS (SELECT doc_id, label, max(step_id) AS step_id FROM c GROUP BY 1, 2) SELECT r.*, h.step_id AS head_step, t.step_id AS tail_step FROM r LEFT JOIN last h ON r.doc_id = h.doc_id AND r.head = h.label LEFT JOIN last t ON r.doc_id = t.doc_id AND r.tail = t.label WHERE family <> 'structural' AND coalesce(h.step_id, t.step_id) IS NOT NULL")
def cross_step_relations(spark, sf_dir):
    return extraction.cross_steps(*_ends(spark, sf_dir))


@query(f"WITH {_ENDS_SQL} SELECT DISTINCT r.doc_id, pos, step_id FROM r JOIN c ON r.doc_id = c.doc_id AND (c.label = r.head OR c.label = r.tail)")
def placed_diagnostics(spark, sf_dir):
    relations, concepts = _ends(spark, sf_dir)
    return extraction.place_diagnostics(relations.withColumnsRenamed({"head": "evidence_label", "tail": "indicated_label"}), concepts).select("doc_id", "pos", "step_id")


@query("SELECT DISTINCT substr(sha256(text), 1, 16) AS text_hash, length(text) AS size, min(doc_id % 2) OVER (PARTITION BY text) = 1 AS computed FROM documents WHERE text IS NOT NULL")
def cached_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 2 = 0").select(T.text_hash(F.col("text")).alias("text_hash"), F.array(F.char_length("text"), F.lit(0)).alias("vector"))
    out, _ = providers.embed_with_cache(docs, cache, lambda missing: missing.withColumn("vector", F.array(F.char_length("text"), F.lit(1))))
    return out.select("text_hash", F.col("vector")[0].cast("long").alias("size"), (F.col("vector")[1] == 1).alias("computed"))


@query(
    f"WITH {_JUDGED_SQL} SELECT origin AS domain_id, count(*) AS candidate_triple_count, count(*) FILTER (reject_reason IS NULL) AS accepted_triple_count, "
    "count(*) FILTER (reject_reason NOT LIKE 'type_constraint:%') AS rejected_triple_count, count(*) FILTER (reject_reason LIKE 'type_constraint:%') AS type_rejected_triple_count FROM judged GROUP BY 1"
)
def triple_counts(spark, sf_dir):
    return audits.triple_counts(_judged(spark, sf_dir)[0].withColumn("domain_id", F.col("origin")))


_NODES_SQL = "n AS (SELECT source AS domain_id, CASE WHEN doc_id % 3 = 0 THEN 'workflow' ELSE 'semantic' END AS layer, lang AS shared_hypernym, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS step_phase FROM documents)"


def _document_nodes(spark, sf_dir) -> DataFrame:
    layer = F.when(F.col("doc_id") % 3 == 0, "workflow").otherwise("semantic").alias("layer")
    phase = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("step_phase")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("domain_id"), layer, F.col("lang").alias("shared_hypernym"), phase)


@query(
    f"WITH {_NODES_SQL} SELECT domain_id, count(*) AS node_count, count(*) FILTER (layer = 'workflow') AS workflow_step_node_count, count(*) FILTER (layer = 'semantic') AS semantic_node_count, "
    "coalesce(round(count(*) FILTER (layer = 'semantic' AND shared_hypernym <> '') / nullif(count(*) FILTER (layer = 'semantic'), 0), 4), 0.0) AS hypernym_coverage FROM n GROUP BY 1"
)
def node_counts(spark, sf_dir):
    return audits.node_counts(_document_nodes(spark, sf_dir))


@query(
    f"WITH {_NODES_SQL} SELECT domain_id, 'shared_hypernym' AS property, shared_hypernym AS value, count(*) AS n FROM n WHERE layer = 'semantic' AND shared_hypernym <> '' GROUP BY ALL "
    "UNION ALL SELECT domain_id, 'step_phase', step_phase, count(*) FROM n WHERE layer = 'workflow' AND step_phase <> '' GROUP BY ALL"
)
def node_distributions(spark, sf_dir):
    return audits.node_distributions(_document_nodes(spark, sf_dir))


@query("SELECT source AS domain_id, lang AS doc_type, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT source, NULL, count(*) FROM documents GROUP BY 1")
def document_counts(spark, sf_dir):
    return audits.document_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("domain_id"), F.col("lang").alias("doc_type")))


_CANDIDATES_SQL = (
    "j AS (SELECT s_nationkey AS domain_id, CASE WHEN s_suppkey % 4 = 0 THEN 'rejected' WHEN s_suppkey % 3 = 0 THEN 'reuse' ELSE 'adapter' END AS outcome, "
    "CASE WHEN s_suppkey % 4 <> 0 THEN NULL WHEN s_suppkey % 8 = 0 THEN 'unspecified' ELSE 'low_graph_value' END AS reject_reason FROM supplier)"
)


def _judged_suppliers(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("domain_id"), key.cast("string").alias("label"), key)
    reason = F.when(key % 8 == 0, "").when(key % 4 == 0, "low_graph_value")
    route = F.when(key % 3 == 0, "reuse_backbone").otherwise("vertical_specialize")
    decided = rows.select("domain_id", "label", (key % 4 != 0).alias("admit"), route.alias("route"), reason.alias("reject_reason"))
    return audits.judged_candidates(rows.select("domain_id", "label"), decided, rows.select("label"))


@query(f"WITH {_CANDIDATES_SQL} SELECT domain_id, outcome, reject_reason, count(*) AS n FROM j GROUP BY ALL")
def attachment_audit(spark, sf_dir):
    return audits.attachment_audit(_judged_suppliers(spark, sf_dir))


@query(
    f"WITH {_CANDIDATES_SQL} SELECT domain_id, count(*) AS candidate_count, count(*) FILTER (outcome = 'adapter') AS accepted_adapter_candidate_count, "
    "count(*) FILTER (outcome = 'reuse') AS accepted_backbone_reuse_count, count(*) FILTER (outcome = 'rejected') AS rejected_candidate_count FROM j GROUP BY 1"
)
def candidate_counts(spark, sf_dir):
    return audits.candidate_counts(_judged_suppliers(spark, sf_dir))


@query(
    "WITH l AS (SELECT l_orderkey AS d, l_linenumber AS n, max('valve unit ' || (l_partkey % 9)) AS c, max('valve unit ' || (l_suppkey % 9)) AS r FROM lineitem GROUP BY 1, 2), "
    "ends AS (SELECT DISTINCT d, n, r AS label FROM l), rest AS (SELECT d, c AS label, count(*) AS k, min(n) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.d = l.d AND e.label = l.c) GROUP BY 1, 2), "
    "placed AS (SELECT d, n, label FROM ends UNION ALL SELECT d, n, label FROM rest WHERE k = 1) "
    "SELECT CAST(l.d AS VARCHAR) AS evidence_id, 'T' || l.n AS step_id, 'T' || lead(l.n) OVER (PARTITION BY l.d ORDER BY l.n) AS sequence_next, l.r AS target, "
    "(SELECT string_agg(label, ',' ORDER BY label) FROM placed p WHERE p.d = l.d AND p.n = l.n) AS concepts, "
    "coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM rest WHERE rest.d = l.d AND k > 1), '') AS of_document FROM l"
)
def composed_records(spark, sf_dir):
    """Orders as documents, a line as a step that names one concept and acts on another."""
    doc, n = F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber")
    unit = lambda c: F.concat(F.lit("valve unit "), F.max(F.col(c) % 9).cast("string"))
    ensure_checkpoint_dir(spark)
    lines = table(spark, sf_dir, "lineitem").groupBy(doc, n.cast("int").alias("pos")).agg(unit("l_partkey").alias("c"), unit("l_suppkey").alias("r")).checkpoint()
    step, none = F.concat(F.lit("T"), F.col("pos")), F.lit(None).cast("string")
    row = F.concat(F.lit("| "), step, F.lit(" | Check the "), F.col("c"), F.lit(" |"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("t")))), lambda x: x["t"]), "\n")
    documents = lines.groupBy("doc_id").agg(content.alias("content")).select("doc_id", F.lit("d").alias("domain_id"), none.alias("role"), none.alias("doc_type"), none.alias("timestamp"), "content")
    text = lambda *names: [none.alias(c) for c in names]
    found = records.Extracted(
        lines.select("doc_id", "pos", F.col("c").alias("label"), *text("description", "surface_form", "hint", "hypernym"), F.lit(True).alias("node_worthy")),
        lines.select("doc_id", "pos", F.lit("inspects").alias("label"), F.lit("task_dependency").alias("family"), step.alias("head"), F.col("r").alias("tail")),
        lines.where("false").select("doc_id", "pos", *text("from_state", "to_state", "trigger_step", "evidence_label")),
        lines.where("false").select("doc_id", "pos", *text("evidence_label", "indicated_label", "mechanism")),
    )
    out = records.compose_records(documents, found)
    labels = lambda c: F.array_join(F.transform(c, lambda m: m["label"]), ",")
    out = out.select("evidence_id", labels(F.col("document_concept_mentions")).alias("of_document"), F.explode("step_records").alias("s"))
    return out.select("evidence_id", "s.step_id", "s.sequence_next", F.col("s.step_actions")[0]["target_label"].alias("target"), labels(F.col("s.concept_mentions")).alias("concepts"), "of_document")
