"""From what was extracted of a procedure to the parts of its record: merged mentions, aliases, steps of labels, mended relations.

Every frame has doc_id; all joins are on equal keys within a document, whatever the document's size.
Rows that are null in a key join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions.text import step_id, whole_word
from stepweave.session import ensure_checkpoint_dir

_WORD = r"(?U)\w+"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def merge_mentions(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "step_id", "label")) -> DataFrame:
    """One mention per key: the first filled description, surface form and hint by pos, worthy if any is, the hypernym of the first."""
    first = [F.min_by(c, F.when(_filled(c), F.col("pos"))).alias(c) for c in ("description", "surface_form", "hint")]
    return found.groupBy(*keys).agg(*first, F.min_by("hypernym", "pos").alias("hypernym"), F.bool_or("node_worthy").alias("node_worthy"), F.min("pos").alias("pos"))


def alias_tokens(label: Column) -> Column:
    """A label's words in lower case, words of one meaning alike."""
    same = F.create_map(*(F.lit(x) for pair in K.SAME_TOKENS.items() for x in pair))
    words = F.filter(F.split(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    return F.transform(words, lambda x: F.coalesce(F.try_element_at(same, x), x))


def _extends(short: Column, long: Column) -> Column:
    """Whether all tokens of short follow each other in long, and none of the rest tells two things apart."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("other"))

    def step(s: Column, token: Column) -> Column:
        met = F.coalesce(F.get(short, s["at"]) == token, F.lit(False))
        return F.struct((s["at"] + met.cast("int")).alias("at"), (s["other"] | (~met & token.isin(*K.DISTINGUISHING_TOKENS))).alias("other"))

    return F.aggregate(long, start, step, lambda s: (s["at"] == F.size(short)) & ~s["other"])


def aliases(labels: DataFrame) -> DataFrame:
    """doc_id, label, alias_of for labels (doc_id, label, hint, pos; pos null unless of a concept) that exactly one longer label extends.

    The last concept of a label gives its hint; labels of two different hints are not the same thing.
    A longer label is found by the shorter one's first token. The distinct labels are read twice, so they are checkpointed.
    """
    ensure_checkpoint_dir(labels.sparkSession)
    named = labels.select("doc_id", F.trim("label").alias("label"), "hint", "pos").where((F.col("label") != "") & step_id(F.col("label")).isNull())
    named = named.groupBy("doc_id", "label").agg(F.max_by("hint", "pos").alias("hint")).withColumn("tokens", alias_tokens(F.col("label"))).checkpoint()
    short = named.where((F.size("tokens") > 1) | F.get("tokens", F.lit(0)).isin(*K.LONE_ALIASES)).withColumn("token", F.get("tokens", F.lit(0)))
    long = named.where(F.size("tokens") > 1).select("doc_id", F.col("label").alias("alias_of"), F.col("hint").alias("_hint"), F.col("tokens").alias("_tokens"), F.explode(F.array_distinct("tokens")).alias("token"))
    fits = (F.size("_tokens") > F.size("tokens")) & (F.col("hint").isNull() | F.col("_hint").isNull() | (F.col("hint") == F.col("_hint")))
    pairs = short.join(long, ["doc_id", "token"]).where(fits & _extends(F.col("tokens"), F.col("_tokens")))
    return pairs.groupBy("doc_id", "label").agg(F.count("*").alias("_n"), F.min("alias_of").alias("alias_of")).where("_n = 1").drop("_n")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


#: A document's labels up to this number are each sought in all of its steps; of more, those that share a word with a step.
FEW_LABELS = 64


def surface_steps(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """doc_id, label, step_id for labels that stand, as whole words, in the text of exactly one step (doc_id, step_id, text).

    Short labels are left out. The labels of each document are written once, in the shared folder of checkpoints. Where a document has
    many, a label's longest word is the join key, as every word of a label is a word of such a text; words travel without their texts,
    which then meet the pairs of a label and a step. No side is broadcast, as Spark takes words for as few as their texts.
    """
    ensure_checkpoint_dir(labels.sparkSession)
    asked = labels.where("doc_id IS NOT NULL").select("doc_id", "label").distinct().withColumn("_flat", _flat(F.col("label")))
    asked = asked.where((F.length("_flat") >= 5) & (F.col("_flat").contains(" ") | (F.length("_flat") >= 8)))
    listed = asked.groupBy("doc_id").agg(F.collect_list(F.struct("label", "_flat")).alias("_labels")).checkpoint()
    few, many = listed.where(F.size("_labels") <= FEW_LABELS), listed.where(F.size("_labels") > FEW_LABELS)
    texts = steps.select("doc_id", "step_id", _flat(F.col("text")).alias("_text"))
    met = texts.join(few.hint("merge"), "doc_id").select("doc_id", "step_id", "_text", F.inline("_labels")).where(F.contains("_text", "_flat"))
    if not many.isEmpty():
        met = met.unionByName(_by_words(many, texts))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.regexp_replace("_flat", r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E(?!\w)"))
    met = met.where(F.rlike("_text", quoted))
    return met.groupBy("doc_id", "label").agg(F.min("step_id").alias("step_id"), F.max("step_id").alias("_last")).where("step_id = _last").drop("_last")


def _by_words(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """The labels (_labels: label, _flat) of a document beside its texts (step_id, _text) that have a label's longest word."""
    key = F.array_max(F.transform(F.regexp_extract_all("_flat", F.lit(_WORD), 0), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    sought = listed.select("doc_id", F.inline("_labels")).select("doc_id", "label", "_flat", F.coalesce(key, F.lit("")).alias("_key"))
    own = texts.join(listed.select("doc_id").hint("merge"), "doc_id")
    words = own.select("doc_id", "step_id", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("_text", F.lit(_WORD), 0), F.array(F.lit(""))))).alias("_key"))
    pairs = sought.join(words.hint("merge"), ["doc_id", "_key"]).select("doc_id", "step_id", "label", "_flat").distinct()
    return pairs.join(own.hint("merge"), ["doc_id", "step_id"]).select("doc_id", "step_id", "_text", "label", "_flat")


def place_transitions(transitions: DataFrame, steps: DataFrame) -> DataFrame:
    """The transitions (doc_id, trigger_step, ...) whose step there is."""
    return transitions.join(steps.select("doc_id", F.col("step_id").alias("trigger_step")), ["doc_id", "trigger_step"], "left_semi")


def place_diagnostics(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Each edge (doc_id, pos, evidence_label, indicated_label, ...) once for each step (doc_id, step_id, label) that has one of its labels."""
    ends = edges.withColumn("_end", F.explode(F.array_distinct(F.array("evidence_label", "indicated_label"))))
    at = concepts.select("doc_id", "step_id", F.col("label").alias("_end")).distinct()
    return ends.join(at, ["doc_id", "_end"]).drop("_end").dropDuplicates(["doc_id", "pos", "step_id"])


def cross_steps(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Communication and propagation relations with the last steps (step_pos) that have their head and tail; those with neither go."""
    last = concepts.groupBy("doc_id", "label").agg(F.max_by("step_id", "step_pos").alias("step_id"))
    out = relations.where(F.col("family").isin("communication", "propagation"))
    for end in ("head", "tail"):
        out = out.join(last.select("doc_id", F.col("label").alias(end), F.col("step_id").alias(f"{end}_step")), ["doc_id", end], "left")
    return out.where("head_step IS NOT NULL OR tail_step IS NOT NULL").select(*relations.columns, "head_step", "tail_step")


def annotate_cross_steps(stream: DataFrame, crossing: DataFrame, record: str = "evidence_id") -> DataFrame:
    """The stream (source_field, head_step, tail_step among its columns), relations that cross steps marked so; of repeated ones the last by pos counts."""
    keys = [record, "head", "label", "family", "tail"]
    last = crossing.groupBy(*keys).agg(F.max_by(F.struct("head_step", "tail_step"), "pos").alias("_x"))
    taken = lambda own, value: F.when(F.col("_x").isNotNull(), value).otherwise(F.col(own)).alias(own)
    new = {"source_field": F.lit("cross_step_relations"), "head_step": F.col("_x.head_step"), "tail_step": F.col("_x.tail_step")}
    return stream.join(last, keys, "left").select(*(taken(c, new[c]) if c in new else F.col(c) for c in stream.columns))


def structural_parents(concepts: DataFrame) -> DataFrame:
    """doc_id, parent: the connector of a document (doc_id, label, hint) that is named best, if one is."""
    named = concepts.where(F.col("label").rlike(whole_word(K.PARENT_WORDS)) & ~F.col("label").rlike(whole_word(K.PART_WORDS))).dropDuplicates(["doc_id", "label"])
    is_component = F.coalesce(F.col("hint") == "Component", F.lit(False))
    score = 2 * is_component.cast("int") + 2 * (~F.col("label").rlike(whole_word(K.GENERIC_WORDS))).cast("int") + F.lower("label").contains("connector").cast("int")
    return _best(named.withColumn("_score", score), ["doc_id"], "parent")


def _best(scored: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The label of the highest _score of each key, if it is alone there."""
    tied = scored.groupBy(*keys, "_score").agg(F.count("*").alias("_n"), F.min("label").alias("_label"))
    top = tied.groupBy(*keys).agg(F.max_by(F.struct("_n", "_label"), "_score").alias("_b"), F.max("_score").alias("_score"))
    return top.where("_b._n = 1").select(*keys, F.col("_b._label").alias(name), "_score")


def mend_structural(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Structural relations from a context to a connector's part get the connector as their head."""
    wrong = (F.col("family") == "structural") & F.col("head").rlike(whole_word(K.DOCUMENT_HEAD)) & F.col("tail").rlike(whole_word(K.PART_WORDS)) & (F.col("_parent") != F.col("tail"))
    parents = structural_parents(concepts).select("doc_id", F.col("parent").alias("_parent"))
    return relations.join(parents, "doc_id", "left").select(*(F.when(wrong, F.col("_parent")).otherwise(F.col(c)).alias(c) if c == "head" else F.col(c) for c in relations.columns))


def damage_score(head: Column, target: Column) -> Column:
    """How well a target goes with the local damage that a head tells of: 6 for its own kind, -2 for a broad cause."""
    broad = target.rlike(whole_word(K.BROAD_CAUSES))
    return sum((F.when(~head.rlike(h), 0).when(target.rlike(whole_word(t)), 6).when(broad, -2).otherwise(0) for h, t in K.DAMAGE_RULES), F.lit(0))


def mend_indicates(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """`indicates` relations (pos tells those of a document apart) get as their tail the concept that goes with their head best.

    It must be one of signal, state or fault (or of no hint), better than the tail there is, and alone.
    Heads and concepts meet by the rule that both fulfil.
    """
    rules = lambda value, k: F.explode(F.array_compact(F.array(*(F.when(value.rlike(r[0] if k == 0 else whole_word(r[1])), F.lit(n)) for n, r in enumerate(K.DAMAGE_RULES)))))
    asked = relations.where((F.col("family") == "communication") & (F.col("label") == "indicates")).select("doc_id", "pos", F.col("head").alias("_head"), rules(F.col("head"), 0).alias("_rule"))
    offered = concepts.where(F.col("hint").isNull() | F.col("hint").isin(*K.INDICATED_HINTS)).select("doc_id", "label").distinct().select("doc_id", "label", rules(F.col("label"), 1).alias("_rule"))
    pairs = asked.join(offered, ["doc_id", "_rule"]).where("label <> _head").drop("_rule").distinct().withColumn("_score", damage_score(F.col("_head"), F.col("label")))
    best = _best(pairs.where("_score > 0"), ["doc_id", "pos"], "_target")
    better = F.col("_score") > F.coalesce(damage_score(F.col("head"), F.col("tail")), F.lit(0))
    return relations.join(best, ["doc_id", "pos"], "left").select(*(F.when(better, F.col("_target")).otherwise(F.col(c)).alias(c) if c == "tail" else F.col(c) for c in relations.columns))
