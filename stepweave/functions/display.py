"""How steps and relations are shown: actions, salience and step labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions.text import let, normalize_space, step_token, whole_word

ACTIONS = tuple(dict.fromkeys(K.ACTION_WORDS.values()))


def _strings(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def relation_phrase(label: Column) -> Column:
    return F.lower(normalize_space(F.translate(label, "_/", "  ")))


def action(label: Column) -> Column:
    """The action that a phrase names as a whole, else by its first word that names one; null for weak phrases."""
    table = _strings(K.ACTION_WORDS)
    words = lambda phrase: F.concat(F.array(phrase), F.regexp_extract_all(phrase, F.lit("([a-z0-9]+(?:-[a-z0-9]+)?)"), 1))
    first = lambda phrase: F.get(F.array_compact(F.transform(words(phrase), lambda w: F.try_element_at(table, w))), F.lit(0))
    return let(relation_phrase(label), lambda phrase: F.when(~phrase.isin(*K.WEAK_RELATIONS), first(phrase)))


def step_summary(text: Column) -> Column:
    """The first clause of a step's text, without what it is for or where it is done."""
    flat = F.trim(F.regexp_replace(normalize_space(text), K.SUMMARY_PREFIX, ""))
    first = lambda x: F.array_min(F.filter(F.array(*(F.locate(end, F.lower(x)) for end in K.SUMMARY_ENDS)), lambda at: at > 1))
    return let(flat, lambda x: F.trim(F.substring(x, F.lit(1), F.coalesce(first(x) - 1, F.length(x)))))


def short_summary(summary: Column, words: int = 10, chars: int = 72) -> Column:
    """Whole words up to `words` and `chars`; the first always."""
    listed = F.slice(F.regexp_extract_all(summary, F.lit(r"([A-Za-z0-9][A-Za-z0-9\-./]*)"), 1), 1, words)
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))
    more = lambda s, w: F.concat(s["t"], F.lit(" "), w)
    add = lambda s, w: F.when(s["full"], s).when(s["t"] == "", F.struct(w.alias("t"), F.lit(False).alias("full"))).when(F.length(more(s, w)) > chars, F.struct(s["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(more(s, w).alias("t"), F.lit(False).alias("full")))
    return F.aggregate(listed, start, add, lambda s: s["t"])


def step_action(phase: Column, summary: Column) -> Column:
    """What a step does, by its phase and its summary."""
    return let(F.struct(phase.alias("phase"), action(summary).alias("named"), relation_phrase(summary).alias("phrase")), lambda v: _step_action(v["phase"], v["named"], v["phrase"]))


def _step_action(phase: Column, named: Column, phrase: Column) -> Column:
    among = lambda *names: F.when(named.isin(*names), named)
    return (
        F.when(phase == "observe", F.coalesce(among("record", "inspect", "measure", "expose", "compare"), F.lit("inspect")))
        .when(phase == "diagnose", F.coalesce(named, F.lit("compare")))
        .when(phase == "repair", F.coalesce(among("repair", "remove", "expose"), F.lit("repair")))
        .when(phase == "verify", "verify")
        .when(phrase.contains("pressure hold") | phrase.contains("proof cycle"), "verify")
        .when(phrase.contains("time to first"), "measure")
        .otherwise(named)
    )


def display_action(label: Column, of_step: Column, tail_type: Column) -> Column:
    """The action that a step's relation shows: its own, the step's where that says more or the relation names none."""
    return let(F.struct(action(label).alias("own"), of_step.alias("of_step"), tail_type.alias("kind")), lambda v: _display_action(v["own"], v["of_step"], v["kind"]))


def _display_action(own: Column, of_step: Column, tail_type: Column) -> Column:
    observed = tail_type.isin("Signal", "State", "Fault")
    return F.when(observed & (((own == "inspect") & of_step.isin("record", "verify")) | ((own == "record") & (of_step == "verify"))), of_step).otherwise(F.coalesce(own, F.when(of_step.isin(*ACTIONS), of_step)))


def _shown(salience: str, reason: Column | str | None = None) -> Column:
    reason = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    return F.struct(F.lit(salience).alias("salience"), F.lit(salience != "low").alias("admitted"), reason.cast("string").alias("hidden"))


def workflow_policy(label: Column, shown_as: Column, tail: Column, tail_type: Column) -> Column:
    """salience, admitted, hidden (why not) of a step's relation that is shown as an action; first match wins."""
    return let(F.struct(label.alias("label"), shown_as.alias("shown_as"), tail.alias("tail"), tail_type.alias("kind")), lambda v: _workflow_policy(v["label"], v["shown_as"], v["tail"], v["kind"]))


def _workflow_policy(label: Column, shown_as: Column, tail: Column, tail_type: Column) -> Column:
    weak = relation_phrase(label).isin(*K.WEAK_RELATIONS)
    handled = shown_as.isin("expose", "remove", "repair") & (tail_type == "Component") & ~relation_phrase(tail).rlike(whole_word(K.GENERIC_CONTEXT))
    proven = (shown_as == "verify") & tail_type.isin("State", "Fault")
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.when(~yes(shown_as.isin(*ACTIONS)), _shown("low", "unsupported_workflow_action")).when(yes(tail_type == "Asset"), _shown("low", "workflow_asset_context"))
    out = out.when(weak & yes(handled | proven), _shown("medium")).when(weak, _shown("low", "weak_workflow_relation"))
    for name, (high, medium, reason) in K.ACTION_TARGETS.items():
        for salience, types in (("high", high), ("medium", medium)):
            if types:
                out = out.when((shown_as == name) & yes(tail_type.isin(*types)), _shown(salience))
        out = out.when(shown_as == name, _shown("low", reason))
    return out


def relation_display(status: Column, kind: Column, family: Column, label: Column, of_step: Column, tail: Column, tail_type: Column) -> Column:
    """display (the name shown), salience, admitted, hidden of any judged relation; what is not accepted is not shown."""
    shown_as = display_action(label, of_step, tail_type)
    policy = workflow_policy(label, shown_as, tail, tail_type)
    named = lambda name, p: F.struct(name.alias("display"), p["salience"].alias("salience"), p["admitted"].alias("admitted"), p["hidden"].alias("hidden"))
    plain = lambda salience, admitted, hidden: F.struct(F.lit(salience).cast("string").alias("salience"), F.lit(admitted).alias("admitted"), F.lit(hidden).cast("string").alias("hidden"))
    return (
        F.when(status != "accepted", named(label, plain(None, False, "not_accepted")))
        .when(kind == "sequence", named(F.lit("triggers"), plain("high", True, None)))
        .when(kind == "action_object", named(F.coalesce(shown_as, label), policy))
        .when(family.isin("communication", "propagation", "lifecycle"), named(label, plain("high", True, None)))
        .when(family == "structural", named(label, plain("medium", True, None)))
        .otherwise(named(label, plain("low", True, None)))
    )


def step_source(step: Column) -> Column:
    """A step's text: its surface form, summary or its task's description, unless that is its id; else its task's wording."""
    told = lambda c: F.when((normalize_space(c) != "") & (F.lower(normalize_space(c)) != F.lower(step["step_id"])), normalize_space(c))
    task = step["task"]
    return F.coalesce(told(step["surface_form"]), told(step["step_summary"]), told(task["description"]), F.when(normalize_space(task["surface_form"]) != "", normalize_space(task["surface_form"])), normalize_space(task["label"]), F.lit(""))


def step_label(step: Column) -> Column:
    """What a step is called: its action and object, else its shortened text, and its id. step is a struct of an evidence record."""
    named = lambda x: F.struct(x.alias("summary"), step_action(step["step_phase"], x).alias("does"))
    return let(let(step_summary(step_source(step)), named), lambda v: _step_label(step, v["summary"], v["does"]))


def _step_label(step: Column, summary: Column, does: Column) -> Column:
    concepts = step["concept_mentions"]

    def entry(r: Column) -> Column:
        kind = F.try_element_at(F.filter(concepts, lambda m: m["label"] == r["tail"]), F.lit(-1))["semantic_type_hint"]
        acts = let(kind, lambda k: F.struct(k.alias("kind"), display_action(r["label"], does, k).alias("action")))
        judged = let(acts, lambda a: F.struct(a["kind"].alias("kind"), a["action"].alias("action"), workflow_policy(r["label"], a["action"], r["tail"], a["kind"]).alias("p")))
        own = step_token(r["head"]).eqNullSafe(step_token(step["step_id"]))
        return let(judged, lambda j: F.when(own & j["p"]["admitted"], F.struct(F.when(j["p"]["salience"] == "high", 0).otherwise(1).alias("rank"), j["action"].alias("action"), j["kind"].alias("kind"), r["tail"].alias("tail"))))

    listed = F.array_compact(F.transform(F.coalesce(step["relation_mentions"], F.array().cast("array<struct<label:string,family:string,head:string,tail:string>>")), entry))
    def tell(listed: Column, chosen: Column) -> Column:
        ordered = F.array_sort(F.transform(listed, lambda e: F.struct(e["rank"], (e["action"] != chosen).alias("other"), F.length(e["tail"]).alias("n"), e["tail"].alias("tail"), e["kind"].alias("kind"))))
        return let(ordered, lambda o: let(F.filter(o, lambda e: ~e["other"]), lambda same: F.concat(F.upper(F.substring(chosen, 1, 1)), F.substring(chosen, 2, 100), F.lit(" "), thing(o, same, chosen))))

    def thing(ordered: Column, same: Column, chosen: Column) -> Column:
        kind = F.coalesce(F.get(same, F.lit(0)), F.get(ordered, F.lit(0)))["kind"]
        usual = F.when((chosen == "inspect") & (kind == "Component"), "critical components").when((chosen == "inspect") & kind.isin("State", "Fault"), "fault boundary").otherwise(F.try_element_at(_strings(K.DEFAULT_OBJECTS), chosen))
        return F.when(F.size(same) == 1, F.get(same, F.lit(0))["tail"]).otherwise(F.coalesce(usual, F.lit("workflow step")))

    short = let(short_summary(summary), lambda x: F.when(x != "", x))
    text = let(listed, lambda x: let(F.coalesce(does, F.get(x, F.lit(0))["action"]), lambda chosen: F.when(chosen.isNotNull(), tell(x, chosen)).otherwise(short)))
    return F.coalesce(F.concat(text, F.lit(" ("), step["step_id"], F.lit(")")), step["step_id"])
