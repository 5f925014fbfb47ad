"""A whole run from settings: evidence of each domain, candidates, decisions, graph, and the run's folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave import settings, validation
from stepweave.operators import assembly, attachment, audits, decisions, evidence, extractor, graph, providers, routing
from stepweave.settings import SettingsError
from stepweave.sources import artifacts, clients, manuals
from stepweave.sources.readers import read_evidence, read_evidence_lines
from stepweave.sources.split_json import read_evidence_split

ROUTES = ("reuse_backbone", "vertical_specialize", "reject")


@dataclass(frozen=True)
class Domain:
    """A domain and its evidence: a path that Spark reads (JSON, or JSON lines where it ends in .jsonl), the source types taken, a file of further concepts, and one of type constraints of its own.

    split_mb: JSON files are read in ranges of so many MB, for files too large for a task; 0 reads each whole.
    """

    domain_id: str
    data_path: str
    source_types: tuple[str, ...] = ("om_manual",)
    role: str = "target"
    ontology_seed_path: str | None = None
    constraints_path: str | None = None
    split_mb: int = 0


@dataclass(frozen=True)
class Variant:
    """A way to decide on candidates: strategy is a key of STRATEGIES, or llm with a function given to run().

    routing is none, or how anchors are retrieved for candidates before: a mode of routing.MODES. It needs a model of vectors, and embedding_top1 needs it.
    """

    variant_id: str
    description: str = ""
    strategy: str = "deterministic"
    allow_free_growth: bool = False
    detailed: bool = False
    routing: str = "none"
    top: int = 3


@dataclass(frozen=True)
class RunSettings:
    """Settings of a run, checked when made: known strategies, one role, no id twice.

    seed_descriptions: the concepts of the backbone and what they mean, the fixed ones unless given. constraints_path: a file of type
    constraints for the domains without their own; without any file the fixed ones hold. vectors_path and embedding_model: where vectors of texts are kept, and by what name.
    """

    project_name: str
    domains: tuple[Domain, ...]
    variants: tuple[Variant, ...]
    output_path: str = ""
    allowed_routes: tuple[str, ...] = ROUTES
    relation_families: tuple[str, ...] = field(default_factory=lambda: tuple(K.TYPE_CONSTRAINTS))
    seed_descriptions: dict[str, str] | None = None
    constraints_path: str | None = None
    validate_relations: bool = True
    vectors_path: str | None = None
    embedding_model: str = "default"

    def __post_init__(self) -> None:
        if not self.domains or not self.variants:
            raise SettingsError("a run needs a domain and a variant")
        for kind, names, check in (("domain", [d.domain_id for d in self.domains], validation.domain_id), ("variant", [v.variant_id for v in self.variants], validation.variant_id)):
            for name in names:
                check(name)
            if len(set(names)) < len(names):
                raise SettingsError(f"a {kind} stands twice: {', '.join(names)}")
        for d in self.domains:
            validation.member("role", d.role, ("target",))
        for v in self.variants:
            validation.member("strategy", v.strategy, (*STRATEGIES, "llm"))
            validation.member("routing", v.routing, ("none", *routing.MODES))
            validation.positive(v.top)
            if v.strategy == "embedding_top1" and v.routing == "none":
                raise SettingsError(f"{v.variant_id}: embedding_top1 needs routing")
        for r in self.allowed_routes:
            validation.member("route", r, ROUTES)
        for f in self.relation_families:
            validation.member("relation family", f, K.TYPE_CONSTRAINTS)

    def only(self, domains: list[str] | None = None, variants: list[str] | None = None) -> RunSettings:
        """The same settings for some domains and variants; names that there are not fail."""
        from dataclasses import replace

        for name in domains or ():
            validation.member("domain", name, [d.domain_id for d in self.domains])
        for name in variants or ():
            validation.member("variant", name, [v.variant_id for v in self.variants])
        kept = tuple(d for d in self.domains if not domains or d.domain_id in domains)
        return replace(self, domains=kept, variants=tuple(v for v in self.variants if not variants or v.variant_id in variants))


def _made(kind: type, given: dict[str, Any], lists: tuple[str, ...] = ()) -> Any:
    unknown = set(given) - set(kind.__dataclass_fields__)
    if unknown:
        raise SettingsError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    try:
        return kind(**{k: tuple(v) if k in lists else v for k, v in given.items()})
    except TypeError as e:
        raise SettingsError(f"{kind.__name__}: {e}") from e


def load_settings(path: str) -> RunSettings:
    """Settings of a run from a file (settings.load); unknown and missing keys fail."""
    told = settings.load(path)
    own = dict(told)
    own["domains"] = [_made(Domain, d, ("source_types",)) for d in told.get("domains") or ()]
    own["variants"] = [_made(Variant, v) for v in told.get("variants") or ()]
    return _made(RunSettings, own, ("domains", "variants", "allowed_routes", "relation_families"))


@dataclass(frozen=True)
class PreprocessSettings:
    """Settings of the way from manuals to evidence records; llm has the fields of sources.clients.Endpoint. Fields llm_<name> at the top are an older form of it.

    answers_path: where answers are kept, so that a run that failed goes on.
    """

    data_root: str
    output_path: str
    prompt_template_path: str
    llm: clients.Endpoint
    domain_ids: tuple[str, ...] = tuple(manuals.DOMAIN_FOLDERS)
    role: str = "target"
    answers_path: str | None = None
    relation_families: tuple[str, ...] = tuple(K.TYPE_CONSTRAINTS)
    backbone_concepts: tuple[str, ...] = K.ANCHORS

    def __post_init__(self) -> None:
        validation.member("role", self.role, ("target",))
        for d in self.domain_ids:
            validation.domain_id(d)


def load_preprocess_settings(path: str) -> PreprocessSettings:
    """Settings of preprocess() from a file; unknown and missing keys fail."""
    told = dict(settings.load(path))
    older = {k.removeprefix("llm_"): told.pop(k) for k in [k for k in told if k.startswith("llm_")]}
    model = dict(told.get("llm") or older)
    if "host" in model:
        model.setdefault("base_url", model.pop("host"))
        model.pop("host", None)
    model.pop("provider", None)
    told["llm"] = _made(clients.Endpoint, model)
    return _made(PreprocessSettings, told, ("domain_ids", "relation_families", "backbone_concepts"))


def preprocess(spark: SparkSession, told: PreprocessSettings, generate: Callable[[str], str] | None = None) -> DataFrame:
    """The evidence records of all manuals, added to output_path as JSON lines by domain; generate stands in for the settings' model."""
    documents = manuals.read_domains(spark, told.data_root, list(told.domain_ids), told.role)
    made = extractor.records_of_documents(
        documents, manuals.read_prompt(spark, told.prompt_template_path), generate or clients.chat(told.llm), told.answers_path, model=told.llm.model, families=told.relation_families, backbone=told.backbone_concepts
    ).checkpoint()
    artifacts.write_records(made, told.output_path)
    return made


def by_anchors(candidates: DataFrame, variant: Variant, backbone: tuple[str, ...] = K.ANCHORS, least: float = 0.0) -> DataFrame:
    """Proposals from retrieved anchors (top_anchor, where the candidates have it), else from hints and families of relations."""
    if "top_anchor" not in candidates.columns:
        candidates = candidates.withColumn("top_anchor", F.lit(None).cast("string"))
    return decisions.top1_decisions(candidates, variant.allow_free_growth, least, backbone)


def deterministic(candidates: DataFrame, variant: Variant, backbone: tuple[str, ...] = K.ANCHORS) -> DataFrame:
    """The same, a specialization never below a confidence of 0.6."""
    return by_anchors(candidates, variant, backbone, 0.6)


#: How a variant proposes a route and an anchor for each candidate; decide() has the last word on all.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"deterministic": deterministic, "embedding_top1": by_anchors}


def by_model(template: str, generate: Callable[[str], str], path: str | None = None, model: str = "default", size: int = 8, backbone: tuple[str, ...] = K.ANCHORS) -> Callable[[DataFrame, Variant], DataFrame]:
    """A function for run() that lets a model propose, for variants of strategy llm: prompts of up to `size` candidates, each with what is known and recommended.

    Labels of the backbone are not asked about. With a path answers are kept, so a run that failed goes on (providers.answered()).
    """

    def propose(candidates: DataFrame, variant: Variant) -> DataFrame:
        if "top_anchor" not in candidates.columns:
            candidates = candidates.withColumn("top_anchor", F.lit(None).cast("string")).withColumn("retrieved", F.lit(None).cast("array<struct<rank:int,anchor:string,score:double>>"))
        told = decisions.priors(candidates, backbone).where(~F.col("label").isin(*backbone))
        features = F.struct("support_count", "relation_count", "head_count", "tail_count", "families", "step_ids", "hint", "hint_candidates", "hypernym")
        prior = F.struct("recommended_anchor", "recommended_route", "agreement", "strength")
        payload = F.to_json(F.struct("candidate_id", "label", "description", "evidence_ids", "evidence_texts", features.alias("routing_features"), F.col("retrieved_anchors"), prior.alias("prior")), {"ignoreNullFields": "false"})
        asking = told.drop("retrieved").join(candidates.select("candidate_id", F.col("retrieved").alias("retrieved_anchors")), "candidate_id").select("domain_id", "candidate_id", payload.alias("payload"))
        answers = providers.model_decisions(asking, template, generate, size, path=path, model=model).checkpoint()
        return decisions.complete(candidates, answers, backbone)

    return propose


def cached_vectors(run: RunSettings, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A function of texts (text) that gives text_hash and vector of the distinct ones: from the run's table of vectors, the rest from embed, once, and kept there."""

    def vectors(texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        cache = artifacts.load_vectors(spark, run.vectors_path, run.embedding_model) if run.vectors_path else spark.createDataFrame([], "text_hash string, vector array<double>")
        kept = lambda missing: embed(missing).select("text_hash", "text", F.col("vector").cast("array<double>").alias("vector")).checkpoint()
        found, new = providers.embed_with_cache(texts, cache, kept)
        found = found.select("text_hash", "vector").checkpoint()
        if run.vectors_path:
            artifacts.save_vectors(new, run.vectors_path, run.embedding_model)
        return found

    return vectors


def constraints(spark: SparkSession, run: RunSettings) -> DataFrame | None:
    """The type constraints of a run's files; None where no file is named, so that the fixed ones hold; empty where relations are not validated."""
    if not run.validate_relations:
        return graph.constraint_rules(spark, {})
    paths = {None: run.constraints_path} | {d.domain_id: d.constraints_path for d in run.domains}
    if not any(paths.values()):
        return None
    told = {domain: manuals.read_constraints(spark, path) for domain, path in paths.items() if path}
    return graph.constraint_rules(spark, {None: K.TYPE_CONSTRAINTS} | told)


def domain_records(spark: SparkSession, run: RunSettings) -> DataFrame:
    """The records of all domains in order, labels canonical; of each domain those of its source types and role."""
    found = None
    for path, split in {d.data_path: d.split_mb for d in run.domains}.items():
        if path.endswith((".jsonl", ".ndjson")):
            own = read_evidence_lines(spark, path)
        else:
            own = read_evidence_split(spark, path, split << 20) if split else read_evidence(spark, path)
        found = own if found is None else found.unionByName(own)
    domains = spark.createDataFrame([(d.domain_id, list(d.source_types), d.role) for d in run.domains], "domain_id string, source_types array<string>, _role string")
    wrong = F.raise_error(F.concat(F.lit("role of "), "evidence_id", F.lit(" is not its domain's"))).cast("string")
    checked = found.join(F.broadcast(domains.select("domain_id", "_role")), "domain_id").withColumn("role", F.when(F.coalesce("role", "_role") == F.col("_role"), F.col("_role")).otherwise(wrong)).drop("_role")
    return evidence.order_records(evidence.canonical(checked), F.broadcast(domains.drop("_role")))


def run(
    spark: SparkSession, run: RunSettings, propose: Callable[[DataFrame, Variant], DataFrame] | None = None, export: bool = True, embed: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, tuple[assembly.Graph, DataFrame]]:
    """Each variant's graph and judged candidates; with export its folder is written too.

    propose stands in for the strategy of variants with `llm`: candidates in, route, parent_anchor,
    reject_reason and confidence added. embed is the model of vectors for variants that route: text_hash and text in, vector added.
    """
    assembly.ensure_checkpoint_dir(spark)
    records = domain_records(spark, run).checkpoint()
    stream = assembly.relation_stream(records)
    found = evidence.candidates(evidence.mentions(records), stream.select("domain_id", "head", "tail", "family")).checkpoint()
    backbone = audits.build_backbone(manuals.supplements(spark, {d.domain_id: d.ontology_seed_path for d in run.domains}), run.seed_descriptions)
    labels = tuple(r["label"] for r in backbone.orderBy("place").collect())  # of the settings' files
    rules = constraints(spark, run)
    units = evidence.evidence_units(records)
    out, by_mode = {}, {}
    for variant in run.variants:
        proposing = propose if variant.strategy == "llm" else STRATEGIES[variant.strategy]
        if proposing is None:
            raise SettingsError(f"{variant.variant_id}: a variant of strategy llm needs a function that proposes")
        candidates = found
        if variant.routing != "none":
            if embed is None:
                raise SettingsError(f"{variant.variant_id}: routing needs a model of vectors")
            if (variant.routing, variant.top) not in by_mode:
                by_mode[variant.routing, variant.top] = routing.routed(found, backbone, cached_vectors(run, embed), variant.routing, variant.top).checkpoint()
            candidates = by_mode[variant.routing, variant.top]
        proposed = proposing(candidates, variant) if variant.strategy == "llm" else proposing(candidates, variant, labels)
        decided = attachment.decide(proposed, run.allowed_routes, variant.allow_free_growth, labels).checkpoint()
        kept = decided.select("domain_id", "label", "admit", "route", "parent_anchor", "reject_reason")
        made = assembly.assemble(records, kept.drop("route"), labels, run.relation_families, rules)
        judged = audits.judged_candidates(candidates, kept, backbone)
        if export:
            artifacts.export_run(made, units, judged, backbone, run.output_path, variant.variant_id, variant.detailed)
        out[variant.variant_id] = (made, judged)
    if export:
        told = artifacts.benchmark_summary(spark, run.output_path, [v.variant_id for v in run.variants])
        artifacts.write_summary(told.withColumn("project_name", F.lit(run.project_name)), f"{run.output_path}/latest_summary")
    return out
