"""Command line: run, replay, rollback, preprocess. Errors of settings end with a line on stderr and status 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from stepweave import runs
from stepweave.session import session
from stepweave.settings import SettingsError, StepweaveError, configure_logging
from stepweave.sources import artifacts, manuals


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stepweave")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="records to graphs, and a folder for each variant")
    run.add_argument("--config", required=True)
    run.add_argument("--domains", nargs="*")
    run.add_argument("--variants", nargs="*")
    run.add_argument("--no-export", action="store_true")
    for name, told in (("replay", "the graph of a run as it was after a snapshot, else at its end"), ("rollback", "the graph to which a snapshot leads back")):
        state = commands.add_parser(name, help=told)
        state.add_argument("--run-dir", required=True)
        state.add_argument("--variant", required=True)
        state.add_argument("--domain", required=True)
        state.add_argument("--snapshot", required=name == "rollback")
    documents = commands.add_parser("preprocess", help="folders of manuals to a table of documents")
    documents.add_argument("--config", help="settings with a model: evidence records instead of documents")
    documents.add_argument("--data-root")
    documents.add_argument("--domain-ids", nargs="+")
    documents.add_argument("--output-path")
    documents.add_argument("--role", default="target", choices=["target"])
    return out


def _work(given: argparse.Namespace) -> str:
    if given.command == "run":
        told = runs.load_settings(given.config).only(given.domains, given.variants)
        made = runs.run(session(), told, export=not given.no_export)
        return "\n".join(f"{name}: {graph.nodes.count()} nodes, {graph.edges.count()} edges" for name, (graph, _) in made.items())
    spark = session()
    if given.command == "preprocess" and given.config:
        told = runs.load_preprocess_settings(given.config)
        return f"{runs.preprocess(spark, told).count()} records in {told.output_path}"
    if given.command == "preprocess":
        if not (given.data_root and given.domain_ids and given.output_path):
            raise SettingsError("preprocess needs --config, or --data-root, --domain-ids and --output-path")
        manuals.read_domains(spark, given.data_root, given.domain_ids, given.role).write.partitionBy("domain_id").parquet(given.output_path)
        return given.output_path
    at = given.snapshot
    if at is None:
        states = spark.read.parquet(f"{given.run_dir}/{given.variant}/graph/snapshots").where(F.col("domain_id") == given.domain)
        last = states.agg(F.max_by("snapshot_id", "record_idx").alias("s")).first()["s"]
        at = "none" if last is None else last
    nodes, edges = artifacts.load_snapshot(spark, given.run_dir, given.variant, given.domain, at)
    return f"{at}: {nodes.count()} nodes, {edges.count()} edges"


def main(args: list[str] | None = None) -> int:
    configure_logging()
    try:
        print(_work(parser().parse_args(args)))
    except (StepweaveError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
