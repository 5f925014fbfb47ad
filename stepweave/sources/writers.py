"""Sinks: flat CSV, JSON lines and GraphML, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_columns(df: DataFrame) -> list[Column]:
    """Arrays joined by |, structs as JSON, other columns as they are."""
    return [F.concat_ws("|", F.transform(c, lambda x: x.cast("string"))).alias(c) if kind.startswith("array<") and "struct" not in kind else F.to_json(c).alias(c) if kind.startswith(("struct", "map", "array")) else F.col(c) for c, kind in df.dtypes]


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*flat_columns(df)).write.csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line, nulls included."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(nodes: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """Lines of a GraphML file (part, pos, value): displayed edges and the nodes that touch them; empty properties are left out.

    A displayed edge whose end is no node fails, and so does a label that two nodes have.
    """
    from stepweave.operators.graph import readable

    own, shown = readable(nodes.where(F.col("domain_id") == domain), edges.where(F.col("domain_id") == domain))

    def data(df: DataFrame, skip: tuple) -> Column:
        return F.concat_ws("", *(F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f'<data key="{c}">'), escaped(v.cast("string")), F.lit("</data>"))) for c, v in zip(df.columns, flat_columns(df), strict=True) if c not in skip))

    doubled = nodes.where(F.col("domain_id") == domain).groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label").first()
    if doubled:
        raise ValueError(f"two nodes have the label {doubled['label']!r}")
    ends = shown.select(F.explode(F.array("head", "tail")).alias("label")).join(own.select("label"), "label", "left_anti").first()
    if ends:
        raise ValueError(f"an edge ends at {ends['label']!r}, which is no node")
    ids = own.select("label", "node_id")
    keys = [f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="string"/>' for kind, df in (("node", own), ("edge", shown)) for c in df.columns]
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(dict.fromkeys(keys)) + '<graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, pos string, value string")
    body = own.select(F.lit(1).alias("part"), F.col("node_id").alias("pos"), F.concat(F.lit('<node id="'), escaped(F.col("node_id")), F.lit('">'), data(own, ("node_id",)), F.lit("</node>")).alias("value"))
    joined = shown.join(ids.select(F.col("label").alias("head"), F.col("node_id").alias("source")), "head").join(ids.select(F.col("label").alias("tail"), F.col("node_id").alias("target")), "tail")
    links = joined.select(F.lit(2).alias("part"), F.concat_ws("::", "head", "label", "tail").alias("pos"), F.concat(F.lit('<edge source="'), escaped(F.col("source")), F.lit('" target="'), escaped(F.col("target")), F.lit('">'), data(shown, ()), F.lit("</edge>")).alias("value"))
    return head.unionByName(body).unionByName(links).orderBy("part", "pos")
