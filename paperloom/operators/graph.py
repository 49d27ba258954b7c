"""Knowledge graph of papers, items and relations, with checks as reports or errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Order of the item types and the edges from a paper to its items.
TYPE_ORDER = {"Paper": 0, "Claim": 1, "Method": 2, "Experiment": 3, "Limitation": 4, "Concept": 5}
PAPER_EDGES = {"Claim": "paper_has_claim", "Method": "paper_uses_method", "Experiment": "paper_reports_experiment", "Limitation": "paper_has_limitation"}


def type_order(c):
    out = None
    for k, v in TYPE_ORDER.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def nodes(titles: DataFrame, items: DataFrame) -> DataFrame:
    papers = titles.select(
        "doc_idx", F.lit(0).alias("type_ord"), F.lit(0).alias("ord"), F.col("paper_id").alias("id"), F.col("title").alias("label"), F.lit("Paper").alias("type"),
        "paper_id", F.lit("").alias("section"), F.lit(None).cast("int").alias("page"), F.lit("").alias("evidence_span"), F.lit(None).cast("double").alias("confidence"),
    )
    rest = items.select(
        "doc_idx", type_order(F.col("item_type")).alias("type_ord"), "ord", F.col("item_id").alias("id"), F.col("text").alias("label"), F.col("item_type").alias("type"),
        "paper_id", "section", "page", "evidence_span", "confidence",
    )
    return papers.unionByName(rest)


def edges(items: DataFrame, relations: DataFrame) -> DataFrame:
    kind = None
    for t, e in PAPER_EDGES.items():
        kind = F.when(F.col("item_type") == t, e) if kind is None else kind.when(F.col("item_type") == t, e)
    own = items.withColumn("kind", kind).where("kind is not null").select(
        "doc_idx", type_order(F.col("item_type")).alias("type_ord"), "ord", F.lit(0).alias("ord2"), F.col("paper_id").alias("source"), F.col("item_id").alias("target"), F.col("kind").alias("type"),
        "paper_id", F.lit("").alias("section"), F.lit(None).cast("int").alias("page"), F.lit("").alias("evidence_span"), F.lit(None).cast("double").alias("confidence"),
    )
    rel = relations.select("doc_idx", F.lit(9).alias("type_ord"), F.col("m_ord").alias("ord"), F.col("c_ord").alias("ord2"), "source", "target", "type", "paper_id", "section", "page", "evidence_span", "confidence")
    return own.unionByName(rel)


def duplicate_nodes(nodes_: DataFrame) -> DataFrame:
    return nodes_.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def dangling_edges(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges with an end that is no node: (source, target, missing); the source first."""
    ids = nodes_.select("id").distinct()
    no_source = edges_.join(ids, F.col("source") == F.col("id"), "left_anti").select("source", "target", F.col("source").alias("missing"))
    has = edges_.join(ids, F.col("source") == F.col("id"), "left_semi")
    return no_source.unionByName(has.join(ids, F.col("target") == F.col("id"), "left_anti").select("source", "target", F.col("target").alias("missing")))


def check(nodes_: DataFrame, edges_: DataFrame) -> None:
    """Raise for the smallest duplicate node id, else for the smallest missing end."""
    bad = duplicate_nodes(nodes_).agg(F.min("id")).first()[0]
    if bad is not None:
        raise ValueError(f"duplicate node id: {bad}")
    bad = dangling_edges(edges_, nodes_).agg(F.min("missing")).first()[0]
    if bad is not None:
        raise ValueError(f"edge end is no node: {bad}")
