"""Sections to evidence items and relations.

items(doc_idx, paper_id, item_type, item_id, ord, text, section, page, evidence_span,
confidence). A paper's items of one type share a running number in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, strip
from ..sources.staging import staged

# Markers with their id prefix and item type.
MARKERS = {
    "claim": ("claim", "Claim"), "method": ("method", "Method"), "experiment": ("experiment", "Experiment"),
    "result": ("result", "Experiment"), "limitation": ("limitation", "Limitation"), "concept": ("concept", "Concept"),
    "주장": ("claim", "Claim"), "방법": ("method", "Method"), "실험": ("experiment", "Experiment"),
    "결과": ("result", "Experiment"), "한계": ("limitation", "Limitation"), "개념": ("concept", "Concept"),
}
# Section titles that stand for a type.
KINDS = {
    "Claim": ["abstract", "초록", "요약"],
    "Method": ["method", "methods", "methodology", "방법", "approach"],
    "Experiment": ["experiment", "experiments", "evaluation", "result", "results", "실험", "평가", "결과"],
    "Limitation": ["limitation", "limitations", "한계"],
}
TYPES = ["Claim", "Method", "Experiment", "Limitation", "Concept"]


def content_lines(text: Column) -> Column:
    """Lines with anything on them, without bullets and blanks at both ends."""
    return F.transform(F.filter(lines(text), lambda x: strip(x) != ""), bare)


def bare(line: Column) -> Column:
    """A line without bullets and blanks at both ends."""
    return F.btrim(line, F.lit("-* \t"))


def marker(line: Column) -> Column:
    """The line's marker, or null."""
    found = F.lower(strip(F.substring_index(line, ":", 1)))
    return F.when(line.contains(":") & found.isin(list(MARKERS)), found)


def _lookup(c: Column, part: int) -> Column:
    out = None
    for k, v in MARKERS.items():
        out = F.when(c == k, v[part]) if out is None else out.when(c == k, v[part])
    return out


def marked_items(sections: DataFrame) -> DataFrame:
    """An item for each line of the form ``Marker: value``; an empty value counts."""
    rows = sections.where(F.col("text").contains(":")).select("doc_idx", "paper_id", "section_idx", F.col("title").alias("section"), "page", F.posexplode(lines(F.col("text"))).alias("line_idx", "line"))
    rows = rows.where(F.col("line").contains(":")).withColumn("line", bare(F.col("line")))
    rows = rows.withColumn("marker", marker(F.col("line"))).where("marker is not null")
    rows = rows.select("*", _lookup(F.col("marker"), 0).alias("prefix"), _lookup(F.col("marker"), 1).alias("item_type"))
    n = F.row_number().over(Window.partitionBy("doc_idx", "paper_id", "item_type").orderBy("section_idx", "line_idx"))
    value = strip(F.expr("substring(line, instr(line, ':') + 1)"))
    return rows.withColumn("ord", n).select(
        "doc_idx", "paper_id", "item_type", F.concat_ws(":", "paper_id", "prefix", F.col("ord").cast("string")).alias("item_id"), "ord",
        value.alias("text"), "section", "page", F.col("line").alias("evidence_span"), F.lit(1.0).alias("confidence"),
    )


def first_sentence(text: Column) -> Column:
    firsts = F.transform(F.filter(content_lines(text), lambda x: marker(x).isNull()), lambda x: strip(F.substring_index(x, ". ", 1)))
    return F.substring(F.coalesce(F.get(F.filter(firsts, lambda x: x != ""), 0), F.lit("")), 1, 500)


def section_kind(title: Column) -> Column:
    t = strip(F.lower(title))
    out = None
    for kind, names in KINDS.items():
        out = F.when(t.isin(names), kind) if out is None else out.when(t.isin(names), kind)
    return out


def fallback_items(sections: DataFrame, marked: DataFrame) -> DataFrame:
    """For each type a paper has no marked item of, the first sentence of its first
    section of that kind."""
    rows = sections.withColumn("item_type", section_kind(F.col("title"))).where("item_type is not null")
    rows = rows.withColumn("sentence", first_sentence(F.col("text"))).where("sentence <> ''")
    first = rows.groupBy("doc_idx", "paper_id", "item_type").agg(F.min_by(F.struct("title", "page", "sentence"), "section_idx").alias("s"))
    first = first.join(marked.select("doc_idx", "item_type").distinct(), ["doc_idx", "item_type"], "left_anti")
    return first.select(
        "doc_idx", "paper_id", "item_type", F.concat_ws(":", "paper_id", F.lower("item_type"), F.lit("1")).alias("item_id"), F.lit(1).alias("ord"),
        F.col("s.sentence").alias("text"), F.col("s.title").alias("section"), F.col("s.page").alias("page"), F.col("s.sentence").alias("evidence_span"), F.lit(0.35).alias("confidence"),
    )


def items(sections: DataFrame, stage: bool = False) -> DataFrame:
    """Marked and fallback items. ``stage`` writes the marked ones, which are read twice."""
    marked = staged(marked_items(sections)) if stage else marked_items(sections)
    return marked.unionByName(fallback_items(sections, marked))


def method_concept_relations(items_: DataFrame) -> DataFrame:
    """A ``uses`` edge from each method to each concept of its paper it names; the page
    is dropped, the order is by method, then concept."""
    m = items_.where("item_type = 'Method'").select("doc_idx", "paper_id", F.col("ord").alias("m_ord"), F.col("item_id").alias("source"), F.lower("text").alias("m_text"), "section", "evidence_span")
    c = items_.where("item_type = 'Concept'").select("doc_idx", F.col("ord").alias("c_ord"), F.col("item_id").alias("target"), F.lower("text").alias("c_text"))
    named = F.col("m_text").contains(F.col("c_text")) | F.lower("evidence_span").contains(F.col("c_text"))
    return m.join(c, "doc_idx").where(named).select(
        "doc_idx", "paper_id", "m_ord", "c_ord", "source", "target", F.lit("uses").alias("type"), "section", F.lit(None).cast("int").alias("page"), "evidence_span", F.lit(0.6).alias("confidence")
    )
