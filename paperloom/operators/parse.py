"""Documents to sections. Input docs(doc_idx, paper_id, text); sections keep ordinals.

Null text gives one empty section titled ``Document``; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, BLANKS, ENDS, SPACE, lines, plain_ends, strip, title_case

# Headings of unmarked documents, in two languages.
HEADINGS = [
    "abstract", "초록", "요약", "introduction", "서론", "background", "관련 연구", "related work", "method", "methods",
    "methodology", "방법", "approach", "experiment", "experiments", "evaluation", "실험", "평가", "result", "results",
    "결과", "discussion", "논의", "limitation", "limitations", "한계", "conclusion", "결론", "references", "참고문헌",
]


def without_hashes(c: Column) -> Column:
    return strip(F.regexp_replace(c, "^#+", ""))


def stem_title(stem: Column) -> Column:
    return title_case(F.translate(stem, "-_", "  "))


def first_title(text: Column) -> Column:
    first = strip(F.regexp_extract(F.coalesce(text, F.lit("")), f"^[{SPACE}]*([^{ENDS}]+)", 1))
    return F.coalesce(F.when(first.startswith("#"), without_hashes(first)).otherwise(first), F.lit(""))


def document_titles(docs: DataFrame) -> DataFrame:
    """(doc_idx, paper_id, title): the first line, else the prettified paper id."""
    t = first_title(F.col("text"))
    return docs.select("doc_idx", "paper_id", F.when(t != "", t).otherwise(stem_title(F.col("paper_id"))).alias("title"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_idx, paper_id, section_idx, title, text, page): a line starting with # opens a
    section; sections without text are dropped; a document left without any is one
    section of its own.

    A text is cut before its heading lines by one regular expression and its sections are
    exploded at once, so nothing is shuffled however many there are. Whether any section
    will have text is told by the first line that is no heading.
    """
    text = F.coalesce("text", F.lit(""))
    filled = text.rlike(f"(?:^|[{ENDS}])[{BLANK}]*[^#{SPACE}]")
    parts = F.when(filled, F.split(text, f"(?:^|(?<=[{ENDS}]))(?=[{BLANK}]*#)")).otherwise(F.array(text))
    starts = lambda c: F.ltrim(c, F.lit(BLANKS)).startswith("#")
    rows = docs.select("doc_idx", "paper_id", filled.alias("filled"), starts(text).cast("int").alias("first"), F.posexplode(parts).alias("i", "part"))
    rows = rows.withColumn("head", F.col("filled") & starts(F.col("part"))).withColumn("line", F.when(F.col("head"), F.regexp_extract("part", f"^[^{ENDS}]*", 0)))
    title = F.when(F.col("head"), F.coalesce(F.nullif(without_hashes(strip(F.col("line"))), F.lit("")), F.lit("Document"))).otherwise("Document")
    body = strip(F.when(F.col("head"), F.substring(F.col("part"), F.length("line") + 1, F.length("part"))).otherwise(F.col("part")))
    out = rows.select("doc_idx", "paper_id", "filled", F.when(F.col("filled"), F.col("i") + F.col("first")).otherwise(0).alias("section_idx"), title.alias("title"), body.alias("text"))
    out = out.where((F.col("text") != "") | ~F.col("filled"))
    return out.select("doc_idx", "paper_id", "section_idx", "title", F.when(F.col("filled"), plain_ends(F.col("text"))).otherwise(F.col("text")).alias("text"), F.lit(None).cast("int").alias("page"))


def clean_heading(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), f"^[0-9]+(\\.[0-9]+)*[{SPACE}]*", ""), r"\.+$", ""))


def is_heading(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(clean_heading(c)), f"[{SPACE}]+", " ")
    return (F.length(c) <= 80) & plain.isin(HEADINGS)


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(r"^\p{Nd}+$")


def page_sections(pages: DataFrame) -> DataFrame:
    """pages(doc_idx, paper_id, title, page, text), one row a page: sections of documents
    without markup, opened by known headings, with the page they begin on. Page numbers
    and leading lines equal to the title are skipped."""
    line = F.posexplode(F.transform(lines(F.col("text")), strip)).alias("line_idx", "line")
    rows = pages.select("doc_idx", "paper_id", F.col("title").alias("doc_title"), "page", line).where((F.col("line") != "") & ~is_page_number(F.col("line")))
    w = Window.partitionBy("doc_idx", "paper_id").orderBy("page", "line_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kept", F.max((F.col("line") != F.coalesce("doc_title", F.lit(""))).cast("int")).over(so_far)).where("kept = 1")
    rows = rows.withColumn("head", is_heading(F.col("line")).cast("int")).withColumn("n", F.sum("head").over(so_far))
    grouped = rows.groupBy("doc_idx", "paper_id", "n").agg(
        F.max(F.when(F.col("head") == 1, clean_heading(F.col("line")))).alias("title"),
        F.min("page").alias("page"),
        F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("page", "line_idx", "line")))).alias("ls"),
    )
    text = strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    out = grouped.select("doc_idx", "paper_id", F.col("n").cast("int").alias("section_idx"), F.coalesce(F.nullif("title", F.lit("")), F.lit("문서")).alias("title"), text.alias("text"), "page").where("text <> ''")
    whole = pages.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy("doc_idx", "paper_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"))
    rest = whole.join(out.select("doc_idx").distinct(), "doc_idx", "left_anti").select(
        "doc_idx", "paper_id", F.lit(0).alias("section_idx"), F.lit("문서").alias("title"), strip(F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n")).alias("text"), F.lit(None).cast("int").alias("page")
    )
    return out.unionByName(rest)


def page_titles(pages: DataFrame) -> DataFrame:
    """(doc_idx, title): the first line that is no page number, at most 160 characters."""
    line = F.posexplode(F.transform(lines(F.col("text")), strip)).alias("line_idx", "line")
    rows = pages.select("doc_idx", "page", line).where((F.col("line") != "") & ~is_page_number(F.col("line")))
    return rows.groupBy("doc_idx").agg(F.substring(F.min_by("line", F.struct("page", "line_idx")), 1, 160).alias("title"))
