"""Problem 3: cutting oversized texts at natural boundaries.

Balanced targets: take the least number of pieces the limit allows, place the cuts
for pieces of equal length, and move each to the strongest boundary nearby that
keeps both limits feasible. A cut moved shifts the targets of those after it. If a cut
finds no boundary, one piece more is planned from there on, which widens the room for
it; where no number helps (no break within the limit), the text is cut at the
target, never between a base and its marks.

A piece starts exactly ``overlap`` characters before the end of the one before it, so
piece 1 and the rest of each later piece give back the text. Outer spaces, tabs
and line breaks are no part of it. Null and short texts give no pieces.
Rows delivered twice (equal key) are cut once. Lengths are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OUTER = " \t\r\n"
#: Boundaries by strength, strongest first; a cut goes after the match.
BOUNDARIES = (
    re.compile(r"\r?\n[ \t]*\r?\n\s*|\r[ \t]*\r\s*"),
    re.compile(r"[\r\n]+"),
    re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+"),
    re.compile(r"[;:]\s+|[,)\]–—]\s+"),
    re.compile(r"\s+"),
)
_JOINED = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︀-️︠-︯‍ᅠ-ᇿ\n]")


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces, in time proportional to the text."""
    size, step = len(text), limit - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the limit")
    found = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES] if size > limit else []
    ends: list[int] = []
    before = overlap  # where the last piece ended; the first one gives nothing twice
    left = -(-(size - overlap) // step)  # pieces still to come, this one included
    while left > 1:
        each = (size - before) / left  # new characters of each piece that is left
        target = before + round(each)
        high = min(before + step, size - 1)
        low = max(before + 1, size - (left - 1) * step)
        room = max(1, int(each) // 4)
        pick = _nearest(found, max(low, target - room), min(high, target + room), target)
        if pick is None:
            pick = _nearest(found, low, high, target)
        if pick is None and low > before + 1 and _nearest(found, before + 1, high, target) is not None:
            left += 1  # a boundary can be met only with one piece more
            continue
        if pick is None:  # no boundary within reach of any number of pieces
            pick = min(max(target, low), high)
            while pick > low and _JOINED.match(text[pick]):
                pick -= 1
        ends.append(pick)
        before, left = pick, left - 1
    return [*ends, size]


def _nearest(found: list[list[int]], low: int, high: int, target: int) -> int | None:
    """The boundary nearest to the target among the strongest ones from low to high."""
    for at in found:
        k = bisect_left(at, target)
        near = [x for x in at[max(0, k - 1) : k + 1] if low <= x <= high]
        if near:
            return min(near, key=lambda x: (abs(x - target), x))
        if low > target or high < target:
            k = bisect_left(at, low)
            if k < len(at) and at[k] <= high:
                return at[k] if low > target else at[bisect_right(at, high) - 1]
    return None


def split_pieces(texts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """texts(record_table, record_id, text): the pieces of those above the limit,
    (record_table, record_id, piece, pieces, start, length, text)."""
    schema = "record_table string, record_id string, piece int, pieces int, start int, length int, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows: list[tuple] = []
            for t, i, text in zip(*(c.to_pylist() for c in rb.columns)):
                ends = cuts(text, limit, overlap)
                begin = 0
                for k, end in enumerate(ends):
                    rows.append((t, i, k, len(ends), begin, end - begin, text[begin:end]))
                    begin = end - overlap
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])

    stripped: Column = F.expr(r"trim(BOTH ' \t\r\n' FROM text)")
    big = texts.select("record_table", "record_id", stripped.alias("text")).where(F.length("text") > limit)
    return big.dropDuplicates(["record_table", "record_id"]).mapInArrow(cut, schema)


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The few named limits of size_limits."""
    return {r[0]: r[1] for r in table(spark, sf_dir, "size_limits").select("limit_name", "limit_value").collect()}


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = limits(spark, sf_dir)
    both = (
        table(spark, sf_dir, "sections").select(F.lit("sections").alias("record_table"), F.col("section_id").alias("record_id"), "text")
    ).unionByName(table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("record_id"), "text"))
    return split_pieces(both, lim["piece_max"], lim["piece_overlap"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece = 0").select("record_table", "record_id")


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text above the limit its trimmed length and its text put together again from the
    pieces, by a hash; too long pieces and wrong overlaps are to be 0."""
    lim = limits(spark, sf_dir)
    p = p3_pieces(spark, sf_dir)
    new = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.expr(f"substring(text, {lim['piece_overlap'] + 1})"))
    after = F.lead("text").over(Window.partitionBy("record_table", "record_id").orderBy("piece"))
    n = lim["piece_overlap"]
    p = p.withColumn("new", new).withColumn("wrong", after.isNotNull() & (F.expr(f"right(text, {n})") != F.substring(after, 1, n)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "")
    out = p.groupBy("record_table", "record_id").agg(F.md5(whole).alias("text_md5"), F.count_if(F.col("length") > lim["piece_max"]).alias("too_long"), F.count_if("wrong").alias("wrong_overlaps"))
    return out.select("record_table", "record_id", "text_md5", "too_long", "wrong_overlaps")


_TRIMMED = "trim(text, chr(32) || chr(9) || chr(13) || chr(10))"
_MAX = "(select limit_value from size_limits where limit_name = 'piece_max')"
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_check": p3_check}
SQL = {
    "p3_found": f"""
select distinct 'sections' as record_table, section_id as record_id from sections where length({_TRIMMED}) > {_MAX}
union all
select distinct 'chunks', chunk_id from chunks where length({_TRIMMED}) > {_MAX}""",
    "p3_check": f"""
with b as (select 'sections' as record_table, section_id as record_id, {_TRIMMED} as text from sections union all select 'chunks', chunk_id, {_TRIMMED} from chunks)
select record_table, record_id, md5(min(text)) as text_md5, cast(0 as bigint) as too_long, cast(0 as bigint) as wrong_overlaps from b where length(text) > {_MAX} group by 1, 2""",
}
