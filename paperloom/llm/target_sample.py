"""Problem 6: a sample whose categories have given shares.

One pass keeps a reservoir for each category: every id draws a fixed priority from its
hash, and a reservoir holds the lowest priorities it has seen, as many as the category
can be asked for at most, with the number of ids seen in each stripe of the priority
range. Reservoirs of tasks merge by union and by adding their counts. After the
final counts the merged reservoir is trimmed to its quota: whole stripes, then the lowest
priorities of the stripe in which the quota ends. So each row of a category has the
same chance, the result doesn't depend on tasks, and a category with any share of
the rows is spread over all of them. Report and found are read from the reservoirs' counts.

Quota: the larger of ``min_rows`` and the share of the sample size (a fifth of all
different ids), rounded up; a category with fewer rows gives all and is reported.
A reservoir's bound is the same quota with the number of delivered rows for that of ids.
Buckets compare without case and outer blanks; a null bucket is in no category. Rows
delivered twice count once. A category without rows is reported as exhausted with 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STRIPES, folded, materialize, table

SEED = 13
#: The sample is this part of all ids.
PART = 5
_BITS = 60  # of a priority


def priority(key: Column) -> Column:
    """The first 60 bits of a SHA-256 of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}|"), key), 256), 1, _BITS // 4), 16, 10).cast("long")


def reservoirs(rows: DataFrame, capacity: dict[tuple[str, str], int]) -> DataFrame:
    """rows(id, ds, bucket), capacity by (ds, bucket): merged reservoirs as a written table,
    (cat, stripe, seen, id, p). Rows with ``seen`` are counts, cat -1 is that of all
    other rows; the others are the ids kept. cat is the place in ``capacity``."""
    caps = np.array([*capacity.values(), 0], np.int64)
    names = rows.sparkSession.createDataFrame([(d, b, i) for i, (d, b) in enumerate(capacity)], "ds string, bucket string, cat int")
    once = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("ds", "bucket")).alias("c")).select("id", "c.ds", "c.bucket")
    drawn = once.join(F.broadcast(names), ["ds", "bucket"], "left").select(F.coalesce("cat", F.lit(-1)).alias("cat"), priority(F.col("id")).alias("p"), "id")
    shift = _BITS - (STRIPES - 1).bit_length()

    def low(cat: int, p: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
        if len(p) <= caps[cat]:
            return p, ids
        keep = np.flatnonzero(p <= np.partition(p, caps[cat] - 1)[caps[cat] - 1])  # ties stay
        return p[keep], ids.take(pa.array(keep))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(caps), STRIPES), np.int64)
        held: dict[int, tuple[np.ndarray, pa.Array]] = {}
        for rb in batches:
            cat, p = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(counts, (cat, p >> shift), 1)
            for c in np.unique(cat[cat >= 0]).tolist():
                at = np.flatnonzero(cat == c)
                new_p, new_id = p[at], rb.column(2).take(pa.array(at))
                if c in held:
                    new_p, new_id = np.concatenate([held[c][0], new_p]), pa.concat_arrays([held[c][1], new_id])
                held[c] = low(c, new_p, new_id) if len(new_p) > 2 * caps[c] else (new_p, new_id)
        cat, stripe = np.nonzero(counts)
        yield _batch(np.where(cat == len(caps) - 1, -1, cat), stripe, counts[cat, stripe], pa.nulls(len(cat), pa.string()), None)
        for c, (p, ids) in held.items():
            p, ids = low(c, p, ids)
            yield _batch(np.full(len(p), c), p >> shift, None, ids, p)

    return materialize(drawn.mapInArrow(fill, "cat int, stripe int, seen long, id string, p long"))


def _batch(cat, stripe, seen, ids, p) -> pa.RecordBatch:
    whole = lambda x: pa.nulls(len(cat), pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(cat, pa.int32()), pa.array(stripe, pa.int32()), whole(seen), ids, whole(p)], ["cat", "stripe", "seen", "id", "p"])


def _wanted(permille: int, least: int, n: int) -> int:
    return max(least, -(-permille * (n // PART) // 1000))


def trimmed(held: DataFrame, take: list[int]) -> DataFrame:
    """The ids (cat, id) of lowest priority, ``take[cat]`` of each category."""
    spark = held.sparkSession
    quota = spark.createDataFrame(list(enumerate(take)), "cat int, take long")
    counts = held.where("seen is not null and cat >= 0").groupBy("cat", "stripe").agg(F.sum("seen").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cat").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most a row for each stripe of each target
    cut = F.broadcast(counts.join(F.broadcast(quota), "cat").withColumn("left", F.col("take") - before).where("left > 0").select("cat", "stripe", "n", "left"))
    rows = held.where("id is not null").select("cat", "stripe", "id", "p").join(cut, ["cat", "stripe"])
    rank = F.row_number().over(Window.partitionBy("cat", "stripe").orderBy("p", "id"))
    last = rows.where("n > left").withColumn("r", rank).where("r <= left")
    return rows.where("n <= left").select("cat", "id").unionByName(last.select("cat", "id"))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """The given categories: as many rows as somebody wrote by hand."""
    t = table(spark, sf_dir, "sampling_targets").select("source_dataset", "target_bucket", folded(F.col("target_bucket")), "target_permille", "min_rows")
    return [tuple(r) for r in t.collect()]


def sample(rows: DataFrame, targets: list[tuple]) -> tuple[DataFrame, list[tuple], dict[tuple[str, str], int]]:
    """rows(id, ds, bucket), targets(ds, spelled bucket, bucket, permille, least): the reservoirs,
    (ds, spelled bucket, available, wanted) for each target, and takes by category."""
    delivered = rows.count()
    capacity: dict[tuple[str, str], int] = {}
    for ds, _, bucket, permille, least in targets:
        capacity[ds, bucket] = max(1, capacity.get((ds, bucket), 0), _wanted(permille, least, delivered))
    held = reservoirs(rows, capacity)
    seen = {r[0]: r[1] for r in held.groupBy("cat").agg(F.sum("seen")).collect()}  # a row for each target
    n = sum(v or 0 for v in seen.values())
    number = {k: i for i, k in enumerate(capacity)}
    report = [(ds, spelled, seen.get(number[ds, bucket]) or 0, _wanted(permille, least, n)) for ds, spelled, bucket, permille, least in targets]
    take = dict.fromkeys(capacity, 0)
    for (ds, _, bucket, _, _), (_, _, available, wanted) in zip(targets, report):
        take[ds, bucket] = max(take[ds, bucket], min(available, wanted))
    return held, report, take


def _sampled(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("id"), F.col("source_dataset").alias("ds"), folded(F.col("target_bucket")).alias("bucket"))
    return sample(rows, _targets(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report, _ = _sampled(spark, sf_dir)
    rows = [(ds, bucket, a, w, min(a, w), a < w) for ds, bucket, a, w in report]
    return spark.createDataFrame(rows, "source_dataset string, target_bucket string, available long, wanted long, take long, exhausted boolean")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_report(spark, sf_dir).where("exhausted").select("source_dataset", "target_bucket")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _, take = _sampled(spark, sf_dir)
    names = spark.createDataFrame([(i, d, b) for i, (d, b) in enumerate(take)], "cat int, source_dataset string, target_bucket string")
    return trimmed(held, list(take.values())).join(F.broadcast(names), "cat").select(F.col("id").alias("candidate_id"), "source_dataset", "target_bucket")


_REPORT = """
with c as (select candidate_id, min(source_dataset) as ds, min(lower(trim(target_bucket))) as b from candidates where candidate_id is not null group by 1),
n as (select count(*) // 5 as n from c),
h as (select ds, b, count(*) as available from c where b is not null group by 1, 2),
q as (select t.source_dataset, t.target_bucket, coalesce(h.available, 0) as available,
  greatest(cast(t.min_rows as bigint), (cast(t.target_permille as bigint) * (select n from n) + 999) // 1000) as wanted
  from sampling_targets t left join h on h.ds = t.source_dataset and h.b = lower(trim(t.target_bucket)))"""
QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_sample": p6_sample}
SQL = {
    "p6_found": _REPORT + " select source_dataset, target_bucket from q where available < wanted",
    "p6_report": _REPORT + " select source_dataset, target_bucket, available, wanted, least(available, wanted) as take, available < wanted as exhausted from q",
    "p6_sample": _REPORT
    + """, r as (select *, row_number() over (partition by ds, b order by substr(sha256('13|' || candidate_id), 1, 15), candidate_id) as r from c)
select r.candidate_id, r.ds as source_dataset, r.b as target_bucket from r join q on q.source_dataset = r.ds and lower(trim(q.target_bucket)) = r.b where r <= least(available, wanted)""",
}
