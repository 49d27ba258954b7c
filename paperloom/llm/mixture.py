"""Problem 9: mixing sources to target weights.

The size of all documents is the total; each source's budget is its share of it. A
source is repeated whole as often as the budget holds it; the rest is fitted:

* documents above ``LONG`` tokens are taken in a seeded order up to their part of the
  rest, by sums over ranges of that order, so that none of them reaches the driver;
* the others are counted by exact token length, at most ``LONG`` rows for each source.
  Lengths are taken in proportion to their counts, then from long to short, at last
  by a bounded-knapsack dynamic program over the remaining tokens, of fixed memory.

Documents of each length are then drawn by a seeded hash.

Sources compare without case and outer blanks; null sources and sources without a
target count towards the total only. Where the cap on repeats keeps a source below
its budget, all is used as often as allowed and the source is reported as short; the
report also has the largest total at which every share could hold. A document
delivered twice counts once; one of 0 tokens is used with the whole source.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded, materialize, running_total, table, take_exactly
from .tokens import VOCABULARY, sized

SEED = 17
#: Longest document that is counted by length; the dynamic program spans four times as much.
LONG = 1 << 14


def fitted(lots: list[tuple[int, int]], rest: int) -> list[int]:
    """Lots (length, documents) whose sizes sum to the greatest total up to ``rest``.

    For each total only the lot by which it was first reached is kept: what is left
    without that lot was reached by an earlier one, so no lot is taken twice.
    """
    first = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    for i, (n, k) in enumerate(lots):
        if reached[rest]:
            break
        w = n * k
        if w <= rest:
            new = reached[: rest + 1 - w] & ~reached[w:]
            first[w:][new] = i
            reached[w:] |= new
    left, taken = int(np.flatnonzero(reached)[-1]), []
    while left:
        i = int(first[left])
        taken.append(i)
        left -= lots[i][0] * lots[i][1]
    return taken


def subset_sum(counts: dict[int, int], budget: int, seed: int = SEED) -> dict[int, int]:
    """Documents to take of each length, their sum as near below the budget as found;
    exact for budgets up to four times the longest length."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    whole = sum(n * c for n, c in counts.items())
    if budget >= whole:
        return counts
    most = 4 * max(counts)
    take = dict.fromkeys(counts, 0)
    rest = max(budget, 0)
    if rest > most:
        take = {n: c * (rest - most) // whole for n, c in counts.items()}
        rest -= sum(n * k for n, k in take.items())
    for n in sorted(counts, reverse=True):
        if rest <= most:
            break
        k = min(counts[n] - take[n], (rest - most) // n + 1, rest // n)
        take[n] += k
        rest -= n * k
    lots = []
    for n in counts:
        spare, size = min(counts[n] - take[n], rest // n), 1
        while spare > 0:
            size = min(size, spare)
            lots.append((n, size))
            spare -= size
            size *= 2
    random.Random(seed).shuffle(lots)
    lots.sort(key=lambda x: x[1])
    for i in fitted(lots, rest):
        take[lots[i][0]] += lots[i][1]
    return take


def _long_part(docs: DataFrame, budgets: dict[str, int]) -> tuple[DataFrame | None, dict[str, int]]:
    """Of each source's documents above ``LONG`` those that fit its budget in seeded order,
    and their sums. A source's order is summed over ranges, never in one task."""
    if not any(budgets.values()):
        return None, {}
    rows = docs.where((F.col("tokens") > LONG) & F.col("source").isin([k for k, v in budgets.items() if v]))
    placed = running_total(rows.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")), ["source", "h", "doc_id"], "tokens", "start")
    room = F.lit(0)  # to the end of each source's budget
    for r in placed.groupBy("source").agg(F.min("start")).collect():  # a row for each target
        room = F.when(F.col("source") == r[0], r[1] + budgets[r[0]]).otherwise(room)
    got = materialize(placed.where(F.col("start") + F.col("tokens") <= room).select("doc_id", "source", "tokens"))
    return got, {r[0]: r[1] for r in got.groupBy("source").agg(F.sum("tokens")).collect()}


def plan(docs: DataFrame, targets: list[tuple[str, int, int]]) -> tuple[list[tuple], dict[tuple[str, int], int], DataFrame | None]:
    """docs(doc_id, source, tokens); targets (source, permille, most repeats): per source
    (source, budget, size, whole copies, reached, short), takes by (source, length), and
    the long documents taken."""
    hist: dict[str | None, dict[int, int]] = {}
    long_size: dict[str, int] = {}
    wanted = docs.where(F.col("source").isin([t[0] for t in targets]))
    length = F.when(F.col("tokens") <= LONG, F.col("tokens")).otherwise(-1)
    for r in wanted.groupBy("source", length.alias("n")).agg(F.count("*").alias("c"), F.sum("tokens").alias("s")).collect():
        if r["n"] < 0:
            long_size[r["source"]] = r["s"]
        else:
            hist.setdefault(r["source"], {})[r["n"]] = r["c"]
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    rests, rows, long_budget = {}, [], {}
    for source, permille, most in targets:
        few = sum(n * c for n, c in hist.get(source, {}).items())
        size, budget = few + long_size.get(source, 0), total * permille // 1000
        short = most * size * 1000 < total * permille
        copies = most if short or not size else min(most, budget // size)
        rest = budget - copies * size if copies < most else 0
        rests[source] = rest
        if rest and long_size.get(source):
            long_budget[source] = max(rest * long_size[source] // size, rest - few)
        rows.append((source, budget, size, copies, copies * size, short))
    got, sums = _long_part(wanted, long_budget)
    takes: dict[tuple[str, int], int] = {}
    for i, (source, budget, size, copies, reached, short) in enumerate(rows):
        rest = rests[source] - sums.get(source, 0)
        take = {n: k for n, k in subset_sum(hist.get(source, {}), rest).items() if k} if rest > 0 else {}
        takes |= {(source, n): k for n, k in take.items()}
        rows[i] = (source, budget, size, copies, reached + sums.get(source, 0) + sum(n * k for n, k in take.items()), short)
    return rows, takes, got


def _planned(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY):
    docs = table(spark, sf_dir, "documents").select("doc_id", folded(F.col("source")).alias("source"), "text")
    docs = materialize(sized(docs, "doc_id", vocabulary))
    named = [(r[0], r[1], r[2]) for r in table(spark, sf_dir, "mix_targets").select("source", "target_permille", "max_repeats").collect()]
    rows, takes, long = plan(docs, [(s.strip().lower(), p, m) for s, p, m in named])
    rows = [(n[0], *r, n[2] * r[2] * 1000 // n[1] if n[1] else None) for n, r in zip(named, rows)]
    return docs, rows, takes, long


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its target, the size reached, and whether the cap on repeats keeps it short.
    ``feasible_total``: the largest total size at which every source could give its share."""
    _, rows, _, _ = _planned(spark, sf_dir)
    whole = sum(r[5] for r in rows) or 1
    feasible = min((r[7] for r in rows if r[7] is not None), default=0)
    out = [(r[0], r[2], r[3], r[4], r[5], r[5] * 1000 / whole, r[6], feasible) for r in rows]
    return spark.createDataFrame(out, "source string, target_tokens long, source_tokens long, whole_copies long, reached_tokens long, reached_permille double, short boolean, feasible_total long")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_report(spark, sf_dir).where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents used, and how often."""
    docs, rows, takes, long = _planned(spark, sf_dir)
    quota = spark.createDataFrame([(s, n, k) for (s, n), k in takes.items()], "source string, tokens long, take long")
    extra = take_exactly(docs.where("source is not null"), ["source", "tokens"], quota, F.xxhash64(F.lit(SEED), "doc_id")).select("doc_id", "source", "tokens")
    if long is not None:
        extra = extra.unionByName(long)
    whole = spark.createDataFrame([(r[1], r[4]) for r in rows if r[4]], "source string, copies long")
    # one row for each target
    used = docs.join(F.broadcast(whole), "source").unionByName(extra.withColumn("copies", F.lit(1).cast("long")))
    return used.groupBy("doc_id").agg(F.min("source").alias("source"), F.min("tokens").alias("tokens"), F.sum("copies").alias("copies"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the mix by source, all to be 0: documents used more often than allowed, and
    documents of another source."""
    mix = p9_mix(spark, sf_dir)
    own = table(spark, sf_dir, "documents").select("doc_id", folded(F.col("source")).alias("own")).distinct()
    t = table(spark, sf_dir, "mix_targets").select("source", F.lower(F.trim("source")).alias("own"), "max_repeats")
    used = t.join(mix.select("doc_id", F.col("source").alias("own"), "copies"), "own", "left")
    over = used.groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"))
    foreign = mix.join(own, "doc_id").where(F.col("own").isNull() | (F.col("own") != F.col("source"))).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    return over.join(foreign, F.lower("source") == F.col("s"), "left").select("source", "too_often", F.coalesce("n", F.lit(0)).alias("foreign_documents"))


QUERIES = {"p9_found": p9_found, "p9_report": p9_report, "p9_mix": p9_mix, "p9_check": p9_check}
SQL: dict[str, str] = {"p9_check": "select source, cast(0 as bigint) as too_often, cast(0 as bigint) as foreign_documents from mix_targets"}
