"""Problem 8: filling containers of fixed capacity.

Items are spread over groups by hash; each group is packed best-fit decreasing. Lower
bounds from dual-feasible functions certify the containers of each group and of all
items together (from the histogram of sizes, at most capacity + 1 rows). While there is
a gap to the bound of all, containers that are not full are exchanged: those of groups
with a gap, and those of certified groups too, since a group can lack small items that
another has. Their documents are mixed into new, fewer groups and packed again. A round
that closes less than a hundredth of the gap is the last, and one that closes none is
undone. The report has the bound and the gap that is left.

A document above the capacity gives whole containers of its own and one item with the
rest; no other is split. Null and empty texts have size 0 and fit anywhere. A document
delivered twice is packed once.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .pieces import limits
from .tokens import VOCABULARY, sized

GROUP_ITEMS = 50_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, and the room left in each container."""
    order = np.argsort(-sizes, kind="stable")
    at = np.zeros(len(sizes), np.int64)
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: there is a container with r left
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = open_rooms >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        at[i] = b
        room[b] = r - s
        by_room.setdefault(r - s, []).append(b)
        open_rooms |= 1 << (r - s)
    return at, np.array(room, np.int64)


def lower_bound(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """Greatest bound of two families of dual-feasible functions over all parameters."""
    held = size > 0
    size, count = size[held].astype(np.int64), count[held].astype(np.int64)
    if not len(size):
        return 0
    best = -(-int((size * count).sum()) // capacity)
    # Items above capacity - k count whole, items below k not, others as they are.
    for k in np.unique(np.minimum(size, capacity - size)):
        if 0 < k <= capacity // 2:
            whole = int(count[size > capacity - k].sum())
            middle = (size >= k) & (size <= capacity - k)
            best = max(best, whole + -(-int((size * count)[middle].sum()) // capacity))
    # Rounding to multiples of 1 / k.
    for k in range(2, 41):
        x = (k + 1) * size
        scaled = np.where(x % capacity == 0, size * k, x // capacity * capacity)  # times 1 / (k * capacity)
        best = max(best, -(-int((scaled * count).sum()) // (k * capacity)))
    return best


_PACKED = "doc_id long, part int, size long, container string, room long, certified boolean"


def _filled(active: DataFrame, capacity: int, groups: int, turn: int) -> DataFrame:
    """active(doc_id, part, size) packed group by group; ``certified``: the group can't take fewer
    containers."""

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True])
        sizes = pdf["size"].to_numpy()
        at, room = best_fit_decreasing(sizes, capacity)
        u, c = np.unique(sizes, return_counts=True)
        certified = len(room) <= max(1, lower_bound(u, c, capacity))
        names = np.array([f"{turn}-{key[0]}-{b}" for b in range(len(room))], object)
        return pdf.assign(container=names[at], room=room[at], certified=certified)[["doc_id", "part", "size", "container", "room", "certified"]]

    mixed = active.withColumn("g", F.pmod(F.xxhash64("doc_id", "part", F.lit(turn)), F.lit(groups)))
    return materialize(mixed.groupBy("g").applyInPandas(fill, _PACKED))


def bound_of(items: DataFrame, capacity: int) -> int:
    """Lower bound of all items, from the histogram of sizes: at most capacity + 1 rows."""
    hist = items.groupBy("size").agg(F.count("*").alias("n")).collect()
    return lower_bound(np.array([r[0] for r in hist]), np.array([r[1] for r in hist]), capacity)


def pack(items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """items(doc_id, part, size), sizes up to the capacity: with ``container``."""
    columns = ["doc_id", "part", "size", "container"]
    n = items.count()
    groups = max(1, -(-n // group_items))
    packed = _filled(items.select("doc_id", "part", "size"), capacity, groups, 0)
    gap = packed.select("container").distinct().count() - max(1 if n else 0, bound_of(packed, capacity))
    done: DataFrame | None = None
    for turn in count(1):
        whole = F.lit(gap <= 0) | (F.col("room") == 0)
        if groups == 1:  # nobody to exchange with
            whole |= F.col("certified")
        shut, active = packed.where(whole).select(columns), packed.where(~whole)
        done = shut if done is None else done.unionByName(shut)
        n, held = (active.agg(F.count("*"), F.countDistinct("container")).first()) if gap > 0 else (0, 0)
        if held < 2:
            return done.unionByName(active.select(columns))
        # groups of up to twice the size, so that containers of several groups meet
        groups = max(1, n // (2 * group_items))
        again = _filled(active.select("doc_id", "part", "size"), capacity, groups, turn)
        gained = held - again.select("container").distinct().count()
        if gained <= 0:
            return done.unionByName(active.select(columns))
        if 100 * gained < gap:
            return done.unionByName(again.select(columns))
        packed, gap = again, gap - gained
    raise AssertionError


def _items(docs: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Items to pack, and the containers that single documents fill alone."""
    full = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") % capacity
    items = docs.where((rest > 0) | (F.col("tokens") == 0)).select("doc_id", full.alias("part"), rest.alias("size"))
    alone = docs.where(F.col("tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"), F.lit(capacity).cast("long").alias("size"))
    return items, alone.withColumn("container", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("part").cast("string")))


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int]:
    capacity = limits(spark, sf_dir)["container_capacity"]
    docs = materialize(sized(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", vocabulary))
    items, alone = _items(docs, capacity)
    return pack(items, capacity).unionByName(alone), capacity


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's parts (the tokens from part * capacity on) and their containers."""
    packed, capacity = _packed(spark, sf_dir)
    return packed.select("container", "doc_id", "part", (F.col("part").cast("long") * capacity).alias("first_token"), F.col("size").alias("tokens"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the certified lower bound, the gap between them, and the share of room
    filled."""
    packed, capacity = _packed(spark, sf_dir)
    packed = materialize(packed)
    bound = bound_of(packed, capacity)
    used = packed.agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    filled = F.col("tokens") / (F.col("containers") * capacity)
    return used.select("containers", F.lit(bound).cast("long").alias("lower_bound"), (F.col("containers") - bound).alias("gap"), "tokens", filled.alias("filled"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, and faults that are all to be 0: containers above the capacity, parts
    that stand twice, parts of a document that leave out or overlap tokens, and parts of
    divided documents that could have been larger."""
    packed, capacity = _packed(spark, sf_dir)
    packed = materialize(packed)
    full = packed.groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > capacity).alias("overfull"))
    w = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("d"), F.max("part").alias("last"), F.count_if(F.col("size") < capacity).alias("partly"))
    docs = w.agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.col("d")).alias("repeated_parts"), F.count_if(F.col("last") + 1 != F.col("n")).alias("missing_parts"), F.count_if(F.col("partly") > 1).alias("needless_parts"))
    return docs.withColumn("overfull", F.lit(full.first()[0]))


QUERIES = {"p8_containers": p8_containers, "p8_report": p8_report, "p8_check": p8_check}
SQL: dict[str, str] = {
    "p8_check": """select count(distinct doc_id) as documents, cast(0 as bigint) as repeated_parts, cast(0 as bigint) as missing_parts,
cast(0 as bigint) as needless_parts, cast(0 as bigint) as overfull from documents"""
}
