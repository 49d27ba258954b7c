"""Problem 2: passages of the evaluation splits that also stand in the train split.

Two texts overlap when their longest common subsequence of words (upper case,
runs of letters and digits) has at least four fifths of the longer text's words.

Exact join. With lengths a, b and a common subsequence of L words there are at
least t = 3L - a - b - 1 pairs of neighbouring words matched to neighbouring words:
L words in order make L - 1 steps, and each of the a + b - 2L unmatched words breaks
one at most. So the two texts share t two-word shingles, the k-th occurrence of one
counted as another than its first. Three things follow in any common order of shingles:

* The rarest shared one is among the p - t + 1 rarest of either text's p shingles that
  both sides have. If it is rare (``FEW``), the texts meet on it.
* Else all t shared ones are frequent. A text of f frequent shingles holds the m <= t
  rarest shared ones among its f - t + m rarest. Dealt out to g groups by their hash,
  these make at least m - g pairs within groups: the texts meet on as many pairs of
  shingles. Two frequent shingles seldom meet by chance where one does all the time, many
  pairs hardly ever; and a text of n words has some n pairs, for g goes with n.
* m and g must be the same for both texts, so they are those of the longer one's range of
  lengths (``_scheme``). A text that may be the shorter one of a pair in the next range has
  pairs of that range too.

A pair must also pass two exact filters in the join condition: length ratio and a parity
bitmap of the words, whose differing bits can't outnumber the unmatched words.
Survivors are verified by a bit-parallel longest common subsequence.

The order of rarity comes from a hashed count of bounded size; any common order is
exact, a finer one only gives fewer pairs. Equal texts are first united in a class;
classes are joined, so a text copied into a third of all rows is joined once.

Null and empty texts overlap nothing. Null splits belong to neither side. Rows
delivered twice count once. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alike, folded, materialize, spread, table
from .sketch import hashed_counts

#: The sketch of rarity has eight counters for each different text, within these bounds
#: (a broadcast of 4 to 64 MB); its size changes no result.
LEAST_BITS, MOST_BITS = 20, 24
LANES = 4  # 64-bit words of the parity bitmap
#: A shingle is rare if an entry of it meets no more than so many of the other side, on
#: average over both sides. Changes no result: more mean more pairs, fewer more entries.
FEW = 64
#: Two texts below this length meet on any shared shingle: they may share a single one.
ALONE = 8
#: Above so many different texts, ranges of lengths (powers of two) are joined one after the
#: other, with the shuffled entries and pairs of one on disk at a time. Changes no result.
WHOLE = 1 << 18
RANGES = ((0, 5), (6, 6), (7, 7), (8, 62))


@lru_cache(1 << 16)
def least_shared(a: int) -> int:
    """Least number of matched two-word shingles of a text of a words with any
    partner it may overlap with."""
    top = a * 5 // 4
    return min(3 * -(-4 * max(a, b) // 5) - a - b - 1 for b in {*range(-(-4 * a // 5), min(top, a) + 1)[-6:], *range(a, min(top, a + 6) + 1)})


@lru_cache(1 << 16)
def _scheme(n: int, up: int) -> tuple[int, int, int, int]:
    """For a text of n words whose partner is not longer (up = 0: or is longer, but of the
    same power of two), or is in the next one (up = 1): number of the range of lengths, number
    of groups (0: no such partner), how many frequent shingles are shared at least and on how
    many pairs of shingles the texts meet at least."""
    k = n.bit_length() - 1 + up
    first, last = 1 << k, (2 << k) - 1  # lengths of the longer text

    def shared(a: int) -> int:
        # 3L - a - b - 1 falls with the shorter length and rises with the longer one but for rounding, by fives
        return min((3 * -(-4 * m // 5) - m - a - 1 for m in range(max(a, first), min(last, a * 5 // 4, max(a, first) + 6) + 1)), default=0)

    t = shared(n)
    if first < ALONE or t <= 0:
        return k, 0, 0, 0
    least = min(x for x in map(shared, range(-(-4 * first // 5), first + 7)) if x > 0)
    groups = max(1, least // 2)
    return k, groups, t, max(1, least // 8)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, 64 and more cells at a time."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of words with one blank between: word hashes, lengths, hashes of
    neighbouring words and the number of the text of each of those."""
    flat, lengths = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts.to_pylist()):
        w = t.split(" ")
        flat += w
        lengths[i] = len(w)
    h = pd.util.hash_array(np.array(flat, object), categorize=True) if flat else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[1:] == owner[:-1]
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside]
    two ^= two >> np.uint64(29)
    return h, lengths, two, owner[:-1][inside]


def _slots(bits: int):
    def slots(rb: pa.RecordBatch) -> list[np.ndarray]:
        _, _, two, owner = _shingles(rb.column("words"))
        slot = (two & np.uint64((1 << bits) - 1)).astype(np.int64)
        train = rb.column("train").to_numpy(zero_copy_only=False)[owner]
        held = rb.column("held").to_numpy(zero_copy_only=False)[owner]
        return [slot[train], slot[held]]

    return slots


_ENTRY = "no long, meet long, n int, need int, " + ", ".join(f"p{i} long" for i in range(LANES))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = (out * np.uint64(0x9E3779B97F4A7C15)) + x
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _among(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted owners: how many each text has, and the place of each among its text's."""
    count = np.bincount(owner, minlength=texts)
    return count, np.arange(len(owner)) - (np.cumsum(count) - count)[owner]


def _keys(texts: pa.Array, rank: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys on which texts meet whose longer one is in the ranges low to high: the text of
    each, the key and how many of such keys an overlapping pair has at least, below 0 if
    the text can't be the longer one; and of the texts the word counts and parity bitmaps."""
    h, lengths, two, owner = _shingles(texts)
    parity = np.zeros((len(lengths), LANES), np.uint64)
    lane = ((h >> np.uint64(6)) % np.uint64(LANES)).astype(np.int64)
    np.bitwise_xor.at(parity, (np.repeat(np.arange(len(lengths)), lengths), lane), np.uint64(1) << (h & np.uint64(63)))
    r = rank[(two & np.uint64(len(rank) - 1)).astype(np.int64)]
    there = np.flatnonzero(r > 0)
    order = there[np.lexsort((two[there], r[there], owner[there]))]
    o, two, r = owner[order], two[order], r[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (two[1:] != two[:-1])
    at = np.arange(len(o))
    token = _mixed(two, (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64))
    count, among = _among(o, len(lengths))
    rare = r <= FEW
    alone = (rare | (lengths < ALONE)[o]) & (among < (count - np.array([least_shared(int(n)) for n in lengths], np.int64) + 1)[o])
    found = [(o[alone], token[alone], np.where(lengths[o[alone]] >> low, 1, -1))]
    o, token = o[~rare], token[~rare]
    count, among = _among(o, len(lengths))
    for up in (0, 1):
        band, groups, t, need = np.array([_scheme(int(n), up) for n in lengths], np.int64).reshape(-1, 4).T
        pick = (among < (count - t + groups + need)[o]) & ((groups > 0) & (count >= t) & (band >= low) & (band <= high))[o]
        po, q = o[pick], token[pick]
        g = (q >> np.uint64(20)) % np.maximum(groups, 1)[po].astype(np.uint64)
        order = np.lexsort((q, g, po))
        po, q, g = po[order], q[order], g[order]
        first = np.ones(len(po), bool)
        first[1:] = (po[1:] != po[:-1]) | (g[1:] != g[:-1])
        run = np.cumsum(first) - 1
        i, step = np.arange(len(po)), 1
        while len(i := i[i + step < len(po)]) and len(i := i[run[i] == run[i + step]]):
            found.append((po[i], _mixed(q[i], q[i + step], band[po[i]].astype(np.uint64)), -need[po[i]] if up else need[po[i]]))
            step += 1
    return *(np.concatenate(x) for x in zip(*found)), lengths, parity


def _prefixes(weight, low: int = 0, high: int = 62):
    """weight: broadcast; of each slot how many of the other side an entry meets, 0 where it
    has no text on one side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                o, key, need, lengths, parity = _keys(rb.column("words"), weight.value, low, high)
                cols = [rb.column("no").to_numpy(zero_copy_only=False)[o], key.view(np.int64), lengths[o].astype(np.int32), need.astype(np.int32)]
                cols += [parity[o, i].view(np.int64) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["no", "meet", "n", "need", *(f"p{i}" for i in range(LANES))])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        ok = []
        for a, b in zip(rb.column("wa").to_pylist(), rb.column("wb").to_pylist()):
            a, b = a.split(" "), b.split(" ")
            least = -(-4 * max(len(a), len(b)) // 5)
            # words that stand in the other anywhere are counted first: cheaper, and settles most
            ok.append(sum(map(set(a).__contains__, b)) >= least and sum(map(set(b).__contains__, a)) >= least and lcs(a, b) >= least)
        yield rb.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _stage(df: DataFrame) -> DataFrame:
    """A stage whose shuffle files are deleted as soon as it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _near(classes: DataFrame, weight, low: int, high: int) -> DataFrame:
    """(a, b) of the overlapping pairs whose longer text is in the ranges low to high."""
    n = F.size(F.split("words", " "))
    part = classes.where((5 * n >= 4 << low) & (n < 2 << high)) if high < 30 else classes.where(5 * n >= 4 << low)
    t, e = (part.where(side).select("no", "words").mapInArrow(_prefixes(weight, low, high), _ENTRY) for side in ("train", "held"))
    e = e.select(*[F.col(c).alias(f"e_{c}") for c in e.columns])
    longer, shorter = F.greatest("n", "e_n"), F.least("n", "e_n")
    least = F.ceil(longer * 4 / 5).cast("int")
    apart = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"e_p{i}"))) for i in range(LANES)), F.lit(0))
    met = t.join(
        e,
        (F.col("meet") == F.col("e_meet"))
        & (F.col("no") != F.col("e_no"))
        & ((F.col("need") > 0) | (F.col("e_need") > 0))
        & (5 * shorter >= 4 * longer)
        & (apart <= F.col("n") + F.col("e_n") - 2 * least),
    )
    pairs = met.groupBy(F.col("no").alias("a"), F.col("e_no").alias("b")).agg(F.count("*").alias("met"), F.min(F.greatest("need", "e_need")).alias("need"))
    pairs = _stage(pairs.where("met >= need").select("a", "b"))
    words = classes.select("no", "words")
    texts = pairs.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return _stage(texts.select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long"))


def overlapping_classes(classes: DataFrame) -> DataFrame:
    """classes(no, words, train, held), words with one blank between: (a, b) of the
    overlapping pairs of a class with train texts and another with held-out texts."""
    spark = classes.sparkSession
    total = classes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * total).bit_length()))
    train, held = hashed_counts(classes.select("words", "train", "held"), _slots(bits), 2, bits)
    # float32 keeps the order well enough; the array's size is bounded by MOST_BITS.
    weight = spark.sparkContext.broadcast((train.astype(float) * held / np.maximum(train + held, 1)).astype(np.float32))
    near = [_near(classes, weight, *r) for r in (RANGES if total > WHOLE else [(0, 62)])]
    return reduce(DataFrame.unionByName, near).distinct()


def split_overlap(passages: DataFrame) -> DataFrame:
    """passages(key, train BOOLEAN, text): (train_key, held_key) of all overlaps."""
    words = F.array_join(F.regexp_extract_all(F.upper("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    rows = _stage(passages.select("key", "train", words.alias("words")).where("words <> ''").withColumn("h", F.unhex(F.sha2("words", 256))))
    classes = _stage(
        rows.groupBy("h")
        .agg(F.first("words").alias("words"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
        .withColumn("no", F.monotonically_increasing_id())
    )
    near = overlapping_classes(classes.select("no", "words", "train", "held"))
    same = classes.where("train and held").select(F.col("no").alias("a"), F.col("no").alias("b"))
    member = rows.select("h", "train", "key").distinct().join(classes.select("h", "no"), "h")
    return (
        near.unionByName(same)
        .join(member.where("train").select(F.col("no").alias("a"), F.col("key").alias("train_key")), "a")
        .join(member.where("not train").select(F.col("no").alias("b"), F.col("key").alias("held_key")), "b")
        .select("train_key", "held_key")
        .distinct()
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, train, text, split, source_dataset): chunks of any non-null split, and
    candidates whose chunk is in another split than train."""
    chunks = table(spark, sf_dir, "chunks").withColumn("split", folded(F.col("split"))).where("split is not null")
    own = spread(chunks).select(F.col("chunk_id").alias("key"), (F.col("split") == "train").alias("train"), "text", "split", "source_dataset")
    held = chunks.where("split <> 'train'").select(alike(F.col("chunk_id")).alias("ck"), "split").where("ck <> ''").distinct()
    of = (
        table(spark, sf_dir, "candidates")
        .where("chunk_text is not null")
        .select("candidate_id", alike(F.col("chunk_id")).alias("ck"), "chunk_text", "source_dataset")
        .where("ck <> ''")
        .join(held, "ck")
        .select(F.col("candidate_id").alias("key"), F.lit(False).alias("train"), F.col("chunk_text").alias("text"), "split", "source_dataset")
    )
    return own.unionByName(of)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap(passages(spark, sf_dir)).select(F.least("train_key", "held_key").alias("key_a"), F.greatest("train_key", "held_key").alias("key_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: evaluation passages, and how many overlap a train chunk."""
    p = passages(spark, sf_dir)
    hit = split_overlap(p).select(F.col("held_key").alias("key")).distinct().withColumn("hit", F.lit(1))
    return (
        p.where("not train").select("key", "split", "source_dataset").distinct().join(hit, "key", "left")
        .groupBy("split", "source_dataset")
        .agg(F.count("*").alias("passages"), F.count("hit").alias("overlapping"))
    )


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL: dict[str, str] = {}
