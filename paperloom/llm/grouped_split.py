"""Problem 4: train, validation and test splits that keep tied records together.

Components by random-mate contraction: each round every vertex draws a coin from
a hash; each tail with a head among its neighbours joins one of them; edges are
rewritten, loops and repeats dropped, until none is left. The joins of all rounds are
then unwound together: every label is replaced by its own label, as often as doubling
takes to pass all rounds. Every round is written to the shared folder.

A candidate's vertex is its paper; without one, the first paper of its chunk; without
that the chunk, else the candidate itself. Chunks tie their papers as stars around the
smallest, so a chunk or paper with a third of all rows gives one edge per different
paper only. Blank keys tie nothing. Rows delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alike, materialize, nonblank, running_total, table
from .pieces import limits

MOST_ROUNDS = 200
#: A group with more than one in so many rows is joined by broadcast.
HEAVY = 1000


def components(edges: DataFrame) -> DataFrame:
    """edges(u STRING, v STRING): (vertex, root) of every vertex with an edge to another."""
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    joined: list[DataFrame] = []
    for turn in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        heads = lambda c: F.xxhash64(F.lit(turn), F.col(c)) % 2 == 0  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mate = materialize(both.where(~heads("u") & heads("v")).groupBy("u").agg(F.min("v").alias("to")))
        joined.append(mate)
        left = mate.toDF("u", "ut")
        right = mate.toDF("v", "vt")
        moved = edges.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("ut", "u").alias("x"), F.coalesce("vt", "v").alias("y"))
        edges = materialize(moved.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    else:
        raise RuntimeError("the contraction did not end")
    spark = edges.sparkSession
    if not joined:
        return spark.createDataFrame([], "vertex string, root string")
    # Each vertex was joined to one once; unwinding halves the way to the last of them.
    mates = joined[0]
    for mate in joined[1:]:
        mates = mates.unionByName(mate)
    roots = mates.toDF("vertex", "root")
    for _ in range(len(joined).bit_length()):
        above = roots.toDF("root", "above")
        roots = materialize(roots.join(above, "root", "left").select("vertex", F.coalesce("above", "root").alias("root")))
    tops = roots.select("root").distinct()
    return roots.unionByName(tops.select(F.col("root").alias("vertex"), "root"))


def _vertex(kind: str, of: Column) -> Column:
    return F.concat(F.lit(kind), F.coalesce(F.col("source_dataset"), F.lit("")), F.lit("\x1f"), of)


def _keyed(candidates: DataFrame) -> DataFrame:
    paper = F.when(nonblank(F.col("paper_id")), _vertex("p", F.col("paper_id")))
    chunk = F.nullif(alike(F.col("chunk_id")), F.lit(""))
    return candidates.select("candidate_id", "source_dataset", "paper_id", paper.alias("paper"), _vertex("c", chunk).alias("chunk")).where("candidate_id is not null")


def tied_papers(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed candidates, (chunk, first paper), and components of the papers."""
    keyed = _keyed(candidates)
    links = materialize(keyed.where("paper is not null and chunk is not null").select("chunk", "paper").distinct())
    first = links.groupBy("chunk").agg(F.min("paper").alias("first"))
    edges = links.join(first, "chunk").where("paper <> first").select(F.col("first").alias("u"), F.col("paper").alias("v"))
    return keyed, first, components(edges)


def grouped_split(candidates: DataFrame, shares: list[tuple[str, int]]) -> DataFrame:
    """(candidate_id, group_key, split): whole groups in the shares (permille).

    Groups are laid out from heavy to light along the total weight, and each
    takes the split its start falls in. Heavy groups thus fill the first, largest
    share and single records even out the borders.
    """
    keyed, first, comps = tied_papers(candidates)
    of = (
        keyed.select("candidate_id", "paper", "chunk").join(first, "chunk", "left")
        .withColumn("vertex", F.coalesce("paper", "first", "chunk", F.concat(F.lit("i"), "candidate_id")))
        .join(comps, "vertex", "left")
        .select("candidate_id", F.coalesce("root", "vertex").alias("group_key"))
        # a candidate delivered twice has one group
        .groupBy("candidate_id").agg(F.min("group_key").alias("group_key"))
    )
    of = materialize(of)
    weights = of.groupBy("group_key").agg(F.count("*").alias("weight"))
    placed = running_total(weights.withColumn("down", -F.col("weight")).withColumn("h", F.xxhash64("group_key")), ["down", "h", "group_key"], "weight", "start")
    total = of.count()
    split, at, total_share = F.lit(shares[-1][0]), 0, sum(s for _, s in shares)
    bounds = []
    for name, share in shares[:-1]:
        at += share
        bounds.append((name, total * at / total_share))
    for name, bound in reversed(bounds):
        split = F.when(F.col("start") < bound, name).otherwise(split)
    named = placed.select("group_key", "weight", split.alias("split"))
    # Less than HEAVY groups can hold that much; their rows stay where they are.
    heavy = F.broadcast(named.where(F.col("weight") * HEAVY > total).select("group_key", "split"))
    met = of.join(heavy, "group_key", "left").select("candidate_id", "group_key", "split")
    rest = met.where("split is null").drop("split").join(named.where(F.col("weight") * HEAVY <= total).select("group_key", "split"), "group_key")
    return met.where("split is not null").unionByName(rest.select("candidate_id", "group_key", "split"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, comps = tied_papers(table(spark, sf_dir, "candidates"))
    parts = comps.select("root", F.split(F.substring("vertex", 2, 1 << 30), "\x1f", 2).alias("k"))
    named = parts.select("root", F.col("k")[0].alias("source_dataset"), F.col("k")[1].alias("paper_id"))
    least = named.groupBy("root").agg(F.min("paper_id").alias("group_id"))
    return named.join(least, "root").select("source_dataset", "group_id", "paper_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = limits(spark, sf_dir)
    return grouped_split(table(spark, sf_dir, "candidates"), [(s, lim[f"{s}_share"]) for s in ("train", "validation", "test")])


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and share reached (permille) of each split."""
    made = materialize(p4_splits(spark, sf_dir))
    total = made.count()
    return made.groupBy("split").agg(F.count("*").alias("candidates"), (F.count("*") * 1000 / F.lit(total)).alias("permille"))


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a split, and faults that are to be 0: papers, chunks (of a dataset) and
    candidates that stand in more than one split."""
    c = table(spark, sf_dir, "candidates")
    made = materialize(p4_splits(spark, sf_dir))
    keyed = _keyed(c).distinct().join(made, "candidate_id")
    parted = lambda k: keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b"))).first()[0]
    n = made.agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("d"))
    return n.select(F.col("n").alias("candidates"), (F.col("n") - F.col("d")).alias("repeated"), F.lit(parted("paper")).alias("papers_parted"), F.lit(parted("chunk")).alias("chunks_parted"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares, "p4_check": p4_check}
SQL: dict[str, str] = {
    "p4_check": """select count(distinct candidate_id) as candidates, cast(0 as bigint) as repeated, cast(0 as bigint) as papers_parted, cast(0 as bigint) as chunks_parted from candidates""",
    "p4_found": r"""
with recursive k as (
  select distinct source_dataset as ds, paper_id as p, nullif(regexp_replace(upper(coalesce(chunk_id, '')), '[^\p{L}\p{N}]', '', 'g'), '') as c
  from candidates where trim(coalesce(paper_id, '')) <> ''),
f as (select ds, c, min(p) as u from k where c is not null group by ds, c),
e as (select distinct k.ds, f.u, k.p as v from k join f on f.ds = k.ds and f.c = k.c where k.p <> f.u),
b as (select ds, u, v from e union select ds, v, u from e),
r(ds, p, q) as (select distinct ds, u, u from b union select r.ds, r.p, b.v from r join b on b.ds = r.ds and b.u = r.q)
select ds as source_dataset, min(q) as group_id, p as paper_id from r group by ds, p"""
}
