"""Candidates from seed rows, their deduplication, and diverse stratified sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, norm, stable_id

# Default targets, labels taken per row and bucket, and bucket order.
TARGETS = {
    "qasper": {"claims": 20, "methods": 25, "experiments": 25, "limitations": 10},
    "scifact": {"supports": 35, "contradicts": 35},
    "scier": {"methods": 40, "concepts": 30, "relations": 30},
    "scirex": {"methods": 20, "concepts": 20, "relations": 10},
}
MOST_LABELS = {"scirex": {"methods": 3, "concepts": 3, "relations": 5}}
BUCKETS = ["claims", "methods", "experiments", "limitations", "concepts", "relations"]
LONG_CHUNK = 1600
DEDUPE_KEY = ["source_dataset", "paper_id", "chunk_id", "label_bucket", "target_bucket", "label_id", "label_text", "evidence_span", "relation_type", "source_id", "target_id"]
LABEL = "struct<id:string,name:string,text:string,claim:string,type:string,evidence_span:string,confidence:double,source:string,source_id:string,target_id:string,raw_relation:string>"
SEED = (
    "id string, source_dataset string, status string, paper_id string, title string, source_pdf string, section string, page int, chunk_id string, chunk_text string, question string, "
    "labels struct<" + ",".join(f"{b}:array<{LABEL}>" for b in BUCKETS) + ">"
)


def label_text(label: Column, bucket: Column) -> Column:
    """A relation's raw form (keys sorted), else its first filled text."""
    raw = F.when((bucket == "relations") & F.ltrim(label["raw_relation"]).startswith("{"), F.to_json(F.try_parse_json(label["raw_relation"])))
    return F.coalesce(raw, first_filled(*[norm(label[k]) for k in ("text", "name", "claim", "type")]))


def representative(labels: Column, limit: Column) -> Column:
    """At most ``limit`` labels at even distances, first and last kept; null: all."""
    n = F.size(labels)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), limit - 1), lambda i: F.bround(i * (n - 1) / (limit - 1)).cast("int")))
    picked = F.transform(at, lambda i: F.get(labels, i))
    return F.when(limit.isNull() | (limit <= 0) | (n <= limit), labels).when(limit == 1, F.slice(labels, 1, 1)).otherwise(picked)


def candidates(seeds: DataFrame) -> DataFrame:
    """A candidate for each label of a seed row; claim-verification rows give their stances
    only, with the text of the claim they are about."""
    empty = F.from_json(F.lit("[]"), f"array<{LABEL}>")
    limits = F.lit(None).cast("int")

    def limit_of(b: str) -> Column:
        out = limits
        for ds, per in MOST_LABELS.items():
            if b in per:
                out = F.when(norm(F.col("source_dataset")) == ds, per[b]).otherwise(out)
        return out

    lots = F.array(*[F.struct(F.lit(i).alias("b_ord"), F.lit(b).alias("bucket"), representative(F.coalesce(F.col(f"labels.{b}"), empty), limit_of(b)).alias("ls")) for i, b in enumerate(BUCKETS)])
    rows = seeds.withColumn("lot", F.explode(lots)).select("*", F.posexplode("lot.ls").alias("l_ord", "label")).withColumn("bucket", F.col("lot.bucket"))
    fact = norm(F.col("source_dataset")) == "scifact"
    kind = F.lower(norm(F.col("label.type")))
    rows = rows.where(~fact | ((F.col("bucket") == "relations") & kind.isin("supports", "contradicts")))
    label, bucket = F.col("label"), F.col("bucket")
    claims = F.coalesce(F.col("labels.claims"), empty)
    own = F.get(F.filter(claims, lambda c: norm(c["id"]) == norm(F.col("label.source_id"))), 0)
    about = F.coalesce(own, F.get(claims, 0))
    text = F.when(fact & about.isNotNull(), label_text(about, F.lit("claims"))).otherwise(label_text(label, bucket))
    only = lambda c: F.when(bucket == "relations", norm(label[c])).otherwise("")
    evidence, chunk = norm(label["evidence_span"]), norm(F.col("chunk_text"))
    cases = F.array_compact(
        F.array(
            F.when(F.length(chunk) >= LONG_CHUNK, "long_chunk"), F.when((evidence != "") & ~chunk.contains(evidence), "evidence_span_mismatch"),
            F.when((bucket == "relations") & ((F.coalesce(label["source_id"], F.lit("")) != "") | (F.coalesce(label["target_id"], F.lit("")) != "")), "relation_endpoints"),
            F.when((bucket == "relations") & (kind == "contradicts"), "contradicts_relation"),
            F.when((F.size(F.coalesce(F.col("labels.methods"), empty)) > 0) & (F.size(F.coalesce(F.col("labels.concepts"), empty)) > 0), "method_and_concept_same_chunk"),
            F.when(label_text(label, bucket) == "", "empty_or_ambiguous_label"),
        )
    )
    out = rows.select(
        *[norm(F.col(c)).alias(c) for c in ("source_dataset", "paper_id", "title", "section", "chunk_id")], chunk.alias("chunk_text"),
        bucket.alias("label_bucket"), F.when(fact, kind).otherwise(bucket).alias("target_bucket"), norm(label["id"]).alias("label_id"), norm(text).alias("label_text"), evidence.alias("evidence_span"),
        only("type").alias("relation_type"), only("source_id").alias("source_id"), only("target_id").alias("target_id"), norm(F.col("id")).alias("seed_id"), norm(F.col("question")).alias("question"),
        cases.alias("hard_cases"), F.to_json(label).alias("source_label"), F.struct("id", "lot.b_ord", "l_ord").alias("pool_idx"),
    )
    parts = ["source_dataset", "paper_id", "chunk_id", "seed_id", "label_bucket", "target_bucket", "label_id", "label_text", "relation_type", "source_id", "target_id", "evidence_span"]
    return out.withColumn("candidate_id", F.concat(F.lit("cand-"), stable_id(*[F.col(c) for c in parts])))


def dedupe(pool: DataFrame, order: str | Column) -> DataFrame:
    """The first of the candidates that agree in all of ``DEDUPE_KEY``."""
    order = F.col(order) if isinstance(order, str) else order
    rows = F.struct(*[F.col(c) for c in pool.columns])
    best = pool.groupBy(*[F.coalesce(c, F.lit("")).alias(f"__{i}") for i, c in enumerate(DEDUPE_KEY)]).agg(F.min_by(rows, order).alias("__r"))
    return best.select("__r.*")


def _order(seed: int) -> list[Column]:
    return [F.desc(F.size("hard_cases")), F.sha2(F.concat_ws("|", F.lit(str(seed)), "candidate_id"), 256), F.coalesce("paper_id", F.lit("")), "candidate_id"]


def pick_diverse(pool: DataFrame, strata: list[str], quota: DataFrame, seed: int, most: int) -> DataFrame:
    """The quota of each stratum, one of each paper before a second of any.

    ``most`` bounds all quotas; rank limits with it let each task drop what can't
    be chosen before rows of a stratum meet.
    """
    o = _order(seed)
    k = F.row_number().over(Window.partitionBy(*strata, F.coalesce("paper_id", F.lit(""))).orderBy(*o))
    ranked = pool.withColumn("__k", k).where(F.col("__k") <= most)
    g = F.row_number().over(Window.partitionBy(*strata).orderBy(F.col("__k") > 1, *o))
    near = ranked.withColumn("__g", g).where(F.col("__g") <= most)
    return near.join(F.broadcast(quota), strata).where(F.col("__g") <= F.col("quota")).drop("__k", "__g", "quota")


def sample(pool: DataFrame, targets: dict[str, dict[str, int]] | None = None, seed: int = 13, backfill: bool = True) -> tuple[DataFrame, DataFrame]:
    """(selected with ``pick``: target, dataset or global; deficits before backfill).

    pool(candidate_id unique, source_dataset, target_bucket, paper_id, hard_cases, ...).
    Ids are picked; the rows are joined back by the caller's need.
    """
    targets = targets or TARGETS
    spark = pool.sparkSession
    flat = [(d, b, n) for d, per in targets.items() for b, n in per.items()]
    total = sum(n for *_, n in flat)
    quota = spark.createDataFrame(flat, "source_dataset string, target_bucket string, quota int")
    narrow = pool.select("candidate_id", "source_dataset", "target_bucket", "paper_id", "hard_cases")
    picked = pick_diverse(narrow, ["source_dataset", "target_bucket"], quota, seed, max(n for *_, n in flat)).withColumn("pick", F.lit("target"))
    got = picked.groupBy("source_dataset", "target_bucket").agg(F.count("*").alias("n"))
    deficits = quota.join(got, ["source_dataset", "target_bucket"], "left").select("source_dataset", "target_bucket", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("deficit")).where("deficit > 0")
    if not backfill:
        return picked, deficits
    per = quota.groupBy("source_dataset").agg(F.sum("quota").alias("want"))
    have = picked.groupBy("source_dataset").agg(F.count("*").alias("n"))
    missing = per.join(have, "source_dataset", "left").select("source_dataset", (F.col("want") - F.coalesce("n", F.lit(0))).alias("quota")).where("quota > 0")
    rest = narrow.join(F.broadcast(picked.select("candidate_id")), "candidate_id", "left_anti")  # at most the sum of all targets
    second = pick_diverse(rest, ["source_dataset"], missing, seed + 1, total).withColumn("pick", F.lit("dataset"))
    both = picked.unionByName(second)
    left = both.agg((F.lit(total) - F.count("*")).alias("quota")).withColumn("__all", F.lit(1))
    rest2 = narrow.join(F.broadcast(both.select("candidate_id")), "candidate_id", "left_anti").withColumn("__all", F.lit(1))
    third = pick_diverse(rest2, ["__all"], left, seed + 2, total).drop("__all").withColumn("pick", F.lit("global"))
    return both.unionByName(third), deficits


def parse_target(text: str, targets: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    """``DATASET.BUCKET=COUNT`` put over the targets."""
    name, eq, count = text.partition("=")
    dataset, dot, bucket = name.partition(".")
    if not eq or not dot or not dataset or not bucket or not count.isdigit():
        raise ValueError(f"not DATASET.BUCKET=COUNT: {text}")
    return {**targets, dataset: {**targets.get(dataset, {}), bucket: int(count)}}
