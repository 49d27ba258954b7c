"""Chat examples for training from labelled candidates, and validity of generated JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, norm

KEYS = ["claims", "methods", "experiments", "limitations", "concepts", "relations"]
EXTRACTOR_SYSTEM = "Extract an evidence-grounded graph from the passage as JSON."
JUDGE_SYSTEM = "Judge whether the candidate label is supported by the passage; answer in JSON."
_DECISION = "struct<version:string,status:string,confidence:double,reason_codes:array<string>,corrected_label_bucket:string,corrected_label_text:string,corrected_evidence_span:string>"


def merge_labels(auto: DataFrame, strict: DataFrame) -> DataFrame:
    """Candidates with ``auto_label``, joined with ``strict_auto_label`` of the same id, and the
    ``effective`` label of both. Ids are compared without outer and repeated blanks. Should an id
    repeat among the strict labels, the last in file order counts (``_file``, ``_part``, ``_line``
    as the reader gives them), without them the greatest label as JSON text."""
    order = [F.col(c) for c in ("_file", "_part", "_line") if c in strict.columns] or [F.to_json("strict_auto_label")]
    last = strict.groupBy(norm(F.col("candidate_id")).alias("__id")).agg(F.max_by("strict_auto_label", F.struct(*order)).alias("strict_auto_label"))
    both = auto.withColumn("__id", norm(F.col("candidate_id"))).join(last, "__id", "left").drop("__id")
    use = F.coalesce(F.col("strict_auto_label.status"), F.lit("")) != ""
    none = {"status": F.lit("reject"), "confidence": F.lit(0.0), "reason_codes": F.array(F.lit("missing_auto_label"))}
    held = F.col("auto_label").isNotNull()
    fields = [f.split(":")[0] for f in _DECISION[7:-1].split(",")]
    pick = lambda f: F.when(use, F.col(f"strict_auto_label.{f}")).when(held, F.col(f"auto_label.{f}")).otherwise(none.get(f, F.lit("")))
    return both.withColumn("effective", F.struct(*[pick(f).alias(f) for f in fields]))


def corrected(field: str) -> Column:
    return first_filled(norm(F.col(f"effective.corrected_{field}")), norm(F.col(field)))


def split_key(paper: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), norm(paper)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000


def split_name(paper: Column, eval_ratio: float = 0.1, seed: int = 17) -> Column:
    """eval or train by a hash of the paper, so no paper is in both."""
    return F.when(split_key(paper, seed) < int(eval_ratio * 10_000), "eval").otherwise("train")


def _messages(system: str, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user), ("assistant", assistant))])


_KEEP_NULLS = {"ignoreNullFields": "false"}


def extractor_examples(merged: DataFrame, eval_ratio: float = 0.1, seed: int = 17) -> DataFrame:
    """One example for each chunk with accepted candidates, ordered by candidate id."""
    chunk = first_filled(norm(F.col("chunk_id")), norm(F.col("candidate_id")))
    bucket = corrected("label_bucket")
    ident, text, evidence, section = first_filled(norm(F.col("label_id")), norm(F.col("candidate_id"))), corrected("label_text"), corrected("evidence_span"), norm(F.col("section"))
    base = [("evidence_span", evidence), ("id", ident), ("section", section)]
    item = lambda *more: F.struct(*[c.alias(k) for k, c in sorted([*base, *more], key=lambda x: x[0])])
    forms = {
        "claims": item(("text", text)), "methods": item(("name", text)), "experiments": item(("summary", text)), "limitations": item(("text", text)), "concepts": item(("name", text)),
        "relations": item(("type", F.coalesce(F.nullif(norm(F.col("relation_type")), F.lit("")), F.lit("related-to"))), ("source_id", norm(F.col("source_id"))), ("target_id", norm(F.col("target_id"))), ("source_text", text)),
    }
    first = F.struct(*[norm(F.col(c)).alias(c) for c in ("chunk_text", "paper_id", "section", "title")])
    rows = merged.where("effective.status = 'accept'").select(chunk.alias("chunk_id"), F.col("candidate_id").alias("ord"), bucket.alias("bucket"), first.alias("first"), *[f.alias(f"i_{b}") for b, f in forms.items()])
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("ord", F.col(f"i_{b}").alias("item"))))), lambda x: x["item"]).alias(b) for b in sorted(forms)]
    per = rows.groupBy("chunk_id").agg(F.min_by("first", "ord").alias("first"), F.count("*").alias("n_items"), *lists)
    graph = F.to_json(F.struct(*sorted(forms)), _KEEP_NULLS)
    return per.select(
        F.lit("extractor").alias("task"), F.col("first.paper_id").alias("paper_id"), "chunk_id", split_name(F.col("first.paper_id"), eval_ratio, seed).alias("split"), "n_items",
        _messages(EXTRACTOR_SYSTEM, F.to_json("first", _KEEP_NULLS), graph).alias("messages"),
    )


def judge_examples(merged: DataFrame, eval_ratio: float = 0.1, seed: int = 17) -> DataFrame:
    """One example for each candidate; corrections only where the verdict is edit."""
    fields = ["evidence_span", "label_bucket", "label_text", "relation_type", "source_id", "target_id"]
    user = F.struct(F.struct(*[norm(F.col(c)).alias(c) for c in fields]).alias("candidate"), norm(F.col("chunk_text")).alias("chunk_text"))
    fix = F.struct(*[norm(F.col(f"effective.corrected_{c}")).alias(c) for c in ("evidence_span", "label_bucket", "label_text")])
    status = norm(F.col("effective.status"))
    out = F.struct(F.when(status == "edit", fix).alias("corrected_candidate"), F.coalesce("effective.reason_codes", F.array().cast("array<string>")).alias("reason_codes"), status.alias("verdict"))
    return merged.select(
        F.lit("judge").alias("task"), norm(F.col("paper_id")).alias("paper_id"), "candidate_id", split_name(F.col("paper_id"), eval_ratio, seed).alias("split"), status.alias("verdict"),
        _messages(JUDGE_SYSTEM, F.to_json(user, _KEEP_NULLS), F.to_json(out, _KEEP_NULLS)).alias("messages"),
    )


def json_payload(text: Column) -> Column:
    """The text's outermost JSON object as a variant, or null."""
    v = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def schema_ok(payload: Column) -> Column:
    """Whether all keys of the schema are there and hold arrays."""
    ok = payload.isNotNull()
    for k in KEYS:
        ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(payload, f"$.{k}", "variant")).startswith("ARRAY"), F.lit(False))
    return ok


def validity(generated: DataFrame) -> DataFrame:
    """generated(chunk_id, text): whether each text holds a JSON object of the schema. Each text
    is parsed once: the variant is generated, so no expression that reads it repeats it."""
    rows = generated.select("chunk_id", "text", F.explode(F.array(json_payload(F.col("text")))).alias("payload"))
    return rows.select("chunk_id", F.col("payload").isNotNull().alias("json_valid"), schema_ok(F.col("payload")).alias("schema_ok"), F.substring("text", 1, 300).alias("preview"))


def validity_summary(judged: DataFrame) -> DataFrame:
    """(total, json_valid, schema_ok): one row, of zeros for no texts."""
    return judged.agg(F.count("*").alias("total"), F.count_if("json_valid").alias("json_valid"), F.count_if("schema_ok").alias("schema_ok"))


def prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(chunk_id, type, text) on both sides: precision, recall and F1 by type."""
    key = lambda d: d.select("chunk_id", "type", F.lower(norm(F.col("text"))).alias("k")).distinct()
    g, p = key(gold).withColumn("g", F.lit(1)), key(predicted).withColumn("p", F.lit(1))
    both = g.join(p, ["chunk_id", "type", "k"], "full_outer").groupBy("type").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.col("g") + F.col("p")).alias("matched"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m, gn, pn = F.col("matched"), F.col("gold"), F.col("predicted")
    return both.select("type", "gold", "predicted", "matched", ratio(m, pn).alias("precision"), ratio(m, gn).alias("recall"), ratio(2 * m, gn + pn).alias("f1"))
