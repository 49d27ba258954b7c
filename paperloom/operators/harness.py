"""Accept / edit / reject rules over candidates, as plain Columns.

``standard`` evaluates all rules; ``strict`` is a first-match list for rows the standard
harness left to edit. Nulls count as empty; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, contains_any, first_filled, key, norm

VERSION, STRICT_VERSION = "auto-label-v1", "auto-label-v1-strict-edit-pass"
# Fixed values of the rules.
BUCKETS = ["claims", "methods", "experiments", "limitations", "concepts", "relations"]
WEAK = ["", "n/a", "na", "none", "null", "yes", "no", "true", "false", "unanswerable", "unknown"]
GENERIC = ["cnn", "rnn", "lstm", "mlp", "bert", "dropout", "attention", "transformer", "resnet", "vgg"]
TYPED = ["supports", "contradicts", "used-for", "part-of", "feature-of", "evaluated-with", "trained-with", "compare", "synonym-of"]
METRIC_CUES = ["f1", "accuracy", "score", "dataset", "%", "ap", "map"]
LIMIT_CUES = ["limit", "weak", "fail", "future", "however", "challenge"]
CLAIM_VERBS = "is are was were has have had shows show improves achieves outperforms reduces increases supports contradicts proposes uses requires enables".split()
REVIEW = [
    "candidate_id", "source_dataset", "paper_id", "section", "chunk_text", "label_bucket", "label_text", "evidence_span", "relation_type", "source_id", "target_id",
    "review_status", "corrected_label_bucket", "corrected_label_text", "corrected_evidence_span", "notes",
]


def _features() -> dict[str, Column]:
    f: dict[str, Column] = {
        "dataset": key(F.col("source_dataset")), "bucket": key(F.col("label_bucket")), "label": norm(F.col("label_text")),
        "evidence": norm(F.col("evidence_span")), "chunk": norm(F.col("chunk_text")), "src": norm(F.col("source_id")), "tgt": norm(F.col("target_id")),
        "rel": F.lower(first_filled(norm(F.col("relation_type")), norm(F.get_json_object("source_label", "$.type")))),
        "mapped_raw": F.get_json_object("source_label", "$.raw_relation").isNotNull(),
    }
    return f


def _with_features(df: DataFrame) -> DataFrame:
    """Features under names no input column has, so that clashes can't happen."""
    df = df.withColumns({f"__{k}": c for k, c in _features().items()})
    raw = F.from_json("__label", "map<string,string>")
    is_object = F.col("__label").startswith("{") & F.coalesce(F.size(raw) > 0, F.lit(False))
    filled = lambda k: F.coalesce(F.try_element_at(raw, F.lit(k)), F.lit("")) != ""
    numeric = F.col("__label").rlike(r"^[\p{Nd}.,%+\- ]+$")
    low = F.lower("__label")
    return df.withColumns(
        {
            "__raw": is_object, "__core": is_object & filled("Method") & filled("Task"), "__numeric": numeric, "__weak": low.isin(WEAK) | numeric, "__generic": low.isin(GENERIC),
            "__exact": (F.col("__evidence") != "") & F.lower("__chunk").contains(F.lower("__evidence")),
            "__words": F.when(F.col("__label") == "", 0).otherwise(F.size(F.split("__label", " "))),
            "__metric": contains_any(low, METRIC_CUES), "__cue": contains_any(F.lower(F.concat_ws(" ", "__label", "__evidence")), LIMIT_CUES),
            "__verb": contains_any(F.concat(F.lit(" "), low, F.lit(" ")), [f" {v} " for v in CLAIM_VERBS]),
            "__list": F.col("__label").contains("|") | (F.length(F.regexp_replace("__label", "[^,]", "")) >= 3) | (F.length(F.regexp_replace("__label", "[^;]", "")) >= 2),
        }
    )


def _c(name: str) -> Column:
    return F.col(f"__{name}")


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))


def _decision(version: str, status: Column, confidence: Column, reasons: Column, bucket: Column, text: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(version).alias("version"), status.alias("status"), confidence.cast("double").alias("confidence"), reasons.alias("reason_codes"),
        bucket.alias("corrected_label_bucket"), text.alias("corrected_label_text"), evidence.alias("corrected_evidence_span"),
    )


def standard(df: DataFrame, name: str) -> DataFrame:
    """All rules are evaluated; reject outweighs edit, edit outweighs accept."""
    b, relations, has_ev = _c("bucket"), _c("bucket") == "relations", _c("evidence") != ""
    entity = b.isin("methods", "concepts")
    short = F.length(_c("label")) < 3
    scirex_raw = relations & (_c("dataset") == "scirex") & _c("raw")
    stance = relations & ~scirex_raw & _c("rel").isin("supports", "contradicts")
    typed = relations & ~scirex_raw & ~_c("rel").isin("supports", "contradicts") & _c("rel").isin(TYPED)
    other = relations & ~scirex_raw & ~_c("rel").isin(TYPED)
    stance_ok = (_c("label") != "") & has_ev & ~_c("weak")
    ends = (_c("src") != "") & (_c("tgt") != "") & has_ev
    reject = _reasons(
        (~b.isin(BUCKETS), "invalid_bucket"), (_c("chunk") == "", "missing_chunk_text"), (_c("weak") & ~relations, "weak_atomic_label"),
        ((b == "claims") & (_c("words") < 4), "claim_too_short"), (entity & short, "entity_too_short"),
        (relations & (_c("rel") == ""), "missing_relation_type"), (scirex_raw & ~_c("core"), "raw_relation_missing_core_fields"),
    )
    edit = _reasons(
        (~relations & ~has_ev, "missing_evidence_span"), (has_ev & ~_c("exact"), "evidence_span_not_exact_substring"),
        (entity & ~short & _c("generic"), "generic_entity_needs_policy"), ((b == "experiments") & _c("numeric"), "metric_without_context"),
        ((b == "limitations") & ~_c("cue"), "limitation_needs_human_confirmation"), (scirex_raw & _c("core"), "raw_document_relation_needs_endpoint_mapping"),
        (stance & ~stance_ok, "claim_relation_needs_text_or_evidence"), (typed & ~ends, "typed_relation_missing_endpoint_or_evidence"),
        (other & _c("mapped_raw"), "raw_relation_needs_mapping"), (other & ~_c("mapped_raw"), "relation_needs_human_confirmation"),
        ((_c("dataset") == "qasper") & b.isin("claims", "methods", "experiments") & (_c("label").startswith("FLOAT SELECTED:") | _c("label").startswith("Table ")), "table_or_float_label_needs_cleanup"),
    )
    accept = _reasons(
        (entity & ~short & ~_c("generic") & _c("exact"), "entity_with_exact_evidence"), ((b == "experiments") & ~_c("numeric") & _c("metric"), "experiment_metric_result"),
        (stance & stance_ok, "claim_relation_with_evidence"), (typed & ends, "typed_relation_with_endpoints"),
    )
    # The reasons are columns of their own, so that the fields below don't repeat the rules.
    df = df.withColumns({"__reject": reject, "__edit": edit, "__accept": accept})
    some = lambda c: F.size(_c(c)) > 0
    df = df.withColumn("__case", F.when(some("reject"), 0).when(some("edit"), 1).when(some("accept"), 2).otherwise(3))
    pick = lambda *v: F.when(_c("case") == 0, v[0]).when(_c("case") == 1, v[1]).when(_c("case") == 2, v[2]).otherwise(v[3])
    none, exact = F.lit(""), F.when(_c("exact"), _c("evidence")).otherwise("")
    bucket = F.when(b.isin(BUCKETS), b).otherwise("")
    return df.withColumn(
        name,
        _decision(
            VERSION, pick(F.lit("reject"), F.lit("edit"), F.lit("accept"), F.lit("edit")),
            pick(F.when(F.array_contains(_c("reject"), "weak_atomic_label"), 0.9).otherwise(0.8), F.lit(0.7), F.lit(0.8), F.lit(0.55)),
            pick(F.concat(_c("reject"), _c("edit"), _c("accept")), F.concat(_c("edit"), _c("accept")), _c("accept"), F.array(F.lit("needs_human_confirmation"))),
            pick(none, bucket, none, bucket), pick(none, F.when(_c("weak"), "").otherwise(_c("label")), none, _c("label")), pick(none, exact, none, exact),
        ),
    )


def strict(df: DataFrame, name: str) -> DataFrame:
    """The first rule that holds decides; its number is found once, its fields looked up."""
    b, exact = _c("bucket"), _c("exact")
    entity, rel = b.isin("methods", "concepts"), b == "relations"
    raw = rel & (_c("dataset") == "scirex") & _c("raw")
    stance = rel & _c("rel").isin("supports", "contradicts")
    rules = [
        (~b.isin(BUCKETS), "reject", 0.95, "invalid_bucket"),
        (_c("chunk") == "", "reject", 0.95, "missing_chunk_text"),
        (_c("weak") & (b != "relations"), "reject", 0.95, "weak_atomic_label"),
        (raw & _c("core"), "edit", 0.85, "scirex_raw_relation_requires_endpoint_mapping"),
        (raw, "reject", 0.95, "raw_relation_missing_core_fields"),
        (rel & (_c("rel") == ""), "reject", 0.95, "missing_relation_type"),
        (stance & (_c("label") != "") & exact & ~_c("weak"), "accept", 0.9, "claim_relation_exact_evidence"),
        (stance, "reject", 0.9, "claim_relation_without_exact_evidence"),
        (rel & (_c("src") != "") & (_c("tgt") != "") & exact, "accept", 0.9, "typed_relation_exact_endpoints_evidence"),
        (rel, "reject", 0.9, "relation_without_exact_endpoint_evidence"),
        (entity & (F.length(_c("label")) < 3), "reject", 0.95, "entity_too_short"),
        (entity & _c("generic") & exact, "edit", 0.8, "generic_entity_requires_schema_policy"),
        (entity & _c("generic"), "reject", 0.9, "generic_entity_without_exact_evidence"),
        (entity & exact, "accept", 0.9, "entity_exact_evidence"),
        (entity, "reject", 0.9, "entity_without_exact_evidence"),
        ((b == "experiments") & _c("metric") & exact & ~_c("numeric"), "accept", 0.9, "experiment_metric_exact_evidence"),
        (b == "experiments", "reject", 0.9, "experiment_without_metric_exact_evidence"),
        ((b == "claims") & exact & (_c("words") >= 8) & _c("verb") & ~_c("list"), "accept", 0.88, "sentence_claim_exact_evidence"),
        (b == "claims", "reject", 0.88, "claim_not_sentence_or_exact_evidence"),
        ((b == "limitations") & exact & _c("cue"), "accept", 0.88, "limitation_exact_evidence"),
        (b == "limitations", "reject", 0.88, "limitation_without_explicit_signal"),
        (F.lit(True), "reject", 0.85, "unhandled_candidate"),
    ]
    number = F.when(rules[0][0], 1)
    for i, r in enumerate(rules[1:], 2):
        number = number.when(r[0], i)
    df = df.withColumn("__rule", number)
    field = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in rules]), _c("rule"))
    edits = _c("rule").isin([i for i, r in enumerate(rules, 1) if r[1] == "edit"])
    fix = lambda c: F.when(edits, c).otherwise("")
    evidence = F.when(exact, _c("evidence")).otherwise("")
    return df.withColumn(name, _decision(STRICT_VERSION, field(1), field(2), F.array(F.concat(F.lit("strict_"), field(3))), fix(b), fix(_c("label")), fix(evidence)))


#: Harnesses by name: the key their decision is stored under, and what adds it.
HARNESSES: dict[str, tuple[str, Callable[[DataFrame, str], DataFrame]]] = {"standard": ("auto_label", standard), "strict-edit-pass": ("strict_auto_label", strict)}


def label(candidates: DataFrame, harness: str = "standard", only_auto_status: str | None = None) -> DataFrame:
    """Candidates with the harness' decision; optionally only those of an earlier status."""
    if harness not in HARNESSES:
        raise ValueError(f"unknown harness: {harness}")
    name, decide = HARNESSES[harness]
    if only_auto_status:
        candidates = candidates.where(key(F.col("auto_label.status")) == only_auto_status)
    keep = candidates.columns
    return decide(_with_features(candidates), name).select(*[c for c in keep if c != name], name)


def notes(decision: Column) -> Column:
    return F.format_string("%s; confidence=%.2f; reasons=%s", decision["version"], decision["confidence"], F.array_join(decision["reason_codes"], ","))


def review_rows(labeled: DataFrame, name: str = "auto_label") -> DataFrame:
    """The 16 columns of a review sheet."""
    d = F.col(name)
    filled = {"review_status": d["status"], "notes": notes(d)} | {c: d[c] for c in REVIEW if c.startswith("corrected_")}
    return labeled.select(*[(filled[c] if c in filled else norm(F.col(c))).alias(c) for c in REVIEW])


def status_counts(labeled: DataFrame, name: str = "auto_label") -> DataFrame:
    """Rows by status, all three statuses present."""
    spark = labeled.sparkSession
    all_three = spark.createDataFrame([("accept",), ("edit",), ("reject",)], "status string")
    n = labeled.groupBy(F.col(f"{name}.status").alias("status")).agg(F.count("*").alias("n"))
    return all_three.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
