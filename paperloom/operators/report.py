"""Evidence matrix, coverage and Markdown reports, and answers to simple questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import type_order

# Names of the types in reports, and keywords of questions, in order.
NAMES = {"Claim": "주장", "Method": "방법", "Experiment": "실험/결과", "Limitation": "한계", "Concept": "개념"}
INTENTS = {"Claim": ["주장", "claim"], "Method": ["방법", "method"], "Experiment": ["실험", "experiment", "result", "performance"], "Limitation": ["한계", "limitation"], "Concept": ["개념", "concept"]}
UNKNOWN = "질문 의도를 파악하지 못했습니다. '주장', '방법', '실험', '한계', '개념'처럼 질문해 보세요."


def evidence_matrix(titles: DataFrame, items: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return items.join(titles.select("doc_idx", "title"), "doc_idx").select(
        "doc_idx", type_order(F.col("item_type")).alias("type_ord"), "ord", "paper_id", "title", "item_type", "item_id", "text", "section", text("page").alias("page"), "evidence_span", text("confidence").alias("confidence")
    )


def assessment(titles: DataFrame, items: DataFrame) -> DataFrame:
    """Per paper: items, coverage by evidence (rounded half to even), counts by type, and
    the types that are missing; papers without items too."""
    n = {t: F.count_if(F.col("item_type") == t) for t in NAMES}
    per = items.groupBy("doc_idx").agg(F.count("*").alias("items"), F.count_if(F.col("evidence_span") != "").alias("with_evidence"), *[c.alias(f"n_{t.lower()}") for t, c in n.items()])
    counts = ["items", "with_evidence", *[f"n_{t.lower()}" for t in NAMES]]
    out = titles.join(per, "doc_idx", "left").select("doc_idx", "paper_id", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{t.lower()}") == 0, NAMES[t]) for t in list(NAMES)[:4]])), ", ")
    coverage = F.when(F.col("items") == 0, 0).otherwise(F.bround(F.col("with_evidence") * 100.0 / F.col("items"), 0)).cast("int")
    return out.withColumn("coverage", coverage).withColumn("missing", F.when(missing == "", "없음").otherwise(missing))


def assessment_blocks(rows: DataFrame) -> DataFrame:
    line = lambda label, c, end="": F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"), F.lit(end))
    block = F.concat_ws(
        "\n", F.concat(F.lit("## "), "title"), F.lit(""), F.concat(F.lit("- 논문 ID: `"), "paper_id", F.lit("`")), line("추출 항목 수", "items"), line("근거 문장 커버리지", "coverage", "%"),
        line("추출된 주장 수", "n_claim"), line("추출된 방법 수", "n_method"), line("추출된 실험/결과 수", "n_experiment"), line("추출된 한계 수", "n_limitation"), line("추출된 개념 수", "n_concept"), line("보강 필요", "missing"),
    )
    return rows.select("doc_idx", "paper_id", block.alias("block"))


def summary_blocks(titles: DataFrame, items: DataFrame) -> DataFrame:
    """A Markdown block for each paper: its items by type; types without items are left out."""
    bullets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    name: Column | None = None
    for t, v in NAMES.items():
        name = F.when(F.col("item_type") == t, v) if name is None else name.when(F.col("item_type") == t, v)
    per = items.groupBy("doc_idx", "item_type").agg(bullets.alias("bullets"))
    per = per.select("doc_idx", type_order(F.col("item_type")).alias("t"), F.concat(F.lit("### "), name, F.lit("\n"), "bullets").alias("part"))
    parts = per.groupBy("doc_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "part"))), lambda x: x["part"]), "\n\n").alias("parts"))
    head = F.concat(F.lit("## "), "title", F.lit("\n\n논문 ID: `"), "paper_id", F.lit("`"))
    return titles.join(parts, "doc_idx", "left").select("doc_idx", "paper_id", F.concat_ws("\n\n", head, "parts").alias("block"))


def intent(question: Column) -> Column:
    q, out = F.lower(question), None
    for t, words in INTENTS.items():
        hit = q.contains(words[0])
        for w in words[1:]:
            hit = hit | q.contains(w)
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out


def answers(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """questions(qid, question): (qid, type, rank, bullet) — a bullet for each node of the
    question's type, or one line that says why there is none. The caller joins the few
    lines it shows; a type's nodes are never gathered in one row."""
    asked = questions.select("qid", intent(F.col("question")).alias("type"))
    hit = asked.where("type is not null").join(nodes.select("type", "doc_idx", "ord", F.col("label")), "type")
    found = hit.select("qid", "type", "doc_idx", "ord", F.concat(F.lit("- "), "label").alias("line"))
    first = F.coalesce(*[F.when(F.col("type") == t, w[0]) for t, w in INTENTS.items()])
    none = asked.join(nodes.select("type").distinct(), "type", "left_anti")
    said = F.when(F.col("type").isNull(), UNKNOWN).otherwise(F.concat(F.lit("추출된 "), first, F.lit(" 정보가 없습니다.")))
    return found.unionByName(none.select("qid", "type", F.lit(None).cast("long").alias("doc_idx"), F.lit(0).alias("ord"), said.alias("line")))


def ask(question: str, nodes: DataFrame) -> str:
    spark = nodes.sparkSession
    rows = answers(spark.createDataFrame([(1, question)], "qid int, question string"), nodes).orderBy("doc_idx", "ord")
    return "\n".join(r["line"] for r in rows.toLocalIterator())
