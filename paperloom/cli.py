"""Command line: build, sample, label, seed, sft, eval-json."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract, graph, harness, parse, report, sampling, seeds, sft
from .sources import readers, sinks


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def build(spark: SparkSession, folder: str, out: str, question: str = "") -> None:
    """Graph, evidence matrix, summary and assessment of a folder of papers."""
    files = readers.paper_files(spark, folder)
    if files.isEmpty():
        raise SystemExit(f"no supported papers in {folder}")
    texts = files.where(F.col("suffix").isin(readers.TEXT)).select("doc_idx", "paper_id", F.decode("content", "UTF-8").alias("text"))
    sections, titles = parse.markdown_sections(texts), parse.document_titles(texts)
    if not files.where(F.col("suffix").isin(readers.PDF)).isEmpty():
        pages = readers.pdf_pages(files)
        named = pages.groupBy("doc_idx", "paper_id").agg(F.first("meta_title").alias("meta")).join(parse.page_titles(pages), "doc_idx", "left")
        named = named.select("doc_idx", "paper_id", F.coalesce(F.nullif("meta", F.lit("")), "title", parse.stem_title(F.col("paper_id"))).alias("title"))
        titles = titles.unionByName(named)
        sections = sections.unionByName(parse.page_sections(pages.drop("meta_title").join(named.select("doc_idx", "title"), "doc_idx")))
    items = extract.items(sections).cache()
    relations = extract.method_concept_relations(items)
    nodes, edges = graph.nodes(titles, items), graph.edges(items, relations)
    graph.check(nodes, edges)
    Path(out).mkdir(parents=True, exist_ok=True)
    sinks.write_graph_json(nodes, edges, f"{out}/graph.json")
    sinks.write_evidence_matrix(report.evidence_matrix(titles, items), f"{out}/evidence_matrix.csv")
    sinks.write_markdown(report.summary_blocks(titles, items), f"{out}/summary.md", "요약", question)
    sinks.write_markdown(report.assessment_blocks(report.assessment(titles, items)), f"{out}/assessment.md", "평가")
    items.unpersist()


_DECISION = "struct<version:string,status:string,confidence:double,reason_codes:array<string>,corrected_label_bucket:string,corrected_label_text:string,corrected_evidence_span:string>"
_CANDIDATE = (
    "candidate_id string, source_dataset string, paper_id string, title string, section string, chunk_id string, chunk_text string, label_bucket string, target_bucket string, label_id string, label_text string, "
    f"evidence_span string, relation_type string, source_id string, target_id string, seed_id string, question string, hard_cases array<string>, source_label string, auto_label {_DECISION}, strict_auto_label {_DECISION}"
)


def read_candidates(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """Candidates of JSON lines; with their places in the files where the last of a repeated id
    counts."""
    rows = readers.json_lines(spark, path, _CANDIDATE)
    return rows if places else rows.drop(*readers.PLACE)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperloom")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("input_dir")
    b.add_argument("--question", default="")
    b.add_argument("--out", default="paperloom-output")
    s = sub.add_parser("sample")
    s.add_argument("--seed-root", default="data/processed")
    s.add_argument("--out", default="candidates")
    s.add_argument("--review-csv", default="review")
    s.add_argument("--seed", type=int, default=13)
    s.add_argument("--target", action="append", default=[])
    s.add_argument("--no-backfill", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("label")
    x.add_argument("--candidates", required=True)
    x.add_argument("--out-csv", required=True)
    x.add_argument("--out-jsonl")
    x.add_argument("--harness", choices=list(harness.HARNESSES), default="standard")
    x.add_argument("--only-auto-status")
    d = sub.add_parser("seed")
    d.add_argument("name", choices=["qasper", "scifact", "scier", "scirex"])
    d.add_argument("--raw-dir", required=True)
    d.add_argument("--out-dir", required=True)
    d.add_argument("--max-papers-per-split", type=int, default=25)
    d.add_argument("--max-claims-per-split", type=int, default=0)
    t = sub.add_parser("sft")
    t.add_argument("--autolabeled", required=True)
    t.add_argument("--strict", required=True)
    t.add_argument("--out-dir", default="train")
    t.add_argument("--eval-ratio", type=float, default=0.1)
    t.add_argument("--seed", type=int, default=17)
    e = sub.add_parser("eval-json")
    e.add_argument("--generated", required=True)
    e.add_argument("--limit", type=int, default=8)
    a = p.parse_args(argv)
    spark = _session()
    if a.command == "build":
        build(spark, a.input_dir, a.out, a.question)
    elif a.command == "sample":
        targets = sampling.TARGETS
        for text in a.target:
            targets = sampling.parse_target(text, targets if targets is not sampling.TARGETS else {})
        pool = sampling.dedupe(sampling.candidates(readers.json_lines(spark, f"{a.seed_root}/*/seeds.jsonl", sampling.SEED)), "pool_idx").drop("pool_idx")
        picked, deficits = sampling.sample(pool, targets, a.seed, not a.no_backfill)
        rows = pool.join(picked.select("candidate_id"), "candidate_id", "left_semi").cache()
        if not a.dry_run:
            sinks.write_json_lines(rows, a.out)
            blank = {c: F.lit("") for c in harness.REVIEW[11:]}
            sinks.write_csv(rows.select(*[blank.get(c, F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in harness.REVIEW]), a.review_csv)
        for r in rows.groupBy("source_dataset", "label_bucket").count().orderBy("source_dataset", "label_bucket").collect():
            print(f"{r[0]}.{r[1]}: {r[2]}")
        for r in deficits.collect():
            print(f"deficit {r[0]}.{r[1]}: {r[2]}")
    elif a.command == "label":
        name = harness.HARNESSES[a.harness][0]
        out = harness.label(read_candidates(spark, a.candidates), a.harness, a.only_auto_status).cache()
        sinks.write_csv(harness.review_rows(out, name), a.out_csv)
        if a.out_jsonl:
            sinks.write_json_lines(out, a.out_jsonl)
        for r in harness.status_counts(out, name).orderBy("status").collect():
            print(f"{r[0]}: {r[1]}")
    elif a.command == "seed":
        seed(spark, a.name, a.raw_dir, a.out_dir, a.max_papers_per_split or None, a.max_claims_per_split or None)
    elif a.command == "sft":
        merged = sft.merge_labels(read_candidates(spark, a.autolabeled).drop("strict_auto_label"), read_candidates(spark, a.strict, places=True)).cache()
        stats = {"input_rows": merged.count(), "status": {r[0]: r[1] for r in merged.groupBy("effective.status").count().collect()}}
        for task, made in (("extractor", sft.extractor_examples(merged, a.eval_ratio, a.seed)), ("judge", sft.judge_examples(merged, a.eval_ratio, a.seed))):
            for split in ("train", "eval"):
                stats[f"{task}_{split}"] = sinks.write_json_lines(made.where(F.col("split") == split).drop("split"), f"{a.out_dir}/{task}_{split}")
        Path(f"{a.out_dir}/sft_stats.json").write_text(json.dumps(stats, indent=2, sort_keys=True) + "\n")
    else:
        judged = sft.validity(readers.json_lines(spark, a.generated, "chunk_id string, text string", limit=a.limit or None)).cache()
        summary = sft.validity_summary(judged).first().asDict()
        if a.limit:  # few rows
            summary["results"] = [r.asDict() for r in judged.collect()]
        print(json.dumps(summary, ensure_ascii=False, indent=2))
    return 0


def seed(spark: SparkSession, name: str, raw: str, out: str, most_papers: int | None, most_claims: int | None) -> None:
    """Convert one corpus of split files, in or below a folder, to chunks, evidence and seeds."""
    splits = ["train", "validation", "test", *(["test_ood"] if name == "scier" else [])]
    found = {}
    for s in splits:
        try:
            found[s] = readers.split_file(spark, raw, f"{s}.json" + ("" if name == "qasper" else "l"))
        except FileNotFoundError:
            if s != "test_ood":
                raise
    if name == "qasper":
        papers = readers.by_split({s: readers.json_map(spark, f, seeds.QA_PAPER).select("pos", F.col("key").alias("paper_id"), "value.*") for s, f in found.items()})
        made = seeds.question_corpus(papers, most_papers)
    elif name == "scifact":
        rows = seeds.numbered(readers.by_split({s: readers.json_lines(spark, f, seeds.CLAIM, strict=False) for s, f in found.items()}))
        if most_claims:
            rows = rows.where(F.col("row_idx") <= most_claims)
        made = seeds.claim_corpus(rows, readers.last_per_key(readers.json_lines(spark, readers.split_file(spark, raw, "corpus.jsonl"), seeds.CORPUS, strict=False), "doc_id"))
    else:
        schema, convert = (seeds.SENTENCE, seeds.sentence_corpus) if name == "scier" else (seeds.FULL_DOCUMENT, seeds.document_corpus)
        made = convert(seeds.numbered(readers.by_split({s: readers.json_lines(spark, f, schema, strict=False) for s, f in found.items()})))
    counts = {k: sinks.write_json_lines(df, f"{out}/{k}") for k, df in zip(("chunks", "evidence", "seeds"), made)}
    sinks.manifest(f"{out}/manifest.json", name, found, counts)


if __name__ == "__main__":
    sys.exit(main())
