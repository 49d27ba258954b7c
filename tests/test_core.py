"""Parsing, extraction, graph, reports and rules on small inputs of our own."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import extract, graph, harness, parse, report, sampling, seeds, sft
from paperloom.sources import readers, sinks

PAPER = "# On  Trees\r\nintro line\n## Abstract\nTrees grow. They do.\n## Methods\n- Method: count rings of oak\n* Concept: oak\nResult: 12 rings\nExperiment: again\n주장: 나무\n## Empty\n\n## Limitations\nOnly oak. Not pine.\n"


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "doc_idx long, paper_id string, text string")


def test_text(spark):
    df = spark.createDataFrame([("  a 　b\x1c c\n", "graph-rag 3d", "Ünï A--b!")], "x string, y string, z string")
    r = df.select(text.norm(F.col("x")), text.title_case(F.col("y")), text.slug(F.col("z")), text.slug(F.lit("--")), text.lines(F.lit("a\r\nb\n")), text.stable_id(F.lit(None).cast("string"), F.lit("q"))).first()
    assert r[0] == "a b c" and r[1] == "Graph-Rag 3D" and r[2] == "n-a-b" and r[3] == "item" and r[4] == ["a", "b"] and len(r[5]) == 16


def test_sections_and_titles(spark):
    d = docs(spark, PAPER, None, "", "no heading\nat all", "#\nbare")
    got = {(r.doc_idx, r.title, r.text) for r in parse.markdown_sections(d).collect()}
    assert (0, "On  Trees", "intro line") in got and (0, "Limitations", "Only oak. Not pine.") in got
    assert not any(t == "Empty" for _, t, _ in got)
    assert {(1, "Document", ""), (2, "Document", ""), (3, "Document", "no heading\nat all"), (4, "Document", "bare")} <= got
    assert [r.title for r in parse.document_titles(d).orderBy("doc_idx").collect()] == ["On  Trees", "P1", "P2", "no heading", "P4"]


def test_headings(spark):
    rows = spark.createDataFrame([("3.1 Methods",), ("3. Methods",), ("RESULTS.",), ("a" * 81,)], "x string")
    assert [r[0] for r in rows.select(parse.is_heading(F.col("x"))).collect()] == [True, False, True, False]


def test_page_sections(spark):
    pages = spark.createDataFrame([(0, "p", "Title", 1, "Title\n1\nAbstract\nWe test."), (0, "p", "Title", 2, "still\nMethods\nCount."), (1, "q", "", 1, "7"), (2, "r", "", 1, "x")], "doc_idx long, paper_id string, title string, page int, text string")
    got = [(r.doc_idx, r.title, r.text, r.page) for r in parse.page_sections(pages).orderBy("doc_idx", "section_idx").collect()]
    assert got == [(0, "Abstract", "We test.\nstill", 1), (0, "Methods", "Count.", 2), (1, "문서", "7", None), (2, "문서", "x", 1)]


def test_items_graph_and_reports(spark, tmp_path):
    d = docs(spark, PAPER, "nothing here")
    s = parse.markdown_sections(d)
    it = extract.items(s).cache()
    ids = {r.item_id: (r.text, r.confidence) for r in it.collect()}
    assert ids["p0:result:1"] == ("12 rings", 1.0) and ids["p0:experiment:2"] == ("again", 1.0)
    assert ids["p0:claim:1"] == ("나무", 1.0) and ids["p0:limitation:1"] == ("Only oak", 0.35)
    rel = extract.method_concept_relations(it)
    assert [(r.source, r.target, r.page) for r in rel.collect()] == [("p0:method:1", "p0:concept:1", None)]
    t = parse.document_titles(d)
    n, e = graph.nodes(t, it), graph.edges(it, rel)
    graph.check(n, e)
    assert n.count() == 8 and e.count() == 6
    with pytest.raises(ValueError, match="duplicate node id: p0"):
        graph.check(n.unionByName(n.where("id = 'p0'")), e)
    with pytest.raises(ValueError, match="no node: p0:concept:1"):
        graph.check(n.where("type <> 'Concept'"), e)
    a = {r.paper_id: r for r in report.assessment(t, it).collect()}
    assert a["p0"].coverage == 100 and a["p0"].missing == "없음" and a["p1"]["items"] == 0 and a["p1"].coverage == 0
    assert report.ask("which methods?", n) == "- count rings of oak"
    assert report.ask("hello", n) == report.UNKNOWN
    assert "정보가 없습니다" in report.ask("claim?", n.where("type <> 'Claim'"))
    sinks.write_graph_json(n, e, f"{tmp_path}/g.json")
    import json

    g = json.loads((tmp_path / "g.json").read_text())
    assert len(g["nodes"]) == 8 and g["edges"][-1]["type"] == "uses" and g["nodes"][0]["page"] is None
    sinks.write_evidence_matrix(report.evidence_matrix(t, it), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).count() == 6


def test_whole_concepts_are_matched(spark, tmp_path):
    from paperloom.plans.queries import QUERIES

    text = "# T\n## Methods\n- Method: a graph of Red Oak\n- Method: rings\n- Concept: red oak\n- Concept: blue oak\n- Concept: oak rings\n"
    spark.createDataFrame([(1, text), (2, "# U\n- Method: blue oak\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {k: [(r.source, r.target) for r in QUERIES[k](spark, str(tmp_path)).collect()] for k in ("method_concept_relations", "graph_edges", "dangling_edges")}
    assert got["method_concept_relations"] == [("1:method:1", "1:concept:1")]
    assert sorted(got["graph_edges"]) == [("1", "1:method:1"), ("1", "1:method:2"), ("1:method:1", "1:concept:1"), ("2", "2:method:1")]
    assert sorted(got["dangling_edges"]) == sorted(got["graph_edges"])


def cand(**over):
    base = dict(candidate_id="c", source_dataset="scier", paper_id="p", section="s", chunk_id="k", chunk_text="The parser beats the tagger on news.", label_bucket="methods", label_text="parser", evidence_span="the parser", relation_type="", source_id="", target_id="", source_label="{}", title="", label_id="")
    return Row(**(base | over))


@pytest.mark.parametrize(
    ("over", "name", "status", "reason"),
    [
        ({}, "standard", "accept", "entity_with_exact_evidence"),
        ({"label_bucket": "claims", "label_text": "no"}, "standard", "reject", "weak_atomic_label"),
        ({"label_bucket": "relations", "source_dataset": "scirex", "label_text": '{"Method": "a", "Task": "b"}', "relation_type": "x"}, "standard", "edit", "raw_document_relation_needs_endpoint_mapping"),
        ({"label_bucket": "relations", "relation_type": "supports", "source_dataset": "scifact"}, "standard", "accept", "claim_relation_with_evidence"),
        ({"label_bucket": "relations", "relation_type": "Used-For", "source_id": "a", "target_id": "b"}, "strict-edit-pass", "accept", "strict_typed_relation_exact_endpoints_evidence"),
        ({"label_bucket": "claims", "label_text": "a, b, c, d", "evidence_span": ""}, "strict-edit-pass", "reject", "strict_claim_not_sentence_or_exact_evidence"),
        ({"label_bucket": None, "chunk_text": None, "label_text": None, "evidence_span": None, "source_label": None}, "standard", "reject", "invalid_bucket"),
    ],
)
def test_harness(spark, over, name, status, reason):
    schema = ", ".join(f"{k} string" for k in cand().asDict())
    out = harness.label(spark.createDataFrame([tuple(cand(**over))], schema), name).first()[harness.HARNESSES[name][0]]
    assert out.status == status and reason in out.reason_codes


def test_unknown_harness(spark):
    with pytest.raises(ValueError, match="unknown harness"):
        harness.label(spark.createDataFrame([("c",)], "candidate_id string"), "x")


def greedy(pool, n):
    """One of each paper first, then the rest, both in order."""
    papers, first, rest = set(), [], []
    for c in pool:
        (rest if c[1] in papers else first).append(c)
        papers.add(c[1])
    return {c[0] for c in (first + rest)[:n]}


def test_diverse_sample_is_the_greedy_one(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(f"c{i}", "d", "b", f"p{rng.randrange(4)}", ["h"] * rng.randrange(3)) for i in range(40)]
    df = spark.createDataFrame(rows, "candidate_id string, source_dataset string, target_bucket string, paper_id string, hard_cases array<string>")
    order = sorted(rows, key=lambda r: (-len(r[4]), hashlib.sha256(f"13|{r[0]}".encode()).hexdigest(), r[3], r[0]))
    for n in (1, 3, 4, 9, 50):
        got, deficits = sampling.sample(df, {"d": {"b": n}}, backfill=False)
        assert {r.candidate_id for r in got.collect()} == greedy([(r[0], r[3]) for r in order], n)
        assert [r.deficit for r in deficits.collect()] == ([n - 40] if n > 40 else [])
    full, _ = sampling.sample(df, {"d": {"b": 5, "none": 3}})
    assert full.count() == 8


def test_exhausted_source_is_made_up_by_all(spark, tmp_path):
    """The registered sample over tables with too few rows of every source but one, against a plain one."""
    import hashlib

    from paperloom.plans.queries import QUERIES

    rng = random.Random(5)
    rows = [(f"c{i}", "scier" if i < 400 else "scifact", rng.choice(["methods", "concepts", "supports"]), f"p{rng.randrange(30)}", ["h"] * rng.randrange(3)) for i in range(410)]
    df = spark.createDataFrame(rows, "candidate_id string, source_dataset string, target_bucket string, paper_id string, hard_cases array<string>")
    df.withColumn("ingested_at", F.current_timestamp()).write.parquet(f"{tmp_path}/candidates.parquet")
    order = lambda seed, pool: [(r[0], r[3]) for r in sorted(pool, key=lambda r: (-len(r[4]), hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest(), r[3], r[0]))]
    want, total = {}, sum(n for per in sampling.TARGETS.values() for n in per.values())
    for ds, per in sampling.TARGETS.items():
        for b, n in per.items():
            want |= dict.fromkeys(greedy(order(13, [r for r in rows if r[1:3] == (ds, b)]), n), "target")
    first = set(want)
    for ds, per in sampling.TARGETS.items():
        n = sum(per.values()) - sum(r[0] in first and r[1] == ds for r in rows)
        want |= dict.fromkeys(greedy(order(14, [r for r in rows if r[1] == ds and r[0] not in first]), n), "dataset")
    want |= dict.fromkeys(greedy(order(15, [r for r in rows if r[0] not in want]), total - len(want)), "global")
    got = [(r.candidate_id, r.pick) for r in QUERIES["stratified_sample"](spark, str(tmp_path)).collect()]
    assert len(got) == total and dict(got) == want and set(want.values()) == {"target", "dataset", "global"}


def test_targets():
    assert sampling.parse_target("a.b=3", {"a": {"c": 1}}) == {"a": {"c": 1, "b": 3}}
    for bad in ("a=3", "a.b", "a.b=-1"):
        with pytest.raises(ValueError, match="DATASET"):
            sampling.parse_target(bad, {})


def test_split_is_by_paper_and_examples(spark):
    rows = [cand(candidate_id="a"), cand(candidate_id="b", label_bucket="claims"), cand(candidate_id="d", chunk_id=None)]
    auto = harness.label(spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{k} string" for k in cand().asDict())))
    m = sft.merge_labels(auto, harness.label(auto, "strict-edit-pass", "edit").select("candidate_id", "strict_auto_label"))
    x = {r.chunk_id: r for r in sft.extractor_examples(m).collect()}
    assert set(x) == {"k", "d"} and '"methods":[{"evidence_span":"the parser"' in x["k"].messages[2].content
    assert {r.split for r in sft.judge_examples(m).collect()} == {x["k"].split}


def test_validity(spark):
    full = "{" + ",".join(f'"{k}":[]' for k in sft.KEYS) + "}"
    texts = ["```json\n" + full + "\n```", "x " + full + " y", full.replace('"claims":[]', '"claims":{}'), "{bad", "[1]", None]
    got = sft.validity(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")).orderBy("chunk_id").collect()
    assert [(r.json_valid, r.schema_ok) for r in got] == [(True, True), (True, True), (True, False), (False, False), (False, False), (False, False)]


def test_corpora(spark):
    claims = spark.createDataFrame([("train", 1, "Oak  is hard", {"7": [("SUPPORT", [1, 9, -1]), ("X", [])], "8": [("SUPPORT", [0])]})], "split string, id long, claim string, evidence map<string,array<struct<label:string,sentences:array<int>>>>")
    corpus = spark.createDataFrame([(7, "T", ["a", "oak b"], True)], seeds.CORPUS)
    chunks, ev, seed = seeds.claim_corpus(claims, corpus)
    assert [(r.id, r.evidence_span, r.relation_type) for r in ev.collect()] == [("scifact-train-1-7-1", "oak b", "supports")]
    assert chunks.count() == 1 and sampling.candidates(seed).first().label_text == "Oak is hard"
    rows = spark.createDataFrame([("train", 1, "d", "Oak beats pine", [["oak", "Method"], ["pine", "Task"], ["OAK", "Method"]], None, [["Oak:Method", "beats", "pine"], ["x", "y", "pine"]])], f"split string, row_idx long, {seeds.SENTENCE}")
    _, ents, made = seeds.sentence_corpus(rows)
    r = made.first().labels.relations
    assert ents.count() == 3 and len(r) == 1 and r[0].source_id == "method-scier-d-1-3" and r[0].target_id == "concept-scier-d-1-2"
    rows = spark.createDataFrame([("train", 1, "d", None, None, [["a", "b"], ["c"]], "[[[0,2,\"Method\"],[1,9,\"Task\"]]]", None, ['{"Method":"a"}', '["q"]', "text"], None)], f"split string, row_idx long, {seeds.FULL_DOCUMENT}")
    _, ents, made = seeds.document_corpus(rows)
    assert {r.text for r in ents.collect()} == {"a b", "b c"} and len(made.first().labels.relations) == 2


def test_claims_reach_every_sentence_of_their_paper(spark, tmp_path):
    from paperloom.plans.queries import QUERIES

    texts = {1: "a\nb\nc\nd\ne\nf\ng", 2: "h", 3: "\n \ni\nj", 4: "other"}
    spark.createDataFrame([(i, "scifact", "q" if i == 4 else "p", x) for i, x in texts.items()], "doc_id long, source_dataset string, paper_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = spark.createDataFrame([("c1", "scifact", "p", "supports", "Oak"), ("c2", "scifact", "p", None, "Elm"), ("c3", "scifact", "none", "supports", "Ash"), ("c4", "scifact", "q", "supports", " ")], "candidate_id string, source_dataset string, paper_id string, relation_type string, label_text string")
    c.withColumn("ingested_at", F.current_timestamp()).write.parquet(f"{tmp_path}/candidates.parquet")
    spans = [("1", "a b"), ("1", "c d"), ("1", "e f"), ("1", "g"), ("2", "h"), ("3", "i j")]
    got = sorted(tuple(r) for r in QUERIES["claim_evidence_join"](spark, str(tmp_path)).collect())
    assert got == sorted((claim, doc, kind, x) for claim, kind in (("Oak", "supports"), ("Elm", "related_to")) for doc, x in spans)
    assert {r.chunk_id for r in QUERIES["used_docs"](spark, str(tmp_path)).collect()} == {f"scifact:{i}:abstract" for i in (1, 2, 3)}


def test_locate(spark):
    ev = spark.createDataFrame([(1, "p", "Red Oak"), (2, "p", "one two three four five six"), (3, "p", "one two"), (4, "p", "")], "ev_id int, paper_id string, evidence_span string")
    ch = spark.createDataFrame([("p", "a", 0, "a red oak"), ("p", "b", 1, "red oak one two three four x"), ("p", "c", 2, "one two three four y")], "paper_id string, chunk_id string, chunk_ord int, chunk_text string")
    assert {(r.ev_id, r.chunk_id, r.match) for r in seeds.locate(ev, ch).collect()} == {(1, "a", "exact"), (2, "b", "overlap"), (3, "b", "exact")}


def test_every_document_is_ingested(spark, tmp_path):
    """The folder reader and the stream give the items of the table itself."""
    from paperloom.plans.queries import QUERIES

    texts = [PAPER, "nothing here", "# 나무\r\n## Methods\nCount rings. Then stop.\x85- Concept: 나이테", "", None, *(PAPER.replace("oak", f"oak {n}") for n in range(9))]
    spark.createDataFrame([(i * 7, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.createDataFrame([(i * 7, str(i * 7), x) for i, x in enumerate(texts)], "doc_idx long, paper_id string, text string")
    want = sorted((r.paper_id, r.item_id, r.text) for r in extract.items(parse.markdown_sections(table)).collect())
    assert {w[0] for w in want} >= {"0", "14", "91"}
    for name in ("directory_ingest", "stream_items"):
        assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_questions_of_all_papers(spark, tmp_path):
    from paperloom.plans.queries import QUERIES

    at = lambda df, name: df.withColumn("ingested_at", F.current_timestamp()).write.parquet(f"{tmp_path}/{name}.parquet")
    at(spark.createDataFrame([("qasper", "1.5", "T"), ("qasper", "1.5", "T"), ("qasper", "2", None), ("scier", "2", "other")], "source_dataset string, paper_id string, title string"), "papers")
    sec = [("a", "1.5", 2, "Intro", "Oak grows.\n\nThe graph method works \"well\"."), ("b", "1.5", 1, "", "First\n\n\n\nThird part"), ("b", "1.5", 1, "", "First\n\n\n\nThird part"), ("c", "2", 1, "A", "No limits."), ("d", "2", 2, "B", None)]
    at(spark.createDataFrame([("qasper", *x) for x in sec], "source_dataset string, section_id string, paper_id string, section_idx int, title string, text string"), "sections")
    c = [
        ("c1", "1.5", "How does it work?", "graph | oak", "graph  METHOD"), ("c2", "1.5", "How does it work?", "Well", "third part"), ("c3", "1.5", "Is it so?", "yes", "Oak"), ("c4", "2", "What fails?", "No", "no limits."),
        ("c5", "2", None, "unanswerable", "limits"), ("c6", "2", "Q?", None, "limits"), ("c7", "2", "Q?", "x", None), ("c8", "1.5", "Q?", "x", "no such place"), ("c9", "9", "Q?", "x", "limits"),
    ]
    at(spark.createDataFrame([("qasper", *x) for x in c], "source_dataset string, candidate_id string, paper_id string, question string, label_text string, evidence_span string"), "candidates")
    assert sorted(tuple(r) for r in QUERIES["qa_corpus_records"](spark, str(tmp_path)).collect()) == [
        ("qasper-train-1-5-1-1-1", "1.5", "methods", "graph | oak", "graph METHOD", "1.5:s2:p2"), ("qasper-train-1-5-1-1-2", "1.5", "methods", "graph | oak", "graph", "1.5:s2:p2"),
        ("qasper-train-1-5-1-1-3", "1.5", "methods", "graph | oak", "oak", "1.5:s2:p1"), ("qasper-train-1-5-1-2-1", "1.5", "methods", "Well", "third part", "1.5:s1:p3"),
        ("qasper-train-1-5-2-1-1", "1.5", "claims", "yes", "Oak", "1.5:s2:p1"), ("qasper-train-2-1-1-1", "2", "limitations", "no", "no limits.", "2:s1:p1"), ("qasper-train-2-2-1-1", "2", "claims", "unanswerable", "limits", "2:s1:p1"),
    ]


def test_papers_share_files(spark, tmp_path, monkeypatch):
    """Files grow with the text of all papers, not with their number."""
    from paperloom.plans import queries

    texts = {str(i): f'a "{i}" \\ {{나무}}' for i in range(500)}
    papers = spark.createDataFrame([(k, x) for k, x in texts.items()], "k string, x string").repartition(2)
    members = papers.select(F.to_json(F.create_map("k", F.struct("x"))).alias("b")).selectExpr("substring(b, 2, length(b) - 2) as member")
    for size, most in ((1 << 20, 2), (3000, 30)):
        (folder := tmp_path / str(size)).mkdir()
        monkeypatch.setattr(queries, "MAP_CHARS", size)
        for _ in range(2):  # a task that runs again leaves nothing twice
            queries._write_maps(members, str(folder))
        assert len(list(folder.iterdir())) <= most
        got = [(r.key, r.value.x) for r in readers.json_map(spark, f"{folder}/", "struct<x:string>").collect()]
        assert sorted(got) == sorted(texts.items())


def test_question_corpus_in_both_forms(spark, tmp_path):
    body = '{"p1":{"title":"T","full_text":[{"section_name":"Intro","paragraphs":["The graph method works well on five held out sets.",""]}],"qas":[{"question":"How does it work?","question_id":"q1","answers":[{"answer":{"extractive_spans":["graph method"],"evidence":["The graph method works well"]}}]}]},"p0":{"title":"U","full_text":{"section_name":["A"],"paragraphs":[["No limits."]]},"qas":{"question":["What fails?"],"question_id":["z"],"answers":[[{"answer":{"yes_no":false,"evidence":["No limits."]}}]]}}}'
    (tmp_path / "train.json").write_text(body)
    papers = readers.by_split({"train": readers.json_map(spark, f"{tmp_path}/train.json", seeds.QA_PAPER).select("pos", F.col("key").alias("paper_id"), "value.*")})
    assert {(r.paper_id, r.answer_text, r.chunk_id) for r in seeds.question_corpus(papers)[1].collect()} == {("p1", "graph method", "p1:s1:p1"), ("p0", "no", "p0:s1:p1")}


def test_json_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"x": 1}\n\n[2]\n{"x": 3}\n')
    assert [r.x for r in readers.json_lines(spark, str(f), "x int", strict=False).collect()] == [1, 3]
    with pytest.raises(Exception, match=r"no JSON object in .*a.jsonl.*\[2\]"):
        readers.json_lines(spark, str(f), "x int").collect()
    f.write_text('{"x": 1, "y": "a"}\n{"x": 1, "y": "b"}\n{bad\n')
    with pytest.raises(Exception, match=r"no JSON in .*a.jsonl.*\{bad"):
        readers.json_lines(spark, str(f), "x int, y string").collect()
    f.write_text('{"x": 1, "y": "a"}\n{"x": 1, "y": "b"}\n')
    assert readers.last_per_key(readers.json_lines(spark, str(f), "x int, y string"), "x").first().y == "b"


def test_lines_are_numbered_across_parts_and_bounded(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"x": {i}, "s": "{name}"}}\n\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.json_lines(spark, f"{tmp_path}/*.jsonl", "x int, s string").withColumn("split", F.lit("t"))
        assert rows.select("_part").distinct().count() > 3
        got = sorted((r.row_idx, r.s, r.x) for r in seeds.numbered(rows).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, "a", i) for i in range(400)] + [(400 + i + 1, "b", i) for i in range(3)]
    assert [r.x for r in readers.json_lines(spark, f"{tmp_path}/a.jsonl", "x int", limit=5).collect()] == [0, 1, 2, 3, 4]


def test_repeated_strict_labels(spark, tmp_path):
    f = tmp_path / "strict.jsonl"
    f.write_text("".join(f'{{"candidate_id": "{i}", "strict_auto_label": {{"status": "{x}"}}}}\n' for i, x in (("c1", "reject"), ("c2", "edit"), (" c1 ", "accept"))))
    from paperloom import cli

    auto = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "candidate_id string").withColumn("auto_label", F.lit(None).cast(sft._DECISION))
    got = {r.candidate_id: r.effective.status for r in sft.merge_labels(auto, cli.read_candidates(spark, str(f), places=True)).collect()}
    assert got == {"c1": "accept", "c2": "edit", "c3": "reject"}


def test_files_below_a_folder_and_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    deep = tmp_path / "raw" / "x"
    deep.mkdir(parents=True)
    (deep / "train.jsonl").write_text("{}")
    assert readers.split_file(spark, f"{tmp_path}/raw", "train.jsonl").endswith("/raw/x/train.jsonl")
    with pytest.raises(FileNotFoundError, match="dev.jsonl"):
        readers.split_file(spark, f"{tmp_path}/raw", "dev.jsonl")
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        t.add(deep / "train.jsonl", "d/train.jsonl")
    readers.unpack(f"{tmp_path}/a.tgz", f"{tmp_path}/out")
    assert (tmp_path / "out" / "d" / "train.jsonl").exists()
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        t.addfile(tarfile.TarInfo("../evil"), io.BytesIO())
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("ok", "1")
        z.writestr("../evil", "1")
    for name in ("b.tar", "c.zip"):
        with pytest.raises(ValueError, match="unsafe path"):
            readers.unpack(f"{tmp_path}/{name}", f"{tmp_path}/out2")
    assert not (tmp_path / "evil").exists() and not (tmp_path / "out2" / "ok").exists()
    with pytest.raises(ValueError, match="no supported document format: .csv"):
        readers.document_file(spark, f"{tmp_path}/x.csv")
    (tmp_path / "p.TXT").write_text("one")
    assert readers.document_file(spark, f"{tmp_path}/p.TXT").first().paper_id == "p"


def test_locate_is_that_of_brute_force(spark):
    import re

    rng = random.Random(7)
    words = ["oak", "art", "party", "x", "yz", "red", "tree", "of", "the", "a", "3d", "7"]
    chunks = [(p, f"{p}{i}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) + rng.choice(["", " -- .", "..."])) for p in "pq" for i in range(25)]
    spans = ["art", "ar", "x y", "--", "RED  tree", "t", "", "oak of", "of the a", "7 3d", "absent"]
    spans += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(90)]
    ev = [(i, rng.choice("pq"), s) for i, s in enumerate(spans * 2)]
    want = set()
    for i, p, s in ev:
        needle = " ".join(s.lower().split())
        hold = [c for c in chunks if c[0] == p and needle and needle in c[3].lower()]
        t = set(re.findall("[a-z0-9]+", needle))
        score = [(len(t & set(re.findall("[a-z0-9]+", c[3].lower()))) / len(t), -c[2], c[1]) for c in chunks if c[0] == p] if len(t) >= 5 else []
        if hold:
            want.add((i, min(hold, key=lambda c: c[2])[1], "exact", 1.0))
        elif score and max(score)[0] >= 0.65:
            want.add((i, max(score)[2], "overlap", max(score)[0]))
    e = spark.createDataFrame(ev, "ev_id int, paper_id string, evidence_span string")
    c = spark.createDataFrame(chunks, "paper_id string, chunk_id string, chunk_ord int, chunk_text string")
    assert {tuple(r) for r in seeds.locate(e, c).select("ev_id", "chunk_id", "match", "overlap").collect()} == want
    assert {"exact", "overlap"} <= {w[2] for w in want}


@pytest.mark.parametrize("most", [0, 30, 100_000])
def test_locate_in_small_and_large_papers(spark, monkeypatch, most):
    """One result, wherever the bound of small papers is; order of chunks by any type."""
    import re

    monkeypatch.setattr(seeds, "MEET_ALL", most)
    rng = random.Random(most)
    words = ["oak", "ïda", "나무", "red", "tree", "of", "the", "a", "3d", "x", "x\u0301y"]
    chunks = [(p, f"{p}-{i}", rng.choice([" ", "  ", "-"]).join(rng.choice(words) for _ in range(rng.randint(0, 16)))) for p, n in (("p", 40), ("q", 3), ("r", 20)) for i in range(n)]
    spans = ["", "나", "--", "absent", None, "d x", "A  tree of"]
    for _, _, x in rng.choices([c for c in chunks if c[2]], k=120):
        a, b = sorted(rng.choices(range(len(x) + 1), k=2))
        spans += [x[a:b], " ".join(rng.sample(x.split(), len(x.split())))]
    ev = [(i, rng.choice("ppprq"), s) for i, s in enumerate(spans)]
    want = set()
    for i, p, s in ev:
        needle, own = " ".join((s or "").lower().split()), sorted(c for c in chunks if c[0] == p)
        hold = [c for c in own if needle and needle in c[2].lower()]
        t = set(re.findall("[a-z0-9]+", needle))
        score = [(-len(t & set(re.findall("[a-z0-9]+", c[2].lower()))) / len(t), c[1]) for c in own] if len(t) >= 5 else []
        if hold:
            want.add((i, hold[0][1], "exact", 1.0))
        elif score and min(score)[0] <= -0.65:
            want.add((i, min(score)[1], "overlap", -min(score)[0]))
    e = spark.createDataFrame(ev, "ev_id int, paper_id string, evidence_span string")
    c = spark.createDataFrame(chunks, "paper_id string, chunk_id string, chunk_text string").withColumn("chunk_ord", F.col("chunk_id"))
    assert {tuple(r) for r in seeds.locate(e, c).select("ev_id", "chunk_id", "match", "overlap").collect()} == want
    assert len({w[2] for w in want}) == 2


def test_locate_writes_no_tokens_of_small_papers(spark):
    """Of papers with a few chunks each, nothing but the rows themselves is moved."""
    from pathlib import Path

    from paperloom.sources import staging

    folder = lambda: sum(p.stat().st_size for p in Path(staging.shared_folder(spark).removeprefix("file:")).rglob("part-*.parquet"))
    c = spark.range(3000).select(F.concat(F.lit("p"), F.floor(F.col("id") / 3)).alias("paper_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("chunk_ord"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.substring(F.sha1(F.concat_ws(",", "id", i)), 1, 7)), " ").alias("chunk_text"))
    e = c.select(F.col("chunk_id").alias("ev_id"), "paper_id", F.substring("chunk_text", 20, 60).alias("evidence_span"))
    before = folder()
    assert seeds.locate(e, c).where("match = 'exact' and ev_id = chunk_id").count() == 3000
    assert folder() - before < 300_000


def test_locate_normalizes_spans_once(spark):
    """Neither phase reads the spans as they came again, by overlap or exactly."""
    words = "one two three four five six seven eight"
    e = spark.createDataFrame([("a", "p", f" {words.upper()}"), ("b", "p", "three  four"), ("c", "p", "nine ten one two three")], "ev_id string, paper_id string, evidence_span string")
    c = spark.createDataFrame([("p", "1", "x one three four five six seven eight"), ("p", "0", "seven six five four three one"), ("p", "2", "THREE four")], "paper_id string, chunk_id string, chunk_text string").withColumn("chunk_ord", F.col("chunk_id"))
    found = seeds.locate(e, c, stage=True).where("match = 'overlap'")
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ev_id, r.chunk_id, r.overlap) for r in found.collect()] == [("a", "1", 7 / 8)]


def test_commands_of_the_pipeline(spark, tmp_path, capsys):
    """seed, sample, label (both harnesses), sft and eval-json, each on the files of the one before."""
    from paperloom import cli

    raw = tmp_path / "raw" / "below"
    raw.mkdir(parents=True)
    (raw / "corpus.jsonl").write_text('{"doc_id": 7, "title": "T", "abstract": ["Oak is red.", "Pine improves oak trees over all of the other trees here."], "structured": false}\n')
    claim = lambda i, text, label: json.dumps({"id": i, "claim": text, "evidence": {"7": [{"label": label, "sentences": [1]}]}}) + "\n"
    for split in ("train", "validation", "test"):
        (raw / f"{split}.jsonl").write_text(claim(1, "Pine improves oak", "SUPPORT") + "[]\n" + claim(2, "Oak is blue", "CONTRADICT") + claim(3, "Other", ""))
    cli.main(["seed", "scifact", "--raw-dir", f"{tmp_path}/raw", "--out-dir", f"{tmp_path}/seeds/scifact"])
    manifest = json.loads((tmp_path / "seeds" / "scifact" / "manifest.json").read_text())
    assert manifest["source"] == "scifact" and manifest["rows"] == {"chunks": 1, "evidence": 9, "seeds": 9}
    part = next(p for p in (tmp_path / "seeds" / "scifact" / "seeds").iterdir() if p.name.endswith(".json"))
    rows = "".join(p.read_text() for p in sorted((tmp_path / "seeds" / "scifact" / "seeds").iterdir()) if p.suffix == ".json")
    assert part.exists() and "_line" not in rows
    (tmp_path / "root" / "scifact").mkdir(parents=True)
    (tmp_path / "root" / "scifact" / "seeds.jsonl").write_text(rows)
    args = ["sample", "--seed-root", f"{tmp_path}/root", "--out", f"{tmp_path}/cand", "--review-csv", f"{tmp_path}/review", "--target", "scifact.supports=2", "--target", "scifact.contradicts=2"]
    cli.main([*args, "--dry-run"])
    assert not (tmp_path / "cand").exists() and "scifact.relations: 4" in capsys.readouterr().out
    cli.main(args)
    lines = lambda folder: [json.loads(x) for p in sorted((tmp_path / folder).glob("*.json")) for x in p.read_text().splitlines()]
    picked = lines("cand")
    assert len(picked) == 4 and all(r["candidate_id"].startswith("cand-") for r in picked)
    review = "".join(p.read_text() for p in sorted((tmp_path / "review").glob("*.csv")))
    assert review.startswith(",".join(harness.REVIEW)) and "Pine improves oak" in review
    cli.main(["label", "--candidates", f"{tmp_path}/cand", "--out-csv", f"{tmp_path}/auto_csv", "--out-jsonl", f"{tmp_path}/auto"])
    assert "accept: 4" in capsys.readouterr().out and all("_file" not in r for r in lines("auto"))
    cli.main(["label", "--candidates", f"{tmp_path}/auto", "--harness", "strict-edit-pass", "--only-auto-status", "accept", "--out-csv", f"{tmp_path}/strict_csv", "--out-jsonl", f"{tmp_path}/strict"])
    assert len(lines("strict")) == 4 and lines("strict")[0]["strict_auto_label"]["status"] == "accept"
    cli.main(["sft", "--autolabeled", f"{tmp_path}/auto", "--strict", f"{tmp_path}/strict", "--out-dir", f"{tmp_path}/train"])
    stats = json.loads((tmp_path / "train" / "sft_stats.json").read_text())
    assert stats["input_rows"] == 4 and stats["status"] == {"accept": 4} and stats["judge_train"] + stats["judge_eval"] == 4
    full = json.dumps({k: [] for k in sft.KEYS})
    (tmp_path / "gen.jsonl").write_text("".join(json.dumps({"chunk_id": str(i), "text": x}) + "\n" for i, x in enumerate([f"ok {full}", "no", full])))
    capsys.readouterr()
    cli.main(["eval-json", "--generated", f"{tmp_path}/gen.jsonl", "--limit", "2"])
    out = json.loads(capsys.readouterr().out)
    assert (out["total"], out["json_valid"], out["schema_ok"]) == (2, 1, 1) and [r["chunk_id"] for r in out["results"]] == ["0", "1"]


def test_build_command(spark, tmp_path):
    from paperloom import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a-paper.md").write_text(PAPER, encoding="utf-8")
    cli.build(spark, f"{tmp_path}/in", f"{tmp_path}/out", "why oak?")
    assert "why oak?" in (tmp_path / "out" / "summary.md").read_text()
    assert "커버리지: 100%" in (tmp_path / "out" / "assessment.md").read_text()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("1")
    with pytest.raises(SystemExit):
        cli.build(spark, f"{tmp_path}/none", f"{tmp_path}/out2")
