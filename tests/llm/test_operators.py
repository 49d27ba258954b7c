"""Operators on Spark: brute force on small inputs, and inputs meant to break them."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import answer_defects, common, containers, format_variants, grouped_split, mixture, queries, sketch, split_overlap, target_sample
from paperloom.llm.split_overlap import lcs

T = dt.datetime(2024, 1, 1)
CANDIDATE = (
    "candidate_id string, source_dataset string, paper_id string, title string, section string, chunk_id string, chunk_text string, label_bucket string, target_bucket string, label_id string, label_text string, "
    "evidence_span string, relation_type string, source_id string, target_id string, seed_id string, question string, hard_cases array<string>, source_label string, created_at timestamp, ingested_at timestamp"
)
CHUNK = "chunk_id string, source_dataset string, paper_id string, title string, split string, section string, paragraph_index int, text string, created_at timestamp, ingested_at timestamp"
SECTION = "section_id string, source_dataset string, paper_id string, section_idx int, title string, text string, page int, created_at timestamp, ingested_at timestamp"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, source_dataset string, paper_id string, created_at timestamp, ingested_at timestamp"
SMALL = {
    "sampling_targets": ("source_dataset string, target_bucket string, target_permille int, min_rows int", [("scier", "methods", 600, 2), ("qasper", "claims", 400, 2)]),
    "mix_targets": ("source string, target_permille int, max_repeats int", [("a", 600, 2), ("b", 400, 1)]),
    "size_limits": ("limit_name string, limit_value int, unit string", [("piece_max", 1600, ""), ("piece_overlap", 120, ""), ("container_capacity", 2048, ""), ("train_share", 800, ""), ("validation_share", 100, ""), ("test_share", 100, "")]),
}
CLASHES = ["key", "id", "a", "b", "n", "no", "h", "ck", "words", "tokens", "size", "part", "train", "held", "take", "bucket", "ds", "_p", "_s", "_pid", "text_form", "evidence_span_form", "restored", "copies", "vertex", "group_key"]


def names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def row(schema, **values):
    return tuple(values.get(n) for n in names(schema))


def write(spark, folder, **tables):
    schemas = {"candidates": CANDIDATE, "chunks": CHUNK, "sections": SECTION, "documents": DOCUMENT}
    for name, schema in schemas.items():
        df = spark.createDataFrame(tables.get(name, []), schema)
        for c in CLASHES:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{folder}/{name}.parquet")
    for name, (schema, rows) in SMALL.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    long = ("long words without end " * 3000).strip()
    c = lambda i, **v: row(CANDIDATE, candidate_id=i, source_dataset="qasper", created_at=T, ingested_at=T, **v)
    candidates = [
        row(CANDIDATE), c("c0"), c("c1", question="", label_text="", evidence_span="", chunk_text="", chunk_id="", paper_id=" "), c("c1", question="", label_text="", evidence_span="", chunk_text="", chunk_id="", paper_id=" "),
        c("c2", question="Who?", label_text=long, evidence_span=long + "​", chunk_text=long, chunk_id="K 1", paper_id="p1", target_bucket=" Claims"),
        c("c3", question="Who?", label_text=long.upper(), evidence_span=long, chunk_text=long, chunk_id="k1", paper_id="p2", target_bucket="claims"),
        row(CANDIDATE, candidate_id="c4", label_text='{"a": 1, "b": null}', target_bucket="methods"), row(CANDIDATE, candidate_id="c5", label_text='{"b": null, "A": "1"}', target_bucket="methods"), c("c6", label_text="{broken"),
    ]
    chunk = lambda i, **v: row(CHUNK, chunk_id=i, **v)
    chunks = [chunk(None), chunk("k1", split=" TEST ", text=long), chunk("k2", split="Train", text=long + " more"), chunk("k2", split="Train", text=long + " more"), chunk("k3", split=None, text=long), chunk("k4", split="train", text=None), chunk("", split="test", text="")]
    sections = [row(SECTION), row(SECTION, section_id="s1", text="\r\n " + "x" * 5000 + "\t"), row(SECTION, section_id="s1", text="\r\n " + "x" * 5000 + "\t"), row(SECTION, section_id="s2", text=" ")]
    documents = [row(DOCUMENT), row(DOCUMENT, doc_id=1), row(DOCUMENT, doc_id=2, text="", source="a"), row(DOCUMENT, doc_id=3, text=long, source=" A "), row(DOCUMENT, doc_id=3, text=long, source=" A "), row(DOCUMENT, doc_id=4, text="Ã©" * 9 + " fa�ade", source="b"), row(DOCUMENT, doc_id=5, text="one line", source="b")]
    return write(spark, tmp_path_factory.mktemp("hostile"), candidates=candidates, chunks=chunks, sections=sections, documents=documents)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_hostile_tables(spark, hostile):
    q = {k: f(spark, hostile) for k, f in queries.QUERIES.items() if k not in ("p2_report", "p7_counts", "p4_shares")}
    assert rows(q["p1_found"]) == {("c2", "c3"), ("c4", "c5")} | {p for p in rows(q["p1_found"]) if p == ("c0", "c1")}
    assert ("c0", "c1") in rows(q["p1_found"])
    assert rows(q["p1_records"]) == {("c0", 2), ("c2", 2), ("c4", 2), ("c6", 1)}
    assert rows(q["p2_found"]) == {("k1", "k2"), ("c2", "k2"), ("c3", "k2")}
    assert rows(q["p3_found"]) == {("sections", "s1"), ("chunks", "k1"), ("chunks", "k2"), ("chunks", "k3")}
    assert rows(q["p4_found"]) == {("qasper", "p1", "p1"), ("qasper", "p1", "p2")}
    splits = {r.candidate_id: (r.group_key, r.split) for r in q["p4_splits"].collect()}
    assert set(splits) == {f"c{i}" for i in range(7)} and splits["c2"] == splits["c3"]
    assert rows(q["p5_found"]) == {("c2", "evidence_span")}
    assert q["p5_forms"].count() >= 7
    assert rows(q["p6_found"]) == {("scier", "methods")}
    assert rows(q["p6_sample"]) == {("c2", "qasper", "claims"), ("c3", "qasper", "claims")}
    found = dict(rows(q["p7_found"]))
    assert found["c0"] == found["c1"] == "empty" and "c4" not in found
    boxes = q["p8_containers"].collect()
    size = Counter()
    for b in boxes:
        size[b.container] += b.tokens
    assert max(size.values()) <= 2048 and {b.doc_id for b in boxes} == {1, 2, 3, 4, 5} and len({(b.doc_id, b.part) for b in boxes}) == len(boxes)
    assert q["p8_report"].first().lower_bound <= q["p8_report"].first().containers
    assert rows(q["p9_found"]) == {("b",)}
    mix = {r.doc_id: r.copies for r in q["p9_mix"].collect()}
    assert max(mix.values()) <= 2 and mix[4] == mix[5] == 1
    assert rows(q["p10_found"]) == {(4,)}


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path)
    for name, f in queries.QUERIES.items():
        n = f(spark, folder).count()
        assert n == 0 or name in ("p4_check", "p6_report", "p6_found", "p9_report", "p9_check", "p8_report", "p8_check", "p10_report"), name
    assert queries.QUERIES["p6_found"](spark, folder).count() == 2


def test_runs_that_cross_partitions(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + list("abcdefg")), f"i{rng.randrange(400)}") for _ in range(900)]
    data = [(k, f"{k}{i}") for k, i in data]
    groups = defaultdict(set)
    for k, i in data:
        groups[k].add(i)
    want = {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, "key string, id string").repartition(5)
        assert rows(format_variants.copy_pairs(df)) == want
        assert rows(format_variants.collapsed(df)) == {(min(v), len(v)) for v in groups.values()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlaps_are_those_of_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    data = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        data.append((f"k{i}", rng.random() < 0.6, "  ".join(w).title()))
    want = set()
    for k, train, a in data:
        for k2, train2, b in data:
            x, y = a.upper().split(), b.upper().split()
            if train and not train2 and x and y and 5 * lcs(x, y) >= 4 * max(len(x), len(y)):
                want.add((k, k2))
    assert rows(split_overlap.split_overlap(spark.createDataFrame(data, "key string, train boolean, text string"))) == want


def test_overlaps_of_texts_of_frequent_shingles(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(6)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 7, 8, 13, 16, 30, 32, 33, 62, 65, 130]))] for _ in range(40)]
    data = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        data.append((f"k{i}", rng.random() < 0.6, " ".join(w)))
    split = lambda train: [(k, w.upper().split()) for k, t, w in data if t == train and w]
    want = {(k, k2) for k, x in split(True) for k2, y in split(False) if 5 * lcs(x, y) >= 4 * max(len(x), len(y))}
    lengths = {k: len(w.split()) for k, _, w in data}
    assert {lengths[k].bit_length() - lengths[k2].bit_length() for k, k2 in want} == {-1, 0, 1}
    df = spark.createDataFrame(data, "key string, train boolean, text string")
    monkeypatch.setattr(split_overlap, "WHOLE", 0)  # ranges of lengths one after the other
    for few in (0, 5):  # no shingle is rare, or some are
        monkeypatch.setattr(split_overlap, "FEW", few)
        assert rows(split_overlap.split_overlap(df)) == want


def test_components_are_those_of_union_find(spark):
    rng = random.Random(4)
    edges = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    want = defaultdict(set)
    for x in {x for e in edges if e[0] != e[1] for x in e}:
        want[find(x)].add(x)
    got = defaultdict(set)
    for r in grouped_split.components(spark.createDataFrame(edges, "u string, v string")).collect():
        got[r.root].add(r.vertex)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_exact_takes_and_running_totals(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", i) for i in range(3000)], "g string, id int")
    quota = spark.createDataFrame([("g", 777), ("h", 5000)], "g string, take int")
    got = common.take_exactly(df, ["g"], quota, F.xxhash64("id"))
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"g": 777, "h": 1000}
    assert got.select("id").distinct().count() == 1777
    total = common.running_total(df, ["id"], "id", "before")
    assert all(r.before == r.id * (r.id - 1) // 2 for r in total.collect())


def test_reservoirs_merge_and_trim(spark):
    rng = random.Random(8)
    data = [(f"i{i}", "d", rng.choice("bbbbbc")) for i in range(3000)] + [(f"n{i}", "d", None) for i in range(50)]
    targets = [("d", "B", "b", 301, 3), ("d", "c", "c", 10, 9000), ("d", "x", "x", 1, 2)]
    rows = spark.createDataFrame(data + data[:900], "id string, ds string, bucket string")
    drawn = {r.id: r.p for r in rows.select("id", target_sample.priority(F.col("id")).alias("p")).collect()}
    of = {c: sorted((drawn[i], i) for i, _, b in data if b == c) for c in "bc"}
    want = {("b", i) for _, i in of["b"][: -(-301 * 610 // 1000)]} | {("c", i) for _, i in of["c"]}
    for parts in (1, 9):
        held, report, take = target_sample.sample(rows.repartition(parts), targets)
        assert report == [("d", "B", len(of["b"]), 184), ("d", "c", len(of["c"]), 9000), ("d", "x", 0, 2)]
        assert held.where("id is not null and cat = 0").count() <= len(of["b"])
        got = {("bcx"[r.cat], r.id) for r in target_sample.trimmed(held, list(take.values())).collect()}
        assert got == want


def test_reservoirs_are_bounded(spark):
    rows = spark.createDataFrame([(f"i{i}", "d", "b") for i in range(4000)], "id string, ds string, bucket string").coalesce(1)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        held = target_sample.reservoirs(rows, {("d", "b"): 25})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert held.where("id is not null").count() == 25 and held.agg(F.sum("seen")).first()[0] == 4000


@pytest.mark.parametrize("group_items", [20, 50, 100_000])
def test_containers_are_exchanged(spark, group_items):
    rng = random.Random(6)
    sizes = [rng.randint(0, 60) for _ in range(900)]
    items = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, part int, size long")
    apart = containers._filled(items, 100, -(-900 // group_items), 0).select("container").distinct().count()
    got = containers.pack(items, 100, group_items).collect()
    held = Counter()
    for r in got:
        held[r.container] += r.size
    assert sorted(r.doc_id for r in got) == list(range(900)) and max(held.values()) <= 100
    bound = containers.bound_of(items, 100)
    assert bound <= len(held) <= apart and len(held) <= 1.02 * bound
    assert group_items > 900 or len(held) < apart  # the exchange gained


def test_sketch_is_summed_in_a_tree(spark):
    data = spark.createDataFrame([(i % 37,) for i in range(2000)], "n long").repartition(23)
    got = sketch.hashed_counts(data, lambda rb: [rb.column(0).to_numpy(), rb.column(0).to_numpy() % 5], 2, 17, fan=3)
    assert got[0].tolist()[:37] == [2000 // 37 + (i < 2000 % 37) for i in range(37)] and got[0].sum() == 2000
    assert got[1].tolist()[:5] == [sum(got[0][i] for i in range(37) if i % 5 == k) for k in range(5)]


def test_long_documents_are_mixed_by_sums(spark, monkeypatch):
    monkeypatch.setattr(mixture, "LONG", 50)
    rng = random.Random(3)
    docs = [(i, rng.choice("ab"), rng.choice([3, 7, 20, 60, 300])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    (a, b), takes, long = mixture.plan(df, [("a", 300, 2), ("b", 100, 1)])
    assert all(0 <= r[1] - r[4] <= 3 and not r[5] for r in (a, b))
    assert sum(n * k for (s, n), k in takes.items() if s == "b") + sum(r.tokens for r in long.collect() if r.source == "b") == b[4]
    assert {r.tokens for r in long.collect()} == {60, 300} and all(n <= 50 for _, n in takes)


def test_nested_objects_and_separators(spark):
    rows = [("a", "x", '{"p": {"b": 1, "a": [1, 2]}, "q": 2}'), ("b", "x", '{"Q": "2", "p": {"a": [1, 2], "b": 1}}'), ("c", "x", '{"p": {"b": 2, "a": [1, 2]}, "q": 2}'), ("d", "x\x1fy", "z"), ("e", "x", "y\x1fz"), ("f", None, None), ("g", "", " ")]
    df = spark.createDataFrame(rows, "id string, ds string, label string")
    made = format_variants.canonical(df, "id", ["ds"], ["label"], ["label"])
    assert rows_of(format_variants.copy_pairs(made)) == {("a", "b"), ("f", "g")}


def test_heavy_groups_are_split_like_others(spark, monkeypatch):
    rng = random.Random(2)
    c = [(f"c{i}", "d", f"p{rng.choice([0, 0, 0, rng.randrange(1, 60)])}", f"k{rng.randrange(400)}") for i in range(500)]
    df = spark.createDataFrame(c, "candidate_id string, source_dataset string, paper_id string, chunk_id string")
    made = []
    for heavy in (1, 4, 1000):
        monkeypatch.setattr(grouped_split, "HEAVY", heavy)
        made.append(rows_of(grouped_split.grouped_split(df, [("train", 8), ("validation", 1), ("test", 1)])))
    assert made[0] == made[1] == made[2] and len(made[0]) == 500
    assert len({(g, s) for _, g, s in made[0]}) == len({g for _, g, _ in made[0]})


def test_profiles_are_learned_from_labelled_texts(spark):
    texts = {"en": "the model is used in the data set", "de": "die neuen Modelle werden mit den Daten verglichen"}
    docs = [(i, t if i % 9 else None, lang.upper() if i % 2 else lang) for i, (lang, t) in enumerate(list(texts.items()) * 40)] + [(900, "odd", "und"), (901, "odd", None), (902, "", "fr")]
    p = answer_defects.learned(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert p.languages == ["de", "en"]
    ask = "which model is used in the set".split()
    assert p.other(p.language(ask), ask, "die neuen daten werden verglichen".split()) and not p.other(p.language(ask), ask, "the data is used".split())


def rows_of(df):
    return {tuple(r) for r in df.collect()}
