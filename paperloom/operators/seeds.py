"""Converters of four kinds of annotated corpora to chunks, evidence and seed rows.

Each takes parsed rows (see the schemas) and gives DataFrames; missing fields are null and
give no rows, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_filled, norm, slug, tokens
from ..sources.staging import staged
from .sampling import BUCKETS, LABEL

# Cues of a question's label type, in order, and the least word overlap.
QUESTION_CUES = {
    "methods": ["method", "approach", "algorithm", "model", "how"],
    "experiments": ["result", "performance", "score", "accuracy", "improvement", "experiment"],
    "limitations": ["limitation", "fail", "error", "weakness", "future work"],
}
LEAST_OVERLAP, LEAST_TOKENS = 0.65, 5
#: Of a span's rarest tokens, as many as a chunk must share to be compared.
SHARED = 3
#: Spans times chunks of a paper up to which every span simply meets every chunk.
MEET_ALL = 100_000

ANSWER = "struct<extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,unanswerable:boolean,evidence:array<string>,highlighted_evidence:array<string>>"
QA_PAPER = "struct<title:string,full_text:string,qas:string>"
_SECTION_LIST = "array<struct<section_name:string,paragraphs:array<string>>>"
_SECTION_COLUMNS = "struct<section_name:array<string>,paragraphs:array<array<string>>>"
_ANSWER_ENTRY = f"struct<answer:{ANSWER},{ANSWER[7:-1]}>"
_QA_LIST = f"array<struct<question:string,question_id:string,answers:array<{_ANSWER_ENTRY}>>>"
_QA_COLUMNS = f"struct<question:array<string>,question_id:array<string>,answers:array<array<{_ANSWER_ENTRY}>>>"
CLAIM = "id long, claim string, evidence map<string,array<struct<label:string,sentences:array<int>>>>"
CORPUS = "doc_id long, title string, abstract array<string>, structured boolean"
SENTENCE = "doc_id string, sentence string, ner array<array<string>>, rel array<array<string>>, rel_plus array<array<string>>"
FULL_DOCUMENT = "doc_id string, doc_key string, words array<string>, sentences array<array<string>>, ner string, n_ary_relations array<string>, relations array<string>, relation array<string>"


def question_label_type(q: Column) -> Column:
    out = None
    for kind, cues in QUESTION_CUES.items():
        hit = contains_any(F.lower(q), cues)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("claims")


def answer_text(a: Column) -> Column:
    """Extractive spans joined, else free form, yes or no, unanswerable, else empty."""
    spans = F.filter(F.transform(F.coalesce(a["extractive_spans"], F.array().cast("array<string>")), norm), lambda x: x != "")
    word = F.when(a["yes_no"], "yes").when(~a["yes_no"], "no").when(a["unanswerable"], "unanswerable").otherwise("")
    return first_filled(F.array_join(spans, " | "), norm(a["free_form_answer"]), word)


def evidence_spans(a: Column) -> Column:
    """Highlighted, other and extractive evidence without blanks and repeats, in order."""
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(a[k], none) for k in ("highlighted_evidence", "evidence", "extractive_spans")])
    return F.array_distinct(F.filter(F.transform(every, norm), lambda x: x != ""))


def _unicode_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _grams(token: Column, n: Column) -> Column:
    """The pieces of n characters of a token."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - n + 1, F.lit(1))), lambda i: F.substring(token, i, n))


def _runs(ts: Column, n: int) -> Column:
    """Each n tokens in a row that others surround, with the last character of the token
    before and the first of the one after them."""
    run = lambda i: F.concat_ws(" ", F.right(F.element_at(ts, i - 1), F.lit(1)), F.array_join(F.slice(ts, i, n), " "), F.left(F.element_at(ts, i + n), F.lit(1)))
    return F.array_distinct(F.when(F.size(ts) > n + 1, F.transform(F.sequence(F.lit(2), F.size(ts) - n), run)).otherwise(F.array().cast("array<string>")))


def _exact(ev: DataFrame, ch: DataFrame) -> DataFrame:
    """(ev_id, chunk_id) of the first chunk of the paper that holds the needle.

    Equal needles of a paper are sought once. A token inside the needle, neither its
    first nor its last, is a whole token of any text that holds it, and so are the
    characters next to it. So a needle meets only chunks with the rarest of its runs of three
    inner tokens, or of one if it has no more than two, and a paper with a third of all rows
    is spread over its runs. Needles of two tokens or fewer have no inner one: the longer of
    theirs is part of a token of the text, which is sought among the paper's different
    tokens by its rarest piece of three characters (of fewer, if it is shorter). Needles
    without any token meet all chunks of their paper.
    """
    needles = ev.select("paper_id", "needle").distinct().withColumn("ts", _unicode_tokens(F.col("needle")))
    ts = F.col("ts")
    keys = F.concat(F.array_distinct(ts), _runs(ts, 1), _runs(ts, 3))  # only runs have blanks
    index = staged(ch.select("paper_id", "chunk_id", _unicode_tokens(F.col("hay")).alias("ts")).select("paper_id", "chunk_id", F.explode(keys).alias("token")))  # read three times
    inner = needles.where(F.size("ts") > 2).select("paper_id", "needle", F.explode(F.when(F.size("ts") > 4, _runs(ts, 3)).otherwise(_runs(ts, 1))).alias("token"))
    spread = index.groupBy("paper_id", "token").agg(F.count("*").alias("n"))
    rarest = inner.join(spread, ["paper_id", "token"], "left").groupBy("paper_id", "needle").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    part = needles.where(F.size("ts").isin(1, 2)).select("paper_id", "needle", F.array_max(F.transform("ts", lambda x: F.struct(F.length(x).alias("n"), x.alias("token"))))["token"].alias("piece"))
    pieces = part.withColumn("k", F.least(F.length("piece"), F.lit(3)))
    grams = pieces.select("paper_id", "piece", "k").distinct().withColumn("gram", F.explode(F.array_distinct(_grams(F.col("piece"), F.col("k")))))
    sizes = pieces.groupBy("paper_id").agg(F.collect_set("k").alias("ks"))  # three at most
    vocabulary = spread.where(~F.col("token").contains(" ")).join(sizes, "paper_id").select("paper_id", "token", F.explode(F.array_distinct(F.flatten(F.transform("ks", lambda k: _grams(F.col("token"), k))))).alias("gram"))
    common = vocabulary.groupBy("paper_id", "gram").agg(F.count("*").alias("n"))
    rare = grams.join(common, ["paper_id", "gram"]).groupBy("paper_id", "piece").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    holding = rare.join(vocabulary, ["paper_id", "gram"]).where(F.col("token").contains(F.col("piece"))).select("paper_id", "piece", "token")
    met = rarest.unionByName(pieces.join(holding, ["paper_id", "piece"]).select("paper_id", "needle", "token"))
    # by hash of the needle, since a paper's chunks can be many and a needle long
    pairs = met.join(index, ["paper_id", "token"]).select("paper_id", "needle", "chunk_id").distinct()
    blank = needles.where(F.size("ts") == 0).select("paper_id", "needle").join(ch.select("paper_id", "chunk_id"), "paper_id")
    texts = ch.select("chunk_id", "chunk_ord", "hay")
    hits = pairs.unionByName(blank.select(pairs.columns)).join(texts, "chunk_id").where(F.col("hay").contains(F.col("needle")))
    first = hits.groupBy("paper_id", "needle").agg(F.min_by("chunk_id", "chunk_ord").alias("chunk_id"))
    return ev.join(first, ["paper_id", "needle"]).select("ev_id", "chunk_id")


def _most(chunk: str) -> Column:
    """Of an aggregate: the first chunk with the greatest overlap."""
    return F.min_by(F.struct(chunk, "overlap"), F.struct(-F.col("overlap"), "chunk_ord"))


def _exact_in_small(ev: DataFrame, ch: DataFrame) -> DataFrame:
    """As _exact, of papers whose spans can meet all of their chunks."""
    hits = ev.join(ch, "paper_id").where(F.col("hay").contains(F.col("needle")))
    return hits.groupBy("ev_id").agg(F.min_by("chunk_id", "chunk_ord").alias("chunk_id"))


def _overlapping_in_small(rest: DataFrame, ch: DataFrame) -> DataFrame:
    """As _overlapping, of papers whose spans can meet all of their chunks."""
    words = ch.select("paper_id", "chunk_id", "chunk_ord", tokens(F.col("hay")).alias("ht"))
    scored = rest.join(words, "paper_id").withColumn("overlap", F.size(F.array_intersect("t", "ht")) / F.size("t")).where(F.col("overlap") >= LEAST_OVERLAP)
    return scored.groupBy("ev_id").agg(_most("chunk_id").alias("b")).select("ev_id", "b.chunk_id", "b.overlap")


def _overlapping(rest: DataFrame, ch: DataFrame) -> DataFrame:
    """rest(ev_id, paper_id, t: distinct tokens, n: their number): the first chunk with the
    greatest share of the tokens, if enough (ev_id, chunk_id, overlap).

    A chunk with k of n tokens has at least three of the n - k + 3 rarest, so only these are
    joined; pairs that meet on three are counted on their whole token sets.
    """
    index = ch.select("paper_id", "chunk_id", F.explode(tokens(F.col("hay"))).alias("token"))
    common = index.groupBy("paper_id", "token").agg(F.count("*").alias("c"))
    # Equal token sets of a paper are sought once.
    sought = rest.groupBy("paper_id", F.array_sort("t").alias("t")).agg(F.min("ev_id").alias("one"))
    ranked = sought.select("paper_id", "one", F.size("t").alias("n"), F.explode("t").alias("token")).join(common, ["paper_id", "token"], "left")
    place = F.row_number().over(Window.partitionBy("paper_id", "one").orderBy(F.coalesce("c", F.lit(0)), "token"))
    probe = ranked.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * LEAST_OVERLAP) + SHARED) & F.col("c").isNotNull())
    met = probe.join(index, ["paper_id", "token"]).groupBy("one", "chunk_id").agg(F.count("*").alias("k")).where(F.col("k") >= SHARED).drop("k")
    texts = ch.select("chunk_id", "chunk_ord", tokens(F.col("hay")).alias("ht"))
    scored = met.join(sought.select("one", "t"), "one").join(texts, "chunk_id").withColumn("overlap", F.size(F.array_intersect("t", "ht")) / F.size("t")).where(F.col("overlap") >= LEAST_OVERLAP)
    best = scored.groupBy("one").agg(_most("chunk_id").alias("b"))
    found = sought.join(best, "one").select("paper_id", F.col("t").alias("st"), "b")
    return rest.select("ev_id", "paper_id", F.array_sort("t").alias("st")).join(found, ["paper_id", "st"]).select("ev_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.overlap").alias("overlap"))


def locate(evidence: DataFrame, chunks: DataFrame, stage: bool = False) -> DataFrame:
    """evidence(ev_id, paper_id, evidence_span), chunks(paper_id, chunk_id unique, chunk_ord of
    any ordered type, chunk_text): the first chunk that holds the span, else of a span with
    five tokens or more the first with the greatest token overlap, if at least 0.65.

    Two phases: only spans without an exact hit are sought by overlap. In a paper of at most
    MEET_ALL pairs, all spans meet all chunks: no more than the root of that for each row,
    and texts are dealt out by paper once. Larger papers, of which there are few, meet on rare
    tokens only. ``stage`` writes the exact hits and the spans without, which are read again.
    """
    ev = staged(evidence.select("ev_id", "paper_id", F.lower(norm(F.col("evidence_span"))).alias("needle")).where("needle <> ''"))
    ch = chunks.select("paper_id", "chunk_id", "chunk_ord", F.lower("chunk_text").alias("hay"))
    sizes = ev.groupBy("paper_id").agg(F.count("*").alias("e")).join(chunks.groupBy("paper_id").agg(F.count("*").alias("c")), "paper_id")
    large = staged(sizes.where(F.col("e") * F.col("c") > MEET_ALL).select("paper_id"))  # read for each phase and side
    in_small, in_large = (lambda df: df.join(large, "paper_id", "left_anti")), (lambda df: df.join(large, "paper_id", "left_semi"))
    exact = _exact_in_small(in_small(ev), in_small(ch)).unionByName(_exact(in_large(ev), in_large(ch)))
    exact = staged(exact) if stage else exact
    rest = ev.join(exact.select("ev_id"), "ev_id", "left_anti").withColumn("t", tokens(F.col("needle"))).where(F.size("t") >= LEAST_TOKENS).select("ev_id", "paper_id", "t")
    rest = staged(rest) if stage else rest
    best = _overlapping_in_small(in_small(rest), in_small(ch)).unionByName(_overlapping(in_large(rest), in_large(ch)))
    exact = exact.withColumn("match", F.lit("exact")).withColumn("overlap", F.lit(1.0))
    return exact.unionByName(best.select("ev_id", "chunk_id", F.lit("overlap").alias("match"), "overlap"))


def section_chunks(papers: DataFrame) -> DataFrame:
    """papers(paper_id, full_text JSON, ...): paragraphs of sections given as a list of
    structs or as a struct of lists; blank ones are left out but counted."""
    by_list = F.from_json("full_text", _SECTION_LIST)
    cols = F.from_json("full_text", _SECTION_COLUMNS)
    by_column = F.transform(cols["paragraphs"], lambda p, i: F.struct(F.get(cols["section_name"], i).alias("section_name"), p.alias("paragraphs")))
    rows = papers.withColumn("secs", F.when(F.ltrim("full_text").startswith("["), by_list).otherwise(by_column)).select("*", F.posexplode("secs").alias("s", "sec"))
    rows = rows.select("*", F.posexplode("sec.paragraphs").alias("p", "par")).withColumn("chunk_text", norm(F.col("par"))).where("chunk_text <> ''")
    name = norm(F.coalesce(F.nullif("sec.section_name", F.lit("")), F.concat(F.lit("Section "), (F.col("s") + 1).cast("string"))))
    chunk_id = F.concat("paper_id", F.lit(":s"), (F.col("s") + 1).cast("string"), F.lit(":p"), (F.col("p") + 1).cast("string"))
    return rows.select("split", "paper_id", norm(F.col("title")).alias("title"), name.alias("section"), (F.col("p") + 1).alias("paragraph_index"), chunk_id.alias("chunk_id"), (F.col("s") * 1_000_000 + F.col("p")).alias("chunk_ord"), "chunk_text")


def questions(papers: DataFrame) -> DataFrame:
    """(split, paper_id, qa_index, question_id, question, answer_index, answer)."""
    by_list, cols = F.from_json("qas", _QA_LIST), F.from_json("qas", _QA_COLUMNS)
    none = F.from_json(F.lit("[]"), f"array<{_ANSWER_ENTRY}>")
    by_column = F.transform(cols["question"], lambda q, i: F.struct(q.alias("question"), F.get(cols["question_id"], i).alias("question_id"), F.coalesce(F.get(cols["answers"], i), none).alias("answers")))
    rows = papers.withColumn("qa", F.explode(F.transform(F.when(F.ltrim("qas").startswith("["), by_list).otherwise(by_column), lambda q, i: F.struct(i.alias("i"), q.alias("q")))))
    rows = rows.select("split", "paper_id", (F.col("qa.i") + 1).alias("qa_index"), norm(F.col("qa.q.question")).alias("question"), F.col("qa.q.question_id").alias("qid"), F.posexplode("qa.q.answers").alias("a", "entry"))
    flat = F.struct(*[F.col(f"entry.{f.split(':')[0]}") for f in ANSWER[7:-1].split(",")])
    return rows.select(
        "split", "paper_id", "qa_index", "question", norm(F.coalesce("qid", F.concat(F.lit("q"), F.col("qa_index").cast("string")))).alias("question_id"),
        (F.col("a") + 1).alias("answer_index"), F.coalesce("entry.answer", flat.cast(ANSWER)).alias("answer"),
    )


def _label(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in LABEL[7:-1].split(",")]
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).alias(n) for n in names]).cast(LABEL)


def _labels(**lists: Column) -> Column:
    empty = F.from_json(F.lit("[]"), f"array<{LABEL}>")
    return F.struct(*[F.coalesce(lists[b], empty).alias(b) if b in lists else empty.alias(b) for b in BUCKETS])


def _seed(rows: DataFrame, dataset: str, labels: Column, question: Column) -> DataFrame:
    return rows.select(
        "id", F.lit(dataset).alias("source_dataset"), F.lit("needs_human_review").alias("status"), "paper_id", "title", F.lit(None).cast("string").alias("source_pdf"), "section",
        F.lit(None).cast("int").alias("page"), "chunk_id", "chunk_text", question.alias("question"), labels.alias("labels"),
    )


def question_corpus(papers: DataFrame, most_papers: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """papers(split, pos, paper_id, title, full_text, qas): chunks, evidence, seeds."""
    if most_papers:
        papers = papers.where(F.col("pos") < most_papers)
    chunks = staged(section_chunks(papers))  # JSON is parsed once, though both are read several times
    qs = questions(papers).withColumn("answer_text", answer_text(F.col("answer"))).where("answer_text <> ''")
    spans = qs.select("split", "paper_id", "qa_index", "question_id", "question", "answer_index", "answer_text", F.posexplode(evidence_spans(F.col("answer"))).alias("e", "evidence_span"))
    rid = F.concat_ws("-", F.lit("qasper"), "split", slug(F.col("paper_id")), F.col("qa_index").cast("string"), F.col("answer_index").cast("string"), (F.col("e") + 1).cast("string"))
    spans = staged(spans.withColumn("id", rid).withColumn("label_hint", question_label_type(F.col("question"))))
    hit = locate(spans.select(F.col("id").alias("ev_id"), "paper_id", "evidence_span"), chunks, stage=True).select(F.col("ev_id").alias("id"), "chunk_id")
    evidence = spans.join(hit, "id").join(chunks.select("chunk_id", "title", "section", "chunk_text"), "chunk_id")
    evidence = evidence.select("id", "split", "paper_id", "title", "question_id", "question", "answer_text", "label_hint", "section", "chunk_id", "evidence_span", "chunk_text")
    one = _label(id=F.concat_ws("-", F.expr("substring(label_hint, 1, length(label_hint) - 1)"), "id"), text=F.col("answer_text"), evidence_span=F.col("evidence_span"), confidence=F.lit(0.6), source=F.lit("qa_evidence_heuristic"))
    labels = _labels(**{b: F.when(F.col("label_hint") == b, F.array(one)) for b in ("claims", "methods", "experiments", "limitations")})
    return chunks, evidence, _seed(evidence, "qasper", labels, F.col("question"))


def evidence_sentences(abstract: Column, at: Column) -> Column:
    """The sentences at the given places, joined; places out of range are ignored."""
    return F.array_join(F.filter(F.transform(at, lambda i: F.when(i >= 0, norm(F.get(abstract, i)))), lambda x: x != ""), " ")


def stance(label: Column) -> Column:
    u = F.upper(label)
    return F.when(u == "SUPPORT", "supports").when(u == "CONTRADICT", "contradicts").otherwise(first_filled(F.lower(label), F.lit("related_to")))


def claim_corpus(claims: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """claims(split, id, claim, evidence map), corpus(doc_id unique, ...): chunks of the
    documents used, evidence, seeds."""
    c = claims.withColumn("claim", norm(F.col("claim"))).where("claim <> ''").select("split", F.col("id").alias("claim_id"), "claim", F.explode("evidence").alias("doc", "rationales"))
    joined = c.withColumn("doc_id", F.expr("try_cast(doc as bigint)")).join(corpus, "doc_id")
    rows = joined.select("*", F.posexplode("rationales").alias("r", "rationale")).withColumn("evidence_span", evidence_sentences(F.col("abstract"), F.coalesce("rationale.sentences", F.array().cast("array<int>")))).where("evidence_span <> ''")
    rid = F.concat_ws("-", F.lit("scifact"), "split", F.col("claim_id").cast("string"), F.col("doc_id").cast("string"), (F.col("r") + 1).cast("string"))
    text = F.array_join(F.transform("abstract", norm), " ")
    label = norm(F.col("rationale.label"))
    evidence = rows.select(
        rid.alias("id"), "split", "claim_id", F.col("doc_id").cast("string").alias("paper_id"), norm(F.col("title")).alias("title"), F.lit("Abstract").alias("section"),
        F.concat(F.lit("scifact:"), F.col("doc_id").cast("string"), F.lit(":abstract")).alias("chunk_id"), label.alias("label"), stance(label).alias("relation_type"), "claim", "evidence_span", text.alias("chunk_text"),
    )
    cid = F.concat(F.lit("claim-"), "id")
    claim = _label(id=cid, text=F.col("claim"), evidence_span=F.col("evidence_span"), confidence=F.lit(0.7), source=F.lit("claim_verification"))
    rel = _label(source_id=cid, target_id=F.concat(F.lit("evidence-"), "id"), type=F.col("relation_type"), evidence_span=F.col("evidence_span"), confidence=F.lit(0.85), source=F.lit("rationale_label"))
    seeds = _seed(evidence, "scifact", _labels(claims=F.array(claim), relations=F.array(rel)), F.lit("Does the evidence support or contradict the claim?"))
    used = corpus.join(joined.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = used.select(F.col("doc_id").cast("string").alias("paper_id"), norm(F.col("title")).alias("title"), F.lit("Abstract").alias("section"), F.concat(F.lit("scifact:"), F.col("doc_id").cast("string"), F.lit(":abstract")).alias("chunk_id"), text.alias("chunk_text"), F.coalesce("structured", F.lit(False)).alias("structured"))
    return chunks, evidence, seeds


def entity_bucket(kind: Column) -> Column:
    return F.when(F.lower(F.trim(kind)) == "method", "methods").otherwise("concepts")


def sentence_corpus(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(split, row_idx, doc_id, sentence, ner, rel, rel_plus): chunks, entities, seeds. An
    endpoint is the last entity with its text, compared in lower case."""
    rows = rows.select("split", "row_idx", norm(F.coalesce("doc_id", F.concat_ws("-", "split", F.col("row_idx").cast("string")))).alias("paper_id"), norm(F.col("sentence")).alias("chunk_text"), "ner", F.when(F.size(F.coalesce("rel_plus", F.array())) > 0, F.col("rel_plus")).otherwise(F.col("rel")).alias("rels")).where("chunk_text <> ''")
    rows = rows.withColumn("chunk_id", F.concat(F.lit("scier:"), "paper_id", F.lit(":sent-"), F.col("row_idx").cast("string")))
    base = ["split", "row_idx", "paper_id", "chunk_id", "chunk_text"]
    ents = rows.select(*base, F.posexplode("ner").alias("i", "e")).select(*base, "i", norm(F.get("e", 0)).alias("text"), norm(F.get("e", 1)).alias("type")).where("text <> '' and type <> ''")
    ents = ents.withColumn("bucket", entity_bucket(F.col("type")))
    ents = ents.withColumn("id", F.concat_ws("-", F.expr("substring(bucket, 1, length(bucket) - 1)"), F.lit("scier"), slug(F.col("paper_id")), F.col("row_idx").cast("string"), (F.col("i") + 1).cast("string")))
    keys = ["split", "row_idx"]
    by_text = ents.groupBy(*keys, F.lower("text").alias("t")).agg(F.max_by("id", "i").alias("eid"))
    rel = rows.select(*keys, "chunk_text", F.posexplode("rels").alias("ri", "r")).where(F.size("r") >= 3)
    rel = rel.select(*keys, "chunk_text", "ri", F.lower(norm(F.substring_index(F.get("r", 0), ":", 1))).alias("s"), norm(F.get("r", 1)).alias("type"), F.lower(norm(F.substring_index(F.get("r", 2), ":", 1))).alias("o")).where("type <> ''")
    rel = rel.join(by_text.select(*keys, F.col("t").alias("s"), F.col("eid").alias("source_id")), [*keys, "s"]).join(by_text.select(*keys, F.col("t").alias("o"), F.col("eid").alias("target_id")), [*keys, "o"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["l"])
    ent_label = _label(id=F.col("id"), name=F.col("text"), text=F.col("text"), type=F.col("type"), evidence_span=F.col("text"), confidence=F.lit(0.8), source=F.lit("sentence_ner"))
    e = ents.groupBy(*keys).agg(*[ordered(F.when(F.col("bucket") == b, F.struct("i", ent_label.alias("l")))).alias(b) for b in ("methods", "concepts")])
    rel_label = _label(source_id=F.col("source_id"), target_id=F.col("target_id"), type=F.col("type"), evidence_span=F.col("chunk_text"), confidence=F.lit(0.85), source=F.lit("sentence_relation"))
    r = rel.groupBy(*keys).agg(ordered(F.struct("ri", rel_label.alias("l"))).alias("relations"))
    labelled = rows.join(e, keys).join(r, keys, "left").withColumn("id", F.concat_ws("-", F.lit("scier"), "split", slug(F.col("paper_id")), F.col("row_idx").cast("string"))).withColumn("title", F.lit("")).withColumn("section", F.lit("Sentence"))
    seeds = _seed(labelled, "scier", _labels(methods=F.col("methods"), concepts=F.col("concepts"), relations=F.col("relations")), F.lit("Which methods, tasks, datasets and relations does this sentence name?"))
    return rows.select(*base), ents.drop("i"), seeds


def span_text(words: Column, start: Column, end: Column) -> Column:
    """Words of a half-open span; one that ends beyond the text is inclusive and cut."""
    n = F.size(words)
    size = F.when(end <= n, end - start).otherwise(F.least(end + 1, n) - start)
    ok = (start >= 0) & (end >= start) & (start < n)
    return F.when(ok, norm(F.array_join(F.slice(words, start + 1, F.greatest(size, F.lit(0))), " "))).otherwise("")


def document_corpus(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(split, row_idx, FULL_DOCUMENT): chunks, entities, seeds with document-level relations."""
    words = F.when(F.size(F.coalesce("words", F.array().cast("array<string>"))) > 0, F.col("words")).otherwise(F.flatten("sentences"))
    pid = norm(F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("doc_key", F.lit("")), F.concat_ws("-", "split", F.col("row_idx").cast("string"))))
    flat1 = F.from_json("ner", "array<array<string>>")
    deep = F.from_json("ner", "array<array<array<string>>>")
    ner = F.when(F.regexp_replace("ner", r"\s", "").startswith("[[["), F.flatten(deep)).otherwise(flat1)
    none = F.array().cast("array<string>")
    rels = F.filter(F.concat(*[F.coalesce(c, none) for c in ("n_ary_relations", "relations", "relation")]), lambda x: F.ltrim(x).startswith("{") | F.ltrim(x).startswith("["))
    raw = F.transform(rels, lambda x: F.when(F.ltrim(x).startswith("["), F.concat(F.lit('{"raw":'), x, F.lit("}"))).otherwise(x))
    docs = rows.select("split", "row_idx", pid.alias("paper_id"), words.alias("words"), ner.alias("ner"), raw.alias("raw")).where(F.size("words") > 0)
    docs = docs.withColumn("chunk_text", norm(F.array_join("words", " "))).withColumn("chunk_id", F.concat(F.lit("scirex:"), "paper_id", F.lit(":document")))
    keys = ["split", "row_idx"]
    ents = docs.select(*keys, "paper_id", "chunk_id", "words", F.posexplode("ner").alias("i", "e")).where(F.size("e") >= 3)
    ents = ents.withColumn("text", span_text(F.col("words"), F.expr("try_cast(e[0] as int)"), F.expr("try_cast(e[1] as int)"))).where("text <> ''").withColumn("type", norm(F.get("e", 2))).withColumn("bucket", entity_bucket(F.col("type")))
    ents = ents.withColumn("id", F.concat_ws("-", F.expr("substring(bucket, 1, length(bucket) - 1)"), F.lit("scirex"), slug(F.col("paper_id")), (F.col("i") + 1).cast("string"))).drop("words", "e")
    label = _label(id=F.col("id"), name=F.col("text"), text=F.col("text"), type=F.col("type"), evidence_span=F.col("text"), confidence=F.lit(0.75), source=F.lit("document_ner"))
    ordered = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("i", label.alias("l"))))), lambda x: x["l"])
    e = ents.groupBy(*keys).agg(ordered("methods").alias("methods"), ordered("concepts").alias("concepts"))
    rel = F.transform("raw", lambda x, i: _label(source_id=F.concat(F.lit("document-"), slug(F.col("paper_id"))), target_id=F.concat_ws("-", F.lit("relation"), slug(F.col("paper_id")), (i + 1).cast("string")), type=F.lit("document_level_relation"), evidence_span=F.substring("chunk_text", 1, 800), confidence=F.lit(0.5), source=F.lit("document_relation_raw"), raw_relation=x))
    labelled = docs.join(e, keys, "left").withColumn("relations", rel).withColumn("id", F.concat_ws("-", F.lit("scirex"), "split", slug(F.col("paper_id")))).withColumn("title", F.lit("")).withColumn("section", F.lit("Document"))
    labelled = labelled.where((F.size(F.coalesce("methods", F.array())) > 0) | (F.size(F.coalesce("concepts", F.array())) > 0) | (F.size("relations") > 0))
    seeds = _seed(labelled, "scirex", _labels(methods=F.col("methods"), concepts=F.col("concepts"), relations=F.col("relations")), F.lit("Which methods, tasks, metrics and materials does this document report?"))
    return docs.select(*keys, "paper_id", "chunk_id", "chunk_text"), ents.drop("i"), seeds


def numbered(rows: DataFrame) -> DataFrame:
    """row_idx: the place of each row in its split, from 1, by file and place in it. Rows are
    numbered within the part of a file that a task reads, and shifted by the counts of the
    parts before it; only those counts are brought together."""
    part = ["split", "_file", "_part"]
    here = Window.partitionBy(*part)
    counts = rows.groupBy(*part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("split").orderBy("_file", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.withColumn("__before", before).drop("__n")
    own = rows.withColumn("__own", F.row_number().over(here.orderBy("_line")))
    return own.join(shifts, part).withColumn("row_idx", (F.col("__before") + F.col("__own")).cast("int")).drop("__before", "__own")
