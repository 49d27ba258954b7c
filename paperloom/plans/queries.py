"""Queries over the test tables, by name, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm, slug, stable_id
from ..operators import extract, graph, harness, parse, report, sampling, seeds, sft
from ..sources import readers, sinks
from ..sources.staging import new_folder, spread, staged
from ..streaming import ingest
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(t(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("paper_id"), "text"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return parse.markdown_sections(docs(spark, d))


def items(spark: SparkSession, d: str, again: bool = False) -> DataFrame:
    """Sections are parsed once, though the items read them more than once; ``again``: so are
    the items."""
    made = extract.items(staged(sections(spark, d)), stage=True)
    return staged(made) if again else made


def candidates(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Candidates, each delivered once: the earliest delivery of an id; of all columns or those named."""
    c = t(spark, d, "candidates").where("candidate_id is not null")
    c = spread(c.select("candidate_id", "ingested_at", *names) if names else c)
    return c.groupBy("candidate_id").agg(F.min_by(F.struct(*[x for x in c.columns if x != "candidate_id"]), "ingested_at").alias("r")).select("candidate_id", "r.*")


@query(f"with {o.SECTIONS} select cast(doc_id as varchar) as paper_id, section_idx, title, text from sec")
def split_sections(spark, d):
    return sections(spark, d).select("paper_id", "section_idx", "title", "text")


@query(f"with {o.SECTIONS} select cast(doc_id as varchar) as paper_id, title from tit")
def document_titles(spark, d):
    return parse.document_titles(docs(spark, d)).select("paper_id", "title")


_PAGE = "^[0-9]+$"
_CLEAN = o.strip(f"regexp_replace(regexp_replace(s, '^[0-9]+(\\.[0-9]+)*[{o.SPACE}]*', ''), '\\.+$', '')")


@query(f"""with {o.LINES},
k as (select doc_id, cast((i - 1) // 10 + 1 as int) as page, i, s, {_CLEAN} as cleaned from l where s <> '' and not regexp_full_match(s, '[0-9]+')),
hd as (select *, length(s) <= 80 and regexp_replace(lower(cleaned), '[{o.SPACE}]+', ' ', 'g') in ({o.many(o.HEADINGS)}) as head from k),
g as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by i) as n from hd),
ps as (select doc_id, cast(n as int) as section_idx, coalesce(nullif(max(case when head then cleaned end), ''), '문서') as title,
  min(page) as page, string_agg(case when head then null else s end, chr(10) order by i) as text from g group by doc_id, n having count(*) filter (where not head) > 0),
pg as (select doc_id, (i - 1) // 10 as p, string_agg(line, chr(10) order by i) as text from l group by 1, 2),
wh as (select doc_id, {o.strip("string_agg(text, chr(10) || chr(10) order by p)")} as text from pg where {o.strip('text')} <> '' and doc_id not in (select doc_id from ps) group by doc_id)
select cast(doc_id as varchar) as paper_id, section_idx, title, page, text from ps
union all select cast(doc_id as varchar), 0, '문서', null, text from wh""")
def pdf_sections(spark, d):
    rows = docs(spark, d).select("doc_idx", "paper_id", F.posexplode(F.transform(parse.lines(F.col("text")), lambda x: x)).alias("i", "line"))
    pages = rows.groupBy("doc_idx", "paper_id", (F.floor(F.col("i") / 10) + 1).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = parse.page_sections(pages.withColumn("title", F.lit("")))
    return out.select("paper_id", "section_idx", "title", "page", "text")


@query(f"with {o.ITEMS} select cast(doc_id as varchar) as paper_id, item_type, item_id, text, section, evidence_span, confidence from it where confidence = 1.0")
def marker_items(spark, d):
    return extract.marked_items(sections(spark, d)).select("paper_id", "item_type", "item_id", "text", "section", "evidence_span", "confidence")


@query(f"with {o.ITEMS} select cast(doc_id as varchar) as paper_id, item_type, item_id, text, section, confidence from it where confidence < 1.0")
def fallback_items(spark, d):
    s = staged(sections(spark, d))
    return extract.fallback_items(s, extract.marked_items(s)).select("paper_id", "item_type", "item_id", "text", "section", "confidence")


@query(f"with {o.NODES} select id, label, type, paper_id, section, evidence_span, confidence from nodes")
def graph_nodes(spark, d):
    return graph.nodes(parse.document_titles(docs(spark, d)), items(spark, d)).select("id", "label", "type", "paper_id", "section", "evidence_span", "confidence")


@query(f"with {o.NODES} select id, cast(2 as bigint) as n from nodes where type = 'Claim'")
def duplicate_nodes(spark, d):
    n = graph.nodes(parse.document_titles(docs(spark, d)), items(spark, d, again=True))
    return graph.duplicate_nodes(n.unionByName(n.where("type = 'Claim'")))


@query(f"with {o.CONCEPTS} select source, target, type, section, evidence_span, confidence from rel")
def method_concept_relations(spark, d):
    return extract.method_concept_relations(items(spark, d, again=True)).select("source", "target", "type", "section", "evidence_span", "confidence")


@query(f"with {o.EDGES} select source, target, type, paper_id, section, evidence_span, confidence from edges")
def graph_edges(spark, d):
    it = items(spark, d, again=True)
    return graph.edges(it, extract.method_concept_relations(it)).select("source", "target", "type", "paper_id", "section", "evidence_span", "confidence")


@query(f"with {o.EDGES} select source, target, target as missing from edges where type = 'paper_uses_method' union all select source, target, source from edges where type = 'uses'")
def dangling_edges(spark, d):
    it = items(spark, d, again=True)
    n = graph.nodes(parse.document_titles(docs(spark, d)), it).where("type <> 'Method'")
    return graph.dangling_edges(graph.edges(it, extract.method_concept_relations(it)), n)


@query("""select cast(o_orderkey as varchar) as source, cast(o_custkey as varchar) as target, 'c' || cast(o_custkey as varchar) as missing from orders where o_custkey % 7 = 0""")
def tpch_graph_integrity(spark, d):
    c, od = t(spark, d, "customer"), t(spark, d, "orders")
    ids = c.select(F.concat(F.lit("c"), "c_custkey").alias("id")).where(F.col("c_custkey") % 7 != 0).unionByName(od.select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    e = od.select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"))
    return graph.dangling_edges(e, ids).select(F.expr("substring(source, 2)").alias("source"), F.expr("substring(target, 2)").alias("target"), "missing")


@query(f"with {o.ITEMS} select cast(it.doc_id as varchar) as paper_id, tit.title, item_type, item_id, text, section, '' as page, evidence_span, cast(confidence as varchar) as confidence from it join tit on tit.doc_id = it.doc_id")
def evidence_matrix(spark, d):
    return report.evidence_matrix(parse.document_titles(docs(spark, d)), items(spark, d)).select(*sinks.MATRIX)


_COUNTS = "items, with_evidence, n_claim, n_method, n_experiment, n_limitation, n_concept"


@query(f"with {o.ASSESS} select cast(doc_id as varchar) as paper_id, title, {_COUNTS}, coverage, missing from a")
def assessment(spark, d):
    return report.assessment(parse.document_titles(docs(spark, d)), items(spark, d)).select("paper_id", "title", *_COUNTS.split(", "), "coverage", "missing")


@query(f"""with {o.ASSESS} select cast(doc_id as varchar) as paper_id, '## ' || title || chr(10) || chr(10) || '- 논문 ID: `' || cast(doc_id as varchar) || '`' || chr(10) || '- 추출 항목 수: ' || cast(items as varchar) || chr(10)
|| '- 근거 문장 커버리지: ' || cast(coverage as varchar) || '%' || chr(10) || '- 추출된 주장 수: ' || cast(n_claim as varchar) || chr(10) || '- 추출된 방법 수: ' || cast(n_method as varchar) || chr(10) || '- 추출된 실험/결과 수: ' || cast(n_experiment as varchar)
|| chr(10) || '- 추출된 한계 수: ' || cast(n_limitation as varchar) || chr(10) || '- 추출된 개념 수: ' || cast(n_concept as varchar) || chr(10) || '- 보강 필요: ' || missing as block from a""")
def assessment_markdown(spark, d):
    return report.assessment_blocks(report.assessment(parse.document_titles(docs(spark, d)), items(spark, d))).select("paper_id", "block")


@query(f"""with {o.ITEMS}, p as (select doc_id, {o.case('item_type', list(zip(o.NAMES, range(5))))} as tn, '### ' || {o.case('item_type', o.NAMES.items())} || chr(10) || string_agg('- ' || text, chr(10) order by ord) as part from it group by doc_id, item_type),
b as (select doc_id, string_agg(part, chr(10) || chr(10) order by tn) as parts from p group by doc_id)
select cast(tit.doc_id as varchar) as paper_id, '## ' || title || chr(10) || chr(10) || '논문 ID: `' || cast(tit.doc_id as varchar) || '`' || case when parts is null then '' else chr(10) || chr(10) || parts end as block from tit left join b on b.doc_id = tit.doc_id""")
def summary_markdown(spark, d):
    return report.summary_blocks(parse.document_titles(docs(spark, d)), items(spark, d)).select("paper_id", "block")


_ASKED = [(1, "어떤 주장이 있나요?"), (2, "Which METHODS are used?"), (3, "what are the results"), (4, "한계는?"), (5, "list the concepts"), (6, "who wrote it?")]


@query(f"""with {o.NODES}, qs(qid, question) as (values {', '.join(f'({i}, {o.q(x)})' for i, x in _ASKED)}), a as (select qid, {o.INTENT} as type from qs)
select a.qid, a.type, nodes.id, '- ' || label as line from a join nodes on nodes.type = a.type union all select qid, null, null, {o.q(o.UNKNOWN)} from a where type is null""")
def qa_answers(spark, d):
    n = graph.nodes(parse.document_titles(docs(spark, d)), items(spark, d))
    a = report.answers(spark.createDataFrame(_ASKED, "qid int, question string"), n)
    ids = n.select(F.col("type").alias("nt"), F.col("doc_idx").alias("nd"), F.col("ord").alias("no"), "id")
    return a.join(ids, (F.col("type") == F.col("nt")) & (F.col("doc_idx") == F.col("nd")) & (F.col("ord") == F.col("no")), "left").select("qid", "type", "id", "line")


def _evidence(spark, d):
    c = candidates(spark, d, "source_dataset", "paper_id", "evidence_span").where("paper_id is not null")
    ev = c.select(F.col("candidate_id").alias("ev_id"), F.concat_ws("/", "source_dataset", "paper_id").alias("paper_id"), "evidence_span")
    ch = staged(t(spark, d, "chunks").groupBy("chunk_id").agg(F.min(F.concat_ws("/", "source_dataset", "paper_id")).alias("paper_id"), F.min("text").alias("chunk_text")))
    return ev, ch.withColumn("chunk_ord", F.col("chunk_id"))


_EV = f"""{o.ONE}, ev as (select candidate_id as ev_id, source_dataset || '/' || paper_id as p, lower({o.norm('evidence_span')}) as needle from c where paper_id is not null),
ch as (select chunk_id, min(source_dataset || '/' || paper_id) as p, lower(min(text)) as hay from chunks group by chunk_id),
ex as (select ev_id, min(chunk_id) as chunk_id from ev join ch on ev.p = ch.p where needle <> '' and contains(hay, needle) group by ev_id)"""


@query(f"with {_EV} select ev_id, chunk_id from ex")
def evidence_exact_match(spark, d):
    ev, ch = _evidence(spark, d)
    return seeds.locate(ev, ch).where("match = 'exact'").select("ev_id", "chunk_id")


@query(f"""with {_EV}, rest as (select ev.* from ev left join ex on ex.ev_id = ev.ev_id where ex.ev_id is null and needle <> ''),
tk as (select distinct ev_id, p, unnest(regexp_extract_all(needle, '[a-z0-9]+')) as w from rest), tn as (select ev_id, count(*) as n from tk group by ev_id having count(*) >= 5),
hk as (select distinct chunk_id, p, unnest(regexp_extract_all(hay, '[a-z0-9]+')) as w from ch),
sh as (select tk.ev_id, chunk_id, tn.n, count(*) as k from tk join tn on tn.ev_id = tk.ev_id join hk on hk.p = tk.p and hk.w = tk.w group by tk.ev_id, chunk_id, tn.n),
rk as (select *, row_number() over (partition by ev_id order by k desc, chunk_id) as r from sh where k >= 0.65 * n)
select ev_id, chunk_id, cast(k as double) / n as overlap from rk where r = 1""")
def evidence_overlap_match(spark, d):
    ev, ch = _evidence(spark, d)
    return seeds.locate(ev, ch, stage=True).where("match = 'overlap'").select("ev_id", "chunk_id", "overlap")


@query(f"""with s as (select distinct section_id, source_dataset, paper_id, section_idx, title, text from sections), p as (select s.*, u.p as p, {o.norm('u.x')} as chunk_text from s, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) with ordinality as u(x, p))
select paper_id || ':s' || cast(section_idx as varchar) || ':p' || cast(p as varchar) as chunk_id, source_dataset, case when {o.norm('title')} = '' then 'Section ' || cast(section_idx as varchar) else {o.norm('title')} end as section, cast(p as int) as paragraph_index, chunk_text from p where chunk_text <> ''""")
def paragraph_chunks(spark, d):
    s = t(spark, d, "sections").select("section_id", "source_dataset", "paper_id", "section_idx", "title", "text").distinct()
    papers = s.select(
        "source_dataset", "section_idx", F.lit("train").alias("split"), "paper_id", F.lit("").alias("title"),
        F.to_json(F.array(F.struct(F.coalesce(F.nullif(norm(F.col("title")), F.lit("")), F.concat(F.lit("Section "), "section_idx")).alias("section_name"), F.split(F.coalesce("text", F.lit("")), "\n\n").alias("paragraphs")))).alias("full_text"),
    )
    parts = papers.select("source_dataset", "section_idx", "paper_id", F.struct("split", F.concat_ws("\x1f", "source_dataset", "paper_id", "section_idx").alias("paper_id"), "title", "full_text").alias("p"))
    out = seeds.section_chunks(parts.select("p.*")).withColumn("k", F.split("paper_id", "\x1f"))
    chunk = F.concat(F.col("k")[1], F.lit(":s"), F.col("k")[2], F.lit(":p"), "paragraph_index")
    return out.select(chunk.alias("chunk_id"), F.col("k")[0].alias("source_dataset"), "section", "paragraph_index", "chunk_text")


@query("select candidate_id, case " + " ".join(f"when {o.any_in('lower(question)', v)} then {o.q(k)}" for k, v in o.QUESTION_CUES.items()) + f" else 'claims' end as label_type from (select * from (with {o.ONE} select * from c)) where question is not null")
def question_label_type(spark, d):
    return candidates(spark, d).where("question is not null").select("candidate_id", seeds.question_label_type(F.col("question")).alias("label_type"))


def _answers(spark, d):
    c = candidates(spark, d)
    yes = F.when(F.lower("label_text") == "yes", True).when(F.lower("label_text") == "no", False)
    a = F.struct(
        F.when(F.col("label_text").contains(" | "), F.split("label_text", r" \| ")).alias("extractive_spans"), F.when(yes.isNull() & (F.col("label_bucket") == "claims"), F.col("label_text")).alias("free_form_answer"),
        yes.alias("yes_no"), (F.length("candidate_id") > 0).alias("unanswerable"), F.array("evidence_span", "chunk_text").alias("evidence"), F.array("evidence_span", F.lit(" ")).alias("highlighted_evidence"),
    ).cast(seeds.ANSWER)
    return c.select("candidate_id", a.alias("a"))


_SPANS = f"array_to_string(list_filter(list_transform(string_split(label_text, ' | '), lambda x: {o.norm('x')}), lambda x: x <> ''), ' | ')"


@query(f"""with {o.ONE} select candidate_id, coalesce(case when contains(label_text, ' | ') then nullif({_SPANS}, '') end,
case when label_bucket = 'claims' and lower(label_text) not in ('yes', 'no') then nullif({o.norm('label_text')}, '') end, case when lower(label_text) in ('yes', 'no') then lower(label_text) end, 'unanswerable') as answer from c""")
def answer_priority(spark, d):
    return _answers(spark, d).select("candidate_id", seeds.answer_text(F.col("a")).alias("answer"))


@query(f"""with {o.ONE}, n as (select candidate_id, {o.norm('evidence_span')} as a, {o.norm('chunk_text')} as b, case when contains(label_text, ' | ') then label_text end as l from c),
s as (select candidate_id, 1 as k, 0 as i, a as x from n union all select candidate_id, 2, 0, b from n union all select candidate_id, 3, u.i, {o.norm('u.x')} from n, unnest(string_split(l, ' | ')) with ordinality as u(x, i)),
f as (select candidate_id, x, min(k * 100000 + i) as r from s where x <> '' group by candidate_id, x) select candidate_id, string_agg(x, '¦' order by r) as spans from f group by candidate_id""")
def evidence_span_union(spark, d):
    return _answers(spark, d).select("candidate_id", F.array_join(seeds.evidence_spans(F.col("a")), "¦").alias("spans")).where("spans <> ''")


def _claims(spark, d):
    """Claims over documents as abstracts: each claim cites every sentence of all documents
    of its paper, in rationales of two neighbours; places out of range are among them."""
    c = candidates(spark, d).where("source_dataset = 'scifact'")
    dd = t(spark, d, "documents").where("source_dataset = 'scifact'").select("doc_id", F.col("paper_id").alias("title"), F.split(F.coalesce("text", F.lit("")), "\n").alias("abstract"), F.lit(False).alias("structured"))
    per = dd.where("title is not null").groupBy(F.col("title").alias("paper_id")).agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("doc"), F.size("abstract").alias("n"))).alias("ds"))
    label = F.when(F.col("relation_type") == "supports", "SUPPORT").when(F.col("relation_type") == "contradicts", "CONTRADICT").otherwise("")
    pairs = lambda n: F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), lambda i: F.struct(label.alias("label"), F.array(i, i + 1, F.lit(-1), F.lit(100000)).alias("sentences")))
    evidence = F.map_from_entries(F.transform("ds", lambda x: F.struct(x["doc"], pairs(x["n"]))))
    claims = c.join(per, "paper_id").select(F.col("relation_type").alias("split"), F.xxhash64("candidate_id").alias("id"), F.col("label_text").alias("claim"), evidence.alias("evidence"), "candidate_id")
    return claims, dd


_CA = f"""{o.ONE}, da as (select doc_id as doc, paper_id, string_split(coalesce(text, ''), chr(10)) as ab from documents where source_dataset = 'scifact' and paper_id is not null),
ca as (select candidate_id, relation_type, {o.norm('label_text')} as claim, doc, ab from c join da on da.paper_id = c.paper_id where c.source_dataset = 'scifact' and {o.norm('label_text')} <> ''),
sa as (select ca.*, concat_ws(' ', nullif({o.norm('ab[2 * r + 1]')}, ''), nullif({o.norm('ab[2 * r + 2]')}, '')) as span from ca, unnest(range((len(ab) + 1) // 2)) as u(r))"""


@query(f"with {_CA} select claim, cast(doc as varchar) as paper_id, case relation_type when 'supports' then 'supports' when 'contradicts' then 'contradicts' else 'related_to' end as relation_type, span as evidence_span from sa where span <> ''")
def claim_evidence_join(spark, d):
    claims, corpus = _claims(spark, d)
    return seeds.claim_corpus(claims, corpus)[1].select("claim", "paper_id", "relation_type", "evidence_span")


@query(f"with {_CA} select distinct 'scifact:' || cast(doc as varchar) || ':abstract' as chunk_id from ca")
def used_docs(spark, d):
    claims, corpus = _claims(spark, d)
    return seeds.claim_corpus(claims, corpus)[0].select("chunk_id")


def _sentences(spark, d):
    """Each entity candidate's sentence with its label and first words as mentions."""
    c = candidates(spark, d).where("source_dataset = 'scier' and chunk_text is not null and label_text is not null")
    first, last = F.get(F.split(norm(F.col("chunk_text")), " "), 0), F.get(F.split(norm(F.col("chunk_text")), " "), -1 + F.size(F.split(norm(F.col("chunk_text")), " ")))
    ner = F.array(F.array("label_text", F.lit("Method")), F.array(first, F.lit("Task")), F.array(F.upper(first), F.lit("Method")))
    rel = F.array(F.array(F.concat("label_text", F.lit(":Method")), F.lit("Used-For"), F.lower(first)), F.array(last, F.lit("Part-Of"), F.lit("no such mention")))
    return c.select("candidate_id", F.lit("train").alias("split"), F.xxhash64("candidate_id").alias("row_idx"), F.col("candidate_id").alias("doc_id"), F.col("chunk_text").alias("sentence"), ner.alias("ner"), F.lit(None).cast("array<array<string>>").alias("rel"), rel.alias("rel_plus"))


@query(f"""with {o.ONE}, s as (select candidate_id, {o.norm('label_text')} as lab, split_part({o.norm('chunk_text')}, ' ', 1) as w, lower({o.norm("split_part(label_text, ':', 1)")}) as src from c where source_dataset = 'scier' and {o.norm('chunk_text')} <> '' and label_text is not null),
m as (select candidate_id, 1 as i, lower(lab) as t, 'method' as k from s where lab <> '' union all select candidate_id, 2, lower(w), 'concept' from s where {o.norm('w')} <> '' union all select candidate_id, 3, lower(upper(w)), 'method' from s where {o.norm('w')} <> ''),
b as (select candidate_id, t, arg_max(i, i) as i, arg_max(k, i) as k from m group by candidate_id, t)
select s.candidate_id, x.k || '-' || cast(x.i as varchar) as source, y.k || '-' || cast(y.i as varchar) as target from s join b x on x.candidate_id = s.candidate_id and x.t = s.src join b y on y.candidate_id = s.candidate_id and y.t = lower(s.w)""")
def mention_resolution(spark, d):
    rows = _sentences(spark, d)
    _, _, made = seeds.sentence_corpus(rows)
    r = made.select(F.col("paper_id").alias("candidate_id"), F.explode("labels.relations").alias("r"))
    short = lambda c: F.concat_ws("-", F.substring_index(c, "-", 1), F.substring_index(c, "-", -1))
    return r.select("candidate_id", short(F.col("r.source_id")).alias("source"), short(F.col("r.target_id")).alias("target"))


@query(f"""with w as (select doc_id, string_split({o.norm('text')}, ' ') as ws from documents), s as (select doc_id, ws, len(ws) as n, doc_id % 11 as st, doc_id % 11 + doc_id % 7 as en from w)
select doc_id, case when st < n then array_to_string(list_slice(ws, st + 1, case when en <= n then en else least(en + 1, n) end), ' ') else '' end as span from s""")
def token_span_slice(spark, d):
    w = spread(t(spark, d, "documents")).select("doc_id", F.split(norm(F.col("text")), " ").alias("ws"))
    st = (F.col("doc_id") % 11).cast("int")
    return w.select("doc_id", seeds.span_text(F.col("ws"), st, st + (F.col("doc_id") % 7).cast("int")).alias("span"))


@query(f"""with {o.ONE}, r as (select candidate_id, {o.norm('label_text')} as lab, substr({o.norm('chunk_text')}, 1, 800) as evidence_span from c where source_dataset = 'scirex'),
u as (select candidate_id, 1 as i, lab as raw, evidence_span from r where starts_with(lab, '{{') union all select candidate_id, case when starts_with(lab, '{{') then 2 else 1 end, '{{"raw":["a","b"]}}', evidence_span from r
  union all select candidate_id, 3, lab, evidence_span from r where starts_with(lab, '{{'))
select candidate_id, cast(i as int) as i, 'document_level_relation' as type, raw as raw_relation, evidence_span from u""")
def relation_union(spark, d):
    c = candidates(spark, d).where("source_dataset = 'scirex'")
    lab = norm(F.col("label_text"))
    rows = c.select(
        F.lit("train").alias("split"), F.xxhash64("candidate_id").alias("row_idx"), F.col("candidate_id").alias("doc_id"), F.lit(None).cast("string").alias("doc_key"), F.split(norm(F.col("chunk_text")), " ").alias("words"), F.lit(None).cast("array<array<string>>").alias("sentences"), F.lit(None).cast("string").alias("ner"),
        F.array(lab).alias("n_ary_relations"), F.array(F.lit('["a","b"]'), F.lit("no relation")).alias("relations"), F.array(lab).alias("relation"),
    )
    made = seeds.document_corpus(rows)[2]
    out = made.select(F.col("paper_id").alias("candidate_id"), F.posexplode("labels.relations").alias("i", "r"))
    return out.select("candidate_id", (F.col("i") + 1).alias("i"), "r.type", "r.raw_relation", "r.evidence_span")


@query(f"""with {o.ONE}, r as (select candidate_id, string_split({o.norm('chunk_text')}, ' ') as ws, hash(candidate_id) as h from c where source_dataset = 'scirex' and {o.norm('chunk_text')} <> ''),
e as (select candidate_id, 1 as i, 'Method' as type, list_slice(ws, 1, 2) as x from r union all select candidate_id, 2, 'Task', list_slice(ws, 2, 4) from r union all select candidate_id, 3, 'method', ws from r)
select candidate_id, cast(i as int) as i, type, case when type = 'Task' then 'concepts' else 'methods' end as bucket, array_to_string(x, ' ') as text from e where array_to_string(x, ' ') <> ''""")
def document_entities(spark, d):
    """Entities by their spans: two words, three from the second on, and a span beyond the end."""
    c = candidates(spark, d).where("source_dataset = 'scirex'").where(norm(F.col("chunk_text")) != "")
    rows = c.select(
        F.lit("train").alias("split"), F.xxhash64("candidate_id").alias("row_idx"), F.col("candidate_id").alias("doc_id"), F.lit(None).cast("string").alias("doc_key"), F.split(norm(F.col("chunk_text")), " ").alias("words"),
        F.lit(None).cast("array<array<string>>").alias("sentences"), F.lit('[[[0,2,"Method"],[1,4,"Task"]],[[0,1000000,"method"]]]').alias("ner"), *[F.lit(None).cast("array<string>").alias(x) for x in ("n_ary_relations", "relations", "relation")],
    )
    e = seeds.document_corpus(rows)[1]
    return e.select(F.col("paper_id").alias("candidate_id"), F.element_at(F.split("id", "-"), -1).cast("int").alias("i"), "type", "bucket", "text")


@query("select p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') as slug from part")
def slug_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


@query("select doc_id, substr(sha1(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || cast(doc_id as varchar)), 1, 16) as id from documents")
def stable_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


def _seed_rows(spark, d):
    """Seed rows of the labels of each chunk, from the candidates."""
    c = candidates(spark, d).where("chunk_id is not null")
    fields = dict(id="label_id", text="label_text", type="relation_type", evidence_span="evidence_span", source_id="source_id", target_id="target_id")
    label = F.struct(*[(F.col(fields[n]) if n in fields else F.lit(None)).alias(n) for n in [f.split(":")[0] for f in sampling.LABEL[7:-1].split(",")]]).cast(sampling.LABEL)
    lists = {b: F.transform(F.array_sort(F.collect_list(F.when(F.col("label_bucket") == b, F.struct("candidate_id", label.alias("l"))))), lambda x: x["l"]).alias(b) for b in sampling.BUCKETS}
    g = c.groupBy("source_dataset", "paper_id", "chunk_id").agg(F.min("chunk_text").alias("chunk_text"), *lists.values())
    blank = F.lit("").alias
    return g.select(F.concat_ws("/", "source_dataset", F.coalesce("paper_id", F.lit("")), "chunk_id").alias("id"), "source_dataset", blank("status"), "paper_id", blank("title"), blank("source_pdf"), blank("section"), F.lit(None).cast("int").alias("page"), "chunk_id", "chunk_text", blank("question"), F.struct(*sampling.BUCKETS).alias("labels"))


_SEEDED = f"""{o.ONE}, k as (select candidate_id, source_dataset, paper_id, chunk_id, label_bucket, label_id, label_text, evidence_span, relation_type, source_id, target_id,
  min(chunk_text) over (partition by source_dataset, paper_id, chunk_id) as chunk_text, row_number() over (partition by source_dataset, paper_id, chunk_id, label_bucket order by candidate_id) - 1 as i,
  count(*) over (partition by source_dataset, paper_id, chunk_id, label_bucket) as n from c where chunk_id is not null),
lim as (select *, case when source_dataset = 'scirex' then case label_bucket when 'methods' then 3 when 'concepts' then 3 when 'relations' then 5 end end as m from k),
kept as (select * from lim where m is null or n <= m or i in (select cast(round_even(cast(j * (n - 1) as double) / (m - 1), 0) as bigint) from unnest(range(m)) as u(j)))"""


_ABOUT = lambda x: f"coalesce(nullif({o.norm(x + '.label_text')}, ''), {o.norm(x + '.relation_type')})"
_IDS = ["source_dataset", "paper_id", "chunk_id", "seed_id", "label_bucket", "target_bucket", "label_id", "label_text", "relation_type", "source_id", "target_id", "evidence_span"]
_OWN = lambda c: f"case when label_bucket = 'relations' then {o.norm(c)} else '' end as {c}"


@query(f"""with {_SEEDED},
cm as (select coalesce(paper_id, '') as p, chunk_id, {o.norm('label_id')} as lid, arg_min({_ABOUT('c')}, candidate_id) as txt, min(candidate_id) as first from c
  where chunk_id is not null and source_dataset = 'scifact' and label_bucket = 'claims' group by 1, 2, 3),
c1 as (select p, chunk_id, arg_min(txt, first) as txt from cm group by 1, 2),
mc as (select source_dataset, coalesce(paper_id, '') as p, chunk_id, bool_or(label_bucket = 'methods') and bool_or(label_bucket = 'concepts') as mixed from c where chunk_id is not null group by 1, 2, 3),
w as (select kept.source_dataset, kept.label_bucket, kept.candidate_id as given, kept.chunk_text as raw_chunk, kept.label_text as raw_label, lower({o.norm('kept.relation_type')}) as kind, kept.source_id as s0, kept.target_id as t0, mixed,
  {o.norm('kept.paper_id')} as paper_id, {o.norm('kept.chunk_id')} as chunk_id, {o.norm("kept.source_dataset || '/' || coalesce(kept.paper_id, '') || '/' || kept.chunk_id")} as seed_id, {o.norm('kept.label_id')} as label_id, {o.norm('kept.evidence_span')} as evidence_span,
  {_ABOUT('kept')} as own, case when kept.source_dataset = 'scifact' then coalesce(cm.txt, c1.txt) end as about, relation_type, source_id, target_id
  from kept join mc on mc.source_dataset = kept.source_dataset and mc.p = coalesce(kept.paper_id, '') and mc.chunk_id = kept.chunk_id
  left join cm on kept.source_dataset = 'scifact' and cm.p = coalesce(kept.paper_id, '') and cm.chunk_id = kept.chunk_id and cm.lid = {o.norm('kept.source_id')}
  left join c1 on kept.source_dataset = 'scifact' and c1.p = coalesce(kept.paper_id, '') and c1.chunk_id = kept.chunk_id
  where kept.source_dataset <> 'scifact' or (kept.label_bucket = 'relations' and lower({o.norm('kept.relation_type')}) in ('supports', 'contradicts'))),
v as (select source_dataset, paper_id, chunk_id, seed_id, label_bucket, case when source_dataset = 'scifact' then kind else label_bucket end as target_bucket, label_id, coalesce(about, own) as label_text, {_OWN('relation_type')}, {_OWN('source_id')}, {_OWN('target_id')}, evidence_span,
  concat_ws(',', case when length({o.norm('raw_chunk')}) >= 1600 then 'long_chunk' end, case when evidence_span <> '' and not contains({o.norm('raw_chunk')}, evidence_span) then 'evidence_span_mismatch' end,
    case when label_bucket = 'relations' and (coalesce(s0, '') <> '' or coalesce(t0, '') <> '') then 'relation_endpoints' end, case when label_bucket = 'relations' and kind = 'contradicts' then 'contradicts_relation' end,
    case when mixed then 'method_and_concept_same_chunk' end, case when own = '' then 'empty_or_ambiguous_label' end) as hard_cases from w)
select 'cand-' || substr(sha1({" || chr(31) || ".join(_IDS)}), 1, 16) as candidate_id, {', '.join(_IDS)}, hard_cases from v""")
def seed_candidates(spark, d):
    return sampling.candidates(_seed_rows(spark, d)).select("candidate_id", *_IDS, F.array_join("hard_cases", ",").alias("hard_cases"))


_DK = ", ".join(f"coalesce({c}, '')" for c in o.DEDUPE_KEY)


@query(f"with {o.ONE}, r as (select candidate_id, row_number() over (partition by {_DK} order by candidate_id) as n from (select * exclude (rn) from c)) select candidate_id from r where n = 1")
def candidates_dedup(spark, d):
    return sampling.dedupe(candidates(spark, d), "candidate_id").select("candidate_id")


@query(f"""with l as (select doc_id, string_split({o.norm('text')}, ' ') as ws from documents), n as (select *, len(ws) as n, cast(2 + doc_id % 4 as int) as k from l)
select doc_id, case when n <= k then array_to_string(ws, ' ') else (select string_agg(ws[cast(round_even(cast(j * (n - 1) as double) / (k - 1), 0) as bigint) + 1], ' ' order by j) from unnest(range(k)) as u(j)) end as picked from n""")
def representative_labels(spark, d):
    ws = F.split(norm(F.col("text")), " ")
    return spread(t(spark, d, "documents")).select("doc_id", F.array_join(sampling.representative(ws, (F.col("doc_id") % 4 + 2).cast("int")), " ").alias("picked"))


_FLAT = o.TARGETS
_SAMPLE = f"""{o.ONE}, tg(source_dataset, target_bucket, quota) as (values {', '.join(f"('{a}', '{b}', {n})" for a, b, n in _FLAT)}),
p as (select candidate_id, source_dataset, target_bucket, coalesce(paper_id, '') as paper_id, len(hard_cases) as hc, sha256('13|' || candidate_id) as h1, sha256('14|' || candidate_id) as h2 from c),
k1 as (select *, row_number() over (partition by source_dataset, target_bucket, paper_id order by hc desc, h1, paper_id, candidate_id) as k from p),
g1 as (select *, row_number() over (partition by source_dataset, target_bucket order by k > 1, hc desc, h1, paper_id, candidate_id) as g from k1),
s1 as (select g1.candidate_id, g1.source_dataset, g1.target_bucket from g1 join tg on tg.source_dataset = g1.source_dataset and tg.target_bucket = g1.target_bucket where g <= quota),
df as (select tg.source_dataset, tg.target_bucket, tg.quota - count(s1.candidate_id) as deficit from tg left join s1 on s1.source_dataset = tg.source_dataset and s1.target_bucket = tg.target_bucket group by tg.source_dataset, tg.target_bucket, tg.quota),
ms as (select source_dataset, sum(deficit) as quota from df group by source_dataset having sum(deficit) > 0),
k2 as (select p.*, row_number() over (partition by source_dataset, paper_id order by hc desc, h2, paper_id, candidate_id) as k from p where candidate_id not in (select candidate_id from s1)),
g2 as (select *, row_number() over (partition by source_dataset order by k > 1, hc desc, h2, paper_id, candidate_id) as g from k2),
s2 as (select g2.candidate_id, g2.source_dataset from g2 join ms on ms.source_dataset = g2.source_dataset where g <= ms.quota)"""


_BACKFILL = f"""{_SAMPLE}, lf as (select {sum(n for *_, n in _FLAT)} - (select count(*) from s1) - (select count(*) from s2) as quota),
p3 as (select *, sha256('15|' || candidate_id) as h3 from p where candidate_id not in (select candidate_id from s1) and candidate_id not in (select candidate_id from s2)),
k3 as (select *, row_number() over (partition by paper_id order by hc desc, h3, candidate_id) as k from p3),
g3 as (select *, row_number() over (order by k > 1, hc desc, h3, paper_id, candidate_id) as g from k3),
s3 as (select candidate_id from g3, lf where g <= lf.quota)"""


@query(f"with {_BACKFILL} select candidate_id, 'target' as pick from s1 union all select candidate_id, 'dataset' from s2 union all select candidate_id, 'global' from s3")
def stratified_sample(spark, d):
    return sampling.sample(candidates(spark, d))[0].select("candidate_id", "pick")


@query(f"with {_SAMPLE} select source_dataset, target_bucket, cast(deficit as bigint) as deficit from df where deficit > 0")
def sample_deficits(spark, d):
    return sampling.sample(candidates(spark, d), backfill=False)[1]


_LABEL_COLUMNS = ["status", "confidence", "corrected_label_bucket", "corrected_label_text", "corrected_evidence_span"]


def labelled(spark, d):
    return harness.label(candidates(spark, d))


def _flat(df, name):
    return df.select("candidate_id", *[F.col(f"{name}.{c}").alias(c) for c in _LABEL_COLUMNS], F.array_join(f"{name}.reason_codes", ",").alias("reasons"))


@query(f"with {o.STANDARD} select candidate_id, status, confidence, cb as corrected_label_bucket, ct as corrected_label_text, ce as corrected_evidence_span, reasons from s")
def label_standard(spark, d):
    return _flat(labelled(spark, d), "auto_label")


@query(f"with {o.STRICT} select candidate_id, xstatus as status, xconfidence as confidence, case when xstatus = 'edit' then b else '' end as corrected_label_bucket, case when xstatus = 'edit' then lab else '' end as corrected_label_text, case when xstatus = 'edit' and exact then ev else '' end as corrected_evidence_span, xreason as reasons from x where status = 'edit'")
def label_strict(spark, d):
    return _flat(harness.label(staged(labelled(spark, d)), "strict-edit-pass", "edit"), "strict_auto_label")


@query(f"with {o.STANDARD}, k(status) as (values ('accept'), ('edit'), ('reject')) select k.status, count(s.candidate_id) as n from k left join s on s.status = k.status group by k.status")
def label_counts(spark, d):
    return harness.status_counts(labelled(spark, d))


@query(f"with {o.STANDARD} select candidate_id, 'auto-label-v1; confidence=' || printf('%.2f', confidence) || '; reasons=' || reasons as notes, status as review_status from s")
def review_sheet(spark, d):
    return harness.review_rows(labelled(spark, d)).select("candidate_id", "notes", "review_status")


def merged(spark, d):
    auto = staged(labelled(spark, d))  # as the files between the two passes
    return sft.merge_labels(auto, harness.label(auto, "strict-edit-pass", "edit").select("candidate_id", "strict_auto_label"))


@query(f"with {o.EFFECTIVE} select candidate_id, estatus as status, ereasons as reasons, coalesce(nullif(ect, ''), lab) as label_text, coalesce(nullif(ece, ''), ev) as evidence_span from e")
def effective_labels(spark, d):
    return merged(spark, d).select("candidate_id", F.col("effective.status").alias("status"), F.array_join("effective.reason_codes", ",").alias("reasons"), sft.corrected("label_text").alias("label_text"), sft.corrected("evidence_span").alias("evidence_span"))


@query(f"select source_dataset, paper_id, {o.SPLIT} as split from (select distinct source_dataset, paper_id from papers)")
def hash_split(spark, d):
    return t(spark, d, "papers").select("source_dataset", "paper_id").distinct().withColumn("split", sft.split_name(F.col("paper_id")))


_CK = f"coalesce(nullif({o.norm('chunk_id')}, ''), {o.norm('candidate_id')})"


_ITEM = {
    "claims": "'id', ident, 'section', section, 'text', txt", "methods": "'id', ident, 'name', txt, 'section', section", "experiments": "'id', ident, 'section', section, 'summary', txt",
    "limitations": "'id', ident, 'section', section, 'text', txt", "concepts": "'id', ident, 'name', txt, 'section', section",
    "relations": "'id', ident, 'section', section, 'source_id', src, 'source_text', txt, 'target_id', tgt, 'type', coalesce(nullif(rtype, ''), 'related-to')",
}
_LISTS = ", ".join(f"'{b}', coalesce(to_json(list(json_object('evidence_span', evid, {_ITEM[b]}) order by candidate_id) filter (where bk = '{b}')), json('[]'))" for b in sorted(_ITEM))


@query(f"""with {o.EFFECTIVE}, k as (select *, {_CK} as ck, coalesce(nullif(ecb, ''), {o.norm('b0')}) as bk, coalesce(nullif(label_id, ''), {o.norm('candidate_id')}) as ident, coalesce(nullif({o.norm('ect')}, ''), lab) as txt, coalesce(nullif({o.norm('ece')}, ''), ev) as evid
  from (select e.*, c.label_bucket as b0, {o.norm('c.title')} as title from e join c on c.candidate_id = e.candidate_id) where estatus = 'accept'),
fst as (select ck, min(candidate_id) as fc, count(*) as n, json_object({_LISTS}) as graph from k group by ck)
select fst.ck as chunk_id, {o.norm('paper_id')} as paper_id, cast(n as bigint) as n_items, {o.SPLIT} as split, cast(json_object('chunk_text', k.ch, 'paper_id', {o.norm('paper_id')}, 'section', section, 'title', title) as varchar) as asked, cast(graph as varchar) as told
from fst join k on k.candidate_id = fst.fc""")
def extractor_sft(spark, d):
    m = F.col("messages")
    return sft.extractor_examples(merged(spark, d)).select("chunk_id", "paper_id", "n_items", "split", m[1]["content"].alias("asked"), m[2]["content"].alias("told"))


@query(f"""with {o.EFFECTIVE} select candidate_id, {o.norm('paper_id')} as paper_id, {o.SPLIT} as split, estatus as verdict,
cast(json_object('candidate', json_object('evidence_span', ev, 'label_bucket', (select {o.norm('label_bucket')} from c where c.candidate_id = e.candidate_id), 'label_text', lab, 'relation_type', rtype, 'source_id', src, 'target_id', tgt), 'chunk_text', ch) as varchar) as asked,
cast(json_object('corrected_candidate', case when estatus = 'edit' then json_object('evidence_span', ece, 'label_bucket', ecb, 'label_text', ect) end, 'reason_codes', to_json(string_split(ereasons, ',')), 'verdict', estatus) as varchar) as told from e""")
def judge_sft(spark, d):
    m = F.col("messages")
    return sft.judge_examples(merged(spark, d)).select("candidate_id", "paper_id", "split", "verdict", m[1]["content"].alias("asked"), m[2]["content"].alias("told"))


@query(f"with {o.EFFECTIVE}, z as (select {o.SPLIT} as split, estatus as verdict from e) select split, verdict, count(*) as n from z group by split, verdict")
def sft_stats(spark, d):
    return sft.judge_examples(merged(spark, d)).groupBy("split", "verdict").agg(F.count("*").alias("n"))


_EMPTY = '{"claims":[],"methods":[],"experiments":[],"limitations":[],"concepts":[],"relations":[]}'
_FORMS = [lambda p: F.concat(F.lit("```json\n"), p, F.lit("\n```")), lambda p: F.concat(F.lit("Sure: "), p), lambda p: F.lit(_EMPTY), lambda p: F.concat(F.lit("{"), p), lambda p: F.lit('["a"]')]


@query("""select cast(event_id as varchar) as chunk_id, props is not null and event_id % 5 in (0, 1) or event_id % 5 = 2 as json_valid, event_id % 5 = 2 as schema_ok from events""")
def json_payload_eval(spark, d):
    k, text = F.col("event_id") % 5, F.lit(None).cast("string")
    for i, f in enumerate(_FORMS):
        text = F.when(k == i, f(F.col("props"))).otherwise(text)
    return sft.validity(t(spark, d, "events").select(F.col("event_id").cast("string").alias("chunk_id"), text.alias("text"))).select("chunk_id", "json_valid", "schema_ok")


@query("""select count(*) as total, count(*) filter (where props is not null and event_id % 5 in (0, 1) or event_id % 5 = 2) as json_valid, count(*) filter (where event_id % 5 = 2) as schema_ok from events""")
def json_payload_summary(spark, d):
    return sft.validity_summary(json_payload_eval(spark, d))


_PN = f"lower({o.norm('label_text')})"


@query(f"""with {o.ONE}, g as (select distinct chunk_id, label_bucket as type, {_PN} as k from c where chunk_id is not null), p as (select distinct chunk_id, type, case when length(k) % 3 = 0 then k || ' x' else k end as k from g where length(k) % 4 <> 0),
b as (select coalesce(g.type, p.type) as type, count(g.k) as gold, count(p.k) as predicted, count(case when g.k is not null and p.k is not null then 1 end) as matched from g full join p on g.chunk_id = p.chunk_id and g.type = p.type and g.k = p.k group by 1)
select type, gold, predicted, matched, cast(matched as double) / predicted as precision, cast(matched as double) / gold as recall, cast(2 * matched as double) / (gold + predicted) as f1 from b""")
def eval_prf(spark, d):
    gold = candidates(spark, d).where("chunk_id is not null").select("chunk_id", F.col("label_bucket").alias("type"), F.lower(norm(F.col("label_text"))).alias("text")).distinct()
    n = F.length("text")
    return sft.prf(gold, gold.where(n % 4 != 0).withColumn("text", F.when(n % 3 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))))


@query(f"with {o.FEATURES} select ds as source_dataset, count(*) as spans, count(*) filter (where not exact) as unsupported from g where ev <> '' group by ds")
def evidence_hallucination(spark, d):
    c = candidates(spark, d).withColumn("ev", norm(F.col("evidence_span"))).where("ev <> ''")
    inside = F.lower(norm(F.col("chunk_text"))).contains(F.lower("ev"))
    return c.groupBy(F.lower(norm(F.col("source_dataset"))).alias("source_dataset")).agg(F.count("*").alias("spans"), F.count_if(~inside).alias("unsupported"))


def _folder(spark: SparkSession) -> str:
    """A new folder within the one that all executors share."""
    folder = Path("/" + new_folder(spark, "files").removeprefix("file:").lstrip("/"))
    folder.mkdir(parents=True)
    return str(folder)


def _write_files(rows: DataFrame, folder: str | Path) -> None:
    """rows(name, text): a UTF-8 file each, written where the rows are."""
    folder = str(folder)

    def put(batches):
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                Path(folder, name).write_bytes((text or "").encode())
            yield pdf[["name"]]

    rows.select("name", "text").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()


MAP_CHARS = 1 << 20  # of a file of several papers


def _write_maps(members: DataFrame, folder: str) -> None:
    """members(member): '"key":value' texts, joined to files of one JSON object each, of about
    MAP_CHARS and written where the rows are. A task that runs again first deletes its files."""

    def put(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for old in Path(folder).glob(f"{part}-*.json"):
            old.unlink()
        held, size, files = [], 0, 0
        for pdf in batches:
            for x in pdf["member"]:
                held.append(x)
                size += len(x)
                if size >= MAP_CHARS:
                    Path(folder, f"{part}-{files}.json").write_text("{" + ",".join(held) + "}", encoding="utf-8")
                    held, size, files = [], 0, files + 1
            yield pdf[["member"]].head(0)
        if held:
            Path(folder, f"{part}-{files}.json").write_text("{" + ",".join(held) + "}", encoding="utf-8")

    members.select("member").mapInPandas(put, "member string").write.format("noop").mode("overwrite").save()


def _document_files(spark: SparkSession, d: str, folder: str | Path) -> None:
    """Each document as a file named by its id, with suffixes of all kinds that are read."""
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".txt"))), (F.pmod("doc_idx", F.lit(3)) + 1).cast("int"))
    _write_files(docs(spark, d).select(F.concat("paper_id", suffix).alias("name"), "text"), folder)


_FILES = f"with {o.ITEMS} select cast(doc_id as varchar) as paper_id, item_id, text from it"


@query(_FILES)
def directory_ingest(spark, d):
    folder = Path(_folder(spark))
    _document_files(spark, d, folder)
    (folder / "skip.csv").write_text("# no paper\n- Claim: none\n", encoding="utf-8")
    dd = readers.text_documents(spark, str(folder))
    return extract.items(staged(parse.markdown_sections(dd)), stage=True).select("paper_id", "item_id", "text")


@query(_FILES)
def stream_items(spark, d):
    folder = Path(_folder(spark))
    (folder / "in").mkdir()
    _document_files(spark, d, folder / "in")
    ingest.write_items(ingest.paper_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("paper_id", "item_id", "text")


@query(f"with {o.ONE} select candidate_id, label_text from c")
def jsonl_roundtrip(spark, d):
    folder = _folder(spark)
    sinks.write_json_lines(candidates(spark, d).select("candidate_id", "label_text"), f"{folder}/x")
    return readers.json_lines(spark, f"{folder}/x/*.json", "candidate_id string, label_text string").select("candidate_id", "label_text")


_BACK = ", ".join(f"nullif({x}, '') as {y}" for x, y in zip(["cast(it.doc_id as varchar)", "tit.title", "item_type", "item_id", "text", "section", "''", "evidence_span", "cast(confidence as varchar)"], sinks.MATRIX))


@query(f"with {o.ITEMS} select {_BACK} from it join tit on tit.doc_id = it.doc_id")
def csv_roundtrip(spark, d):
    folder = _folder(spark)
    sinks.write_evidence_matrix(report.evidence_matrix(parse.document_titles(docs(spark, d)), items(spark, d)), f"{folder}/m")
    return spark.read.csv(f"{folder}/m", header=True, escape='"', multiLine=True, lineSep="\r\n")


def _qa_papers(spark, d):
    """(paper_id, title, full_text, qas): sections in order, their paragraphs, and the questions of
    the candidates, each with all its answers."""
    own = "source_dataset = 'qasper' and paper_id is not null"
    s = t(spark, d, "sections").where(own).select("section_id", "paper_id", "section_idx", "title", "text").distinct()
    part = F.struct(F.coalesce("title", F.lit("")).alias("section_name"), F.split(F.coalesce("text", F.lit("")), "\n\n").alias("paragraphs"))
    texts = s.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "section_id", part.alias("x")))), lambda x: x["x"]).alias("full_text"))
    c = candidates(spark, d, "source_dataset", "paper_id", "question", "label_text", "evidence_span").where(own)
    low = F.lower(norm(F.col("label_text")))
    yes = F.when(low == "yes", True).when(low == "no", False)
    several = F.col("label_text").contains(" | ")
    free = F.when(yes.isNull() & (low != "unanswerable") & ~F.coalesce(several, F.lit(False)), F.col("label_text"))
    a = F.struct(F.when(several, F.split("label_text", r" \| ")).alias("extractive_spans"), free.alias("free_form_answer"), yes.alias("yes_no"), (low == "unanswerable").alias("unanswerable"), F.array("evidence_span").alias("evidence"))
    q = c.groupBy("paper_id", "question").agg(F.min("candidate_id").alias("question_id"), F.array_sort(F.collect_list(F.struct("candidate_id", F.struct(a.alias("answer")).alias("x")))).alias("xs"))
    one = F.struct("question", "question_id", F.transform("xs", lambda x: x["x"]).alias("answers"))
    qas = q.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("question_id", one.alias("x")))), lambda x: x["x"]).alias("qas"))
    p = t(spark, d, "papers").where(own).groupBy("paper_id").agg(F.min("title").alias("title"))
    return p.join(texts, "paper_id", "left").join(qas, "paper_id", "left")


@query()
def qa_corpus_records(spark, d):
    folder = _folder(spark)
    body = F.to_json(F.create_map("paper_id", F.struct("title", "full_text", "qas")))
    _write_maps(_qa_papers(spark, d).select(body.alias("body")).selectExpr("substring(body, 2, length(body) - 2) as member"), folder)
    papers = readers.by_split({"train": readers.json_map(spark, f"{folder}/", seeds.QA_PAPER).select("pos", F.col("key").alias("paper_id"), "value.*")})
    return seeds.question_corpus(papers)[1].select("id", "paper_id", "label_hint", "answer_text", "evidence_span", "chunk_id")
