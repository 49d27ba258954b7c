"""SQL fragments that the oracle statements share.

All constants are written out here a second time, so that a wrong one in an operator
shows as a difference.
"""

# White space, line ends, and the rules' word lists.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
MARKERS = {
    "claim": ("claim", "Claim"), "method": ("method", "Method"), "experiment": ("experiment", "Experiment"), "result": ("result", "Experiment"), "limitation": ("limitation", "Limitation"), "concept": ("concept", "Concept"),
    "주장": ("claim", "Claim"), "방법": ("method", "Method"), "실험": ("experiment", "Experiment"), "결과": ("result", "Experiment"), "한계": ("limitation", "Limitation"), "개념": ("concept", "Concept"),
}
KINDS = {
    "Claim": ["abstract", "초록", "요약"], "Method": ["method", "methods", "methodology", "방법", "approach"],
    "Experiment": ["experiment", "experiments", "evaluation", "result", "results", "실험", "평가", "결과"], "Limitation": ["limitation", "limitations", "한계"],
}
PAPER_EDGES = {"Claim": "paper_has_claim", "Method": "paper_uses_method", "Experiment": "paper_reports_experiment", "Limitation": "paper_has_limitation"}
NAMES = {"Claim": "주장", "Method": "방법", "Experiment": "실험/결과", "Limitation": "한계", "Concept": "개념"}
INTENTS = {"Claim": ["주장", "claim"], "Method": ["방법", "method"], "Experiment": ["실험", "experiment", "result", "performance"], "Limitation": ["한계", "limitation"], "Concept": ["개념", "concept"]}
UNKNOWN = "질문 의도를 파악하지 못했습니다. '주장', '방법', '실험', '한계', '개념'처럼 질문해 보세요."
HEADINGS = """abstract|초록|요약|introduction|서론|background|관련 연구|related work|method|methods|methodology|방법|approach|experiment|experiments|evaluation|실험|평가|result|results|결과|
discussion|논의|limitation|limitations|한계|conclusion|결론|references|참고문헌""".replace("\n", "").split("|")
BUCKETS = "claims methods experiments limitations concepts relations".split()
WEAK = "|n/a|na|none|null|yes|no|true|false|unanswerable|unknown".split("|")
GENERIC = "cnn rnn lstm mlp bert dropout attention transformer resnet vgg".split()
TYPED = "supports contradicts used-for part-of feature-of evaluated-with trained-with compare synonym-of".split()
METRIC_CUES = "f1 accuracy score dataset % ap map".split()
LIMIT_CUES = "limit weak fail future however challenge".split()
CLAIM_VERBS = "is are was were has have had shows show improves achieves outperforms reduces increases supports contradicts proposes uses requires enables".split()
QUESTION_CUES = {
    "methods": ["method", "approach", "algorithm", "model", "how"], "experiments": ["result", "performance", "score", "accuracy", "improvement", "experiment"],
    "limitations": ["limitation", "fail", "error", "weakness", "future work"],
}
TARGETS = [
    ("qasper", "claims", 20), ("qasper", "methods", 25), ("qasper", "experiments", 25), ("qasper", "limitations", 10), ("scifact", "supports", 35), ("scifact", "contradicts", 35),
    ("scier", "methods", 40), ("scier", "concepts", 30), ("scier", "relations", 30), ("scirex", "methods", 20), ("scirex", "concepts", 20), ("scirex", "relations", 10),
]
DEDUPE_KEY = "source_dataset paper_id chunk_id label_bucket target_bucket label_id label_text evidence_span relation_type source_id target_id".split()


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def many(xs) -> str:
    return ", ".join(q(x) for x in xs)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{SPACE}]+', ' ', 'g'))"


def any_in(x: str, cues) -> str:
    return "(" + " or ".join(f"contains({x}, {q(c)})" for c in cues) + ")"


def case(x: str, pairs) -> str:
    return f"case {x} " + " ".join(f"when {q(k)} then {v if isinstance(v, int) else q(v)}" for k, v in pairs) + " end"


LINES = f"""
l as (select doc_id, u.i as i, u.line as line, {strip('u.line')} as s
  from documents d, unnest(regexp_split_to_array(coalesce(d.text, ''), '{LINE_END}')) with ordinality as u(line, i))"""
SECTIONS = f"""{LINES},
h as (select *, starts_with(s, '#') as head, sum(case when starts_with(s, '#') then 1 else 0 end) over (partition by doc_id order by i) as n from l),
sec0 as (select doc_id, n, coalesce(nullif(max(case when head then {strip("regexp_replace(s, '^#+', '')")} end), ''), 'Document') as title,
  {strip("coalesce(string_agg(case when head then null else line end, chr(10) order by i), '')")} as text from h group by doc_id, n),
sec as (select doc_id, cast(n as int) as section_idx, title, text from sec0 where text <> ''
  union all select doc_id, 0, 'Document', {strip("coalesce(text, '')")} from documents where doc_id not in (select doc_id from sec0 where text <> '')),
ft as (select doc_id, arg_min(s, i) as f from l where s <> '' group by doc_id),
tit0 as (select d.doc_id, coalesce(case when starts_with(f, '#') then {strip("regexp_replace(f, '^#+', '')")} else f end, '') as t from documents d left join ft on ft.doc_id = d.doc_id),
tit as (select doc_id, case when t <> '' then t else cast(doc_id as varchar) end as title from tit0)"""
_VALUE = strip("substr(line, strpos(line, ':') + 1)")
ITEMS = f"""{SECTIONS},
cl0 as (select s.doc_id, s.section_idx, s.title, u.i as i, u.line as raw
  from sec s, unnest(regexp_split_to_array(s.text, '{LINE_END}')) with ordinality as u(line, i)),
cl as (select doc_id, section_idx, title, i, regexp_replace(raw, '^[-* \\t]+|[-* \\t]+$', '', 'g') as line from cl0 where {strip('raw')} <> ''),
mk0 as (select *, case when contains(line, ':') then lower({strip("split_part(line, ':', 1)")}) end as m from cl),
mk as (select *, {case('m', [(k, v[0]) for k, v in MARKERS.items()])} as prefix, {case('m', [(k, v[1]) for k, v in MARKERS.items()])} as item_type from mk0),
mi as (select doc_id, item_type, prefix, row_number() over (partition by doc_id, item_type order by section_idx, i) as ord,
  {_VALUE} as text, title as section, line as evidence_span, 1.0 as confidence from mk where item_type is not null),
fs0 as (select doc_id, section_idx, title, i, {strip("split_part(line, '. ', 1)")} as sent from mk where item_type is null),
fs as (select doc_id, section_idx, title, substr(arg_min(sent, i), 1, 500) as sent from fs0 where sent <> '' group by doc_id, section_idx, title),
fk as (select *, case {' '.join(f"when {strip('lower(title)')} in ({many(v)}) then {q(k)}" for k, v in KINDS.items())} end as item_type from fs),
fb as (select doc_id, item_type, arg_min(sent, section_idx) as sent, arg_min(title, section_idx) as section from fk where item_type is not null group by doc_id, item_type),
it as (select doc_id, item_type, cast(doc_id as varchar) || ':' || prefix || ':' || cast(ord as varchar) as item_id, cast(ord as int) as ord, text, section, evidence_span, cast(confidence as double) as confidence from mi
  union all select doc_id, item_type, cast(doc_id as varchar) || ':' || lower(item_type) || ':1', 1, sent, section, sent, cast(0.35 as double) from fb
  where not exists (select 1 from mi where mi.doc_id = fb.doc_id and mi.item_type = fb.item_type))"""
NODES = f"""{ITEMS},
nodes as (select cast(doc_id as varchar) as id, title as label, 'Paper' as type, cast(doc_id as varchar) as paper_id, '' as section, '' as evidence_span, cast(null as double) as confidence, doc_id, 0 as ord from tit
  union all select item_id, text, item_type, cast(doc_id as varchar), section, evidence_span, confidence, doc_id, ord from it)"""
CONCEPTS = f"""{ITEMS},
cit as (select doc_id, item_type, item_id, ord, section, evidence_span, lower(text) as text from it),
rel as (select m.doc_id, m.item_id as source, c.item_id as target, 'uses' as type, m.section, m.evidence_span, cast(0.6 as double) as confidence
  from cit m join cit c on m.doc_id = c.doc_id where m.item_type = 'Method' and c.item_type = 'Concept' and (contains(m.text, c.text) or contains(lower(m.evidence_span), c.text)))"""
EDGES = f"""{CONCEPTS},
edges as (select cast(doc_id as varchar) as source, item_id as target, {case('item_type', PAPER_EDGES.items())} as type, cast(doc_id as varchar) as paper_id, '' as section, '' as evidence_span, cast(null as double) as confidence
  from it where item_type <> 'Concept'
  union all select source, target, type, cast(doc_id as varchar), section, evidence_span, confidence from rel)"""
ASSESS = f"""{ITEMS},
ag as (select doc_id, count(*) as items, count(*) filter (where evidence_span <> '') as with_evidence, {', '.join(f"count(*) filter (where item_type = {q(t)}) as n_{t.lower()}" for t in NAMES)} from it group by doc_id),
a0 as (select tit.doc_id, tit.title, coalesce(items, 0) as items, coalesce(with_evidence, 0) as with_evidence, {', '.join(f"coalesce(n_{t.lower()}, 0) as n_{t.lower()}" for t in NAMES)} from tit left join ag on ag.doc_id = tit.doc_id),
a as (select *, cast(case when items = 0 then 0 else round_even(100.0 * with_evidence / items, 0) end as int) as coverage,
  coalesce(nullif(concat_ws(', ', {', '.join(f"case when n_{t.lower()} = 0 then {q(NAMES[t])} end" for t in list(NAMES)[:4])}), ''), '없음') as missing from a0)"""
INTENT = "case " + " ".join(f"when {any_in('lower(question)', w)} then {q(t)}" for t, w in INTENTS.items()) + " end"

ONE = "c as (select * from (select *, row_number() over (partition by candidate_id order by ingested_at) as rn from candidates where candidate_id is not null) where rn = 1)"
FEATURES = f"""{ONE},
f0 as (select candidate_id, paper_id, chunk_id, lower({norm('source_dataset')}) as ds, lower({norm('label_bucket')}) as b, {norm('label_text')} as lab, {norm('evidence_span')} as ev, {norm('chunk_text')} as ch,
  {norm('source_id')} as src, {norm('target_id')} as tgt, lower(coalesce(nullif({norm('relation_type')}, ''), {norm("json_extract_string(source_label, '$.type')")})) as rel,
  json_extract(source_label, '$.raw_relation') is not null as mapped, {norm('label_id')} as label_id, {norm('section')} as section, {norm('relation_type')} as rtype from c),
f1 as (select *, case when starts_with(lab, '{{') then json_valid(lab) and lab <> '{{}}' else false end as raw, regexp_full_match(lab, '[0-9.,%+\\- ]+') as num, lower(lab) as low, ev <> '' and contains(lower(ch), lower(ev)) as exact,
  case when lab = '' then 0 else length(lab) - length(replace(lab, ' ', '')) + 1 end as words from f0),
f as (select *, low in ({many(WEAK)}) or num as weak, low in ({many(GENERIC)}) as generic, {any_in('low', METRIC_CUES)} as metric, {any_in("lower(lab || ' ' || ev)", LIMIT_CUES)} as cue,
  {any_in("(' ' || low || ' ')", [f' {v} ' for v in CLAIM_VERBS])} as verb, contains(lab, '|') or length(lab) - length(replace(lab, ',', '')) >= 3 or length(lab) - length(replace(lab, ';', '')) >= 2 as lst,
  case when raw then coalesce(json_extract_string(lab, '$.Method'), '') <> '' and coalesce(json_extract_string(lab, '$.Task'), '') <> '' else false end as core from f1),
g as (select *, b = 'relations' as isr, b in ('methods', 'concepts') as ent, length(lab) < 3 as short, b = 'relations' and ds = 'scirex' and raw as sraw from f)"""


def _rules(rules) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {c} then {q(r)} end" for c, r in rules) + ")"


_ST, _OK = "(isr and not sraw and rel in ('supports', 'contradicts'))", "(lab <> '' and ev <> '' and not weak)"
_TY = f"(isr and not sraw and rel not in ('supports', 'contradicts') and rel in ({many(TYPED)}))"
_OT, _EN = f"(isr and not sraw and rel not in ({many(TYPED)}))", "(src <> '' and tgt <> '' and ev <> '')"
STANDARD = f"""{FEATURES},
r as (select *, {_rules([(f"b not in ({many(BUCKETS)})", "invalid_bucket"), ("ch = ''", "missing_chunk_text"), ("weak and not isr", "weak_atomic_label"), ("b = 'claims' and words < 4", "claim_too_short"),
  ("ent and short", "entity_too_short"), ("isr and rel = ''", "missing_relation_type"), ("sraw and not core", "raw_relation_missing_core_fields")])} as rej,
  {_rules([("not isr and ev = ''", "missing_evidence_span"), ("ev <> '' and not exact", "evidence_span_not_exact_substring"), ("ent and not short and generic", "generic_entity_needs_policy"), ("b = 'experiments' and num", "metric_without_context"),
  ("b = 'limitations' and not cue", "limitation_needs_human_confirmation"), ("sraw and core", "raw_document_relation_needs_endpoint_mapping"), (f"{_ST} and not {_OK}", "claim_relation_needs_text_or_evidence"),
  (f"{_TY} and not {_EN}", "typed_relation_missing_endpoint_or_evidence"), (f"{_OT} and mapped", "raw_relation_needs_mapping"), (f"{_OT} and not mapped", "relation_needs_human_confirmation"),
  ("ds = 'qasper' and b in ('claims', 'methods', 'experiments') and (starts_with(lab, 'FLOAT SELECTED:') or starts_with(lab, 'Table '))", "table_or_float_label_needs_cleanup")])} as ed,
  {_rules([("ent and not short and not generic and exact", "entity_with_exact_evidence"), ("b = 'experiments' and not num and metric", "experiment_metric_result"), (f"{_ST} and {_OK}", "claim_relation_with_evidence"), (f"{_TY} and {_EN}", "typed_relation_with_endpoints")])} as ac from g),
s as (select *, case when rej <> '' then 'reject' when ed <> '' then 'edit' when ac <> '' then 'accept' else 'edit' end as status,
  cast(case when rej <> '' then (case when contains(rej, 'weak_atomic_label') then 0.9 else 0.8 end) when ed <> '' then 0.7 when ac <> '' then 0.8 else 0.55 end as double) as confidence,
  case when rej <> '' then concat_ws(',', rej, nullif(ed, ''), nullif(ac, '')) when ed <> '' then concat_ws(',', ed, nullif(ac, '')) when ac <> '' then ac else 'needs_human_confirmation' end as reasons,
  case when rej = '' and (ed <> '' or ac = '') then b else '' end as cb, case when rej = '' and ed <> '' then (case when weak then '' else lab end) when rej = '' and ac = '' then lab else '' end as ct,
  case when rej = '' and (ed <> '' or ac = '') and exact then ev else '' end as ce from r)"""
_X = [
    (f"b not in ({many(BUCKETS)})", "reject", 0.95, "invalid_bucket"), ("ch = ''", "reject", 0.95, "missing_chunk_text"), ("weak and not isr", "reject", 0.95, "weak_atomic_label"),
    ("sraw and core", "edit", 0.85, "scirex_raw_relation_requires_endpoint_mapping"), ("sraw", "reject", 0.95, "raw_relation_missing_core_fields"), ("isr and rel = ''", "reject", 0.95, "missing_relation_type"),
    ("isr and rel in ('supports', 'contradicts') and lab <> '' and exact and not weak", "accept", 0.9, "claim_relation_exact_evidence"), ("isr and rel in ('supports', 'contradicts')", "reject", 0.9, "claim_relation_without_exact_evidence"),
    ("isr and src <> '' and tgt <> '' and exact", "accept", 0.9, "typed_relation_exact_endpoints_evidence"), ("isr", "reject", 0.9, "relation_without_exact_endpoint_evidence"), ("ent and short", "reject", 0.95, "entity_too_short"),
    ("ent and generic and exact", "edit", 0.8, "generic_entity_requires_schema_policy"), ("ent and generic", "reject", 0.9, "generic_entity_without_exact_evidence"), ("ent and exact", "accept", 0.9, "entity_exact_evidence"), ("ent", "reject", 0.9, "entity_without_exact_evidence"),
    ("b = 'experiments' and metric and exact and not num", "accept", 0.9, "experiment_metric_exact_evidence"), ("b = 'experiments'", "reject", 0.9, "experiment_without_metric_exact_evidence"),
    ("b = 'claims' and exact and words >= 8 and verb and not lst", "accept", 0.88, "sentence_claim_exact_evidence"), ("b = 'claims'", "reject", 0.88, "claim_not_sentence_or_exact_evidence"),
    ("b = 'limitations' and exact and cue", "accept", 0.88, "limitation_exact_evidence"), ("b = 'limitations'", "reject", 0.88, "limitation_without_explicit_signal"),
]
STRICT = f"""{STANDARD},
x as (select *, case {' '.join(f"when {c} then {q(v)}" for c, v, _, _ in _X)} end as xstatus, cast(case {' '.join(f"when {c} then {v}" for c, _, v, _ in _X)} end as double) as xconfidence,
  case {' '.join(f"when {c} then {q('strict_' + v)}" for c, _, _, v in _X)} end as xreason from s)"""
EFFECTIVE = f"""{STRICT},
e as (select *, case when status = 'edit' then xstatus else status end as estatus, case when status = 'edit' then xreason else reasons end as ereasons,
  case when status <> 'edit' then cb when xstatus = 'edit' then b else '' end as ecb, case when status <> 'edit' then ct when xstatus = 'edit' then lab else '' end as ect,
  case when status <> 'edit' then ce when xstatus = 'edit' and exact then ev else '' end as ece from x)"""
SPLIT = f"case when cast(('0x' || substr(sha256('17:' || {norm('paper_id')}), 1, 8)) as bigint) % 10000 < 1000 then 'eval' else 'train' end"
