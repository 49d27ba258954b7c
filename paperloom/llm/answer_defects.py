"""Problem 7: broken question and answer pairs.

Each pair gets at most one defect, the first that holds of

* ``empty``: no letter or digit, or a placeholder for a missing value;
* ``refusal``: the answer, up to a word that opens a reason, aligns (longest common
  subsequence of words) with a refusal template, and little but courtesy is left beside it;
* ``echo``: the answer's two-word shingles are contained in the question's and the common
  subsequence covers the question, so that nothing is added to it;
* ``other_language``: a sentence (five words, or two and a mark that ends one) in another
  language than the question. Word profiles of the languages are learned from
  ``documents.lang``; the log-likelihood must favour another language by ``EVIDENCE``.
  Where the profiles tell nothing, letters of another script do. What stands in
  quotation marks tells nothing of an answer, and a question of names alone is
  taken to be in the language of its passage;
* ``truncated``: ends in an ellipsis or hyphen, ends where the passage goes on inside a
  word, or ends with a word that cannot end a clause.

The profiles are fitted on ``PROFILE_TEXTS`` whole texts of each language at most, those
chosen by a hash of their id; all else covers all rows.

A null answer is empty. A null or empty question has no echo and no language. A null
passage tells nothing of a break. Whole texts are compared. Candidates delivered twice
give one row. Without labelled documents scripts alone tell languages apart.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folded, spread, table
from .lookalikes import Transducer, transducer
from .sketch import hashed_counts
from .split_overlap import lcs

#: Bounds of the language profiles: whole texts of each language, and its hashed words.
PROFILE_TEXTS, PROFILE_BITS = 2000, 17
#: A label on fewer than one in so many labelled documents is no language.
RARE_LABEL = 1000
#: Natural logarithm of the odds from which a text is in one language and not in another.
EVIDENCE = 9.0
#: Frequency given to a word that a language's profile lacks.
FLOOR = 1e-6

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

# What stands for a missing value, letters and digits only, lower case.
PLACEHOLDERS = frozenset("null none nil nan na tbd tba todo undefined missing empty blank notavailable notapplicable noanswer unknown placeholder xxx void ka kangabe keineangabe sansobjet nd нд нетданных semresposta 없음 해당없음 미정".split()) - {"unknown", "void"}

_ACT = "answer/answering/help/assist/discuss/discussing/provide/respond/comment/commenting/comply/reply/address/share/give/offer/support/fulfil/fulfill/do/engage/advise/speak/say/cover/complete/explain"
_HELFEN = "beantworten/antworten/helfen/weiterhelfen/geben/äußern/sagen/unterstützen/bearbeiten/erfüllen/eingehen/kommentieren/nachkommen/behandeln/antwort"
_AIDER = "répondre/aider/traiter/fournir/donner/commenter/discuter/satisfaire/communiquer/assister/prononcer/réponse"
_AJUDAR = "responder/ajudar/ajudá/fornecer/discutir/comentar/atender/dar/auxiliar/tratar/resposta"
_OTVET = "ответить/отвечать/помочь/помогать/обсуждать/комментировать/предоставить/дать/выполнить/раскрывать/прокомментировать/ответа"
#: Templates of a refusal by language, a word or its alternatives at each place, without the
#: courtesies around them and the object of the refusal.
REFUSALS = [
    [frozenset(x.split("/")) for x in t.split()]
    for t in f"""
i/we can't/won't/couldn't {_ACT}
i/we can/could/will/shall not {_ACT}
i/we am/are unable/unwilling {_ACT}
i/we am/are not able/comfortable/allowed/permitted/willing/going/prepared/authorized/authorised/free/supposed {_ACT}
i/we won't be able {_ACT}
i/we will/would/may/might not be able {_ACT}
i/we do not feel/have/want/wish comfortable/permission/authority/clearance/right/liberty {_ACT}
i/we do not want/wish/intend {_ACT}
i/we must/have/need/will/would/should decline/refuse/pass/abstain/refrain
i/we refuse/decline {_ACT}
i/we would/had/i'd rather/prefer/like not {_ACT}
i'd rather/prefer not {_ACT}
i/we prefer/choose/opt not {_ACT}
my guidelines/instructions/policy/policies/rules/programming/training/developers/guideline do/does not allow/permit/let me {_ACT}
my guidelines/instructions/policy/policies/rules/programming/training/developers/guideline prevent/prevents/forbid/forbids/prohibit/prohibits/stop/keep me {_ACT}
answering/discussing/that/this/it is/falls/lies outside/beyond what i may/can/do/could/should
that/this/it is/falls/lies/question/request outside/beyond my scope/abilities/capabilities/remit/competence/role/knowledge
this/that/it can't/cannot be answered/discussed/provided/handled/fulfilled assistant/model/ai/me
that/this is something/one/nothing i can't/won't/couldn't {_ACT}
it would not be appropriate/right/proper/responsible/ethical me {_ACT}
it would be inappropriate/improper/irresponsible/unethical/wrong me {_ACT}
ich/wir kann/können/darf/dürfen/möchte/möchten/werde/will nicht/keine/kein/nichts {_HELFEN}
kann/können/darf/dürfen/möchte/möchten/werde/will ich/wir nicht/keine/kein/nichts {_HELFEN}
ich/wir muss/müssen/möchte ablehnen/passen/verzichten
muss/müssen/möchte ich/wir ablehnen/passen/verzichten
ich/wir lehne/lehnen ab
mir/uns nicht/leider möglich/erlaubt/gestattet {_HELFEN}
ich/wir bin/sind nicht/außerstande befugt/berechtigt/lage/bereit/autorisiert {_HELFEN}
je/nous ne peux/pouvons/veux/souhaite/dois/saurais/pourrai/vais pas {_AIDER}
je/nous préfère/préférons/souhaite/aimerais ne pas {_AIDER}
je/nous ne suis/sommes pas mesure/autorisé/autorisée/habilité/capable/programmé {_AIDER}
je/nous suis/sommes incapable/l'incapacité/désolé {_AIDER} impossible/pas/incapable
il m'est/n'est impossible/interdit/possible {_AIDER}
je/nous refuse/refusons/décline/dois/m'abstiens/m'abstiendrai {_AIDER}/refuser/décliner
não posso/podemos/consigo/vou/devo/poderei/quero/pretendo/poderia {_AJUDAR}
prefiro/preferimos/escolho não {_AJUDAR}
não estou/tenho/sou/sinto autorizado/autorizada/permissão/capaz/condições/confortável/vontade {_AJUDAR}
recuso/recusamos/tenho/devo/preciso {_AJUDAR}/recusar/declinar
estou/sou incapaz/impossibilitado/impedido {_AJUDAR}
не могу/можем/буду/хочу/имею/готов/вправе/смогу/стану {_OTVET}
вынужден/вынуждена/вынуждены/должен/приходится отказаться/отказать/воздержаться/отклонить
предпочитаю/предпочёл/предпочту не {_OTVET}
отказываюсь/воздержусь/отказываемся {_OTVET}
мне не/запрещено разрешено/позволено/положено {_OTVET}
답변할/답할/도와드릴/대답할/답변드릴/응답할/제공할/말씀드릴/도울/처리할/드릴/대답해/알려드릴/수행할 수/수가/수는 없습니다/없어요/없다/없음/없네요
답변을/답변은/답변이/대답을/응답을/답변하는/대답하는/답변하기 거부합니다/거절합니다/불가합니다/삼가겠습니다/어렵습니다/곤란합니다/거부하겠습니다/불가능합니다/것은
""".strip().splitlines()
]
#: Words that may stand beside a template: courtesies, and what is refused.
COURTESY = frozenset(
    """sorry i'm i am afraid but unfortunately regrettably however apologize apologies apologise my please thank thanks you for asking as an a ai
    system language model assistant and so the at this time here that to with read full text instead ask authors author me we it really very kind regards
    of from in on about by be able these those one request requests question questions query answer answers topic matter subject issue information response content
    contents paper document kind sort type such any your further more help assistance details detail anything regarding concerning simply just must like any be something out
    leider entschuldigung bitte als ki es tut mir leid diese dieser dieses dieser frage fragen anfrage dazu dabei darauf damit hierzu dem der die das zu auskunft ihnen zum inhalt ich ist in zur
    désolé malheureusement excusez moi en tant que ia je suis mais à cette ce cet de la le question demande vous cela ça pour sur y toute avec
    desculpe infelizmente lamento sinto muito como ia mas a essa esse esta este isso isto com pergunta pedido questão solicitação de à ao me por se te lhe você mim o
    извините к сожалению простите как ии но я мы на этот этого это вопрос вопросы с этим запрос запросом от по теме вам из
    죄송하지만 죄송합니다 죄송합니다만 안타깝지만 유감스럽게도 이 그 해당 저는 제가 질문에 질문에는 질문은 요청을 요청은 요청에는 내용을 내용은 대해 대해서 대해서는 대한 것은 점 양해""".split()
)
#: Words that open the reason of a refusal.
REASONS = frozenset("because since due weil denn parce puisque porque pois поскольку так потому".split())
LEADS = frozenset("q question answer a frage pergunta вопрос 질문 re repeat the is you asked".split())
# Function words by language; the first groups also can't end a clause.
ENDLESS = {
    "en": "the a an of and or in on our with for to by which that under over its their into from than as at is are was were be because while whereas if whose without within across through between against beyond inside after before despite although upon among toward towards via per not both each whether when where",
    "de": "der die das den dem des ein eine einen einem einer und oder in im mit für nach von zu zur zum bei auf aus durch gegen ohne unter über dass weil wenn während obwohl sowie als um wie deren dessen jedoch nur",
    "fr": "le la les un une des du de et ou en dans avec pour par sur sous que qui dont où au aux ce ces cette leur leurs mais car si selon entre sans vers chez malgré grâce à",
    "pt": "o os as um uma uns umas de do da dos das e ou em no na nos nas com para por pelo pela que ao aos à às se mas sem sob sobre entre como",
    "ru": "и или в во на с со к ко по из от для о об при за под над без до между через что который которые однако но а если чтобы как хотя вместе",
}
ENDLESS = {k: frozenset(v.split()) for k, v in ENDLESS.items()}
def words(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in _WORD.findall(text)]


class Profiles:
    """Words of languages, and the evidence they give."""

    def __init__(self, languages: list[str], counts: list[np.ndarray]):
        self.languages = languages
        self.logs = [np.log(np.maximum(c / max(1, c.sum()), FLOOR)).astype(np.float32) for c in counts]
        self.known: dict[str, tuple[float, ...]] = {}

    def _of(self, word: str) -> tuple[float, ...]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= 1 << 17:
                self.known.clear()
            at = word_slot(word)
            out = self.known[word] = tuple(float(x[at]) for x in self.logs)
        return out

    def scores(self, tokens: list[str]) -> list[float]:
        return [math.fsum(x) for x in zip(*map(self._of, tokens))] if tokens and self.logs else []

    def language(self, tokens: list[str]) -> int | None:
        """The likeliest language by number, if the next one is clearly behind."""
        s = self.scores(tokens)
        order = sorted(range(len(s)), key=s.__getitem__, reverse=True)
        if not s or s[order[0]] - (s[order[1]] if len(s) > 1 else len(tokens) * math.log(FLOOR)) < EVIDENCE:
            return None
        return order[0]

    def other(self, asked: int | None, question: list[str], answer: list[str]) -> bool:
        """Whether the answer is in another language than the question's (by number, if known)."""
        if asked is not None and answer:
            s = self.scores(answer)
            best = max(s)
            if best - s[asked] >= EVIDENCE:
                return True
            if s[asked] - len(answer) * math.log(FLOOR) >= EVIDENCE:  # the question's own
                return False
        a, b = script(question), script(answer)
        return bool(a and b) and a != b


def word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << PROFILE_BITS) - 1)


@cache
def _script(ch: str) -> str:
    """The first word of a letter's name; ideographs and kana are written together."""
    name = unicodedata.name(ch, "").partition(" ")[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK"}.get(name, name) if ch.isalpha() else ""


def script(tokens: list[str]) -> str | None:
    """The script of more than half of all words; a word has that of its last letter, so that
    a name with an ending counts as the ending does."""
    n = Counter(next((x for c in reversed(w) if (x := _script(c))), "") for w in tokens)
    del n[""]
    if not n:
        return None
    (best, most), total = n.most_common(1)[0], sum(n.values())
    return best if 2 * most > total else None


def learned(documents: DataFrame) -> Profiles:
    """documents(doc_id, text, lang): profiles of the languages they are labelled with."""
    labelled = documents.select("doc_id", "text", folded(F.col("lang")).alias("lang")).where("text <> '' and lang <> '' and lang <> 'und'")
    n = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count("*")).where("lang rlike '^[a-z]{2,3}$'").collect()}  # at most 26^3 labels
    languages = sorted(k for k, v in n.items() if v * RARE_LABEL >= sum(n.values()))
    if not languages:
        return Profiles([], [])
    # Hashes are even, so twice the part that is wanted has it; only these texts are ranked, a
    # number that doesn't grow with the table.
    part = F.lit(0.0)
    for k in languages:
        part = F.when(F.col("lang") == k, 2 * PROFILE_TEXTS / n[k]).otherwise(part)
    h = F.xxhash64("doc_id")
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    near = labelled.withColumn("h", h).where((F.shiftrightunsigned("h", 11) * 2.0**-53 < part) & F.col("doc_id").isNotNull())
    picked = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PROFILE_TEXTS).select("lang", "text")
    number = {k: i for i, k in enumerate(languages)}

    def slots(rb: pa.RecordBatch) -> list[np.ndarray]:
        out: list[list[int]] = [[] for _ in languages]
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            out[number[lang]] += map(word_slot, words(text))
        return [np.array(x, np.int64) for x in out]

    return Profiles(languages, hashed_counts(picked, slots, len(languages), PROFILE_BITS))


def is_empty(answer: str) -> bool:
    kept = "".join(c for c in answer.lower() if c.isalnum())
    return not kept or kept in PLACEHOLDERS


_PLAIN = {"cannot": "can't", "i'm": "i am", "we're": "we are", "don't": "do not", "doesn't": "does not", "i'll": "i will", "we'll": "we will", "isn't": "is not", "wouldn't": "would not", "it's": "it is", "that's": "that is"}
_LEAST = [max(2, -(-4 * len(t) // 5)) for t in REFUSALS]
_WITH: dict[str, list[int]] = {}
for _i, _t in enumerate(REFUSALS):
    for _w in frozenset().union(*_t):
        _WITH.setdefault(_w, []).append(_i)


def _aligned(text: list[str], template: list[frozenset[str]]) -> int:
    """Longest common subsequence; a place of the template holds any of its words."""
    at = {w: sum(1 << i for i, x in enumerate(template) if w in x) for w in text}
    v = full = (1 << len(template)) - 1
    for w in text:
        u = v & at[w]
        v = ((v + u) | (v - u)) & full
    return len(template) - v.bit_count()


def is_refusal(tokens: list[str]) -> bool:
    text = " ".join(_PLAIN.get(w, w) for w in tokens).split()
    reason = next((i for i, w in enumerate(text) if w in REASONS and i > 2), len(text))
    text = text[:reason]
    # A template can align only if enough of the text's different words are in it.
    near = Counter(i for w in set(text) for i in _WITH.get(w, ()))
    for i, n in near.items():
        if n < _LEAST[i] or _aligned(text, REFUSALS[i]) < _LEAST[i]:
            continue
        own = frozenset().union(*REFUSALS[i])
        beside = sum(w not in COURTESY and w not in own for w in text)
        if beside <= max(1, len(text) // 6):
            return True
    return False


def is_echo(question: list[str], answer: list[str]) -> bool:
    if not question or not answer:
        return False
    while answer and answer[0] in LEADS and answer[: len(question)] != question:
        answer = answer[1:]
    if not answer or not set(answer) <= set(question):
        return False
    pairs = set(zip(answer, answer[1:]))
    inside = len(pairs & set(zip(question, question[1:])))
    breaks = len(answer) // len(question)  # where a repeated question begins again
    return inside >= 0.9 * len(pairs) - breaks and 10 * lcs(question, answer) >= 9 * len(question)


_QUOTED = re.compile("“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
_PARTICLES = frozenset("은 는 이 가 을 를 와 과 의 에 에서 에게 로 으로 보다 도 만 까지 부터 처럼 이다 다 들".split())
_WHOLE = frozenset("yes no ja nein oui non sim não да нет 예 네 아니요 아니오".split())
_OUTER = " \t\r\n\"'“”‘’«»()[]*_`;,:|#>"


def _breaks_off(body: str, passage: str) -> bool:
    """Wherever the answer stands in the passage from a word's beginning, the passage goes on
    inside its last word, by more than a particle."""
    a = "".join(c for c in body.lower() if c.isalnum())
    p = [k for k, c in enumerate(passage) if c.isalnum()]
    flat = "".join(c.lower() if len(c.lower()) == 1 else c for c in (passage[k] for k in p))
    found, at = False, flat.find(a)
    while at >= 0:
        if at == 0 or p[at] > p[at - 1] + 1:
            end = at + len(a)
            if end == len(p) or p[end] > p[end - 1] + 1 or re.match(r"[^\W_]*", passage[p[end] :]).group() in _PARTICLES:
                return False
            found = True
        at = flat.find(a, at + 1)
    return found


def is_truncated(answer: str, passage: str, lang: str | None) -> bool:
    body = answer.strip(_OUTER)
    tokens = words(body)
    if len(tokens) < 2:  # yes, no and numbers are whole, whatever words begin like them
        plain = not tokens or tokens[0] in _WHOLE or tokens[0].isdigit() or body[-1] in ".!?。"
        return not plain and bool(passage) and _breaks_off(body, passage)
    if body.endswith(("…", "...")):
        return True
    if body[-1] in "-‐" and body[-2:-1].isalpha():
        return True
    if body[-1] in ".!?。":
        return False
    last = _WORD.findall(body)[-1]
    small = last.islower() or (len(last) > 1 and not any(c.islower() for c in body))  # no name, no choice
    ends = lang in ENDLESS and tokens[-1] in ENDLESS[lang] or lang is None and any(tokens[-1] in v for v in ENDLESS.values())
    if small and ends and " | " not in body and body.endswith(last):
        return True
    return bool(passage) and _breaks_off(body, passage)


def defect(question: str | None, answer: str | None, passage: str | None, profiles: Profiles, forms: Transducer) -> str | None:
    if answer is None:
        return "empty"
    if not answer.isascii():
        answer = forms.apply(answer)
    if is_empty(answer):
        return "empty"
    a = words(answer)
    if is_refusal(a):
        return "refusal"
    q = words(question if question.isascii() else forms.apply(question)) if question else []
    if is_echo(q, a):
        return "echo"
    if passage and not passage.isascii():
        passage = forms.apply(passage)
    asked = profiles.language(q)
    if asked is None and q:  # little but names: the passage tells the language
        asked = profiles.language(q + words(passage or ""))
    own = words(_QUOTED.sub(" ", answer))  # what is quoted may be in any language
    if q and "|" not in answer and _sentence(own, answer) and profiles.other(asked, q, own):
        return "other_language"
    return "truncated" if is_truncated(answer, passage or "", None if asked is None else profiles.languages[asked]) else None


def _sentence(tokens: list[str], answer: str) -> bool:
    """More than a name or noun phrase; without blanks two ideographs count as a word."""
    n = sum(max(1, sum(_script(c) == "CJK" for c in w) // 2) for w in tokens)
    ended = answer.rstrip(_OUTER)[-1:] in ".!?。"
    return n >= 5 or ended and n >= 2 and not all(w in _WHOLE for w in tokens)


def flagged(pairs: DataFrame, profiles: Profiles) -> DataFrame:
    """pairs(candidate_id, question, label_text, evidence_span): (candidate_id, defect)."""
    told = pairs.sparkSession.sparkContext.broadcast((profiles, transducer()))  # both of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, forms = told.value
        for rb in batches:
            i, q, a, e = (c.to_pylist() for c in rb.columns)
            found = [(k, d) for k, d in zip(i, (defect(*x, p, forms) for x in zip(q, a, e))) if d]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())], ["candidate_id", "defect"])

    return spread(pairs.select("candidate_id", "question", "label_text", "evidence_span")).mapInArrow(run, "candidate_id string, defect string")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    qasper = table(spark, sf_dir, "candidates").where(F.col("source_dataset") == "qasper")
    return flagged(qasper, learned(table(spark, sf_dir, "documents"))).groupBy("candidate_id").agg(F.min("defect").alias("defect"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("candidates"))


QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
SQL: dict[str, str] = {}
