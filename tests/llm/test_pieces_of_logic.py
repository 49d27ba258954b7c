"""Logic without Spark, against plain statements of what it must do."""

import itertools
import random
import time
import unicodedata
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import answer_defects as ad
from paperloom.llm import containers, encoding, lookalikes, mixture, pieces, split_overlap
from paperloom.llm.split_overlap import ALONE, _scheme, lcs, least_shared


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    assert lcs(a, b) == plain_lcs(a, b)


@settings(max_examples=300)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=2, max_size=25), st.data())
def test_overlapping_texts_share_enough_shingles(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 6))):
        i = data.draw(st.integers(0, len(b)))
        b[i : i + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from([[], ["x"], ["y"]]))
    if not b or 5 * plain_lcs(a, b) < 4 * max(len(a), len(b)):
        return
    assert least_shared(len(a)) <= 3 * plain_lcs(a, b) - len(a) - len(b) - 1
    assert least_shared(len(a)) >= 1
    assert set(zip(a, a[1:])) & set(zip(b, b[1:]))


@settings(max_examples=200)
@given(st.text(alphabet="ab. \n,", min_size=0, max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces(text, limit, overlap):
    ends = pieces.cuts(text, limit, overlap)
    begin, back = 0, ""
    for k, end in enumerate(ends):
        assert 0 < end - begin <= limit or not text
        back += text[begin:end] if k == 0 else text[begin + overlap : end]
        begin = end - overlap
    assert back == text and ends[-1] == len(text)
    assert len(text) > limit or len(ends) == 1


def test_pieces_prefer_strong_boundaries():
    text = "word " * 30 + "end.\n\n" + "word " * 30
    (first, *_) = pieces.cuts(text, 200, 10)
    assert text[:first].endswith("end.\n\n")
    assert pieces.cuts("x" * 4000, 1600, 120)[-1] == 4000
    with pytest.raises(ValueError, match="overlap"):
        pieces.cuts("x", 5, 5)


@settings(max_examples=200)
@given(st.text(alphabet="ab. \n,xyz", min_size=0, max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_cuts_are_boundaries_where_any_is_in_reach(text, limit, overlap):
    every = sorted({m.end() for b in pieces.BOUNDARIES for m in b.finditer(text)})
    before = overlap
    for end in pieces.cuts(text, limit, overlap)[:-1]:
        assert end in every or not [x for x in every if before < x <= min(before + limit - overlap, len(text) - 1)]
        before = end


def test_cutting_unbroken_text_takes_linear_time():
    def seconds(n):
        began = time.process_time()
        assert pieces.cuts("x" * n, 1600, 120)[-1] == n
        return time.process_time() - began

    assert seconds(4_000_000) < 60 * max(seconds(200_000), 0.01)


@given(st.text(alphabet=list("aeohxкоеёΑο=< ") + [chr(c) for c in (0x300, 0x301, 0x308, 0x323, 0x327, 0x338, 0x200B, 0x200D, 0xFF41, 0x1112, 0x1161, 0x11AB, 0xD558, 0x1EA5, 0x212B, 0x1D41A)], max_size=12))
def test_equivalent_spellings_have_one_form(text):
    forms = {lookalikes.consistent(unicodedata.normalize(n, text)) for n in ("NFC", "NFD")} | {lookalikes.consistent(text)}
    assert len(forms) == 1 and lookalikes.consistent(min(forms)) in forms


@given(st.text(max_size=60))
def test_one_form_is_stable(text):
    form = lookalikes.consistent(text)
    assert lookalikes.consistent(form) == form


@pytest.mark.parametrize(
    ("text", "form"),
    [("ｆｕｌｌ １", "full 1"), ("ﬁne", "fine"), ("café", "café"), ("a b​c", "a bc"), ("thе cаt", "the cat"), ("한", "한"), ("\U0001d400b", "Ab"), ("раdость", "раԁость"),
     ("pаper", "paper"), ("e\u0301", "é"), ("\uff45\u200d\u0301", "é"), ("o\u0302\u0323", "\u1ed9"), ("c\u0430f\u0435\u0301", "café"), ("\u1112\u1161\u11ab", "한"), ("\u212a", "K"), ("\u0261o\u0251t", "goat"), ("\u13aaBC", "ABC"), ("=\u0338", "≠"), ("<\u200b\u0338", "≮")],
)
def test_one_form(text, form):
    assert lookalikes.consistent(text) == form


@pytest.mark.parametrize("text", ["plain", "tab\tand\nline", "“quoted” – it’s", "x² ™ №", "α = 5", "хорошо", "한국어 Text", "naïve façade", ""])
def test_ordinary_text_stays(text):
    assert lookalikes.consistent(text) == text


def test_transducer_finds_conflicts():
    t = lookalikes.Transducer({"a\u0301": "á", "a\u0323\u0301": "x", "\uff41": "a"})
    assert t.apply("\uff41\u0301 a\u0301\u0323 z\u0301 \uff41") == "á x z\u0301 a"  # the longest match, marks in any order
    with pytest.raises(ValueError, match="itself rewritten"):
        lookalikes.Transducer({"ä": "ö", "ö": "u"})
    with pytest.raises(ValueError, match="itself rewritten"):
        lookalikes.Transducer({"ａ\u0301": "x", "ａ": "a"})
    with pytest.raises(ValueError, match="no rule"):
        lookalikes.Transducer({"a": "a"})
    with pytest.raises(ValueError, match="two targets"):
        lookalikes.settled([("a", "b"), ("a", "c")])
    with pytest.raises(ValueError, match="double"):
        lookalikes.Transducer({}, {"Cyrillic": {"а": "б"}})
    assert lookalikes.transducer().longest > 1


PROFILE_SAMPLES = {
    "en": "the model is used in the data set and it shows that which sets are used here for the new parser of the results on news with a tagger we do not know what it is by how much",
    "de": "die neuen modelle werden mit den alten quellen nur für kurze zeit verglichen und der die das ist nicht auch in den daten wie wir zeigen für die es gibt",
    "fr": "les modèles sont comparés avec des sources et la méthode est dans le texte pour une tâche les récentes ne pas qui nous montrons que les tâches",
    "ru": "модель и данные в работе показывают что новые источники не являются старыми для этой задачи как мы",
}


def profiles(samples=PROFILE_SAMPLES):
    counts = [np.bincount([ad.word_slot(w) for w in ad.words(t)], minlength=1 << ad.PROFILE_BITS) for t in samples.values()]
    return ad.Profiles(list(samples), counts)


def defect(q, a, e, p=None):
    return ad.defect(q, a, e, p or profiles(), lookalikes.transducer())


@pytest.mark.parametrize(
    ("q", "a", "e", "want"),
    [
        ("What is it?", None, "x", "empty"), ("What is it?", " – ", "x", "empty"), ("What is it?", "N/A", "x", "empty"), (None, "a net", None, None),
        ("What is it?", "I'm sorry, but I cannot help with that request.", None, "refusal"), ("What is it?", "They decline to report variance because it is small.", None, None),
        ("Which set is used here?", "Q: which set is used here", None, "echo"), ("Which set is used here?", "Which set is used here: News", None, None),
        ("Which set is used here?", "Die neuen Modelle werden mit den alten Quellen nur für kurze Zeit verglichen.", None, "other_language"), ("Which set is used here?", "les tâches récentes", None, None),
        ("Which set is used here?", "The parser improves the tag", "The parser improves the tagger on news.", "truncated"), ("Which set is used here?", "The parser improves the tagger on", None, "truncated"),
        ("Which set is used here?", "The parser", "The parser improves the tagger.", None), ("Which set is used here?", "yes", None, None), ("Which set is used here?", "unanswerable", None, None), ("", "", "", "empty"),
        ("Which set is used here?", "The parser improves …", None, "truncated"), ("x " * 20000, "y " * 20000, "z " * 20000, None),
    ],
)
def test_defects(q, a, e, want):
    assert defect(q, a, e) == want


@settings(max_examples=100)
@given(st.lists(st.integers(0, 20), max_size=40))
def test_packing(sizes):
    sizes = np.array(sizes, np.int64)
    at, room = containers.best_fit_decreasing(sizes, 20)
    for b in range(len(room)):
        assert sizes[at == b].sum() == 20 - room[b] and room[b] >= 0
    u, c = np.unique(sizes, return_counts=True)
    assert containers.lower_bound(u, c, 20) <= len(room)


def fewest(sizes, capacity):
    best = len(sizes)
    for split in itertools.product(range(len(sizes)), repeat=len(sizes)):
        used = {}
        for s, b in zip(sizes, split):
            used[b] = used.get(b, 0) + s
        if max(used.values()) <= capacity:
            best = min(best, len(used))
    return best


def test_bound_holds_for_the_best_packing():
    rng = random.Random(2)
    for _ in range(25):
        sizes = [rng.randint(1, 10) for _ in range(5)]
        u, c = np.unique(sizes, return_counts=True)
        assert containers.lower_bound(u, c, 10) <= fewest(sizes, 10)


@settings(max_examples=150)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), max_size=6), st.integers(0, 150))
def test_subset_sum(counts, budget):
    take = mixture.subset_sum(counts, budget)
    total = sum(n * k for n, k in take.items())
    assert all(0 <= k <= counts[n] for n, k in take.items()) and total <= max(budget, 0) or budget >= sum(n * c for n, c in counts.items())
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1)}
    if budget <= 4 * max(counts, default=0):  # small budgets are fitted exactly
        assert total == max(r for r in reach if r <= budget)


CLEAN = ["Das größere Modell prüft die Übersicht, während naïve Ansätze scheitern.", "La façade révèle l’étude – d’après les données.", "Модель проверяет новые источники и данные.", "한국어 문장은 새로운 모델을 설명한다.", "A plain sentence with “quotes” and ± signs."]


def model(*more):
    texts = "\x00".join([*CLEAN * 40, *more])
    cp = encoding.codes(texts)
    pairs = np.bincount(encoding.pair_slots(cp), minlength=1 << encoding.PAIR_BITS)
    return encoding.PairModel(pairs, np.bincount(cp, minlength=1 << encoding.CHAR_BITS))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman"])
def test_utf8_read_wrongly(wrong):
    m = model()
    for t in CLEAN:
        assert encoding.restore(t, m) == (t, False, False)
        raw = t.encode()
        try:
            bad = raw.decode(wrong)
        except UnicodeDecodeError:
            continue
        if bad != t:
            assert encoding.restore(bad, m) == (t, True, False)


def test_older_encodings_and_lost_bytes():
    m = model()
    t = CLEAN[2]
    assert encoding.restore(t.encode("koi8-r").decode("cp1251"), m) == (t, True, False)
    assert encoding.restore("fa��ade", m)[1:] == (True, True)
    many, forms = CLEAN[1], []
    for _ in range(6):  # as often as it was garbled
        many = many.encode().decode("latin-1")
        forms.append(many)
    assert encoding.restore(many, model(*forms)) == (CLEAN[1], True, False)
    assert encoding.restore("la façade – d’après".encode().decode("cp1252").replace("â€™", "â€"), m)[1:] == (True, True)
    assert encoding.restore("", m) == ("", False, False)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("the tagger on ne", "truncated"), ("tagg", "truncated"), ("parser bea", "truncated"), ("the tagger on news", None), ("agger on ne", None), ("tagger on", "truncated"), ("set A", None), ("no", None), ("4", None), ("par", None),
        ("I am unable to answer this question. " + "Sorry, " * 50, "refusal"),
    ],
)
def test_breaks_anywhere_in_the_passage_and_long_refusals(answer, want):
    assert defect("Which set is used here?", answer, "Our parser beats the tagger on news, not by 42. A par is no parser.") == want


def test_rare_character_of_a_large_corpus_is_restored():
    text = "the oak grows in the wood near the mill and the river. " * 60_000 + "Erdős űr hű "
    cp = encoding.codes(text)
    model = encoding.PairModel(np.bincount(encoding.pair_slots(cp), minlength=1 << encoding.PAIR_BITS), np.bincount(cp, minlength=1 << encoding.CHAR_BITS))
    garbled = "the river and Erdős near".encode().decode("cp1252")
    assert encoding.restore(garbled, model) == ("the river and Erdős near", True, False)


def test_model_does_not_depend_on_tasks(spark):
    df = spark.createDataFrame([(x,) for x in ("one oak", "two", "one oak", None, "", "one oak", "two")], "text string")
    counts = [encoding.corpus_model(df.repartition(n)).chars for n in (1, 7)]
    assert (counts[0] == counts[1]).all() and counts[0][ord("k")] == 1 and counts[0][ord("w")] == 1


# Written apart from the templates: other verbs, order, reasons and courtesies.
HELD_OUT_REFUSALS = """
I'm not able to assist you with that one, sorry.
Sorry, I can't share details about this paper's contents.
I cannot help with this request because it asks for private information.
We're unable to discuss this topic here.
As an AI language model, I am not permitted to comment on that.
I would prefer not to respond to this question.
Unfortunately, I won't provide an answer to that.
I don't have permission to share this information.
My policy does not permit me to discuss this.
This request is beyond my capabilities.
I have to refuse this request.
It would be wrong for me to comment on this.
I am unwilling to discuss that.
I do not wish to answer.
I choose not to answer this.
That question can't be answered by this model.
I can not offer any help with that, since my rules forbid it.
I decline to comment.
I'd rather not say.
Leider kann ich Ihnen bei dieser Anfrage nicht weiterhelfen.
Ich bin nicht befugt, diese Frage zu beantworten.
Das möchte ich nicht kommentieren.
Ich muss die Anfrage leider ablehnen.
Malheureusement, je ne suis pas autorisé à répondre à cette demande.
Je refuse de commenter ce sujet.
Je ne souhaite pas discuter de cela.
Infelizmente, não estou autorizado a responder a isso.
Lamento, mas não consigo ajudar com esta pergunta.
К сожалению, я не могу помочь с этим вопросом.
Я отказываюсь отвечать на этот вопрос.
죄송합니다만 해당 질문에는 대답할 수 없습니다.
이 요청은 처리할 수 없습니다.
""".strip().splitlines()
NO_REFUSALS = """
They decline to report variance because the data set is small.
We cannot rule out that the parser helps.
The authors were unable to answer the third question of the survey.
I and II
The assistant is able to answer most questions.
We do not use external data.
Users may refuse to answer.
The model must decline 12 requests.
Not answered in the paper
unanswerable
The system cannot answer questions about tables, which the reviewers criticise at length.
저자들은 원인을 설명할 수 없다고 보고한다
""".strip().splitlines()


def test_held_out_refusals():
    found = [t for t in HELD_OUT_REFUSALS if ad.is_refusal(ad.words(t))]
    assert len(found) >= 0.9 * len(HELD_OUT_REFUSALS), set(HELD_OUT_REFUSALS) - set(found)
    assert not [t for t in NO_REFUSALS if ad.is_refusal(ad.words(t))]
    assert ad.is_refusal(ad.words("I am unable to answer this question. " + "Sorry, I am sorry. " * 500))


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("该模型在新闻数据集上训练。", True), ("يستخدم النموذج مجموعة بيانات الأخبار", True), ("모델은 뉴스 데이터를 사용한다.", True), ("Les modèles sont comparés.", True), ("die neuen Modelle sind in den Daten nicht", True),
        ("Москва", False), ("news.", False), ("It cites “die neuen Modelle werden mit den alten Quellen verglichen” here.", False), ("the new parser", False), ("Ja.", False), ("Zorblat, Quimby and Traxel", False),
    ],
)
def test_other_languages(answer, want):
    assert (defect("Which set is used here for the parser?", answer, None) == "other_language") is want


def test_without_profiles_scripts_tell():
    none = ad.Profiles([], [])
    assert defect("Which set is used?", "Модель использует новые данные.", None, none) == "other_language"
    assert defect("Which set is used?", "Les modèles sont comparés.", None, none) is None


def test_scheme_of_both_lengths_of_a_pair():
    for a in range(ALONE, 700):
        for b in range(-(-4 * a // 5), a + 1):
            shared = 3 * -(-4 * a // 5) - a - b - 1
            (k, groups, t, need), other = _scheme(a, 0), _scheme(b, a.bit_length() - b.bit_length())
            assert other[:2] == (k, groups) and other[3] == need
            assert groups >= 1 and need >= 1 and groups + need <= min(t, other[2]) and max(t, other[2]) <= shared


def test_texts_of_one_language_seldom_meet():
    """Met on single shingles, 300 and 300 unlike texts from 100 words made 27,430 pairs."""
    rng = np.random.default_rng(7)
    met = []
    for train in (True, False):
        texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 100, rng.integers(60, 90))) for _ in range(300)]
        rb = pa.RecordBatch.from_pydict({"no": range(300), "words": texts, "train": [train] * 300, "held": [not train] * 300})
        out = split_overlap._prefixes(SimpleNamespace(value=np.full(1 << 12, 1000, np.float32)))(iter([rb]))
        met.append(Counter(k for b in out for k in b.column("meet").to_pylist()))
    assert sum(c * met[1][k] for k, c in met[0].items()) < 2000
