"""Problem 5: one form for texts that look the same.

One longest-match transducer over grapheme clusters, compiled once on the driver and sent
to the executors, rewrites a text in one pass. Its mapping is computed by rules over
the Unicode database and the short tables below:

* single characters: full-width, half-width, styled and joined letter forms, characters
  that are another one by definition, blanks, and what can't be seen;
* clusters: a base with its marks, or a syllable of separate parts, in canonical order,
  and the one character they are. Variants and invisible characters within a cluster
  are rewritten on the way into it, marks are put into canonical order;
* look-alike letters by script: a word's output is held until the word ends. In a word
  of several scripts the letters that have no double decide the script, else the more
  frequent script does, and the clusters with a double in it are matched again with it.
  Whole words of another script stay.

Compiling fails if a source has two targets, if a target is itself rewritten, or if a
double is no letter of its script.

Null stays null, an empty text empty. Tabs, line breaks, typographic quotes, dashes,
superscripts and symbols stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝүАВЕКМНОРСТУХІЈЅԌҮ", "aeopcyxijshdqwyABEKMHOPCTYXIJSGY", strict=True))
GREEK = dict(zip("αοινρυκϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aoivpukcjABEZHIKMNOPTYXCJ", strict=True))
ARMENIAN = dict(zip("օոսհցքՕՏՍԼ", "onuhgpOSUL", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ", "ABCDEGHJKLMPSTVWZR", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
COPTIC = dict(zip("ⲞⲟⲢⲣⲤⲥⲦⲬⲔⲘⲚⲎ", "OoPpCcTXKMNH", strict=True))
#: Latin letters that look like another one.
LATIN = dict(zip("ɑɡ", "ag", strict=True))
#: Letters that look like a space or nothing.
FILLERS = "ᅟᅠㅤﾠ͏᠎឴឵⠀"
KEEP = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
SCRIPTS = {"Latin": "A-Za-zªºÀ-ÖØ-öø-ʸᴀ-ᴥᴬ-ᵜᵢ-ᵥᵫ-ᵷᵹ-ᶾḀ-ỿⅠ-ↈⱠ-ⱿꜢ-ꞇ", "Cyrillic": "Ѐ-҄҇-ԯᲀ-ᲈᴫᵸⷠ-ⷿꙀ-ꚟ", "Greek": "Ͱ-ͳ͵-ͷͺ-ͽͿ΄ΆΈ-ϡϰ-Ͽἀ-῾", "Armenian": "Ա-Ֆՙ-֊", "Cherokee": "Ꭰ-Ᏽ", "Lisu": "ꓐ-ꓷ", "Coptic": "Ⲁ-ⳮϢ-ϯ"}


DOUBLES = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Lisu": LISU, "Coptic": COPTIC}


def _styled(ch: str) -> str | None:
    """What a full-width, half-width, styled or joined letter form stands for."""
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return None
    kind, cat = d[1 : d.index(">")], unicodedata.category(ch)
    if kind == "narrow":  # half-width syllable parts are letters of their own
        return chr(int(d.split()[1], 16))
    if kind in ("wide", "font", "initial", "medial", "final", "isolated"):
        return unicodedata.normalize("NFKC", ch)
    if kind == "compat" and (cat[0] == "L" or cat == "Nl") and len(unicodedata.normalize("NFKC", ch)) > 1 and ch not in "ŉ":
        return unicodedata.normalize("NFKC", ch)
    if kind == "compat" and cat == "Nl":
        return unicodedata.normalize("NFKC", ch)
    return None


def mapping() -> Iterator[tuple[str, str]]:
    """Sources and targets by rule: single characters, and clusters in canonical order."""
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0x3130 <= cp < 0x3190:
            continue
        ch = chr(cp)
        if ch in KEEP or ch == " ":
            continue
        cat = unicodedata.category(ch)
        if cat in ("Cf", "Cc") or ch in FILLERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180D:
            yield ch, ""
        elif cat == "Zs":
            yield ch, " "
        elif (to := _styled(ch)) is not None:
            yield ch, to
        elif (to := LATIN.get(ch)) is not None:
            yield ch, to
        elif cat != "Cn" and (to := unicodedata.normalize("NFC", ch)) != ch:
            yield ch, to
        elif cat != "Cn" and (parts := unicodedata.normalize("NFD", ch)) != ch:
            yield parts, ch


def settled(rules: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Rules by source; targets are rewritten by the single characters' rules until nothing
    changes. Two targets of one source are an error."""
    out: dict[str, str] = {}
    for s, t in rules:
        if out.setdefault(s, t) != t:
            raise ValueError(f"two targets of {s!r}")
    for s, t in out.items():
        while len(s) == 1 and (new := unicodedata.normalize("NFC", "".join(out.get(c, c) for c in t))) != t:
            t = new
        out[s] = t
    return out


def _to_script(script: str, doubles: dict[str, dict[str, str]]) -> dict[str, str]:
    """Doubles of the other scripts' letters in this script; Latin is the pivot."""
    if script == "Latin":
        return {k: v for d in doubles.values() for k, v in d.items()}
    back = {v: k for k, v in doubles[script].items()}
    out = dict(back)
    for name, d in doubles.items():
        if name != script:
            out |= {k: back[v] for k, v in d.items() if v in back}
    return out


class Transducer:
    """Longest-match rewriting of clusters, compiled from a mapping of strings and, by script,
    the letters that look like Latin ones."""

    def __init__(self, rules: dict[str, str], doubles: dict[str, dict[str, str]] | None = None):
        doubles = doubles or {}
        self.single = {s: t for s, t in rules.items() if len(s) == 1}
        self.cluster = {s: t for s, t in rules.items() if len(s) > 1}
        self.longest = max(map(len, rules), default=0)
        self.parts = {t: s for s, t in self.cluster.items() if len(t) == 1}
        self.later = frozenset(c for s in self.cluster for c in s[1:])
        self.to_script = {n: _to_script(n, doubles) for n in (["Latin", *doubles] if doubles else [])}
        self.has_double = {n: frozenset(d) for n, d in doubles.items()}
        if doubles:
            self.has_double["Latin"] = frozenset(self.to_script["Latin"].values())
        self.script_of = {n: re.compile(f"[{SCRIPTS[n]}]") for n in self.to_script}
        self.change, self.tokens = self._patterns()
        self.known: dict[str, str] = {}
        for s, t in rules.items():
            if not s or s == t:
                raise ValueError(f"no rule: {s!r}")
            if len(s) > 1 and any(c in self.single for c in s):
                raise ValueError(f"a part of {s!r} is itself rewritten")
            if self.apply(t) != t:
                raise ValueError(f"the target of {s!r} is itself rewritten")
        for n, pairs in self.to_script.items():
            for s, t in pairs.items():
                if self._script(t) != n or s in self.script_of and t in pairs:
                    raise ValueError(f"{t!r} is no {n} double of {s!r}")

    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """What any change needs: a source of a rule, a mark or later part, or a letter of a
        script with doubles; and runs of letters and digits with a character beyond ASCII or
        a source. Within the first plane a class is a bitmap lookup."""
        marks = {cp for cp in range(0x80, 0x10000) if unicodedata.combining(chr(cp))} | {ord(c) for c in self.later}
        sources = {ord(c) for c in self.single}
        scripts = {cp for n in self.script_of if n != "Latin" for cp in range(0x80, 0x10000) if self.script_of[n].match(chr(cp))}
        own = sources | marks | {cp for cp in range(0x80, 0x10000) if chr(cp).isalnum()}
        odd, mark = _ranges(c for c in own if c < 0x10000) + "\U00010000-\U0010ffff", _ranges(marks)
        unseen = _ranges(ord(c) for c, t in self.single.items() if not t)
        base = f"|[^A-Za-z0-9\\s](?={f'[{unseen}]*' if unseen else ''}[{mark}])" if marks else ""
        change = _ranges(c for c in sources | marks | scripts if c < 0x10000)
        return re.compile(f"[{change}\U00010000-\U0010ffff]"), re.compile(f"(?:[A-Za-z0-9]*{base})[{odd}][A-Za-z0-9{odd}]*")

    def apply(self, text: str) -> str:
        return self.tokens.sub(self._known, text) if self.change.search(text) else text

    def _known(self, found: re.Match) -> str:
        token = found.group()
        out = self.known.get(token)
        if out is None:
            if len(self.known) >= 1 << 17:
                self.known.clear()
            out = self.known[token] = self._token(token)
        return out

    def _token(self, token: str) -> str:
        out: list[str] = []
        word: list[str] = []  # clusters of the open word
        for cluster in self._clusters(token):
            made = self._match(cluster)
            if made[:1].isalnum():
                word.append(made)
                continue
            out += self._one_script(word)
            word = []
            out.append(made)
        return "".join([*out, *self._one_script(word)])

    def _clusters(self, token: str) -> Iterator[str]:
        open_ = ""
        for ch in token:
            for c in self.single.get(ch, ch):
                if open_ and (c in self.later or unicodedata.combining(c)):
                    open_ += c
                else:
                    if open_:
                        yield open_
                    open_ = c
        if open_:
            yield open_

    def _match(self, cluster: str) -> str:
        if len(cluster) == 1:
            return cluster
        # the base has class 0 and stays first
        key = "".join(self.parts.get(c, c) for c in cluster)
        key = "".join(_ordered(key))
        for size in range(min(self.longest, len(key)), 1, -1):
            to = self.cluster.get(key[:size])
            if to is not None:
                return to + key[size:]
        return key

    def _script(self, ch: str) -> str | None:
        return next((n for n, p in self.script_of.items() if p.match(ch)), None)

    def _one_script(self, word: list[str]) -> list[str]:
        of: dict[str, list[str]] = {}
        for c in word:
            if (n := self._script(c[0])) is not None:
                of.setdefault(n, []).append(c[0])
        if len(of) < 2:
            return word
        own = {n: sum(c not in self.has_double[n] for c in letters) for n, letters in of.items()}
        order = sorted(of, key=lambda n: (own[n], len(of[n]), n == "Latin"), reverse=True)
        # the first script in which all the others' letters have a double
        pick = next((n for n in order if all(c in self.to_script[n] for m in of if m != n for c in of[m])), order[0])
        to, keep = self.to_script[pick], set(of[pick])
        return [c if c[0] in keep or c[0] not in to else self._match(to[c[0]] + c[1:]) for c in word]


def _ordered(marks: str) -> list[str]:
    """Marks in canonical order: by class, as they come within one and around class 0."""
    out: list[str] = []
    for c in marks:
        k, n = unicodedata.combining(c), len(out)
        while k and n and unicodedata.combining(out[n - 1]) > k:
            n -= 1
        out.insert(n, c)
    return out


def _ranges(points: Iterable[int]) -> str:
    parts: list[list[int]] = []
    for cp in sorted(points):
        if parts and cp == parts[-1][1] + 1:
            parts[-1][1] = cp
        else:
            parts.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts)


@cache
def transducer() -> Transducer:
    return Transducer(settled(mapping()), DOUBLES)


def consistent(text: str) -> str:
    """The one form of a text; applying it again changes nothing."""
    return transducer().apply(text)


def suspicious(col: Column) -> Column:
    """True for every text that :func:`consistent` may change; cheap, in the JVM."""
    return col.rlike(r"[^\x09-\x0d\x1c-\x7e]")


def rewrite(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with ``<column>_form`` beside each column: the one form where it differs from
    the text, else null. Only suspicious texts travel to Python."""
    keep = [c for c in df.columns if c not in columns]
    sent = spread(df.select(*keep, *[F.when(suspicious(F.col(c)), F.col(c)).alias(c) for c in columns]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name in keep)
    schema += "".join(f", `{c}_form` string" for c in columns)
    compiled = df.sparkSession.sparkContext.broadcast(transducer())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = compiled.value.apply
        for rb in batches:
            cols = [rb.column(rb.schema.get_field_index(c)) for c in keep]
            for c in columns:
                forms = []
                for t in rb.column(rb.schema.get_field_index(c)).to_pylist():
                    form = None if t is None else apply(t)
                    forms.append(None if form == t else form)
                cols.append(pa.array(forms, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*keep, *(f"{c}_form" for c in columns)])

    return sent.mapInArrow(run, schema)


FIELDS = ["evidence_span", "chunk_text"]


def _odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = table(spark, sf_dir, "candidates").select("candidate_id", *FIELDS)
    odd = cand.where(suspicious(F.col(FIELDS[0])) | suspicious(F.col(FIELDS[1])))
    return rewrite(odd, FIELDS)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's fields in the one form, and whether they were rewritten."""
    cand = table(spark, sf_dir, "candidates").select("candidate_id", *FIELDS)
    made = rewrite(cand.select("candidate_id", *[F.col(c).alias(f"{c}_raw") for c in FIELDS], *FIELDS), FIELDS)
    out = made.select("candidate_id", *[F.coalesce(f"{c}_form", f"{c}_raw").alias(c) for c in FIELDS], *[F.col(f"{c}_form").isNotNull().alias(f"{c}_rewritten") for c in FIELDS])
    return out.dropDuplicates(["candidate_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _odd_rows(spark, sf_dir)
    names = F.array_compact(F.array(*[F.when(F.col(f"{c}_form").isNotNull(), F.lit(c)) for c in FIELDS]))
    return made.select("candidate_id", F.explode(names).alias("field_name")).distinct()


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms}
SQL: dict[str, str] = {}
