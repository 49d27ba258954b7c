"""Problem 10: text decoded with a wrong character encoding.

1. Adjacent character pairs of the whole corpus are counted in an array of fixed size.
   A pair's weight is its part of the corpus' mutual information,
   p(xy) * log2(p(xy) / (p(x) * p(y))).
2. In a text, each pair scores by how far its weight lies below a usual pair's;
   plain ASCII pairs score below zero. Maximum-scoring segments are the improbable runs.
3. Only inside those runs inverse mappings are tested: encode with the wrong encoding,
   decode with the right one, again and again as long as it gains. A restoration counts
   when all its characters are known to the corpus and it needs fewer bits under the
   pair model.

In a run, an unread byte (a replacement character or a control character of the C1 range)
or a sequence whose last byte was lost is garbled even where nothing can be restored; the
latter is told by the same inverse mappings, with every last byte there can be. Equal texts
count once in the corpus, so that a garbled text copied into many rows stays improbable.

Null and empty texts are never garbled; a document delivered twice counts once; texts
are taken whole. All counts cover all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table
from .sketch import hashed_counts

PAIR_BITS = 19
CHAR_BITS = 17
#: A pair of this weight (bits of mutual information per character) scores 0.
USUAL = 1e-3
#: Bits a pair up to which a run reads as usual text, so no older encoding is tried.
FLUENT = 14.5
#: Score of a pair of two ASCII characters, which no wrong decoding makes.
PLAIN = -0.625
#: Encodings that texts are wrongly read with, and those they are in.
WRONG = ("cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-2", "cp1254")
RIGHT = ("cp1252", "cp1251", "koi8-r", "cp949", "cp1250", "cp866")
#: What decoders put for bytes they can't read: the replacement character, or the byte's
#: number as a control character. U+0085 ends lines in real texts.
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")

#: Characters that no wrong decoding makes are no reason to test a run.
_MADE = re.compile("[^\x00-\x7f가-힣一-鿿]")


@cache
def byte_of(encoding: str) -> dict[str, int]:
    """Byte of each character; a byte without a character stands for itself, as
    lenient decoders have it."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            pass
        if b < 0xA0:
            out.setdefault(chr(b), b)
    return out


@cache
def sequences(encoding: str) -> re.Pattern:
    """Characters that are, in this encoding, well-formed UTF-8 of two bytes or more."""
    m = byte_of(encoding)
    of = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in m.items() if lo <= b <= hi) + "]"
    c = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{c}|{of(0xE0, 0xEF)}{c}{c}|{of(0xF0, 0xF4)}{c}{c}{c})+")


@cache
def cut_off(encoding: str) -> re.Pattern:
    """Characters that are, in this encoding, UTF-8 of three bytes or more without its end."""
    m = byte_of(encoding)
    of = lambda lo, hi: "".join(re.escape(c) for c, b in m.items() if lo <= b <= hi)
    c, no = f"[{of(0x80, 0xBF)}]", f"(?![{of(0x80, 0xBF)}])"
    return re.compile(f"[{of(0xE0, 0xEF)}]{c}{no}|[{of(0xF0, 0xF4)}]{c}{{1,2}}{no}")


def to_bytes(text: str, encoding: str) -> bytes | None:
    m = byte_of(encoding)
    out = bytearray()
    for ch in text:
        b = ord(ch) if ch < "\x80" else m.get(ch)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_slots(cp: np.ndarray) -> np.ndarray:
    c = cp.astype(np.uint64)
    h = (c[:-1] * np.uint64(0x1F123BB5) + c[1:]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


class PairModel:
    """Bits and mutual-information weights of adjacent characters."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        self.n = max(1, int(chars.sum()))
        self.bits = -np.log2((pairs + 0.25) / self.n).astype(np.float32)
        self.pairs = pairs.astype(np.float64)
        self.chars = chars
        self.known = frozenset(map(chr, np.flatnonzero(chars).tolist())).issuperset
        self.runs: dict[tuple[str, str, str], str | None] = {}
        self.lossy: dict[tuple[str, str, str], bool] = {}
        self.bits_of: dict[str, float] = {}

    def mended(self, left: str, run: str, right: str) -> str | None:
        """The run restored; short runs, of which texts repeat a few, are remembered."""
        key = (left, run, right)
        if key in self.runs:
            return self.runs[key]
        made = [x for x in (_utf8(run, left, right, self), _legacy(run, left, right, self)) if x is not None]
        out = min(made, key=lambda x: self.cost(left + x + right), default=None)
        if out is None and " " in run:  # a byte lost in one word must not cost the others
            words = run.split(" ")
            sides = [left, *[" "] * len(words), right]
            mended = [self.mended(sides[k], w, sides[k + 2] if k + 1 < len(words) else right) if w and not w.isascii() else None for k, w in enumerate(words)]
            if any(m is not None for m in mended):
                out = " ".join(w if m is None else m for w, m in zip(words, mended))
        if len(run) <= 24 and len(self.runs) < 1 << 17:
            self.runs[key] = out
        return out

    def lost(self, left: str, run: str, right: str) -> bool:
        key = (left, run, right)
        out = self.lossy.get(key)
        if out is None:
            out = lost(run, left, right, self)
            if len(run) <= 24 and len(self.lossy) < 1 << 17:
                self.lossy[key] = out
        return out

    def scores(self, cp: np.ndarray) -> np.ndarray:
        n12 = self.pairs[pair_slots(cp)] + 0.25
        c = np.minimum(cp, (1 << CHAR_BITS) - 1)
        n1 = self.chars[c] + 0.5
        info = np.log2(n12 * self.n / (n1[:-1] * n1[1:]))
        weight = n12 / self.n * np.maximum(info, 0.05)
        s = np.clip(np.log2(USUAL / weight), -4, 4)
        s[(cp[:-1] < 128) & (cp[1:] < 128)] = PLAIN
        return s

    def cost(self, text: str) -> float:
        if len(text) > 40:
            return float(self.bits[pair_slots(codes(text))].sum())
        total = 0.0
        for k in range(len(text) - 1):
            two = text[k : k + 2]
            b = self.bits_of.get(two)
            if b is None:
                b = self.bits_of[two] = float(self.bits[pair_slots(codes(two))[0]])
            total += b
        return total


def segments(s: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring runs of pairs: each ends where its total would fall to 0 or 6
    below its best. Plain pairs all score ``PLAIN`` and are passed over in one step."""
    out: list[tuple[int, int]] = []
    begin, total, best, best_at, last = -1, 0.0, 0.0, -1, -1
    at = np.flatnonzero(s != PLAIN)
    for i, v in zip(at.tolist(), s[at].tolist()):
        if begin >= 0:
            total += PLAIN * (i - last - 1)
            if total > 0 and total > best - 6:
                total += v
                if total > best:
                    best, best_at = total, i
            if total <= 0 or total <= best - 6:
                out.append((begin, best_at + 1))
                begin = -1
        if begin < 0 and v > 0:
            begin, total, best, best_at = i, v, v, i
        last = i
    if begin >= 0:
        out.append((begin, best_at + 1))
    return out


def _utf8(run: str, left: str, right: str, model: PairModel) -> str | None:
    """The run with every well-formed sequence restored whose restoration is likelier, by the
    encoding that leaves the fewest bits."""
    best, out = float("inf"), None
    for enc in WRONG:
        pattern, m = sequences(enc), byte_of(enc)
        changed = False

        def put(found: re.Match) -> str:
            nonlocal changed
            text = found.group()
            a = run[found.start() - 1] if found.start() else left
            b = run[found.end()] if found.end() < len(run) else right
            try:
                made = bytes(m[c] for c in text).decode("utf-8")  # noqa: B023
            except UnicodeDecodeError:
                return text
            if model.known(made) and model.cost(a + made + b) < model.cost(a + text + b) - 3:
                changed = True
                return made
            return text

        made = pattern.sub(put, run)
        if changed and (c := model.cost(left + made + right)) < best:
            best, out = c, made
    return out


def lost(run: str, left: str, right: str, model: PairModel) -> bool:
    """Whether the run has a sequence that lost bytes: an unread byte, or the beginning of a
    well-formed sequence of which some end gives a known character that is likelier by the
    ten bits that choosing among 64 ends and the inverse mapping cost."""
    if _LOST.search(run):
        return True
    for enc in WRONG:
        m = byte_of(enc)
        for found in cut_off(enc).finditer(run):
            a = run[found.start() - 1] if found.start() else left
            b = run[found.end()] if found.end() < len(run) else right
            begin = bytes(m[c] for c in found.group())
            short = (3 if begin[0] < 0xF0 else 4) - len(begin)
            if short > 1:
                continue
            around = a + found.group() + b
            now = model.cost(around)
            if now <= FLUENT * (len(around) - 1):  # reads as usual text
                continue
            limit = now - 10
            for last in range(0x80, 0xC0):
                made = (begin + bytes([last])).decode("utf-8", "ignore")
                if made and model.known(made) and model.cost(a + made + b) < limit:
                    return True
    return False


def _legacy(run: str, left: str, right: str, model: PairModel) -> str | None:
    """The run read again from one of the older encodings, if clearly likelier."""
    odd = sum(c > "\x7f" for c in run)
    if not odd:
        return None
    whole = left + run + right
    pairs = [whole[k : k + 2] for k in range(len(whole) - 1)]
    pairs = [x for x in pairs if not x.isascii()]
    if sum(map(model.cost, pairs)) <= FLUENT * len(pairs):
        return None
    now = model.cost(whole)
    best, out = now - max(10.0, 0.12 * now), None
    for wrong in WRONG:
        raw = to_bytes(run, wrong)
        if raw is None:
            continue
        for right_enc in RIGHT:
            if right_enc == wrong:
                continue
            try:
                made = raw.decode(right_enc)
            except UnicodeDecodeError:
                continue
            if made != run and model.known(made) and (c := model.cost(left + made + right)) < best:
                best, out = c, made
    return out


def _grown(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The run with the whole characters beyond ASCII at its ends."""
    while lo > 0 and text[lo - 1] > "\x7f":
        lo -= 1
    while hi < len(text) and text[hi] > "\x7f":
        hi += 1
    return lo, hi


def restore(text: str, model: PairModel) -> tuple[str, bool, bool]:
    """The restored text, whether the text has a garbled sequence, and whether one is left.

    Runs are restored until nothing is likelier; each turn lowers the text's bits, so the
    turns end. A run that lost bytes is garbled even where nothing can be restored.
    """
    if text.isascii():
        return text, False, False
    garbled = False
    while True:
        cp = codes(text)
        if len(cp) < 2:
            return text, garbled, False
        runs: list[tuple[int, int]] = []
        for lo, hi in segments(model.scores(cp)):
            lo, hi = _grown(text, lo, hi + 1)
            if runs and lo <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
            else:
                runs.append((lo, hi))
        parts, at, left = [], 0, False
        for lo, hi in runs:
            run = text[lo:hi]
            if not _MADE.search(run):
                continue
            a, b = text[lo - 1 : lo] if lo else "", text[hi : hi + 1]
            made = model.mended(a, run, b)
            if made is not None:
                parts += [text[at:lo], made]
                at = hi
            left = left or model.lost(a, run if made is None else made, b)
        garbled = garbled or left or bool(parts)
        if not parts:
            return text, garbled, left
        text = "".join([*parts, text[at:]])


def corpus_model(texts: DataFrame, column: str = "text") -> PairModel:
    """Every different text counts once, however the table is split into tasks."""

    def slots(rb: pa.RecordBatch) -> list[np.ndarray]:
        cp = codes("\x00".join(rb.column(0).to_pylist()))
        return [pair_slots(cp) if len(cp) > 1 else np.zeros(0, np.int64), np.minimum(cp, (1 << CHAR_BITS) - 1).astype(np.int64)]

    once = texts.select(column).where(F.col(column) != "").groupBy(F.xxhash64(column), F.length(column)).agg(F.min(column).alias(column)).select(column)
    pairs, chars = hashed_counts(once, slots, 2, max(PAIR_BITS, CHAR_BITS))
    return PairModel(pairs[: 1 << PAIR_BITS], chars[: 1 << CHAR_BITS])


def restored(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): (doc_id, garbled, text) of the garbled documents, restored
    where it could be, ``left`` telling whether garbled characters remain."""
    model = docs.sparkSession.sparkContext.broadcast(corpus_model(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rb in batches:
            ids, out, left = [], [], []
            for i, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                new, bad, rest = restore(t, m)
                if bad:
                    ids.append(i)
                    out.append(new)
                    left.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(left, pa.bool_())], ["doc_id", "restored", "left_garbled"])

    odd = spread(docs.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7f]")))
    return odd.mapInArrow(run, "doc_id long, restored string, left_garbled boolean")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents")).dropDuplicates(["doc_id"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found, those restored wholly or in part, and those with garbled characters left."""
    made = p10_restored(spark, sf_dir).join(table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id")
    return made.agg(F.count("*").alias("garbled"), F.count_if(F.col("restored") != F.col("text")).alias("restored"), F.count_if("left_garbled").alias("left_garbled"))


QUERIES = {"p10_report": p10_report, "p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict[str, str] = {}
