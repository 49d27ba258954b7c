"""Text functions as Columns: Unicode white space, lines, trimming, ids, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by code point, the same in Java's and RE2's syntax.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

#: Characters that end a line, and white space within one.
ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
BLANK = r"\x09\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"


#: The same characters as texts, for trimming without regular expressions.
BLANKS = "\t\x1f \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
SPACES = BLANKS + "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def norm(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"[{SPACE}]+", " "))


def key(c: Column) -> Column:
    return F.lower(norm(c))


def lines(c: Column) -> Column:
    """Lines of a text; no empty line after a final line end."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?:{LINE_END})\\z", ""), LINE_END)


def plain_ends(c: Column) -> Column:
    """Every line end as a line feed; texts with no other are not copied."""
    return F.when(c.rlike(f"[{ENDS.removeprefix(chr(92) + 'n')}]"), F.regexp_replace(c, LINE_END, "\n")).otherwise(c)


def title_case(c: Column) -> Column:
    """A capital after every non-letter, small letters after letters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; ``item`` if none is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("item"))


def stable_id(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of the parts; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 16)


def tokens(c: Column) -> Column:
    """Distinct ASCII words, lower case, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out
