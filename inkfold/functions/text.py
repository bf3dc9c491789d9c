"""Column expressions on text: lines, literals, scripts, tokens.

All of them are built-in Spark expressions but :func:`nfc`, because Spark has no Unicode normalization function, and
:func:`matches`, which needs the places of a pattern's matches.  Offsets are 0-based code points, half open.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K

HIRAGANA_LETTERS = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA_LETTERS = "".join(chr(ord(c) + 0x60) for c in HIRAGANA_LETTERS)
# the whole-text replacement stops at U+3093
HIRAGANA_TEXT_LETTERS = HIRAGANA_LETTERS[: HIRAGANA_LETTERS.index("ん") + 1]
KATAKANA_TEXT_LETTERS = KATAKANA_LETTERS[: len(HIRAGANA_TEXT_LETTERS)]


def let(value: Column, body) -> Column:
    """Evaluate an expression once and use it many times.

    An expression named inside a lambda would be computed again for every element; as the element of
    a one-element array it is a plain variable there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- trimming and lines ------------------------------------------------------
def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[{K.SPACE}]+$", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{K.SPACE}]+|[{K.SPACE}]+$", "")


def split_lines(c: Column) -> Column:
    """Lines as Python's ``splitlines`` cuts them: no empty last line."""
    return let(
        F.split(c, K.LINE_END, -1),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def newline_lines(c: Column) -> Column:
    """Lines cut at the newline only; a text without one is a single line."""
    return F.split(c, "\n", -1)


def normalize_text(c: Column) -> Column:
    """Right-strip every line, then strip the whole."""
    return strip(F.array_join(F.transform(split_lines(c), rstrip), "\n"))


# --- literals ----------------------------------------------------------------
def quote(c: Column) -> Column:
    """Escape regular-expression metacharacters of a literal held in a column."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def count_literal(text: Column, literal: Column) -> Column:
    """Occurrences of a literal, not overlapping, left to right."""
    removed = F.char_length(text) - F.char_length(F.replace(text, literal, F.lit("")))
    return F.try_divide(removed, F.char_length(literal)).cast("int")


def _starts(pieces: Column, gap: Column | int) -> Column:
    """Offset after each piece plus ``gap`` per cut: the running length of a split text."""
    gap = F.lit(gap) if isinstance(gap, int) else gap
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(
        pieces,
        zero,
        lambda acc, x: F.struct(
            (acc["p"] + F.char_length(x) + gap).cast("int").alias("p"),
            F.array_append(acc["a"], (acc["p"] + F.char_length(x)).cast("int")).alias("a"),
        ),
        lambda acc: acc["a"],
    )


def cut_points(pieces: Column, gap: Column | int = 0) -> Column:
    """Offsets at which a split text was cut, ``gap`` characters being lost at each cut."""
    return let(_starts(pieces, gap), lambda ends: F.slice(ends, 1, F.size(ends) - 1))


def find_all(text: Column, literal: Column) -> Column:
    """Starts of a literal, not overlapping, left to right."""
    cuts = cut_points(F.split(text, quote(literal), -1), F.char_length(literal))
    return F.when(F.contains(text, literal), cuts).otherwise(F.array().cast("array<int>"))


def find_overlapping(text: Column, literal: Column) -> Column:
    """Every start of a literal, overlapping ones too."""
    ahead = F.concat(F.lit("(?="), quote(literal), F.lit(")"))
    inner = cut_points(F.split(text, ahead, -1))
    first = F.when(F.startswith(text, literal), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(F.contains(text, literal), F.concat(first, inner)).otherwise(F.array().cast("array<int>"))


def has_border(literal: Column) -> Column:
    """True when a literal can overlap a copy of itself (some proper prefix is a suffix)."""
    n = F.char_length(literal)
    return F.when(
        n > 1,
        F.exists(
            F.sequence(F.lit(1), n - 1),
            lambda k: F.substring(literal, F.lit(1), k) == F.substring(literal, n - k + 1, k),
        ),
    ).otherwise(F.lit(False))


def greedy_starts(starts: Column, length: Column) -> Column:
    """From all sorted starts keep those a left-to-right scan without overlap would meet."""
    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, s: F.when(
            s >= acc["next"],
            F.struct((s + length).cast("int").alias("next"), F.array_append(acc["a"], s).alias("a")),
        ).otherwise(acc),
        lambda acc: acc["a"],
    )


def context(text: Column, start: Column, end: Column, width: int = 4) -> Column:
    """The text around a span, ``width`` characters on both sides."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(text, first + 1, end + width - first)


def splice(text: Column, edits: Column) -> Column:
    """Replace many spans at once.

    ``edits``: array of struct(start, end, new), sorted by start, not overlapping.
    """
    n = F.size(edits)
    pieces = F.transform(
        edits,
        lambda e, i: F.concat(
            F.substring(
                text,
                F.when(i == 0, F.lit(0)).otherwise(F.get(edits, i - 1)["end"]) + 1,
                e["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(edits, i - 1)["end"]),
            ),
            e["new"],
        ),
    )
    tail_from = F.when(n == 0, F.lit(0)).otherwise(F.get(edits, n - 1)["end"])
    tail = F.substring(text, tail_from + 1, F.char_length(text))
    return F.concat(F.array_join(pieces, ""), tail)


_MATCHES = "array<struct<start:int,text:string,before:string,after:string>>"


def matches(scanned: Column, pattern: str, shown: Column | None = None, width: int = 0) -> Column:
    """Matches of a pattern, left to right: array of struct(start, text, before, after).

    They are looked for in ``scanned`` and read from ``shown``, a text of the same length, with ``width`` letters on both
    sides. One pass over a text gives all of it: a substring of Spark's counts letters from the front of its text each time.
    """
    wanted = re.compile(pattern)

    @F.arrow_udf(_MATCHES)
    def found(scanned: pa.Array, shown: pa.Array) -> pa.Array:
        edges, start, text, before, after = [0], [], [], [], []
        for a, b in zip(scanned.to_pylist(), shown.to_pylist(), strict=True):
            for m in wanted.finditer(a or ""):
                s, e = m.span()
                start.append(s)
                text.append(b[s:e])
                before.append(b[max(0, s - width) : s])
                after.append(b[e : e + width])
            edges.append(len(start))
        strings = [pa.array(x, pa.string()) for x in (text, before, after)]
        rows = pa.StructArray.from_arrays([pa.array(start, pa.int32()), *strings], ["start", "text", "before", "after"])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)

    return found(scanned, scanned if shown is None else shown)


# --- scripts -----------------------------------------------------------------
def hira_to_kata(c: Column) -> Column:
    return F.translate(c, HIRAGANA_LETTERS, KATAKANA_LETTERS)


def hiragana_apply_text(c: Column) -> Column:
    return F.translate(c, HIRAGANA_TEXT_LETTERS, KATAKANA_TEXT_LETTERS)


def kana_label(c: Column) -> Column:
    hira, kata = c.rlike("[ぁ-ゖ]"), c.rlike(f"[{K.KATAKANA}]")
    return F.when(hira & ~kata, "ひらがな").when(kata & ~hira, "カタカナ")


def dominant_script(c: Column) -> Column:
    """'ascii', 'kanji', 'kana' or 'mixed', by the Unicode names of the characters."""
    kanji = F.regexp_count(c, F.lit(f"[{K.KANJI_BY_NAME}]"))
    kana = F.regexp_count(c, F.lit(f"[{K.KANA_BY_NAME}]"))
    total = kanji + kana
    return (
        F.when(c.rlike(r"\A[\x00-\x7F]+\z"), "ascii")
        .when(total == 0, "mixed")
        .when(kanji / total >= 0.8, "kanji")
        .when(kana / total >= 0.8, "kana")
        .otherwise("mixed")
    )


def compat_script(span_script: Column, candidate_script: Column) -> Column:
    return (
        F.when(span_script == "ascii", candidate_script == "ascii")
        .when(span_script == "kanji", candidate_script.isin("kanji", "mixed"))
        .when(span_script == "kana", candidate_script.isin("kana", "mixed"))
        .otherwise(F.lit(True))
    )


def scripts_accepting(candidate_script: Column) -> Column:
    """The span scripts for which a candidate of this script is compatible."""
    return (
        F.when(candidate_script == "ascii", F.array(F.lit("ascii"), F.lit("mixed")))
        .when(candidate_script == "kanji", F.array(F.lit("kanji"), F.lit("mixed")))
        .when(candidate_script == "kana", F.array(F.lit("kana"), F.lit("mixed")))
        .otherwise(F.array(F.lit("kanji"), F.lit("kana"), F.lit("mixed")))
    )


def char_diversity(c: Column) -> Column:
    """Distinct over all characters, white space not counted; null for an empty text."""
    solid = F.regexp_replace(c, rf"(?U)[{K.SPACE}]", "")
    n = F.char_length(solid)
    return F.when(n > 0, F.size(F.array_distinct(F.split(solid, "", -1))) / n)


# --- tokens ------------------------------------------------------------------
def is_noise_token(c: Column) -> Column:
    n = F.char_length(c)
    return (
        (n < K.TOKEN_MIN_LEN)
        | (n > K.TOKEN_MAX_LEN)
        | c.rlike("https?://")
        | c.rlike(r"(?U)^\d+$")
        | c.rlike(r"(?U)^\d{4}([-/]\d{1,2}){0,2}$")
        | c.rlike(r"^[A-Za-z0-9_\-]+$")
    )


def split_tokens(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern, -1), strip), lambda t: t != "")


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, f"[{K.EMOJI}]", "")


def page_name(link: Column) -> Column:
    """Last path part of a link, without ``#anchor`` and suffix."""
    stem = F.substring_index(F.substring_index(link, "/", -1), "#", 1)
    return F.regexp_replace(stem, r"(?s)\.[^.]*$", "")


def wikilink_text(display: Column, link: Column) -> Column:
    """What a wikilink reads as: its display, else the page name."""
    return F.when(F.coalesce(display, F.lit("")) != "", strip(display)).otherwise(strip(page_name(link)))


def wikilink_texts(c: Column, clean=lambda x: x) -> Column:
    """The readings of all wikilinks of a text, in order."""
    whole = F.regexp_extract_all(c, F.lit(K.WIKILINK), F.lit(0))
    return F.transform(
        whole,
        lambda w: clean(
            wikilink_text(F.regexp_extract(w, K.WIKILINK, 2), F.regexp_extract(w, K.WIKILINK, 1))
        ),
    )


def without_wikilinks(c: Column) -> Column:
    return F.regexp_replace(c, K.WIKILINK, " ")


def strip_wikilink(c: Column) -> Column:
    """Replace every wikilink of a frontmatter value by its reading, without leading marks.

    Leading characters from U+2000 up, outside the CJK and kana blocks, are dropped from a
    page name (not from a display text).
    """
    marks = r"^[\x{2000}-\x{2FFF}\x{3100}-\x{4DFF}\x{A000}-\x{10FFFF}]+"
    whole = F.regexp_extract_all(c, F.lit(K.WIKILINK), F.lit(0))
    pieces = F.split(c, K.WIKILINK, -1)

    def reading(w):
        display, link = F.regexp_extract(w, K.WIKILINK, 2), F.regexp_extract(w, K.WIKILINK, 1)
        bare = F.regexp_replace(page_name(link), marks, "")
        return F.when(display != "", strip(display)).otherwise(strip(bare))

    joined = F.transform(
        pieces,
        lambda p, i: F.concat(p, F.when(i < F.size(whole), reading(F.get(whole, i))).otherwise(F.lit(""))),
    )
    return F.array_join(joined, "")


# --- values ------------------------------------------------------------------
def parse_bool(c: Column, default: bool = False) -> Column:
    word = F.lower(strip(c))
    return (
        F.when(word.isin(*K.TRUE_WORDS), F.lit(True))
        .when(word.isin(*K.FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(default))
    )


def parse_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(default))


def normalize_variants(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]", -1), strip), lambda p: p != "")
    return F.array_join(F.array_distinct(parts), ";")


def split_variants(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";", -1), strip), lambda p: p != "")


def all_forms(term: Column, normalized: Column, variants: Column) -> Column:
    """Distinct forms of a term, in the order term, normalized, variants."""
    return F.array_distinct(F.concat(F.array(term, normalized), variants))


def safe_export_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[/\\:*?"<>|]', "_")


def span_id(page: Column, occurrence: Column, start: Column) -> Column:
    return F.format_string("p%d_o%d_s%d", page, occurrence, start)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))
