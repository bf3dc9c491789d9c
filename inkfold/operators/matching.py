"""Dictionary matching and the positions of spans."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .. import constants as K
from ..functions import text as T

PAGE = ["note_id", "page"]


def term_forms(terms: DataFrame) -> DataFrame:
    """One row per form of a term: form, form_ord, seq and what matching and scoring need."""
    standalone = (F.col("term") == F.col("normalized")) & (F.size("variants") == 0)
    return terms.select(
        "seq", "term", "normalized", "protect", "tier", "priority", "domain",
        standalone.alias("is_standalone"),
        F.posexplode(T.all_forms(F.col("term"), F.col("normalized"), F.col("variants"))).alias("form_ord", "form"),
    )


def _match_table(forms: DataFrame) -> DataFrame:
    """The first term in load order for every form that may be reported."""
    usable = forms.where((F.col("form") != "") & ((F.col("form") != F.col("normalized")) | F.col("is_standalone")))
    reason = F.when(
        F.col("is_standalone") & (F.col("form") == F.col("term")), F.lit(K.REASON_TERM)
    ).otherwise(F.format_string(K.REASON_VARIANT, "normalized"))
    first = usable.groupBy("form").agg(
        F.min_by(F.struct("seq", "form_ord", reason.alias("reason"), "protect"), F.struct("seq", "form_ord")).alias("t")
    )
    return first.select("form", "t.seq", "t.form_ord", "t.reason", F.col("t.protect").alias("is_protected"))


#: Bits of the filter that keeps pieces of no form out of the join: 512 KB, whatever the dictionary holds.
FILTER_BITS = 22
_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base]


def _slots(codes: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Place in the filter of each run of ``n`` letters; ``sums`` are the running sums of the letters' terms."""
    m = len(codes) - n + 1
    h = (sums[n:] - sums[:m]) * _powers(pow(_BASE, -1, 1 << 64), m)[:m]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes))[: len(codes)], out=out[1:])
    return out


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _marked(batches):
    """Forms to the filter's bits of a task and the lengths it met."""
    bits, lengths = np.zeros(1 << FILTER_BITS, bool), set()
    for batch in batches:
        for form in batch.column(0).to_pylist():
            codes = _letters(form)
            bits[_slots(codes, len(codes), _sums(codes))] = True
            lengths.add(len(codes))
    yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()], "lengths": [sorted(lengths)]}, schema=pa.schema([("bits", pa.binary()), ("lengths", pa.list_(pa.int32()))]))


#: Pieces, and letters of texts, after which they are handed on.
ROOM = 1 << 17


def _pieces(sent, lengths: list[int]):
    """Texts to those of their pieces that may be forms, each once a text; at most ``ROOM`` and those of one text and length are held at once."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            rows, out, met = [], [], 0

            def made():
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.string())], ["note_id", "page", "form"])

            for i, value in enumerate(batch.column(2)):
                text = value.as_py()
                codes = _letters(text)
                sums = _sums(codes)
                for n in lengths:
                    if n > len(codes):
                        break
                    # pieces of different lengths are different
                    found = {text[k : k + n] for k in np.flatnonzero(bits[_slots(codes, n, sums)]).tolist()}
                    out += found
                    rows += [i] * len(found)
                    if len(out) >= ROOM:
                        yield made()
                        rows, out, met = [], [], 0
                met += len(codes)
                if out and met >= ROOM:
                    yield made()
                    rows, out, met = [], [], 0
            yield made()

    return run


def dictionary_match(pages: DataFrame, forms: DataFrame, column: str = "clean_text", hint: str | None = None) -> DataFrame:
    """Forms found in each page, by an equi join on whole forms.

    For each length that a form of the dictionary has, a page gives its distinct pieces of that length, less those
    that a filter of fixed size rules out. The join has nothing to check afterwards, and a shuffled one moves
    pieces, not texts; Spark chooses which, or ``hint`` (a join hint) does.
    """
    table = _match_table(forms)
    bits, lengths = np.zeros(1 << FILTER_BITS >> 3, np.uint8), set()
    for r in table.select("form").mapInArrow(_marked, "bits binary, lengths array<int>").toLocalIterator():
        bits |= np.frombuffer(r.bits, np.uint8)
        lengths |= set(r.lengths)
    sent = pages.sparkSession.sparkContext.broadcast(bits.tobytes())
    text = F.col(column)
    kinds = [pages.schema[c].dataType.simpleString() for c in PAGE]
    pieces = pages.where(text != "").select(*PAGE, text.alias("_t")).mapInArrow(_pieces(sent, sorted(lengths)), f"note_id {kinds[0]}, page {kinds[1]}, form string")
    return pieces.join(table.hint(hint) if hint else table, "form").select(
        *PAGE, F.col("form").alias("suspect_span"), "reason", F.lit(1.0).alias("confidence"), "is_protected",
        F.lit("dict").alias("category"), F.lit("dictionary").alias("detector"), "seq", "form_ord",
    )


# --- positions -----------------------------------------------------------------
def first_wins(spans: DataFrame, order=("detector_ord", "seq")) -> DataFrame:
    """The first report of each text on a page."""
    w = W.partitionBy(*PAGE, "suspect_span").orderBy(*order)
    return spans.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def all_occurrences(spans: DataFrame, pages: DataFrame, column: str = "clean_text") -> DataFrame:
    """Every start of every span text (overlapping ones too); ``greedy`` marks a scan without overlap."""
    texts = spans.groupBy(*PAGE).agg(F.collect_set("suspect_span").alias("_s"))
    t = F.col(column)
    located = pages.join(texts, PAGE).select(
        *PAGE,
        F.explode(
            F.transform("_s", lambda s: F.struct(s.alias("suspect_span"), T.find_overlapping(t, s).alias("starts")))
        ).alias("x"),
    )
    n = F.char_length("suspect_span")
    return (
        located.select(*PAGE, "x.suspect_span", "x.starts")
        .withColumn(
            "_g", F.when(T.has_border(F.col("suspect_span")), T.greedy_starts(F.col("starts"), n)).otherwise(F.col("starts"))
        )
        .select(*PAGE, "suspect_span", "_g", F.explode("starts").alias("start"))
        .select(
            *PAGE, "suspect_span", "start", (F.col("start") + n).alias("end"),
            F.array_contains("_g", F.col("start")).alias("greedy"),
        )
    )


def drop_shadowed(occ: DataFrame) -> DataFrame:
    """Drop an occurrence when a longer span starts at the same place."""
    n = F.char_length("suspect_span")
    counted = F.when(F.col("greedy"), n) if "greedy" in occ.columns else n
    longest = F.max(counted).over(W.partitionBy(*PAGE, "start"))
    return occ.withColumn("_longest", longest).where(F.coalesce("_longest", F.lit(0)) <= n).drop("_longest")


def drop_bigram_covered(occ: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Drop one-letter occurrences that lie inside any bigram occurrence (note_id, page, start)."""
    covered = bigrams.select(
        *PAGE, F.explode(F.array(F.col("start"), F.col("start") + 1)).alias("start"), F.lit(1).alias("_len")
    ).distinct()
    return occ.withColumn("_len", F.char_length("suspect_span")).join(covered, [*PAGE, "start", "_len"], "left_anti").drop("_len")


def resume(occ: DataFrame) -> DataFrame:
    """Of the visible occurrences of a text keep those that do not overlap the kept one before."""
    n = F.char_length("suspect_span")
    grouped = occ.groupBy(*PAGE, "suspect_span").agg(F.sort_array(F.collect_list("start")).alias("_s"))
    kept = F.when(T.has_border(F.col("suspect_span")), T.greedy_starts(F.col("_s"), n)).otherwise(F.col("_s"))
    return grouped.select(*PAGE, "suspect_span", F.posexplode(kept).alias("occurrence_index", "start")).withColumn(
        "end", F.col("start") + n
    )


def occurrence_index(occ: DataFrame) -> DataFrame:
    """0-based number of each occurrence of a text on its page."""
    w = W.partitionBy(*PAGE, "suspect_span").orderBy("start")
    return occ.withColumn("occurrence_index", F.row_number().over(w) - 1)


def occurrences(spans: DataFrame, pages: DataFrame, column: str = "clean_text") -> DataFrame:
    """Visible, numbered occurrences of the span texts."""
    return resume(drop_shadowed(all_occurrences(spans, pages, column)))


def _bordered(s: str) -> bool:
    """Whether a text begins with one of its own ends, so that it can overlap itself."""
    return any(s.startswith(s[k:]) for k in range(1, len(s)))


def _apart(starts: np.ndarray, n: int) -> np.ndarray:
    """Of rising starts those that begin behind the one kept before."""
    kept, end = [], -1
    for s in starts.tolist():
        if s >= end:
            kept.append(s)
            end = s + n
    return np.array(kept, np.int64)


def visible_starts(text: str, names: list[str], forced: list[bool], bigram: list[bool]) -> list[np.ndarray]:
    """The visible starts of each of a page's distinct texts, by one pass of an automaton of all of them.

    A place is hidden where a longer text starts; a forced letter also where it is the second letter of a bigram. The longest
    text at a start is a maximum over the matches, so nothing is compared text by text. Of equal texts the first counts; later
    ones, and empty ones, are nowhere visible.
    """
    first = list({n: i for i, n in reversed(list(enumerate(names))) if n}.values())[::-1]
    if len(first) < len(names):
        out = [np.zeros(0, np.int64)] * len(names)
        part = [[a[i] for i in first] for a in (names, forced, bigram)]
        for i, starts in zip(first, visible_starts(text, *part) if first else [], strict=True):
            out[i] = starts
        return out
    automaton = ahocorasick.Automaton()
    for i, name in enumerate(names):
        automaton.add_word(name, i)
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    size = np.array([len(n) for n in names], np.int64)
    which = hits[:, 1]
    start = hits[:, 0] - size[which] + 1
    order = np.lexsort((start, which))
    which, start = which[order], start[order]
    edge = np.searchsorted(which, np.arange(len(names) + 1))
    over = {i: _apart(start[edge[i] : edge[i + 1]], len(n)) for i, n in enumerate(names) if edge[i] < edge[i + 1] and _bordered(n)}
    # what hides: every match, but of texts that overlap themselves those of a scan without overlap
    plain = ~np.isin(which, list(over))
    at = np.concatenate([start[plain], *over.values()])
    by = np.concatenate([which[plain], *[np.full(len(v), i) for i, v in over.items()]]).astype(np.int64)
    longest = np.zeros(len(text) + 1, np.int64)
    np.maximum.at(longest, at, size[by])
    seen = longest[start] <= size[which]
    if any(forced) and any(bigram):
        inside = np.zeros(len(text) + 2, bool)
        inside[at[np.array(bigram, bool)[by]] + 1] = True
        seen &= ~(np.array(forced, bool)[which] & (size[which] == 1) & inside[start])
    out = []
    for i, name in enumerate(names):
        own = start[edge[i] : edge[i + 1]][seen[edge[i] : edge[i + 1]]]
        out.append(_apart(own, len(name)) if i in over else own)
    return out


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _visible(text: pa.Array, names: pa.Array, forced: pa.Array, bigram: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (text, names, forced, bigram)), strict=True)
    made = [None if t is None or n is None else visible_starts(t, n, f, b) if n else [] for t, n, f, b in rows]
    return pa.array(made, pa.list_(pa.list_(pa.int32())))


#: Evaluated once, where it stands: what follows is not moved before it.
_visible = _visible.asNondeterministic()


def visible_starts_col(text: Column, findings: Column) -> Column:
    """Give the first finding of every text of a page its visible starts, in the row; findings that are nowhere visible are dropped.

    Two spans starting at one place are prefixes of each other, so only a longer one can hide a text; a
    one-letter forced span is also hidden inside a bigram.
    """

    def located(a):
        part = lambda get: F.transform(a, get)
        starts = _visible(text, part(lambda f: f["suspect_span"]), part(lambda f: f["forced"].isNotNull()), part(lambda f: f["bigram"].isNotNull()))
        return F.zip_with(a, starts, lambda f, s: F.struct(f.alias("f"), s.alias("starts")))

    return F.filter(located(findings), lambda x: F.size(x["starts"]) > 0)
