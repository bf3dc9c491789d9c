import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.llm import components, line_dedup, simhash, substring_dedup
from tests.llm import cases

SPACED = re.compile("[^\x20\x09-\x0d]+")


# --- substring dedup ---------------------------------------------------------------------
def without_repeats(rows, size):
    words = [SPACED.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                keep[k : k + size] = [False] * size
        left = " ".join(x for x, f in zip(w, keep, strict=True) if f)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [35, 3])
def test_repeated_windows_go(spark, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)  # many blocks
    rows = cases.texts() + [cases.texts()[3]]
    got = cases.collect(substring_dedup.remove_repeats(cases.frame(spark, rows), size))
    assert got == without_repeats(rows, size)
    assert sum(r[2] for r in got) > 100


def test_no_windows_at_all(spark):
    assert substring_dedup.remove_repeats(cases.frame(spark, [])).collect() == []
    got = cases.collect(substring_dedup.remove_repeats(cases.frame(spark, [(1, "a b"), (2, None)])))
    assert [r[:3] for r in got] == [(1, 2, 0), (2, 0, 0)]


# --- line dedup --------------------------------------------------------------------------
def deduped(rows):
    keyed = [(i, t) for i, t in rows]
    places = collections.defaultdict(set)
    for i, t in keyed:
        for at, n, body in line_dedup.chunks(t) if t is not None else []:
            if n >= line_dedup.LEAST:
                places[body].add((i is not None, i or 0, at))
    out = []
    for i, t in keyed:
        if t is not None:
            kept = [b for at, n, b in line_dedup.chunks(t) if n < line_dedup.LEAST or (i is not None, i or 0, at) == min(places[b])]
            t = b"\n".join(kept).decode()
        out.append((i, t))
    return sorted(out, key=repr)


def test_repeated_chunks_go(spark):
    rows = cases.texts()
    df = line_dedup.remove_repeats(cases.frame(spark, rows))
    assert df.columns == cases.frame(spark, rows).columns
    got = df.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == deduped(rows)
    assert sum(len(t or "") for _, t in rows) > sum(len(r.text or "") for r in got) + 100
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got if r.doc_id is not None)


def test_equal_rows_are_one_place_and_no_rows_none(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    assert [r.text for r in line_dedup.remove_repeats(cases.frame(spark, [(1, text), (1, text)])).collect()] == [text, text]
    assert line_dedup.remove_repeats(cases.frame(spark, [])).collect() == []


def test_boundaries_come_back_after_an_insertion():
    lines = [f"line {i}" for i in range(200)]
    before = {b for _, _, b in line_dedup.chunks("\n".join(lines))}
    after = {b for _, _, b in line_dedup.chunks("\n".join([*lines[:7], "new", *lines[7:]]))}
    assert len(before - after) <= 3 and len(before) > 20


# --- simhash -----------------------------------------------------------------------------
def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACED.findall(t)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = list(range(len(prints)))
    for x in range(len(prints)):
        for y in range(x):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= 3:
                a, b = group[x], group[y]
                group = [a if g == b else g for g in group]
    least = {g: min((i for (i, _), h in zip(prints, group, strict=True) if h == g and i is not None), default=None) for g in group}
    return sorted(((i, f"{p:016x}", least[g]) for (i, p), g in zip(prints, group, strict=True)), key=repr)


@pytest.mark.parametrize("tile", [4096, 2])
def test_near_duplicates(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    long = " ".join(f"w{i}" for i in range(400))
    rows = cases.texts() + [(500, long), (501, long.replace("w7 ", "w8 ")), (502, long + " end"), (503, long.upper()), (3, long), (504, None)]
    got = cases.collect(simhash.near_duplicates(cases.frame(spark, rows)))
    assert got == plain_groups(rows)
    assert len({r[2] for r in got}) < len(got) - 3


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (9, "other words here now"), (9, "other words here now"), (None, "a b c d")]
    df = simhash.keep_one(cases.frame(spark, rows))
    assert sorted((r.doc_id for r in df.collect()), key=repr) == [2, 9, None]
    assert simhash.keep_one(cases.frame(spark, [])).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=90), st.lists(st.lists(st.integers(0, 63), max_size=5), min_size=1, max_size=90))
@settings(max_examples=40, deadline=None)
def test_bit_sliced_pairs(values, flips):
    near = [v ^ sum({1 << b for b in f}) for v, f in zip(values, flips, strict=False)]
    a, b = np.array(values, np.uint64), np.array(near, np.uint64)
    x, y = simhash.close_pairs([(a, b), (b, a)])
    want = [(int(p), int(q)) for s, t in ((a, b), (b, a)) for p in s for q in t if int(p ^ q).bit_count() <= 3]
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[0] != got[100]
