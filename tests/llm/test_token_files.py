import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.llm import packing, scan, token_files, units
from inkfold.llm.token_files import EliasFano
from tests.llm import cases

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", ",", "'s", "'", "12", "_", "ß", "×", "İ", "̇", "́", " ", "|", "<|endoftext|>", "word", "Ünï", "don't", "...", "\r\n", "日本", "x.'s", "\x1c", "ªº", "²"]


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(units.tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", [BYTE, WORD])
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=30), limit=st.integers(1, 200))
@settings(max_examples=60, deadline=None)
def test_units_give_the_ids_of_whole_texts(name, texts, limit):
    import pyarrow as pa

    enc, got = units.encoder(units.tokenizer_path(name)), []
    for lo, hi, data, offs in scan.slices(pa.array(texts, pa.string()), limit):
        ids, at = enc.encode(data, offs)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [e.ids for e in plain(name).encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(-(2**40), 2**40), max_size=400))
@settings(max_examples=80, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef = EliasFano(EliasFano.encode(np.array(values, np.int64)) + b"behind")
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_boundaries_take_little_space():
    bounds = np.cumsum(np.full(10_000, 700))
    assert len(EliasFano.encode(bounds)) < 10_000 * 2


def test_a_hash_table_finds_what_was_added():
    keys = scan.mix(np.arange(1, 5000, dtype=np.uint64))
    t = scan.HashTable(4)
    for part in np.split(keys, [10, 500, 2000]):
        t.add(part)
    assert t.find(keys).tolist() == list(range(len(keys)))
    assert (t.find(scan.mix(np.arange(6000, 7000, dtype=np.uint64))) == -1).all()


def wanted(rows, name, end):
    enc = plain(name).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [np.array([*e.ids, end], "<u4") for e in enc]


def test_token_file_reads_back(spark):
    rows = cases.texts()
    blocks = token_files.write_tokens(cases.frame(spark, rows), units.tokenizer_path(BYTE), 2)
    got = [tuple(r) for r in token_files.read_tokens(blocks).collect()]
    ids = {(i, t): x for (i, t), x in zip(rows, wanted(rows, BYTE, 2), strict=True)}
    assert sorted((i or -1, len(x), zlib.crc32(x)) for (i, _), x in ids.items()) == sorted((i or -1, n, c) for i, _, n, c in got)
    order = sorted(got, key=lambda r: r[1])
    assert [i for i, *_ in order if i is not None] == sorted(i for i, *_ in got if i is not None)
    assert [i for i, *_ in order][:2] == [None, None]
    at = 0
    for _, start, n, _ in order:
        assert start == at
        at += n


def test_empty_token_file(spark):
    blocks = token_files.write_tokens(cases.frame(spark, []), units.tokenizer_path(BYTE), 2)
    assert token_files.read_tokens(blocks).collect() == []


@pytest.mark.parametrize("size", [4096, 64, 7])
def test_packing(spark, size):
    rows = cases.texts() + [(1, cases.texts()[1][1])]
    got = packing.pack(cases.frame(spark, rows), units.tokenizer_path(WORD), 1, size).collect()
    want = []
    for (i, _), x in zip(rows, wanted(rows, WORD, 1), strict=True):
        want += [(i, k // size, k, len(x[k : k + size]), zlib.crc32(x[k : k + size])) for k in range(0, len(x), size)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    assert len(bins) <= -(-sum(r.length for r in got) // size) * 1.2 + 1


def test_packing_nothing(spark):
    assert packing.pack(cases.frame(spark, []), units.tokenizer_path(WORD), 1).collect() == []


@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=31) if lengths else np.zeros(31, np.int64)
    used = np.zeros(31, np.int64)
    total = 0
    for inside, times in packing.plan(counts):
        assert sum(inside) <= 30
        total += times
        for x in inside:
            used[x] += times
    assert (used == counts).all()
    assert total <= -(-sum(lengths) // 30) * 1.5 + 1


def test_exact_complements_are_taken():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 50, 25, 10, 15]] = [4, 4, 2, 2, 2, 2]  # 60+40, 50+50, 25+... in whole sequences
    assert sum(n for _, n in packing.plan(counts)) == -(-int((counts * np.arange(101)).sum()) // 100)
