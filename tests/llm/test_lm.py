import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from inkfold.llm import attention, lm, units
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKENIZER = units.tokenizer_path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def plain_base(rows):
    count = collections.Counter()
    for i, t in rows:
        if i is not None and fold(i) != 1:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, i is not None and fold(i) == 1, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [lm.BLOCK, 2000])
def test_base_against_plain_counts(spark, block):
    rows = cases.texts() + [cases.texts()[3], (70001, "WORD wOrd word"), (70002, "É é")]
    got = lm.score(cases.frame(spark, rows), TOKENIZER, block).collect()
    want = plain_base(rows)
    got = sorted((tuple(r) for r in got), key=lambda r: repr((*r[:5], round(r[5], 6))))
    want = sorted(want, key=lambda r: repr((*r[:5], round(r[5], 6))))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    copies = {g[6] for g in got if g[0] in (93, 94)}  # equal texts, learned from or not
    assert len(copies) == 1


def test_no_rows_and_nothing_to_learn_from(spark):
    assert lm.score(cases.frame(spark, []), TOKENIZER).collect() == []
    held = [i for i in range(50) if fold(i) == 1][:2]
    got = lm.score(cases.frame(spark, [(held[0], "a b"), (held[1], None)]), TOKENIZER).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in got} == {(True, 0, 0, 0.0)}
    assert all(r.score < 0 for r in got)


def test_lessons_are_learned_from_and_help(spark, monkeypatch):
    monkeypatch.setattr(lm, "PRIMER", 100_000)
    monkeypatch.setattr(lm, "SHARE", 0.8)
    monkeypatch.setattr(lm, "LESSON", 30_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    end = units.encoder(TOKENIZER).tokenizer.get_vocab_size()
    corpus = lm.read_corpus(docs, TOKENIZER, 20_000)
    assert corpus.agg({"lesson_ids": "sum"}).first()[0] > 60_000
    model, code = lm.learn(corpus, end)
    texts = [r.text for r in docs.collect() if fold(r.doc_id) == 1]
    enc = units.encoder(TOKENIZER)
    ids = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    flat, offs = np.concatenate(ids).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in ids])]
    learned = attention.Scorer(model, code).score(flat, offs, end).sum()
    untaught = attention.Scorer(attention.start(code), code).score(flat, offs, end).sum()
    monkeypatch.setattr(lm, "SHARE", 0.0)
    assert learned > 0.9 * untaught
    alone, _ = lm.learn(lm.read_corpus(docs, TOKENIZER, 20_000), end)
    assert learned > attention.Scorer(alone, code).score(flat, offs, end).sum()


def test_every_training_text_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(lm, "PRIMER", 100_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    end = units.encoder(TOKENIZER).tokenizer.get_vocab_size()
    corpus = lm.read_corpus(docs, TOKENIZER, 20_000)
    met = []
    for r in corpus.collect():
        counted = np.frombuffer(r.id_counts, np.int64).sum()  # of all training texts, their ends included
        ids, offs = lm._open(r.primer)
        parts = list(lm._lessons_of(r.payload, 3000))
        assert r.lesson_ids == sum(len(i) + len(n) for i, n in parts)
        assert counted == len(ids) + len(offs) - 1 + r.lesson_ids
        assert all(len(n) == 1 or len(i) <= 3000 for i, n in parts)
        met.append(r.lesson_ids)
    assert sum(met) > 0
    seen, train = [], attention.train
    monkeypatch.setattr(attention, "train", lambda model, code, ids, offs, end, tokens, *a, **k: seen.append(tokens - len(ids) - len(offs) + 1) or train(model, code, ids, offs, end, 1, *a, **k))
    monkeypatch.setattr(lm, "POSITIONS", 10)
    monkeypatch.setattr(lm, "_learned", lambda corpus, model, *_: model)
    lm.learn(corpus, end)
    assert seen == [0]  # the primer is met once at least


# --- the model -----------------------------------------------------------------------------
def small(seed=3):
    rng = np.random.default_rng(seed)
    counts = np.floor(1e4 / np.arange(1, 3001)).astype(np.int64)
    code = attention.codes(rng.permutation(counts))
    model = attention.start(code)
    model["far"] += rng.normal(size=attention.WIDTH).astype(np.float32)
    return model, code, rng


def plain_score(model, code, ids, end):
    """log10 of a text, one position after the other, each with the context its window gives it."""
    m = {k: v.astype(np.float64) for k, v in model.items()}
    seen, total = [end, *ids], 0.0
    for t, target in enumerate([*ids, end]):
        k = 0 if t < attention.WIDTH else -(-(t + 1 - attention.WIDTH) // attention.STEP)
        first = k * attention.STEP
        h = np.array([m["now"][code.row[seen[s]]] + m["last"][code.row[seen[max(s - 1, 0)]]] for s in range(first, t + 1)])
        a = (h[-1] @ m["q"]) @ (h @ m["k"]).T * attention.DIM**-0.5 + m["far"][t - first :: -1][: t - first + 1]
        a = np.exp(a) / np.exp(a).sum()
        h1 = h[-1] + (a @ (h @ m["v"])) @ m["o"]
        h2 = h1 + np.maximum(h1 @ m["in"] + m["shift"], 0) @ m["out"]
        x, c = h2 @ m["class"] + m["class0"], code.kind[target]
        total += x[c] - np.log(np.exp(x).sum())
        if c < attention.CLASSES - 1:
            y = h2 @ m["place"][c] + m["place0"][c]
            total += y[code.place[target]] - np.log(np.exp(y).sum())
        total += code.rare[target]
    return total / np.log(10)


def test_windows_score_each_id_once_as_a_plain_loop_does():
    model, code, rng = small()
    end = len(code.row) - 1
    texts = [rng.integers(0, end, n) for n in (0, 1, 5, attention.WIDTH - 2, attention.WIDTH - 1, attention.WIDTH, attention.WIDTH + 1, attention.WIDTH + attention.STEP, 150)]
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = attention.Scorer(model, code).score(np.concatenate(texts), offs, end)
    assert np.allclose(got, [plain_score(model, code, t.tolist(), end) for t in texts], rtol=1e-4)
    lengths = np.diff(offs) + 1
    seen = [np.zeros(n, int) for n in lengths]
    for text, first, scored, stop in zip(*attention.windows(lengths), strict=True):
        seen[text][scored:stop] += 1
        assert scored - first in (0, attention.WIDTH - attention.STEP) and stop - first <= attention.WIDTH
    assert all((s == 1).all() for s in seen)


def test_a_lesson_is_not_laid_out_in_windows():
    model, code, rng = small()
    ids, offs = rng.integers(0, 2000, 400_000), np.arange(0, 400_001, 1000)
    tracemalloc.start()
    attention.train(model, code, ids, offs, len(code.row) - 1, 1, 0.2, together=192)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # windows of the whole lesson took 28 MB


def test_encoders_are_released():
    assert units.encoder(TOKENIZER) is units.encoder(TOKENIZER)
    units.release()
    assert not units._ENCODERS
    assert units.encoder(TOKENIZER).tokenizer.get_vocab_size() > 0


def test_freed_memory_goes_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    held = [np.ones(2000, np.uint8) for _ in range(50_000)]
    last = held[-1]  # keeps the end of the heap in use
    del held
    before = resident()
    units.trim()
    assert resident() < before - 50 and last.all()


def test_probabilities_of_all_ids_sum_to_one():
    model, code, rng = small()
    h = np.c_[rng.normal(size=(1, attention.DIM)), 1].astype(np.float32)
    n = len(code.row)
    got = attention.Scorer(model, code).log_probabilities(np.repeat(h, n, axis=0), np.arange(n))
    assert abs(np.exp(got).sum() - 1) < 1e-4


def test_nothing_later_is_seen():
    model, code, rng = small()
    now, last = rng.integers(0, 100, (1, attention.WIDTH)), rng.integers(0, 100, (1, attention.WIDTH))
    a = attention.Scorer(model, code).hidden(now, last)
    now[0, 10:] += 1
    b = attention.Scorer(model, code).hidden(now, last)
    assert (a[:10] == b[:10]).all() and (a[10:] != b[10:]).any()


def test_gradients_against_differences():
    model, code, rng = small()
    model = {k: v.astype(np.float64) for k, v in model.items()}
    ids = rng.integers(0, 2000, 60)
    _, now, last, then, on = next(attention.batches(ids, np.array([0, 25, 60]), len(code.row) - 1))
    _, g, sparse = attention.gradients(model, code, now, last, then, on)
    for k, (rows, d) in sparse.items():
        g[k] = np.zeros_like(model[k])
        g[k][rows] = d
    for k, v in model.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        step, old = 1e-5, v[at]
        v[at] = old + step
        up = attention.gradients(model, code, now, last, then, on)[0]
        v[at] = old - step
        down = attention.gradients(model, code, now, last, then, on)[0]
        v[at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k


def test_only_scored_positions_go_through_the_layers():
    model, code, rng = small()
    ids = rng.integers(0, 2000, 200)
    found = [x for x in attention.batches(ids, np.array([0, 200]), len(code.row) - 1)]
    for _, now, last, then, on in found:
        at, kept = np.flatnonzero(on), {}
        assert len(attention.hidden(model, code.row[now], code.row[last], at, kept)) == len(kept["z"]) == on.sum() < on.size
        some = attention.Scorer(model, code).hidden(code.row[now], code.row[last], at, int(on.any(axis=0).argmax()))
        assert np.allclose(some, attention.Scorer(model, code).hidden(code.row[now], code.row[last])[at], atol=1e-5)


def test_word_counts_move_in_ranges(spark, monkeypatch):
    rows = cases.texts()
    corpus = lm.read_corpus(cases.frame(spark, rows), TOKENIZER, 2000)
    plain = collections.Counter()
    for r in corpus.collect():
        plain.update(dict(zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True)))
    monkeypatch.setattr(lm, "_bucketed", lambda df: df)
    known = lm.word_counts(corpus)
    assert "Window" not in known._jdf.queryExecution().toString()  # no row a word
    found = {r.block: np.frombuffer(r.found, np.int64).tolist() for r in known.collect()}
    assert found == {r.block: [plain[k] for k in np.frombuffer(r["keys"], np.int64).tolist()] for r in corpus.collect()} and len(found) > 2
    assert sum(r.firsts for r in known.collect()) == sum(n > 0 for n in plain.values())
