import hashlib
import random

import pyarrow as pa
import pytest

from inkfold.llm import decontaminate as D
from inkfold.llm import scan
from tests.llm import cases


def brute(docs, items, size):
    windows = {}
    for name, text in items:
        w = D.words_of(text)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(m, {}).setdefault(tuple(w[k : k + m]), set()).add(name)
    out = []
    for i, text in docs:
        w = D.words_of(text)
        hit, names = [False] * len(w), set()
        for m, known in windows.items():
            for k in range(len(w) - m + 1):
                if found := known.get(tuple(w[k : k + m])):
                    hit[k : k + m] = [True] * m
                    names |= found
        names = sorted(x for x in names if x is not None)
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


ITEMS = [("1", "the of Th thor ndhe éreau über Oneaea and, on. idiot to x the of"), ("2", "No"), ("3", None), ("4", "..."), (None, "of the"), ("10", "the of th THOR"), ("10", "x the of"), ("2", "no")]


@pytest.mark.parametrize("size", [10, 3])
@pytest.mark.parametrize("pass_bytes", [8 << 20, 20])
def test_contamination(spark, size, pass_bytes, monkeypatch):
    monkeypatch.setattr(D, "PASS_BYTES", pass_bytes)  # 20: several passes
    rows = [*cases.texts(), (4, cases.texts()[4][1]), (700, "and x " + ITEMS[0][1].upper() + " y")]
    items = [(int(i) if i else None, t) for i, t in ITEMS]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = cases.collect(D.contamination(cases.frame(spark, rows), table, size))
    assert got == brute(rows, ITEMS, size)
    kept = D.keep_clean(cases.frame(spark, rows), table, size)
    assert kept.columns == cases.frame(spark, rows).columns
    assert sorted((repr(r.doc_id) for r in kept.collect())) == sorted(repr(r[0]) for r in got if not r[5])


def test_nothing_to_find_and_nothing_to_search(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in D.contamination(cases.frame(spark, cases.texts()), none).collect())
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(cases.frame(spark, []), some).collect() == []


def test_search_over_few_words_meets_every_shift():
    rng = random.Random(4)
    letters = ["a", "B", "c", "d é", "e"]
    docs = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    for size in (1, 2, 3, 5):
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))) for i in range(12)]
        patterns, got = D.Patterns(items, size), []
        for lo, hi, data, offs in scan.slices(pa.array([t for _, t in docs]), 300):
            rows, hit, names = patterns.scan(data, offs)
            for i in range(hi - lo):
                got.append((docs[lo + i][0], int(rows[i + 1] - rows[i]), int(hit[rows[i] : rows[i + 1]].sum()), sorted(names.get(i, ()))))
        assert [(a, b, c) for a, b, c, _ in sorted(got)] == [r[:3] for r in sorted(brute(docs, items, size))]
