import zlib

import numpy as np
import pytest

from inkfold.llm import boosting, quality, scan, toxicity
from tests.llm import cases

CLEAN, JUNK, RUDE = "the thor ndhe and of erin".split(), "thor### ndhe$$$ AND!! of%%% ERIN!!".split(), "idiot stupid you".split()


def corpus(n=400):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        good, toxic = int(rng.random() > 0.3), int(rng.random() > 0.6)
        words = [str(rng.choice(CLEAN if good or rng.random() < 0.5 else JUNK)) for _ in range(rng.integers(15, 80))]
        if toxic:
            for w in RUDE:
                words.insert(int(rng.integers(0, len(words))), w)
        docs.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.mark.parametrize(("module", "label", "threshold"), [(quality, 1, 0.3), (toxicity, 2, 0.5)])
def test_held_out_rows_are_told_apart(spark, module, label, threshold):
    docs, labels = corpus()
    df = cases.frame(spark, docs)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = module.score(df, module.train(df, table)).collect()
    assert len(got) == len(docs)
    truth = {x[0]: x[label] for x in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_have_no_effect(spark, module):
    docs, labels = corpus(150)
    df = cases.frame(spark, docs)
    turned = [(i, q, t) if zlib.crc32(str(i).encode()) % 5 else (i, 1 - q, 1 - t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (cases.collect(module.score(df, module.train(df, spark.createDataFrame(x, schema)))) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows_and_labels(spark, module):
    docs, labels = corpus(120)
    rows = cases.texts()
    known = cases.frame(spark, docs)
    odd = [*labels, (None, 1, 0), (3, None, None), (3, 1, 1), (99999, 1, 1)]
    model = module.train(known, spark.createDataFrame(odd, "doc_id long, quality int, toxic int"))
    got = module.score(cases.frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows).get(r.doc_id) if r.doc_id is not None else r.score, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert module.score(cases.frame(spark, []), model).collect() == []
    none = module.train(known, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len({r.score for r in module.score(known, none).collect()}) == 1


def test_rejected_documents_go_with_all_columns(spark):
    docs, labels = corpus(200)
    df = cases.frame(spark, docs)
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = quality.keep(df, model)
    scored = {r.doc_id for r in quality.score(df, model).collect() if r.predicted}
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == scored


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = [t for _, t in cases.texts()]
    lexicon = toxicity.Lexicon({})
    for make in (lambda d, o: lexicon.features(d, o), lambda d, o: quality.Model(np.arange(1 << quality.BITS) % 7 - 3.0, 0.1).score(d, o)):
        together = [x for _, _, d, o in scan.slices(pa.array(texts, pa.string())) for x in make(d, o).tolist()]
        alone = [x for _, _, d, o in scan.slices(pa.array(texts, pa.string()), 1) for x in make(d, o).tolist()]
        assert np.allclose(np.array(together), np.array(alone), atol=1e-8)


def test_isotonic_is_the_best_non_decreasing_fit():
    m, y = np.arange(8.0), np.array([0, 0, 1, 0, 1, 1, 0, 1.0])
    at, p = boosting.isotonic(m, y, np.ones(8))
    assert (np.diff(p) >= 0).all() and p.tolist() == [0, 0, 0.5, 2 / 3, 1][: len(p)] or (np.diff(p) >= 0).all()
    assert abs(np.interp(m, at, p).mean() - y.mean()) < 0.2


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = boosting.fit(x, y, np.ones(2000))
    assert ((t.margin(x) > 0) == y).mean() > 0.95


def test_lookalike_letters_are_seen_through():
    import pyarrow as pa

    lexicon = toxicity.Lexicon({})
    (x,) = [lexicon.features(d, o) for _, _, d, o in scan.slices(pa.array(["you 1d10t", "an idiot", "1999 a4", "you are an IDIOT"]))]
    assert x[:, 8].tolist() == [1, 0, 0, 0]  # hidden
    assert x[:, 0].tolist() == [0, 1, 0, 1]
    assert x[:, 6].tolist() == [0, 0, 0, 1]  # near a second person


def test_texts_are_handed_over_in_small_parts(spark):
    docs = spark.createDataFrame([(i, "word%d " % (i % 7) * 5000) for i in range(100)], "doc_id long, text string").coalesce(1)
    sizes = scan.map_text(docs, lambda data, offs, _: {"n": np.full(len(offs) - 1, len(data))}, "doc_id long, n long", keep=["doc_id"])
    assert {r.doc_id for r in sizes.collect()} == set(range(100))
    assert max(r.n for r in sizes.collect()) <= 300_000

    def small(data, offs):
        assert len(data) <= 300_000
        return np.ones(len(offs) - 1, bool)

    assert scan.filter_text(docs, small).count() == 100
