import math

import numpy as np
import pytest

from inkfold.llm import cover_tree, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, payload string"


def plain(rows):
    good = {}
    for i, e, y, *_ in rows:
        if i is None or y is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        r = (y, [math.floor(256 * float(np.float32(x))) for x in e])
        good[i] = min(good.get(i, r), r)
    out = []
    for a, (own, q) in good.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, e, strict=True)), i, y) for i, (y, e) in good.items() if i != a and len(e) == len(q))
        for s, p, _ in [r for r in scored if r[2] == own][:5]:
            fit = [(-t, i) for t, i, y in scored if y != own and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit[:10])]
    return sorted(out)


def vectors(n, dim, seed, kinds=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim))
    return [(i, (centres[i % kinds] * rng.uniform(0.2, 1.5) + rng.normal(size=dim) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 3)), 1, "x") for i in range(n)]


@pytest.mark.parametrize(("block", "group", "pack"), [(2048, 1 << 15, 2048), (40, 3, 2)])
def test_against_plain_loops(spark, block, group, pack, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "PACK", pack)
    rows = vectors(900, 6, 1)
    rows += [(2000 + i, rows[3][1], i % 2, 1, "x") for i in range(60)]  # ties
    rows += [rows[5], rows[5], (5, rows[6][1], 0, 1, "x")]  # repeated rows and ids
    rows += [(None, rows[0][1], 1, 1, "x"), (3000, None, 1, 1, "x"), (3100, rows[0][1], None, 1, "x"), (3200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, "x"), (3300, [math.nan] * 6, 1, 1, "x"), (3400, [math.inf] * 6, 1, 1, "x")]
    rows += [(4000, [1.0, 2.0], 1, 1, "x"), (4001, [1.0, 1.0], 1, 1, "x"), (4002, [0.5, 0.5], 2, 1, "x"), (4100, [], 1, 1, "x"), (4101, [], 1, 1, "x"), (4102, [], 2, 1, "x"), (4200, [0.0] * 6, 1, 1, "x")]
    got = sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain(rows)
    assert {r[0] for r in got} >= {0, 100, 4000, 4100} and len(got) > 200


def test_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(100, [1.0], 1, 1, "x")], SCHEMA)).collect() == []


def test_tree_covers_and_skips():
    rng = np.random.default_rng(2)
    x = np.floor(np.concatenate([rng.normal(size=(300, 5)) * 3 + c for c in rng.normal(size=(6, 5)) * 300]))
    tree = cover_tree.build(x, np.arange(len(x)), np.zeros(len(x), np.int64))
    assert sorted(np.concatenate(tree.own).tolist()) == list(range(len(x)))  # every vector once
    extra = np.sqrt(tree.longest - (x * x).sum(axis=1))
    full = np.c_[x, extra]

    def below(node):
        return np.concatenate([tree.own[node], *[below(k) for k in tree.children[node]]])

    for node, c in enumerate(tree.centre):
        assert np.linalg.norm(full[below(node)] - full[c], axis=1).max() <= tree.radius[node] + 1e-3
        assert all(tree.radius[k] <= tree.radius[node] / 2 + 1e-3 for k in tree.children[node])
    q = x[:3]
    top = cover_tree.Top(np.full((3, 1), -np.inf), np.full((3, 1), np.inf), 4)
    seen = cover_tree.search(tree, q, (q * q).sum(axis=1), top, lambda rows, ids, _: rows != ids)
    score = q @ x.T
    score[np.arange(3), np.arange(3)] = -np.inf
    assert (top.score[:, 0] == -np.sort(-score, axis=1)[:, :4]).all()
    assert seen < 0.5 * score.size  # nodes outside were skipped
