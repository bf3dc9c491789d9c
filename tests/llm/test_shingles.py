import random

import numpy as np
import pytest

import corpus_pipeline
from inkfold.llm import shingles, simhash
from tests.llm import cases, test_duplicates

SMALL = "/root/testdata/sf0.001"


def plain_set(text, size=5):
    w = test_duplicates.SPACED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_kept(rows, size=5, likeness=0.8):
    """The rows that stay, by a loop over all pairs; ``rows`` have no null id."""
    found = [plain_set(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            a, b = found[x], found[y]
            if a == b or len(a & b) / max(1, len(a | b)) >= likeness:
                p, q = group[x], group[y]
                group = [p if g == q else g for g in group]
    least = {}
    for row, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, row), row, key=lambda r: r[0])
    return sorted(least.values(), key=repr)


def near_copies(seed=3):
    """Texts with words replaced: likeness from below 0.8 to nearly 1."""
    rng = random.Random(seed)
    out = []
    for g in range(8):
        base = [f"g{g}w{k}" for k in range(120)]
        for c in range(6):
            text = list(base)
            for k in rng.sample(range(120), c):
                text[k] = f"x{g}{c}{k}"
            out.append((1000 + 10 * g + c, " ".join(text)))
    return out


@pytest.mark.parametrize(("tile", "room"), [(2048, 1 << 22), (4, 1 << 22), (2048, 300)])
def test_near_copies_go(spark, tile, room, monkeypatch):
    monkeypatch.setattr(shingles, "TILE", tile)
    monkeypatch.setattr(shingles, "ROOM", room)
    rows = [r for r in cases.texts() if r[0] is not None] + near_copies()
    got = simhash.keep_one(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == plain_kept(rows)
    assert len(got) < len(rows) - 20


def test_the_likeness_is_exact():
    # 8 shingles of 10, then 7 of 9 in common
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert shingles.alike(a, b, 0.8) and not shingles.alike(a[:8], b[:8], 0.8)


def test_the_stage_keeps_what_a_plain_loop_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == plain_kept(rows)


def test_rows_of_one_id_are_decided_one_by_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of seven words"), (7, "one text here"), (7, "other text there"), (7, "one text here")]
    got = simhash.keep_one(cases.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [rows[0], rows[2], rows[3], rows[4]]


# --- what is compared ------------------------------------------------------------------------
def test_distances_against_plain_counts():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, (150, shingles.LANES), dtype=np.uint64)
    for k in range(1, 150, 2):  # near ones, from a few bits to beyond the radius
        x[k] = x[k - 1]
        for b in rng.choice(64 * shingles.LANES, k, replace=False).tolist():
            x[k, b // 64] ^= np.uint64(1 << (b % 64))
    for radius in (0, 20, 203, 248):
        i, j, bits = shingles.within(x[:40], shingles.planes(x), 150, radius)
        want = {(a, b, d) for a in range(40) for b in range(150) if (d := int(np.bitwise_count(x[a] ^ x[b]).sum())) <= radius}
        assert set(zip(i.tolist(), j.tolist(), bits.tolist(), strict=True)) == want


@pytest.mark.parametrize("n", [4, 5, 8, 16, 60, 400])
def test_alike_sets_are_within_the_radius(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])  # 0.8 alike
        x, y = (np.frombuffer(shingles.print_of(np.unique(s)), "<u8") for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= shingles._radius(np.array(len(a)), np.array(len(b)))


def groups_of(n, pairs):
    group = list(range(n))
    for x, y in pairs:
        group = [group[x] if g == group[y] else g for g in group]
    return [group.index(g) for g in group]


@pytest.mark.parametrize("seed", range(12))
def test_links_span_every_graph(seed, monkeypatch):
    monkeypatch.setattr(shingles, "QUERIES", 1 + seed % 5)
    rng = np.random.default_rng(seed)
    n = 60
    linked = np.triu(rng.random((n, n)) < 0.004 * (seed + 1), 1)
    linked |= linked.T

    def met(some, others):
        return np.nonzero(linked[np.ix_(some, others)])

    got = shingles.spanning(n, met)
    assert groups_of(n, got) == groups_of(n, np.argwhere(linked).tolist())
    assert len(got) == n - len(set(groups_of(n, got)))  # a forest


def test_a_dense_group_costs_little():
    seen = 0

    def met(some, others):
        nonlocal seen
        seen += len(some) * len(others)
        return np.nonzero(np.ones((len(some), len(others)), bool))

    assert len(shingles.spanning(2000, met)) == 1999
    assert seen <= shingles.QUERIES * 2000


def moved(spark, rows):
    """How many texts are compared as sets."""
    found = shingles.sketch([np.unique(np.array([hash(s) & (1 << 63) - 1 for s in plain_set(t)], np.uint64)) for _, t in rows])
    distinct = spark.createDataFrame([(int(a), int(n), p.as_py(), k.as_py()) for a, n, p, k in zip(found["node"], found["n"], found["print"], found["bands"], strict=True)], "node long, n int, print binary, bands array<long>")
    pairs = [(r.a, r.b) for r in shingles.candidates(distinct).collect()]
    return len({x for p in pairs for x in p})


@pytest.mark.parametrize("n", [150, 450])
def test_boilerplate_and_chains_move_few_texts(spark, n):
    common = [f"c{k}" for k in range(200)]
    boiler = [(i, " ".join([f"o{i}w{k}" for k in range(70)] + common + [f"p{i}w{k}" for k in range(45)])) for i in range(n)]  # 0.47 alike, all of them
    assert moved(spark, boiler) < 0.05 * n
    chain = [(i, " ".join(f"w{k}" for k in range(32 * i, 32 * i + 100))) for i in range(n)]  # neighbours 0.5 alike
    assert moved(spark, chain) < 0.05 * n


def test_keys_and_texts_move_once(spark, monkeypatch):
    """Of tables of any size: buckets of the same nodes are met once, keys are shuffled once, and texts once behind their blocks."""
    handed, grouped = [], shingles._grouped
    monkeypatch.setattr(shingles, "_grouped", lambda rows, *a: handed.append(rows) or grouped(rows, *a))
    rng = random.Random(5)
    rows = []
    for g in range(40):  # pairs 0.9 alike share about 15 of 24 keys
        base = [f"g{g}w{k}" for k in range(200)]
        other = [*base]
        for k in rng.sample(range(200), 2):
            other[k] = f"x{g}{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simhash.keep_one(cases.frame(spark, rows)).collect()
        met, texts = handed
        assert met.count() == 80
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in handed]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 40
    assert plans[0].count("Generate posexplode(bands") == 1
    assert "Join" not in plans[1].split("MapInArrow")[0]


def test_own_names_as_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, 3, "x", True), (2, "a b c d e f", 1, 2, 3, "x", True), (3, "other", 1, 2, 3, "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h long, block long, node long, payload string, _hit boolean")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_empty_table(spark):
    assert simhash.keep_one(cases.frame(spark, [])).collect() == []
