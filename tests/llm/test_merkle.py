import hashlib
import zlib

import pytest

from inkfold.llm import merkle
from tests.llm import cases


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and, for each node, its (left, right) siblings level by level."""
    level, at = list(nodes), list(range(len(nodes)))
    paths = [[] for _ in nodes]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    say = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, s, n: h(*map(say, (i, s, lang, n, t)))
    if not rows:
        return []
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        made[s] = tree([leaf(*r) for r in by_source[s]])
    root, tops = tree([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(by_source[s], made[s][1], strict=True):
            node = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                node = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for a, b in path + top:
                node = h(a, node, b)
            out.append((r[0], leaf(*r), made[s][0], root, h(*[a + b for a, b in path + top]), node, node == root))
    return sorted(out, key=repr)


def sourced(rows, sources):
    return [(i, t, "en" if (i or 0) % 3 else None, sources[k % len(sources)], len(t) if t else None) for k, (i, t) in enumerate(rows)]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int")
    return cases.collect(merkle.manifest(docs))


@pytest.mark.parametrize("levels", [7, 1, 2])
def test_against_plain_trees(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # blocks of 3: several storeys of blocks
    rows = sourced(cases.texts(), ["b", None, "a", "b", "b", "é", "", "b", "b"])
    rows += [rows[3], rows[3], (5000, "x", "en", "lone", 1)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 4, 28])
def test_small_trees(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, "a\nb", "en", "s", 3) for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_many_sources_are_a_tree_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, "a\nb", "en", f"s{i % 30}", 3) for i in range(70)]
    assert run(spark, rows) == plain(rows)


def test_a_partial_witness_is_extended_by_later_siblings():
    made = merkle.Witnesses()
    for d in "abcd":
        made.append(d)
    assert made.paths == [[("", "bc")], [("a", "c")], [("ab", "")], []]
    assert merkle.fold("b", made.paths[1]) == made.open[1][0][0]
    top = made.finish(2)
    assert [merkle.fold(d, p) for d, p in zip("abcd", made.paths, strict=True)] == [top] * 4
    assert made.paths[3] == [("", ""), (made_of("abc"), "")]


def made_of(x):
    return merkle.digest(list(x))
