import random
import re
import time

import __spark_entry__ as E
from driver import candidate_queries as Q
from inkfold.operators import matching as M

SMALL = "/root/testdata/sf0.001"


def runs_by_loop(text):
    """Starts of the visible symbol runs of a text: a longer run that starts at a place hides the others there."""
    spans = set(re.findall("[！？。、…・]{3,}", text))
    greedy = {(m.start(), s) for s in spans for m in re.finditer(re.escape(s), text)}
    longest = {}
    for at, s in greedy:
        longest[at] = max(longest.get(at, 0), len(s))
    seen = []
    for s in spans:
        at = text.find(s)
        while at >= 0:
            hidden = longest.get(at, 0) > len(s)
            if not hidden:
                seen.append((at, s))
            at = text.find(s, at + (1 if hidden else len(s)))
    return seen


def test_a_page_with_ten_thousand_spans():
    rng = random.Random(1)
    text = "".join(rng.choice("申立候レルテ共仕地村論会人裁判") for _ in range(60_000))
    names = list({text[a : a + n] for a, n in ((rng.randint(0, 59_000), rng.randint(1, 30)) for _ in range(12_000))})
    assert len(names) > 9_000
    began = time.time()
    got = M.visible_starts(text, names, [False] * len(names), [False] * len(names))
    assert time.time() - began < 10
    longest = {}
    for name, starts in zip(names, got, strict=True):
        assert all(text.startswith(name, s) for s in starts.tolist())
        for s in [] if M._bordered(name) else starts.tolist():
            assert longest.setdefault(s, len(name)) == len(name)  # one visible text a place
    assert len(longest) > 10_000


def test_a_forced_letter_inside_a_bigram_is_hidden():
    got = M.visible_starts("山に村山に", ["に", "山に", "山"], [True, False, False], [False, True, False])
    assert [g.tolist() for g in got] == [[], [0, 3], []]
    assert [g.tolist() for g in M.visible_starts("ああああ", ["ああ", "あああ"], [False] * 2, [False] * 2)] == [[1], [0]]


def test_entry_counts_symbol_runs(spark):
    found = {}
    for r in Q.span_counts(spark, SMALL).collect():
        found.setdefault(r.note_id, {})[r.suspect_span] = (r.n, r.first_start)
    got = {r.note_id: r for r in E.entry(spark).collect()}
    pages = Q.span_pages(spark, SMALL).collect()
    assert len(got) == len(pages)
    for p in pages:
        runs, w, g = runs_by_loop(p.text), found[p.note_id], got[p.note_id]
        assert runs
        assert {s: v for s, v in w.items() if s[0] in "！？。、…・"} == {s: (sum(t == s for _, t in runs), min(a for a, t in runs if t == s)) for s in {s for _, s in runs}}
        assert (g.n_spans, g.n_texts) == (sum(n for n, _ in w.values()), len(w))


def test_first_of_equal_texts_counts():
    """Reports need not be told apart before: of equal texts the first has the starts, later and empty ones none."""
    got = M.visible_starts("山に村山に", ["山", "", "山に", "山", "村", "山に"], [False] * 6, [False] * 6)
    assert [g.tolist() for g in got] == [[], [], [0, 3], [], [2], []]


def test_arrays_are_computed_once(spark):
    """An inner explode is filtered on its array's size, which computes the array again before the rows are dealt out."""
    from driver import inputs as I

    plan = I.words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
