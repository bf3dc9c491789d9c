import hashlib

import numpy as np
import pyarrow as pa

from inkfold.llm import imatch, scan
from tests.llm import cases


def test_order_edits_and_equal_texts(spark):
    rows = [r for r in cases.texts() if r[0] is not None]
    got = {r.doc_id: r for r in imatch.fingerprints(cases.frame(spark, rows), 1 / 50, 1 / 2).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == after:
            assert r.near_next == 1.0
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
    by_text = {}
    for i, text in rows:
        by_text.setdefault(text or "", set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_null_ids_repeats_one_row_and_none(spark):
    rows = cases.texts() + [(3, cases.texts()[3][1]), (3, "another text of the same id")]
    assert len(imatch.fingerprints(cases.frame(spark, rows)).collect()) == len(rows)
    (one,) = imatch.fingerprints(cases.frame(spark, [(1, "only the thor")])).collect()
    assert one.near_next == 1.0 and one.n_chars == 13
    assert imatch.fingerprints(cases.frame(spark, [])).collect() == []
    assert len(imatch.fingerprints(cases.frame(spark, [(None, "a b"), (None, None)])).collect()) == 2


def test_likeness_follows_the_edits():
    words = [f"w{i}" for i in range(4000)]
    rng = np.random.default_rng(1)
    prints = imatch.Fingerprinter(np.unique(scan.run_hashes(np.frombuffer(" ".join(words).encode(), np.uint8), *scan.runs(scan.ALNUM[np.frombuffer(" ".join(words).encode(), np.uint8)], np.array([0, len(" ".join(words))])), scan.LOWER_VALUE)))
    text = [str(x) for x in rng.choice(words, 300, replace=False)]
    last = 1.0
    for part in (0, 0.05, 0.2, 0.4, 1):
        k = int(300 * part)
        other = [*text[k:], *[str(x) for x in rng.choice(words, k)]]
        fp = [prints(d, o) for _, _, d, o in scan.slices(pa.array([" ".join(text), " ".join(other)]))][0]
        now = float(imatch.likeness(fp[:1], fp[1:])[0])
        assert now <= last + 0.15
        last = now
    assert last < 0.2


def test_the_order_of_words_does_not_matter():
    prints = imatch.Fingerprinter(np.sort(scan.run_hashes(np.frombuffer(b"aabbcc", np.uint8), np.array([0, 2, 4]), np.array([2, 4, 6]))))
    fp = [prints(d, o) for _, _, d, o in scan.slices(pa.array(["aa bb cc", "CC, bb aa zz", "bb"]))][0]
    assert (fp[0] == fp[1]).all() and not (fp[0] == fp[2]).all()
