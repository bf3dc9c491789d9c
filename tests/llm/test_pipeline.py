import corpus_pipeline
from inkfold.llm import decontaminate, line_dedup, packing, quality, units
from inkfold.llm.queries import ORACLES, QUERIES
from tests.llm import test_decontaminate, test_duplicates, test_shingles

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_stages_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = test_duplicates.deduped(rows)
    rows = test_shingles.plain_kept(rows)
    rows = [(i, t) for (i, t), r in zip(sorted(rows), sorted(test_decontaminate.brute(rows, items, 10)), strict=True) if not r[5]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        if k < 4:
            assert docs.columns == columns
    got = docs.collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    texts = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), units.tokenizer_path("word_bpe_49k.json"), 1, 4096).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, texts))
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in texts})
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert decontaminate.WORD and line_dedup.LEAST == 2


#: Names that stages use inside; a column of such a name goes through unchanged.
INNER = ["_h", "_n_lines", "_n_removed", "_hit", "_items", "_text", "block", "row", "payload", "found", "node", "chunk", "rows", "hash", "label"]


def clashing(spark, rows):
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in INNER)
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), *[f"{c}{i}" for c in INNER]) for i, t in rows], fields)


def test_stages_on_awkward_tables(spark):
    rows = [(1, "a b c d e f\ng h\ni j"), (2, "a b c d e f\ng h\ni j"), (3, None), (4, ""), (None, "x"), (5, "good text " * 40), (5, "good text " * 40)]
    for given in (rows, []):
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = clashing(spark, given)
            got = stage(spark, docs, SMALL)
            assert got.columns == docs.columns
            known = {tuple(r)[:1] + tuple(r)[5:] for r in docs.collect()}
            assert {tuple(r)[:1] + tuple(r)[5:] for r in got.collect()} <= known
        got = corpus_pipeline.STAGES[4][1](spark, clashing(spark, given), SMALL).collect()
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and (len(got) >= 7) == bool(given)
