"""The analysis end to end on one note, and the in-row positions against the row operators."""

import random

from pyspark.sql import functions as F

from inkfold.operators import detectors as D
from inkfold.operators import matching as M
from inkfold.plans import analyze as A
from inkfold.plans import review as R
from inkfold.sources import dictionaries as SD

from .test_candidates import term, terms

MD = (
    "---\nregion: 尾張\nplaintiff: 美濃国厚見郡且嶋村\nperson: '[[田中次郎]]'\n---\n本文 [[山田太郎]] の件\n![[a.jpg]]\n> [!ocr]\n"
    "> 愛知ノ山論ハ村ニ尾張ノ人ヲ裁ニ付申立候村ト人ヘ山ハ村ニ人ヲ。。。証b書\n"
    "> 入會山ハ村ニ申立レ共伊勢ノ山諍ニ尾張ノ村ヲ人ハ山ニ村ヲ申立レ\n> 美濃国厚見郡且嶋\n> 村ヘ係ル山わり村より人に山\n> 一〇、〇〇、一一、〇一\n"
)
NOUNS = [
    ("core", None, [{"term": "入会権", "aliases": ["入会"], "weight": 1.3}]), ("prefectures", None, [{"term": "伊勢", "weight": 1.2}]),
    ("regional", "aichi", [{"term": "三河", "aliases": ["三州"], "weight": 1.3}]),
]


def config(spark):
    return A.AnalyzeConfig(
        terms=terms(spark, term("入会", variants=["入會"], priority=1.0, protect=True), term("山論", priority=0.9, protect=True), term("山諍", "山訴", priority=0.9, tier="experimental")),
        shape_pairs=SD.shape_pairs_from(spark, [{"wrong": "山諍", "correct": ["山論"], "score": 60.0}]), proper_nouns=SD.proper_nouns_from(spark, NOUNS),
    )


def test_analyze_and_events(spark):
    notes = spark.createDataFrame([("n1", "n1", MD)], "note_id string, name string, md string")
    cfg = config(spark)
    spans = A.analyze(notes, cfg).persist()
    rows = {r.suspect_span: r for r in spans.collect()}
    text = A.page_profile(notes, cfg).first().clean_text
    assert all(text[r.start : r.end] == s for s, r in rows.items())
    want = {
        "山論": ["山論"], "申立候": ["申立候"], "。。。": ["三河", "入会権", "入会", "伊勢", "三州"], "b": ["b"], "入會": ["入會", "入会"],
        "申立レ共": ["申立候共", "申立レ共"], "山諍": ["山訴", "山論"], "申立レ": ["申立候", "申立レ"], "美濃国厚見郡且嶋": ["美濃国厚見郡且嶋村"],
        "わり": ["ワリ", "わり", "ヨリ"], "より": ["ヨリ", "より"], "に": ["ニ", "に"], "一〇、〇〇、一一、〇一": [""],
    }
    assert {s: r.candidates for s, r in rows.items()} == want
    assert rows["わり"].soft_hints == {"ヨリ": "manual_override_seed"} and rows["わり"].is_bigram_suspect
    assert rows["。。。"].is_dangerous and not rows["山諍"].is_dangerous
    assert rows["山諍"].rank1_from_experimental_dict and rows["美濃国厚見郡且嶋"].rank1_from_frontmatter
    assert rows["申立レ"].validation.verdict == "reject" and rows["申立レ共"].validation.verdict == "review"
    assert rows["一〇、〇〇、一一、〇一"].validation.verdict == "reject" and rows["山論"].region == "愛知"
    ev = A.proper_noun_events(spans, cfg.proper_nouns).collect()
    assert {e.suspect_span for e in ev} == {"。。。", "入會"}
    dots = next(e for e in ev if e.suspect_span == "。。。")
    assert dots.proper_noun_candidates == want["。。。"] and dots.rank1_is_proper_noun


def test_incremental_analysis_with_changes_and_deletions(spark, tmp):
    from inkfold.streaming import jobs

    schema = "note_id string, name string, md string, ord long"
    cfg = config(spark)
    other = MD.replace("申立レ共", "申立候").replace("三河", "伊勢")
    batches = [
        [("n1", "n1", MD, 1), ("n2", "n2", MD, 1), ("n3", "n3", other, 1)],
        [("n1", "n1", MD, 2), ("n2", "n2", MD, 2), ("n2", "n2", other, 3)],  # one unchanged, one changed twice
        [("n3", "n3", None, 4), ("n4", "n4", MD, 4)],
    ]
    counts = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp}/in/b{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp}/in")
        jobs.analyze_stream(stream, cfg, f"{tmp}/out", f"{tmp}/ck").awaitTermination()
        counts.append(spark.read.parquet(f"{tmp}/out/notes/batch={k}").count())
    assert counts == [3, 1, 2]  # what came again unchanged was not analyzed again
    final = spark.createDataFrame([("n1", "n1", MD), ("n2", "n2", other), ("n4", "n4", MD)], "note_id string, name string, md string")
    key = lambda df: sorted((r.note_id, r.page, r.start, r.suspect_span, tuple(r.candidates)) for r in df.collect())
    assert key(jobs.current_spans(spark, f"{tmp}/out")) == key(A.analyze(final, cfg))


def test_visible_starts_match_row_operators(spark):
    rnd = random.Random(3)
    rows = [(i, 1, "".join(rnd.choice("あいう。") for _ in range(40))) for i in range(12)]
    texts = ["あ", "あい", "ああ", "あいう", "。。", "。。。", "いあい"]
    df = spark.createDataFrame(rows, "note_id int, page int, clean_text string")
    found = F.array(*[D._finding(F.lit(t), "", 1.0, "x", "x") for t in texts])
    inrow = df.select("note_id", F.explode(M.visible_starts_col(F.col("clean_text"), found)).alias("x")).select(
        "note_id", F.col("x.f.suspect_span").alias("s"), F.posexplode("x.starts").alias("i", "start"))
    spans = df.select("note_id", "page", F.explode(F.array(*[F.lit(t) for t in texts])).alias("suspect_span"))
    occ = M.occurrences(spans, df)
    a = sorted((r.note_id, r.s, r.i, r.start) for r in inrow.collect())
    b = sorted((r.note_id, r.suspect_span, r.occurrence_index, r.start) for r in occ.collect())
    # and both against a plain loop
    want = []
    for i, _, text in rows:
        longest = {}
        for t in texts:
            p = 0
            while (k := text.find(t, p)) != -1:
                longest[k] = max(longest.get(k, 0), len(t))
                p = k + len(t)
        for t in texts:
            p = n = 0
            while (k := text.find(t, p)) != -1:
                if longest.get(k, 0) > len(t):
                    p = k + 1
                    continue
                want.append((i, t, n, k))
                n, p = n + 1, k + len(t)
    assert a == b == sorted(want)


def test_replay(spark):
    notes = spark.createDataFrame([("n1", "n1", MD)], "note_id string, name string, md string")
    cols = ("doc_id string, page int, save_page int, span_id string, occurrence_index int, suspect_span string, selected_candidate string, correction_mode string, ord int")
    rows = spark.createDataFrame([
        ("n1", 1, 1, "a", 0, "申立レ", "古", "single", 0), ("n1", 1, 1, "a", 0, "申立レ", "申立候", "single", 1),
        ("n1", 1, 1, "b", 5, "申立レ", "無", "single", 2), ("n1", 1, 1, "c", 0, "申立レ共", "", "single", 3), ("n1", 1, 1, "", 0, "b", None, "single", 4),
    ], cols)
    r = R.replay_corrections(notes, rows, A.AnalyzeConfig(use_body=False)).first()
    assert r.n_applied == 2 and "村ヲ申立候\n" in r.new_text and "申立レ共" not in r.new_text and "村ニ伊勢" in r.new_text


def test_evaluation_ends_frontmatter_at_any_fence(spark):
    df = spark.createDataFrame([("n", "---\nregion: 尾張\ncourt: a---b\n---\n本文", "x")], "note_id string, md string, name string")
    courts = {}
    for fence in ("line", "any"):
        fm = A.page_profile(df, A.AnalyzeConfig(unit="note", fence=fence)).first().fm
        courts[fence] = [e["value"] for e in fm if e["key"] == "court"]
    assert courts == {"line": ["a---b"], "any": ["a"]}
