"""Notes to pages, block rewriting, frontmatter."""


from inkfold.operators import pages as P


def notes(spark, *mds):
    return spark.createDataFrame([(str(i), f"d/n{i}", f"n{i}", m) for i, m in enumerate(mds)], "note_id string, path string, name string, md string")


CASES = [
    ("- [ ] ![[image.jpg]]\n> [!ocr]\n> line 1\n> line 2\n", [("image.jpg", "line 1\nline 2")]),
    ("> [!ocr]\n> some text\n", []),
    ("![[a.jpg]]\n> [!ocr]\n> t1\n> [!memo]\n> memo\n![[b.jpg]]\n> [!OCR]\n> t2\n", [("a.jpg", "t1"), ("b.jpg", "t2")]),
    ("![[a.jpg]]\n> [!ocr]\n> inside\n\n> outside\n", [("a.jpg", "inside")]),
    ("![[p1]]\n> [!ocr]\n> one\n\n![[p2]]\n![[x/p3|w]]\n\n> [!ocr]\n> three", [("p1", "one"), ("p2", ""), ("x/p3", "three")]),
    ("![[a.jpg]]\n> [!ocr]\nplain 1\n\n# head\n## page-2.jpg\nlost\n![[b.jpg]]", [("a.jpg", "plain 1\nhead"), ("b.jpg", "")]),
    ("![[a.jpg]]\ntext\n> [!ocr]\n> no", [("a.jpg", "")]),
    ("", []),
]


def test_ocr_pages(spark):
    rows = P.ocr_pages(notes(spark, *[c[0] for c in CASES])).orderBy("note_id", "page").collect()
    got = {}
    for r in rows:
        got.setdefault(int(r.note_id), []).append((r.image_link, r.ocr_text))
        assert r.page == len(got[int(r.note_id)])
        assert r.image_name == r.image_link.split("/")[-1]
    for i, (_, want) in enumerate(CASES):
        assert got.get(i, []) == want, i


def test_ocr_text(spark):
    md = ["[!ocr] head\n> a\n> b\n\n> c", "> [!OCR]\n> x\n> [!note]\n> y\n> [!ocr] z\n> w\nplain\n> v", "none"]
    got = [r.ocr_text for r in P.ocr_text(notes(spark, *md)).orderBy("note_id").collect()]
    assert got == ["head\na\nb", "x\nz\nw", ""]


def test_clean_text_falls_back(spark):
    df = spark.createDataFrame([("a  \n b　\n\n",), ("> [!ocr]\n> q  ",)], "ocr_text string")
    assert [r.clean_text for r in P.clean_text(df).collect()] == ["a\n b", "q"]


def test_line_table(spark):
    df = spark.createDataFrame([("n", 1, "ab\n\n𠮷c\n")], "note_id string, page int, ocr_text string")
    got = [(r.line_no, r.line_start, r.line) for r in P.line_table(df).orderBy("line_no").collect()]
    assert got == [(0, 0, "ab"), (1, 3, ""), (2, 4, "𠮷c"), (3, 7, "")]


def test_coverage(spark):
    df = spark.createDataFrame([("n", 1, "a.jpg", "x"), ("n", 2, "b.jpg", " 　"), ("n", 3, "", None)],
                               "note_id string, page int, image_name string, ocr_text string")
    r = P.ocr_coverage(df).first()
    assert (r.n_pages, r.n_with_ocr) == (3, 1)
    assert [x.page for x in P.pages_missing_ocr(df).collect()] == [2]


MD = "top\n![[a.jpg]]\n> [!ocr]\n> 1\n> 2\n> 3\n\n![[b.jpg]]\n> [!ocr]\n> 4\nend"


def test_embed_corrected(spark):
    n = notes(spark, MD, "no block", MD)
    t = spark.createDataFrame([("0", "A\nB\nC\nD\nE"), ("1", "x")], "note_id string, text string")
    got = {r.note_id: r.md for r in P.embed_corrected(n, t).collect()}
    # 3 of 4 old lines: round(3/4*5)=round(3.75)=4
    assert got["0"] == "top\n![[a.jpg]]\n> [!ocr]\n> A\n> B\n> C\n> D\n\n![[b.jpg]]\n> [!ocr]\n> E\nend"
    assert got["1"] == "no block" and got["2"] == MD


def test_embed_pages_and_upsert(spark):
    n = notes(spark, MD)
    t = spark.createDataFrame([("0", 2, "X\nY")], "note_id string, page int, text string")
    assert P.embed_corrected_pages(n, t).first().md == "top\n![[a.jpg]]\n> [!ocr]\n> 1\n> 2\n> 3\n\n![[b.jpg]]\n> [!ocr]\n> X\n> Y\nend"
    n2 = notes(spark, "![[a.jpg]]\n\n> [!OCR]\n> 1\n\n![[b.jpg]]\nend")
    t2 = spark.createDataFrame([("0", 1, "N"), ("0", 2, "M")], "note_id string, page int, text string")
    assert P.upsert_ocr(n2, t2).first().md == "![[a.jpg]]\n\n> [!ocr]\n> N\n\n![[b.jpg]]\n> [!ocr]\n> M\nend"
    bad = spark.createDataFrame([("0", 3, "N")], "note_id string, page int, text string")
    assert P.upsert_ocr(n2, bad).first().md == n2.first().md
    assert [tuple(r) for r in P.rejected_pages(n2, bad).collect()] == [("0", 3, "page out of range")]
    assert P.rejected_pages(n2, t2).collect() == []


def test_set_frontmatter(spark):
    n = notes(spark, "body", "---\na: 1\nab: 2\n---\nbody", "---\nx: 1\n---\nbody\na: 5")
    got = [r.md for r in P.set_frontmatter(n, "a", "v").orderBy("note_id").collect()]
    assert got == ["---\na: v\n---\nbody", "---\na: v\nab: 2\n---\nbody", "---\nx: 1\na: v\n\n---\nbody\na: 5"]
    open_note = notes(spark, "---\na: 1")
    assert P.set_frontmatter(open_note, "a", "v").first().md == "---\na: 1"
    assert P.unclosed_frontmatter(open_note).first().reason == "frontmatter not closed"
    assert P.unclosed_frontmatter(n).collect() == []


def test_merge_body(spark):
    s = notes(spark, "---\nk: new\n---\nold body", "no fm")
    i = notes(spark, "---\nk: old\n---\nnew body", "---\nz: 1\n---\nb")
    got = [r.md for r in P.merge_body(s, i).orderBy("note_id").collect()]
    assert got == ["---\nk: new\n---\nnew body", "---\nz: 1\n---\nb"]
