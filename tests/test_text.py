"""Text functions against plain Python."""

import random
import re

from pyspark.sql import functions as F

from inkfold import constants as K
from inkfold.functions import text as T
from inkfold.operators import particles as PT


def py_find(text, lit, overlap):
    out, p = [], 0
    while (i := text.find(lit, p)) != -1:
        out.append(i)
        p = i + (1 if overlap else len(lit))
    return out


def test_positions(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("aab𠮷.(") for _ in range(30)), lit) for lit in ("a", "aa", "aba", "𠮷", ".", "(", "zz") for _ in range(6)]
    df = spark.createDataFrame(rows, "t string, l string")
    t, l = F.col("t"), F.col("l")
    got = df.select("t", "l", T.find_all(t, l).alias("g"), T.find_overlapping(t, l).alias("o"), T.count_literal(t, l).alias("n"),
                    T.greedy_starts(T.find_overlapping(t, l), F.char_length(l)).alias("gg")).collect()
    for r in got:
        assert r.g == py_find(r.t, r.l, False) == r.gg and r.n == len(r.g)
        assert r.o == py_find(r.t, r.l, True)


def test_scalars(spark):
    one = spark.range(1)

    def v(c):
        return one.select(c.alias("x")).first().x

    assert v(T.splice(F.lit("abcdef"), F.expr("array(named_struct('start',1,'end',2,'new','XY'),named_struct('start',4,'end',6,'new',''))"))) == "aXYcd"
    assert v(T.split_lines(F.lit("a\r\nb \n"))) == ["a", "b", ""] and v(T.split_lines(F.lit(""))) == []
    assert v(T.normalize_variants(F.lit(" a;b,a ;;c d"))) == "a;b;c d"
    assert v(T.parse_bool(F.lit(" Y "))) is True and v(T.parse_bool(F.lit("no"), True)) is False and v(T.parse_bool(F.lit("?"))) is False
    assert v(T.parse_float(F.lit("x"), 0.6)) == 0.6 and v(T.parse_float(F.lit(" 1.5 "))) == 1.5
    for text, want in (("abc", "ascii"), ("山村", "kanji"), ("ー・ｱ", "kana"), ("々々", "mixed"), ("山に", "mixed"), ("𠮷", "kanji")):
        assert v(T.dominant_script(F.lit(text))) == want, text
    assert v(T.strip_wikilink(F.lit("[[path/👤名前]] [[p|表示]] [[近世法制史#検地]]"))) == "名前 表示 近世法制史"
    assert v(T.strip_emoji(F.lit("👤山☀"))) == "山"
    assert v(T.safe_export_name(F.lit('a/b:c*"d'))) == "a_b_c__d"
    assert v(T.kana_label(F.lit("山に"))) == "ひらがな" and v(T.kana_label(F.lit("ニに"))) is None
    assert v(T.nfc(F.lit("が"))) == "が"
    for token in ("https://x", "123", "1868-03", "abc_1", "山", "長" * 21):
        assert v(T.is_noise_token(F.lit(token))) is True, token
    assert v(T.is_noise_token(F.lit("田中次郎"))) is False


def test_no_particle_hit_lies_in_a_phrase(spark):
    """The exclusion list can never touch a hit; shown on random text by the general operators."""
    rnd = random.Random(2)
    parts = [*K.PARTICLE_PHRASES, "山", "ノ", "に", "を", "は", "て", "\n"]
    rows = [(i, 1, "".join(rnd.choice(parts) for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "note_id int, page int, clean_text string")
    hits = PT.particle_hits(df)
    assert hits.count() > 0
    assert PT.drop_positions(hits, PT.phrase_positions(df)).count() == hits.count()
    kk = re.compile(f"(?<=[{K.KANJI_KATA}])[にをは](?=[{K.KANJI_KATA}])")
    want = sorted((i, m.start()) for i, _, t in rows for m in kk.finditer(t))
    assert sorted((r.note_id, r.start) for r in hits.collect()) == want


def test_matches_with_what_stands_around(spark):
    df = spark.createDataFrame([("人に会に社",), ("",), (None,)], "t string")
    found = df.select(T.matches(F.col("t"), "(?<=[人会])に", width=2).alias("m")).collect()
    assert [tuple(x) for x in found[0].m] == [(1, "に", "人", "会に"), (3, "に", "に会", "社")]
    assert found[1].m == [] and found[2].m == []
