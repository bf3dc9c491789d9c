"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

WORDS = "the of Th thor ndhe éreau über Oneaea and, on. idiot to ### x".split()


def texts(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = say(45)
    lines = "\n".join(say(6) for _ in range(12))
    out = [(i, say(rng.randint(1, 90))) for i in range(n)]
    out += [(n + i, f"{say(5)} {passage} {say(4)}") for i in range(5)]
    out += [(n + 10 + i, f"{say(3)}\n{lines}\n{say(3)}") for i in range(4)]
    out += [(n + 20, lines), (n + 21, lines), (n + 22, ""), (n + 23, None), (n + 24, "  \n\t "), (n + 25, "\n\n"), (None, say(20)), (None, None)]
    out += [(n + 30, say(9000)), (n + 31, "a" * 3000), (n + 32, "日本語 テキスト ́ ̧x"), (n + 33, "no"), (n + 34, "no")]
    return out


def frame(spark, rows, extra: bool = True):
    """(doc_id, text), with columns whose names operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    full = [(i, t, "en" if (i or 0) % 2 else None, None, len(t) if t else None, -1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp long, chunk string")


def collect(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
