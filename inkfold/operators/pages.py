"""Notes to pages: OCR block extraction, line tables, coverage, block rewriting.

The block rules depend on the line before, so each note's line array is folded in its row:
no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.rows import unfolded

_STRINGS = "array<string>"


def marked_lines(md: Column) -> Column:
    """Lines with everything the block rules ask about, each computed once."""
    return F.transform(
        T.split_lines(md),
        lambda l: F.struct(
            l.alias("raw"),
            T.strip(l).alias("s"),
            (F.contains(l, F.lit("![[")) & l.rlike(K.IMAGE_LINK)).alias("image"),
            F.regexp_extract(l, K.IMAGE_LINK, 1).alias("link"),
            (F.contains(l, F.lit("[!")) & l.rlike(K.OCR_MARK)).alias("mark"),
            (F.contains(l, F.lit("[!")) & l.rlike(K.OCR_HEADER)).alias("header"),
            (F.contains(l, F.lit("[!")) & l.rlike(K.ANY_CALLOUT)).alias("callout"),
        ),
    )


def _unquoted(s: Column) -> Column:
    return T.strip(F.substring(s, F.lit(2), F.char_length(s)))


def ocr_text_col(md: Column) -> Column:
    """All OCR blocks of a note as one text."""
    def merge(acc, l):
        rest = T.strip(F.regexp_replace(l["raw"], r"(?s)^[^\]]*\]", ""))
        opened = F.struct(
            F.lit(True).alias("inside"),
            F.when(rest != "", F.array_append(acc["out"], rest)).otherwise(acc["out"]).alias("out"),
        )
        closed = F.struct(F.lit(False).alias("inside"), acc["out"].alias("out"))
        more = F.struct(F.lit(True).alias("inside"), F.array_append(acc["out"], _unquoted(l["s"])).alias("out"))
        return (
            F.when(~acc["inside"], F.when(l["mark"], opened).otherwise(acc))
            .when(l["s"] == "", closed)
            .when(l["callout"], F.when(l["mark"], opened).otherwise(closed))
            .when(F.startswith(l["s"], F.lit(">")), more)
            .otherwise(closed)
        )

    zero = F.struct(F.lit(False).alias("inside"), F.array().cast(_STRINGS).alias("out"))
    return F.aggregate(
        marked_lines(md), zero, merge, lambda acc: T.strip(F.array_join(acc["out"], "\n"))
    )


def ocr_text(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", ocr_text_col(F.col("md")).alias("ocr_text"))


def ocr_pages_col(md: Column) -> Column:
    """Pages of a note: array of struct(link, text), one per line holding an image link.

    mode 0 ordinary, 1 after an image, 2 inside a block, 3 block without quote marks.
    """
    page = "struct<link:string,lines:array<string>>"

    def state(done, link, lines, mode):
        return F.struct(
            done.alias("done"), link.alias("link"), lines.alias("lines"), F.lit(mode).alias("mode")
        )

    def merge(acc, l):
        none = F.array().cast(_STRINGS)
        current = F.struct(acc["link"].alias("link"), acc["lines"].alias("lines"))
        done = F.when(acc["link"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], current))
        ordinary = F.when(l["image"], state(done, l["link"], none, 1)).otherwise(
            state(acc["done"], acc["link"], acc["lines"], 0)
        )
        plain = F.regexp_replace(l["s"], K.HEADING, "")
        plain = F.when(F.startswith(plain, F.lit(">")), _unquoted(plain)).otherwise(plain)
        unmarked = (
            F.when(l["image"], ordinary)
            .when(l["s"] == "", state(acc["done"], acc["link"], acc["lines"], 3))
            .when(l["s"].rlike(K.PAGE_HEADING), ordinary)
            .when(plain != "", state(acc["done"], acc["link"], F.array_append(acc["lines"], plain), 3))
            .otherwise(state(acc["done"], acc["link"], acc["lines"], 3))
        )
        quoted = (l["s"] != "") & ~l["callout"] & F.startswith(l["s"], F.lit(">"))
        return (
            F.when(acc["mode"] == 0, ordinary)
            .when(
                acc["mode"] == 1,
                F.when(l["header"], state(acc["done"], acc["link"], acc["lines"], 2))
                .when(l["s"] == "", acc)
                .otherwise(ordinary),
            )
            .when(
                acc["mode"] == 2,
                F.when(quoted, state(acc["done"], acc["link"], F.array_append(acc["lines"], _unquoted(l["s"])), 2))
                .when(F.size(acc["lines"]) > 0, ordinary)
                .otherwise(unmarked),
            )
            .otherwise(unmarked)
        )

    zero = state(F.array().cast(f"array<{page}>"), F.lit(None).cast("string"), F.array().cast(_STRINGS), 0)

    def finish(acc):
        last = F.struct(acc["link"].alias("link"), acc["lines"].alias("lines"))
        pages = F.when(acc["link"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last))
        return F.transform(
            pages,
            lambda p: F.struct(
                p["link"].alias("link"), T.strip(F.array_join(p["lines"], "\n")).alias("text")
            ),
        )

    return F.aggregate(marked_lines(md), zero, merge, finish)


def ocr_pages(notes: DataFrame) -> DataFrame:
    """One row per page: note_id, page (from 1), image_link, image_name, ocr_text."""
    return unfolded(notes, ["note_id"], ocr_pages_col(F.col("md")), "col", "pos").select(
        "note_id",
        (F.col("pos") + 1).alias("page"),
        F.col("col.link").alias("image_link"),
        F.substring_index("col.link", "/", -1).alias("image_name"),
        F.col("col.text").alias("ocr_text"),
    )


def clean_text_col(text: Column) -> Column:
    """Normalized OCR blocks of a text, or the normalized text when it has none."""
    blocks = T.normalize_text(ocr_text_col(text))
    return F.when(text.rlike(K.OCR_MARK), F.coalesce(F.nullif(blocks, F.lit("")), T.normalize_text(text))).otherwise(
        T.normalize_text(text)
    )


def clean_text(df: DataFrame, column: str = "ocr_text") -> DataFrame:
    return df.withColumn("clean_text", clean_text_col(F.col(column)))


def line_table(pages: DataFrame, column: str = "ocr_text") -> DataFrame:
    """Lines cut at newlines with their start offsets: note_id, page, line_no, line_start, line."""
    lines = T.newline_lines(F.col(column))
    starts = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("a")),
        lambda acc, l: F.struct(
            (acc["p"] + F.char_length(l) + 1).cast("int").alias("p"),
            F.array_append(acc["a"], acc["p"]).alias("a"),
        ),
        lambda acc: acc["a"],
    )
    return (
        pages.select("note_id", "page", lines.alias("lines"), starts.alias("starts"))
        .select("note_id", "page", "starts", F.posexplode("lines").alias("line_no", "line"))
        .select("note_id", "page", "line_no", F.get("starts", F.col("line_no")).alias("line_start"), "line")
    )


def pages_missing_ocr(pages: DataFrame) -> DataFrame:
    """Pages with an image name and no text."""
    return pages.where((T.strip(F.coalesce("ocr_text", F.lit(""))) == "") & (F.coalesce("image_name", F.lit("")) != ""))


def ocr_coverage(pages: DataFrame) -> DataFrame:
    """Per note: pages, pages with text and their share."""
    filled = T.strip(F.coalesce("ocr_text", F.lit(""))) != ""
    return pages.groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(filled).alias("n_with_ocr"),
        (F.count_if(filled) / F.count(F.lit(1))).alias("coverage"),
    )


# --- rewriting blocks ---------------------------------------------------------
def ocr_blocks_col(md: Column) -> Column:
    """Block positions of a note: array of struct(header, n): header line (from 0), content lines."""
    def merge(acc, l):
        quoted = (l["s"] != "") & ~l["callout"] & F.startswith(l["s"], F.lit(">"))
        n = F.size(acc["out"])
        last = F.get(acc["out"], n - 1)
        longer = F.array_append(
            F.slice(acc["out"], F.lit(1), n - 1),
            F.struct(last["header"].alias("header"), (last["n"] + 1).alias("n")),
        )
        opened = F.array_append(acc["out"], F.struct(acc["i"].alias("header"), F.lit(0).alias("n")))
        keep = acc["open"] & quoted
        return F.struct(
            (acc["i"] + 1).alias("i"),
            (keep | l["header"]).alias("open"),
            F.when(keep, longer).when(l["header"], opened).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(
        F.lit(0).alias("i"),
        F.lit(False).alias("open"),
        F.array().cast("array<struct<header:int,n:int>>").alias("out"),
    )
    return F.aggregate(marked_lines(md), zero, merge, lambda acc: acc["out"])


def splice_lines(lines: Column, edits: Column) -> Column:
    """Replace line ranges: ``edits`` is array of struct(start, end, new array), sorted, disjoint."""
    def rebuilt(v):
        old, e, n = v["l"], v["e"], F.size(v["e"])

        def before(i):
            return F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)["end"])

        pieces = F.flatten(
            F.transform(e, lambda x, i: F.concat(F.slice(old, before(i) + 1, x["start"] - before(i)), x["new"]))
        )
        done = F.when(n == 0, F.lit(0)).otherwise(F.get(e, n - 1)["end"])
        return F.concat(pieces, F.slice(old, done + 1, F.size(old)))

    return T.let(F.struct(lines.alias("l"), edits.alias("e")), rebuilt)


def _quoted(lines: Column) -> Column:
    return F.transform(lines, lambda t: F.concat(F.lit("> "), t))


def split_over_blocks(blocks: Column, lines: Column) -> Column:
    """Share new lines over blocks in proportion to their old size; the last block takes the rest."""
    total_old = F.aggregate(blocks, F.lit(0), lambda a, b: a + b["n"])

    def shared(v):
        new, old = v["new"], F.greatest(v["old"], F.lit(1))
        counts = F.transform(
            blocks, lambda b: F.greatest(F.lit(1), F.bround(b["n"] / old * F.size(new), 0).cast("int"))
        )
        froms = F.aggregate(
            counts,
            F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<f:int,n:int>>").alias("a")),
            lambda acc, c: F.struct(
                (acc["p"] + c).alias("p"), F.array_append(acc["a"], F.struct(acc["p"].alias("f"), c.alias("n"))).alias("a")
            ),
            lambda acc: acc["a"],
        )
        last = F.size(blocks) - 1
        return F.transform(
            froms,
            lambda x, i: F.slice(new, x["f"] + 1, F.when(i == last, F.size(new)).otherwise(x["n"])),
        )

    return T.let(F.struct(lines.alias("new"), total_old.alias("old")), shared)


def _range_edits(blocks: Column, assigned: Column) -> Column:
    return T.let(
        assigned,
        lambda parts: F.transform(
            blocks,
            lambda b, i: F.struct(
                (b["header"] + 1).alias("start"),
                (b["header"] + 1 + b["n"]).alias("end"),
                _quoted(F.get(parts, i)).alias("new"),
            ),
        ),
    )


def embed_corrected(notes: DataFrame, texts: DataFrame) -> DataFrame:
    """Write one corrected text per note back over all of its OCR blocks.

    ``texts``: note_id, text.  Notes without a text or without a block stay as they are.
    """
    joined = notes.join(texts.select("note_id", F.col("text").alias("_new")), "note_id", "left")
    with_blocks = joined.withColumn("_blocks", ocr_blocks_col(F.col("md")))
    assigned = split_over_blocks(F.col("_blocks"), T.split_lines(F.col("_new")))
    rebuilt = F.array_join(splice_lines(T.split_lines(F.col("md")), _range_edits(F.col("_blocks"), assigned)), "\n")
    keep = F.col("_new").isNull() | (F.size("_blocks") == 0)
    return with_blocks.withColumn("md", F.when(keep, F.col("md")).otherwise(rebuilt)).drop("_new", "_blocks")


def _page_texts(pages: DataFrame) -> DataFrame:
    """Page texts of a note in one row; a note has no more of them than it has images."""
    return pages.groupBy("note_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("int"), "text"))).alias("_texts")
    )


def embed_corrected_pages(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Write corrected page texts (note_id, page, text) back: page n replaces block n."""
    joined = notes.join(_page_texts(pages), "note_id", "left").withColumn("_blocks", ocr_blocks_col(F.col("md")))
    edits = F.filter(
        F.transform(
            F.col("_blocks"),
            lambda b, i: F.struct(
                (b["header"] + 1).alias("start"),
                (b["header"] + 1 + b["n"]).alias("end"),
                _quoted(T.split_lines(F.element_at(F.col("_texts"), i + 1))).alias("new"),
            ),
        ),
        lambda e: e["new"].isNotNull(),
    )
    rebuilt = F.array_join(splice_lines(T.split_lines(F.col("md")), edits), "\n")
    keep = F.col("_texts").isNull() | (F.size(edits) == 0)
    return joined.withColumn("md", F.when(keep, F.col("md")).otherwise(rebuilt)).drop("_texts", "_blocks")


def upsert_ocr(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Insert or replace the OCR block of pages (note_id, page, text); page n is the n-th image line.

    A note with a page beyond its images stays as it is; :func:`rejected_pages` names it.
    """
    lines = marked_lines(F.col("md"))
    joined = notes.join(_page_texts(pages), "note_id", "left").withColumn("_lines", lines)
    ls = F.col("_lines")
    images = F.filter(
        F.transform(ls, lambda l, i: F.when(l["image"], i)), lambda i: i.isNotNull()
    )
    joined = joined.withColumn("_images", images)

    def edit(img, p):
        after = F.slice(ls, img + 2, F.size(ls))
        blanks = F.size(after) - F.size(_drop_while(after, lambda l: (l["s"] == "") & ~l["header"]))
        head = img + 1 + blanks
        found = F.coalesce(F.get(ls, head)["header"], F.lit(False))
        rest = F.slice(ls, head + 2, F.size(ls))
        quoted = lambda l: (l["s"] != "") & ~l["callout"] & F.startswith(l["s"], F.lit(">"))
        stop = head + 1 + F.size(rest) - F.size(_drop_while(rest, quoted))
        text = F.element_at(F.col("_texts"), p + 1)
        new = F.concat(F.array(F.lit("> [!ocr]")), _quoted(T.split_lines(text)))
        return F.struct(
            F.when(found, head).otherwise(img + 1).alias("start"),
            F.when(found, stop).otherwise(img + 1).alias("end"),
            F.when(text.isNotNull(), new).alias("new"),
        )

    edits = F.filter(F.transform(F.col("_images"), edit), lambda e: e["new"].isNotNull())
    raw = F.transform(ls, lambda l: l["raw"])
    rebuilt = F.array_join(splice_lines(raw, edits), "\n")
    bad = F.exists(F.map_keys("_texts"), lambda p: (p < 1) | (p > F.size("_images")))
    return joined.withColumn(
        "md",
        F.when(F.col("_texts").isNull(), F.col("md"))
        .when(bad, F.col("md"))
        .otherwise(rebuilt),
    ).drop("_texts", "_lines", "_images")


def rejected_pages(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(note_id, page, reason) of pages that :func:`upsert_ocr` can't place: no such note, or no such image."""
    images = F.size(F.filter(marked_lines(F.col("md")), lambda l: l["image"]))
    known = notes.select("note_id", images.alias("_n"))
    page = F.col("page").cast("int")
    reason = F.when(F.col("_n").isNull(), F.lit("unknown note")).when((page < 1) | (page > F.col("_n")), F.lit("page out of range"))
    return pages.join(known, "note_id", "left").select("note_id", "page", reason.alias("reason")).where(F.col("reason").isNotNull())


def _drop_while(items: Column, holds) -> Column:
    """The array without its longest leading run for which ``holds``."""
    first = F.array_position(F.transform(items, lambda x: ~holds(x)), True)
    return F.when(first == 0, F.slice(items, F.size(items) + 1, F.lit(0))).otherwise(
        F.slice(items, first.cast("int"), F.size(items))
    )


# --- frontmatter --------------------------------------------------------------
def frontmatter_block(md: Column) -> Column:
    """Text between a leading ``---`` and the next line starting with ``---``; null without one."""
    rest = F.substring(md, F.lit(4), F.char_length(md))
    cut = F.instr(rest, "\n---")
    return F.when(F.startswith(md, F.lit("---")) & (cut > 0), F.substring(rest, F.lit(1), cut - 1))


def frontmatter_block_any(md: Column) -> Column:
    """As :func:`frontmatter_block`, but any later ``---`` ends the block."""
    rest = F.substring(md, F.lit(4), F.char_length(md))
    cut = F.instr(rest, "---")
    return F.when(F.startswith(md, F.lit("---")) & (cut > 0), F.substring(rest, F.lit(1), cut - 1))


def set_frontmatter(notes: DataFrame, key: str, value) -> DataFrame:
    """Set one top-level frontmatter key: the first exact match is replaced, else a line is added.

    A note whose frontmatter isn't closed stays as it is; :func:`unclosed_frontmatter` names it.
    """
    md = F.col("md")
    line = f"{key}: {value}"
    safe_key = "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in key)
    pattern = rf"(?md)^{safe_key}:[ \t]*.*$"
    cut = F.instr(F.substring(md, F.lit(4), F.char_length(md)), "\n---") + 3
    block = F.substring(md, F.lit(5), cut - 5)
    rest = F.substring(md, cut, F.char_length(md))
    hit = F.regexp_instr(block, F.lit(pattern))
    old = F.regexp_extract(block, pattern, 0)
    replaced = F.concat(
        F.substring(block, F.lit(1), hit - 1), F.lit(line), F.substring(block, hit + F.char_length(old), F.char_length(block))
    )
    added = F.concat(F.regexp_replace(block, "\n+$", ""), F.lit(f"\n{line}\n"))
    return notes.withColumn(
        "md",
        F.when(~F.startswith(md, F.lit("---")), F.concat(F.lit(f"---\n{line}\n---\n"), md))
        .when(cut == 3, md)
        .otherwise(
            F.concat(F.lit("---\n"), F.when(hit > 0, replaced).otherwise(added), rest)
        ),
    )


def unclosed_frontmatter(notes: DataFrame) -> DataFrame:
    """(note_id, reason) of notes that open a frontmatter and never close it."""
    md = F.col("md")
    cut = F.instr(F.substring(md, F.lit(4), F.char_length(md)), "\n---")
    return notes.where(F.startswith(md, F.lit("---")) & (cut == 0)).select("note_id", F.lit("frontmatter not closed").alias("reason"))


def merge_body(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Frontmatter of the stored copy, body of the incoming copy (both note_id, md)."""
    def fm_end(md):
        cut = F.instr(F.substring(md, F.lit(4), F.char_length(md)), "\n---")
        return F.when(F.startswith(md, F.lit("---")) & (cut > 0), cut + 3 + 3)

    s, i = stored.select("note_id", F.col("md").alias("_stored")), incoming.select("note_id", F.col("md").alias("_in"))
    s_end, i_end = fm_end(F.col("_stored")), fm_end(F.col("_in"))
    body = F.when(i_end.isNull(), F.col("_in")).otherwise(F.substring("_in", i_end + 1, F.char_length("_in")))
    md = F.when(s_end.isNull(), F.col("_in")).otherwise(F.concat(F.substring("_stored", F.lit(1), s_end), body))
    return i.join(s, "note_id", "left").select("note_id", md.alias("md"))
