"""Reading notes, their frontmatter, images and OCR confidence trees."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .. import constants as K
from ..functions import text as T
from ..functions.rows import unfolded
from ..operators import pages as P
from ..session import written

FRONTMATTER = ArrayType(
    StructType([
        StructField("key", StringType()), StructField("ord", IntegerType()),
        StructField("value", StringType()), StructField("is_text", BooleanType()),
    ])
)


def _relative(path: Column, root: str) -> Column:
    """Path below the root, decoded; file URIs and plain paths alike."""
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    at = F.instr(plain, base)
    return F.substring(plain, at + len(base), F.char_length(plain))


def _allowed(rel: Column) -> Column:
    return ~F.exists(F.split(rel, "/", -1), lambda part: part.isin(*K.EXCLUDED_DIRS))


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes below a folder: note_id and path (relative, no suffix, NFC), name, md."""
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
        .select(F.col("value").alias("md"), _relative(F.col("_metadata.file_path"), root).alias("rel"))
        .where(_allowed(F.col("rel")))
    )
    path = T.nfc(F.regexp_replace("rel", r"\.md$", ""))
    return raw.select(path.alias("note_id"), path.alias("path"), F.substring_index(path, "/", -1).alias("name"), "md")


def list_notes(notes: DataFrame) -> DataFrame:
    return notes.select("name", "path").orderBy("path")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Images below a folder: image_name (NFC), image_path (relative); contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(root)
        .select(_relative(F.col("path"), root).alias("rel"))
        .where(_allowed(F.col("rel")))
    )
    path = T.nfc(F.col("rel"))
    return files.select(F.substring_index(path, "/", -1).alias("image_name"), path.alias("image_path"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder: path, folder, basename, extension."""
    rel = _relative(F.col("path"), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(rel.alias("path"))
    name = F.substring_index("path", "/", -1)
    return files.select(
        "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("basename"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"),
    )


# --- frontmatter ---------------------------------------------------------------
def _parse_block(block: str) -> dict:
    """One YAML map; anything else, or an error, counts as empty."""
    try:
        data = yaml.safe_load(block)
    except Exception:
        return {}
    return data if isinstance(data, dict) else {}


def _flat(block: str | None) -> list[dict]:
    if not block:
        return []
    rows: list[dict] = []
    for key, value in _parse_block(block).items():
        for v in value if isinstance(value, list) else [value]:
            if v is None or isinstance(v, (dict, list)):
                continue
            rows.append({"key": str(key), "ord": len(rows), "value": str(v), "is_text": isinstance(v, str)})
    return rows


@F.pandas_udf(FRONTMATTER)
def _parse_blocks(blocks: pd.Series) -> pd.Series:
    return blocks.map(_flat)


def frontmatter_col(block: Column) -> Column:
    """Entries of a frontmatter block; only the block goes through Python, not the note."""
    return F.when(block.isNotNull() & (block != ""), _parse_blocks(block)).otherwise(F.array().cast(FRONTMATTER))


def frontmatter_rows(notes: DataFrame, fence: str = "line") -> DataFrame:
    """Long frontmatter table: note_id, key, ord, value, is_text.

    ``fence='line'`` ends the block at a line starting with ---, ``'any'`` at any later ---.
    """
    cut = P.frontmatter_block if fence == "line" else P.frontmatter_block_any
    return unfolded(notes, ["note_id"], frontmatter_col(cut(F.col("md"))), "x").select("note_id", "x.*")


# --- finding notes and images ---------------------------------------------------
def find_notes(notes: DataFrame, queries: DataFrame, frontmatter: DataFrame | None = None) -> DataFrame:
    """Best note per query (query): id, name, path, path without .md, part of name, part of path.

    All rules are equi joins, those by parts on pieces of just the lengths that are asked for; the least path per query is kept.
    """
    q = queries.select("query", T.nfc(F.col("query")).alias("_q"))
    n = notes.select("note_id", "path", "name")
    exact = n.select(F.col("name").alias("_q"), F.lit(2).alias("rule"), "note_id", "path").unionByName(
        n.select(F.col("path").alias("_q"), F.lit(3).alias("rule"), "note_id", "path")
    ).unionByName(
        n.select(F.concat("path", F.lit(".md")).alias("_q"), F.lit(4).alias("rule"), "note_id", "path")
    )
    if frontmatter is not None:
        ids = frontmatter.where(F.col("key") == "id").select("note_id", F.col("value").alias("_q"))
        exact = exact.unionByName(n.join(ids, "note_id").select("_q", F.lit(1).alias("rule"), "note_id", "path"))
    pick = F.min(F.struct("rule", "path", "note_id")).alias("b")
    hit = q.join(exact, "_q").groupBy("query").agg(pick)
    open_q = q.join(hit.select("query"), "query", "left_anti").withColumn("_bare", F.regexp_replace("_q", r"\.md$", ""))
    part = _parts_of(n, open_q.select("query", F.col("_q").alias("_s")), "name", 5).unionByName(
        _parts_of(n, open_q.select("query", F.col("_bare").alias("_s")), "path", 6)
    ).groupBy("query").agg(pick)
    found = hit.unionByName(part).select("query", "b.note_id", "b.path", "b.rule")
    return queries.select("query").distinct().join(found, "query", "left")


def _pieces(text, size: int):
    """Distinct runs of ``size`` letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def _parts_of(notes: DataFrame, queries: DataFrame, column: str, rule: int) -> DataFrame:
    """The least (path, note_id) of the notes whose ``column`` holds the query text ``_s``: query, rule, path, note_id.

    A note gives its pieces of just the lengths that queries have; the least note of each piece is kept before the shuffle as well as
    after it, and a query is equi joined on its whole text. So a query meets one row, and nothing is compared afterwards.
    An empty query is part of every note, of which only the first can win.
    """
    first = notes.agg(F.min(F.struct("path", "note_id")).alias("m")).withColumn("_s", F.lit(""))
    out = queries.join(first, "_s").select("query", F.lit(rule).alias("rule"), "m.path", "m.note_id")
    # distinct lengths: no more than the longest name or path has letters
    longest = notes.agg(F.max(F.char_length(column))).first()[0] or 0
    lengths = [r.n for r in queries.select(F.char_length("_s").alias("n")).where((F.col("n") > 0) & (F.col("n") <= longest)).distinct().collect()]
    if not lengths:
        return out
    of_length = lambda n: F.when(F.char_length(column) >= n, _pieces(F.col(column), n))
    pieces = F.flatten(F.filter(F.array(*[of_length(n) for n in sorted(lengths)]), lambda p: p.isNotNull()))
    made = unfolded(notes, ["note_id", "path"], pieces, "_s")
    least = made.groupBy("_s").agg(F.min(F.struct("path", "note_id")).alias("m"))
    return out.unionByName(queries.join(least, "_s").select("query", F.lit(rule).alias("rule"), "m.path", "m.note_id"))


def image_links(notes: DataFrame) -> DataFrame:
    """Every image link of the notes, several per line too: note_id, ord, link."""
    whole = F.regexp_extract_all("md", F.lit(K.IMAGE_LINK), F.lit(1))
    return unfolded(notes, ["note_id"], whole, "_l", "ord").select("note_id", "ord", T.nfc(F.col("_l")).alias("link"))


def _image_tables(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_path = images.select(F.col("image_path").alias("_path"), F.col("image_path").alias("_full"))
    by_name = images.groupBy("image_name").agg(F.min("image_path").alias("_named"))
    return by_path, by_name


def _resolve(df: DataFrame, link: str, images: DataFrame) -> DataFrame:
    """Adds image_path: a link with a folder by its path first, then any link by its file name."""
    by_path, by_name = _image_tables(images)
    full = F.when(F.contains(link, F.lit("/")), F.col(link))
    return (
        df.withColumn("_path", full).withColumn("image_name", F.substring_index(link, "/", -1))
        .join(by_path, "_path", "left").join(by_name, "image_name", "left")
        .withColumn("image_path", F.coalesce("_full", "_named")).drop("_path", "_full", "_named")
    )


def resolve_images(notes: DataFrame, images: DataFrame, frontmatter: DataFrame | None = None) -> DataFrame:
    """Images of each note in link order; a note without any falls back to its frontmatter, then its name."""
    # written: both are read again, and neither the links nor the notes' texts should be
    linked = written(_resolve(image_links(notes), "link", images).where(F.col("image_path").isNotNull()).select("note_id", "ord", "image_path"))
    rest = written(notes.select("note_id", "name").join(linked.select("note_id").distinct(), "note_id", "left_anti"))
    _, by_name = _image_tables(images)
    own = F.array(*[F.concat("name", F.lit(ext)) for ext in K.IMAGE_SUFFIXES])
    named = rest.select("note_id", F.posexplode(own).alias("_r", "image_name")).withColumn("_r", F.col("_r") + 2)
    if frontmatter is not None:
        img = frontmatter.where(F.col("key") == "image").select("note_id", T.nfc(F.col("value")).alias("_v"))
        img = rest.select("note_id").join(img, "note_id")
        named = named.unionByName(img.select("note_id", F.posexplode(F.array("_v", F.substring_index("_v", "/", -1))).alias("_r", "image_name")))
    one = named.join(by_name, "image_name").groupBy("note_id").agg(F.min_by("_named", "_r").alias("image_path"))
    return linked.unionByName(one.select("note_id", F.lit(0).alias("ord"), "image_path"))


def page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Adds image_path to pages; '' when the image is unknown."""
    nfc_link = pages.withColumn("_link", T.nfc(F.col("image_link")))
    done = _resolve(nfc_link.drop("image_name"), "_link", images)
    return done.withColumn("image_path", F.coalesce("image_path", F.lit(""))).drop("_link")


# --- OCR confidence trees ----------------------------------------------------------
def scan_ocr_json(spark: SparkSession, root: str) -> DataFrame:
    """Sidecar trees: name (file stem), json (text)."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rel = _relative(F.col("_metadata.file_path"), root)
    return raw.select(rel.alias("rel"), F.col("value").alias("json")).where(_allowed(F.col("rel"))).select(
        T.nfc(F.regexp_replace(F.substring_index("rel", "/", -1), r"\.json$", "")).alias("name"), "json"
    )


_TOKEN = re.compile(r'[\s,:]*(?:([{}\[\]])|("(?:[^"\\]|\\.)*")|([^\s,:{}\[\]"]+)|$)', re.S)


def _tree_events(raw: str):
    """Opening and closing marks and scalars of a JSON text, in its order; no depth is too deep."""
    at = 0
    while at < len(raw):
        m = _TOKEN.match(raw, at)
        if m is None or m.end() == at:
            return
        at = m.end()
        if m[1]:
            yield m[1], None
        elif m[2] or m[3]:
            yield "", json.loads(m[2] or m[3], strict=False)


def _texts_of_tree(raw: str | None) -> list[tuple[str, float]]:
    """(text, confidence) of every object that holds both, an object before its children, keys as written."""
    out: list[list] = []
    stack: list[dict] = []
    try:
        for mark, value in _tree_events(raw or ""):
            if mark in ("{", "["):
                if stack:
                    stack[-1]["key"] = None
                # an object's place is taken when it opens; it is filled when it closes
                out.append([None, None])
                stack.append({"map": mark == "{", "key": None, "at": len(out) - 1})
            elif mark:
                stack.pop()
            elif stack and stack[-1]["map"]:
                top = stack[-1]
                if top["key"] is None:
                    top["key"] = value
                else:
                    if top["key"] in ("text", "confidence"):
                        out[top["at"]][top["key"] == "confidence"] = value
                    top["key"] = None
    except (ValueError, IndexError):
        return []  # not a tree
    if stack:
        return []
    return [(t, float(c)) for t, c in out if isinstance(t, str) and isinstance(c, int | float) and not isinstance(c, bool)]


def ocr_chars(trees: DataFrame) -> DataFrame:
    """Every object of a tree (note_id, json) holding text and confidence: note_id, ord, text, confidence.

    A tree is read from its first to its last token with a stack of open objects, so neither its depth nor its
    number of objects is bounded. Objects come in the order in which they open; a text that is no tree gives none.
    """
    kind = trees.schema["note_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, order, texts, scores = [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for k, (text, score) in enumerate(_texts_of_tree(raw)):
                    rows.append(i)
                    order.append(k)
                    texts.append(text)
                    scores.append(score)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(order, pa.int32()), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], ["note_id", "ord", "text", "confidence"])

    return trees.select("note_id", "json").mapInArrow(run, f"note_id {kind}, ord int, text string, confidence double")


# --- change detection ------------------------------------------------------------
def rescan_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added notes by path, one row of counts): added, removed, total; both inputs hold path, name."""
    o, n = old.select("path").distinct(), new.select("path").distinct()
    added = new.select("path", "name").join(o, "path", "left_anti")
    tagged = (
        n.withColumn("_n", F.lit(1)).join(o.withColumn("_o", F.lit(1)), "path", "full")
        .agg(
            F.count_if(F.col("_o").isNull()).alias("added"),
            F.count_if(F.col("_n").isNull()).alias("removed"),
            F.count_if(F.col("_n").isNotNull()).alias("total"),
        )
    )
    return added.orderBy("path"), tagged


# --- sidecar resolution ------------------------------------------------------------
def resolve_sidecars(notes: DataFrame, files: DataFrame, frontmatter: DataFrame, priority=K.SIDECAR_STEPS,
                     image_keys=K.SIDECAR_IMAGE_KEYS, data_keys=K.SIDECAR_DATA_KEYS, log_keys=K.SIDECAR_LOG_KEYS) -> DataFrame:
    """Image, OCR data and correction log of each note by the first step that applies.

    notes: note_id, path (with suffix), md; files: path, folder, basename, extension.
    Result: image_file, data_file, log_file, method, confidence, missing, n_pages.
    """
    name = F.substring_index("path", "/", -1)
    n = notes.select(
        "note_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("basename"),
    )
    by_path = files.select("path").withColumnRenamed("path", "_hit")
    by_name = files.groupBy(F.substring_index("path", "/", -1).alias("_name")).agg(F.min("path").alias("_named"))

    def lookup(df, column):
        return (
            df.withColumn("_name", F.substring_index(column, "/", -1))
            .join(by_path, F.col(column) == F.col("_hit"), "left").join(by_name, "_name", "left")
            .withColumn("file", F.coalesce("_hit", "_named")).drop("_hit", "_named", "_name")
        )

    # body: the first page's image, and whether every page has image and text
    body_pages = P.ocr_pages(notes)
    resolved = lookup(body_pages.withColumn("_link", T.strip(F.col("image_link"))), "_link")
    body = resolved.groupBy("note_id").agg(
        F.min_by("file", F.when(F.col("page") == 1, F.lit(1))).alias("image"),
        F.bool_or(F.col("file").isNull()).alias("no_image"), F.bool_or(F.col("ocr_text") == "").alias("no_text"),
        F.count(F.lit(1)).alias("n_pages"),
    )
    body = body.select(
        "note_id", F.lit("body-callout").alias("method"), "image", F.lit(None).cast("string").alias("data"),
        F.lit(None).cast("string").alias("log"),
        F.when(F.col("no_image") | F.col("no_text"), "medium").otherwise("high").alias("confidence"),
        F.array_compact(F.array(F.when(F.col("no_image"), F.lit("image")), F.when(F.col("no_text"), F.lit("ocr-text")))).alias("missing"),
        "n_pages",
    )

    def slots(rows, method, low=False):
        """rows: note_id, slot, file, rank to one row per note."""
        pick = lambda s: F.min_by(F.when(F.col("slot") == s, F.col("file")), F.when(F.col("slot") == s, F.col("rank"))).alias(s)
        wide = rows.where(F.col("file").isNotNull()).groupBy("note_id").agg(pick("image"), pick("data"), pick("log"))
        missing = F.array_compact(F.array(
            F.when(F.col("image").isNull(), F.lit("image")), F.when(F.col("data").isNull(), F.lit("ocr-data")),
            F.when(F.col("log").isNull(), F.lit("correction-log"))))
        conf = F.lit("low") if low else F.when(F.col("image").isNotNull() & F.col("data").isNotNull(), "high").otherwise("medium")
        return wide.select(
            "note_id", F.lit(method).alias("method"), "image", "data", "log", conf.alias("confidence"), missing.alias("missing"),
            F.when(F.col("image").isNotNull(), 1).otherwise(0).cast("bigint").alias("n_pages"),
        )

    keys = [(k, s, i) for s, ks in (("image", image_keys), ("data", data_keys), ("log", log_keys)) for i, k in enumerate(ks)]
    key_map = F.create_map(*[x for k, s, i in keys for x in (F.lit(k), F.struct(F.lit(s).alias("slot"), F.lit(i).alias("rank")))])
    fm = (
        frontmatter.where(F.col("is_text") & F.col("key").isin(*[k for k, _, _ in keys]))
        .withColumn("_k", F.element_at(key_map, F.col("key")))
        .select("note_id", "_k.slot", "_k.rank", T.strip(F.regexp_replace("value", r"^\[\[|\]\]$", "")).alias("_v"))
    )
    by_fm = slots(lookup(fm, "_v").select("note_id", "slot", "file", "rank"), "frontmatter")

    slot = (
        F.when(F.col("extension").isin(*K.SIDECAR_IMAGE_EXTS), "image").when(F.col("extension").isin(*K.SIDECAR_DATA_EXTS), "data")
        .when(F.col("extension").isin(*K.SIDECAR_LOG_EXTS), "log")
    )
    f = files.select(F.col("path").alias("file"), "folder", "basename", slot.alias("slot"))
    same = n.join(f, ["folder", "basename"]).where(F.col("file") != F.col("path"))
    # a file of the same name with an unknown suffix still ends the search at this step
    same_any = same.groupBy("note_id").agg(F.count(F.lit(1)).alias("_n")).select("note_id")
    by_base = slots(same.select("note_id", "slot", "file", F.col("file").alias("rank")), "basename")
    by_base = same_any.join(by_base, "note_id", "left").select(
        "note_id", F.lit("basename").alias("method"), "image", "data", "log", F.coalesce("confidence", F.lit("medium")).alias("confidence"),
        F.coalesce("missing", F.array(F.lit("image"), F.lit("ocr-data"), F.lit("correction-log"))).alias("missing"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
    )
    # a folder needs its three least files only, picked before it meets its notes
    per_folder = f.where(F.col("slot").isNotNull()).groupBy("folder", "slot").agg(F.min("file").alias("file"))
    by_folder = slots(n.join(per_folder, "folder").select("note_id", "slot", "file", F.col("file").alias("rank")), "folder-scan", low=True)

    steps = {"body-callout": body, "frontmatter": by_fm, "basename": by_base, "folder-scan": by_folder}
    tagged = None
    for i, step in enumerate(priority):
        one = steps[step].withColumn("_rank", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    best = tagged.groupBy("note_id").agg(
        F.min_by(F.struct("image", "data", "log", "method", "confidence", "missing", "n_pages"), "_rank").alias("b")
    )
    return n.select("note_id").join(best, "note_id", "left").select(
        "note_id", F.col("b.image").alias("image_file"), F.col("b.data").alias("data_file"), F.col("b.log").alias("log_file"),
        F.coalesce("b.method", F.lit("none")).alias("method"), F.coalesce("b.confidence", F.lit("low")).alias("confidence"),
        F.coalesce("b.missing", F.array(F.lit("image"), F.lit("ocr-data"), F.lit("correction-log"))).alias("missing"),
        F.coalesce("b.n_pages", F.lit(0)).alias("n_pages"),
    )
