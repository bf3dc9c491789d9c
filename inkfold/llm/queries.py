"""The registered query of each operator with its production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a token-id file with Elias-Fano boundaries, read back."""
    from inkfold.llm import token_files, units

    blocks = token_files.write_tokens(table(spark, sf_dir, "documents"), units.tokenizer_path("byte_bpe_50k.json"), 2)
    return token_files.read_tokens(blocks)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    from inkfold.llm import packing, units

    return packing.pack(table(spark, sf_dir, "documents"), units.tokenizer_path("word_bpe_49k.json"), 1, 4096)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    from inkfold.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 35-word windows that stand elsewhere too."""
    from inkfold.llm import substring_dedup

    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 35).drop("kept")


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    from inkfold.llm import decontaminate

    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learns from the labels outside the held-out fold."""
    from inkfold.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learns from the labels outside the held-out fold."""
    from inkfold.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


OP4_SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS i, len(parts) AS n FROM split),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) % 1000003 AS h FROM lines),
chosen AS (SELECT *, (h + 31 * lag(h, 1, 0) OVER w + 961 * lag(h, 2, 0) OVER w) % 1000003 % 4 = 0 AS c FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
since AS (SELECT *, coalesce(max(CASE WHEN c THEN i + 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM chosen),
ended AS (SELECT *, CAST(c OR (i + 1 - s) % 64 = 0 OR i + 1 = n AS INTEGER) AS e FROM since),
numbered AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ended),
chunks AS (SELECT doc_id, k, min(i) AS f, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, k),
placed AS (SELECT *, size >= 2 AND row_number() OVER (PARTITION BY body, size >= 2 ORDER BY doc_id, f) > 1 AS gone FROM chunks)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY f) FILTER (WHERE NOT gone), '') AS text, CAST(sum(size) AS BIGINT) AS n_lines,
  CAST(coalesce(sum(size) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed
FROM placed GROUP BY doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the multi-line chunks that stand elsewhere before."""
    from pyspark.sql import functions as F

    from inkfold.llm import line_dedup

    found = line_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col(line_dedup.N_LINES).alias("n_lines"), F.col(line_dedup.N_REMOVED).alias("n_removed"))


@query("op8_imatch")
def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    from inkfold.llm import imatch

    return imatch.fingerprints(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold what the template uses itself.
TRICKY = "\\### Assistant: </turn> ok"
OP6_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(regexp_replace(role, '[^\\\\#<:\\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op6_chat_format", OP6_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one tricky one in the template, written and read back."""
    from pyspark.sql import functions as F

    from inkfold.llm import chat, store

    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(store.written(chat.format_records(chat.row_records(rows))))


def _levels(name: str, tree: str, keep: str, levels: int) -> str:
    """CTEs that fold the nodes ``{name}0`` (tree, i, n, h) level by level, and carry rows ``{name}p0`` (tree, i, proof, bad, {keep}) along."""
    out = []
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT {tree}, i // 3 AS i, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY {tree}, i // 3)")
        out.append(f"{name}{k + 1} AS (SELECT {tree}, i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")
        out.append(
            f"{name}p{k + 1} AS (SELECT {keep}, p.{tree}, r.i, proof || array_to_string(hs[:p.i % 3], '') || array_to_string(hs[p.i % 3 + 2:], '') AS proof, "
            f"CASE WHEN n = 1 THEN bad ELSE sha256(array_to_string(hs[:p.i % 3], '') || bad || array_to_string(hs[p.i % 3 + 2:], '')) END AS bad "
            f"FROM {name}p{k} p JOIN {name}r{k} r ON p.{tree} = r.{tree} AND p.i // 3 = r.i)")
    return ", ".join(out)


#: Levels of the trees in the SQL: enough for 3 ** 16 documents of a source and 3 ** 9 sources; a finished tree goes through unchanged.
_LEAVES, _SOURCES = 16, 9
_BYTES = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
OP13_SQL = f"""
WITH d AS (SELECT doc_id, source, {" || ".join(_BYTES.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text FROM documents),
l AS (SELECT doc_id, coalesce('+' || source, '') AS s, sha256(head || {_BYTES.format("text")}) AS leaf,
  CASE WHEN coalesce({_CRC} % 2 = 0, false) THEN sha256(head || {_BYTES.format("replace(text, chr(10), '')")}) END AS bad FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, row_number() OVER () AS rid FROM l),
a0 AS (SELECT s, i, n, leaf AS h FROM o), ap0 AS (SELECT rid, s, i, '' AS proof, coalesce(bad, leaf) AS bad FROM o),
{_levels("a", "s", "rid", _LEAVES)},
b0 AS (SELECT 0 AS w, s, row_number() OVER (ORDER BY encode(s)) - 1 AS i, count(*) OVER () AS n, h FROM a{_LEAVES}),
bp0 AS (SELECT rid, 0 AS w, b0.i, proof, bad, h AS subroot FROM ap{_LEAVES} JOIN b0 USING (s)),
{_levels("b", "w", "rid, subroot", _SOURCES)}
SELECT doc_id, leaf, subroot, (SELECT h FROM b{_SOURCES}) AS root, sha256(proof) AS proof_sha256, p.bad AS folded_root, p.bad = (SELECT h FROM b{_SOURCES}) AS verified
FROM bp{_SOURCES} p JOIN o USING (rid)
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, with a proof of each and what a tampered row folds to."""
    from inkfold.llm import merkle

    return merkle.manifest(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    from inkfold.llm import negatives

    return negatives.mine(table(spark, sf_dir, "embeddings"))


@query("op11_lm_score")
def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by the attention model and by word frequencies, learned outside the held-out fold."""
    from inkfold.llm import lm, units

    return lm.score(table(spark, sf_dir, "documents"), units.tokenizer_path("word_bpe_49k.json"))
