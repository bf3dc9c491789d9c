"""Scores of whole texts by a causal self-attention model over subword ids, beside a word-frequency base.

The corpus is read once: texts become blocks of ids and of word numbers, in a bucketed table. From it come, over all training
texts, the count of every id and of every word. Words are counted by 64-bit hashes (of lower-cased A-Z), per block first, so that a word has at most one row
a block; the counts return to the blocks in the order of their words, and no word or text is looked up twice.

The model (``attention``) takes its classes of ids and the start of its biases from the counts of all training texts, and is trained on all of them in two steps:
on a primer of about ``PRIMER`` bytes, chosen by a hash of doc_id, in one place; then every learner takes a lesson
of about ``LESSON`` ids, starts from the primed model, and the learners' tables are averaged by their lessons' lengths. The lessons are all other training
texts, so each training text is learned from; they are read from the blocks where these lie, and a task gives one sum. Texts are scored block by block.

Ids are those of the tokenizer, which ignores case and the kind of white space; the end of a text is an id of its own.

Defined cases: a null or empty text, or one of white space, has its end only; a null doc_id is scored, never learned from, and not held out;
rows of equal doc_id are scored each; without training texts all ids have equal shares and the base score is 0; an empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import attention, blocks, lexicon, scan, store, units

#: Bytes of text in a block; bytes and positions of the primer, which is met once at least and ``EPOCHS`` times at most; share of the training texts in lessons (with 1 all but
#: the primer), ids of one; the rates of both steps, and windows a lesson takes at once.
BLOCK, PRIMER, POSITIONS, SHARE, LESSON = 8 << 20, 6_000_000, 1_500_000, 1.0, 500_000
EPOCHS, RATES, TOGETHER = 4, (0.5, 0.2), 192
#: Ids that are scored in one call.
PART = 1 << 19
#: Numbers of a model in one row on their way to the average.
CHUNK = 8192
#: The fold of crc32(doc_id) that is not learned from.
HELD = 1
_END = scan.mix(np.array([0xE2D], scan.U)).view(np.int64)[0]
TRAIN, IN_PRIMER, IN_LESSON = 1, 2, 3
NAMES = ["block", "payload", "keys", "counts", "ids", "id_counts", "tokens", "primer", "lesson_ids"]
_KINDS = pa.schema([(n, pa.int64() if n in ("block", "tokens", "lesson_ids") else pa.binary()) for n in NAMES])


def held_out() -> F.Column:
    return F.coalesce(lexicon.fold() == HELD, F.lit(False))


def _role(primer: float) -> F.Column:
    """0: not learned from, or one of the three kinds of training texts."""
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.when(u < primer, IN_PRIMER).when(u < primer + SHARE, IN_LESSON).otherwise(TRAIN)
    return F.coalesce(F.when(lexicon.fold() != HELD, chosen), F.lit(0))


def _listed(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.LargeListArray.from_arrays(pa.array(offs, pa.int64()), pa.array(values))


def _texts(ids: list[np.ndarray], lens: list[int], kind) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, kind)
    return blocks.pack(pa.RecordBatch.from_arrays([_listed(flat, np.r_[0, np.cumsum(lens, dtype=np.int64)])], ["ids"]))


def _open(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    column = blocks.unpack(raw).column(0)
    return column.values.to_numpy(), column.offsets.to_numpy()


def _block(number: int, end: int, parts: list[tuple]) -> pa.RecordBatch:
    """One row of the parts (doc_ids, roles, ids, their offsets, word hashes, their offsets)."""
    doc_ids = pa.concat_arrays([p[0] for p in parts])
    roles = np.concatenate([p[1] for p in parts])
    ids = np.concatenate([p[2] for p in parts])
    words = np.concatenate([p[4] for p in parts])
    id_len = np.concatenate([np.diff(p[3]) for p in parts])
    word_len = np.concatenate([np.diff(p[5]) for p in parts])
    keys, at = np.unique(np.append(words.view(np.int64), _END), return_inverse=True)
    learned = roles > 0
    counts = np.bincount(at[:-1][np.repeat(learned, word_len)], minlength=len(keys))
    counts[at[-1]] += learned.sum()
    id_at, word_at = np.r_[0, np.cumsum(id_len)], np.r_[0, np.cumsum(word_len)]
    id_counts = np.bincount(ids[np.repeat(learned, id_len)], minlength=end + 1)
    id_counts[end] += learned.sum()
    seen = np.flatnonzero(id_counts)

    first = np.flatnonzero(roles == IN_PRIMER).tolist()
    primer = _texts([ids[id_at[i] : id_at[i + 1]] for i in first], [int(id_len[i]) for i in first], ids.dtype)
    payload = blocks.pack(pa.RecordBatch.from_arrays([doc_ids, _listed(ids, id_at), _listed(at[:-1].astype(np.uint32), word_at), pa.array(roles.astype(np.int8))], ["doc_id", "ids", "words", "role"]))
    n = int(id_len[roles == IN_LESSON].sum() + (roles == IN_LESSON).sum())
    values = [number, payload, keys.tobytes(), counts.astype(np.int64).tobytes(), seen.astype(np.int64).tobytes(), id_counts[seen].astype(np.int64).tobytes(), int(counts.sum()), primer, n]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _KINDS, strict=True)], schema=_KINDS)


def _bucketed(df: DataFrame) -> DataFrame:
    """``df`` as a table in buckets of its blocks: two of these join without a shuffle."""
    spark, name = df.sparkSession, f"llm_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(store.ranges_of(spark), "block").format("parquet").option("path", store.shared_folder(spark)).saveAsTable(name)
    table = spark.table(name)
    table.table_name = name
    return table


def _release(table: DataFrame) -> None:
    """Remove a table of ``_bucketed`` that nothing reads any more, files and all."""
    store.drop(table)
    table.sparkSession.sql(f"DROP TABLE {table.table_name}")


def read_corpus(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """The blocks of all documents (``NAMES``)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1

    def run(batches):
        enc, task, made, held, room = units.encoder(tokenizer), TaskContext.get().partitionId(), 0, [], 0
        end = enc.tokenizer.get_vocab_size()
        for batch in batches:
            for lo, hi, data, offs in scan.slices(batch.column(2)):
                ids, at = enc.encode(data, offs)
                first, last = scan.runs(scan.NOT_SPACE[data], offs)
                words = scan.run_hashes(data, first, last, scan.LOWER_VALUE)
                held.append((batch.column(0).slice(lo, hi - lo), np.asarray(batch.column(1).slice(lo, hi - lo)), ids, at, words, scan.row_starts(first, offs)))
                room += len(data)
                if room >= block:
                    yield _block(task << 32 | made, end, held)
                    made, held, room = made + 1, [], 0
        if held:
            yield _block(task << 32 | made, end, held)

    rows = store.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _role(min(1.0, PRIMER / size)).cast("long").alias("role"), "text"))
    return _bucketed(rows.mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in _KINDS)))


def _pairs(corpus: DataFrame, key: str, count: str, keep: list[str]) -> DataFrame:
    """(keep, key, n) of two columns of packed numbers."""

    def run(batches):
        for batch in batches:
            for *kept, a, b in zip(*batch.columns, strict=True):
                kept, a, b = [k.as_py() for k in kept], np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                for i in range(0, len(a), 1 << 16):
                    part = a[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(part), k)) for k in kept], pa.array(part), pa.array(b[i : i + (1 << 16)])], [*keep, "key", "n"])

    return corpus.select(*keep, key, count).mapInArrow(run, "".join(f"{k} long, " for k in keep) + "key long, n long")


def word_counts(corpus: DataFrame) -> DataFrame:
    """(block, found, firsts): the corpus counts of a block's words in their order, and how many known words this block is the first to hold.

    A block's words are in the order of their hashes, so they go in one row for each range of hashes, and come back in one.
    """
    ranges = store.ranges_of(corpus.sparkSession)
    edges = np.array([(k << 64) // ranges - (1 << 63) for k in range(1, ranges)], np.int64)

    def dealt(batches):
        for batch in batches:
            for block, keys, counts in zip(*batch.columns, strict=True):
                keys, counts = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)
                at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                made = [(block.as_py(), r, keys[a:b].tobytes(), counts[a:b].tobytes()) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "range", "keys", "counts"])

    def summed(now, held):
        held.sort()  # the first of a word's places is the one of its least block
        lens = [len(k) // 8 for _, k, _ in held]
        _, first, at = np.unique(np.frombuffer(b"".join(k for _, k, _ in held), np.int64), return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, at, np.frombuffer(b"".join(c for _, _, c in held), np.int64))
        edge = np.r_[0, np.cumsum(lens)]
        firsts = np.bincount(np.searchsorted(edge, first[total > 0], side="right") - 1, minlength=len(held))
        found = total[at]
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in held], pa.int64()), pa.array([now] * len(held), pa.int64()), pa.array([found[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), pa.array(firsts, pa.int64())],
            ["block", "range", "found", "firsts"])

    def joined(now, held):
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(f for _, f, _ in held)], pa.binary()), pa.array([sum(n for _, _, n in held)], pa.int64())], ["block", "found", "firsts"])

    def runs(close):
        """Rows of equal first columns, which lie together, to ``close(the value, the other columns)``."""

        def run(batches):
            now, held = None, []
            for batch in batches:
                for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != now and held:
                        yield close(now, held)
                        held = []
                    now = key
                    held.append(tuple(rest))
            if held:
                yield close(now, held)

        return run

    rows = corpus.select("block", "keys", "counts").mapInArrow(dealt, "block long, range long, keys binary, counts binary")
    by_range = rows.repartition("range").sortWithinPartitions("range").select("range", "block", "keys", "counts").mapInArrow(runs(summed), "block long, range long, found binary, firsts long")
    return _bucketed(by_range.repartition("block").sortWithinPartitions("block", "range").mapInArrow(runs(joined), "block long, found binary, firsts long"))


def _flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _lessons_of(payload: pa.Buffer | bytes, size: int):
    """(ids, lengths) of the lesson texts of a block, in parts of at most ``size`` ids; a longer text is a part of its own."""
    rows = blocks.unpack(payload)
    column, chosen = rows.column(1), rows.column(3).to_numpy() == IN_LESSON
    lens = np.diff(column.offsets.to_numpy())
    ids, lens = column.values.to_numpy()[np.repeat(chosen, lens)], lens[chosen]
    offs, lo = np.r_[0, np.cumsum(lens)], 0
    while lo < len(lens):
        hi = min(len(lens), max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1))
        yield ids[offs[lo] : offs[hi]], lens[lo:hi]
        lo = hi


def _learned(corpus: DataFrame, model: dict, code: attention.Codes, end: int) -> dict:
    """The average of what learners make of ``model``, each from its lesson."""
    spark, size = corpus.sparkSession, LESSON
    if not corpus.agg(F.sum("lesson_ids")).first()[0]:
        return model
    sent = spark.sparkContext.broadcast((model, code))  # of fixed size

    def lessons(batches):
        units.release()  # read_corpus was the last to encode
        start, code = sent.value
        held, room, total, seen = [], 0, 0.0, 0

        def taught():
            own = {k: v.copy() for k, v in start.items()}
            ids = np.concatenate([i for i, _ in held]).astype(np.int64)
            offs = np.r_[0, np.cumsum(np.concatenate([n for _, n in held]))]
            attention.train(own, code, ids, offs, end, room, RATES[1], together=TOGETHER)
            return _flat(own).astype(np.float64) * room

        for batch in batches:
            for raw in batch.column(0):
                for ids, lens in _lessons_of(raw.as_buffer(), size):
                    n = len(ids) + len(lens)
                    if held and room + n > size:
                        total, seen, held, room = total + taught(), seen + room, [], 0
                    held.append((ids, lens))
                    room += n
        if held:
            total, seen = total + taught(), seen + room
        if seen:
            for k in range(0, len(total), CHUNK):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "n": pa.array([seen], pa.int64()), "part": pa.array([total[k : k + CHUNK].tobytes()], pa.binary())})

    def added(batches):
        now, total, n = None, None, 0
        for batch in batches:
            for chunk, weight, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield _sum(now, n, total)
                    now, total, n = chunk, 0, 0
                total, n = total + np.frombuffer(part), n + weight
        if now is not None:
            yield _sum(now, n, total)

    made = store.written(corpus.where("lesson_ids > 0").select("payload").mapInArrow(lessons, "chunk int, n long, part binary"))
    sums = made.repartition("chunk").sortWithinPartitions("chunk", "n").mapInArrow(added, "chunk int, n long, part binary").collect()  # one model
    flat = np.concatenate([np.frombuffer(r.part) / r.n for r in sorted(sums, key=lambda r: r.chunk)])
    return _shaped(flat, model)


def _sum(chunk, n, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "n": pa.array([n], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})


def learn(corpus: DataFrame, end: int) -> tuple[dict, attention.Codes]:
    """The model and its codes from the training texts of the corpus; ``end`` is the id of the end of a text."""
    counts = np.zeros(end + 1, np.int64)
    for r in _pairs(corpus, "ids", "id_counts", []).groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most one row an id
        counts[r.key] = r.n
    code = attention.codes(counts)
    model = attention.start(code)
    primer = [_open(r.primer) for r in corpus.select("block", "primer").orderBy("block").collect()]
    primer = [(i, o) for i, o in primer if len(o) > 1]
    if primer:
        ids = np.concatenate([i for i, _ in primer]).astype(np.int64)
        offs = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, o in primer]))]
        n = len(ids) + len(offs) - 1
        attention.train(model, code, ids, offs, end, max(n, min(POSITIONS, EPOCHS * n)), RATES[0])
    return _learned(corpus, model, code, end), code


_SCORERS: dict[str, attention.Scorer] = {}


def _scorer(name: str, sent) -> attention.Scorer:
    """One scorer a process."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = attention.Scorer(*sent.value)
    return _SCORERS[name]


def score(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    end = units.encoder(tokenizer).tokenizer.get_vocab_size()
    corpus = read_corpus(docs, tokenizer, block)
    known = word_counts(corpus)
    tokens = corpus.agg(F.sum("tokens")).first()[0] or 0
    distinct = known.agg(F.sum("firsts")).first()[0] or 0
    sent, name = spark.sparkContext.broadcast(learn(corpus, end)), uuid.uuid4().hex

    def run(batches):
        units.release()
        scorer = _scorer(name, sent)
        for batch in batches:
            for payload, keys, found in (map(pa.BinaryScalar.as_buffer, row) for row in zip(*batch.columns, strict=True)):
                rows, c = blocks.unpack(payload), np.frombuffer(found, np.int64)
                log = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
                own_end = int(np.searchsorted(np.frombuffer(keys, np.int64), _END))
                known_words, own = c > 0, np.array([log[own_end], c[own_end] > 0])
                ids, words = rows.column(1), rows.column(2)
                id_at, at = ids.offsets.to_numpy(), words.offsets.to_numpy()
                lo = 0
                while lo < len(rows):  # as many texts as make a bounded number of ids
                    hi = min(len(rows), max(lo + 1, int(np.searchsorted(id_at, id_at[lo] + PART, side="right")) - 1))
                    w = words.values.slice(at[lo], at[hi] - at[lo]).to_numpy()
                    edge = (at[lo : hi + 1] - at[lo]).tolist()
                    values, seen = log[w], known_words[w]
                    # sums within a text, so that equal texts have equal scores wherever they lie
                    base = np.array([values[a:b].sum() for a, b in zip(edge[:-1], edge[1:], strict=True)]) + own[0]
                    n_known = np.array([np.count_nonzero(seen[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], np.int64) + int(own[1])
                    part = ids.values.slice(id_at[lo], id_at[hi] - id_at[lo]).to_numpy()
                    s = scorer.score(part, id_at[lo : hi + 1] - id_at[lo], end)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).slice(lo, hi - lo), pa.array(np.diff(at[lo : hi + 1]) + 1), pa.array(n_known), pa.array(base, pa.float64()), pa.array(s, pa.float64())],
                        ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                    lo = hi

    scored = corpus.select("block", "payload", "keys").join(known.select("block", "found"), "block").select("payload", "keys", "found")
    out = store.written(scored.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double"))
    for table in (corpus, known):
        _release(table)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
