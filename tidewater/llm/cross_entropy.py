"""Cross-entropy difference: how much more a document reads like a target than like the rest.

Two bigram models with one vocabulary, one order, one smoothing and about as much text are counted:
the target's over the documents marked as such, the background's over a seeded sample of all others
whose size matches (if the others are fewer, the target is sampled instead). Both grow with the
corpus. A document's score is the mean over its tokens of the target's loss less the background's, in
nats; the lower, the closer to the target. A boundary stands before and after each text and is
predicted like a word.

No document is scored by a model that holds it or a copy of it: a hash of the text deals all
documents into two folds, and each fold is scored by the models counted over the other.

    p(w | h) = (c(h, w) + STRENGTH * p(w)) / (c(h) + STRENGTH),  p(w) = (c(w) + 1) / (n + ids)

Here `ids` is the number of distinct words of both models of a fold, the boundary and a word that
nobody has seen; p sums to 1 over them.

The counts are exact and no task and no broadcast holds a model. Words and bigrams have keys of 63
hashed bits (among a billion distinct keys, two that are equal come up in about one corpus of 20).
Texts are dealt into chunks of about CHUNK bytes; a chunk sends each of its keys once, however often
it stands there, as a question to the models of its fold and with what it adds to those of the other,
packed. Keys are dealt by their first bits into buckets, one for about 10 * BUCKET bytes of all texts; a
task holds the packed keys of a bucket, adds up its models and answers, so its memory doesn't grow with the corpus. An
answer names a key by its place among the chunk's questions, which are worked out again where texts are scored.

Defined cases: null and empty texts have no words, only the boundary is predicted; null ids are never
target; rows that repeat are counted and scored each; without target documents that model is even; an
empty table gives an empty result; columns besides id, text and mark aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm.common import cut, release, ship

U = np.uint64
#: Bytes of text that are scored together, keys that are held together, and the weight of the unigrams.
CHUNK, BUCKET, STRENGTH = 8 << 20, 1 << 21, 50.0
#: Keys of words are odd, those of bigrams even.
BOUNDARY = U(1)


def _keys(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, word, first of each text) of the tokens of runs of rows, with the boundaries."""
    for _, _, data, offsets in K.blocks(column):
        start, stop, bounds = K.word_spans(data, offsets)
        hashes, n = K.span_hashes(data, start, stop, K.LOWER) | U(1), np.diff(bounds)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        whole = np.full(first[-1] + 1, BOUNDARY)  # a boundary, the text, and so on to a last boundary
        whole[np.arange(len(hashes)) + np.repeat(np.arange(1, len(n) + 1), n)] = hashes
        yield whole[:-1], whole[1:], first


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix(context ^ K.mix(word + U(16))) & ~U(1)


def roles(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 23) -> DataFrame:
    """(key, text, role, fold) of every row: role 1 trains the target's model, 2 the background's, 0 none."""
    ids = targets.select(F.col(targets.columns[0]).alias("key")).where("key is not null").distinct().withColumn("hit", F.lit(True))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    every = rows.agg(F.sum(size)).first()[0] or 0
    of_target = rows.select("key", size.alias("size")).join(ids, "key").agg(F.sum("size")).first()[0] or 0
    other = every - of_target
    rate = {True: min(1.0, other / max(1, of_target)), False: min(1.0, of_target / max(1, other))}
    drawn = lambda hit: F.pmod(F.xxhash64("key", "text", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(rate[hit] * (1 << 40)))
    role = F.when(F.col("hit").isNotNull() & drawn(True), 1).when(F.col("hit").isNull() & drawn(False), 2).otherwise(0)
    # the plan of large corpora at any size, so that what is shuffled grows with the input
    return rows.join(ids.hint("merge"), "key", "left").select("key", "text", role.alias("role"), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int").alias("fold"))


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(key, text, role, fold, chunk): rows of one fold with about `size` bytes; a written table, so that they stay."""

    def rows(batches):
        first, held = TaskContext.get().partitionId() << 32, [0, 0]
        for batch in batches:
            n = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            fold = batch.column(3).to_numpy()
            chunk = np.zeros(len(n), np.int64)
            for f in (0, 1):
                mine = fold == f
                chunk[mine] = first + (held[f] + np.cumsum(n[mine]) - n[mine]) // size * 2 + f
                held[f] += int(n[mine].sum())
            yield batch.append_column("chunk", pa.array(chunk))

    kind = docs.schema["key"].dataType.simpleString()
    return cut(docs.mapInArrow(rows, f"key {kind}, text string, role int, fold int, chunk long"), "cross-entropy-texts")


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers by their steps, or small ones as they are: bytes of the same weight side by side, deflated."""
    return zlib.compress(np.ascontiguousarray(values.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view(U)[:, 0]


def _steps(values: np.ndarray) -> bytes:
    return _packed(np.diff(values.astype(U), prepend=U(0)))


def _columns(table: pa.Table, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(chunk, its rows) of rows (text, chunk, ...), held until a task has read all of a chunk."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        chunk = batch.column(1).to_numpy()
        for c in np.unique(chunk).tolist():
            for other in [x for x in held if x != c and x % 2 == c % 2]:  # chunks of a fold follow each other
                yield other, held.pop(other)
            held.setdefault(c, []).append(batch.filter(pa.array(chunk == c)))
    yield from held.items()


def _summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, and the sum of each one's counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) if len(first) else c for c in counts)]


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _tokens(rows: list[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What `_keys` gives of a chunk's rows, whose first column is the text."""
    return [x for batch in rows for x in _keys(batch.column(0))]


def _all_keys(tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The words of a chunk, and then its bigrams; its questions are the distinct ones in their order."""
    return np.concatenate([*(word for _, word, _ in tokens), *(_pair(context, word) for context, word, _ in tokens), np.zeros(0, U)])


def looked_up(texts: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, places, t, b, words, all_t, all_b): which questions of a chunk the models of its fold have seen, and their counts.

    `places` are those among the chunk's questions in the bucket. Rows of a chunk below 0 hold a bucket's figures of fold
    -1 - chunk: its distinct words and their counts. A chunk sends a key once: as its question, and with it the counts that
    it adds to the models of the other fold, so a task reads a bucket whole before it answers.
    """
    kind = "bucket long, chunk long, keys binary, t binary, b binary"
    names = [c.split()[0] for c in kind.split(", ")]

    def of_chunks(batches):
        for chunk, rows in _whole_chunks(batches):
            tokens = _tokens(rows)
            n = np.concatenate([np.diff(first) for _, _, first in tokens] or [np.zeros(0, np.int64)])
            role = np.repeat(np.concatenate([batch.column(2).to_numpy() for batch in rows]), n)
            keys, t, b = _summed(_all_keys(tokens), np.tile(role == 1, 2), np.tile(role == 2, 2))
            of = _bucket_of(keys, bits)
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            spans = [slice(*e) for e in zip(edge, edge[1:], strict=False) if e[1] > e[0]]
            for k in range(0, len(spans), 100):
                some = spans[k: k + 100]
                packed = [[_steps(keys[s]) for s in some], *([_packed(v[s]) if v[s].any() else None for s in some] for v in (t, b))]
                yield pa.record_batch([pa.array([int(of[s.start]) for s in some], pa.int64()), pa.array([chunk] * len(some), pa.int64()), *(pa.array(v, pa.binary()) for v in packed)], names)

    answer = ["chunk", "bucket", "places", "t", "b", "words", "all_t", "all_b"]

    def of_bucket(bucket, rows):
        models = []
        for fold in (0, 1):
            parts = []
            for chunk, keys, t, b in rows:
                if chunk % 2 == fold or (t is None and b is None):
                    continue
                keys = np.cumsum(_unpacked(keys), dtype=U)
                t, b = (np.zeros(len(keys), U) if v is None else _unpacked(v) for v in (t, b))
                seen = (t + b) > 0
                parts.append((keys[seen], t[seen], b[seen]))
            keys, t, b = _summed(*(np.concatenate([p[k] for p in parts]) for k in range(3))) if parts else [np.zeros(0, U)] * 3
            models.append((keys, t, b))
            word = (keys & U(1)) == 1
            yield pa.record_batch([pa.array([-1 - fold]), pa.array([bucket]), *[pa.array([None], pa.binary())] * 3, pa.array([int(word.sum())]), pa.array([int(t[word].sum())]), pa.array([int(b[word].sum())])], answer)
        for chunk, keys, _, _ in rows:
            known, t, b = models[chunk % 2]
            keys = np.cumsum(_unpacked(keys), dtype=U)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = np.flatnonzero(known[at] == keys) if len(known) else at[:0]
            if len(hit):
                yield pa.record_batch([pa.array([chunk]), pa.array([bucket]), *(pa.array([v], pa.binary()) for v in (_steps(hit), _packed(t[at[hit]]), _packed(b[at[hit]]))), *[pa.array([0])] * 3], answer)

    def answers(batches):
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and rows:
                    yield from of_bucket(now, rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield from of_bucket(now, rows)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.select("text", "chunk", "role").mapInArrow(of_chunks, kind)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answers, "chunk long, bucket long, places binary, t binary, b binary, words long, all_t long, all_b long")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, bucket: int = BUCKET, strength: float = STRENGTH) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = chunks(roles(docs, targets, id_col, text_col), size)
    release(spark)
    every = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (every // (10 * bucket)).bit_length()  # a key in 5 bytes, in two folds
    found = cut(looked_up(texts, bits), "cross-entropy-counts")
    release(spark)
    sums = found.where("chunk < 0").groupBy("chunk").agg(F.sum("words"), F.sum("all_t"), F.sum("all_b")).collect()  # two rows
    figures = {-1 - r[0]: r[1:] for r in sums}

    def rate(left, right):
        column = left.column("text").combine_chunks()
        fold = left.column("fold")[0].as_py() if left.num_rows else 0
        words, t, b = figures.get(fold, (0, 0, 0))
        total, ids = np.array([t or 0, b or 0], np.float64), words + 1
        tokens = list(_keys(column))
        wanted = _all_keys(tokens)
        order = np.argsort(wanted)
        first = np.ones(len(wanted), bool)
        first[1:] = wanted[order][1:] != wanted[order][:-1]
        place = np.empty(len(wanted), np.int64)
        place[order] = np.cumsum(first) - 1
        keys = wanted[order][first]
        of_bucket = _bucket_of(keys, bits)
        counts = np.zeros((len(keys), 2))  # 0 for what no model has seen
        for b, places, in_t, in_b in zip(*_columns(right, "bucket", "places", "t", "b"), strict=True):
            at = np.searchsorted(of_bucket, b) + np.cumsum(_unpacked(places), dtype=U).astype(np.int64)
            counts[at, 0], counts[at, 1] = _unpacked(in_t), _unpacked(in_b)
        lengths, loss, at, half = [], [], 0, len(wanted) // 2
        boundary = counts[np.searchsorted(keys, BOUNDARY)] if half else None
        for _, word, first in tokens:
            of_word, of_pair = counts[place[at: at + len(word)]], counts[place[half + at: half + at + len(word)]]
            of_context = np.empty_like(of_word)
            of_context[1:] = of_word[:-1]  # the context of a word is the word before it
            of_context[first[:-1]] = boundary
            p = (of_pair + strength * (of_word + 1.0) / (total + ids)) / (of_context + strength)
            at += len(word)
            lengths.append(np.diff(first))
            loss.append(np.add.reduceat(-np.log(p), first[:-1], axis=0) / lengths[-1][:, None])
        lengths, loss = np.concatenate(lengths), np.concatenate(loss)
        return pa.table(
            [left.column("key"), pa.array(lengths - 1), pa.array(loss[:, 0]), pa.array(loss[:, 1]), pa.array(loss[:, 0] - loss[:, 1])],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.select("key", "text", "fold", "chunk").groupBy("chunk").cogroup(found.where("chunk >= 0").select("chunk", "bucket", "places", "t", "b").groupBy("chunk")).applyInArrow(
        rate, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double")
