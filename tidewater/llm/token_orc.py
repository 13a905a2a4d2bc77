"""Token ids in ORC: stripes of run-length encoded integers, row indexes and Bloom filters on ids.

Documents are range-partitioned by id and sorted, so files and stripes hold disjoint id ranges: a
reader takes stripes in parallel, and a lookup of ids is pruned by the row index's bounds and the
Bloom filter before any token is decoded. Tokens are encoded after the shuffle, which so carries
texts only.

Words that recur are encoded once: a block of texts is cut at white space, and a comma or full stop
behind an ASCII letter is cut off, which are places where the tokenizer's own splitting cuts too. A
tokenizer for which that doesn't hold of a sample text encodes whole texts instead.

Defined cases: null and empty texts have the end id alone; null ids come first and rows that repeat
an id are rows of their own, ordered by text; an empty table gives an empty file and an empty
result; columns besides id and text aren't read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import kernels as K
from tidewater.llm.common import cut, scratch, ship

U = np.uint64
#: Words that a worker remembers at most, and words encoded in one call.
REMEMBERED, TOGETHER = 1_500_000, 256
#: Writer settings: stripe bytes, rows of an index entry, and false positives of the Bloom filters.
ORC = {"orc.stripe.size": str(32 << 20), "orc.row.index.stride": "5000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "ZSTD"}
LEAST = -(1 << 63)
#: What tells whether a tokenizer cuts where the words are cut here.
PROBE = "Some words,  with Marks. (odd) ones, 12,3 a.b\tA.\n\n\u00e9t\u00e9. x, |y| don't re-do <b> ... ,. end."


class Encoder:
    """Token ids of texts by way of their words."""

    def __init__(self, path: str, mark: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self.forget()
        self.whole = self.mark_id is None
        if not self.whole:
            raw = np.frombuffer(PROBE.encode(), np.uint8)
            self.whole = self.encode(raw, np.array([0, len(raw)]))[0].tolist() != self.tokenizer.encode(PROBE, add_special_tokens=False).ids
            self.forget()

    def forget(self) -> None:
        """Begin with no words."""
        self.keys, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        self.ids, self.first = [np.zeros(0, np.int32)], np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        made: list[np.ndarray] = []
        lots = [words[k: k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        joined = [self.mark.join(lot) for lot in lots]
        for lot, got in zip(lots, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int32)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(lot) - 1:  # a word holds the mark
                made += [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lot, add_special_tokens=False)]
            else:
                made += [p[1:] if k else p for k, p in enumerate(np.split(ids, cut))]
        size = np.array([len(m) for m in made], np.int64)
        self.flat = np.concatenate([self.flat, *made])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        place = np.arange(len(self.first) - 1 - len(made), len(self.first) - 1)
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.place = both[order], np.concatenate([self.place, place])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text's begin."""
        if self.whole:
            raw = data.tobytes()
            got = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
            ids = [np.array(e.ids, np.int32) for e in got]
            return np.concatenate(ids or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        start, stop, bounds = K.word_spans(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        last = data[stop - 1]
        letter = np.zeros(256, bool)
        letter[97:123] = letter[65:91] = True
        tail = ((last == 44) | (last == 46)) & (stop - start > 1) & letter[data[np.maximum(stop - 2, 0)]]
        # each word is one piece, or two
        n = 1 + tail.astype(np.int64)
        at = np.cumsum(n) - n
        first, end = np.zeros(n.sum(), np.int64), np.zeros(n.sum(), np.int64)
        first[at], end[at] = start, stop - tail
        first[at[tail] + 1], end[at[tail] + 1] = stop[tail] - 1, stop[tail]
        bounds = np.concatenate([[0], np.cumsum(n)])[bounds]
        bars = (data == 124).any()  # special tokens are told from text by case
        keys = K.span_hashes(data, first, end, K.PLAIN if bars else K.LOWER)
        known, example, which = np.unique(keys, return_index=True, return_inverse=True)
        for again in (False, True):
            k = np.minimum(np.searchsorted(self.keys, known), max(0, len(self.keys) - 1))
            new = self.keys[k] != known if len(self.keys) else np.ones(len(known), bool)
            if not new.any():
                break
            if again or len(self.keys) + int(new.sum()) > REMEMBERED:
                self.forget()
                new = np.ones(len(known), bool)
            raw = data.tobytes()
            some = example[new]
            self._learn(known[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(first[some].tolist(), end[some].tolist(), strict=True)])
        k = self.place[np.searchsorted(self.keys, known)][which]
        size = self.first[k + 1] - self.first[k]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.first[k] - total[:-1], size)]
        return ids, total[bounds]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return Encoder(path)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write (doc_id, ids, row) in ascending order of ids; the row's high bits are its part."""
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = placed.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1), 4 << 20):
                ids, bounds = enc.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                bounds = bounds + np.arange(len(bounds))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    made = placed.mapInArrow(rows, "doc_id long, ids array<int>").withColumn("row", F.monotonically_increasing_id())
    made.write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids, row); given ids are looked up by row index and Bloom filter."""
    found = spark.read.schema("doc_id long, ids array<int>, row long").orc(path)
    return found if ids is None else found.where(F.col("doc_id").isin(ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part) of each document in the files.

    A part's documents are counted through by a window of its own; the tokens of the parts before it
    come from one row a part.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, row long"

    def rows(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "ids_crc32", "row"])

    ship(spark)
    part = F.shiftright("row", 33).alias("part")
    each = cut(read(spark, path).mapInArrow(rows, schema), "token-digest").withColumn("part", part)
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("run", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("run")).alias("start"), "n_tokens", "ids_crc32", "part")


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write `docs` to a table in the shared folder and read its digest back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-orc")
    write(docs, path, vocabulary, end_id)
    return digest(spark, path)
