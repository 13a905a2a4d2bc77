"""Ranked lexical search by an automaton over whole texts, without an index of the documents.

The terms of the queries make an Aho-Corasick automaton; each is guarded by a separator on both sides,
so that it matches whole terms only. Tasks run it over the texts, whose other characters are turned
into single separators. A first pass counts rows with terms (N), all terms (L) and the rows that hold each
query term (df); a second one counts tf again, maps terms to the items that hold them, adds up the
items' scores and keeps the `top` best rows an item of its own. The best of all tasks meet in two
steps, so no task reads more than a share of them.

The automaton is broadcast in parts of PART characters of terms at most, each made of whole items (an
item longer than that is a part of its own), and each costs two passes over the texts.

Score of a row for an item, in whole numbers: the sum of w * ((10 ** 9 * tf) div (1000 * tf + 8 * m)) over
the item's distinct terms, with w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and
m = 10 + 90 * n * N div L for a row of n terms.

Defined cases: null texts have no terms; a text without terms isn't counted in N; rows that repeat are
rows of their own and rank one after the other; rows with a null id rank behind equal scores; items
without terms, and items of which no row holds a term, give no row; repeated items are each answered;
null item ids are kept; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import kernels as K
from tidewater.llm.common import cut, ship

#: Characters of terms of one automaton.
PART = 4_000_000
#: Groups in which the best rows of an item meet first.
SPREAD = 512
_NULL = (1 << 63) - 1

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes to separators and lower case; a text is read as one character a byte, so that terms are spans of bytes.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _IS_TERM[b] else 0x20 for b in range(256))
_TERM = re.compile("[^ ]+")


def plain(text: bytes) -> str:
    """A text as its terms with a separator on both sides, one character a byte."""
    return f" {text.translate(_PLAIN).decode('latin-1')} "


def terms(text: str) -> list[str]:
    """The terms of a text with their repeats, as in `plain`."""
    return _TERM.findall(plain(text.encode()))


class Queries:
    """Some items, their distinct terms and the automaton of these; it is built where it is used."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.ids = np.array([_NULL if i is None else i for i, _ in items], np.int64)
        self.null = np.array([i is None for i, _ in items], bool)
        place: dict[str, int] = {}
        pairs = sorted({(place.setdefault(t, len(place)), k) for k, (_, found) in enumerate(items) for t in found})
        self.terms = list(place)
        self.item = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(place) + 1))

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(self.terms):
            made.add_word(f" {t} ", k)
        made.make_automaton()
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def counted(self, text: str) -> Counter:
        """tf of each query term in a text made by `plain`."""
        return Counter(k for _, k in self.automaton.iter(text))


def parts(items: DataFrame, item_col: str, text_col: str) -> Iterator[Queries]:
    """The items in parts; the driver holds one at a time."""
    held, size = [], 0
    for item, text in items.select(F.col(item_col).cast("long"), text_col).toLocalIterator():
        found = list(dict.fromkeys(terms(text or "")))
        if not found:
            continue
        held.append((item, found))
        size += sum(map(len, found))
        if size >= PART:
            yield Queries(held)
            held, size = [], 0
    if held:
        yield Queries(held)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """First row, texts as `plain` gives them and numbers of terms, of blocks of rows."""
    for batch in batches:
        for a, _, data, offsets in K.blocks(batch.column(column)):
            solid = _IS_TERM[data]
            start = solid.copy()
            start[1:] &= ~solid[:-1]
            inner = offsets[(offsets < len(data))]
            start[inner] = solid[inner]
            n = np.concatenate([[0], np.cumsum(start)])[offsets]
            whole = data.tobytes()
            yield batch, a, [plain(whole[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], np.diff(n)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """A weight for each term."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def _counts(docs: DataFrame, text_col: str, held) -> tuple[int, int, np.ndarray]:
    """N, L and df of the terms; tasks send one row for each term they have seen."""

    def rows(batches):
        df: Counter = Counter()
        some = length = 0
        for _, _, texts, n in _texts(batches, 0):
            some, length = some + int((n > 0).sum()), length + int(n.sum())
            for text in texts:
                df.update(held.value.counted(text).keys())
        key = np.array([-2, -1, *df], np.int64)
        yield pa.record_batch([pa.array(key), pa.array(np.array([some, length, *df.values()], np.int64))], ["term", "n"])

    found = docs.select(text_col).mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = found.toArrow()  # as many rows as the broadcast part has terms, at most
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(len(held.value.terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term == -2].sum()), int(n[term == -1].sum()), df


def _best(scored: tuple[np.ndarray, np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows (item, score, id) of each item."""
    item, score, key = scored
    order = np.lexsort((key, -score, item))
    item = item[order]
    first = np.searchsorted(item, item, "left")
    keep = order[np.arange(len(order)) - first < top]
    return scored[0][keep], score[keep], key[keep]


def _scores(queries: Queries, n: int, length: int, weight: np.ndarray, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, score, place of the text) of every text and item with a score above 0."""
    found = [queries.counted(t) for t in texts]
    count = np.array([len(c) for c in found], np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    term = np.fromiter((k for c in found for k in c), np.int64, count.sum())
    tf = np.fromiter((v for c in found for v in c.values()), np.int64, count.sum())
    m = 10 + np.array([90 * int(s) * n // length for s in sizes], np.int64) if length else np.zeros(len(texts), np.int64)
    gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    many = np.diff(queries.first)[term]
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(queries.first[term], many)
    key = np.repeat(doc, many) * len(queries.ids) + queries.item[at]
    # texts come one after the other, so a table of the block's texts and items adds up what belongs together
    total = np.zeros(len(texts) * len(queries.ids), np.int64)
    np.add.at(total, key, np.repeat(gain, many))
    hit = np.flatnonzero(total > 0)
    return hit % len(queries.ids), total[hit], hit // len(queries.ids)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's `top` best rows."""
    spark = docs.sparkSession
    ship(spark)
    schema = "part int, item int, item_id long, doc_id long, score long"
    out, sent = None, []
    for number, part in enumerate(parts(items, item_col, item_text_col)):
        held = spark.sparkContext.broadcast(part)
        n, length, df = _counts(docs, text_col, held)
        rule = spark.sparkContext.broadcast((n, length, weights(n, df)))
        sent += [held, rule]

        def rows(batches, held=held, rule=rule, number=number):
            queries, (n, length, weight) = held.value, rule.value
            best = (np.zeros(0, np.int64),) * 3
            step = max(1, 2_000_000 // len(queries.ids))  # texts a turn: the table of scores stays small
            for batch, a, texts, sizes in _texts(batches, 1):
                ids = K.pc.fill_null(batch.column(0), _NULL).to_numpy(zero_copy_only=False)
                for k in range(0, len(texts), step):
                    item, score, at = _scores(queries, n, length, weight, texts[k: k + step], sizes[k: k + step])
                    least = np.zeros(len(queries.ids), np.int64)  # what an item's last place asks for
                    full = np.bincount(best[0], minlength=len(least)) >= top
                    low = np.full(len(least), _NULL)
                    np.minimum.at(low, best[0], best[1])
                    least[full] = low[full]
                    some = score >= least[item]
                    best = _best(tuple(np.concatenate(v) for v in zip(best, (item[some], score[some], ids[a + k + at[some]]), strict=True)), top)
            item, score, key = best
            yield pa.record_batch([
                pa.array(np.full(len(item), number, np.int32)), pa.array(item.astype(np.int32)), pa.array(queries.ids[item], mask=queries.null[item]),
                pa.array(key, mask=key == _NULL), pa.array(score)], ["part", "item", "item_id", "doc_id", "score"])

        made = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, schema)
        out = made if out is None else out.union(made)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("group", F.spark_partition_id() % SPREAD)
    first = out.withColumn("rank", F.row_number().over(Window.partitionBy("part", "item", "group").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("part", "item").orderBy(*order))).where(F.col("rank") <= top)
    made = cut(last.select("item_id", "rank", "doc_id", "score"), "lexical-best")
    for one in sent:
        one.destroy()
    return made
