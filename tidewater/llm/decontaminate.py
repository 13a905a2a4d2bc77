"""Benchmark decontamination by the q-gram lemma with banded verification.

A benchmark item is searched in windows of up to WINDOW characters. A text region within k edits of
a window shares at least (length - q + 1) - k * q of its q-grams, and those lie on diagonals that
differ by at most 2 * k. So hits of a text in the table of benchmark q-grams are thinned to runs
dense enough for one window, joined to their postings, and counted in diagonal bands that overlap by
half; windows that reach the bound in a band are aligned inside that band, and stand if the edit
distance keeps the budget.

The bound has to be above 0 for the lemma to find all: with edits of a tenth that holds for q = 8 from
40 characters on; items of 4 to 39 characters are searched by q = 4, and shorter ones, which allow no
edits, by their single characters.

A part of an item counts too: each exact excerpt of EXCERPT characters or more, wherever it begins, is a run
of q-grams on one diagonal; one with edits is found if it holds a whole window, which from 127 characters on
every excerpt does.

Benchmarks are taken in parts of PART characters: each part is one broadcast of bounded size and one
pass over the texts, so a larger benchmark costs passes and not memory. Texts are never shuffled.

Defined cases: null and empty texts match nothing; items without text match nothing; ids may be null or repeat; rows that repeat are each judged; an empty table gives an empty
result; all other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm.common import ship

U = np.uint64
WINDOW, STEP, PART = 96, 32, 1_000_000
#: (least characters of an item, q).
GRAMS = ((40, 8), (4, 4), (1, 1))
#: Characters from which on an exact part of a longer item is found.
EXCERPT = 48
#: Edits allowed, per cent of a window's length.
BUDGET = 10
_KEY = U(0xC2B2AE3D27D4EB4F)


def _fold() -> np.ndarray:
    """Characters as compared: lower case, any white space a space."""
    made = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        made[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return made


FOLD = _fold()
MIXED = K.mix(FOLD.astype(U) + U(17))


def _chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a block of texts, folded, and where each text begins."""
    whole = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if len(whole) != at[-1]:  # bytes that aren't UTF-8
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
        whole, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.where(whole < len(FOLD), FOLD[np.minimum(whole, len(FOLD) - 1)], whole), at


def _grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram."""
    n = len(chars)
    if n < q:
        return np.zeros(0, U)
    x = MIXED[chars] if not n or chars.max() < len(FOLD) else K.mix(chars.astype(U) + U(17))
    up, down = K.powers(n)
    run = np.zeros(n + 1, U)
    np.cumsum(x * up[:-1], out=run[1:])
    return (run[q:] - run[:-q]) * down[: n - q + 1]


class Part:
    """The q-grams of some benchmark items, and their windows."""

    def __init__(self, items: list[tuple[int | None, str]], q: int):
        self.ids, self.q = [i for i, _ in items], q
        texts = [_chars(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(t.encode()))[0] for _, t in items]
        self.chars = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        gram, item, pos, w_item, w_pos, w_len = [], [], [], [], [], []
        for k, t in enumerate(texts):
            g = _grams(t, q)
            gram.append(g)
            item.append(np.full(len(g), k))
            pos.append(np.arange(len(g)))
            if len(t) >= q:
                last = max(0, len(t) - WINDOW)
                for s in sorted({*range(0, last + 1, STEP), last}):
                    w_item.append(k)
                    w_pos.append(s)
                    w_len.append(min(WINDOW, len(t)))
        gram = np.concatenate(gram) if gram else np.zeros(0, U)
        order = np.argsort(gram, kind="stable")
        self.keys, at = np.unique(gram[order], return_index=True)
        self.at = np.concatenate([at, [len(gram)]])
        self.item, self.pos = np.concatenate(item or [gram]).astype(np.int64)[order], np.concatenate(pos or [gram]).astype(np.int64)[order]
        self.w_item, self.w_pos, self.w_len = (np.array(v, np.int64) for v in (w_item, w_pos, w_len))
        self.of_item = np.searchsorted(self.w_item, np.arange(len(texts) + 1))
        self.edits = self.w_len * BUDGET // 100
        self.bound = self.w_len - q + 1 - self.edits * q  # above 0, by GRAMS
        self.shift = U(64 - min(26, max(12, len(self.keys).bit_length() + 5)))
        self.map = np.zeros(1 << int(U(64) - self.shift), bool)
        self.map[(self.keys * _KEY) >> self.shift] = True

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first character, one beyond the last, edits) of each window found."""
        if not len(self.keys):
            return []
        chars, starts = _chars(data, offsets)
        grams = _grams(chars, self.q)
        hit = np.flatnonzero(self.map[(grams * _KEY) >> self.shift])
        if not len(hit):
            return []
        key = np.minimum(np.searchsorted(self.keys, grams[hit]), len(self.keys) - 1)
        of = np.searchsorted(starts, hit, "right") - 1
        real = (self.keys[key] == grams[hit]) & (hit + self.q <= starts[of + 1])
        hit, key, of = hit[real], key[real], of[real]
        # dense runs: the least bound of hits within the longest region
        need, room = int(self.bound.min()), int((self.w_len + self.edits).max())
        if len(hit) < need:
            return []
        tight = (hit[need - 1:] - hit[: len(hit) - need + 1] < room) & (of[need - 1:] == of[: len(of) - need + 1])
        cover = np.zeros(len(hit) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(tight), 1)
        np.add.at(cover, np.flatnonzero(tight) + need, -1)
        dense = np.cumsum(cover[:-1]) > 0
        hit, key, of = hit[dense], key[dense], of[dense]
        if not len(hit):
            return []
        n = self.at[key + 1] - self.at[key]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.at[key], n)
        hit, of = np.repeat(hit, n), np.repeat(of, n)
        item, pos = self.item[at], self.pos[at]
        exact = self._excerpts(hit, of, item, pos)
        half = 2 * int(self.edits.max()) + 1
        longest = int(np.diff(self.first).max())
        band = (hit - starts[of] - pos + longest) // half + 1  # each band is two halves wide, so a hit is in two
        room = [len(starts), len(self.ids), int(band.max()) + 1, longest]
        group = (of * room[1] + item) * room[2] + band
        if room[0] * room[1] * room[2] * room[3] < 1 << 62:
            packed = np.concatenate([group, group - 1]) * room[3] + np.tile(pos, 2)
            packed.sort()
            packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]  # a position counts once a band
            group, where = packed // room[3], packed % room[3]
        else:
            both = np.unique(np.stack([np.concatenate([group, group - 1]), np.tile(pos, 2)], axis=1), axis=0)
            group, where = both[:, 0], both[:, 1]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([edge, [len(group)]]))
        edge, size = edge[size >= need], size[size >= need]
        regions = []
        for e, m in zip(edge.tolist(), size.tolist(), strict=True):
            g = int(group[e])
            i = g // room[2] % room[1]
            w = np.arange(self.of_item[i], self.of_item[i + 1])
            at = where[e: e + m]
            count = np.searchsorted(at, self.w_pos[w] + self.w_len[w] - self.q, "right") - np.searchsorted(at, self.w_pos[w])
            low = (g % room[2] - 1) * half - longest
            regions += [(int(c), g // room[2] // room[1], k, low) for k, c in zip(w.tolist(), count.tolist(), strict=True) if c >= self.bound[k]]
        # the fullest band of a window first; the others only where that doesn't stand
        regions.sort(reverse=True)
        good: dict = {}
        while regions:
            now, later, tried = [], [], set()
            for r in regions:
                (later if r[1:3] in tried else now).append(r)
                tried.add(r[1:3])
            good |= self._aligned(now, 2 * half, chars, starts)
            regions = [r for r in later if r[1:3] not in good]
        return [(t, int(self.w_item[k]), *v) for (t, k), v in good.items()] + [(t, i, a - int(starts[t]), b - int(starts[t]), 0) for t, i, a, b in exact]

    def _excerpts(self, hit: np.ndarray, of: np.ndarray, item: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first, last + 1) of runs of hits (ascending) that go on in text and item at once, from EXCERPT characters on."""
        least = EXCERPT - self.q + 1
        if len(hit) < least or int(np.diff(self.first).max()) < EXCERPT:
            return []
        line = of * len(self.ids) + item
        order = np.lexsort((hit, hit - pos, line))
        h, d, g = hit[order], (hit - pos)[order], line[order]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (h[1:] != h[:-1] + 1)])
        edge = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([edge, [len(h)]]))
        long = edge[size >= least]
        return [(int(t), int(i), int(a), int(a + n - 1 + self.q)) for t, i, a, n in zip(of[order][long], item[order][long], h[long], size[size >= least], strict=True)]

    def _aligned(self, regions: list, width: int, chars: np.ndarray, starts: np.ndarray) -> dict:
        """(text, window) -> (first, last + 1, edits), for the regions that keep the budget."""
        good = {}
        text, window, low = (np.array([r[k] for r in regions], np.int64) for k in (1, 2, 3))
        for m in np.unique(self.w_len[window]).tolist():
            some = np.flatnonzero(self.w_len[window] == m)
            w, t = window[some], text[some]
            most = int(self.edits[w[0]])
            begin = starts[t] + self.w_pos[w] + low[some] - most
            pattern = self.chars[(self.first[self.w_item[w]] + self.w_pos[w])[:, None] + np.arange(m)]
            edits, first, last = banded(pattern, chars, begin, starts[t], starts[t + 1], width + 2 * most, most)
            for k in np.flatnonzero(edits <= most).tolist():
                good[(int(t[k]), int(w[k]))] = (int(first[k] - starts[t[k]]), int(last[k] - starts[t[k]]), int(edits[k]))
        return good


def banded(patterns: np.ndarray, text: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern against any part of text[low:high], on `width` diagonals from `begin`.

    Returns edits (beyond `most` where there are more), first and last + 1 of the part.
    """
    far = most + 1
    step = np.arange(width)
    ends = begin[:, None] + step  # the text position before row 0, by diagonal
    low, high = low[:, None], high[:, None]
    cost = np.where((ends >= low) & (ends <= high), 0, far)
    start = ends.copy()
    rows = np.arange(len(ends))[:, None]
    for j in range(patterns.shape[1]):
        at = ends + j
        inside = (at >= low) & (at < high)
        same = inside & (text[np.where(inside, at, 0)] == patterns[:, j: j + 1])
        new, of = np.where(inside, cost + ~same, far), start
        up = np.full_like(cost, far)  # the pattern's character is left out
        up[:, :-1] = cost[:, 1:] + 1
        left = np.zeros_like(start)
        left[:, :-1] = start[:, 1:]
        of = np.where(up < new, left, of)
        new = np.minimum(new, up)
        # the text's characters are left out: least of new[i'] + (i - i') over i' <= i
        slack = new - step
        least = np.minimum.accumulate(slack, axis=1)
        of = of[rows, np.maximum.accumulate(np.where(slack == least, step, 0), axis=1)]
        cost = np.where((at + 1 >= low) & (at + 1 <= high), np.minimum(least + step, far), far)
        start = of
    k = cost.argmin(axis=1)
    rows = rows[:, 0]
    return cost[rows, k], start[rows, k], ends[rows, k] + patterns.shape[1]


def parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Part]:
    """The benchmark's items in parts of bounded size, by the q that suits their length."""
    held: dict[int, list] = {q: [] for _, q in GRAMS}
    size = dict.fromkeys(held, 0)
    for item, text in benchmark.select(F.col(item_col).cast("long"), text_col).where(F.length(text_col) > 0).toLocalIterator():
        q = next(q for least, q in GRAMS if len(text) >= least)
        held[q].append((item, text))
        size[q] += len(text)
        if size[q] >= PART:
            yield Part(held[q], q)
            held[q], size[q] = [], 0
    for q, rows in held.items():
        if rows:
            yield Part(rows, q)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first, last, edits, windows) of each text and each item found in it."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, first long, last long, edits long, windows long"
    out = spark.createDataFrame([], schema)
    for part in parts(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(part)

        def rows(batches, held=held):
            for batch in batches:
                for a, b, data, offsets in K.blocks(batch.column(1)):
                    by: dict = {}
                    for t, i, x, y, e in held.value.matches(data, offsets):
                        o = by.get((t, i), (x, y, e, 0))
                        by[(t, i)] = (min(o[0], x), max(o[1], y), min(o[2], e), o[3] + 1)
                    if by:
                        ids = batch.column(0).slice(a, b - a).take(pa.array([t for t, _ in by]))
                        items = [held.value.ids[i] for _, i in by]
                        yield pa.record_batch([ids, pa.array(items, pa.int64()), *(pa.array([v[k] for v in by.values()], pa.int64()) for k in range(4))], ["doc_id", "item_id", "first", "last", "edits", "windows"])

        out = out.union(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    where = docs.columns.index(text_col)
    for part in parts(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(part)

        def rows(batches, held=held):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in K.blocks(batch.column(where)):
                    keep[[a + m[0] for m in held.value.matches(data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
