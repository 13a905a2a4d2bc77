"""Exact set-similarity join on word shingles by partitioning the shingle universe.

A set is cut into segments by a hash of each shingle; the number of segments depends on the set's
size band. Sets whose Jaccard similarity reaches `num / den` differ in at most H shingles, H being
known for the band, so with H + 1 + slack segments at least 1 + slack of them are equal. Equal
segments share a signature. Segments without shingles say nothing and give no signature; a set with
more of those than the slack covers ("sparse") also publishes, in an index that only sparse sets
enter, its one-deletion neighbourhoods: a segment that may differ by one shingle counts twice. The
slack of each band is what makes the expected number of signatures least.

Candidates from small groups of equal signatures are all pairs. Large groups keep only sets that the
small ones can't speak for (see `_clogged`), and if they are still large give the pairs of a pivot only. Each candidate is checked against a sketch and then verified on the whole sets. Where
the members of a pivot still stand in several components, the links among them are settled by how
they differ from their consensus (see `_settled`), without forming their pairs. Members far from
their pivot go on to a pivot among themselves, one of the component that most of them belong to; what
is still left after ROUNDS such turns meets by its rarest elements.

Defined cases: null text or a text without words has no shingles, links with nothing and is its own
component; rows with a null id take part, and components are named by the smallest id that isn't
null; rows that repeat an id are rows of their own; an empty table gives an empty result; only the
two named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import kernels as K
from tidewater.llm.common import Steps, components, cut, release, ship

U = np.uint64
#: Groups up to this size give all their pairs: at most 3.5 a row.
SMALL = 8
#: Bits of the filter that keeps rows without a candidate out of verification: some for each wanted
#: row, up to 16 MB. Beyond 2 ** 24 wanted rows it lets more of the others pass, which costs the
#: shuffle of their sets and changes no result.
FILTER_SPARE, FILTER_MOST = 3, 27
#: Turns in which members far from their pivot get a new one.
ROUNDS = 2
#: Members of a large group that say what its consensus is, about.
POLLED = 32
#: Bands of lengths in the reach of one.
BANDS = 4
#: Bits of a signature beyond those that count the rows.
SPARE = 12


@functools.lru_cache(maxsize=8)
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size bands, and for each its number of segments and its slack.

    Bands are as wide as two steps of the similarity: wider ones need more segments, narrower ones
    let more sets stand in two bands; this width gives about the fewest signatures.
    """
    low = [next(n for n in range(1, 10**6) if n * den >= num * (n + 1))]  # smaller sets link only when equal
    while low[-1] < 1 << 32:
        low.append(max(low[-1] + 1, low[-1] * den * den // (num * num)))
    m, slack = [], []
    for lo, hi in zip(low, low[1:], strict=False):
        h = most_apart(hi - 1, (hi - 1) * den // num, num, den)
        best = None
        some = 0.015 * h + 1
        for c in sorted({*range(min(60, h // 4 + 2)), *(round(some + k * math.sqrt(some)) for k in range(20) if h > 16)}):
            k, cost = h + 1 + c, 0.0
            for n in (lo, (lo + hi) / 2, hi - 1):  # expected signatures of a set: its segments, or if sparse those and its deletions
                gone = math.exp(-n / k)
                sd = math.sqrt(max(k * gone * (1 - gone * (1 + n / k)), 1e-9))
                cost += k * (1 - gone) + 0.5 * math.erfc((c + 0.5 - k * gone) / sd / math.sqrt(2)) * (k + n)
            if best is None or cost < best[0]:
                best = cost, k, c
        m.append(best[1])
        slack.append(best[2])
    return np.array(low[:-1]), np.array(m), np.array(slack)


def most_apart(a, b, num: int, den: int):
    """How many shingles two sets of these sizes may not share and still reach num / den."""
    return (den - num) * (a + b) // (den + num)


def _class_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set, even and not negative: its lowest bit is free for a role."""
    n = np.diff(bounds).astype(U)
    return ((K.mix(K.segment_sums(K.mix(sets + U(77)), bounds) ^ (n << U(40))) >> U(2)) << U(1)).astype(np.int64)


def _segmented(sets: np.ndarray, bounds: np.ndarray, num: int, den: int) -> Iterator[tuple]:
    """For either role the sets that have it, their bands and numbers of segments, and each shingle's set, place and segment."""
    low, segments, _ = bands(num, den)
    n = np.diff(bounds)
    own = np.searchsorted(low, n, "right") - 1
    picked = K.mix(sets + U(3)) >> U(32)
    for role in (0, 1):
        band = own - role
        some = np.flatnonzero((own >= 0) & ((role == 0) | (band >= 0) & (n * num <= (low[own] - 1) * den)))
        if not len(some):
            continue
        size = n[some]
        m = segments[band[some]]
        first = np.concatenate([[0], np.cumsum(m)])
        owner = np.repeat(np.arange(len(some)), size)
        at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1] - bounds[some], size)
        key = first[owner] + ((picked[at] * m[owner].astype(U)) >> U(32)).astype(np.int64)
        yield role, some, band, m, first, owner, at, key, np.bincount(key, minlength=first[-1])


def _room(sets: np.ndarray, bounds: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """For either role how many segments of a set may say nothing, beside the empty ones; below 0 for sparse sets."""
    slack, out = bands(num, den)[2], [np.zeros(len(bounds) - 1, np.int64) for _ in (0, 1)]
    for role, some, band, _, first, _, _, _, count in _segmented(sets, bounds, num, den):
        out[role][some] = slack[band[some]] - np.add.reduceat(count == 0, first[:-1])
    return out


def _signatures(sets: np.ndarray, bounds: np.ndarray, cls: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signature, class with role) rows: role 1 marks a set that stands in the next smaller band."""
    slack, parts = bands(num, den)[2], K.mix(sets + U(5))
    for role, some, band, m, first, owner, at, key, count in _segmented(sets, bounds, num, den):
        total = np.zeros(first[-1], U)
        np.add.at(total, key, parts[at])
        place = np.repeat(band[some], m).astype(U) << U(40) | (np.arange(first[-1]) - np.repeat(first[:-1], m)).astype(U)
        full = count > 0
        name = (cls[some] | role)
        yield K.mix(total + K.mix(place))[full], np.repeat(name, m)[full]
        empty = np.add.reduceat(~full, first[:-1])
        sparse = empty > slack[band[some]]
        if not sparse.any():
            continue
        long = np.add.reduceat(count >= 2, first[:-1])
        helpless = sparse & (long < empty - slack[band[some]])  # its deletions don't make up for what is empty
        salt = U(0xA5A5A5A5A5A5A5A5)
        whole = (full | np.repeat(helpless, m)) & np.repeat(sparse, m)
        yield K.mix((total + K.mix(place)) ^ salt)[whole], np.repeat(name, m)[whole]
        less = sparse[owner] & (count[key] >= 2)
        yield K.mix((total[key[less]] - parts[at[less]] + K.mix(place[key[less]])) ^ salt), name[owner[less]]


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    for batch in batches:
        for a, b, data, offsets in K.blocks(batch.column(1)):
            sets, bounds = K.shingle_sets(data, offsets, shingle)
            yield batch.column(0).slice(a, b - a), sets, bounds, _class_of(sets, bounds)


def classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, cls, room, room_below): rows with equal sets share a class; null where there is no set."""

    def rows(batches):
        for ids, sets, bounds, cls in _sets(batches, shingle):
            n = np.diff(bounds)
            room = [pa.array(r) for r in _room(sets, bounds, num, den)]
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(n), pa.array(cls, mask=n == 0), *room], ["doc_id", "n_shingles", "cls", "room", "room_below"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, "doc_id long, n_shingles long, cls long, room long, room_below long")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int, bits: int = 64) -> DataFrame:
    """(sig, member): a task publishes the signatures of a class once, however many copies it reads."""

    def rows(batches):
        seen: set[int] = set()
        for _, sets, bounds, cls in _sets(batches, shingle):
            new = np.zeros(len(cls), bool)
            for k, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    new[k] = True
            keep = np.repeat(new, np.diff(bounds))
            sets, bounds, cls = sets[keep], np.concatenate([[0], np.cumsum(np.diff(bounds)[new])]), cls[new]
            for sig, member in _signatures(sets, bounds, cls, num, den):
                for k in range(0, len(sig), 100_000):
                    yield pa.record_batch([pa.array((sig[k: k + 100_000] >> U(64 - bits)).astype(np.int64)), pa.array(member[k: k + 100_000])], ["sig", "member"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, "sig long, member long")


def _runs(batches: Iterator[pa.RecordBatch], apart: bool = False) -> Iterator[pa.RecordBatch]:
    """(a, b, star) from rows sorted by signature: all pairs of small groups, or pivot and member of large ones.

    With `apart` large groups give signature and member, with its role, in place of pivot and member.

    A group may be longer than any memory: of one that goes beyond SMALL rows only the pivot is kept.
    Two sets that both stand in the next smaller band make no pair: they meet in their own.
    """

    def table(a, b, star):
        if star and apart:
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), True))], ["a", "b", "star"])
            return
        keep = (a >> 1) != (b >> 1) if star else ((a & b & 1) == 0) & ((a >> 1) != (b >> 1))
        a, b = a[keep] & ~1, b[keep] & ~1
        if not star:
            a, b = np.minimum(a, b), np.maximum(a, b)
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), star))], ["a", "b", "star"])

    held_s, held_m = np.zeros(0, np.int64), np.zeros(0, np.int64)
    pivot = None  # (signature, member) of a large group that goes on
    batches, done = iter(batches), False
    while not done:
        batch = next(batches, None)
        done = batch is None
        s = held_s if done else np.concatenate([held_s, batch.column(0).to_numpy()])
        m = held_m if done else np.concatenate([held_m, batch.column(1).to_numpy()])
        if len(s) > 1:
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (m[1:] != m[:-1])
            s, m = s[keep], m[keep]
        held_s, held_m = s[:0], m[:0]
        if pivot is not None and len(s):
            more = int(np.searchsorted(s, pivot[0], "right"))  # sorted, and its signature is the least
            yield from table(np.full(more, pivot[1]), m[:more], True)
            if more < len(s):
                pivot = None
            s, m = s[more:], m[more:]
        if not len(s):
            continue
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.concatenate([edge, [len(s)]]))
        goes_on = not done and size[-1] > SMALL
        if not done and size[-1] <= SMALL:  # the last group may go on
            held_s, held_m = s[edge[-1]:], m[edge[-1]:]
            s, m, edge, size = s[: edge[-1]], m[: edge[-1]], edge[:-1], size[:-1]
        few = np.repeat(size, size) <= SMALL
        for step in range(1, SMALL):
            i = np.flatnonzero(few[:-step] & (s[step:] == s[:-step])) if len(s) > step else few[:0]
            if not len(i):
                break
            yield from table(m[i], m[i + step], False)
        if few.all():
            continue
        # the pivot is the first that stands in its own band; a group without one makes no pairs
        if apart:
            yield from table(s[~few], m[~few], True)
            pivot = (s[-1], s[-1]) if goes_on else None
            continue
        own = np.minimum.reduceat(np.where(m & 1 == 0, np.arange(len(m)), len(m)), edge)
        head = np.repeat(own, size)
        big = np.flatnonzero(~few & (head < len(m)))
        yield from table(m[head[big]], m[big], True)
        if goes_on:
            pivot = (s[-1], m[own[-1]] if own[-1] < len(m) else m[edge[-1]])
            if own[-1] == len(m):  # those of its own band may follow: they meet the held ones around the pivot
                yield from table(np.full(size[-1], pivot[1]), m[edge[-1]:], True)


def _clogged(steps: Steps, large: DataFrame, sets: DataFrame) -> DataFrame:
    """The memberships (sig, member) of large groups that can hold a pair which no small group gives.

    Two linked sets have more equal segments than the slack of their band. A segment whose group is large may be
    left out like an empty one: a set with room for all of those still meets each set that it is linked with in a small
    group. So only sets without that room, in that role, go on; a common line alone doesn't make one. One segment more
    is asked for, as two of a set's own signatures may be equal by chance and count once.
    """
    most = F.when(F.col("member").bitwiseAND(1) == 0, F.col("room")).otherwise(F.col("room_below"))
    room = sets.select("cls", "room", "room_below").dropDuplicates(["cls"])
    held = large.groupBy("member").agg(F.count("*").alias("n")).withColumn("cls", F.shiftleft(F.shiftright("member", 1), 1))
    full = steps.cut(held.join(room, "cls").where(F.col("n") >= most).select("member"), "jaccard-clogged")
    return large.join(full, "member", "left_semi").select("sig", "member")


def _sketch(sets: np.ndarray) -> bytes:
    """Sums modulo 256 of the shingles' hashes by slot; the slots are a power of two, about twice the size.

    Halving the slots adds neighbours, so sketches of different sizes compare. Slots that differ
    are at most as many as the shingles that two sets don't share.
    """
    slots = 2 << max(0, round(math.log2(len(sets))))
    at = (K.mix(sets + U(11)) >> U(32)) * U(slots) >> U(32)
    return np.bincount(at.astype(np.int64), (K.mix(sets + U(13)) & U(255)).astype(np.float64), slots).astype(np.int64).astype(np.uint8).tobytes()


def _least_apart(p: np.ndarray, q: np.ndarray) -> int:
    """A lower bound of the shingles that two sets don't share, from their sketches."""
    while len(p) > len(q):
        p = p[::2] + p[1::2]
    while len(q) > len(p):
        q = q[::2] + q[1::2]
    return int(np.count_nonzero(p != q))


def _mask(wanted: DataFrame):
    """A broadcast filter of the wanted classes (cls, rep)."""
    n = min(FILTER_MOST, max(16, wanted.count().bit_length() + FILTER_SPARE))
    slot = F.shiftright("cls", 1).bitwiseXOR(F.col("rep")).bitwiseAND(F.lit((1 << n) - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    got = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** (n - 6) rows
    mask = np.zeros(1 << (n - 6), np.int64)
    mask[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(mask)


def _wanted_sets(batches: Iterator[pa.RecordBatch], mask, shingle: int) -> Iterator[tuple]:
    """(row ids, sets, bounds, classes, rows that pass the filter) of blocks of texts."""
    hit = mask.value
    for key, sets, bounds, cls in _sets(batches, shingle):
        key = pc.fill_null(key, 0).to_numpy(zero_copy_only=False)
        slot = ((cls >> 1) ^ key) & (len(hit) * 64 - 1)
        yield key, sets, bounds, cls, np.flatnonzero((np.diff(bounds) > 0) & ((hit[slot >> 6] >> (slot & 63)) & 1 == 1))


def _read_classes(steps: Steps, docs: DataFrame, wanted: DataFrame, name: str, of, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(cls, n, name) of the wanted classes (cls, rep), as a written table: `of` is applied to the set of row `rep`."""
    mask = _mask(wanted)

    def rows(batches):
        for key, sets, bounds, cls, some in _wanted_sets(batches, mask, shingle):
            if len(some):
                yield pa.record_batch([pa.array(cls[some]), pa.array(key[some]), pa.array(np.diff(bounds)[some]), pa.array([of(sets[bounds[k]: bounds[k + 1]]) for k in some], pa.binary())], ["cls", "rep", "n", name])

    made = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, f"cls long, rep long, n long, {name} binary")
    made = steps.cut(made.join(wanted, ["cls", "rep"], "left_semi").select("cls", "n", name).dropDuplicates(["cls"]), f"jaccard-{name}")
    mask.destroy()
    return made


def _bytes(v: np.ndarray) -> bytes:
    return v.tobytes()


def _with_reps(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(cls, rep): the row that stands for each of the classes."""
    return classes.distinct().join(found, "cls").select("cls", F.coalesce("rep", F.lit(0)).alias("rep"))


def near_pairs(pairs: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes (a, b) that their sketches don't rule out."""
    both = pairs.join(sketched.toDF("a", "na", "x"), "a").join(sketched.toDF("b", "nb", "y"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    def near(batches):
        for batch in batches:
            a, b, x, y, na, nb = (batch.column(k) for k in range(6))
            most = most_apart(na.to_numpy(), nb.to_numpy(), num, den)
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                good[k] = _least_apart(np.frombuffer(x[k].as_buffer(), np.uint8), np.frombuffer(y[k].as_buffer(), np.uint8)) <= most[k]
            yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y", "na", "nb").mapInArrow(near, "a long, b long")


def linked(pairs: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets reach num / den."""
    both = pairs.join(items.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")

    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                z = np.concatenate([np.frombuffer(x[k].as_buffer(), U), np.frombuffer(y[k].as_buffer(), U)])
                z.sort()
                same = int((z[1:] == z[:-1]).sum())
                good[k] = same * den >= num * (len(z) - same)
            yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def _far_pairs(steps: Steps, members: DataFrame, items: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the members (cls) that may be linked and stand in different components.

    Elements are in one order: first those that no two components share, which make no pairs, then
    the others by how many sets hold them. Sets whose first shared element stands at ranks r and q
    share at most 1 + min(n - r, k - q) elements, so only ranks where that reaches the bound meet.
    Counts are exact at any size: they are an aggregate and never leave the executors.
    """
    sets = steps.cut(items.join(members, "cls", "left_semi").join(label.toDF("cls", "l"), "cls", "left").select("cls", F.coalesce("l", "cls").alias("l"), "n", "items"), "jaccard-far")

    def elements(batches):
        for batch in batches:
            x, label_of, n = (batch.column(k).to_numpy() for k in range(3))
            ends = np.cumsum(n)
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends // 100_000)) + 1):
                if len(at):
                    e = np.concatenate([np.frombuffer(batch.column(3)[k].as_buffer(), np.int64) for k in at])
                    yield pa.record_batch([pa.array(e), *(pa.array(np.repeat(v[at], n[at])) for v in (x, label_of, n))], ["e", "x", "l", "n"])

    held = sets.select("cls", "l", "n", "items").mapInArrow(elements, "e long, x long, l long, n long")
    shared = held.groupBy("e").agg(F.count("*").alias("c"), F.min("l").alias("low"), F.max("l").alias("high")).where("low <> high").select("e", "c")
    of = Window.partitionBy("x")  # the elements of one set
    rank = F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("c", "e"))
    ranked = steps.cut(held.join(shared, "e").withColumn("r", rank).where((F.lit(1) + F.col("n") - F.col("r")) * den >= F.col("n") * num).select("e", "x", "l", "n", "r"), "jaccard-firsts")
    other = ranked.toDF("e", "y", "m", "k", "q")
    most = F.lit(1) + F.least(F.col("n") - F.col("r"), F.col("k") - F.col("q"))
    pairs = ranked.join(other, "e").where((F.col("x") < F.col("y")) & (F.col("l") != F.col("m")) & (most * (num + den) >= (F.col("n") + F.col("k")) * num))
    return steps.cut(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "jaccard-far-pairs")


def _settled(steps: Steps, asked: DataFrame, items: DataFrame, label: DataFrame, sketched: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b), pairs left to verify, and far members (p, x), of pivots and members (p, x).

    A member x is near its pivot if they differ in at most half as many elements as x has; members
    that differ in more than (1.5 * den - num) / num times as many can't be linked to near ones, so
    they only ask for each other: they are far. Those between are asked for both ways.

    Around a pivot p the members are told by how they differ from their consensus: p, with every
    shingle flipped in which most of some members differ from it. With d the size of that difference
    and s = (den + num) * d - (den - num) * n, two members x and y that share o elements of their
    differences are linked exactly if s(x) + s(y) <= 2 * (den + num) * o, whatever the consensus. So
    with the member m of the least s, all x with s(x) + s(m) <= 0 are linked to it, and no pair
    beyond them is linked unless it shares elements; such pairs are found by the rarest elements, as
    many as the bound asks for.
    """

    def bounded(batches):  # sketches tell most members that are too far without reading their sets
        for batch in batches:
            p, x, n, of_p, of_x = (batch.column(k) for k in range(5))
            least = np.array([_least_apart(np.frombuffer(of_p[k].as_buffer(), np.uint8), np.frombuffer(of_x[k].as_buffer(), np.uint8)) for k in range(batch.num_rows)], np.int64)
            yield pa.record_batch([p, x, pa.array(2 * num * least > (3 * den - 2 * num) * n.to_numpy())], ["p", "x", "far"])

    both = asked.join(sketched.toDF("x", "n", "of_x"), "x").join(sketched.toDF("p", "n_p", "of_p"), "p")
    told = steps.cut(both.select("p", "x", "n", "of_p", "of_x").mapInArrow(bounded, "p long, x long, far boolean"), "jaccard-told")
    near = told.where("not far").drop("far")

    def differ(batches):
        for batch in batches:
            p, x, n, of_p, of_x = (batch.column(k) for k in range(5))
            made, far = [], np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                z = np.concatenate([np.frombuffer(of_p[k].as_buffer(), U), np.frombuffer(of_x[k].as_buffer(), U)])
                z.sort()
                twice = np.flatnonzero(z[1:] == z[:-1])
                alone = np.ones(len(z), bool)
                alone[twice] = alone[twice + 1] = False
                d = z[alone].astype(np.int64)
                far[k] = 2 * len(d) > n[k].as_py()
                made.append(None if 2 * num * len(d) > (3 * den - 2 * num) * n[k].as_py() else d)
            yield pa.record_batch([p, x, n, pa.array(far), pa.array(made, pa.list_(pa.int64()))], ["p", "x", "n", "far", "delta"])

    both = near.join(items.select(F.col("cls").alias("x"), "n", F.col("items").alias("of_x")), "x").join(items.select(F.col("cls").alias("p"), F.col("items").alias("of_p")), "p")
    delta = steps.cut(both.select("p", "x", "n", "of_p", "of_x").mapInArrow(differ, "p long, x long, n long, far boolean, delta array<long>"), "jaccard-delta")
    far = told.where("far").select("p", "x").union(delta.where("far").select("p", "x"))
    delta = delta.where("delta is not null").drop("far")
    # groups in which all those that are asked for stand in one component have nothing to settle
    of = delta.select("p", "x").join(label.toDF("x", "l"), "x", "left").groupBy("p").agg(F.min(F.coalesce("l", "x")).alias("low"), F.max(F.coalesce("l", "x")).alias("high"))
    delta = delta.join(of.where("low <> high").select("p"), "p", "left_semi")
    size = delta.groupBy("p").agg(F.count("*").alias("k"))
    # the consensus is that of some POLLED members: it decides how short the differences are, not what is found
    polled = delta.join(size, "p").where(F.pmod(F.xxhash64("p", "x"), F.greatest(F.lit(1), (F.col("k") / POLLED).cast("long"))) == 0)
    size = polled.groupBy("p").agg(F.count("*").alias("k"))
    flips = polled.select("p", F.explode("delta").alias("e")).groupBy("p", "e").agg(F.count("*").alias("c")).join(size, "p").where("2 * c > k").groupBy("p").agg(F.collect_list("e").alias("flip"))  # at most twice a mean difference
    none = F.array().cast("array<bigint>")
    delta = delta.join(flips, "p", "left").withColumn("flip", F.coalesce("flip", none))
    delta = delta.select("p", "x", "n", F.concat(F.array_except("delta", "flip"), F.array_except("flip", "delta")).alias("delta"))
    weight = den + num
    delta = steps.cut(delta.withColumn("s", weight * F.size("delta") - (den - num) * F.col("n")), "jaccard-consensus")
    mid = delta.groupBy("p").agg(F.min(F.struct("s", "x")).alias("m")).select("p", F.col("m.s").alias("sm"), F.col("m.x").alias("m"))
    delta = steps.cut(delta.join(mid, "p"), "jaccard-middle")
    sure = (delta.where("s + sm <= 0 and x <> m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct())
    delta = delta.join(label.toDF("x", "lx"), "x", "left").join(label.toDF("m", "lm"), "m", "left")
    delta = delta.select("p", "x", "n", "s", F.coalesce("lx", "x").alias("l"), F.size("delta").alias("d"), "delta", ((F.col("s") + F.col("sm") > 0) & (F.coalesce("lx", "x") != F.coalesce("lm", "m"))).alias("asks"))
    delta = delta.join(delta.where("asks").select("p").distinct(), "p", "left_semi")
    # linked sets differ in length of their differences by (den - num) / weight of their sizes at most: each asks the
    # bands of lengths in reach, and how many elements they have to share follows from the least s of a band
    wide = F.floor(2 * F.max("n") * (den - num) / weight)
    step = F.greatest(F.lit(1), F.floor(wide / BANDS))
    delta = steps.cut(delta.join(delta.groupBy("p").agg(step.alias("step"), (F.floor(wide / step) + 1).alias("reach")), "p").withColumn("band", F.floor(F.col("d") / F.col("step"))), "jaccard-banded")
    near_bands = F.explode(F.sequence(F.greatest(F.lit(0), F.col("band") - F.col("reach")), F.col("band") + F.col("reach"))).alias("to")
    low = steps.cut(delta.groupBy("p", "band", "reach").agg(F.min("s").alias("low"), F.min(F.when(F.col("asks"), F.col("s"))).alias("low_asks")), "jaccard-bands")
    need = lambda other: F.greatest(F.lit(1), F.ceil((F.col("s") + F.col(other)) / (2 * weight)))
    probes = delta.where("asks").select("p", "x", "d", "s", near_bands).join(low.select("p", F.col("band").alias("to"), "low"), ["p", "to"])
    probes = steps.cut(probes.select("p", "x", "to", (F.col("d") - need("low") + 1).alias("first")).where("first > 0"), "jaccard-probes")
    asked_by = low.where("low_asks is not null").select("p", near_bands, "low_asks").groupBy("p", F.col("to").alias("band")).agg(F.min("low_asks").alias("low_asks"))
    delta = delta.join(asked_by, ["p", "band"], "left").join(probes.groupBy("p", "x").agg(F.max("first").alias("probe")), ["p", "x"], "left")
    delta = delta.select("p", "x", "l", "d", "s", "band", F.coalesce(F.col("d") - need("low_asks") + 1, F.lit(0)).alias("index"), F.coalesce("probe", F.lit(0)).alias("probe"), F.explode("delta").alias("e"))
    delta = steps.cut(delta, "jaccard-elements")
    often = delta.groupBy("p", "e").agg(F.count("*").alias("c"))
    ranked = delta.join(often, ["p", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("p", "x").orderBy("c", "e"))).where("c > 1 and rank <= greatest(index, probe)")
    ranked = steps.cut(ranked, "jaccard-ranked")
    left = ranked.where("rank <= probe").join(probes, ["p", "x"]).where("rank <= first").select("p", "e", F.col("to").alias("band"), F.col("x").alias("x1"), F.col("l").alias("l1"), F.col("s").alias("s1"), F.col("d").alias("d1"), F.col("rank").alias("r1"))
    right = ranked.where("rank <= index").select("p", "e", "band", F.col("x").alias("x2"), F.col("l").alias("l2"), F.col("s").alias("s2"), F.col("d").alias("d2"), F.col("rank").alias("r2"))
    # what two members share lies in front of an element that they share, is it, or lies behind it
    shared = F.least("r1", "r2") + F.least(F.col("d1") - F.col("r1"), F.col("d2") - F.col("r2"))
    rest = left.join(right, ["p", "e", "band"]).where((F.col("l1") != F.col("l2")) & (F.col("s1") + F.col("s2") <= 2 * weight * shared))
    rest = rest.select(F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b")).distinct()
    return sure, steps.cut(rest, "jaccard-pairs"), far


def _around_pivots(steps: Steps, stars: DataFrame, items: DataFrame, label: DataFrame, sketched: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs left to verify, among the members (p, x) of groups.

    Each turn settles what is near a pivot; the far members of a group get a pivot of their own, so a
    turn costs one comparison a member. Groups that are down to one component are done.
    """
    none = stars.select(F.col("p").alias("a"), F.col("x").alias("b")).limit(0)
    sure, rest, asked = none, none, stars
    for turn in range(ROUNDS):
        links, pairs, far = _settled(steps, asked, items, label, sketched, num, den)
        sure, rest = sure.union(links), rest.union(pairs)
        far = steps.cut(far.join(label.toDF("x", "l"), "x", "left").select("p", "x", F.coalesce("l", "x").alias("l")), "jaccard-far-members")
        kinds = far.groupBy("p", "l").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("x", F.lit(turn)).alias("h"), "x")).alias("least"))
        heads = kinds.groupBy("p").agg(F.max(F.struct("n", "least.h", "least.x")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("p", F.col("m.x").alias("q"))
        asked = steps.cut(far.join(heads, "p").select(F.col("q").alias("p"), "x").distinct(), "jaccard-asked")
        if asked.isEmpty():
            return sure, rest.distinct()
    return sure, rest.union(_far_pairs(steps, asked.select(F.col("x").alias("cls")).distinct(), items, label, num, den)).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5, with_class: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of `docs`.

    component_id is the smallest id reachable over links of similarity num / den or more; n_links is
    a lower bound of the row's links to other sets: links inside a component that is already known
    need no proof.
    """
    spark = docs.sparkSession
    ship(spark)
    steps = Steps(spark)
    rows = cut(classes(docs, id_col, text_col, shingle, num, den), "jaccard-classes")
    sets = rows.where("cls is not null")
    found = sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"))
    # signatures get as many bits as the rows call for: one in 2 ** SPARE rows meets a stranger
    most = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    signed = signatures(docs, id_col, text_col, shingle, num, den, min(64, max(32, int(most).bit_length() + SPARE)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = lambda rows, apart: rows.repartition(parts, "sig").sortWithinPartitions("sig", "member").mapInArrow(lambda b: _runs(b, apart), "a long, b long, star boolean").distinct()
    grouped = steps.cut(runs(signed, True), "jaccard-groups")
    release(spark)
    grouped = grouped.where("not star").union(steps.cut(runs(_clogged(steps, grouped.where("star").select(F.col("a").alias("sig"), F.col("b").alias("member")), sets), False), "jaccard-groups"))
    read = lambda of, name, kind: _read_classes(steps, docs, steps.cut(_with_reps(of, found), "jaccard-wanted"), name, kind, id_col, text_col, shingle)
    tested = steps.cut(grouped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    sketched = read(tested.select(F.explode(F.array("a", "b")).alias("cls")), "sketch", _sketch)
    near = steps.cut(near_pairs(tested, sketched, num, den), "jaccard-candidates")
    items = read(near.select(F.explode(F.array("a", "b")).alias("cls")), "items", _bytes)
    links = cut(linked(near, items, num, den), "jaccard-links")
    release(spark)
    label = components(links, "jaccard-components")
    stars = grouped.where("star").select("a", "b")
    mixed = stars.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a").distinct()
    stars = steps.cut(stars.join(mixed, "a", "left_semi").union(mixed.select("a", F.col("a").alias("b"))).toDF("p", "x"), "jaccard-stars")
    if not stars.isEmpty():
        items = read(stars.select(F.col("x").alias("cls")), "items", _bytes)  # a pivot is a member of its group
        sure, rest = _around_pivots(steps, stars, items, label, sketched, num, den)
        rest = steps.cut(near_pairs(rest.join(tested, ["a", "b"], "left_anti"), sketched, num, den), "jaccard-candidates")
        links = cut(links.union(sure).union(linked(rest, items, num, den)).distinct(), "jaccard-links")
        label = components(links, "jaccard-components")
    steps.clear()
    release(spark)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    named = found.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    low = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = named.join(low, "label").join(degree, "cls", "left").select("cls", "component_id", "n_links", "label")
    return rows.join(of, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        *(["cls", "label"] if with_class else []))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of `docs` for each component, that of its smallest id; all columns are carried.

    Rows without shingles are alone and all stay. Where ids are unique and not null, only the ids of
    the rows that go are matched. Else rows are told apart by id and set, and of rows alike in both
    one stays.
    """
    joined = cut(jaccard_components(docs, id_col, text_col, shingle, num, den, with_class=True), "jaccard-joined")
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("body"))
    back = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    if joined.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("key"))
        return plain.drop("body").join(gone, "key", "left_anti").select(*back)
    best = joined.where("cls is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("x")).select(F.col("x.doc_id").alias("key"), F.col("x.cls").alias("cls"))

    def rows(batches):
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(2)):
                sets, bounds = K.shingle_sets(data, offsets, shingle)
                cls = pa.array(_class_of(sets, bounds), mask=np.diff(bounds) == 0)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), cls], ["doc", "key", "cls"])

    kinds = plain.drop("body").schema.add("cls", "long")
    told = plain.mapInArrow(rows, kinds)
    best = best.withColumnsRenamed({"key": "k", "cls": "c"})
    one = told.join(best, told["key"].eqNullSafe(best["k"]) & (told["cls"] == best["c"])).dropDuplicates(["key", "cls"])
    return told.where("cls is null").select(*back).union(one.select(*back))
