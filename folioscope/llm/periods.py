"""Periodic runs of words, found by uniting suffix classes in descending order of their common length.

The suffixes of a text's words are ordered by doubling ranks (1, 2, 4, ... words),
and the common length of neighbours in that order is read off the stored ranks,
so every comparison is of word numbers and exact.  Going down the common lengths
as Kruskal's algorithm goes along edges, neighbouring classes are united by
union-find; every class keeps its positions in order, the smaller list going into
the larger.  Two positions that become neighbours in a list agree for exactly the
length of the edge.  If that is at least ``times - 1`` times their distance, the
distance is the smallest period of a run: a position between them with the same
beginning would have joined the class before.

Texts are worked on by tasks alone; nothing is shuffled and no text meets another.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.binding import bind
from folioscope.llm.arrays import SPACED, Words, loose, text_portions


def word_numbers(words: Words) -> np.ndarray:
    """Equal words have equal numbers; words are compared by their bytes."""
    length = words.end - words.start
    body = words.data[words.inside]
    bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))])
    return np.asarray(column.dictionary_encode().indices, dtype=np.int64)


class SuffixRanks:
    """Ranks of all stretches of 2**k words; stretches never leave their text."""

    def __init__(self, numbers: np.ndarray, bounds: np.ndarray, least: int):
        sizes = np.diff(bounds)
        self.end = np.repeat(bounds[1:], sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        count = len(numbers)
        kinds = int(numbers.max()) + 1 if count else 1
        rank = np.zeros(count, np.int64)
        self.rank, open_ = rank, self._split(rank, np.arange(count), text * kinds + numbers, np.zeros(count, np.int64))
        self.wide: list[np.ndarray] = [rank.astype(np.int32 if count < 2**31 else np.int64)]
        step = 1
        while 2 * step <= least:
            open_ = self._double(open_, step)
            step *= 2
            self.wide.append(rank.astype(self.wide[0].dtype))
        #: Positions whose first ``step`` words occur again in their text; the rest can be in no run.
        self.active = np.sort(open_)
        self.family = rank[self.active]
        self.slot = np.full(count, -1, self.wide[0].dtype)
        self.slot[self.active] = np.arange(len(self.active))
        self.deep: list[np.ndarray] = []
        while len(open_):
            open_ = self._double(open_, step)
            step *= 2
            self.deep.append(rank[self.active].astype(self.wide[0].dtype))

    @staticmethod
    def _split(rank: np.ndarray, at: np.ndarray, second: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Give the positions ``at`` ranks by (first, second); those that still share theirs are returned."""
        if not len(at):
            return at
        order = np.lexsort((second, first)) if first.any() else np.argsort(second, kind="stable")
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = a[1:] != a[:-1]
        place = np.arange(len(order))
        group = np.maximum.accumulate(np.where(new, place, 0))
        new[1:] |= b[1:] != b[:-1]
        part = np.maximum.accumulate(np.where(new, place, 0))
        rank[at[order]] = a + part - group
        alone = new & np.append(new[1:], True)
        return at[order[~alone]]

    def _double(self, open_: np.ndarray, step: int) -> np.ndarray:
        onward = open_ + step
        inside = onward < self.end[open_]
        second = np.zeros(len(open_), np.int64)
        second[inside] = self.rank[onward[inside]] + 1
        return self._split(self.rank, open_, second, self.rank[open_])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b of one text have in common."""
        agreed = np.zeros(len(a), np.int64)
        for level in range(len(self.wide) + len(self.deep) - 1, -1, -1):
            step = 1 << level
            fits = np.maximum(a, b) + agreed + step <= self.end[a]
            x, y = (a + agreed)[fits], (b + agreed)[fits]
            if level < len(self.wide):
                same = self.wide[level][x] == self.wide[level][y]
            else:
                ranks, x, y = self.deep[level - len(self.wide)], self.slot[x], self.slot[y]
                same = (x >= 0) & (y >= 0)
                same[same] = ranks[x[same]] == ranks[y[same]]
            agreed[np.flatnonzero(fits)[same]] += step
        return agreed


def _seeds(place: list[int], edge: list[int], common: list[int], least: int, times: int) -> tuple[list[int], list[int], list[int]]:
    """(left position, distance, common words) of positions that become neighbours and are close enough for a run.

    ``place`` lists positions in the order of their suffixes; edge e joins the
    entries e and e + 1, and edges come by descending common length.
    """
    parent = list(range(len(place)))
    members = [[p] for p in place]
    starts, gaps, lengths = [], [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def meet(left: int, right: int, agreed: int) -> None:
        gap = right - left
        if agreed >= (times - 1) * gap and agreed + gap >= least:
            starts.append(left)
            gaps.append(gap)
            lengths.append(agreed)

    for e, agreed in zip(edge, common, strict=True):
        a, b = root(e), root(e + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        many, few = members[a], members[b]
        parent[b] = a
        members[b] = few if a == b else []
        for k, p in enumerate(few):
            at = bisect_left(many, p)
            if at and (k == 0 or few[k - 1] < many[at - 1]):
                meet(many[at - 1], p, agreed)
            if at < len(many) and (k + 1 == len(few) or few[k + 1] > many[at]):
                meet(p, many[at], agreed)
        if 8 * len(few) < len(many):
            for p in few:
                insort(many, p)
        else:
            many += few
            many.sort()
    return starts, gaps, lengths


def runs_of(numbers: np.ndarray, bounds: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start and period.

    ``numbers`` are the words of all texts in a row, text i those of
    ``bounds[i]`` to ``bounds[i + 1]``.
    """
    shared = min(max(least - q, (times - 1) * q, 1) for q in range(1, max(least, 1) + 1))
    ranks = SuffixRanks(numbers, bounds, shared)
    place = ranks.active[np.argsort(ranks.rank[ranks.active], kind="stable")]
    family = ranks.family[ranks.slot[place]]
    edge = np.flatnonzero(family[1:] == family[:-1])
    common = ranks.common(place[edge], place[edge + 1])
    usable = common >= shared
    edge, common = edge[usable], common[usable]
    order = np.argsort(-common, kind="stable")
    start, period, agreed = (np.array(x, np.int64) for x in _seeds(place.tolist(), edge[order].tolist(), common[order].tolist(), least, times))
    if len(start):
        first = bounds[np.searchsorted(bounds, start, side="right") - 1]
        opens = (start == first) | (numbers[start - 1] != numbers[start - 1 + period])
        start, period, agreed = start[opens], period[opens], agreed[opens]
    order = np.lexsort((period, start))
    return start[order], (agreed + period)[order], period[order]


def collapsed(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    chosen = np.flatnonzero(kept)
    length = words.end[chosen] - words.start[chosen] + 1
    begin = np.cumsum(length) - length
    total = int(length.sum())
    out = np.full(total, 32, np.uint8)
    place = np.arange(total)
    inner = np.ones(total, bool)
    inner[begin + length - 1] = False
    source = place + np.repeat(words.start[chosen] - begin, length)
    out[inner] = words.data[source[inner]]
    # the space after a text's last word goes
    number = np.concatenate(([0], np.cumsum(kept)))[words.bounds]
    last = number[1:][number[1:] > number[:-1]] - 1
    drop = np.zeros(total, bool)
    drop[(begin + length - 1)[last]] = True
    ends = np.concatenate(([0], np.cumsum(length)))[number] - np.concatenate(([0], np.cumsum(number[1:] > number[:-1])))
    return out[~drop], ends


_FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept binary"


def _finder(least: int, times: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = loose(batch.column("row"))
            for low, high, data, offsets in text_portions(batch.column("body")):
                words = Words(data, offsets, SPACED)
                start, length, period = runs_of(word_numbers(words), words.bounds, least, times)
                text = np.searchsorted(words.bounds, start, side="right") - 1
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                body, ends = collapsed(words, np.cumsum(change[:-1]) == 0)
                structs = pa.StructArray.from_arrays([pa.array(start - words.bounds[text]), pa.array(length), pa.array(period)], fields=list(run))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.bounds).astype(np.int32)), structs)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([rows.slice(low, high - low), pa.array(np.diff(words.bounds)), lists, kept.cast(pa.binary())], ["row", "n_words", "runs", "kept"])

    return work


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, least: int = 24, times: int = 3
) -> DataFrame:
    """Runs of every text, and the text without their repetitions: row, n_words, runs, kept.

    Words are what white space (the six ASCII characters) separates.  A run is
    a stretch of at least ``least`` words and ``times`` periods that no
    neighbouring word extends with its smallest period; ``runs`` has its start
    (counted from 0), length and period, by start and period.  ``kept`` joins
    by one space the words that no run contains after its first period.

    ``row`` is a struct of the ``carry`` columns (the id alone if none are
    named), so their names clash with nothing.  A NULL text, an empty one and
    one of white space have no words, no runs and an empty ``kept``.  Each row
    is looked at by itself, so repeated rows and rows without id have results
    of their own; an empty table gives an empty result.
    """
    if least < 1 or times < 2:
        raise ValueError("a run has at least one word and two periods")
    given = docs.select(F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    return given.mapInArrow(_finder(least, times), f"row {given.schema['row'].dataType.simpleString()}, {_FOUND}")


_SPLIT = r"[^\x20\x09-\x0D]+"


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which the text of one document in ten becomes periodic from some word on.

    With h the CRC-32 of the id in decimal and g = h div 10, a document with h
    divisible by 10 repeats, from word g mod n on, the period of
    1 + (n - a) div (3 + g mod 8) words that begins there.  Documents without
    id, or without words, stay as they are.
    """
    hashed = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(hashed / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        from_ = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, period))
        planted = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, from_(i)))
        return F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col(text_col))

    edited = bind(F.regexp_extract_all(F.col(text_col), F.lit(_SPLIT), F.lit(0)), rewritten)
    chosen = (hashed % 10 == 0) & F.col(text_col).isNotNull()
    return docs.withColumn(text_col, F.when(chosen, edited).otherwise(F.col(text_col)))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run with most repetitions, and hashes of all runs and of the kept words."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    listed = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    text = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    best = found.select("*", F.aggregate("runs", none, better).alias("best"))
    return best.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
