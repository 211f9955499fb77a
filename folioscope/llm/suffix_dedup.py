"""Removal of repeated substrings by a hash-compared suffix sort.

Every byte that lies in a ``length``-byte string which also starts in a
document with a smaller id is removed.  The work is spread as follows.

1. Each window of ``length`` bytes belongs to one anchor, the first smallest
   ``anchor``-gram in it, so equal windows have equal anchors.  A batch sends
   the hashes of its anchors to buckets; a bucket answers which of them occur
   in more than one document.
2. For those, the batch sends the bytes around the anchor that hold all its
   windows, equal ones once with the smallest id.  A bucket sorts them as
   suffixes (``suffix_sort``), first as a whole, then, where an anchor has
   different surroundings, window by window, and answers with the smallest
   document of each window.
3. The batch marks the bytes of windows that a smaller document has.

An anchor with many different surroundings (a line that a third of all documents
hold) would fill one bucket with entries.  Such runs are cut into windows, each
of which is an entry of its own and goes to the bucket that its hash names.

A batch is a function of the document, so an answer finds its way back to
the rows it is about, and a group of copies costs one entry for each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import U64, flat, give_back, loose, mix, portions, powers, prefix_hashes
from folioscope.llm.shared import BATCH_BYTES, batch_count, in_batches
from folioscope.llm.suffix_sort import Suffixes

NO_ID = np.iinfo(np.int64).max
_REACH = 1 << 19
#: An anchor with more different surroundings than this is dealt out window by window.
HOT = 10_000
_PLACE_BITS = U64(22)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


class Runs:
    """Runs of windows that share an anchor: where they lie and what they hold.

    ``first``/``last`` are the first windows' start bytes, ``place`` the
    distance of the anchor from ``first``, ``anchor`` and ``content`` hashes of
    the anchor and of the bytes of all windows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        width = length - anchor + 1
        parts = []
        # Cuts depend on the documents alone, so that every pass finds the same runs whatever the order of rows.
        for low, high in portions(offsets, _REACH):
            begin, end = int(offsets[low]), int(offsets[high])
            if end - begin <= _REACH:
                parts.append(self._part(data[begin:end], offsets[low : high + 1] - begin, length, anchor, width, begin))
                continue
            for at in range(begin, end - length + 1, _REACH):
                stop = min(at + _REACH + length - 1, end)
                parts.append(self._part(data[at:stop], np.array([0, stop - at]), length, anchor, width, at))
        parts = [p for p in parts if p is not None]
        names = ("first", "last", "place", "anchor", "content")
        for name, kind, at in zip(names, (np.int64, np.int64, np.int64, U64, U64), range(5), strict=True):
            setattr(self, name, np.concatenate([p[at] for p in parts]) if parts else np.zeros(0, kind))
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1

    @staticmethod
    def _part(data, offsets, length, anchor, width, shift):
        windows = len(data) - length + 1
        if windows <= 0:
            return None
        prefix, undo = prefix_hashes(data), powers(len(data) + 1, inverse=True)
        grams = mix((prefix[anchor:] - prefix[:-anchor]) * undo[: len(data) - anchor + 1])
        keys = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=U64)
        at = (_sliding_least(keys, width)[:windows] & U64((1 << 22) - 1)).astype(np.int64)
        # windows that cross the end of a document count as their own, unusable run
        ends = offsets[1:]
        begins = np.clip(np.maximum(offsets[:-1], offsets[1:] - length + 1), 0, windows)
        crossing = np.zeros(windows + 1, np.int64)
        filled = offsets[1:] > offsets[:-1]
        np.add.at(crossing, begins[filled], 1)
        np.add.at(crossing, np.minimum(ends, windows)[filled], -1)
        usable = np.cumsum(crossing[:-1]) == 0
        starts = np.ones(windows, bool)
        starts[1:] = (at[1:] != at[:-1]) | (usable[1:] != usable[:-1])
        inner = offsets[(offsets > 0) & (offsets < windows)]
        starts[inner] = True
        first = np.flatnonzero(starts)
        last = np.append(first[1:], windows) - 1
        good = usable[first]
        first, last = first[good], last[good]
        end = last + length
        content = (prefix[end] - prefix[first]) * undo[first]
        return first + shift, last + shift, at[first] - first, grams[at[first]], mix(content)

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("first", "last", "place", "anchor", "content", "doc"):
            setattr(self, name, getattr(self, name)[chosen])

    def split(self, chosen: np.ndarray, data: np.ndarray, length: int) -> None:
        """Cut the chosen runs into windows, each with an anchor made of its own bytes."""
        if not chosen.any():
            return
        windows = (self.last - self.first + 1)[chosen]
        begin = np.cumsum(windows) - windows
        first = np.repeat(self.first[chosen] - begin, windows) + np.arange(int(windows.sum()))
        prefix = prefix_hashes(data)
        content = mix((prefix[first + length] - prefix[first]) * powers(len(data) + 1, inverse=True)[first])
        made = {
            "first": first,
            "last": first,
            "place": np.repeat((self.first + self.place)[chosen], windows) - first,
            "anchor": mix(content ^ np.repeat(self.anchor[chosen], windows)),
            "content": content,
            "doc": np.repeat(self.doc[chosen], windows),
        }
        for name, value in made.items():
            setattr(self, name, np.concatenate((getattr(self, name)[~chosen], value)))

    def bucket(self, buckets: int) -> np.ndarray:
        return (self.anchor % U64(buckets)).astype(np.int64)

    def residue(self) -> np.ndarray:
        return (self.anchor >> U64(32)).astype(np.uint32)


def _ids(table: pa.Table) -> np.ndarray:
    column = table.column("id").cast(pa.int64())
    return np.asarray(column.fill_null(NO_ID), dtype=np.int64)


def _packed(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array).tobytes(), codec="zstd", asbytes=True) if array.size else b""


def _unpacked(blob: bytes, count: int, kind) -> np.ndarray:
    if not count:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(blob, decompressed_size=count * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("residues", pa.binary()), ("shared", pa.binary()), ("entries", pa.binary())])
_FLAGS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("residues", pa.binary()), ("hot", pa.binary())])
_ENTRIES = pa.schema(
    [("bucket", pa.int32()), ("batch", pa.int32()), ("count", pa.int32()), ("residues", pa.binary()), ("places", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("bytes", pa.int64()), ("body", pa.binary())]
)
_ANSWERS = pa.schema(
    [("batch", pa.int32()), ("bucket", pa.int32()), ("count", pa.int32()), ("residues", pa.binary()), ("least", pa.binary()), ("windows", pa.int64()), ("each", pa.binary())]
)


class _Method:
    """The worker side: what a batch sends and what a bucket answers."""

    def __init__(self, length: int, anchor: int, buckets: int, hot: int):
        self.length, self.anchor, self.buckets, self.hot = length, anchor, buckets, hot

    def runs(self, table: pa.Table) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = flat(table.column("body"))
        return Runs(data, offsets, self.length, self.anchor), data, offsets, _ids(table)

    def send_anchors(self, key, table: pa.Table) -> pa.Table:
        runs, _, _, ids = self.runs(table)
        bucket, residue = runs.bucket(self.buckets), runs.residue()
        owner = ids[runs.doc]
        order = np.lexsort((owner, residue, bucket))
        b, r, o = bucket[order], residue[order], owner[order]
        rows = []
        if len(order):
            new = np.ones(len(order), bool)
            new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order)) - 1
            shared = o[first] != o[last]
            anchor = np.cumsum(new) - 1
            around = runs.content[order]
            by_content = np.lexsort((around, anchor))
            a, c = anchor[by_content], around[by_content]
            other = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
            entries = np.bincount(a[other], minlength=len(first)).astype(np.uint32)
            cuts = np.append(np.flatnonzero(np.diff(b[first], prepend=-1)), len(first))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(b[first[low]]), key[0].as_py(), r[first[low:high]].tobytes(), np.packbits(shared[low:high]).tobytes(), entries[low:high].tobytes()))
        return _table(_ANCHORS, rows)

    def find_shared(self, key, table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint32) for x in table.column("residues").to_pylist()]
        shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(y)] for x, y in zip(table.column("shared").to_pylist(), lists, strict=True)])
        every = np.concatenate(lists)
        _, number, count = np.unique(every, return_inverse=True, return_counts=True)
        wanted = (count > 1) | (np.bincount(number, weights=shared, minlength=len(count)) > 0)
        entries = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("entries").to_pylist()])
        crowded = np.bincount(number, weights=entries, minlength=len(count)) > self.hot
        flagged, hot, at, rows = wanted[number], crowded[number], 0, []
        for batch, values in zip(table.column("batch").to_pylist(), lists, strict=True):
            mine = flagged[at : at + len(values)]
            found = values[mine]
            if len(found):
                rows.append((batch, key[0].as_py(), found.tobytes(), np.packbits(hot[at : at + len(values)][mine]).tobytes()))
            at += len(values)
        return _table(_FLAGS, rows)

    def choose(self, runs: Runs, data: np.ndarray, flags: pa.Table) -> None:
        """Leave the runs whose anchor is flagged, those of hot anchors cut into windows."""
        lists = [np.frombuffer(x, np.uint32) for x in flags.column("residues").to_pylist()]
        if not lists or not len(runs.first):
            runs.keep(np.zeros(len(runs.first), bool))
            return
        pairs = np.concatenate([x.astype(U64) | U64(b) << U64(32) for b, x in zip(flags.column("bucket").to_pylist(), lists, strict=True)])
        hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8))[: len(x)] for h, x in zip(flags.column("hot").to_pylist(), lists, strict=True)])
        mine = runs.residue().astype(U64) | runs.bucket(self.buckets).astype(U64) << U64(32)
        known = np.isin(mine, pairs)
        runs.keep(known)
        runs.split(np.isin(mine[known], pairs[hot == 1]), data, self.length)

    def entries(self, runs: Runs, data: np.ndarray):
        """Order of the runs and the number of the entry each belongs to: equal surroundings are one entry."""
        length = runs.last + self.length - runs.first
        order = np.lexsort((runs.place, length, runs.content, runs.anchor, runs.residue(), runs.bucket(self.buckets)))
        if not len(order):
            return order, np.zeros(0, np.int64), length
        same = np.ones(len(order) - 1, bool)
        for values in (runs.anchor, runs.content, length, runs.place):
            v = values[order]
            same &= v[1:] == v[:-1]
        at = np.flatnonzero(same)
        same[at] = Suffixes.equal_bytes(_Bytes(data), runs.first[order][at], runs.first[order][at + 1], length[order][at])
        return order, np.concatenate(([0], np.cumsum(~same))), length

    def send_entries(self, key, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows or not flags.num_rows:
            return _table(_ENTRIES, [])
        runs, data, _, ids = self.runs(table)
        self.choose(runs, data, flags)
        order, number, length = self.entries(runs, data)
        if not len(order):
            return _table(_ENTRIES, [])
        first = np.flatnonzero(np.diff(number, prepend=-1))
        least = np.minimum.reduceat(ids[runs.doc][order], first)
        chosen = order[first]
        bucket, rows = runs.bucket(self.buckets)[chosen], []
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(chosen))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = chosen[low:high]
            n = length[part]
            begin = np.cumsum(n) - n
            body = data[np.repeat(runs.first[part] - begin, n) + np.arange(int(n.sum()))]
            rows.append(
                (int(bucket[low]), key[0].as_py(), len(part), _packed(runs.residue()[part]), _packed(runs.place[part].astype(np.uint16)), _packed(n.astype(np.uint16)), _packed(least[low:high]), len(body), _packed(body))
            )
        return _table(_ENTRIES, rows)

    def answer(self, key, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = [x["count"] for x in rows]

        def whole(name, kind):
            return np.concatenate([_unpacked(x[name], x["count"], kind) for x in rows])

        residue, place, length, ids = whole("residues", np.uint32), whole("places", np.uint16).astype(np.int64), whole("lengths", np.uint16).astype(np.int64), whole("ids", np.int64)
        data = np.concatenate([_unpacked(x["body"], x["bytes"], np.uint8) for x in rows])
        start = np.cumsum(length) - length
        suffixes = Suffixes(data)
        entry_class = suffixes.classes(start, length, residue.astype(np.int64) << 16 | place)
        classes = int(entry_class.max()) + 1
        least = np.full(classes, NO_ID)
        np.minimum.at(least, entry_class, ids)
        _, one = np.unique(entry_class, return_index=True)
        # anchors with one surrounding only are done; the others are taken window by window
        _, group, members = np.unique(residue[one], return_inverse=True, return_counts=True)
        several = members[group] > 1
        picked = one[several]
        windows = length[picked] - self.length + 1
        begin = np.cumsum(windows) - windows
        step = np.arange(int(windows.sum())) - np.repeat(begin, windows)
        w_start = np.repeat(start[picked], windows) + step
        w_group = np.repeat(group[several], windows) << 16 | (np.repeat(place[picked], windows) - step)
        w_class = suffixes.classes(w_start, np.full(len(w_start), self.length), w_group)
        w_least = np.full(int(w_class.max()) + 1 if len(w_class) else 0, NO_ID)
        np.minimum.at(w_least, w_class, np.repeat(least[several], windows))
        found = w_least[w_class] if len(w_class) else np.zeros(0, np.int64)
        # a class whose windows all have one answer needs no list
        uniform = np.ones(classes, bool)
        where = np.full(classes, -1)
        where[several] = begin
        if len(found):
            low, high = np.minimum.reduceat(found, begin), np.maximum.reduceat(found, begin)
            least[several] = low
            uniform[several] = low == high
        out, at = [], 0
        for row, count in zip(rows, counts, strict=True):
            mine = entry_class[at : at + count]
            n = length[at : at + count] - self.length + 1
            listed = ~uniform[mine]
            value = np.where(listed, -1, least[mine])
            n = n[listed]
            begin_ = np.cumsum(n) - n
            each = found[np.repeat(where[mine[listed]] - begin_, n) + np.arange(int(n.sum()))]
            out.append((row["batch"], key[0].as_py(), count, residue[at : at + count].tobytes(), _packed(value), len(each), _packed(each)))
            at += count
        return _table(_ANSWERS, out)

    def remove(self, key, table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = flat(table.column("body"))
        covered = np.zeros(len(data), bool)
        if told.num_rows and table.num_rows:
            runs, _, _, ids = self.runs(table)
            flagged = pc.less(told.column("count"), 0)
            self.choose(runs, data, told.filter(flagged).rename_columns(["hot" if n == "least" else n for n in told.column_names]))
            order, number, _ = self.entries(runs, data)
            by_bucket = sorted(told.filter(pc.invert(flagged)).to_pylist(), key=lambda x: x["bucket"])
            least = np.concatenate([_unpacked(x["least"], x["count"], np.int64) for x in by_bucket])
            each = np.concatenate([_unpacked(x["each"], x["windows"], np.int64) for x in by_bucket])
            listed = least == -1
            first = runs.first[order]
            windows = runs.last[order] - first + 1
            per_entry = np.zeros(len(least), np.int64)
            per_entry[number] = windows
            sizes = np.where(listed, per_entry, 0)
            where = np.cumsum(sizes) - sizes
            own = ids[runs.doc][order]
            change = np.zeros(len(data) + 1, np.int32)
            gone = ~listed[number] & (least[number] < own)
            np.add.at(change, first[gone], 1)
            np.add.at(change, first[gone] + windows[gone] + self.length - 1, -1)
            at = np.flatnonzero(listed[number])
            n = windows[at]
            begin = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(begin, n)
            hit = each[np.repeat(where[number[at]], n) + step] < np.repeat(own[at], n)
            place = (np.repeat(first[at], n) + step)[hit]
            np.add.at(change, place, 1)
            np.add.at(change, place + self.length, -1)
            covered = np.cumsum(change[:-1]) > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        edge[inner] = covered[inner]
        begin = np.flatnonzero(edge)
        stop = covered.copy()
        stop[:-1] &= ~covered[1:]
        tail = offsets[1:][offsets[1:] > 0] - 1
        stop[tail] = covered[tail]
        end = np.flatnonzero(stop) + 1
        doc = np.searchsorted(offsets, begin, side="right") - 1
        bounds = np.searchsorted(begin, offsets)
        span = pa.StructArray.from_arrays([pa.array(begin - offsets[doc]), pa.array(end - offsets[doc])], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), span)
        left = np.concatenate(([0], np.cumsum(~covered)))[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[~covered].tobytes())])
        names = ["row", "removed", "kept"]
        return pa.Table.from_arrays([loose(table.column("row")), spans, kept.cast(pa.binary())], names)


class _Bytes:
    def __init__(self, data):
        self.data = data


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    length: int = 50,
    anchor: int = 24,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Bytes of every text that no smaller document has: row, removed, kept.

    ``row`` is a struct of the ``carry`` columns (the id alone if none are
    named), so their names clash with nothing; ``removed`` lists maximal
    removed runs as (start, end) byte positions; ``kept`` is the rest as
    binary.  Matches never cross documents, and are judged on the input.

    A NULL or empty text, or one shorter than ``length``, is kept as it is.
    Rows with the same id never remove each other's bytes.  A row without id
    counts as the last one: others have precedence, and rows without id leave
    one another alone.  An empty table gives an empty result.
    """
    method_batches = batch_count(docs, F.col(text_col), batch_bytes)
    method = _Method(length, anchor, method_batches, HOT)
    given = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
        F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("row"),
    )
    # by id and text: rows of one id need the same precedence, not the same batch
    batched = in_batches(given, F.xxhash64("id", "body"), F.col("body"), method_batches)
    row_type = given.schema["row"].dataType.simpleString()
    by_batch = batched.groupBy("batch")
    anchors = by_batch.applyInArrow(_two(method.send_anchors), "bucket int, batch int, residues binary, shared binary, entries binary")
    flags = anchors.groupBy("bucket").applyInArrow(_two(method.find_shared), "batch int, bucket int, residues binary, hot binary")
    entries = by_batch.cogroup(flags.groupBy("batch")).applyInArrow(
        _three(method.send_entries),
        "bucket int, batch int, count int, residues binary, places binary, lengths binary, ids binary, bytes long, body binary",
    )
    answers = entries.groupBy("bucket").applyInArrow(
        _two(method.answer), "batch int, bucket int, count int, residues binary, least binary, windows long, each binary"
    )
    # a batch has to choose the same runs again, so it is told the flags beside the answers, as rows with a count below 0
    none, empty = F.lit(0).cast("long"), F.lit(b"")
    again = flags.select("batch", "bucket", F.lit(-1).alias("count"), "residues", F.col("hot").alias("least"), none.alias("windows"), empty.alias("each"))
    return by_batch.cogroup(answers.unionByName(again).groupBy("batch")).applyInArrow(
        _three(method.remove), f"row {row_type}, removed array<struct<start:bigint,end:bigint>>, kept binary"
    )


def _two(function):
    # no type hints: Spark would read them as another kind of function
    def run(key, table):
        made = function(key, table)
        give_back()
        return made

    return run


def _three(function):
    def run(key, left, right):
        made = function(key, left, right)
        give_back()
        return made

    return run


def digest(cleaned: DataFrame) -> DataFrame:
    """Lengths and a hash of what is left."""
    size: Column = F.octet_length("kept")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return cleaned.select(
        F.col("row.doc_id").alias("doc_id"),
        (size + gone).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
