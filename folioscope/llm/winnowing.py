"""Benchmark decontamination by winnowing.

From every run of ``window`` consecutive words the smallest of its
``gram``-word hashes is kept as fingerprint, so documents and items that share
such a run share a fingerprint at the same place in it.  The fingerprints of
the items are joined with those of the documents, and each meeting is extended
word by word; only extensions of at least ``window`` words count.  Items of
fewer words are one window of their own length and are looked up at every
place of a document.

A Bloom filter of fixed size over the item fingerprints travels to the tasks;
it only spares rows that cannot join, so its error rate costs rows, never
results.  The join itself is left to the optimiser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import ALNUM, U64, Words, gram_hashes, loose, text_portions

FILTER_BITS = 1 << 23
FILTER_HASHES = 4
_PLACE_BITS = U64(28)


def _places(keys: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(FILTER_HASHES):
        yield ((keys * U64(2 * at + 0x9E3779B97F4A7C15)) >> U64(41)).astype(np.int64)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    good = np.ones(len(keys), bool)
    for place in _places(keys):
        good &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return good


class Prints:
    """Fingerprints of the texts of a portion: text, first word, key, surrounding words.

    ``key`` is the gram hash; ``around`` the word hashes from ``window - gram``
    words before the gram to as many behind it, 0 where the text ends.
    """

    def __init__(self, data, offsets, window: int, gram: int):
        self.words = words = Words(data, offsets, ALNUM)
        self.hashes = words.hashes() | U64(1)
        self.window, self.gram = window, gram
        self.count = np.diff(words.bounds)
        self.grams = gram_hashes(self.hashes, gram)

    def chosen(self) -> np.ndarray:
        """First words of the selected grams; winnowing never looks beyond a text."""
        bounds, width = self.words.bounds, self.window - self.gram + 1
        if not len(self.grams):
            return np.zeros(0, np.int64)
        own = np.repeat(bounds[1:], self.count)[: len(self.grams)]
        inside = np.arange(len(self.grams)) + self.gram <= own
        # a window of words inside one text has all its grams inside; others are dropped afterwards
        keys = np.where(inside, self.grams, ~U64(0))
        place = np.arange(len(keys), dtype=U64)
        bits = _PLACE_BITS
        mask = (U64(1) << bits) - U64(1)
        least = (keys >> bits << bits) | place
        have = 1
        while have < width:
            step = min(have, width - have)
            if len(least) <= step:
                return np.zeros(0, np.int64)
            least = np.minimum(least[:-step], least[step:])
            have += step
        begin = np.arange(len(least))
        whole = begin + self.window <= np.repeat(bounds[1:], self.count)[: len(least)]
        return np.unique((least[whole] & mask).astype(np.int64))

    def around(self, first: np.ndarray, before: int, after: int) -> np.ndarray:
        """Word hashes from first - before to first + after, 0 outside the text."""
        index = first[:, None] + np.arange(-before, after)
        text = self.words.text[first]
        good = (index >= self.words.bounds[text][:, None]) & (index < self.words.bounds[text + 1][:, None])
        return np.where(good, self.hashes[np.clip(index, 0, len(self.hashes) - 1)], U64(0))


def _salted(keys: np.ndarray, length: int) -> np.ndarray:
    """Keys of short items differ by their length, so that they never meet grams."""
    return keys ^ U64(length * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)


def _item_prints(window: int, gram: int):
    side = window - gram

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                found = Prints(data, offsets, window, gram)
                at = found.chosen()
                text, keys = found.words.text[at], found.grams[at] if len(at) else np.zeros(0, U64)
                around = [x.tobytes() for x in found.around(at, side, gram + side)]
                length = np.full(len(at), gram)
                for short in np.flatnonzero((found.count > 0) & (found.count < window)):
                    begin, n = found.words.bounds[short], int(found.count[short])
                    text, length = np.append(text, short), np.append(length, -n)
                    keys = np.append(keys, _salted(gram_hashes(found.hashes[begin : begin + n], n), n))
                    around.append(found.hashes[begin : begin + n].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(low, high - low).take(pa.array(text)), pa.array(keys.astype(np.int64)), pa.array(around, pa.binary()), pa.array(length.astype(np.int32))],
                    ["item_id", "key", "item_words", "n"],
                )

    return run


def _filter_blocks(batches):
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for place in _places(np.asarray(batch.column("key"), np.int64).astype(U64)):
            bits[place] = True
    packed = np.packbits(bits, bitorder="little")
    size = 1 << 14
    for low in range(0, len(packed), size):
        part = packed[low : low + size]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["low", "bits"])


def _merge_blocks(key, table):
    parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())], ["low", "bits"])


_HIT = pa.struct([("key", pa.int64()), ("first", pa.int64()), ("words", pa.binary())])


def _doc_prints(window: int, gram: int, shared, lengths: list[int]):
    side = window - gram

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                found = Prints(data, offsets, window, gram)
                at = found.chosen()
                at = at[_passes(bits, found.grams[at])] if len(at) else at
                firsts, keys, around = [at], [found.grams[at] if len(at) else np.zeros(0, U64)], [x.tobytes() for x in found.around(at, side, gram + side)]
                for n in lengths:
                    grams = _salted(gram_hashes(found.hashes, n), n)
                    place = np.flatnonzero(_passes(bits, grams))
                    place = place[place + n <= found.words.bounds[found.words.text[place] + 1]]
                    firsts.append(place)
                    keys.append(grams[place])
                    around += [x.tobytes() for x in found.around(place, 0, n)]
                first, key = np.concatenate(firsts), np.concatenate(keys)
                text = found.words.text[first]
                order = np.argsort(text, kind="stable")
                bounds = np.searchsorted(text[order], np.arange(high - low + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays(
                    [pa.array(key[order].astype(np.int64)), pa.array(first[order] - found.words.bounds[text[order]]), pa.array([around[i] for i in order], pa.binary())],
                    fields=list(_HIT),
                )
                yield pa.RecordBatch.from_arrays(
                    [loose(batch.column("row")).slice(low, high - low), pa.array(found.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), hits)],
                    ["row", "n_words", "hits"],
                )

    return run


def _extend(gram: int, window: int):
    """Turns meetings into hit word ranges of the document; a row that meets nothing stays, without range."""
    side = window - gram

    def run(batches):
        for batch in batches:
            n = np.asarray(batch.column("n"), np.int64)
            first = np.asarray(batch.column("first"), np.int64)
            mine, other = batch.column("words").to_pylist(), batch.column("item_words").to_pylist()
            low, high, good = first.copy(), first.copy(), np.zeros(len(n), bool)
            short = np.flatnonzero(n < 0)
            good[short] = [mine[i] == other[i] for i in short]
            high[short] = first[short] - n[short]
            long = np.flatnonzero(n > 0)
            if len(long):
                # a short item's key may, in theory, equal a gram's; its words are no context
                fits = [i for i in long if len(mine[i]) == len(other[i])]
                long = np.array(fits, np.int64)
            if len(long):
                a = np.frombuffer(b"".join(mine[i] for i in long), U64).reshape(len(long), -1)
                b = np.frombuffer(b"".join(other[i] for i in long), U64).reshape(len(long), -1)
                same = (a == b) & (a != 0)
                left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(same[:, side + gram :], axis=1).sum(axis=1)
                good[long] = same[:, side : side + gram].all(axis=1) & (left + gram + right >= window)
                low[long] -= left
                high[long] += gram + right
            missed = ~good
            ids = batch.column("item_ids")
            yield pa.RecordBatch.from_arrays(
                [
                    loose(batch.column("row")),
                    batch.column("n_words"),
                    pc.if_else(pa.array(good), ids, pa.scalar(None, ids.type)),
                    pa.array(low, mask=missed),
                    pa.array(high, mask=missed),
                ],
                ["row", "n_words", "item_ids", "low", "high"],
            )

    return run


def _merged(ranges):
    """Disjoint ranges from sorted (low, high) pairs."""
    empty = F.array().cast("array<struct<low:bigint,high:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["low"] <= last["high"])
        grown = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.when(F.size(ranges) > 0, F.aggregate(ranges, empty, add)).otherwise(empty)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: list[str] | None = None,
    window: int = 10,
    gram: int = 5,
) -> DataFrame:
    """What of every document also stands in an item: row, n_words, hits, item_ids.

    ``row`` is a struct of the ``carry`` columns; ``hits`` lists the disjoint
    word ranges (low, high) that lie in an occurrence of an item's window,
    ``item_ids`` the items with such windows, in the order of their text form.
    Words are letters, digits and characters outside ASCII, A-Z in lower case.

    NULL and empty texts have no words and no hits; an item without words has
    no window; an item without id is not searched for.  Rows are judged one by
    one, so repeated rows all come back.  Empty tables give no hits.
    """
    spark = docs.sparkSession
    item_rows = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("binary"), F.lit(b"")).alias("body"))
    id_type = item_rows.schema["item_id"].dataType.simpleString()
    prints = item_rows.mapInArrow(_item_prints(window, gram), f"item_id {id_type}, key long, item_words binary, n int")
    grouped = prints.groupBy("key", "n", "item_words").agg(F.collect_set("item_id").alias("item_ids"))
    blocks = prints.select("key").mapInArrow(_filter_blocks, "low int, bits binary").groupBy("low").applyInArrow(lambda k, t: _merge_blocks(k, t), "low int, bits binary").collect()
    bits = bytearray(FILTER_BITS // 8)
    for block in blocks:
        bits[block["low"] : block["low"] + len(block["bits"])] = block["bits"]
    lengths = sorted(-x["n"] for x in prints.filter("n < 0").select("n").distinct().collect())
    shared = spark.sparkContext.broadcast(bytes(bits))
    own = docs.select(
        F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(c) for c in (carry or ["doc_id"])]).alias("row")).alias("row"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )
    row_type = own.schema["row"].dataType.simpleString()
    found = own.mapInArrow(_doc_prints(window, gram, shared, lengths), f"row {row_type}, n_words long, hits array<struct<key:bigint,first:bigint,words:binary>>")
    # rows without a meeting get a key of their own, so that they are not all dealt to one task
    key = F.coalesce("hit.key", F.xxhash64("row.at"))
    narrow = found.select("row", "n_words", F.explode_outer("hits").alias("hit")).select("row", "n_words", key.alias("key"), "hit.first", "hit.words")
    joined = narrow.join(grouped, "key", "left").select(
        "row", "n_words", F.coalesce("first", F.lit(0)).alias("first"), "words", "item_words", F.when(F.col("words").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("n"), "item_ids"
    )
    ranged = joined.mapInArrow(_extend(gram, window), f"row {row_type}, n_words long, item_ids array<{id_type}>, low long, high long")
    ranges = F.array_sort(F.collect_set(F.when(F.col("low").isNotNull(), F.struct("low", "high"))))
    every = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("item_ids"))), lambda x: x.cast("string")))
    summed = ranged.groupBy("row.at").agg(F.first("row.row").alias("row"), F.first("n_words").alias("n_words"), ranges.alias("ranges"), every.alias("item_ids"))
    return summed.select("row", "n_words", _merged(F.col("ranges")).alias("hits"), "item_ids")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the items of every document."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["high"] - x["low"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
