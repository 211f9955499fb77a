"""Near-duplicate documents by an LSH forest, confirmed on full shingle sets.

Every distinct set gets one MinHash signature for each tree.  A tree sorts the
sets by signature, so that sets with a long common prefix are neighbours.  A
region is a run with ``depth`` equal values; in a small region pairs whose
sketches agree by half are candidates, a large region is taken deeper and
sets that still agree are candidates.  Candidates only say which sets belong
to one cluster.  Inside a cluster all full sets are compared in tiles of
bounded size: sets in bands of size that differ by more than one cannot be
linked.  Tiles give a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import SPACED, U64, Words, gram_hashes, mix, per_text, text_portions
from folioscope.llm.components import components
from folioscope.session import cut_lineage

SKETCH = 32
SMALL_REGION = 256
TILE = 512
TILE_SHINGLES = 1 << 19


def _odd(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class Shingles:
    """Distinct shingle hashes of the texts of a portion, sorted inside each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        words = Words(data, offsets, SPACED)
        hashes = words.hashes()
        count = np.diff(words.bounds)
        grams = gram_hashes(hashes, size)
        last = np.repeat(words.bounds[1:], count)[: len(grams)]
        inside = np.arange(len(grams)) + size <= last
        value, owner = grams[inside], words.text[: len(grams)][inside]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            whole = np.array([gram_hashes(hashes[words.bounds[t] : words.bounds[t + 1]], count[t])[0] for t in short], U64)
            value, owner = np.concatenate([value, whole ^ U64(1)]), np.concatenate([owner, short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[new], owner[new]
        self.bounds = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.count = np.diff(self.bounds)


def _signatures(size: int, trees: int, depth: int):
    factors, sketch_factors = _odd(trees * depth, 11), _odd(SKETCH, 977)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                found = Shingles(data, offsets, size)
                rows = high - low
                mixed = mix(found.value + U64(77))
                sums = [per_text(rows, found.bounds, mix(found.value * f)).astype(np.int64) for f in (U64(3), U64(0x51ED270B7F14A9C5))]
                mins = np.zeros((rows, trees * depth), ">u4")
                sketch = np.zeros((rows, SKETCH), np.uint8)
                for at, factor in enumerate(factors):
                    mins[:, at] = per_text(rows, found.bounds, (mixed * factor) >> U64(32), np.minimum)
                for at, factor in enumerate(sketch_factors):
                    sketch[:, at] = mix(per_text(rows, found.bounds, (mixed * factor) >> U64(24), np.minimum)) & U64(255)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, rows),
                        pa.array(found.count.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([m.tobytes() for m in mins], pa.binary()),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "mins", "sketch"],
                )

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix: its smallest row."""
    label = np.arange(len(linked))
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _fixed(column, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def _neighbours(depth: int, width: int):
    """Candidate links from rows sorted by tree and signature; a region may span batches."""

    def small(nodes: np.ndarray, sketches: np.ndarray, out: list) -> None:
        alike = (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2) >= SKETCH // 2
        label = _labels(alike)
        moved = label != np.arange(len(label))
        out.append((nodes[moved], nodes[label[moved]]))

    def large(nodes: np.ndarray, signatures: np.ndarray, out: list) -> None:
        new = np.ones(len(nodes), bool)
        new[1:] = (signatures[1:] != signatures[:-1]).any(axis=1)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        out.append((nodes[~new], nodes[first[~new]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, in_large = None, False

        def close(rows, out, goes_on: bool):
            nonlocal in_large
            keys, nodes, sketches = rows
            if in_large or len(nodes) > SMALL_REGION:
                large(nodes, keys, out)
            elif goes_on:
                return rows
            elif len(nodes) > 1:
                small(nodes, sketches, out)
            in_large = goes_on and (in_large or len(nodes) > SMALL_REGION)
            return tuple(x[-1:] for x in rows) if goes_on else None

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.asarray(batch.column("tree"), np.uint8)[:, None]
            rows = (np.concatenate([tree, _fixed(batch.column("signature"), 4 * width)], axis=1), np.asarray(batch.column("node"), np.int64), _fixed(batch.column("sketch"), SKETCH))
            if carried is not None:
                rows = tuple(np.concatenate(x) for x in zip(carried, rows, strict=True))
            prefix = rows[0][:, : 1 + 4 * depth]
            cuts = np.flatnonzero((prefix[1:] != prefix[:-1]).any(axis=1)) + 1
            begin, end = np.append(0, cuts), np.append(cuts, len(prefix))
            out: list = []
            for at in np.flatnonzero(end - begin > 1) if len(begin) > 1 else [0]:
                if at < len(begin) - 1:
                    close(tuple(x[begin[at] : end[at]] for x in rows), out, False)
            if len(begin) > 1 and end[0] - begin[0] == 1:
                in_large = False
            carried = close(tuple(x[begin[-1] :] for x in rows), out, True)
            yield _links(out)
        if carried is not None:
            out = []
            close(carried, out, False)
            yield _links(out)

    return run


def _links(parts: list) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                found = Shingles(data, offsets, size)
                blobs = [found.value[a:b].tobytes() for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(low, high - low), batch.column("tiles").slice(low, high - low), pa.array(blobs, pa.binary())],
                    ["node", "tiles", "members"],
                )

    return run


def _confirm(part: int, of: int):
    """Spanning forest of the links between the full sets of a tile."""

    def run(key, table: pa.Table) -> pa.Table:
        nodes = np.asarray(table.column("node"), np.int64)
        order = np.argsort(nodes, kind="stable")
        sets = [np.frombuffer(x, U64) for x in table.column("members").to_pylist()]
        nodes, sets = nodes[order], [sets[i] for i in order]
        size = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(every, return_inverse=True, return_counts=True)
        common = count > 1
        number = np.cumsum(common) - 1
        held = common[column]
        column, owner = number[column[held]], owner[held]
        by_column = np.argsort(column, kind="stable")
        column, owner = column[by_column], owner[by_column]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        width = 2048
        for low in range(0, int(common.sum()), width):
            a, b = np.searchsorted(column, (low, low + width))
            block = np.zeros((len(sets), width), np.float32)
            block[owner[a:b], column[a:b] - low] = 1
            shared += block @ block.T
        inter = shared.astype(np.int64)
        linked = of * inter >= part * (size[:, None] + size[None, :] - inter)
        label = _labels(linked)
        moved = label != np.arange(len(label))
        return pa.Table.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    return run


def _tiles(clustered: DataFrame, part: int, of: int) -> DataFrame:
    """(node, tiles): the tiles of bounded size in which a set meets all it may be linked with."""
    step = math.log(of / part) * (1 + 1e-9)  # rounding must not push sets two bands apart
    banded = clustered.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step)).cast("int"))
    # tiles are bounded by sets and by the shingles in them
    load = F.ceil(F.greatest(F.count("*") / F.lit(TILE), F.sum("n_shingles") / F.lit(TILE_SHINGLES))).cast("int")
    sizes = banded.groupBy("component").agg(load.alias("size"))
    bands = banded.groupBy("component", "band").agg(load.alias("parts"))
    sized = banded.join(sizes, "component")
    whole = sized.filter(F.col("size") <= 1).select("node", F.array(F.struct(F.col("component"), F.lit("").alias("tile"))).alias("tiles"))
    big = sized.filter(F.col("size") > 1)
    for shift, name in ((-1, "below"), (0, "parts"), (1, "above")):
        other = bands.select("component", (F.col("band") - shift).alias("band"), F.col("parts").alias(name))
        big = big.join(other, ["component", "band"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")

    def named(band_a, part_a, band_b, part_b):
        return F.struct(F.col("component"), F.concat_ws(":", band_a.cast("string"), part_a.cast("string"), band_b.cast("string"), part_b.cast("string")).alias("tile"))

    def parts(count):
        return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    band, mine = F.col("band"), F.col("_own")
    tiles = F.concat(
        F.transform(parts("parts"), lambda x: named(band, F.least(x, mine), band, F.greatest(x, mine))),
        F.transform(parts("above"), lambda x: named(band, mine, band + 1, x)),
        F.transform(parts("below"), lambda x: named(band - 1, x, band, mine)),
    )
    split = big.withColumn("_own", own).select("node", tiles.alias("tiles"))
    return whole.unionByName(split)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    part: int = 85,
    of: int = 100,
    trees: int = 24,
    depth: int = 5,
    deepest: int = 6,
) -> DataFrame:
    """One row per document: its number of shingles and the smallest id it is connected with.

    Two documents are linked if their sets of ``shingle``-word shingles
    (lower-case A-Z, words between white space) have ``of`` * common >=
    ``part`` * union.  Texts of fewer words are one shingle; texts without
    words, and NULL texts, are linked with nothing.

    ``kept`` marks the row whose id is the component's.  Rows with one id are
    one document: they share links.  A row without id is linked with nothing
    and has a NULL component and ``kept`` false.  Equal texts form a class
    before any comparison, so copies cost one row each.  A pair at the limit
    is missed by all trees with a probability of (1 - (part/of)**depth)**trees
    (8e-7 by default).
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    seen = cut_lineage(
        given.mapInArrow(_signatures(shingle, trees, deepest), "doc_id long, n_shingles long, set_a long, set_b long, mins binary, sketch binary")
    )
    key = ["set_a", "set_b", "n_shingles"]
    linkable = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = classes.select("node", "mins", "sketch", tree)
    rows = rows.select("tree", F.expr(f"substring(mins, tree * {4 * deepest} + 1, {4 * deepest})").alias("signature"), "node", "sketch")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(width, "tree", F.substring("signature", 1, 4 * depth)).sortWithinPartitions("tree", "signature")
    candidates = sorted_rows.mapInArrow(_neighbours(depth, deepest), "a long, b long")
    clusters = components(candidates)
    counted = classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    clustered = cut_lineage(clusters.join(counted, "node"))
    tiles = cut_lineage(_tiles(clustered, part, of))
    # Through a shuffle at every size: the hint keeps candidate components out of the driver.
    met = given.withColumnRenamed("doc_id", "node").join(tiles.hint("shuffle_merge"), "node")
    # A repeated row is one set of a tile, as tiles are sized by distinct ones; the rows of a node are together here.
    marked = met.withColumns({"_a": F.xxhash64("body"), "_b": F.xxhash64("body", F.lit(23))})
    wanted = marked.groupBy("node", "_a", "_b").agg(F.first("tiles").alias("tiles"), F.first("body").alias("body"))
    sets = wanted.mapInArrow(_sets(shingle), "node long, tiles array<struct<component:bigint,tile:string>>, members binary")
    spread = sets.select("node", "members", F.explode("tiles").alias("t")).select("node", "members", "t.component", "t.tile")
    links = spread.groupBy("component", "tile").applyInArrow(lambda k, t: _confirm(part, of)(k, t), "a long, b long")
    found = components(links)
    named = classes.select(*key, "node").join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    at_doc = seen.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return at_doc.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
