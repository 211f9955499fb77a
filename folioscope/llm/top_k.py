"""Exact top-k search by tiled matrix products.

Vectors are packed into blocks; each tile is one product of a block of queries
and a block of candidates, from which the best ``k`` of every query are taken.
Lists of tiles are merged in a tree, a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.suffix_dedup import _table

BLOCK = 4096
QUERIES = 1024
FAN = 16
_EXACT = float(2**53)


def _pack(key, table: pa.Table) -> pa.Table:
    """One row for a block: ids in ascending order and their vectors side by side, shorter ones filled with 0."""
    ids = np.asarray(table.column("vec_id"), np.int64)
    vectors = table.column("vector").to_pylist()
    order = np.argsort(ids, kind="stable")
    width = max(len(v) for v in vectors)
    values = np.zeros((len(ids), width))
    for at, i in enumerate(order):
        values[at, : len(vectors[i])] = vectors[i]
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("matrix", pa.binary())])
    return _table(schema, [(key[0].as_py(), ids[order].tobytes(), width, values.tobytes())])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, equal scores by smaller id; columns are in the order of ids."""
    if scores.shape[1] > k:
        limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = (scores > limit).sum(axis=1)
        even = scores == limit
        chosen = (scores > limit) | (even & (np.cumsum(even, axis=1) <= (k - above)[:, None]))
        column = np.nonzero(chosen)[1].reshape(len(scores), k)
    else:
        column = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    found = np.take_along_axis(scores, column, axis=1)
    order = np.lexsort((ids[column], -found), axis=1)
    return np.take_along_axis(ids[column], order, axis=1), np.take_along_axis(found, order, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point while that is exact, else with Python's integers, held to 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if largest < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(a).dot(whole(b).T) if width else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


_LIST = pa.schema([("tile", pa.int64()), ("group", pa.int64()), ("query_ids", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
_LIST_TYPE = "tile long, group long, query_ids binary, counts binary, ids binary, scores binary"


def _tile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked, own = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                a = np.frombuffer(row["query_matrix"]).reshape(len(asked), row["query_width"])
                b = np.frombuffer(row["matrix"]).reshape(len(own), row["width"])
                scores = _product(a, b)
                # a query's own row is no candidate: one more than k is taken, then it goes
                ids, found = best(scores, own, k + 1)
                other = ids != asked[:, None]
                keep = other & (np.cumsum(other, axis=1) <= k)
                yield from _table(_LIST, [(row["tile"], row["group"], row["query_ids"], keep.sum(axis=1).tobytes(), ids[keep].tobytes(), found[keep].tobytes())]).to_batches()

    return run


def _merge(k: int):
    def run(key, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = np.frombuffer(rows[0]["query_ids"], np.int64)
        query = np.concatenate([np.repeat(np.arange(len(asked)), np.frombuffer(r["counts"], np.int64)) for r in rows])
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        scores = np.concatenate([np.frombuffer(r["scores"], np.int64) for r in rows])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(len(asked)))
        keep = np.arange(len(query)) - first[query] < k
        counts = np.bincount(query[keep], minlength=len(asked)).astype(np.int64)
        return _table(_LIST, [(key[0].as_py(), key[1].as_py(), rows[0]["query_ids"], counts.tobytes(), ids[keep].tobytes(), scores[keep].tobytes())])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.int64)
            rank = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.frombuffer(row["query_ids"], np.int64), counts)), pa.array(rank.astype(np.int32)), pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(np.frombuffer(row["scores"], np.int64))],
                ["query_id", "rank", "vec_id", "score"],
            )


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """The k candidates with the highest inner product for each query: query_id, rank, vec_id, score.

    Components become floor(scale * x).  Every vector is a candidate of every
    query but itself; equal scores go to the smaller id.  Rows without id, NULL
    vectors and vectors with a NULL or non-finite component take no part.
    Missing components of shorter vectors count as 0.  Rows that repeat an id
    are the same vector: one of them (the smallest) takes part.  Scores beyond
    64 bits are held at the limit.  An empty table gives an empty result.
    """
    number = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"), number.alias("vector"))
    once = usable.groupBy("vec_id").agg(F.first("asks").alias("asks"), F.min("vector").alias("vector"))
    sizes = once.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).first()
    blocks, query_blocks = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-(sizes["q"] or 0) // QUERIES))

    def packed(df: DataFrame, count: int) -> DataFrame:
        dealt = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block"), "vec_id", "vector")
        return dealt.groupBy("block").applyInArrow(lambda key, table: _pack(key, table), "block long, ids binary, width int, matrix binary")

    candidates = packed(once, blocks)
    asked = packed(once.filter("asks"), query_blocks).select(F.col("block").alias("tile"), F.col("ids").alias("query_ids"), F.col("width").alias("query_width"), F.col("matrix").alias("query_matrix"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("tile")
    tiles = candidates.select("*", every).join(asked, "tile").withColumn("group", F.floor(F.col("block") / FAN))
    found = tiles.select("tile", "group", "query_ids", "query_width", "query_matrix", "ids", "width", "matrix").mapInArrow(_tile(k), _LIST_TYPE)
    groups = blocks
    while True:
        found = found.groupBy("tile", "group").applyInArrow(lambda key, table: _merge(k)(key, table), _LIST_TYPE)
        groups = -(-groups // FAN)
        if groups <= 1:
            break
        found = found.withColumn("group", F.floor(F.col("group") / FAN))
    return found.mapInArrow(_unpack, "query_id long, rank int, vec_id long, score long")
