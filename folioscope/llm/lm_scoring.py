"""Cross-entropy difference of two matched n-gram models over bytes.

Target model: documents that the labels call good.  Background model: all
documents.  Both have the same vocabulary (the 256 bytes), order and
smoothing (Witten-Bell interpolation of orders 5, 2, 1 and an even choice), so
the loss of a byte under one can be compared with that under the other.

Counts cover the whole corpus.  Batches of documents send their distinct
n-grams, counted, to buckets by context; a bucket sums the counts of its
contexts and sends both losses of every n-gram back to the batches that asked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import U64, flat, loose, mix, per_text, portions
from folioscope.llm.shared import BATCH_BYTES, batch_count, in_batches
from folioscope.llm.suffix_dedup import _packed, _table, _unpacked
from folioscope.session import cut_lineage

ORDER = 5
_BITS = U64((1 << 8 * ORDER) - 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER - 1 before it as one number; zero bytes stand before a text."""
    out = data.astype(U64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in range(1, min(ORDER, len(data) + 1)):
        before = np.zeros(len(data), U64)
        before[step:] = data[:-step]
        out |= np.where(place >= step, before, U64(0)) << U64(8 * step)
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((keys >> U64(8)) + U64(1)) % U64(buckets)).astype(np.int64)


_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("count", pa.int32()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])
_SENT_TYPE = "bucket int, batch int, count int, keys binary, background binary, target binary"
_LOSS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("count", pa.int32()), ("keys", pa.binary()), ("losses", pa.binary())])
_LOSS_TYPE = "batch int, bucket int, count int, keys binary, losses binary"


def _send(buckets: int):
    def run(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_SENT, [])
        data, offsets = flat(docs.column("body"))
        good = np.isin(np.asarray(docs.column("id").fill_null(-1)), np.asarray(wanted.column("id"))) & np.asarray(docs.column("id").is_valid())
        parts = []
        for low, high in portions(offsets):
            own = offsets[low : high + 1] - offsets[low]
            found = grams(data[offsets[low] : offsets[high]], own)
            code, each = pd.factorize(found)
            chosen = np.repeat(good[low:high], np.diff(own))
            parts.append((each, np.bincount(code, minlength=len(each)), np.bincount(code, chosen, len(each))))
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True) if parts else (np.zeros(0, U64), np.zeros(0, int))
        totals = [np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64) for i in (1, 2)]
        bucket = _bucket(keys, buckets)
        order = np.lexsort((keys, bucket))
        cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        rows = [
            (int(bucket[order[a]]), key[0].as_py(), b - a, _packed(keys[order[a:b]]), _packed(totals[0][order[a:b]]), _packed(totals[1][order[a:b]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]
        return _table(_SENT, rows)

    return run


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of some rows, the number of each row's n-grams among them, and both totals."""
    keys, at = np.unique(np.concatenate([_unpacked(r["keys"], r["count"], U64) for r in rows]), return_inverse=True)
    return keys, at, *(np.bincount(at, np.concatenate([_unpacked(r[name], r["count"], np.int64) for r in rows]), len(keys)) for name in ("background", "target"))


def _pairs(batches):
    """Counts of the last two bytes of the n-grams, one row for each pair of a task."""
    total = np.zeros((2, 1 << 16), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            keys, _, *counts = _summed([row])
            pair = (keys & U64(0xFFFF)).astype(np.int64)
            for at, count in enumerate(counts):
                total[at] += np.bincount(pair, count, 1 << 16).astype(np.int64)
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["pair", "background", "target"])


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Chance of a byte after another (256 x 256) by Witten-Bell over pairs, bytes and an even choice."""
    single = counts.sum(axis=0)
    kinds, total = (single > 0).sum(), single.sum()
    one = (single + kinds / 256.0) / (total + kinds) if total else np.full(256, 1 / 256)
    kinds, total = (counts > 0).sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, (counts + kinds * one) / np.maximum(total + kinds, 1), one)


def losses(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each n-gram; ``keys`` are distinct and hold whole contexts."""
    contexts, at = np.unique(keys >> U64(8), return_inverse=True)
    total, kinds = np.bincount(at, counts, len(contexts)), np.bincount(at, counts > 0, len(contexts))
    pair = (keys & U64(0xFFFF)).astype(np.int64)
    below = lower[pair >> 8, pair & 255]
    chance = np.where(total[at] > 0, (counts + kinds[at] * below) / np.maximum(total[at] + kinds[at], 1), below)
    return -np.log2(chance)


def _answer(background: np.ndarray, target: np.ndarray):
    def run(key, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, at, in_background, in_target = _summed(rows)
        both = np.stack([losses(keys, in_background, background), losses(keys, in_target, target)], axis=1).astype(np.float32)
        out, low = [], 0
        for row in rows:
            mine = at[low : low + row["count"]]
            low += row["count"]
            out.append((row["batch"], key[0].as_py(), row["count"], row["keys"], _packed(both[mine])))
        return _table(_LOSS, out)

    return run


def _score(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
    data, offsets = flat(docs.column("body"))
    rows = docs.num_rows
    total = np.zeros((rows, 2))
    if len(data):
        given = answers.to_pylist()
        keys = np.concatenate([_unpacked(r["keys"], r["count"], U64) for r in given])
        values = np.concatenate([_unpacked(r["losses"], 2 * r["count"], np.float32).reshape(-1, 2) for r in given])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        for low, high in portions(offsets):
            own = offsets[low : high + 1] - offsets[low]
            code, each = pd.factorize(grams(data[offsets[low] : offsets[high]], own))
            cost = values[np.searchsorted(keys, each)].astype(np.float64)
            for at in (0, 1):
                total[low:high, at] = per_text(high - low, own, cost[:, at][code])
    size = np.diff(offsets)
    each = total / np.maximum(size, 1)[:, None]
    # a value does not depend on the order in which rows met
    columns = [pa.array(size), pa.array(each[:, 1]), pa.array(each[:, 0]), pa.array(each[:, 0] - each[:, 1])]
    return pa.Table.from_arrays([loose(docs.column("row")), *columns], ["row", "n_tokens", "target_loss", "background_loss", "score"])


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """row, n_tokens, target_loss, background_loss and score of every document.

    ``row`` is a struct of the ``carry`` columns; tokens are bytes; losses are
    bits per token; the score is background minus target loss, higher for texts
    that are more like the target.  ``target_ids`` names the target documents
    in its first column.  NULL and empty texts have no tokens and losses and
    score of 0.  Without target documents the target model is an even choice.
    Rows without id count for the background only; rows that repeat an id are
    all counted and scored.  An empty table gives an empty result.
    """
    batches = batch_count(docs, F.col(text_col), batch_bytes)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"), F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("row"))
    by_batch = in_batches(given, F.col("id"), F.col("body"), batches).groupBy("batch")
    wanted = in_batches(target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("id")).filter("id is not null"), F.col("id"), F.lit(b""), batches)
    send = _send(batches)
    sent = cut_lineage(by_batch.cogroup(wanted.groupBy("batch")).applyInArrow(lambda key, left, right: send(key, left, right), _SENT_TYPE))
    counted = sent.mapInArrow(_pairs, "pair int, background long, target long").groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    lower = np.zeros((2, 256 * 256))
    for r in counted.collect():  # at most 65536 rows
        lower[:, r["pair"]] = r["background"], r["target"]
    background, target = (smoothed(x.reshape(256, 256)) for x in lower)
    answer = _answer(background, target)
    answers = sent.groupBy("bucket").applyInArrow(lambda key, table: answer(key, table), _LOSS_TYPE)
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(
        lambda key, left, right: _score(key, left, right), f"row {given.schema['row'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, score double"
    )
