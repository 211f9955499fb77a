"""Language identification by prediction by partial matching.

For each language the bytes of sampled texts are counted in contexts of 0 to
``ORDER`` bytes; the statistics are frozen then.  A byte is coded in the
longest context known, at the cost of an escape wherever it was not seen there
(escape method C: as likely as the number of different bytes of the context),
down to an even choice of 256.  The language in which a text has the shortest
code, with the code of the language itself, is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import LOWER, loose, per_text, text_portions
from folioscope.llm.samples import few_per_key
from folioscope.llm.shared import learns_from

ORDER = 3
_GRAM = ORDER + 1
_CACHE = 400_000


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it as one number; spaces stand before a text."""
    lowered = LOWER[data].astype(np.uint32)
    out = lowered.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in range(1, _GRAM):
        before = np.full(len(data), 32, np.uint32)
        before[step:] = lowered[:-step] if len(data) > step else lowered[:0]
        out |= np.where(place >= step, before, np.uint32(32)) << np.uint32(8 * step)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = np.asarray(batch.column("label").to_pylist(), object)
        for low, high, data, offsets in text_portions(batch.column("body")):
            found = grams(data, offsets)
            names, number = np.unique(label[low:high].astype(str), return_inverse=True)
            keys = np.repeat(number, np.diff(offsets)).astype(np.uint64) << np.uint64(32) | found
            keys, count = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[(keys >> np.uint64(32)).astype(np.int64)].tolist(), pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(count.astype(np.int64))],
                ["label", "gram", "n"],
            )


class ContextTree:
    """Frozen counts of one language: for each depth the symbols and contexts in sorted arrays."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.levels = []
        for depth in range(_GRAM):
            keys = gram & np.uint64((1 << 8 * (depth + 1)) - 1)
            symbols, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, count, len(symbols))
            contexts, of = np.unique(symbols >> np.uint64(8), return_inverse=True)
            self.levels.append((symbols, total, contexts, np.bincount(of, total, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the ones before it."""
        cost = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        for depth in reversed(range(_GRAM)):
            symbols, total, contexts, sums, kinds = self.levels[depth]
            if not len(symbols):
                continue
            key = gram & np.uint64((1 << 8 * (depth + 1)) - 1)
            context = key >> np.uint64(8)
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            s = np.minimum(np.searchsorted(symbols, key), len(symbols) - 1)
            known = open_ & (contexts[c] == context)
            seen = known & (symbols[s] == key)
            whole = sums[c] + kinds[c]
            cost[seen] -= np.log2(total[s[seen]] / whole[seen])
            missed = known & ~seen
            cost[missed] -= np.log2(kinds[c[missed]] / whole[missed])
            open_ &= ~seen
        cost[open_] += 8.0
        return cost


class Model:
    """Context trees of all languages and the code length of each language's name."""

    def __init__(self, names: list[str], trees: list[ContextTree], prior: np.ndarray):
        self.names, self.trees, self.prior = names, trees, prior

    def lengths(self):
        """A function from the grams of a portion to numbers and the costs by number; grams met before are looked up."""
        known, costs = np.zeros(0, np.uint64), np.zeros((0, len(self.trees)))

        def look_up(found: np.ndarray):
            nonlocal known, costs
            code, each = pd.factorize(found)
            each = each.astype(np.uint64)
            at = np.minimum(np.searchsorted(known, each), max(len(known) - 1, 0))
            new = each[known[at] != each] if len(known) else each
            if len(new):
                if len(known) > _CACHE:
                    known, costs, new = known[:0], costs[:0], each
                more = np.stack([t.bits(new) for t in self.trees], axis=1)
                order = np.argsort(np.concatenate([known, new]), kind="stable")
                known, costs = np.concatenate([known, new])[order], np.concatenate([costs, more])[order]
                at = np.searchsorted(known, each)
            return code, costs[at]

        return look_up


def train(docs: DataFrame, lang_col: str = "lang", rows: int = 300) -> Model:
    """Count the bytes of at most ``rows`` documents of each language that may be learned from."""
    sample = few_per_key(docs, lang_col, rows)
    counted = sample.mapInArrow(_count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    sizes = docs.filter(F.col(lang_col).isNotNull() & learns_from(F.col("doc_id"))).groupBy(F.col(lang_col).alias("label")).count().collect()
    label = np.asarray(counted.column("label").to_pylist(), object)
    gram, n = np.asarray(counted.column("gram"), np.int64).astype(np.uint64), np.asarray(counted.column("n"), np.float64)
    names = sorted({r["label"] for r in sizes})
    share = np.array([dict((r["label"], r["count"]) for r in sizes)[name] for name in names], float)
    trees = [ContextTree(gram[label == name], n[label == name]) for name in names]
    return Model(names, trees, -np.log2(share / share.sum()) if len(names) else share)


def _predict(model: Model, text_in_row: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = model.lengths()
        for batch in batches:
            texts = batch.column("body") if text_in_row is None else pc.struct_field(batch.column("row"), text_in_row)
            for low, high, data, offsets in text_portions(texts):
                rows = high - low
                letters = np.asarray(batch.column("letters").slice(low, rows).to_pylist(), bool)
                total = np.zeros((rows, len(model.names)))
                if model.names and len(data):
                    code, costs = look_up(grams(data, offsets))
                    for at in range(len(model.names)):
                        total[:, at] = per_text(rows, offsets, costs[:, at][code])
                if model.names:
                    total += model.prior
                    best = total.argmin(axis=1)
                    chance = 1.0 / np.exp2(np.clip(total.min(axis=1, keepdims=True) - total, -1000, 0)).sum(axis=1)
                    named = [model.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    bits = total.min(axis=1)
                else:
                    named, chance, bits = ["und"] * rows, np.zeros(rows), np.zeros(rows)
                yield pa.RecordBatch.from_arrays(
                    [loose(batch.column("row")).slice(low, rows), pa.array(named, pa.string()), pa.array(np.where(letters & bool(model.names), chance, 0.0)), pa.array(bits)], ["row", "lang_pred", "score", "bits"]
                )

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the ``carry`` columns), lang_pred, score and bits, the length of the shortest code.

    The score is the share of the prediction among all languages, as the code
    lengths give it.  A text that is NULL or has no letter is ``und`` with
    score 0, as is every text if nothing was learned.  Ties go to the first
    language by name.
    """
    row = F.struct(*[F.col(c) for c in (carry or ["doc_id"])]).alias("row")
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    # a carried text goes to the workers once
    carried = text_col if text_col in (carry or []) else None
    body = [] if carried else [F.col(text_col).cast("binary").alias("body")]
    own = docs.select(row, *body, letters)
    return own.mapInArrow(_predict(model, carried), f"row {own.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits double")
