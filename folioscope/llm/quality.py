"""Quality scores: boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import SPACED, Words, loose, per_text, text_portions
from folioscope.llm.boosting import Forest, fit
from folioscope.llm.samples import labelled_sample, sampled_texts


def _bytes(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_KINDS = [
    _bytes("abcdefghijklmnopqrstuvwxyz"),
    _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _bytes("0123456789"),
    _bytes(".,;:!?'\"()-"),
    _bytes("#$%&*@<>{}[]|\\/^~_=+`"),
    _bytes(" \t\r"),
    _bytes("\n"),
    np.arange(256) >= 128,
    np.arange(256) < 9,
]
_KIND = np.select(_KINDS, range(len(_KINDS)), default=len(_KINDS))
FEATURES = len(_KINDS) + 11


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text; an empty text is all zeros."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    kinds = np.bincount(owner * (len(_KINDS) + 1) + _KIND[data], minlength=rows * (len(_KINDS) + 1)).reshape(rows, -1)
    words = Words(data, offsets, SPACED)
    hashes = words.hashes()
    count = np.diff(words.bounds)
    length = words.end - words.start
    order = np.lexsort((hashes, words.text))
    h, t = hashes[order], words.text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    run_bounds = np.searchsorted(t[new], np.arange(rows + 1))
    last = data[words.end - 1] if len(words) else data[:0]
    odd_end = np.isin(_KIND[last], (4,))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    every, each = np.maximum(size, 1), np.maximum(count, 1)
    # lines: repeated ones by the sum of their words' hashes
    is_break = data == 10
    line = np.cumsum(is_break)
    line_of_word = line[words.start] if len(words) else np.zeros(0, np.int64)
    first = np.ones(len(line_of_word), bool)
    first[1:] = (line_of_word[1:] != line_of_word[:-1]) | (words.text[1:] != words.text[:-1])
    starts = np.flatnonzero(first)
    line_hash = np.add.reduceat(hashes, starts) if len(starts) else hashes[:0]
    line_text = words.text[starts]
    by = np.lexsort((line_hash, line_text))
    lh, lt = line_hash[by], line_text[by]
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[1:] != lh[:-1]) | (lt[1:] != lt[:-1])
    lines = np.bincount(lt, minlength=rows)
    distinct_lines = np.bincount(lt[fresh], minlength=rows)
    columns = [
        np.log1p(size),
        np.log1p(count),
        per_text(rows, words.bounds, length) / each,
        per_text(rows, words.bounds, length, np.maximum),
        np.diff(run_bounds) / each,
        per_text(rows, run_bounds, runs, np.maximum) / each,
        per_text(rows, words.bounds, odd_end.astype(np.int64)) / each,
        per_text(rows, words.bounds, again.astype(np.int64)) / each,
        count / np.maximum(lines, 1),
        distinct_lines / np.maximum(lines, 1),
        per_text(rows, words.bounds, (length == 1).astype(np.int64)) / each,
        *(kinds[:, : len(_KINDS)] / every[:, None]).T,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_portions(batch.column("body")):
            found = statistics(data, offsets)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * FEATURES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("label").slice(low, high - low), values], ["doc_id", "label", "values"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = 20_000) -> Forest:
    """Fit on at most ``rows`` labelled documents; only their statistics come to the driver."""
    texts = sampled_texts(docs, labelled_sample(labels, label_col, rows))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(_features, f"doc_id {id_type}, label int, values array<double>").toArrow()
    values = np.array(found.column("values").to_pylist(), np.float64).reshape(-1, FEATURES)
    label = np.asarray(found.column("label"), np.int64)
    order = np.lexsort((*values.T, label))
    return fit(values[order], label[order])


def _scores(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                yield pa.RecordBatch.from_arrays([loose(batch.column("row")).slice(low, high - low), pa.array(forest.score(statistics(data, offsets)))], ["row", "score"])

    return run


def score(docs: DataFrame, forest: Forest, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the ``carry`` columns) and the chance of a good text.

    Every row gets a score; NULL counts as an empty text, whose statistics are
    all zero.  An empty table gives an empty result.
    """
    own = docs.select(F.struct(*[F.col(c) for c in (carry or ["doc_id"])]).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    return own.mapInArrow(_scores(forest), f"row {own.schema['row'].dataType.simpleString()}, score double")
