"""Arrow columns as flat numpy arrays: bytes, words and their hashes.

Workers go through a batch in portions of bounded size; a text longer than a
portion is a portion of its own (or, where an operator says so, is cut).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
PORTION = 1 << 19


def one_chunk(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its len + 1 offsets; NULL is an empty text."""
    array = one_chunk(column)
    array = array.cast(pa.large_binary()) if array.type != pa.large_binary() else array
    if array.null_count:
        array = pc.fill_null(array, b"")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def portions(offsets: np.ndarray, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def give_back() -> None:
    """Hand freed memory back to the system; an idle worker would keep it beside the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_portions(column, most: int = PORTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = flat(column)
    for low, high in portions(offsets, most):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
    give_back()


def _power_table(factor: np.uint64, count: int) -> np.ndarray:
    table = np.full(count, factor, dtype=U64)
    table[:1] = 1
    return np.multiply.accumulate(table) if count else table


_tables: dict[int, np.ndarray] = {}


def powers(count: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(count-1) modulo 2**64, or those of its inverse."""
    known = _tables.get(inverse)
    if known is None or len(known) < count:
        known = _power_table(_INVERSE if inverse else BASE, max(count, PORTION + 256))
        if count <= PORTION + 256:
            _tables[inverse] = known
    return known[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    out = values ^ (values >> U64(31))
    out = out * U64(0x7FB5D329728EA185)
    out ^= out >> U64(27)
    out *= U64(0x81DADEF4BC2DD44D)
    out ^= out >> U64(33)
    return out


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def _nullable(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(_nullable(kind.key_type), _nullable(kind.item_type))
    return kind


def loose(column):
    """The column with fields that may be NULL, as the declared result types have them."""
    kind = _nullable(column.type)
    return column if column.type.equals(kind, check_metadata=False) and str(column.type) == str(kind) else column.cast(kind)


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(code)) for code in range(256)])


#: Bytes of words that are cut at the six white-space characters only.
SPACED = _table(lambda c: c != 32 and not 9 <= c <= 13)
#: Bytes of words of letters, digits and everything outside ASCII.
ALNUM = _table(lambda c: c >= 128 or chr(c).isalnum())
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Words:
    """Words of some texts: first byte, end and text of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        self.inside = inside = table[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        starts, ends = offsets[:-1][filled], offsets[1:][filled] - 1
        first[starts] = inside[starts]
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        #: Words of text i are bounds[i] .. bounds[i + 1].
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, first: int | None = None) -> np.ndarray:
        """64-bit hash of every word in lower case (A-Z only), or of its ``first`` bytes."""
        if not len(self):
            return np.zeros(0, U64)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        values = (LOWER[self.data[self.inside]].astype(U64) + U64(1)) * powers(int(length.max()))[place]
        if first is not None:
            values[place >= first] = 0
        return mix(np.add.reduceat(values, begin))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes, texts not regarded."""
    size = int(size)
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, U64)
    for step in range(size):
        out = (out + words[step : step + count]) * U64(0xD6E8FEB86659FD93 + 2 * size)
    return mix(out)


def per_text(count: int, bounds: np.ndarray, values: np.ndarray, function=np.add) -> np.ndarray:
    """Fold of the values of each text; texts without values get 0."""
    out = np.zeros(count, values.dtype)
    filled = bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = function.reduceat(values, bounds[:-1][filled])
    return out


def batch_of(schema_names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], schema_names)
