"""Mixing sources to target weights by the cube method.

A source that should give r times its words takes every document floor(r)
times and once more with probability r - floor(r).  The cube method picks the
extra ones: in a small window of documents with fractional probabilities it
moves along a direction that changes neither the expected number of documents
nor the expected number of words, until one of them is taken or left.  Blocks
of documents do this on their own; the few that stay open in each block meet
in the next, larger blocks.  The last open ones of a source, a dozen, are landed
by trying all choices for the one nearest in words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import loose

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 4000
#: Open documents that each block leaves to the next round and, at last, to the landing.
RESERVE = 12
_CLOSE = 1e-9
_GOLDEN = 0.6180339887498949


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source; sources in code point order, NULL last, take the weights in turn.

    Shares above ``most`` times a source's size are cut, and what is cut off is
    shared anew by weight, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[at % len(weights)] for at, (name, _) in enumerate(order)}
    total, fixed, open_ = float(sum(n for _, n in sizes)), {}, dict(order)
    while open_:
        left = total - sum(fixed.values())
        every = sum(weight[name] for name in open_)
        share = {name: left * weight[name] / every for name in open_}
        above = [name for name in open_ if share[name] > most * open_[name]]
        if not above:
            fixed.update(share)
            break
        for name in above:
            fixed[name] = most * open_.pop(name)
    return fixed


def _null(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float]:
    """The cross product: orthogonal to both rows of a 2 x 3 matrix."""
    u = (b[1] * c[0] - b[0] * c[1], a[0] * c[1] - a[1] * c[0], a[1] * b[0] - a[0] * b[1])
    return u


def fly(chance: np.ndarray, size: np.ndarray, luck: np.ndarray, reserve: int = 0) -> np.ndarray:
    """Cube method for one source: chances become 0 or 1 while documents and words stay balanced.

    The last ``reserve`` open documents are not touched; of the others at most
    two stay open.
    """
    p = chance.astype(float).copy()
    window: list[int] = []
    moves = 0
    scale = max(float(size.mean()), 1.0) if len(size) else 1.0
    open_ = np.flatnonzero((p > _CLOSE) & (p < 1 - _CLOSE))
    rest = iter(open_[: max(0, len(open_) - reserve)].tolist())
    x = (size / scale).tolist()
    while True:
        while len(window) < 3:
            at = next(rest, None)
            if at is None:
                break
            window.append(at)
        if len(window) == 3:
            a, b, c = window
            u = _null((1.0, x[a]), (1.0, x[b]), (1.0, x[c]))
            if max(map(abs, u)) < 1e-12:
                u = (1.0, -1.0, 0.0)
        elif len(window) == 2 and x[window[0]] == x[window[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(window, u, strict=True) if d)
        down = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(window, u, strict=True) if d)
        moves += 1
        draw = (luck[window[0]] + moves * _GOLDEN) % 1.0
        step = up if draw * (up + down) < down else -down
        for i, d in zip(window, u, strict=True):
            p[i] += step * d
            if p[i] < _CLOSE:
                p[i] = 0.0
            elif p[i] > 1 - _CLOSE:
                p[i] = 1.0
        window = [i for i in window if 0.0 < p[i] < 1.0]


def largest(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the largest open documents, half a reserve: one of them alone could not be balanced by small ones."""
    open_ = np.flatnonzero((chance > _CLOSE) & (chance < 1 - _CLOSE))
    return open_[np.argsort(-size[open_], kind="stable")[: RESERVE // 2]]


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few documents that are open: of all choices the one nearest in words, then in documents."""
    p = chance.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    choice = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(choice @ size[open_] - p[open_] @ size[open_])
    documents = np.abs(choice.sum(axis=1) - p[open_].sum())
    p[open_] = choice[np.lexsort((documents, words))[0]]
    return p


def _flight(last: bool):
    def run(key, table: pa.Table) -> pa.Table:
        source = np.asarray(table.column("source_no"), np.int64)
        luck, size = np.asarray(table.column("luck"), float), np.asarray(table.column("size"), float)
        chance = np.asarray(table.column("chance"), float).copy()
        order = np.lexsort((size, luck, source))
        cuts = np.append(np.flatnonzero(np.diff(source[order], prepend=source[order][:1] - 1)), len(order))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[low:high]
            mine = np.concatenate([np.delete(mine, at := largest(chance[mine], size[mine])), mine[at]])
            settled = fly(chance[mine], size[mine], luck[mine], RESERVE)
            chance[mine] = land(settled, size[mine]) if last else settled
        table = table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance))
        return table.set_column(table.schema.get_field_index("row"), "row", loose(table.column("row")))

    return run


def word_count(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    carry: list[str] | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    block: int = BLOCK,
) -> DataFrame:
    """How often each document is taken: row, size, source_size, target, times.

    ``row`` is a struct of the ``carry`` columns.  All draws are hashes of the
    id and the text's size, so reruns agree.  A document without words, and a
    source of such documents only, is taken no time.  A NULL source is a source
    of its own, the last.  Rows that repeat an id are drawn one by one.  An
    empty table gives an empty result.

    One row per source comes to the driver, to set the targets.
    """
    row = F.struct(*[F.col(c) for c in (carry or [id_col])])
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("row"))
    sums = counted.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    goal = targets([(r["source"], r["n"]) for r in sums], weights, most)
    plan, before = [], 0
    for at, r in enumerate(sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))):
        ratio = float(goal[r["source"]] / r["n"]) if r["n"] else 0.0
        # small sources share a block, large ones are dealt over several
        plan.append((at, r["source"], r["n"], float(goal[r["source"]]), ratio, before // block, max(1, r["docs"] // block)))
        before += r["docs"]
    sources = docs.sparkSession.createDataFrame(plan, "source_no int, name string, source_size long, target double, ratio double, base long, blocks long")
    luck = (F.pmod(F.xxhash64("doc_id", "size", F.lit(19)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    whole = F.floor(F.col("ratio") + _CLOSE)
    chance = F.when(F.col("size") > 0, F.greatest(F.col("ratio") - whole, F.lit(0.0))).otherwise(0.0)
    drawn = counted.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "row", "size", "source_size", "target", "source_no", whole.cast("long").alias("whole"), luck.alias("luck"), chance.alias("chance"), F.xxhash64("doc_id", "size", F.lit(5)).alias("spot"), "base", "blocks"
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawn.schema) + ", part long, block long"
    drawn = drawn.withColumn("part", F.pmod("spot", F.col("blocks"))).withColumn("block", F.col("base") + F.col("part"))
    most_blocks = max((p[-1] for p in plan), default=1)
    per_round = max(2, block // (2 * (RESERVE + 2)))
    open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
    spread = -1 - F.pmod("spot", F.lit(max(1, before // block)))
    while True:
        last = most_blocks == 1
        drawn = drawn.groupBy("block").applyInArrow(_keyed(last), schema)
        if last:
            break
        # a block of the next round gathers what stays open in many; settled rows stay spread
        fewer = F.ceil(F.col("blocks") / F.lit(per_round)).cast("long")
        drawn = drawn.withColumn("blocks", fewer).withColumn("part", F.pmod("part", F.col("blocks")))
        drawn = drawn.withColumn("block", F.when(open_, F.col("base") + F.col("part")).otherwise(spread))
        most_blocks = -(-most_blocks // per_round)
    return drawn.select("row", "size", "source_size", "target", (F.col("whole") + F.round("chance").cast("long")).alias("times"))


def _keyed(last: bool):
    return lambda key, table: _flight(last)(key, table)


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
