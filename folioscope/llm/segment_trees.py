"""How far the sources of a language diverge, by hash-consed segment trees over term ids.

Each group (language, source) is a segment tree whose leaves are its counts of
the language's kept terms.  Nodes are hash-consed: equal counts, and pairs of
equal children, are one node, so equal subtrees of any groups and places are
shared.  Two trees are compared by walking both at once from the roots; a pair
of nodes that comes up again within a pair of groups is priced once and its price
used again.

The top of the trees is dealt out by Spark: a block of term ids is one subtree
of every group, and a task has one block of two tiles of groups.  Blocks of a
language follow the number of its terms and tiles the number of its groups, so
no task grows with the table; prices of a block are integers and add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.grouping import lookup_join
from folioscope.llm.arrays import LOWER, Words, give_back, text_portions
from folioscope.session import cut_lineage

#: A term: letters of ASCII and everything outside it.
_LETTERS = np.array([code >= 128 or chr(code).isalpha() for code in range(256)])
PORTION_BYTES = 4 << 20
HELD_ROWS = 1 << 20
UNIT = 10**9
#: Terms of a block and groups of a tile, on average; a task's arrays follow from both.
BLOCK, TILE = 2048, 16
_PAD = -1


def share(count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kinds)), exact for counts of any size."""
    if len(count) and int(count.max()) > (1 << 63) // UNIT - 3:
        count = count.astype(object)
    return (1 + UNIT * (count + 2) // (total + 2 * kinds)).astype(np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most UNIT + 1, so squares fit."""
    return (p - q) ** 2 // (p + q)


class Forest:
    """Segment trees of some groups with their nodes shared.

    ``levels[0]`` numbers the distinct counts; level k + 1 holds the left and
    right child of each distinct node.  ``roots`` has one node a group.
    """

    def __init__(self, counts: np.ndarray):
        groups, terms = counts.shape
        width = 1 << max(terms - 1, 0).bit_length()
        leaves = np.full((groups, width), _PAD, np.int64)
        leaves[:, :terms] = counts
        self.counts, ids = np.unique(leaves, return_inverse=True)
        ids = ids.reshape(groups, width)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = len(self.counts)
        while ids.shape[1] > 1:
            nodes, ids_ = np.unique(ids[:, 0::2] * kinds + ids[:, 1::2], return_inverse=True)
            self.levels.append((nodes // kinds, nodes % kinds))
            ids, kinds = ids_.reshape(groups, -1), len(nodes)
        self.roots = ids[:, 0]

    def compare(self, a: np.ndarray, b: np.ndarray, total: np.ndarray, kinds: int) -> tuple[np.ndarray, int]:
        """Summed price of the trees of groups a[i] and b[i] for every i, and how many node pairs were priced."""
        which, x, y = np.arange(len(a)), self.roots[a], self.roots[b]
        back, priced = [], len(a)
        for left, right in reversed(self.levels):
            many = max(len(left), len(right), len(self.counts), int(left.max()) + 1, int(right.max()) + 1)
            pairs = np.concatenate(((which * many + left[x]) * many + left[y], (which * many + right[x]) * many + right[y]))
            once, number = np.unique(pairs, return_inverse=True)
            back.append(number)
            which, x, y = once // many // many, once // many % many, once % many
            priced += len(once)
        ca, cb = self.counts[x], self.counts[y]
        real = ca != _PAD
        value = np.zeros(len(which), np.int64)
        p, q = share(ca[real], total[a[which[real]]], kinds), share(cb[real], total[b[which[real]]], kinds)
        value[real] = price(p, q)
        for number in reversed(back):
            half = len(number) // 2
            value = value[number[:half]] + value[number[half:]]
        return value, priced


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pricer(tops: int):
    def work(table: pa.Table) -> pa.Table:
        heads = table.filter(pa.compute.equal(table["kind"], 0))
        sources, tile = heads["name"].to_pylist(), np.asarray(heads["tile"])
        total = np.asarray(heads["amount"])
        kinds, size, lang = heads["kinds"][0].as_py(), heads["size"][0].as_py(), heads["lang"][0].as_py()
        first, second = heads["one"][0].as_py(), heads["two"][0].as_py()
        rows = table.filter(pa.compute.equal(table["kind"], 1))
        terms = rows["name"].combine_chunks().dictionary_encode()
        named = terms.dictionary.to_pylist()
        number = {s: k for k, s in enumerate(sources)}
        owner = np.fromiter((number[s] for s in rows["source"].to_pylist()), np.int64, rows.num_rows)
        counts = np.zeros((len(sources), max(size, 1)), np.int64)
        if not size:
            counts[:] = _PAD
        counts[owner, np.asarray(terms.indices)] = np.asarray(rows["amount"])
        if first == second:
            a, b = np.triu_indices(len(sources), 1)
        else:
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(tile == first), np.flatnonzero(tile == second), indexing="ij"))
        out: list[tuple] = []
        if len(a):
            value, _ = Forest(counts).compare(a, b, total, kinds)
            for i, j, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True):
                out += [(lang, sources[i], "pair", sources[j], v), (lang, sources[j], "pair", sources[i], v)]
        if first == second and rows.num_rows:
            mine, at = owner, np.asarray(terms.indices)
            p = share(counts[mine, at], total[mine], kinds)
            q = share(np.asarray(rows["overall"]), np.asarray(rows["grand"]), kinds)
            above = np.flatnonzero(p > q)
            mine, at, value = mine[above], at[above], price(p[above], q[above])
            spelled = np.argsort(np.argsort([x.encode() for x in named], kind="stable"))
            order = np.lexsort((spelled[at], -value, mine))
            mine, at, value = mine[order], at[order], value[order]
            rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
            best = rank < tops
            out += [(lang, sources[g], "term", named[t], v) for g, t, v in zip(mine[best].tolist(), at[best].tolist(), value[best].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in _OUT]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    def run(table):
        made = work(table)
        give_back()
        return made

    return run


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])


def _portion_counts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Occurrences and documents of every (group, term) of a portion of the texts."""
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    sources = max(len(source.dictionary), 1)
    group = np.asarray(lang.indices, dtype=np.int64) * sources + np.asarray(source.indices)
    for low, high, data, offsets in text_portions(batch.column("body"), PORTION_BYTES):
        words = Words(data, offsets, _LETTERS)
        if not len(words):
            continue
        bounds = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int64)
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[words.inside]])])
        terms = spelled.dictionary_encode()
        kinds, number = len(terms.dictionary), np.asarray(terms.indices, dtype=np.int64)
        in_text, times = np.unique(words.text * kinds + number, return_counts=True)
        owner = group[low:high][in_text // kinds] * kinds + in_text % kinds
        keys, at = np.unique(owner, return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        np.add.at(count, at, times)
        named = keys // kinds
        columns = [
            lang.dictionary.take(pa.array(named // sources)),
            source.dictionary.take(pa.array(named % sources)),
            terms.dictionary.take(pa.array(keys % kinds)).cast(pa.binary()),
            pa.array(count),
            pa.array(np.bincount(at, minlength=len(keys))),
        ]
        yield pa.Table.from_arrays(columns, schema=_COUNTS)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, summed up as long as they stay within ``HELD_ROWS`` rows."""
    held: list[pa.Table] = []
    rows = 0

    def summed() -> pa.Table:
        made = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
        return made.select(["lang", "source", "term", "count_sum", "docs_sum"]).rename_columns(_COUNTS.names)

    for batch in batches:
        for part in _portion_counts(batch):
            held.append(part)
            rows += part.num_rows
            if rows > HELD_ROWS:
                held = [summed()]
                rows = held[0].num_rows
                if 2 * rows > HELD_ROWS:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
                    rows = 0
    if held:
        yield from summed().to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term, and documents with it, in each group.

    Tasks sum up before anything is sent; what they send is dealt out by
    language and term, as the sums over a language need it next.
    """
    given = docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("body"))
    parts = given.mapInArrow(_count_terms, "lang string, source string, term binary, count long, docs long")
    spelled = parts.select("lang", "source", F.col("term").cast("string").alias("term"), "count", "docs").repartition("lang", "term")
    return spelled.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, tops: int = 10, block: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """Divergence of all pairs of groups of a language, and the terms that mark each group.

    Gives lang, source, part, item, value, rank.  A language keeps the V terms
    that at least ``least_docs`` of its documents hold.  A group that holds
    count of N kept occurrences gives a term the share
    1 + floor(10**9 * (count + 2) / (N + 2 V)), and so does the language as a
    whole.  Shares p and q cost floor((p - q)**2 / (p + q)).

    * ``pair``: item is another source of the language, value the cost summed
      over all kept terms (0 if there are none).
    * ``term``: item is a kept term of the group whose share is above the
      language's, value its cost; the ``tops`` dearest.

    Ranks count from 1 by falling value, then by the bytes of the item.  NULL
    languages, sources and texts count as ''.  Every row is a document, repeated
    ones too.  A group without terms takes part in pairs; a language with one
    source has none.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    of_lang = Window.partitionBy("lang", "term")
    counted = term_counts(docs, lang, source, text).withColumns({"overall": F.sum("count").over(of_lang), "_docs": F.sum("docs").over(of_lang)})
    kept = cut_lineage(counted.filter(F.col("_docs") >= least_docs).drop("docs", "_docs"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("amount"))
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["amount"])
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.sum("amount").alias("grand")).join(vocabulary, "lang", "left").fillna(0, ["kinds"])
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kinds") / block))).withColumn("tiles", F.ceil(F.col("groups") / tile))
    langs = cut_lineage(langs)

    dealt = lambda name, parts: F.pmod(F.xxhash64(name), F.col(parts))
    placed = lookup_join(kept, langs, ["lang"], ["term"]).withColumn("block", dealt("term", "blocks")).withColumn("tile", dealt("source", "tiles"))
    filled = placed.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("size"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    heads = lookup_join(groups, langs.drop("grand", "groups"), ["lang"], ["source"]).withColumn("tile", dealt("source", "tiles")).withColumn("block", blocks)
    heads = heads.join(filled, ["lang", "block"], "left").fillna(0, ["size"])
    zero = F.lit(0).cast("long")
    head_rows = heads.select("lang", "block", "tile", "tiles", F.lit(0).alias("kind"), F.col("source").alias("name"), "source", "amount", "kinds", "size", zero.alias("overall"), zero.alias("grand"))
    count_rows = placed.select("lang", "block", "tile", "tiles", F.lit(1).alias("kind"), F.col("term").alias("name"), "source", F.col("count").alias("amount"), zero.alias("kinds"), zero.alias("size"), "overall", "grand")
    every = head_rows.unionByName(count_rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tasks = every.select("*", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")).drop("other", "tiles")
    priced = tasks.groupBy("lang", "block", "one", "two").applyInArrow(_pricer(tops), "lang string, source string, part string, item string, value long")
    summed = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= tops))
