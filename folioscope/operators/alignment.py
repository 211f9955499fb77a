"""Place reader texts on a page by aligning them with the page's words.

Windows of page words are found through shared rare words, never by trying
every window: a window good enough must contain one of a text's seed words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import boxes
from folioscope.functions import text as txt
from folioscope.functions.grouping import first_per_group, lookup_join
from folioscope.functions.rows import explode_rows
from folioscope.session import cut_lineage

# Windows of n-1 to n+2 words, the length penalty, the least scores.
SHORT_TARGET = 3
LEAST_SHORT = 1.0
LEAST_LONG = 0.72
LENGTH_PENALTY = 0.12
BAND_TOLERANCE = 8.0
BAND_STEP = 32.0
START_BLOCK = 64

ROW_LABEL = "mistral_ocr_table_row"
CELL_LABEL = "mistral_ocr_table_cell"
TABLE_LABEL = "mistral_ocr_table"

SCOPE = ["file_hash", "page_no", "scope"]
ELEMENT = [*SCOPE, "source_ref"]
TARGET = [*SCOPE, "target"]


def _best_of(hits: list[int], n: int, starts: list[int], every: bool) -> list[dict]:
    """Windows of the best score, if that is good enough: all of them, or the first of the smallest size.

    ``hits`` has, for each word of the stretch, the places of the text that hold
    it as bits.  The longest common subsequence with every prefix of a window is
    bit-parallel: one step of a machine integer per window word.
    """
    full, sizes = (1 << n) - 1, sorted({max(1, n - 1), n, n + 1, n + 2})
    best, found = LEAST_SHORT if n <= SHORT_TARGET else LEAST_LONG, []
    known = [0, *accumulate(1 if places else 0 for places in hits)]
    for at in starts:
        # No window has more words in common than it has words of the text.
        if (known[min(at + n + 2, len(hits))] - known[min(at, len(hits))]) / n < best:
            continue
        row, shared = full, []
        for places in hits[at : at + n + 2]:
            if places:
                hit = row & places
                row = ((row + hit) | (row - hit)) & full
            shared.append(n - row.bit_count())
        for size in sizes:
            if size <= len(shared):
                score = max(0.0, shared[size - 1] / n - abs(size - n) / n * LENGTH_PENALTY)
                if score > best:
                    best, found = score, []
                if score >= best:
                    found.append((size, at))
    shown = found if every else [min(found)] if found else []
    return [{"at": at, "size": size, "score": best} for size, at in shown]


_BEST_WINDOWS = T.ArrayType(
    T.StructType().add("at", T.IntegerType()).add("size", T.IntegerType()).add("score", T.DoubleType())
)


@F.pandas_udf(_BEST_WINDOWS)
def _best_windows(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Windows of a stretch of words that can be the best of a text, from the given starts."""
    for targets, stretches, starts, every in batches:
        rows = []
        for target, words, offsets, ties in zip(targets, stretches, starts, every):
            places: dict[str, int] = {}
            for i, word in enumerate(target):
                places[word] = places.get(word, 0) | (1 << i)
            rows.append(_best_of([places.get(word, 0) for word in words], len(target), list(offsets), ties))
        yield pd.Series(rows)


def _least_score(n: Column) -> Column:
    return F.when(n <= SHORT_TARGET, F.lit(LEAST_SHORT)).otherwise(F.lit(LEAST_LONG))


def _may_miss() -> Column:
    """How many of its n words a text may lack in a good window."""
    return (F.col("n") - F.ceil(_least_score(F.col("n")) * F.col("n") - 1e-9)).cast("int")


def _seeds(targets: DataFrame, words: DataFrame) -> DataFrame:
    """The rarest words of each text: so many that a good window has one of them.

    A score of s needs at least s*n words in common, so at most n - ceil(s*n)
    words may be missing, and one more than that cannot all be missing.
    """
    counts = words.groupBy(*SCOPE, "word").agg(F.count("*").alias("_df"))
    spread = targets.select(*TARGET, "n", F.posexplode("tokens").alias("at", "word"))
    rated = spread.join(counts, [*SCOPE, "word"], "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    rarest = Window.partitionBy(*TARGET).orderBy("_df", "at")
    ranked = rated.withColumn("_rank", F.row_number().over(rarest))
    return ranked.filter((F.col("_rank") <= _may_miss() + 1) & (F.col("_df") > 0)).select(*TARGET, "n", "at", "word")


def align(targets: DataFrame, words: DataFrame) -> DataFrame:
    """Best window per text.

    ``targets``: file_hash, page_no, scope, source_ref, tokens, estimate (box or NULL).
    ``words``: file_hash, page_no, scope, word_no (1-based in the scope), word, box.

    Every join and group is by page and something else, so nothing but the
    input is shuffled where both sides are dealt out by page (``roles.dealt_turns``).
    """
    # Equal texts of a page with an equal estimate have one window.
    content = F.md5(F.to_json(F.struct("tokens", "estimate")))
    first = lambda name: F.any_value(name).alias(name)
    alike = targets.filter(F.size("tokens") > 0).groupBy(*SCOPE, content.alias("target"))
    sized = alike.agg(first("tokens"), first("estimate"), F.collect_set("source_ref").alias("_refs")).withColumn("n", F.size("tokens"))
    seeds = _seeds(sized, words)
    hits = seeds.join(words.select(*SCOPE, "word", "word_no"), [*SCOPE, "word"])
    # In a good window the seed keeps its place in the text up to the words
    # that may be missing and the two words a window may be longer.
    nearest = F.col("word_no") - F.col("at")
    earliest = F.greatest(F.lit(1), nearest - _may_miss() - 2)
    latest = nearest + _may_miss()
    # Starts are taken in blocks, so that a word is read once per block and
    # text instead of once per window.  A hit stays one interval in each of the
    # few blocks it reaches; single starts are made inside the row.
    numbers = F.sequence(F.floor(earliest / START_BLOCK).cast("int"), F.floor(latest / START_BLOCK).cast("int"))
    reached = hits.filter(latest >= 1).select(*TARGET, "n", earliest.alias("_from"), latest.alias("_to"), F.explode(numbers).alias("_block"))
    opening = F.col("_block") * START_BLOCK
    within = F.struct(F.greatest(F.col("_from"), opening).cast("int").alias("low"), F.least(F.col("_to"), opening + START_BLOCK - 1).cast("int").alias("high"))
    intervals = reached.groupBy(*TARGET, "_block").agg(F.collect_set(within).alias("_intervals"))
    each_start = F.array_sort(F.array_distinct(F.flatten(F.transform("_intervals", lambda x: F.sequence(x["low"], x["high"])))))
    blocks = intervals.select(*TARGET, "_block", each_start.alias("_starts")).join(sized.drop("_refs"), TARGET)
    # Words are laid in blocks of the same width; the last window of a block ends a few words into a later one.
    laid = words.groupBy(*SCOPE, F.floor(F.col("word_no") / START_BLOCK).cast("int").alias("_part")).agg(_in_order("word_no", "word").alias("_words"))
    reach = F.sequence(F.col("_block"), F.floor((opening + START_BLOCK + F.col("n")) / START_BLOCK).cast("int"))
    every = F.col("estimate").isNotNull().alias("_every")
    parts = explode_rows(blocks, [*TARGET, "tokens", every, "_block", "_starts"], reach, "_part").join(laid, [*SCOPE, "_part"])
    stretches = parts.groupBy(*TARGET, "_block").agg(first("tokens"), first("_every"), first("_starts"), F.flatten(_in_order("_part", "_words")).alias("_words"))
    low, high = F.element_at("_starts", 1), F.element_at("_starts", -1)
    needed = F.slice("_words", low - F.greatest(opening, F.lit(1)) + 1, high - low + F.size("tokens") + 2)
    best = _best_windows(F.col("tokens"), needed, F.transform("_starts", lambda start: start - low), F.col("_every"))
    each = explode_rows(stretches.select(*TARGET, low.alias("_low"), best.alias("_best")), [*TARGET, "_low"], "_best", "_w")
    found = each.select(*TARGET, (F.col("_low") + F.col("_w.at")).alias("start"), F.col("_w.size").alias("size"), F.col("_w.score").alias("score"))
    # What comes from Python no longer counts as dealt out; the join sends these few narrow rows to their page.
    windows = found.join(sized.select(*TARGET, every), TARGET)
    # Without an estimate the first window of the smallest size wins among equals; with one the box decides.
    whole = Window.partitionBy(*TARGET)
    ranked = windows.withColumn("_rank", F.row_number().over(whole.orderBy(F.col("score").desc(), "size", "start"))).withColumn("_top", F.max("score").over(whole))
    kept = ranked.filter((F.col("_rank") == 1) | (F.col("_every") & (F.col("score") == F.col("_top"))))
    numbered = explode_rows(kept, [*TARGET, "start", "size", "score"], F.sequence(F.col("start"), F.col("start") + F.col("size") - 1).cast("array<bigint>"), "word_no")
    placed = numbered.join(words.select(*SCOPE, "word_no", "box"), [*SCOPE, "word_no"]).groupBy(*TARGET, "start", "size", "score")
    box = boxes.make_box(F.min("box.left"), F.min("box.top"), F.max("box.right"), F.max("box.bottom"))
    boxed = placed.agg(box.alias("raw_bbox")).join(sized.select(*TARGET, "estimate", "_refs"), TARGET)
    guess = F.col("estimate").isNotNull()
    order = [
        F.col("score").desc(),
        F.when(guess, boxes.center_distance(F.col("raw_bbox"), F.col("estimate"))),
        F.when(guess, F.col("raw_bbox.top")),
        F.when(guess, F.col("raw_bbox.left")),
        F.col("size"),
        F.col("start"),
    ]
    rows = boxed.withColumn("source_ref", F.explode("_refs"))
    return first_per_group(rows, ELEMENT, order).select(*ELEMENT, "score", "raw_bbox")


def _in_order(order: str, value: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.transform(rows, lambda row: row[value])


def _numbered(words: DataFrame, order: list[Column]) -> DataFrame:
    return words.withColumn("word_no", F.row_number().over(Window.partitionBy(*SCOPE).orderBy(*order)).cast("long"))


def page_words(tokens: DataFrame) -> DataFrame:
    """Page words split into evidence tokens, numbered over the page."""
    keep = ["file_hash", "page_no", "place", "box"]
    spread = explode_rows(tokens, keep, txt.evidence_tokens(F.col("text")), "word", "part").withColumn("scope", F.lit(""))
    return _numbered(spread, [F.col("place"), F.col("part")])


def _band_words(words: DataFrame, rows: DataFrame) -> DataFrame:
    """Words within the height of each aligned row, numbered anew; an equi-join on height steps."""
    steps = lambda low, high: F.explode(F.sequence(F.floor(low / BAND_STEP), F.floor(high / BAND_STEP)))
    row_box, word_box = F.col("raw_bbox"), F.col("box")
    low = F.least(row_box["top"], row_box["bottom"]) - BAND_TOLERANCE
    high = F.greatest(row_box["top"], row_box["bottom"]) + BAND_TOLERANCE
    bands = rows.select("file_hash", "page_no", F.col("source_ref").alias("_row"), "raw_bbox", steps(low, high).alias("_step"))
    placed = words.drop("scope", "word_no").withColumn("_step", steps(F.least(word_box["top"], word_box["bottom"]), F.greatest(word_box["top"], word_box["bottom"])))
    near = placed.join(bands, ["file_hash", "page_no", "_step"]).filter(boxes.vertical_overlap(word_box, row_box))
    unique = near.drop("_step", "raw_bbox").withColumnRenamed("_row", "scope").dropDuplicates([*SCOPE, "place", "part"])
    return _numbered(unique, [F.col("place"), F.col("part")])


def _align_cells(cells: DataFrame, rows: DataFrame, words: DataFrame) -> DataFrame:
    """Cells within the band of their row; cells of no known row anywhere on the page."""
    owner = rows.select("file_hash", "page_no", F.col("source_ref").alias("parent_ref"), F.lit(True).alias("_has_row"))
    scoped = cells.join(owner, ["file_hash", "page_no", "parent_ref"], "left").withColumn(
        "scope", F.when(F.col("_has_row"), F.col("parent_ref")).otherwise(F.lit(""))
    )
    in_row = align(scoped.filter("_has_row"), _band_words(words, rows))
    return in_row.unionByName(align(scoped.filter("_has_row IS NULL"), words))


def align_elements(elements: DataFrame, tokens: DataFrame) -> DataFrame:
    """Boxes of reader elements: rows and loose texts on the page, cells in their row, tables around their parts.

    ``elements``: file_hash, page_no, source_ref, parent_ref, label, text, estimate.
    ``tokens``: file_hash, page_no, place, text, box.
    """
    # Page words are made anew wherever they are used, in place; stored they would take many times the text.
    words = page_words(tokens)
    tokenized = elements.withColumn("tokens", txt.evidence_tokens(F.col("text")))
    on_page = tokenized.filter(~F.col("label").isin(CELL_LABEL, TABLE_LABEL)).withColumn("scope", F.lit(""))
    found = align(on_page, words)
    keys = ["file_hash", "page_no", "source_ref"]
    placed = cut_lineage(found.select(*keys, "score", "raw_bbox"))
    cells = tokenized.filter(F.col("label") == CELL_LABEL)
    parts = placed
    if not cells.isEmpty():
        is_row = on_page.filter(F.col("label") == ROW_LABEL).select(*keys)
        rows = placed.join(is_row, keys, "left_semi")
        parts = cut_lineage(placed.unionByName(_align_cells(cells, rows, words).select(*keys, "score", "raw_bbox")))
    owners = F.split("source_ref", "/")
    tables = cut_lineage(elements.filter(F.col("label") == TABLE_LABEL).select("file_hash", "source_ref").distinct())
    prefixes = F.transform(F.sequence(F.lit(1), F.size(owners) - 1), lambda n: F.array_join(F.slice(owners, F.lit(1), n), "/"))
    under = parts.filter(F.size(owners) > 1).select("file_hash", "page_no", "raw_bbox", F.explode(prefixes).alias("source_ref"))
    around = lookup_join(under, tables, ["file_hash", "source_ref"], ["page_no", "raw_bbox"]).groupBy("file_hash", "source_ref").agg(
        F.min("page_no").alias("page_no"), boxes.union_box(F.col("raw_bbox")).alias("raw_bbox")
    )
    return parts.unionByName(around.select(*keys, F.lit(None).cast("double").alias("score"), "raw_bbox"))
