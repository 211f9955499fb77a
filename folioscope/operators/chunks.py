"""Chunks: character windows, packed elements, and the split of oversized text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import ids
from folioscope.functions import text as txt
from folioscope.functions.grouping import blocked_row_number, blocked_running_sum, null_safe_on, ordered_concat
from folioscope.functions.rows import explode_rows
from folioscope.functions.text import TOKENS_PER_WORD
from folioscope.session import cut_lineage

CHAR_CHUNKER = "char-v1"
PACK_CHUNKER = "packed-v1"


def character_chunks(files: DataFrame, max_chars: int = 4000, overlap_chars: int = 400, keep: Sequence[str] = ()) -> DataFrame:
    """Chunk table from plain text; the index counts the chunks that are kept. ``keep`` names columns of the file that its chunks carry."""
    windows = txt.chunk_windows(F.col("text"), max_chars, overlap_chars)
    return _chunk_rows(explode_rows(files, ["file_hash", *keep], windows, "text", "chunk_index"), F.lit(CHAR_CHUNKER), keep)


def _chunk_rows(pieces: DataFrame, chunker: Column, keep: Sequence[str] = ()) -> DataFrame:
    return pieces.select(
        ids.chunk_id(F.col("file_hash"), F.col("chunk_index")).alias("chunk_id"),
        "file_hash",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "text",
        F.length("text").alias("char_count"),
        F.to_json(F.struct(chunker.alias("chunker"))).alias("metadata_json"),
        *keep,
    )


class _Parcel:
    """Text that is being filled; keeps sizes so that no text is counted twice."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.chars = 0
        self.words = 0

    def fits(self, chars: int, words: int, budget: int) -> bool:
        joined = self.chars + chars + (1 if self.pieces else 0)
        return max(1, math.ceil(joined / 4), math.ceil((self.words + words) * TOKENS_PER_WORD)) <= budget

    def add(self, piece: str, words: int) -> None:
        self.chars += len(piece) + (1 if self.pieces else 0)
        self.words += words
        self.pieces.append(piece)


def split_to_budget(text: str, budget: int) -> list[str]:
    """Greedy over lines; a line above the budget is split greedily over words.

    Blank lines vanish and lines lose their trailing space, as every growing
    part is kept stripped.
    """
    parts: list[str] = []
    parcel = _Parcel()

    def close(separator: str) -> None:
        nonlocal parcel
        if parcel.pieces:
            parts.append(separator.join(parcel.pieces))
        parcel = _Parcel()

    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        kept = line.rstrip() if parcel.pieces else line.strip()
        if parcel.fits(len(kept), len(words), budget):
            parcel.add(kept, len(words))
            continue
        close("\n")
        if parcel.fits(len(line), len(words), budget):
            parcel.add(line.strip(), len(words))
            continue
        for word in words:
            if parcel.pieces and not parcel.fits(len(word), 1, budget):
                close(" ")
            parcel.add(word, 1)
        close(" ")
    close("\n")
    return parts


def _splitter(budget: int) -> Callable:
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else split_to_budget(t, budget) for t in texts])

    return split


def budget_parts(text: Column, max_tokens: int = 1200) -> Column:
    """Parts within the token budget; only oversized text is passed to Python."""
    oversized = txt.estimate_tokens(text) > max_tokens
    parts = _splitter(max_tokens)(F.when(oversized, text))
    return F.when(oversized, parts).otherwise(F.array(text))


def split_oversized(chunks: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """Adds part_index and is_split; parts of one text keep their order."""
    exploded = explode_rows(chunks, ["*"], budget_parts(F.col("text"), max_tokens), "part_text", "part_index")
    return exploded.withColumn("is_split", F.length("part_text") != F.length("text"))


def pack_elements(
    elements: DataFrame, max_tokens: int = 1200, block: int = 256, keys: Sequence[str] = ("file_hash",)
) -> DataFrame:
    """Elements in order, packed into chunks by their running token count.

    An element belongs to the budget slice in which it starts, so no element
    has to wait for the one before it and a large file is packed in blocks.
    ``pack_no`` numbers the packs; parts above the budget are split afterwards.
    """
    sized = elements.withColumn("tokens", txt.estimate_tokens(F.col("text")))
    running = blocked_running_sum(
        sized, keys, F.floor(F.col("ordinal") / block), [F.col("ordinal")], F.col("tokens"), "_upto"
    )
    return running.withColumn("pack_no", F.floor((F.col("_upto") - F.col("tokens")) / max_tokens).cast("long")).drop("_upto")


def _next_starts(sized: DataFrame, keys: Sequence[str], max_tokens: int) -> DataFrame:
    """For each element the one that starts the next pack if a pack starts here: keys, ordinal, following.

    ``_upto`` is the running token count.  The next pack starts at the first
    element whose count passes that of this pack by more than the budget.
    Counts are cut into ranges, so a file is looked through in many tasks; an
    element whose range holds no such element takes the first of a later one.
    """
    alone = F.col("tokens") > max_tokens
    passed = F.when(alone, F.col("_upto")).otherwise(F.col("_upto") - F.col("tokens") + max_tokens)
    # where counts are equal, elements stand in their order, and a question behind all of them or behind its own
    behind = F.when(alone, F.col("ordinal").cast("long")).otherwise(F.lit((1 << 63) - 1))
    event = lambda asks, at, place: F.struct(F.lit(asks).alias("asks"), at.alias("at"), place.alias("place"))
    pair = F.array(event(False, F.col("_upto"), F.col("ordinal").cast("long")), event(True, passed, behind))
    ranged = sized.select(*keys, "ordinal", F.inline(pair)).withColumn("range", F.floor(F.col("at") / (8 * max_tokens)))
    element = F.when(~F.col("asks"), F.struct("at", "ordinal"))
    downwards = Window.partitionBy(*keys, "range").orderBy(F.desc("at"), F.desc("place"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_near", F.last(element, ignorenulls=True).over(downwards)).filter("asks")
    firsts = ranged.groupBy(*keys, "range").agg(F.min(element).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = firsts.select(*keys, "range", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    found = inside.alias("i").join(beyond.alias("b"), null_safe_on("i", "b", [*keys, "range"]))
    return found.select(*[F.col(f"i.{k}") for k in keys], "ordinal", F.coalesce("_near.ordinal", "_later.ordinal").alias("following"))


def greedy_packs(elements: DataFrame, max_tokens: int = 1200, block: int = 256, keys: Sequence[str] = ("file_hash",)) -> DataFrame:
    """Elements in order, each pack filled as far as the budget goes before the next one starts.

    Adds ``tokens`` and ``pack_no``.  Where a pack ends depends on where it
    began, yet nothing is folded along a file: every element points to the start
    of the pack after one that starts with it, and pointers are doubled (1, 2,
    4, ... packs ahead) while the known starts are followed, so the number of
    rounds grows with the logarithm of the packs of a file.  An element above
    the budget is a pack of its own.
    """
    sized = elements.withColumn("tokens", txt.estimate_tokens(F.col("text")))
    order, part = [F.col("ordinal")], F.floor(F.col("ordinal") / block)
    running = blocked_running_sum(sized, keys, part, order, F.col("tokens"), "_upto")
    counted = cut_lineage(running.select(*keys, "ordinal", "tokens", "_upto"))
    jump = cut_lineage(_next_starts(counted, keys, max_tokens).filter("following IS NOT NULL"))
    starts = counted.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"))
    same = lambda left, right, a, b: null_safe_on(left, right, keys) & (F.col(f"{left}.{a}") == F.col(f"{right}.{b}"))
    while not jump.isEmpty():
        reached = starts.alias("s").join(jump.alias("j"), same("s", "j", "ordinal", "ordinal"))
        starts = cut_lineage(starts.unionByName(reached.select(*[F.col(f"s.{k}") for k in keys], F.col("j.following").alias("ordinal"))))
        twice = jump.alias("a").join(jump.alias("b"), same("a", "b", "following", "ordinal"))
        jump = cut_lineage(twice.select(*[F.col(f"a.{k}") for k in keys], "a.ordinal", "b.following"))
    opened = starts.withColumn("_opens", F.lit(1)).alias("o")
    marked = sized.alias("e").join(opened, same("e", "o", "ordinal", "ordinal"), "left").select("e.*", F.coalesce("o._opens", F.lit(0)).alias("_opens"))
    numbered = blocked_running_sum(marked, keys, part, order, F.col("_opens"), "_no")
    return numbered.withColumn("pack_no", (F.col("_no") - 1).cast("long")).drop("_no", "_opens")


def packed_chunks(elements: DataFrame, max_tokens: int = 1200, greedy: bool = False) -> DataFrame:
    """Chunk table from ordered elements, in slices of the token count or, if ``greedy``, in filled packs."""
    packed = greedy_packs(elements, max_tokens) if greedy else pack_elements(elements, max_tokens)
    keys = ["file_hash", "pack_no"]
    texts = ordered_concat(packed, keys, "ordinal", "text", "\n", "text")
    split = split_oversized(texts, max_tokens)
    numbered = blocked_row_number(
        split,
        ["file_hash"],
        F.floor(F.col("pack_no") / 64),
        [F.col("pack_no"), F.col("part_index")],
        "chunk_no",
    )
    pieces = numbered.select(
        "file_hash",
        "pack_no",
        "part_index",
        "is_split",
        (F.col("chunk_no") - 1).cast("int").alias("chunk_index"),
        F.col("part_text").alias("text"),
    )
    return pieces.select(
        ids.chunk_id(F.col("file_hash"), F.col("chunk_index")).alias("chunk_id"),
        "*",
        F.length("text").alias("char_count"),
        txt.estimate_tokens(F.col("text")).alias("tokens"),
        F.lit(PACK_CHUNKER).alias("chunker"),
    )


def chunk_items(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which elements each chunk was packed from."""
    keys = ["file_hash", "pack_no"]
    refs = packed.select(*keys, F.col("source_ref").alias("item_ref"), "ordinal")
    owners = chunks.select(*keys, "chunk_id", "chunk_index")
    return owners.alias("c").join(refs.alias("r"), null_safe_on("c", "r", keys)).select(
        "c.file_hash", "c.chunk_id", "c.chunk_index", "r.item_ref", "r.ordinal"
    )


def filled_chunks(elements: DataFrame, max_tokens: int = 1200) -> DataFrame:
    return packed_chunks(elements, max_tokens, greedy=True)


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"chars": character_chunks, "packed": packed_chunks, "filled": filled_chunks}


def build_chunks(kind: str, source: DataFrame, **options: int) -> DataFrame:
    if kind not in CHUNKERS:
        raise ValueError(f"Unsupported chunker: {kind}")
    return CHUNKERS[kind](source, **options)
