"""License scans: an exact set-similarity join of text blocks with templates.

A template is a set of words, a block a run of words at most ``slack`` times as
long as the template.  The template's words are put in the order of their
frequency over all documents; a block that holds ``share`` of them holds at
least one of its rarest words (prefix filter), and a document of fewer words
than that cannot qualify (length filter).  Only blocks that reach such a word
and start at a template word are looked at (positional filter), and the words
they share with the template are counted exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import ALNUM, U64, Words, flat, loose, text_portions

#: Wordings of common licenses, by label.
TEMPLATES: dict[str, Sequence[str]] = {
    "apache": ("Licensed under the Apache License, Version 2.0",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work",),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "mpl": ("subject to the terms of the Mozilla Public License, v. 2.0",),
    "reserved": ("Copyright. All rights reserved",),
}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates that one pass over the documents looks for.
TEMPLATES_PER_PASS = 5000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def word_hashes(words: Sequence[str]) -> np.ndarray:
    data, offsets = flat(pa.array([" ".join(words)]))
    return Words(data, offsets, ALNUM).hashes()


def _counts(tokens: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_portions(batch.column("body")):
                hashes = Words(data, offsets, ALNUM).hashes()
                at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                total += np.bincount(at[tokens[at] == hashes], minlength=len(tokens))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[some].astype(np.int64)), pa.array(total[some])], ["token", "n"])

    return run


class Template:
    def __init__(self, label: str, text: str, frequency: Mapping[int, int], share: float, slack: float):
        tokens = np.unique(word_hashes(split_words(text)))
        self.label, self.size = label, len(tokens)
        self.needed = max(1, math.ceil(share * len(tokens) - 1e-9))
        self.reach = max(len(tokens), math.ceil(slack * len(split_words(text))))
        ordered = sorted(tokens.tolist(), key=lambda t: (frequency.get(t, 0), t))
        self.tokens = tokens
        self.prefix = np.array(ordered[: len(ordered) - self.needed + 1], U64)

    def blocks(self, place: np.ndarray, token: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Best block of each stretch, from the sorted places of template words in one text."""
        rare = np.isin(token, self.prefix)
        if not rare.any() or len(place) < self.needed:
            return
        best, ends = None, -1
        near = np.searchsorted(place, place[rare] - self.reach, side="right"), np.searchsorted(place, place[rare], side="right")
        starts = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(*near, strict=True)]))
        for at in starts:
            stop = int(np.searchsorted(place, place[at] + self.reach))
            shared = len(np.unique(token[at:stop]))
            if shared < self.needed:
                continue
            found = (int(place[at]), int(place[stop - 1]) + 1, shared / self.size)
            if found[0] >= ends:
                if best:
                    yield best
                best, ends = found, found[1]
            elif found[2] > best[2]:
                best, ends = found, max(ends, found[1])
        if best:
            yield best


_BLOCK = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
_PLACE = pa.struct([("label", pa.string()), ("first", pa.int64())])


def _matches(templates: list[Template], phrases: list[tuple[str, np.ndarray]]):
    every = np.unique(np.concatenate([t.tokens for t in templates])) if templates else np.zeros(0, U64)
    rare = np.unique(np.concatenate([t.prefix for t in templates])) if templates else np.zeros(0, U64)
    by_rare: dict[int, list[Template]] = {}
    for t in templates:
        for token in t.prefix.tolist():
            by_rare.setdefault(token, []).append(t)

    def is_one_of(hashes, known):
        if not len(known):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                words = Words(data, offsets, ALNUM)
                hashes, rows = words.hashes(), high - low
                places: list[list] = [[] for _ in range(rows)]
                for label, wanted in phrases:
                    n = len(wanted)
                    hit = np.flatnonzero(hashes[: max(len(hashes) - n + 1, 0)] == wanted[0])
                    for step in range(1, n):
                        hit = hit[hashes[hit + step] == wanted[step]]
                    hit = hit[words.text[hit] == words.text[hit + n - 1]]
                    for at in hit.tolist():
                        text = int(words.text[at])
                        places[text].append({"label": label, "first": at - int(words.bounds[text])})
                blocks: list[list] = [[] for _ in range(rows)]
                held = np.flatnonzero(is_one_of(hashes, every))
                seldom = held[is_one_of(hashes[held], rare)]
                owner = words.text[held]
                for text in np.unique(words.text[seldom]).tolist():
                    a, b = np.searchsorted(owner, (text, text + 1))
                    place, token = held[a:b] - words.bounds[text], hashes[held[a:b]]
                    wanted = {id(t): t for k in set(token.tolist()) & by_rare.keys() for t in by_rare[k]}
                    for t in wanted.values():
                        own = is_one_of(token, t.tokens)
                        for first, last, share in t.blocks(place[own], token[own]):
                            blocks[text].append({"label": t.label, "first": first, "last": last, "share": share})
                yield pa.RecordBatch.from_arrays(
                    [loose(batch.column("row")).slice(low, rows), pa.array(np.diff(words.bounds)), pa.array(places, pa.list_(_PLACE)), pa.array(blocks, pa.list_(_BLOCK))],
                    ["row", "n_words", "places", "blocks"],
                )

    return run


def license_blocks(
    docs: DataFrame,
    text_col: str = "text",
    carry: list[str] | None = None,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    share: float = 0.8,
    slack: float = 1.25,
) -> DataFrame:
    """Phrases and license blocks of every text: row, n_words, places, blocks.

    ``row`` is a struct of the ``carry`` columns.  ``places`` lists where the
    words of a phrase stand consecutively, ``blocks`` the text blocks that hold
    ``share`` of a template's words (of blocks that overlap, the best one).
    NULL and empty texts have neither; an empty table gives an empty result;
    repeated rows are judged one by one.

    Only the counts of the templates' words come to the driver.  Templates
    beyond ``TEMPLATES_PER_PASS`` are looked for in further passes.
    """
    named = [(label, text) for label, texts in sorted(templates.items()) for text in texts if split_words(text)]
    own = docs.select(F.struct(*[F.col(c) for c in (carry or ["doc_id"])]).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    wanted = [(label, word_hashes(split_words(text))) for text, label in sorted(phrases.items())]
    schema = f"row {own.schema['row'].dataType.simpleString()}, n_words long, places array<struct<label:string,first:bigint>>, blocks array<struct<label:string,first:bigint,last:bigint,share:double>>"
    frequency: dict[int, int] = {}
    for low in range(0, len(named), TEMPLATES_PER_PASS):
        tokens = np.unique(np.concatenate([word_hashes(split_words(text)) for _, text in named[low : low + TEMPLATES_PER_PASS]]))
        counted = own.select("body").mapInArrow(_counts(tokens), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        frequency.update((r["token"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in counted.collect())
    made = [Template(label, text, frequency, share, slack) for label, text in named]
    if len(made) <= TEMPLATES_PER_PASS:
        return own.mapInArrow(_matches(made, wanted), schema)
    numbered = own.withColumn("row", F.struct(F.monotonically_increasing_id().alias("at"), F.col("row").alias("row")))
    inner = f"row {numbered.schema['row'].dataType.simpleString()}, n_words" + schema.partition(", n_words")[2]
    parts = None
    for low in range(0, len(made), TEMPLATES_PER_PASS):
        part = numbered.mapInArrow(_matches(made[low : low + TEMPLATES_PER_PASS], wanted if low == 0 else []), inner)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("row.at").agg(
        F.first("row.row").alias("row"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("blocks")).alias("blocks")
    ).drop("at")


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last phrase, labels and the best share of every document."""

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base, own = F.transform("places", lambda x: x["label"]), F.transform("blocks", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["first"])
    best = F.array_max(F.transform("blocks", lambda x: x["share"]))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
