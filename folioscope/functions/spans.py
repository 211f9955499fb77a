"""Token offsets and search highlights: the parts that need a scan position."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as txt
from folioscope.functions.binding import bind

TERM_TYPE = T.ArrayType(
    T.StructType().add("token", T.StringType()).add("char_start", T.IntegerType()).add("char_end", T.IntegerType())
)
HIGHLIGHT_TYPE = T.ArrayType(
    T.StructType()
    .add("field", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("match_kind", T.StringType())
    .add("source", T.StringType())
    .add("score_contribution", T.DoubleType())
)

# Snippet size, highlight limits and weights.
SNIPPET_CHARS = 220
SNIPPET_LEAD = 40
SHORT_TEXT_CHARS = 160
PHRASE_WEIGHT = 1.0
TOKEN_WEIGHT = 0.75
FUZZY_WEIGHT = 0.35
CONTEXT_WEIGHT = 0.1

_TERM = re.compile(r"\w+(?:[.'_-]\w+)*")
_QUERY_TOKEN = re.compile(r"[\w.-]+")


@F.pandas_udf(TERM_TYPE)
def term_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Terms of a text with their character offsets, in one pass."""
    for texts in batches:
        yield pd.Series(
            [
                [{"token": m.group(), "char_start": m.start(), "char_end": m.end()} for m in _TERM.finditer(t or "")]
                for t in texts
            ]
        )


def _scattered(query: str, text: str) -> list[tuple[int, int]]:
    """Spans of the query's letters found one after another in the text."""
    free: dict[str, list[int]] = {}
    for position, ch in enumerate(text):
        if ch.isalnum():
            free.setdefault(ch.lower(), []).append(position)
    chosen: list[int] = []
    cursor = 0
    for ch in query:
        places = free.get(ch) if ch.isalnum() else None
        if not places:
            continue
        at = next((p for p in places if p >= cursor), places[0])
        places.remove(at)
        chosen.append(at)
        cursor = at + 1
    spans: list[tuple[int, int]] = []
    for at in sorted(chosen):
        if spans and spans[-1][1] == at:
            spans[-1] = (spans[-1][0], at + 1)
        else:
            spans.append((at, at + 1))
    return spans


def find_highlights(query: str | None, text: str | None, field: str) -> list[dict]:
    """Exact phrase, else exact tokens, else scattered letters or the opening of the text."""
    query = " ".join((query or "").lower().split())
    if not query or not text:
        return []
    lowered = text.lower()
    found: list[tuple[int, int]] = []
    at = lowered.find(query)
    while at >= 0:
        found.append((at, at + len(query)))
        at = lowered.find(query, at + len(query))
    kind, source, weight = "exact_phrase", "exact_phrase", PHRASE_WEIGHT
    if not found:
        wanted = set(_QUERY_TOKEN.findall(query))
        found = [m.span() for m in _QUERY_TOKEN.finditer(text) if m.group().lower() in wanted]
        kind, source, weight = "exact_token", "exact_token", TOKEN_WEIGHT
    if not found and len(text) <= SHORT_TEXT_CHARS:
        found = _scattered(query, text)
        kind, source, weight = "fuzzy_character", "fuzzy_alignment", FUZZY_WEIGHT
    elif not found:
        found = [(0, SHORT_TEXT_CHARS)]
        kind, source, weight = "chunk_context", "chunk_fallback", CONTEXT_WEIGHT
    return [
        {"field": field, "start": s, "end": e, "match_kind": kind, "source": source, "score_contribution": weight}
        for s, e in found
    ]


@F.pandas_udf(HIGHLIGHT_TYPE)
def highlights(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for query, text, field in batches:
        yield pd.Series([find_highlights(q, t, f) for q, t, f in zip(query, text, field)])


def as_index_hits(found: Column) -> Column:
    """Highlights of a full-text hit name the index as their source."""

    def relabel(item: Column) -> Column:
        exact = item["source"].isin("exact_phrase", "exact_token")
        return item.withField("source", F.when(exact, F.lit("fts_term")).otherwise(item["source"]))

    return F.transform(found, relabel)


def phrase_spans(query: Column, text: Column) -> Column:
    """Start and end of every non-overlapping occurrence of a phrase, natively.

    The text between two occurrences is a gap; starts are running gap lengths.
    """
    quoted = F.replace(query, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    gaps = F.split(F.lower(text), F.concat(F.lit(r"\Q"), quoted, F.lit(r"\E")))
    lengths = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, gap: Column) -> Column:
        begin = (state["at"] + gap).cast("int")
        end = (begin + F.length(query)).cast("int")
        hit = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(hit)).alias("found"))

    return F.when(query != "", F.aggregate(lengths, start, step, lambda state: state["found"]))


def first_hit(query: Column, text: Column) -> Column:
    """0-based position of the phrase, else of the earliest query token, else 0."""

    def position(lowered: Column) -> Column:
        whole = F.instr(lowered, query) - 1
        places = F.transform(txt.query_tokens(query), lambda token: F.instr(lowered, token) - 1)
        nearest = F.array_min(F.filter(places, lambda place: place >= 0))
        return F.when(whole >= 0, whole).otherwise(F.coalesce(nearest, F.lit(0)))

    return bind(F.lower(text), position)


def snippet(query: Column, text: Column, size: int = SNIPPET_CHARS) -> Column:
    """A window of the text around the first hit, some context before it."""
    total = F.length(text)
    begin = F.greatest(F.lit(0), first_hit(query, text) - SNIPPET_LEAD)
    begin = F.least(begin, F.greatest(F.lit(0), total - size))
    piece = txt.strip(F.substring(text, begin + 1, F.lit(size)))
    opening = txt.strip(F.substring(text, 1, size))
    return F.when(total <= size, text).when(piece != "", piece).otherwise(opening)
