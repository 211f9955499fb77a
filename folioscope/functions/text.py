"""Text expressions: whitespace, tokens, token estimates, chunk windows.

All of them are built-in expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.binding import bind

# The characters that count as white space at the ends of a text.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TRAILING_SPACE = r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)"

# Token patterns (letters and digits of any script).
QUERY_TOKEN = r"([\p{L}\p{N}_.-]+)"
TERM = r"[\p{L}\p{N}_]+(?:[.'_-][\p{L}\p{N}_]+)*"
EVIDENCE_TOKEN = r"([$€£₱]|[A-Za-z0-9]+(?:[./:_-][A-Za-z0-9]+)*)"

# The token estimate and the prompt budget.
CHARS_PER_TOKEN = 4
TOKENS_PER_WORD = 1.35
PROMPT_OVERHEAD_TOKENS = 900
OUTPUT_TOKENS_MIN = 2048
OUTPUT_TOKENS_MAX = 8192
OUTPUT_TOKENS_FACTOR = 1.25

# Page text that carries nothing.
USABLE_MIN_CHARS = 8
UNUSABLE_TEXTS = ("", "n/a", "na", "none", "null", "not available")

PREVIEW_CHARS = 260
TRUNCATION_MARK = "... [truncated]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACE_RUN, " "), F.lit(" "))


def clean_query(query: Column) -> Column:
    return collapse_spaces(F.lower(F.coalesce(query, F.lit(""))))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(QUERY_TOKEN), F.lit(1))


def term_tokens(text: Column) -> Column:
    """Lower-cased index terms of a text, without offsets."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def evidence_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(EVIDENCE_TOKEN), F.lit(1))
    trimmed = F.transform(found, lambda t: F.lower(F.btrim(t, F.lit("._"))))
    return F.filter(trimmed, lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def estimate_tokens(text: Column) -> Column:
    by_chars = F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")
    by_words = F.ceil(word_count(text) * F.lit(TOKENS_PER_WORD)).cast("long")
    size = F.greatest(F.lit(1).cast("long"), by_chars, by_words)
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0).cast("long")).otherwise(size)


def prompt_tokens(text: Column, system_prompt: Column) -> Column:
    return estimate_tokens(text) + estimate_tokens(system_prompt) + F.lit(PROMPT_OVERHEAD_TOKENS)


def output_tokens(text: Column) -> Column:
    wanted = F.ceil(estimate_tokens(text) * F.lit(OUTPUT_TOKENS_FACTOR)).cast("long")
    return F.greatest(
        F.lit(OUTPUT_TOKENS_MIN).cast("long"), F.least(F.lit(OUTPUT_TOKENS_MAX).cast("long"), wanted)
    )


def preview(text: Column, size: int = PREVIEW_CHARS) -> Column:
    """The opening, white space collapsed; of a long text only the beginning is gone through where that is enough."""
    opening = F.substring(collapse_spaces(F.substring(text, 1, 4 * size)), 1, size)
    return bind(opening, lambda known: F.when(F.length(known) >= size, known).otherwise(F.substring(collapse_spaces(text), 1, size)))


def truncate(text: Column, limit: int) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit(TRUNCATION_MARK))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def is_usable_text(text: Column) -> Column:
    flat = F.lower(collapse_spaces(F.coalesce(text, F.lit(""))))
    return (F.length(flat) >= USABLE_MIN_CHARS) & ~flat.isin(*UNUSABLE_TEXTS)


def like_literal(haystack: Column, pattern: Column) -> Column:
    """LIKE in which only ``%`` and ``_`` are special.

    Spark treats a backslash as the escape character; NUL never occurs in a
    cleaned query, so naming it as the escape makes backslashes ordinary.
    """
    return F.like(haystack, pattern, F.lit("\x00"))


def ilike_any(needle: str, *columns: Column) -> Column:
    """Case-insensitive contains over several columns; NULL counts as empty."""
    pattern = F.lit(f"%{needle.strip().lower()}%")
    hit = F.lit(False)
    for column in columns:
        hit = hit | like_literal(F.lower(F.coalesce(column, F.lit(""))), pattern)
    return hit


def normalized_lines(text: Column) -> Column:
    """Every line without trailing space, the whole without outer space."""
    unified = F.regexp_replace(text, LINE_BREAK, "\n")
    return strip(F.regexp_replace(unified, TRAILING_SPACE, ""))


def chunk_windows(text: Column, max_chars: int = 4000, overlap_chars: int = 400) -> Column:
    """Overlapping character windows of a text as an array of strings.

    The last window is the one that reaches the end, so no window consists
    of overlap only.  Windows that are blank are left out.
    """
    if max_chars <= overlap_chars:
        raise ValueError("max_chars must be greater than overlap_chars.")
    step = max_chars - overlap_chars

    # The body is cut once into pieces of a step; a window is a piece and the beginning of what follows.
    following = -(-overlap_chars // step)

    def joined(pieces: Column, count: Column) -> Column:
        numbers = F.sequence(F.lit(1), count)
        whole = F.transform(numbers, lambda i: F.array_join(F.slice(pieces, i, F.lit(following + 1)), ""))
        return F.filter(F.transform(whole, lambda text: strip(F.substring(text, 1, max_chars))), lambda piece: piece != "")

    def windows(body: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.length(body) - overlap_chars) / F.lit(step))).cast("int")
        cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        return bind(cut, lambda pieces: joined(pieces, count))

    return bind(normalized_lines(text), windows)
