"""Document fingerprints by I-Match: hashes of sorted distinct terms from randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band:
common words say nothing about a document, rare ones are often misspelled.  It is
randomised ``LEXICONS`` times: a hash of a term ranks it in each, and each
lexicon is halved again and again by that rank.  A document takes from each
lexicon the smallest part that still holds one of its terms, sorts the distinct
terms it has in that part, and hashes them.  A part of fixed size would leave a
long document so many terms that any edit changes every hash, and a short one
none.  Documents are alike to the degree in which their hashes agree.

Everything is built of DataFrame functions.  A term of the lexicon stands in a
fixed share of the documents at least, so the lexicon has no more terms than the
mean number of distinct words divided by that share, however many documents
there are; its size is measured all the same before it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.binding import bind
from folioscope.functions.grouping import lookup_join
from folioscope.session import cut_lineage

#: Band of the inverse document frequency, ln(documents / documents with the term).
BAND = (3.0, 7.0)
LEXICONS = 16
#: Runs of letters, digits and characters outside ASCII, for texts in lower case.  What
#: separates them is named one by one: Java looks such a class up in a table, and
#: tries one range after the other for each character of a class of ranges.
WORD = "[^" + "".join(f"\\x{code:02X}" for code in range(128) if not (48 <= code <= 57 or 97 <= code <= 122)) + "]+"
#: Longs that hold the halvings of a term, 16 bits for each of four lexicons.
PARTS = ["p0", "p1", "p2", "p3"]


def shares(band: tuple[float, float] = BAND) -> tuple[float, float]:
    """Least and greatest share of the documents that hold a term of the band."""
    return math.exp(-band[1]), math.exp(-band[0])


def distinct_words(text: Column) -> Column:
    """Distinct words in lower case: runs of letters, digits and characters outside ASCII."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def halvings(term: Column) -> Column:
    """How often each lexicon can be halved before the term drops out, as so many ones.

    Up to 15 ones of lexicon j stand in the long j // 4 from bit 16 * (j % 4) on, so
    that the longs of several terms, OR-ed, hold the greatest number of halvings.
    """

    def ones(hashed: Column, j: int) -> Column:
        rank = F.conv(F.substring(hashed, 4 * j + 1, 4), 16, 10).cast("long")
        power = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(16) - F.length(F.bin(rank)))
        return F.shiftleft(power - 1, 16 * (j % 4))

    def longs(hashed: Column) -> Column:
        one = lambda k: reduce(Column.bitwiseOR, [ones(hashed, 4 * k + n) for n in range(4)])
        return F.struct(*[one(k).alias(name) for k, name in enumerate(PARTS)])

    return bind(F.sha2(term.cast("binary"), 256), longs)


def lexicon(docs: DataFrame, text: Column, band: tuple[float, float] = BAND) -> DataFrame:
    """(term, p0, ..., p3): the terms of the band with their places in the randomised lexicons.

    Every row of ``docs`` counts as a document, repeated ones and those without
    text too.
    """
    low, high = shares(band)
    count = docs.count()
    found = docs.select(F.explode(distinct_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    inside = found.filter((F.col("docs") >= low * count) & (F.col("docs") <= high * count))
    return inside.select("term", halvings(F.col("term")).alias("parts")).select("term", "parts.*")


def _one_hash(terms: Column, greatest: Column, j: int) -> Column:
    """Hash of the sorted terms in the smallest part of lexicon j that holds any."""
    place = lambda x: x[PARTS[j // 4]].bitwiseAND(F.lit(0x7FFF << 16 * (j % 4)))
    chosen = lambda best: F.transform(F.filter(terms, lambda x: place(x) == best), lambda x: x["term"])
    return bind(place(greatest), lambda best: F.substring(F.md5(F.array_join(F.sort_array(chosen(best)), " ").cast("binary")), 1, 8))


def _hashes(terms: Column) -> Column:
    together = lambda name: F.aggregate(terms, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(x[name])).alias(name)
    every = lambda greatest: F.array(*[_one_hash(terms, greatest, j) for j in range(LEXICONS)])
    return F.array_join(bind(F.struct(*[together(name) for name in PARTS]), every), "-")


def fingerprint(terms: Column, text: Column) -> Column:
    """The hashes of all lexicons, for terms given as (term, p0, ..., p3).

    A text without a term of the band is hashed by all its words, one without
    words as it is.
    """
    placed = lambda w: bind(halvings(w), lambda p: F.struct(w.alias("term"), *[p[name].alias(name) for name in PARTS]))
    without = bind(F.transform(distinct_words(text), placed), lambda own: F.when(F.size(own) > 0, _hashes(own)).otherwise(F.concat(F.lit("="), F.md5(text.cast("binary")))))
    return F.when(F.size(F.coalesce(terms, F.array())) > 0, _hashes(terms)).otherwise(without)


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes that agree; 1 for equal fingerprints."""
    agree = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda t, v: t + v)
    share = bind(F.struct(F.split(a, "-").alias("x"), F.split(b, "-").alias("y")), lambda s: F.when(F.size(s["x"]) == F.size(s["y"]), agree(s["x"], s["y"]) / F.size(s["x"])).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(share)


def _words_once(lists: Sequence[Column]) -> Column:
    """(texts, term) of each word of the lists, which hold it once, once; bit n of ``texts`` stands for list n."""
    groups = [(1, lists[0])]
    for n, own in enumerate(lists[1:], 1):
        new = reduce(F.array_except, [words for _, words in groups], own)
        groups = [group for bits, words in groups for group in ((bits | 1 << n, F.array_intersect(words, own)), (bits, F.array_except(words, own)))]
        groups.append((1 << n, new))
    marked = lambda bits: lambda w: F.struct(F.lit(bits).alias("texts"), w.alias("term"))
    return F.concat(*[F.transform(words, marked(bits)) for bits, words in groups])


def fingerprints(rows: DataFrame, keys: Sequence[str], texts: Sequence[str], terms: DataFrame) -> DataFrame:
    """``rows`` with the fingerprint of each of the text columns, as ``<name>_print``.

    ``keys`` name each row; where rows are partitioned by them already, nothing
    but a lexicon too large to be broadcast moves them.  Texts may not be NULL;
    a word that several texts of a row share is looked up once.
    """
    lists = F.struct(*[distinct_words(F.col(t)).alias(f"t{n}") for n, t in enumerate(texts)])
    once = bind(lists, lambda found: _words_once([found[f"t{n}"] for n in range(len(texts))]))
    words = rows.select(*keys, F.explode(once).alias("w")).select(*keys, F.col("w.texts").alias("texts"), F.col("w.term").alias("term"))
    known = lookup_join(words, terms, ["term"], list(keys))
    of_text = lambda n: F.collect_list(F.when(F.col("texts").bitwiseAND(1 << n) > 0, F.struct("term", *PARTS)))
    listed = known.groupBy(*keys).agg(*[of_text(n).alias(f"_terms{n}") for n in range(len(texts))])
    made = [fingerprint(F.col(f"_terms{n}"), F.col(t)).alias(f"{t}_print") for n, t in enumerate(texts)]
    return rows.join(listed, list(keys), "left").select(*[F.col(c) for c in rows.columns], *made)


_KEY = ["missing", "id", "a", "b"]


def _in_order(docs: DataFrame) -> DataFrame:
    """One row a document with the key and length of the one before it, in the order of the keys.

    Keys are sorted over ranges; neighbours are found inside a range, and the
    ends of ranges, no more than there are shuffle partitions, meet one another.
    """
    keys = docs.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.max(F.length("text")).alias("chars"))
    ranged = cut_lineage(keys.orderBy(*_KEY).withColumn("range", F.spark_partition_id()))
    row = F.struct(*_KEY, "chars")
    inside = ranged.withColumn("before", F.lag(row).over(Window.partitionBy("range").orderBy(*_KEY)))
    ends = ranged.groupBy("range").agg(F.max(row).alias("end"))
    over = Window.orderBy("range")
    last = F.last("end").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    earlier = ends.select("range", F.coalesce(F.lag("end").over(over), last).alias("_end"))
    known = inside.join(F.broadcast(earlier), "range").withColumn("before", F.coalesce("before", "_end"))
    return known.select(*_KEY, "rows", "chars", *[F.col(f"before.{c}").alias(f"before_{c}") for c in (*_KEY, "chars")])


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Every document with the text whose end is replaced by the beginning of the next document.

    Gives missing, id, a, b (the key of a document: id and two hashes of its
    text), rows, chars, the key of the document before (``before_*``), text and
    edited.  The last floor(chars / part) characters are replaced by as many (or
    all) of the next one's, by ascending id; after the last comes the first.

    Rows equal in id and text are one document (``rows`` says how many); those
    with one id and different texts follow each other in the order of hashes of
    the texts; documents without id come last.  A NULL text counts as ''.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(
        F.col(id_col).isNull().cast("int").alias("missing"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(text, F.lit(23)).alias("b"),
        text.alias("text"),
    )
    bodies = given.groupBy(*_KEY).agg(F.first("text").alias("text"))
    whole = bodies.join(_in_order(given), _KEY)
    sent = whole.select(*[F.col(f"before_{c}").alias(c) for c in _KEY], F.expr(f"left(text, before_chars div {part})").alias("beginning"))
    kept = F.expr(f"left(text, cast(chars - chars div {part} as int))")
    return whole.join(sent, _KEY).withColumn("edited", F.concat(kept, "beginning")).drop("beginning", "before_chars")


def audit_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row for each row of ``docs``; see ``with_edits``
    for the edits, the order, repeated rows, and NULL ids and texts.  An empty
    table gives an empty result; a single document is its own next one.
    """
    terms = cut_lineage(lexicon(docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), band))
    edited = with_edits(docs, id_col, text_col)
    marked = fingerprints(edited, _KEY, ["text", "edited"], terms)
    narrow = cut_lineage(
        marked.select(
            *_KEY, "rows", *[f"before_{c}" for c in _KEY], F.col("chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text_print", "edited_print"
        )
    )
    following = narrow.select(*[F.col(f"before_{c}").alias(c) for c in _KEY], F.col("text_print").alias("next_print"))
    every = narrow.join(following, _KEY).withColumn("_many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(rows - 1) div 4096"))))
    copies = every.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096).cast("long"), F.col("rows") - 4096 * F.col("_many")))))
    return copies.select(
        F.when(F.col("missing") == 0, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("text_print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("text_print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("text_print"), F.col("next_print")).alias("near_next"),
    )
