"""Fingerprints, divergence of sources and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import imatch, periods, segment_trees
from tests.llm.odd import SCHEMA, frame, rows
from tests.llm.test_exact import SPACED, got

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def periodic(words, least, times):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            piece = words[i : i + size]
            if j > i and size >= max(least, times * q) and not any(piece[r:] == piece[: size - r] for r in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (1, 2)])
def test_runs_of_many_texts(least, times):
    rng = random.Random(least)
    for _ in range(40):
        texts = [[]]
        for _ in range(rng.randrange(1, 4)):
            words = []
            for _ in range(rng.randrange(1, 8)):
                kinds = rng.choice([2, 3, 30])
                part = [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]
                words += (part * 12)[: rng.randrange(1, 12 * len(part) + 1)] if rng.random() < 0.6 else words[rng.randrange(len(words) + 1) :][:20] * 3 + part
            texts.append(words)
        bounds = np.cumsum([0] + [len(w) for w in texts])
        found = periods.runs_of(np.array(sum(texts, []), np.int64), bounds, least, times)
        want = [(i + int(bounds[k]), n, q) for k, w in enumerate(texts) for i, n, q in periodic(w, least, times)]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def repeated_rows():
    rng = random.Random(8)
    words = ["alpha", "Beta", "ga", "dé", "…", "x"]
    out = []
    for i in range(60):
        part = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        head = [rng.choice(words) for _ in range(rng.randrange(30))]
        out.append((i, "\t ".join(head + part * rng.randrange(1, 8) + head)))
    return rows() + [(i, t, "en", "s", 1, None, 0, None, None, None) for i, t in out] + [(7, "a " * 500, None, None, None, None, None, None, None, None)]


def test_runs_query(spark):
    want = []
    for i, text, *_ in repeated_rows():
        words = SPACED.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = periodic(words, 24, 3)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(w[1] for w in want) > 20
    given = frame(spark, repeated_rows())
    assert got(periods.digest(periods.periodic_runs(periods.with_planted_periods(given)))) == sorted(want, key=repr)
    carried = periods.periodic_runs(given, carry=["doc_id", "row", "label"])
    assert carried.columns == ["row", "n_words", "runs", "kept"] and carried.count() == len(want)
    assert periods.periodic_runs(frame(spark, [])).count() == 0


def test_a_long_text_has_its_run(spark):
    words = [f"w{k}" for k in range(700)]
    text = " ".join(words * 60)
    found = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 42000, 700)] and bytes(found["kept"]).decode() == " ".join(words)


def divergence(given, least, tops):
    unit, groups, in_docs = 10**9, defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in given:
        terms = [t.translate(CASE) for t in TERMS.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        mine = {s: c for (k, s), c in groups.items() if k == lang}
        share = lambda c, total, kept=kept: {t: 1 + unit * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        total = {s: sum(c[t] for t in kept) for s, c in mine.items()}
        p = {s: share(c, total[s]) for s, c in mine.items()}
        q = share(sum(mine.values(), Counter()), sum(total.values()))
        cost = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in mine.items():
            pairs = [(-sum(cost(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            terms = [(-cost(p[s][t], q[t]), t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:tops])):
                out += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(listed)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "tops", "block", "tile"), [(10, 10, 2048, 16), (2, 3, 4, 2), (1, 4, 3, 1), (99, 5, 2048, 16)])
def test_divergence_of_sources(spark, least, tops, block, tile):
    given = rows() + [(900 + k, "only here", "xx", f"s{k}", None, None, None, None, None, None) for k in range(3)] + [(950, None, "xx", "none", None, None, None, None, None, None)]
    assert got(segment_trees.audit(frame(spark, given), least_docs=least, tops=tops, block=block, tile=tile)) == divergence(given, least, tops)


def test_divergence_of_nothing(spark):
    assert segment_trees.audit(frame(spark, [])).count() == 0


def test_equal_subtrees_are_priced_once():
    counts = np.zeros((3, 1024), np.int64)
    counts[:, 5] = [1, 2, 3]
    forest = segment_trees.Forest(counts)
    assert sum(len(left) for left, _ in forest.levels) < 60
    total = counts.sum(1)
    value, priced = forest.compare(np.array([0, 0]), np.array([1, 2]), total, 1024)
    assert priced < 2 * 2 * 12
    p = [segment_trees.share(c, np.array([t]), 1024) for c, t in zip(counts, total, strict=True)]
    assert value.tolist() == [int(segment_trees.price(p[0], p[k]).sum()) for k in (1, 2)]


def test_shares_of_huge_counts_are_exact():
    count, total = np.array([0, 7 * 10**12, 9 * 10**15]), np.array([9 * 10**15] * 3)
    assert segment_trees.share(count, total, 5).tolist() == [1 + 10**9 * (int(c) + 2) // (9 * 10**15 + 10) for c in count]


def prints(given, low, high):
    """Fingerprint of each text, whole words and lexicons looked up by hand."""
    words = lambda t: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    in_docs = Counter(w for *_, t in given for w in words(t))
    band = {w for w, n in in_docs.items() if low * len(given) <= n <= high * len(given)}

    def one(text):
        terms = words(text) & band or words(text)
        if not terms:
            return "=" + hashlib.md5(text.encode()).hexdigest()
        parts = []
        for j in range(imatch.LEXICONS):
            place = lambda w, j=j: 16 - max(int(hashlib.sha256(w.encode()).hexdigest()[4 * j : 4 * j + 4], 16).bit_length(), 1)
            best = max(map(place, terms))
            parts.append(hashlib.md5(" ".join(sorted(w for w in terms if place(w) == best)).encode()).hexdigest()[:8])
        return "-".join(parts)

    return one


def alike(a, b):
    x, y = a.split("-"), b.split("-")
    return 1.0 if a == b else sum(p == q for p, q in zip(x, y, strict=True)) / len(x) if len(x) == len(y) else 0.0


@pytest.mark.parametrize("bytes_", [8 << 20, 0])
def test_fingerprints(spark, monkeypatch, bytes_):
    monkeypatch.setattr("folioscope.functions.grouping.BROADCAST_BYTES", bytes_)
    given = [(i, t or "") for i, t in {(r[0], r[1]) for r in rows()} if i is not None]
    given += [(1000 + k, f"only{k} common alpha") for k in range(20)] + [(1100, "!?"), (1101, "?!")]
    given.sort()
    low, high = imatch.shares((0.5, 4.0))
    one = prints(given, low, high)
    want = []
    for k, (i, text) in enumerate(given):
        following = given[(k + 1) % len(given)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = one(text), one(edited), one(following)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5).withColumn("id", F.lit("x")).withColumn("rows", F.lit(None).cast("int"))
    assert got(imatch.audit_edits(df, band=(0.5, 4.0))) == sorted(want, key=repr)


def test_fingerprints_of_odd_rows(spark):
    given = rows() + [(3, "twice", None, None, None, None, None, None, None, None)] * 5000 + [(None, f"free {k}", None, None, None, None, None, None, None, None) for k in range(50)]
    found = got(imatch.audit_edits(frame(spark, given)))
    assert Counter(r[0] for r in found) == Counter(r[0] for r in given)
    of_text = defaultdict(set)
    for (i, *_), text in ((r, r[3]) for r in found):
        of_text[i].add(text)
    assert len(of_text[3]) == len({t or "" for i, t, *_ in given if i == 3})
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in found)
    single = imatch.audit_edits(spark.createDataFrame([(1, "abcdefgh ij")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0 and single["edited_sha256"] == hashlib.sha256(b"abcdefgh ab"[:9] + b"ab").hexdigest()
    assert imatch.audit_edits(frame(spark, [])).count() == 0


def test_unused_columns_may_clash(spark):
    df = frame(spark).selectExpr("doc_id", "text", "1 as id", "2 as a", "3 as rows", "4 as chars", "lang", "source", "5 as term", "6 as count")
    assert imatch.audit_edits(df).count() == segment_trees.np.int64(len(rows()))
    assert got(segment_trees.audit(df)) == divergence(rows(), 10, 10)
    assert SCHEMA


def test_words_of_fingerprints_are_found_by_a_table(spark):
    """A class of ranges costs ten times the time; the one of single characters takes the same words."""
    assert "-" not in imatch.WORD
    every = "".join(f"{chr(c)}|a" for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    ranges = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    found, want = spark.createDataFrame([(every,)], "text string").select(imatch.distinct_words(F.col("text")), F.array_distinct(ranges)).first()
    assert len(found) > 50000 and found == want


def test_places_in_lexicons_are_ones_of_longs(spark):
    """Terms are compared by numbers; the greatest numbers of halvings of several terms are their bits together."""
    terms = ["alpha", "dé", "x"] + [f"term {k}" for k in range(300)]
    for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", imatch.halvings(F.col("t")).alias("p")).select("t", "p.*").collect():
        hashed = hashlib.sha256(r["t"].encode()).hexdigest()
        for j in range(imatch.LEXICONS):
            times = 16 - max(int(hashed[4 * j : 4 * j + 4], 16).bit_length(), 1)
            assert r[imatch.PARTS[j // 4]] >> 16 * (j % 4) & 0xFFFF == (1 << times) - 1


def test_words_that_texts_share_are_looked_up_once(spark):
    """Three texts of a row: each word of any stands once, and each text has the fingerprint of its own words."""
    given = [(1, "a b b c", "B c d", "c e a"), (2, "", "a", "a"), (3, "x y", "x y", "Y!X"), (4, "?", "!", ""), (5, "only here", "b", "here")]
    texts = ["t", "u", "v"]
    df = spark.createDataFrame(given, "id long, t string, u string, v string")
    once = df.select("id", F.explode(imatch._words_once([imatch.distinct_words(F.col(t)) for t in texts])).alias("w")).select("id", "w.*")
    want = {(r[0], w, sum(1 << n for n in range(3) if w in set(re.findall("[a-z]+", r[1 + n].lower())))) for r in given for w in set(re.findall("[a-z]+", " ".join(r[1:]).lower()))}
    assert sorted((r["id"], r["term"], r["texts"]) for r in once.collect()) == sorted(want)
    terms = spark.createDataFrame([(w,) for w in "abcdexy"], "term string").select("term", imatch.halvings(F.col("term")).alias("p")).select("term", "p.*")
    one = prints([(0, w) for w in "abcdexy"], 0, 1)
    found = {r["id"]: [r[f"{t}_print"] for t in texts] for r in imatch.fingerprints(df, ["id"], texts, terms).collect()}
    assert found == {i: [one(t) for t in three] for i, *three in given}
