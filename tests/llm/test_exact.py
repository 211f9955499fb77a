"""Operators with exact results against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import components, cube, lm_scoring, lsh_forest, set_join, suffix_dedup, top_k, winnowing
from folioscope.llm.shared import in_batches
from folioscope.llm.suffix_sort import Suffixes
from tests.llm.odd import SCHEMA, frame, lower, rows

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_suffixes_are_sorted_like_strings():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(500))
    start = np.array([rng.randrange(450) for _ in range(300)])
    length = np.array([rng.randrange(0, 50) for _ in range(300)])
    group = np.array([rng.randrange(4) for _ in range(300)])
    piece = lambda i: (group[i], data[start[i] : start[i] + length[i]])
    made = Suffixes(np.frombuffer(data, np.uint8))
    order = made.order(start, length, group)
    assert [piece(i) for i in order] == sorted(piece(i) for i in range(300))
    number = made.classes(start, length, group)
    assert len(set(zip(number.tolist(), map(piece, range(300)), strict=True))) == len(set(map(piece, range(300)))) == len(set(number.tolist()))


def without_repeats(given):
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, text, *_ in given:
        body = (text or "").encode()
        for p in range(len(body) - 49):
            s = body[p : p + 50]
            first[s] = min(first.get(s, math.inf), key(i))
    want = []
    for i, text, *_ in given:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for p in range(len(body) - 49):
            if first[body[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        spans = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(body) else 0
        kept = bytes(b for b, g in zip(body, gone, strict=False) if not g)
        want.append((i, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=repr)


@pytest.mark.parametrize("hot", [10_000, 3, 0])
def test_repeats_are_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert got(suffix_dedup.digest(suffix_dedup.remove_repeats(frame(spark), batch_bytes=2000))) == without_repeats(rows())
    assert suffix_dedup.remove_repeats(frame(spark, []), carry=["doc_id", "row"]).count() == 0


def test_a_common_line_fills_no_bucket(spark, monkeypatch):
    """One line in a third of the rows, half of the rows without id, one id many times."""
    rng = random.Random(12)
    words = [f"{rng.randrange(10**6)}" for _ in range(3000)]
    line = "this very line stands in a third of all the documents of the corpus, word for word"
    given = []
    for k in range(900):
        own = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(2)]
        i = None if k % 2 else 7 if k % 5 == 0 else k
        given.append((i, " ".join([own[0], *([line] if k % 3 == 0 else []), own[1]]), *[None] * 8))
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    filled = spark.sparkContext.accumulator(0)
    plain = suffix_dedup._Method.answer

    def counted(self, key, table):
        if sum(table.column("count").to_pylist()) > 1500:
            filled.add(1)
        return plain(self, key, table)

    monkeypatch.setattr(suffix_dedup._Method, "answer", counted)
    found = suffix_dedup.remove_repeats(frame(spark, given), batch_bytes=4000)
    assert got(suffix_dedup.digest(found)) == without_repeats(given)
    assert filled.value == 0


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_REACH", 256)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef ") for _ in range(1500))
    data, offsets = np.frombuffer((long + long).encode(), np.uint8), np.array([0, 1500, 3000])
    runs = suffix_dedup.Runs(data, offsets, 50, 24)
    assert int((runs.last - runs.first + 1).sum()) == 2 * 1451
    halves = [[(f - 1500 * d, x) for f, x, e in zip(runs.first, runs.content, runs.doc, strict=True) if e == d] for d in (0, 1)]
    assert halves[0] == halves[1]


def near_brute(given, shingle, part, of):
    sets, nodes = [], {}
    for i, text, *_ in given:
        w = SPACED.findall(lower(text))
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))) if w else frozenset())
    parent = {i: i for i, *_ in given if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            x, y = given[a][0], given[b][0]
            if x is None or y is None or not sets[a] or not sets[b]:
                continue
            inter = len(sets[a] & sets[b])
            if of * inter >= part * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
    for (i, *_), s in zip(given, sets, strict=True):
        c = None if i is None and s else root(i) if i is not None else None
        yield (i, len(s), c, i is not None and c == i)


@pytest.mark.parametrize(("shingle", "part", "depth", "tile"), [(3, 85, 5, 512), (5, 80, 4, 4)])
def test_near_duplicates(spark, monkeypatch, shingle, part, depth, tile):
    monkeypatch.setattr(lsh_forest, "TILE", tile)
    found = lsh_forest.near_duplicates(frame(spark), shingle=shingle, part=part, depth=depth)
    assert got(found) == sorted(near_brute(rows(), shingle, part, 100), key=repr)


def test_near_duplicates_of_nothing(spark):
    assert lsh_forest.near_duplicates(frame(spark, [])).count() == 0


def test_large_region_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "SMALL_REGION", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    given = []
    for i in range(40):
        copy = base[:]
        copy[rng.randrange(200)] = f"x{i}"
        given.append((i, " ".join(copy), None, None, None, None, None, None, None, None))
    assert got(lsh_forest.near_duplicates(frame(spark, given))) == sorted(near_brute(given, 3, 85, 100), key=repr)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    group = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    want = {(n, c) for n, c in group.items() if any(a != b and n in (a, b) for a, b in edges)}
    assert set(got(components.components(spark.createDataFrame(edges, "a long, b long")))) == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def leaks_brute(docs, items, window):
    wanted = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[k : k + n])].add(item)
    for i, text, *_ in docs:
        w = ALNUM.findall(lower(text))
        hit, ids = set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                found = wanted.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    ids |= found
        yield (i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))


def test_contamination(spark):
    given = rows()
    rng = random.Random(4)
    items = [(k, " ".join(ALNUM.findall(given[k][1])[5 : 5 + rng.randrange(3, 40)]).upper()) for k in range(0, 20, 2)]
    items += [(100, "one two"), (101, "io"), (102, None), (103, ""), (104, items[0][1]), (5, "never seen words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.digest(winnowing.contamination(frame(spark), table, carry=["doc_id", "row"]))
    assert got(found) == sorted(leaks_brute(given, items, 10), key=repr)
    none = winnowing.digest(winnowing.contamination(frame(spark), table.limit(0)))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(given)
    assert winnowing.contamination(frame(spark, []), table).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4).round(1)]) for i in range(300)]
    vectors += [(400, None), (401, [1.0, None, 2.0, 0.0]), (402, [float("nan"), 0.0, 0.0, 0.0]), (403, [float("inf")] * 4), (404, [1.0, 2.0]), (405, []), (None, [1.0] * 4), (3, vectors[3][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    usable = {i: np.floor(64 * np.array(list(v) + [0.0] * (4 - len(v)))) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in usable:
        if q % 20 == 0:
            ranked = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    old = top_k.BLOCK, top_k.QUERIES, top_k.FAN
    top_k.BLOCK, top_k.QUERIES, top_k.FAN = 16, 5, 2
    try:
        assert got(top_k.search(df, F.col("vec_id") % 20 == 0)) == sorted(want, key=repr)
    finally:
        top_k.BLOCK, top_k.QUERIES, top_k.FAN = old
    assert top_k.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k.search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_products_are_exact():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])
    assert top_k._product(a, b)[0, 0] == 2**60 + 1


def test_mix_meets_targets(spark):
    given = [(i, "w " * (1 + i * 7 % 50), None, "abc"[i % 3] if i % 7 else None, None, None, None, None, None, None) for i in range(2000)]
    given += [(None, "w w", None, "a", None, None, None, None, None, None)] * 3 + [(9000, None, None, "empty", None, None, None, None, None, None), (9001, "", None, "empty", None, None, None, None, None, None)]
    size = Counter()
    for _, text, _, source, *_ in given:
        size[source] += len(SPACED.findall(text or ""))
    want = {"a": 5.0, "b": 2.0, "c": 1.0, "empty": 5.0, None: 2.0}
    total = sum(size.values())
    goal = cube.targets(list(size.items()))
    assert goal["empty"] == 0 and abs(sum(goal.values()) - total) < 1e-6 * total
    free = [s for s in size if goal[s] < 3 * size[s] - 1e-9]
    assert all(goal[s] <= 3 * size[s] + 1e-9 for s in size) and len({round(goal[s] / want[s], 6) for s in free}) == 1
    found = cube.digest(cube.mix(frame(spark, given), block=100)).collect()
    assert len(found) == len(given) and got(cube.digest(cube.mix(frame(spark, given), block=100))) == sorted(map(tuple, found), key=repr)
    taken = Counter()
    by_id = {i: source for i, _, _, source, *_ in given}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[by_id[r["doc_id"]]]
        taken[by_id[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= max(3, 0.001 * goal[s]) for s in size), (taken, goal)
    assert cube.mix(frame(spark, [])).count() == 0


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(3)
    size, luck = rng.integers(1, 900, 500).astype(float), rng.random(500)
    p = np.full(500, 0.37)
    moved = cube.fly(p, size, luck)
    open_ = (moved > 0) & (moved < 1)
    assert open_.sum() <= 2 and abs(moved.sum() - p.sum()) < 1e-6 and abs(moved @ size - p @ size) < 1e-3


def lm_brute(given, good):
    def count(texts):
        grams, pairs, single = Counter(), Counter(), Counter()
        for t in texts:
            b = b"\0" * 4 + t
            for k in range(4, len(b)):
                grams[b[k - 4 : k + 1]] += 1
                pairs[b[k - 1 : k + 1]] += 1
                single[b[k]] += 1
        return grams, pairs, single

    bodies = [(i, (t or "").encode()) for i, t, *_ in given]
    models = []
    for texts in ([b for i, b in bodies if i in good], [b for _, b in bodies]):
        grams, pairs, single = count(texts)
        total, kinds = Counter(), Counter()
        for g, n in list(grams.items()) + list(pairs.items()):
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        every, distinct = sum(single.values()), len(single)

        def loss(g, grams=grams, pairs=pairs, single=single, total=total, kinds=kinds, every=every, distinct=distinct):
            one = (single[g[4]] + distinct / 256) / (every + distinct) if every else 1 / 256
            two = (pairs[g[3:]] + kinds[g[3:4]] * one) / (total[g[3:4]] + kinds[g[3:4]]) if total[g[3:4]] else one
            five = (grams[g] + kinds[g[:4]] * two) / (total[g[:4]] + kinds[g[:4]]) if total[g[:4]] else two
            return -math.log2(five)

        models.append(loss)
    for i, b in bodies:
        padded = b"\0" * 4 + b
        each = [sum(m(padded[k - 4 : k + 1]) for k in range(4, len(padded))) / max(len(b), 1) for m in models]
        yield (i, len(b), round(each[0], 4), round(each[1], 4), round(each[1] - each[0], 4))


def test_cross_entropy_difference(spark):
    given = rows()
    good = {0, 3, 7, 11, 20}
    ids = spark.createDataFrame([(g,) for g in good] + [(None,), (3,), (12345,)], "doc_id long")
    found = lm_scoring.cross_entropy_difference(frame(spark), ids, batch_bytes=3000)
    rounded = found.select("row.doc_id", "n_tokens", *[F.col(c).alias(c) for c in ("target_loss", "background_loss", "score")]).collect()
    want = sorted(lm_brute(given, good), key=repr)
    have = sorted(((r[0], r[1], *(round(x, 4) for x in r[2:])) for r in rounded), key=repr)
    assert [h[:2] for h in have] == [w[:2] for w in want]
    assert all(abs(x - y) < 2e-3 for h, w in zip(have, want, strict=True) for x, y in zip(h[2:], w[2:], strict=True))
    assert lm_scoring.cross_entropy_difference(frame(spark, []), ids).count() == 0
    assert lm_scoring.cross_entropy_difference(frame(spark), ids.limit(0)).count() == len(given)


def base_brute(text):
    w = ALNUM.findall(lower(text))
    places = [(label, k) for phrase, label in set_join.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return len(w), sorted(places)


def blocks_brute(text, templates, share, slack):
    """Whether any run of words holds enough of a template."""
    w, labels = ALNUM.findall(lower(text)), set()
    for label, wordings in templates.items():
        for wording in wordings:
            own = ALNUM.findall(lower(wording))
            tokens = set(own)
            reach = max(len(tokens), math.ceil(slack * len(own)))
            need = max(1, math.ceil(share * len(tokens) - 1e-9))
            if any(len(tokens & set(w[k : k + reach])) >= need for k in range(len(w))):
                labels.add(label)
    return labels


def test_license_blocks(spark, monkeypatch):
    texts = [
        "Some text. Licensed under CC BY-NC 4.0. cc by, CC-BY",
        "All rights reserved. all RIGHTS\nreserved",
        "x " * 50 + "Released, under terms, the MIT License" + " y" * 30,
        "This is licensed under the GNU General Public License version 3 (work)",
        "released under apples and the oranges license",
        "under the Apache License Version 2.0",
        "Licensed under the Apache License, 2.0 and released under the MIT License",
        "the the the under under license",
        None,
        "",
        "cc",
    ]
    rng = random.Random(8)
    pool = ["licensed", "under", "the", "apache", "license", "version", "2", "0", "mit", "released", "cc", "by", "nc", "4", "z"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randrange(5, 40))) for _ in range(40)]
    given = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    want = []
    for i, t, *_ in given:
        n, places = base_brute(t)
        base = sorted({label for label, _ in places})
        every = sorted(set(base) | blocks_brute(t, set_join.TEMPLATES, 0.8, 1.25))
        at = [k for _, k in places]
        want.append((i, n, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every)))
    found = set_join.digest(set_join.license_blocks(frame(spark, given))).drop("score")
    assert got(found) == sorted(want, key=repr)
    monkeypatch.setattr(set_join, "TEMPLATES_PER_PASS", 4)
    assert got(set_join.digest(set_join.license_blocks(frame(spark, given))).drop("score")) == sorted(want, key=repr)
    assert set_join.license_blocks(frame(spark, [])).count() == 0
    assert SCHEMA


def test_tiles_stay_out_of_the_driver(spark, monkeypatch):
    def refuse(_):
        raise AssertionError("tiles are gathered in the driver")

    monkeypatch.setattr(lsh_forest.F, "broadcast", refuse)
    rows = [(i, f"one two three four five six seven eight nine {i // 2}") for i in range(8)]
    found = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i // 2 * 2) for i in range(8)}


def test_a_row_that_stands_many_times_is_one_set_of_a_tile(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    plain = lsh_forest._confirm

    def counting(part, of):
        run = plain(part, of)

        def counted(key, table):
            if table.num_rows > 4:
                sizes.add(1)
            return run(key, table)

        return counted

    monkeypatch.setattr(lsh_forest, "_confirm", counting)
    text = " ".join(f"w{k}" for k in range(60))
    given = [(5, text)] * 3000 + [(6, text + " end"), (4, "other words here")]
    found = lsh_forest.near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(3))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(5, 5), (6, 5), (4, 4)} and found.count() == 3002
    assert sizes.value == 0


def test_rows_without_id_are_many_batches(spark):
    given = spark.range(5000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("body"))
    sizes = [r["count"] for r in in_batches(given, F.col("id"), F.col("body"), 64).groupBy("batch").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 200
    repeated = given.withColumn("id", F.lit(7))
    sizes = [r["count"] for r in in_batches(repeated, F.xxhash64("id", "body"), F.col("body"), 64).groupBy("batch").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 200
