"""Stored indexes, greedy packs, fuzzy windows, payload facts and combined output against brute force."""

import base64
import hashlib
import json
import math
import random
import re
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import similarity
from folioscope.functions.text import TOKENS_PER_WORD
from folioscope.operators import block_index, chunks, combined, gram_index, runs, search, work


def bm25(texts, query):
    words = {k: re.findall(r"\w+", t.lower()) for k, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    scores = Counter()
    for token in set(re.findall(r"\w+", query)):
        df = sum(token in w for w in words.values())
        for k, w in words.items():
            if tf := w.count(token):
                scores[k] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return scores


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    texts = {}
    for k in range(1200):
        size = rng.choice([3, 10, 40, 200])
        texts[f"d{k:04d}"] = " ".join("common" if rng.random() < 1 / (1 + k % 40) else f"w{int(rng.expovariate(0.02))}" for _ in range(size))
    return texts


def test_block_index_finds_the_best_and_leaves_blocks_closed(spark, tmp_path, corpus):
    docs = spark.createDataFrame(list(corpus.items()), "chunk_id string, text string")
    path = str(tmp_path / "index")
    block_index.write_block_index(docs, path, block_docs=16)
    asked = {"a": "common", "b": "common w3", "c": "w1 w2 w5", "d": "nothing", "e": "w40"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["bm25"], 5)) for r in block_index.top_hits(spark, path, queries, 7).collect()}
    want = {}
    for q, query in asked.items():
        best = sorted(bm25(corpus, query).items(), key=lambda x: (-round(x[1], 6), x[0]))[:7]
        want |= {(q, n + 1): (k, round(s, 5)) for n, (k, s) in enumerate(best)}
    assert got == want
    bounds, average = block_index.block_bounds(spark, path, queries.filter("query_id = 'a'"))
    _, rest = block_index.opened_blocks(bounds, average, spark, path, 7, 7)
    postings = bounds.agg(F.sum("df")).first()[0]
    assert postings > 600 and (rest.agg(F.sum("df")).first()[0] or 0) < postings / 10


def test_block_index_keeps_each_id_once(spark, tmp_path, corpus):
    """Lists hold numbers, so what is dealt out for them doesn't grow with the ids."""
    docs = spark.createDataFrame(list(corpus.items()), "chunk_id string, text string")
    path = str(tmp_path / "index")
    block_index.write_block_index(docs, path, block_docs=16)
    lists = spark.read.parquet(f"{path}/blocks")
    assert [f.name for f in lists.schema if "string" in f.dataType.simpleString()] == ["token"]
    assert sorted(r["doc"] for r in spark.read.parquet(f"{path}/docs").collect()) == sorted(corpus)
    assert lists.select("token", "block", F.explode("places")).distinct().count() == sum(len(set(t.split())) for t in corpus.values())


def test_gram_index_finds_what_a_scan_finds(spark, tmp_path, corpus):
    texts = {**dict(list(corpus.items())[:150]), "x1": "a", "x2": "ab", "x3": "Größe der ÄRZTE", "x4": "100% sure_thing", "x5": "", "x6": None}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    path = str(tmp_path / "grams")
    gram_index.write_gram_index(docs, path, "chunk_id", "text", buckets=8, block=32)
    asked = ["common", "w1", "on w", "ab", "a", "rösse", "größe der ä", "w3 common w", "c_mmon", "co%w2", "%", "___", "zzz", "mon w12 c", "0% s", "_b", "w_ c"]
    queries = search.prepare_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"))
    got = sorted(map(tuple, gram_index.match_indexed(docs, queries, path, "chunk_id", "text").collect()))
    want = sorted(map(tuple, search.match_queries(docs, queries, "chunk_id", "text").collect()))
    assert got == want and {q for q, _ in got} >= {0, 1, 2, 3, 4, 6, 8, 9, 10}
    opened = gram_index.asked_groups(queries.filter("query_id = 7"), path).collect()
    assert len(opened) == gram_index.INTERSECTED


def test_gram_index_keeps_each_key_once(spark, tmp_path, corpus):
    """Lists hold numbers, so what is dealt out for them doesn't grow with the keys."""
    texts = dict(list(corpus.items())[:150])
    path = str(tmp_path / "grams")
    gram_index.write_gram_index(spark.createDataFrame(list(texts.items()), "chunk_id string, text string"), path, "chunk_id", "text", buckets=8, block=32)
    lists = spark.read.parquet(f"{path}/lists")
    assert [f.name for f in lists.schema if "string" in f.dataType.simpleString()] == ["gram"]
    assert sorted(r["key"] for r in spark.read.parquet(f"{path}/keys").collect()) == sorted(texts)
    groups = lambda t: {t[i : i + gram_index.SIZE] for i in range(len(t))}
    assert lists.select("gram", "part", F.explode("places")).distinct().count() == sum(len(groups(t)) for t in texts.values())


def test_packs_are_filled_greedily(spark):
    rng = random.Random(4)
    rows, want = [], []
    for name, count in (("a", 300), ("b", 1), ("c", 40), ("d", 0)):
        fill, pack = None, 0
        for i in range(count):
            words = rng.choice([0, 1, 3, 10, 30, 90])
            text = " ".join(["ab"] * words)
            tokens = max(math.ceil(len(text) / 4), math.ceil(words * TOKENS_PER_WORD))
            if fill is not None and fill + tokens > 50:
                fill, pack = tokens, pack + 1
            else:
                fill = (fill or 0) + tokens
            rows.append((name, i, text))
            want.append((name, i, tokens, pack))
    made = chunks.greedy_packs(spark.createDataFrame(rows, "file_hash string, ordinal int, text string").repartition(4), 50, block=16)
    assert sorted(map(tuple, made.select("file_hash", "ordinal", "tokens", "pack_no").collect())) == sorted(want)
    assert chunks.build_chunks("filled", spark.createDataFrame(rows, "file_hash string, ordinal int, text string"), max_tokens=50).count() > 20


def test_packing_spreads_one_long_file(spark):
    rows = spark.range(40000).select(F.lit("f").alias("file_hash"), F.col("id").cast("int").alias("ordinal"), F.lit("ab").alias("text"))
    made = chunks.greedy_packs(rows, 100)
    assert made.agg(F.max("pack_no")).first()[0] == 799
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 4 and max(r["count"] for r in spread) < 20000


def window_ratio(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    cuts = [long[i : i + n] for i in range(len(long) - n + 1)] + [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    return max(similarity.ratio(short, c) for c in cuts)


def test_fuzzy_windows_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        letters = rng.choice(["ab", "abcdef ", "é😀x"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(1, n))) for n in (14, 40))
        assert math.isclose(similarity.partial_ratio(a, b), 100.0 if a in b or b in a else window_ratio(a, b))


def test_fuzzy_memory_does_not_multiply():
    rng = random.Random(1)
    query, text = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 20_000))
    tracemalloc.start()
    similarity.partial_ratio(query, text)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 4 << 20


def payload(*bodies, kind="png", slash="/"):
    blocks = [{"type": "image_url", "image_url": {"url": f"data:image/{kind};base64," + base64.b64encode(b).decode()}} for b in bodies]
    return json.dumps({"messages": blocks, "data:image/name": "kept", "text": 'says "data:image/png" here', "n": [1, "x"]}).replace("/", slash)


@pytest.mark.parametrize("slash", ["/", "\\/"])
def test_large_images_are_redacted_and_told(spark, slash):
    big, small = random.Random(3).randbytes(1_000_000), b"tiny"
    text = payload(big, small, slash=slash)
    rows = spark.createDataFrame([(1, text), (2, '{"a":"none"}'), (3, None), (4, '"data:image/gif;base64,%%%"'), (5, '{"u":"data:image\\\\' + "\\\\" * 400_000 + '"}')], "id int, payload string")
    shown = dict(map(tuple, rows.select("id", runs.redact_images(F.col("payload"))).collect()))
    mark = runs.IMAGE_MARK.strip('"')
    clean = json.loads(shown[1])
    assert [m["image_url"]["url"] for m in clean["messages"]] == [mark, mark]
    assert clean["data:image/name"] == "kept" and clean["text"] == 'says "data:image/png" here'
    assert shown[2] == '{"a":"none"}' and shown[3] is None and shown[4] == runs.IMAGE_MARK and json.loads(shown[5]) == {"u": mark}
    facts = sorted(map(tuple, runs.image_attachments(rows, "payload", ["id"]).collect()), key=lambda r: r[:2])
    url = len("data:image/png;base64,")
    assert facts[:2] == [(1, n, "image/png", url + 4 * -(-len(b) // 3), len(b), hashlib.sha256(b).hexdigest()) for n, b in enumerate((big, small))]
    assert facts[2] == (4, 0, "image/gif", 25, None, None) and len(facts) == 4


def test_page_numbers_are_rewritten_at_any_depth(spark):
    values = [{"page_no": 1, "a": [{"page_no": "one", "t": '"page_no": 3'}, ["page_no", {"page_no": None}]]}, {"page_no": {"x": 1}, "b": {"page_no": [1, 2]}}, [], {"page_no ": 4, "xpage_no": 5, "é": "page_no"}]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0), i + 10) for i, v in enumerate(values)], "id int, payload string, page_no int")
    got = {r[0]: json.loads(r[1]) for r in rows.select("id", combined.rewrite_member(F.col("payload"), "page_no", F.col("page_no"))).collect()}
    assert got == {i: combined._replaced(v, "page_no", i + 10) for i, v in enumerate(values)}


def test_combined_rows_keep_everything(spark):
    outputs = [{"texts": [{"t": 1, "page_no": 1}], "pages": {"1": {"page_no": 1, "x": 2}}}, {"tables": [], "pages": [5, {"page_no": 1, "size": {"width": 1, "height": 2}}]}, {"texts": "no list"}]
    rows = [("f", 's "q"', 3 - i, json.dumps(o), ["one ", None, " "][i], 10.0, 20.0, f"h{i}") for i, o in enumerate(outputs)]
    schema = "file_hash string, source string, page_no int, output_json string, text string, page_width double, page_height double, image_sha256 string"
    made = combined.combined_layout(spark.createDataFrame(rows, schema)).first()
    whole = json.loads(made["output_json"])
    assert made["text"] == "<!-- page 3 -->\none" and whole["source"] == 's "q"' and whole["normalized_input"] is True
    assert whole["texts"] == [{"t": 1, "page_no": 3}] and whole["tables"] == []
    size = {"width": 10.0, "height": 20.0}
    assert whole["pages"] == {"1": {"page_no": 1, "size": size}, "2": {"page_no": 2, "size": {"width": 1, "height": 2}}, "3": {"page_no": 3, "x": 2, "size": size}}
    assert [p["image_sha256"] for p in whole["normalized_page_outputs"]] == ["h2", "h1", "h0"]
    content = [{"middle_json": {"pdf_info": [{"page_idx": 0, "k": [{"page_idx": 0}]}, 7]}, "content_list": [{"page_idx": 0, "a": 1}]}, {}]
    rows = [("g", None, i + 1, json.dumps(o), "t", 10.0, 20.0, None) for i, o in enumerate(content)]
    whole = json.loads(combined.combined_content(spark.createDataFrame(rows, schema), "pipe", "auto").first()["output_json"])
    assert whole["middle_json"]["pdf_info"] == [{"page_idx": 0, "k": [{"page_idx": 0}], "page_size": [10.0, 20.0]}, {"page_idx": 1, "page_size": [10.0, 20.0]}]
    assert whole["content_list"] == [{"page_idx": 0, "a": 1}] and "content_list_v2" not in whole


def test_models_stay_together(spark):
    rows = [(f"u{i}", "busy" if i % 3 else f"m{i % 5}") for i in range(600)]
    laid = work.grouped_by_model(spark.createDataFrame(rows, "work_key string, execution_key string").repartition(5), 6)
    met = laid.select(F.spark_partition_id().alias("p"), "execution_key").collect()
    assert Counter(r["p"] for r in met) == {p: 100 for p in range(6)}
    assert len({(r["p"], r["execution_key"]) for r in met}) <= 6 + 6 - 1
