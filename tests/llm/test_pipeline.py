"""The pipeline, stage by stage, on documents made for it."""

import random

import corpus_pipeline as pipeline
import pytest
from folioscope.llm import ppm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    spelled = {"en": "the of and house water through which other people during", "de": "der und haus wasser durch welche andere leute während über"}
    pool = {lang: text.split() for lang, text in spelled.items()}

    def text(lang, n):
        return " ".join(rng.choice(pool[lang]) + rng.choice(["", "s", "ing", "en"]) for _ in range(n))

    docs = [(i, text(("en", "de")[i % 2], 120), ("en", "de")[i % 2], f"s{i % 3}") for i in range(60)]
    near = docs[4][1].split()
    near[50] = "changed"
    leak = text("en", 14)
    passage = text("de", 60)
    docs += [(100, docs[0][1], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, text("en", 60) + " " + leak + " " + text("en", 60), "en", "s2")]
    docs += [(103, text("de", 100) + " " + passage, "de", "s0"), (104, passage + " " + text("de", 100), "de", "s1"), (105, None, None, "s1"), (106, "12 34", None, None), (107, text("en", 90), None, None), (0, docs[0][1], "en", "s0")]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {i: t for i, t, *_ in docs}, passage


def test_stages_do_what_they_say(spark, folder):
    path, texts, passage = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), SCHEMA + (", times long" if name == "source_mix" else ""))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns[:5] == pipeline.COLUMNS
    assert set(texts) - set(seen["language"]) == {105, 106}
    assert seen["language"][107]["lang"] == "en"
    assert set(seen["language"]) - set(seen["near_copies"]) == {100, 101}
    cut = seen["repeated_passages"]
    assert set(cut) == set(seen["near_copies"])
    assert cut[103]["text"] == texts[103] and passage not in cut[104]["text"] and cut[104]["text"].endswith(texts[104][len(passage) :][-400:])
    assert cut[104]["n_chars"] == len(cut[104]["text"])
    assert set(cut) - set(seen["benchmark_passages"]) == {102}
    taken = seen["source_mix"]
    assert set(taken) <= set(seen["benchmark_passages"]) and all(1 <= r["times"] <= 3 for r in taken.values())


def test_run_equals_its_stages(spark, folder):
    path, *_ = folder
    rows = pipeline.run(spark, path).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_copies", "repeated_passages", "benchmark_passages", "source_mix"]


def test_model_is_learned_from_the_learning_rows(spark, folder):
    path, *_ = folder
    assert ppm.train(spark.read.parquet(f"{path}/documents.parquet")).names == ["de", "en"]
