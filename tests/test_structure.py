"""Reader JSON, regions, boxes, orientation and alignment."""

import json
import math
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as contract
from folioscope.functions import boxes
from folioscope.functions import text as txt
from folioscope.functions.grouping import blocked_row_number, grouped_median
from folioscope.operators import alignment, overlays
from folioscope.operators import elements as el
from folioscope.operators import regions as rg

LAYOUT = {
    "texts": [
        {"self_ref": "#/texts/0", "label": "title", "text": " Big \n title ", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 9, "r": 5, "b": 7, "coord_origin": "BOTTOMLEFT"}}]},
        {"self_ref": "#/texts/1", "label": "", "text": " ", "orig": "from orig", "prov": [{"page_no": "2", "bbox": {"left": 1, "top": 9, "right": 5, "bottom": 7}}, {"page_no": 1, "bbox": {"l": 1}}]},
        {"self_ref": "", "text": "no ref", "prov": []},
    ],
    "tables": [
        {
            "self_ref": "#/tables/0",
            "prov": [{"page_no": 1, "bbox": {"l": 0, "t": 50, "r": 40, "b": 10}}],
            "data": {"table_cells": [
                {"text": "a", "bbox": {"l": 0, "t": 50, "r": 10, "b": 40}, "start_row_offset_idx": 0},
                {"text": "b", "bbox": {"l": 10, "t": 50, "r": 20, "b": 40}, "start_row_offset_idx": 0},
                {"text": "c", "bbox": {"l": 0, "t": 40, "r": 10, "b": 30}, "start_row_offset_idx": 1},
                {"text": "nobox", "start_row_offset_idx": 1},
            ]},
        }
    ],
    "pages": {"1": {"page_no": 1, "size": {"width": 100, "height": 200}}, "2": {"size": {"width": "100.5", "height": 200}}},
}


def raw(spark, *outputs, name="f"):
    rows = [(f"{name}{i}", o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(outputs)]
    return spark.createDataFrame(rows, ["file_hash", "output_json"])


def test_layout_elements(spark):
    layouts = el.parse_layout(raw(spark, LAYOUT, "not json", "[1]"))
    rows = {r["source_ref"]: r for r in el.layout_elements(layouts).collect()}
    assert set(rows) == {"#/texts/0", "#/texts/1", "#/tables/0", "#/tables/0/cells/0", "#/tables/0/cells/1", "#/tables/0/cells/2"}
    assert rows["#/texts/0"]["text"] == "Big title" and rows["#/texts/1"]["text"] == "from orig"
    assert rows["#/texts/1"]["page_no"] == 2 and rows["#/texts/1"]["raw_bbox"]["coord_origin"] == "BOTTOMLEFT"
    assert rows["#/tables/0"]["text"] == "a b c nobox" and rows["#/tables/0"]["label"] == "table"
    assert rows["#/tables/0/cells/0"]["context_text"] == "a b" and rows["#/tables/0/cells/2"]["context_text"] == "c nobox"
    legacy = {r["source_ref"]: r["context_text"] for r in el.table_elements(layouts, first_row_alone=True).collect()}
    assert legacy["#/tables/0/cells/0"] == "a" and legacy["#/tables/0/cells/2"] == "c nobox"
    pages = sorted((r["page_no"], r["width"]) for r in el.layout_pages(layouts).collect())
    assert pages == [(1, 100.0), (2, 100.5)]


def test_listed_page_sizes(spark):
    layouts = el.parse_layout(raw(spark, {"pages": [{"dimensions": {"width": 10, "height": 20}}, {}, {"dimensions": {"width": 1, "height": 2}}]}))
    assert sorted((r["page_no"], r["width"]) for r in el.layout_pages(layouts).collect()) == [(1, 10.0), (3, 1.0)]


def chunk_meta(spark, *metas):
    rows = [("f0", f"f0:{i}", i, f"chunk {i} text", json.dumps(m)) for i, m in enumerate(metas)]
    return spark.createDataFrame(rows, "file_hash string, chunk_id string, chunk_index int, text string, metadata_json string")


def test_chunk_evidence_prefers_children_then_falls_back(spark):
    elements = el.layout_elements(el.parse_layout(raw(spark, LAYOUT)))
    item = lambda ref: {"self_ref": ref, "label": "x", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 2, "r": 3, "b": 1}}]}
    chunks = chunk_meta(
        spark,
        {"docling_meta": {"doc_items": [item("#/tables/0"), item("#/texts/0")]}},
        {"docling_meta": {"doc_items": [item("#/pictures/9")]}},
        {"mistral_elements": [{"source_ref": "m", "text": "t", "page_no": 3, "bbox": {"l": 1, "t": 2, "r": 3, "b": 1}}]},
        {"mistral_pages": [{"page_no": 4, "bbox": {"l": 1, "t": 2, "r": 3, "b": 1}}]},
    )
    found = {}
    for r in el.chunk_evidence(chunks, elements).collect():
        found.setdefault(r["chunk_index"], set()).add((r["source_ref"], r["text"]))
    assert found[0] == {("#/tables/0/cells/0", "a"), ("#/tables/0/cells/1", "b"), ("#/tables/0/cells/2", "c"), ("#/texts/0", "Big title")}
    assert found[1] == {("#/pictures/9:prov:0", "chunk 1 text")}
    assert found[2] == {("m", "t")}
    assert found[3] == {("mistral-page-4", "chunk 3 text")}


def test_layout_regions_link_last_chunk_and_drop_unknown_pages(spark):
    layouts = el.parse_layout(raw(spark, LAYOUT))
    elements, pages = el.layout_elements(layouts), el.layout_pages(layouts).filter("page_no = 1")
    item = {"docling_meta": {"doc_items": [{"self_ref": "#/texts/0"}]}}
    evidence = el.item_evidence(chunk_meta(spark, item, item), elements)
    rows = {r["source_ref"]: r for r in rg.layout_regions(elements, pages, evidence).collect()}
    assert "#/texts/1" not in rows
    assert rows["#/texts/0"]["chunk_index"] == 1 and rows["#/texts/0"]["region_kind"] == "title"
    assert rows["#/tables/0/cells/0"]["region_kind"] == "table_cell" and rows["#/tables/0"]["chunk_id"] is None
    again = {r["region_id"] for r in rg.layout_regions(elements, pages, evidence).collect()}
    assert again == {r["region_id"] for r in rows.values()}


def test_content_regions(spark):
    page = {"page_idx": 0, "page_size": [200, 100]}
    listed = {"backend": "vlm", "middle_json": {"pdf_info": [page]}, "content_list": [
        {"type": "equation", "bbox": [100, 200, 500, 400], "page_idx": 0, "text": ""},
        {"type": "table", "sub_type": "simple", "bbox": [0, 0, 0.5, 1], "table_body": ["x", {"k": " y  z "}], "page_idx": 0},
        {"type": "text", "text": "no box", "page_idx": 0},
    ]}
    nested = {"middle_json": json.dumps({"pdf_info": [page]}), "content_list_v2": [[{"type": "text", "bbox": [1, 1, 2, 2000], "text": "abs"}], []]}
    walked = {"middle_json": {"pdf_info": [dict(page, blocks=[{"type": "title", "bbox": [10, 10, 20, 20], "lines": [{"bbox": [1, 2, 3, 4], "content": "inner"}]}])]}}
    rows = rg.content_regions(raw(spark, listed, nested, walked)).collect()
    got = {(r["file_hash"], r["source_ref"]): r for r in rows}
    first = got["f0", "mineru:content:0"]
    assert (first["region_kind"], first["text"]) == ("formula", "equation")
    assert tuple(first["raw_bbox"])[:4] == (20.0, 20.0, 100.0, 40.0)
    second = got["f0", "mineru:content:1"]
    assert (second["label"], second["text"], tuple(second["raw_bbox"])[:4]) == ("table:simple", "x y z", (0.0, 0.0, 100.0, 100.0))
    assert tuple(got["f1", "mineru:content:0"]["raw_bbox"])[:4] == (1.0, 1.0, 2.0, 2000.0)
    assert got["f2", "mineru:middle:1:0"]["region_kind"] == "title" and got["f2", "mineru:middle:1:1"]["text"] == "inner"
    assert len(rows) == 5


def test_page_layout_regions(spark):
    box = {"bbox": [100, 200, 500, 400]}
    data = {"model": "m2", "pages": [
        {"page_no": 1, "width": 200, "height": 100, "status": "ok", "result": {"elements": [dict(box, category="Title", text=" hello "), {"bbox": [5, 5, 5, 9]}]}},
        {"page_no": 2, "width": 200, "height": 100, "status": "error", "result": {"elements": [box]}},
        {"page_no": 3, "width": 200, "height": 100, "result": json.dumps({"wrap": {"inner": [dict(box, type="figure_caption")]}})},
        {"width": 0, "height": 100, "result": {"elements": [box]}},
    ]}
    rows = {r["source_ref"]: r for r in rg.layout_page_regions(raw(spark, data)).collect()}
    assert set(rows) == {"infinity:page:1:region:0", "infinity:page:3:region:0"}
    first = rows["infinity:page:1:region:0"]
    assert (first["region_kind"], first["text"], tuple(first["raw_bbox"])[:4]) == ("title", "hello", (20.0, 20.0, 100.0, 40.0))
    assert rows["infinity:page:3:region:0"]["region_kind"] == "text" and first["annotation_model"] == "m2"


def test_four_quarter_turns_are_identity(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 50), rng.uniform(0, 80), rng.uniform(1, 50), rng.uniform(1, 40)) for i in range(50)]
    df = spark.createDataFrame(rows, ["i", "left", "top", "width", "height"]).withColumn("r", F.struct("left", "top", "width", "height"))
    for degrees, turns in ((90, 4), (180, 2), (270, 4)):
        turned, w, h = F.col("r"), 100.0, 120.0
        for _ in range(turns):
            turned = boxes.bind(turned, lambda r, w=w, h=h: boxes.rotate(r, F.lit(w), F.lit(h), F.lit(degrees)))
            w, h = (h, w) if degrees != 180 else (w, h)
        for r in df.select("r", turned.alias("t")).collect():
            assert all(abs(a - b) < 1e-9 for a, b in zip(r["r"], r["t"]))


def test_normalize_flips_bottom_left(spark):
    box = boxes.make_box(F.lit(10.0), F.lit(90.0), F.lit(60.0), F.lit(40.0), boxes.BOTTOM_LEFT)
    got = spark.range(1).select(boxes.normalize(box, F.lit(100.0), F.lit(100.0)).alias("n")).first()["n"]
    assert tuple(got) == (10.0, 10.0, 50.0, 50.0)


def sideways(spark, tops):
    rows = [("h", 1, "docling", "text", "long enough text", box) for box in tops]
    kind = "file_hash string, page_no int, annotation_engine string, region_kind string, text string, raw_bbox struct<left:double,top:double,right:double,bottom:double,coord_origin:string>"
    pages = spark.createDataFrame([("h", 1, 300.0, 500.0)], ["file_hash", "page_no", "width", "height"])
    return overlays.sideways_pages(spark.createDataFrame(rows, kind), pages).collect()


def test_sideways_pages(spark):
    tall = lambda left, bottom: (float(left), bottom + 200.0, left + 20.0, float(bottom), "BOTTOMLEFT")
    flat = (40.0, 80.0, 180.0, 60.0, "BOTTOMLEFT")
    right = sideways(spark, [tall(240, 220), tall(230, 160), tall(250, 130), flat])
    assert [(r["clockwise_degrees"], round(r["confidence"], 4)) for r in right] == [(90, 0.8125)]
    left = sideways(spark, [tall(40, 220), tall(50, 160), tall(30, 130), flat])
    assert [r["clockwise_degrees"] for r in left] == [270]
    assert sideways(spark, [tall(240, 220)]) == []


def test_blocked_numbers_and_median(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab") if i % 7 else None, rng.randint(0, 400), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r["i"]: r["n"] for r in blocked_row_number(df, ["k"], F.floor(F.col("v") / 50), [F.col("v"), F.col("i")], "n").collect()}
    for key in ("a", "b", None):
        mine = sorted((v, i) for k, v, i in rows if k == key)
        assert all(got[i] == n for n, (_v, i) in enumerate(mine, start=1))
    medians = {r["k"]: r["m"] for r in grouped_median(df, ["k"], "v", 32.0, "m").collect()}
    for key in ("a", "b", None):
        mine = sorted(v for k, v, _i in rows if k == key)
        assert medians[key] == (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2


def lcs(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    return grid[-1][-1]


def best_by_hand(words, target, estimate):
    """Tries every window; returns (score, box) or None."""
    n, found = len(target), []
    for size in sorted({max(1, n - 1), n, n + 1, n + 2}):
        for start in range(len(words) - size + 1):
            window = words[start : start + size]
            score = max(0.0, lcs(target, [w for w, _b in window]) / n - abs(size - n) / n * 0.12)
            if score >= (1.0 if n <= 3 else 0.72):
                box = (min(b[0] for _w, b in window), min(b[1] for _w, b in window), max(b[2] for _w, b in window), max(b[3] for _w, b in window))
                far = math.dist(((box[0] + box[2]) / 2, (box[1] + box[3]) / 2), estimate) if estimate else 0.0
                found.append((-score, far, *((box[1], box[0]) if estimate else ()), size, start, box))
    best = min(found, default=None)
    return None if best is None else (-best[0], best[-1])


def test_alignment_equals_trying_every_window(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(9)]
    tokens, elements, want = [], [], {}
    for page in range(1, 7):
        words = [(rng.choice(vocabulary), (float(i % 10 * 20), float(i // 10 * 12), float(i % 10 * 20 + 15), float(i // 10 * 12 + 9))) for i in range(50)]
        tokens += [("f", page, i, w, (*b, "TOPLEFT")) for i, (w, b) in enumerate(words)]
        for e in range(12):
            at, n = rng.randint(0, 40), rng.randint(1, 9)
            target = [w for w, _b in words[at : at + n]]
            for _ in range(rng.randint(0, 2)):
                target[rng.randrange(len(target))] = rng.choice(vocabulary)
            estimate = (100.0, 30.0) if e % 2 else None
            ref = f"p{page}e{e}"
            elements.append(("f", page, ref, None, "text", " ".join(target), (95.0, 25.0, 105.0, 35.0, "TOPLEFT") if estimate else None))
            want[ref] = best_by_hand(words, target, estimate)
    box_type = "struct<left:double,top:double,right:double,bottom:double,coord_origin:string>"
    token_df = spark.createDataFrame(tokens, f"file_hash string, page_no int, place int, text string, box {box_type}")
    element_df = spark.createDataFrame(elements, f"file_hash string, page_no int, source_ref string, parent_ref string, label string, text string, estimate {box_type}")
    got = {r["source_ref"]: (r["score"], tuple(r["raw_bbox"])[:4]) for r in alignment.align_elements(element_df, token_df).collect()}
    assert got.keys() == {ref for ref, best in want.items() if best}
    for ref, (score, box) in got.items():
        assert abs(score - want[ref][0]) < 1e-9 and box == want[ref][1], ref


def test_cells_stay_in_their_row(spark):
    box_type = "struct<left:double,top:double,right:double,bottom:double,coord_origin:string>"
    words = [("a", 0), ("b", 0), ("same", 0), ("x", 60), ("y", 60), ("same", 60)]
    tokens = [("f", 1, i, w, (i * 20.0, float(top), i * 20.0 + 15, top + 9.0, "TOPLEFT")) for i, (w, top) in enumerate(words)]
    elements = [
        ("f", 1, "t/r1", "t", alignment.ROW_LABEL, "x y same", None),
        ("f", 1, "t/r1/c2", "t/r1", alignment.CELL_LABEL, "same", None),
        ("f", 1, "t", None, alignment.TABLE_LABEL, "", None),
    ]
    token_df = spark.createDataFrame(tokens, f"file_hash string, page_no int, place int, text string, box {box_type}")
    element_df = spark.createDataFrame(elements, f"file_hash string, page_no int, source_ref string, parent_ref string, label string, text string, estimate {box_type}")
    got = {r["source_ref"]: tuple(r["raw_bbox"])[:4] for r in alignment.align_elements(element_df, token_df).collect()}
    assert got["t/r1/c2"] == (100.0, 60.0, 115.0, 69.0)
    assert got["t"] == got["t/r1"] == (60.0, 60.0, 115.0, 69.0)


def test_preview_text(spark):
    assert spark.range(1).select(txt.preview(F.lit(" a \n b "), 3).alias("x")).first()["x"] == "a b"


def test_evidence_stays_with_its_file(spark, sf):
    """Only texts are shuffled, never the rows made of their words."""
    for name in ("chunk_evidence", "layout_regions", "table_elements", "table_row_text"):
        made = contract.queries()[name](spark, sf)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(file_hash" in plan and not re.search(r"hashpartitioning\(file_hash#\d+L?, (?!\d+\))", plan), name
    assert made.count() > 0
