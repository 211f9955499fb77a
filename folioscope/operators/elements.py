"""Reader JSON to rows: text and table elements, page sizes, chunk evidence."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import boxes, ids
from folioscope.functions import text as txt
from folioscope.functions.binding import bind
from folioscope.functions.casts import to_float, to_int
from folioscope.functions.grouping import first_per_group, ordered_concat
from folioscope.functions.rows import explode_rows

PROV_JSON = f"array<struct<page_no:string,bbox:{boxes.RAW_BOX_JSON}>>"
LAYOUT_JSON = (
    f"struct<texts:array<struct<self_ref:string,label:string,text:string,orig:string,prov:{PROV_JSON}>>,"
    f"tables:array<struct<self_ref:string,label:string,prov:{PROV_JSON},data:struct<table_cells:"
    f"array<struct<text:string,orig:string,bbox:{boxes.RAW_BOX_JSON},start_row_offset_idx:string>>>>>,"
    "pages:string>"
)
ITEM_JSON = (
    f"struct<docling_meta:struct<doc_items:array<struct<self_ref:string,label:string,prov:{PROV_JSON}>>>,"
    "mistral_elements:array<struct<source_ref:string,parent_ref:string,label:string,text:string,"
    f"context_text:string,page_no:string,bbox:{boxes.RAW_BOX_JSON}>>,"
    f"mistral_pages:array<struct<source_ref:string,page_no:string,bbox:{boxes.RAW_BOX_JSON}>>>"
)
ELEMENT_COLUMNS = (
    "file_hash", "source_ref", "parent_ref", "label", "text", "context_text", "page_no", "raw_bbox",
)


def parse_layout(raw: DataFrame, output: str = "output_json") -> DataFrame:
    """Parse the reader output once; bad JSON gives an empty layout."""
    return raw.withColumn("layout", F.from_json(F.col(output), LAYOUT_JSON)).drop(output)


def element_text(item: Column) -> Column:
    """``text`` unless blank, else ``orig``; white space collapsed."""
    orig = txt.collapse_spaces(F.coalesce(item["orig"], F.lit("")))
    return bind(txt.collapse_spaces(F.coalesce(item["text"], F.lit(""))), lambda text: F.when(text != "", text).otherwise(orig))


def _filled(value: Column, otherwise: Column | None = None) -> Column:
    kept = F.when(F.coalesce(value, F.lit("")) != "", value)
    return kept if otherwise is None else F.coalesce(kept, otherwise)


def text_elements(layouts: DataFrame) -> DataFrame:
    """One row per text item and place on a page."""
    items = explode_rows(layouts, ["file_hash"], "layout.texts", "item", "item_no")
    named = items.select(
        "file_hash",
        "item_no",
        F.col("item.self_ref").alias("source_ref"),
        _filled(F.col("item.label")).alias("label"),
        element_text(F.col("item")).alias("text"),
        F.explode("item.prov").alias("prov"),
    )
    placed = named.select(
        "file_hash",
        "source_ref",
        F.lit(None).cast("string").alias("parent_ref"),
        "label",
        "text",
        F.col("text").alias("context_text"),
        to_int(F.col("prov.page_no")).alias("page_no"),
        boxes.box_from_json(F.col("prov.bbox")).alias("raw_bbox"),
    )
    usable = (F.coalesce("source_ref", F.lit("")) != "") & (F.col("text") != "")
    return placed.filter(usable & F.col("page_no").isNotNull() & F.col("raw_bbox").isNotNull())


def _group(ref: Column, label: Column, page_no: Column, parts: Column, number: Column) -> Column:
    """What shares a page and a ref: the table itself and its cells, or a text item alone."""
    return F.struct(number.cast("int").alias("table_no"), ref.alias("ref"), label.alias("label"), page_no.alias("page_no"), parts.alias("parts"))


def _part(text: Column, orig: Column, bbox: Column, row: Column) -> Column:
    """In the shape of a cell, so that cells are taken over as they were read."""
    return F.struct(text.alias("text"), orig.alias("orig"), bbox.alias("bbox"), row.alias("start_row_offset_idx"))


def _text_groups(item: Column) -> Column:
    """A group without a number for each place of a text item."""
    alone = lambda prov: F.array(_part(item["text"], item["orig"], prov["bbox"], F.lit(None).cast("string")))
    placed = F.transform(item["prov"], lambda prov: _group(item["self_ref"], _filled(item["label"]), to_int(prov["page_no"]), alone(prov), F.lit(None)))
    return F.coalesce(placed, F.array())


def _table_group(item: Column, number: Column) -> Column:
    """A table and its cells behind it."""
    pages = F.transform(item["prov"], lambda prov: to_int(prov["page_no"]))
    boxed = F.filter(item["prov"], lambda prov: prov["bbox"].isNotNull())
    cells = item["data"]["table_cells"]
    whole = F.coalesce(F.array_join(F.transform(cells, element_text), " "), F.lit(""))
    none = F.lit(None).cast("string")
    itself = F.array(_part(whole, none, F.try_element_at(boxed, F.lit(1))["bbox"], none))
    page = F.try_element_at(F.filter(pages, lambda page: page.isNotNull()), F.lit(1))
    parts = F.when(cells.isNotNull(), F.concat(itself, cells)).otherwise(itself)
    return _group(item["self_ref"], _filled(item["label"], F.lit("table")), page, parts, number)


def table_rows(cells: DataFrame) -> DataFrame:
    """Text of each table row: its cell texts in order."""
    used = cells.filter(F.col("row_no").isNotNull() & (F.col("text") != ""))
    return ordered_concat(used, ["file_hash", "table_no", "row_no"], "cell_no", "text", " ", "row_text")


def table_elements(layouts: DataFrame, *, first_row_alone: bool = False) -> DataFrame:
    """Tables and their cells; a cell's context is the text of its row.

    ``first_row_alone`` keeps the older behaviour in which cells of row 0
    have only their own text as context.  Tables and cells come out of one
    pass over the parsed output, numbered -1 for the table itself.
    """
    return _elements(layouts, F.transform("layout.tables", _table_group), first_row_alone)


def layout_elements(layouts: DataFrame, *, first_row_alone: bool = False) -> DataFrame:
    """Text items, tables and cells in one pass, so that rows stay where their file is."""
    groups = [F.flatten(F.transform("layout.texts", _text_groups)), F.transform("layout.tables", _table_group)]
    return _elements(layouts, F.concat(*[F.coalesce(found, F.array()) for found in groups]), first_row_alone)


def _elements(layouts: DataFrame, groups: Column, first_row_alone: bool) -> DataFrame:
    held = explode_rows(layouts, ["file_hash"], groups, "group").select("file_hash", "group.*")
    known = held.filter((F.coalesce("ref", F.lit("")) != "") & F.col("page_no").isNotNull())
    keep = ["file_hash", "table_no", "ref", "label", "page_no"]
    # Texts and boxes are made of single rows, by generated code, not inside the arrays.
    held_parts = explode_rows(known, keep, "parts", "part", "at").select(*keep, F.when(F.col("table_no").isNotNull(), F.col("at") - 1).otherwise(-2).alias("cell_no"), "part")
    blank_or = txt.collapse_spaces(F.coalesce("part.text", F.lit("")))
    texted = held_parts.withColumns({"_text": blank_or, "row_no": to_int(F.col("part.start_row_offset_idx"))})
    orig = txt.collapse_spaces(F.coalesce("part.orig", F.lit("")))
    text = F.when(F.col("cell_no") == -1, F.col("part.text")).when(F.col("_text") != "", F.col("_text")).otherwise(orig)
    placed = boxes.with_box_from_json(texted.withColumns({"text": text, "bbox": F.col("part.bbox")}).drop("_text", "part"), "bbox", "raw_bbox").drop("bbox")
    # Cells without a row number have no row; each is a group of its own.
    apart = F.when(F.col("row_no").isNull(), F.col("cell_no"))
    of_row = Window.partitionBy("file_hash", "table_no", "row_no", apart).orderBy("cell_no")
    whole_row = of_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row_text = F.array_join(F.collect_list(F.when(F.col("text") != "", F.col("text"))).over(whole_row), " ")
    is_table, is_cell = F.col("cell_no") == -1, F.col("cell_no") >= 0
    alone = F.col("row_no").isNull() | ((F.col("row_no") == 0) if first_row_alone else F.lit(False))
    numbered = placed.withColumn("context_text", F.when(alone, F.col("text")).otherwise(row_text))
    kept = numbered.filter(F.col("raw_bbox").isNotNull() & (is_table | (F.col("text") != "")))
    cell_ref = F.concat(F.col("ref"), F.lit("/cells/"), F.col("cell_no").cast("string"))
    return kept.select(
        "file_hash",
        F.when(is_cell, cell_ref).otherwise(F.col("ref")).alias("source_ref"),
        F.when(is_cell, F.col("ref")).alias("parent_ref"),
        F.when(is_cell, F.lit("table_cell")).otherwise(F.col("label")).alias("label"),
        "text",
        "context_text",
        "page_no",
        "raw_bbox",
    )


def distinct_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per element and place; places are compared to three decimals.

    Rows are grouped by a hash first: a sort compares its first key by eight
    bytes, which are the same for all rows of a file where the file comes first.
    """
    keyed = candidates.withColumn("_key", ids.box_key(F.col("source_ref"), F.col("page_no"), F.col("raw_bbox")))
    rest = [name for name in candidates.columns if name not in keys]
    once = keyed.groupBy(F.xxhash64(*keys, "_key").alias("_at"), *keys, "_key").agg(*[F.first(name).alias(name) for name in rest])
    return once.select(*candidates.columns)


# --- page sizes --------------------------------------------------------------


def layout_pages(layouts: DataFrame) -> DataFrame:
    """Page sizes in keyed form (size) or list form (dimensions)."""
    pages = F.col("layout.pages")
    keyed_type = "map<string,struct<page_no:string,size:struct<width:string,height:string>>>"
    listed_type = "array<struct<dimensions:struct<width:string,height:string>>>"
    is_list = F.startswith(F.ltrim(pages), F.lit("["))

    def size(number: Column, sizes: Column) -> Column:
        return F.struct(number.cast("int").alias("page_no"), to_float(sizes["width"]).alias("width"), to_float(sizes["height"]).alias("height"))

    def keyed(page: Column, at: Column) -> Column:
        number = to_int(page["page_no"])
        return size(F.coalesce(F.when(number != 0, number), at + 1), page["size"])

    by_key = F.transform(F.map_values(F.from_json(pages, keyed_type)), keyed)
    by_place = F.transform(F.from_json(pages, listed_type), lambda page, at: size(at + 1, page["dimensions"]))
    found = explode_rows(layouts, ["file_hash"], F.when(is_list, by_place).otherwise(by_key), "page").select("file_hash", "page.*")
    return found.filter(F.col("width").isNotNull() & F.col("height").isNotNull())


def variant_array(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def variant_object(value: Column, name: str) -> Column:
    """A member that is an object, or a string that holds one."""
    nested = F.try_variant_get(value, f"$.{name}", "variant")
    text = F.when(F.schema_of_variant(nested) == "STRING", nested.cast("string"))
    return F.coalesce(F.try_parse_json(text), nested)


def content_pages(raw: DataFrame, output: str = "output_json") -> DataFrame:
    """Page sizes of the content-list reader: middle_json.pdf_info[].page_size."""
    middle = variant_object(F.try_parse_json(F.col(output)), "middle_json")
    entries = explode_rows(raw, ["file_hash"], variant_array(middle, "$.pdf_info"), "page", "at")
    index = to_int(F.try_variant_get("page", "$.page_idx", "string"))
    return entries.select(
        "file_hash",
        (F.coalesce(index, F.col("at")) + 1).alias("page_no"),
        to_float(F.try_variant_get("page", "$.page_size[0]", "string")).alias("width"),
        to_float(F.try_variant_get("page", "$.page_size[1]", "string")).alias("height"),
    ).filter(F.col("width").isNotNull() & F.col("height").isNotNull())


def explode_layout_pages(raw: DataFrame, output: str = "output_json") -> DataFrame:
    """Pages of the per-page layout reader, with number and size."""
    data = F.try_parse_json(F.col(output))
    model = F.try_variant_get(data, "$.model", "string").alias("model")
    pages = explode_rows(raw, ["file_hash", model], variant_array(data, "$.pages"), "page", "at")
    number = to_int(F.try_variant_get("page", "$.page_no", "string"))
    return pages.select(
        "file_hash",
        "model",
        "page",
        F.coalesce(F.when(number != 0, number), F.col("at") + 1).alias("page_no"),
        to_float(F.try_variant_get("page", "$.width", "string")).alias("width"),
        to_float(F.try_variant_get("page", "$.height", "string")).alias("height"),
        F.try_variant_get("page", "$.status", "string").alias("status"),
    ).filter((F.col("width") > 0) & (F.col("height") > 0))


def layout_reader_pages(raw: DataFrame, output: str = "output_json") -> DataFrame:
    return explode_layout_pages(raw, output).select("file_hash", "page_no", "width", "height")


def document_pages(ranked_sources: list[DataFrame]) -> DataFrame:
    """Page sizes from the first source that has any for the file.

    Sources come in order of trust: image, layout, content list, page layout,
    preview cache.
    """
    tagged = [df.select("file_hash", "page_no", "width", "height").withColumn("_rank", F.lit(i)) for i, df in enumerate(ranked_sources)]
    pages = tagged[0]
    for other in tagged[1:]:
        pages = pages.unionByName(other)
    best = pages.groupBy("file_hash").agg(F.min("_rank").alias("_rank"))
    kept = pages.join(best, ["file_hash", "_rank"])
    return first_per_group(kept, ["file_hash", "page_no"], [F.col("width"), F.col("height")]).withColumnRenamed("_rank", "source_rank")


# --- chunk evidence ----------------------------------------------------------


def chunk_items(chunks: DataFrame, metadata: str = "metadata_json", keep: Sequence[Column] = ()) -> DataFrame:
    parsed = chunks.select("file_hash", "chunk_id", "chunk_index", *keep, F.from_json(F.col(metadata), ITEM_JSON).alias("_meta"))
    return explode_rows(parsed, [name for name in parsed.columns if name != "_meta"], "_meta.docling_meta.doc_items", "item", "item_no")


def _named_by_items(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that an item of a chunk names, by their own ref or as a child; items are few, so they are hashed and elements not sorted."""
    items = chunk_items(chunks).select("file_hash", "chunk_id", "chunk_index", F.col("item.self_ref").alias("item_ref"))
    name = lambda ref, child: F.struct(F.col(ref).alias("item_ref"), F.lit(child).alias("_child"))
    named = elements.select(*ELEMENT_COLUMNS, F.inline(F.array(name("source_ref", False), name("parent_ref", True)))).filter("item_ref IS NOT NULL")
    return named.join(items.hint("shuffle_hash"), ["file_hash", "item_ref"])


def item_evidence(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that the items of each chunk stand for: children of an item where there are any, else the item itself.

    Elements are gone through once.  Those that are dealt out by file, like the
    chunks, are joined where they are.
    """
    found = _named_by_items(chunks, elements)
    ref = [F.xxhash64("file_hash", "item_ref"), "file_hash", "item_ref"]
    has_children = F.max("_child").over(Window.partitionBy(*ref))
    kept = found.withColumn("_parent", has_children).filter(F.col("_child") == F.col("_parent"))
    evidence = kept.select("chunk_id", "chunk_index", *ELEMENT_COLUMNS)
    return distinct_candidates(evidence, ["file_hash", "chunk_id"])


def item_fallback(chunks: DataFrame) -> DataFrame:
    """Places named by the items themselves, with the opening of the chunk as text."""
    items = chunk_items(chunks, keep=[txt.preview(F.col("text")).alias("text")])
    ref = _filled(F.col("item.self_ref"), F.concat(F.lit("chunk-item-"), F.col("item_no").cast("string")))
    placed = items.select(
        "file_hash", "chunk_id", "chunk_index", "text", ref.alias("parent_ref"),
        _filled(F.col("item.label")).alias("label"),
        F.posexplode("item.prov").alias("prov_no", "prov"),
    )
    boxed = placed.select(
        "file_hash", "chunk_id", "chunk_index", "text",
        F.concat(F.col("parent_ref"), F.lit(":prov:"), F.col("prov_no").cast("string")).alias("source_ref"),
        "parent_ref", "label",
        to_int(F.col("prov.page_no")).alias("page_no"),
        boxes.box_from_json(F.col("prov.bbox")).alias("raw_bbox"),
    ).filter(F.col("page_no").isNotNull() & F.col("raw_bbox").isNotNull())
    return boxed.withColumn("context_text", F.col("text")).select("chunk_id", "chunk_index", *ELEMENT_COLUMNS)


def page_item_fallback(chunks: DataFrame) -> DataFrame:
    """Evidence of an older provider: its elements, else its pages with the chunk's opening."""
    parsed = chunks.withColumn("_meta", F.from_json(F.col("metadata_json"), ITEM_JSON))
    legacy = parsed.filter(F.col("_meta.docling_meta").isNull())
    base = ["file_hash", "chunk_id", "chunk_index"]
    items = legacy.select(*base, F.posexplode("_meta.mistral_elements").alias("at", "e"))
    text = txt.strip(F.coalesce("e.text", F.lit("")))
    elements = items.select(
        *base,
        _filled(F.col("e.source_ref"), F.concat(F.lit("mistral-element-"), F.col("at").cast("string"))).alias("source_ref"),
        _filled(F.col("e.parent_ref")).alias("parent_ref"),
        _filled(F.col("e.label"), F.lit("mistral_ocr_element")).alias("label"),
        text.alias("text"),
        txt.strip(_filled(F.col("e.context_text"), text)).alias("context_text"),
        to_int(F.col("e.page_no")).alias("page_no"),
        boxes.box_from_json(F.col("e.bbox")).alias("raw_bbox"),
    ).filter(F.col("page_no").isNotNull() & F.col("raw_bbox").isNotNull())
    elements = elements.filter((F.col("text") != "") | (F.col("context_text") != ""))
    paged = legacy.join(elements.select("chunk_id").distinct(), "chunk_id", "left_anti").select(
        *base, txt.preview(F.col("text")).alias("text"), F.explode("_meta.mistral_pages").alias("p")
    )
    number = to_int(F.col("p.page_no"))
    pages = paged.select(
        *base,
        _filled(F.col("p.source_ref"), F.concat(F.lit("mistral-page-"), number.cast("string"))).alias("source_ref"),
        F.lit(None).cast("string").alias("parent_ref"),
        F.lit("mistral_ocr_page").alias("label"),
        "text",
        F.col("text").alias("context_text"),
        number.alias("page_no"),
        boxes.box_from_json(F.col("p.bbox")).alias("raw_bbox"),
    ).filter(F.col("page_no").isNotNull() & F.col("raw_bbox").isNotNull())
    return elements.unionByName(pages).select("chunk_id", "chunk_index", *ELEMENT_COLUMNS)


def chunk_evidence(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """All evidence of all chunks; the fallbacks serve chunks without element hits."""
    found = item_evidence(chunks, elements)
    # Of what an item names, something is always kept; a chunk is looked for where its file is.
    served = _named_by_items(chunks, elements).select("file_hash", "chunk_id").distinct()
    rest = item_fallback(chunks).join(served, ["file_hash", "chunk_id"], "left_anti")
    return found.unionByName(rest).unionByName(page_item_fallback(chunks))


# --- items of arbitrary nesting ---------------------------------------------

# Where the content-list reader keeps text.
ITEM_TEXT_KEYS = (
    "text", "content", "table_body", "code_body", "algorithm_content", "paragraph_content",
    "title_content", "math_content", "image_caption", "image_footnote", "table_caption",
    "table_footnote", "chart_caption", "chart_footnote", "list_items",
)
RESULT_TEXT_KEYS = ("text", "content", "markdown", "html")
ITEM_BOX_KEYS = ("bbox", "box", "box_2d", "bounding_box")
ITEM_LIST_KEYS = ("elements", "layout", "regions", "items", "blocks")


class _Nodes:
    """A JSON value as rows in document order: value, key in its object, parent row, row behind the last descendant.

    One loop with a stack makes the rows, so depth is no limit.  With
    ``open_strings`` a string that holds JSON counts as that JSON.
    """

    def __init__(self, text: str | None, open_strings: bool = False):
        self.value: list[object] = []
        self.key: list[str | None] = []
        self.parent: list[int] = []
        waiting: list[tuple[object, str | None, int]] = [(_parsed(text), None, -1)]
        while waiting:
            value, key, parent = waiting.pop()
            if open_strings and isinstance(value, str):
                value = _parsed(value)
            here = len(self.value)
            self.value.append(value)
            self.key.append(key)
            self.parent.append(parent)
            named = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
            waiting.extend((child, name, here) for name, child in reversed(list(named)))
        self.behind = list(range(1, len(self.value) + 1))
        for row in range(len(self.value) - 1, 0, -1):
            above = self.parent[row]
            self.behind[above] = max(self.behind[above], self.behind[row])

    def rows(self, kind: type, first: int = 0, behind: int | None = None) -> list[int]:
        end = len(self.value) if behind is None else behind
        return [row for row in range(first, end) if isinstance(self.value[row], kind)]


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _one_line(texts: Iterable[object]) -> str:
    return " ".join(" ".join(texts).split())


def _texts_by_key(nodes: _Nodes) -> list[str]:
    """Strings below the known keys of the outermost object, key by key."""
    tops = {nodes.key[row]: row for row in range(len(nodes.value)) if nodes.parent[row] == 0}
    known = [tops[key] for key in ITEM_TEXT_KEYS if key in tops]
    return [nodes.value[at] for row in known for at in nodes.rows(str, row, nodes.behind[row])]


def _result_lines(nodes: _Nodes) -> list[str]:
    """Strings of lists and of known keys; those of an object come before what lies deeper in it."""
    rank = {key: at for at, key in enumerate(RESULT_TEXT_KEYS)}
    place: list[tuple] = []
    for row, (key, parent) in enumerate(zip(nodes.key, nodes.parent, strict=True)):
        is_known = isinstance(nodes.value[row], str) and key in rank
        place.append((*(place[parent] if parent >= 0 else ()), (0, rank[key]) if is_known else (1, row)))
    shown = [row for row in nodes.rows(str) if nodes.key[row] is None or nodes.key[row] in rank]
    lines = (" ".join(nodes.value[row].split()) for row in sorted(shown, key=place.__getitem__))
    return [line for line in lines if line]


def _with_bbox(nodes: _Nodes) -> list[object]:
    return [nodes.value[row] for row in nodes.rows(dict) if isinstance(nodes.value[row].get("bbox"), list)]


def _outermost_items(nodes: _Nodes) -> list[object]:
    """Items of the first list key of an object, or objects with a box; nothing is looked for inside what is found."""
    found: list[object] = []
    free = 0
    for row in nodes.rows(dict):
        if row < free:
            continue
        item = nodes.value[row]
        box = next((item[key] for key in ITEM_BOX_KEYS if item.get(key)), None)
        boxed = isinstance(box, list) and len(box) >= 4
        lists = [item[key] for key in ITEM_LIST_KEYS if isinstance(item.get(key), list)]
        in_list = nodes.parent[row] >= 0 and isinstance(nodes.value[nodes.parent[row]], list)
        if boxed and (in_list or not lists):
            found.append(item)
        elif lists:
            found += [child for child in lists[0] if isinstance(child, dict)]
        else:
            continue
        free = nodes.behind[row]
    return found


@F.pandas_udf(T.StringType())
def item_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All text below the known keys of one item, in key order."""
    for items in batches:
        yield pd.Series([_one_line(_texts_by_key(_Nodes(item))) for item in items])


@F.pandas_udf(T.StringType())
def result_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Plain text of a reader result, one line per text."""
    for results in batches:
        yield pd.Series(["\n".join(_result_lines(_Nodes(result))) for result in results])


@F.pandas_udf(T.ArrayType(T.StringType()))
def boxed_items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every object with a box, at any depth, outer before inner."""
    for values in batches:
        yield pd.Series([[json.dumps(item) for item in _with_bbox(_Nodes(value))] for value in values])


@F.pandas_udf(T.ArrayType(T.StringType()))
def placed_items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Layout items of a page result that has no plain item list."""
    for values in batches:
        yield pd.Series([[json.dumps(item) for item in _outermost_items(_Nodes(value, open_strings=True))] for value in values])
