"""Region tables of the three reader families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import boxes, ids, kinds
from folioscope.functions import text as txt
from folioscope.functions.casts import to_int
from folioscope.functions.rows import explode_rows
from folioscope.operators import elements as el

CONTENT_LABEL = "mineru_region"
LAYOUT_LABEL = "infinity_region"


def _linked_places(elements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Elements and what chunks name besides, once for each place, with the last chunk that names it.

    One full join on narrow keys, without a union, so that rows dealt out by file stay in place.
    """
    keys = ["_at", "file_hash", "_key"]
    key = ids.box_key(F.col("source_ref"), F.col("page_no"), F.col("raw_bbox"))
    with_key = lambda df: df.withColumn("_key", key).withColumn("_at", F.xxhash64("file_hash", "_key"))
    columns = [name for name in elements.columns if name != "file_hash"]
    # Column by column, so that what is not asked for is not carried through the sorts.
    whole = lambda prefix: [F.first(name).alias(f"{prefix}{name}") for name in columns]
    known = with_key(elements).groupBy(*keys).agg(F.lit(True).alias("_is_known"), *whole("_known_"))
    last = F.max(F.struct("chunk_index", "chunk_id")).alias("_last")
    named = with_key(evidence).groupBy(*keys).agg(*whole("_named_"), last)
    places = known.join(named, keys, "full_outer")
    held = [F.when(F.col("_is_known"), F.col(f"_known_{name}")).otherwise(F.col(f"_named_{name}")).alias(name) for name in columns]
    return places.select("file_hash", *held, "_last.chunk_id", "_last.chunk_index")


def layout_regions(
    elements: DataFrame,
    pages: DataFrame,
    evidence: DataFrame | None = None,
    engine: str = "docling",
    provider: str = "local-docling",
    model: str = "docling",
) -> DataFrame:
    """Regions of the layout reader; rows without a known page are dropped."""
    on_page = lambda df: df.join(pages.select("file_hash", "page_no", "width", "height").hint("shuffle_hash"), ["file_hash", "page_no"])
    if evidence is None:
        places = el.distinct_candidates(elements, ["file_hash"]).withColumn(
            "_key", ids.box_key(F.col("source_ref"), F.col("page_no"), F.col("raw_bbox"))
        )
        sized = on_page(places.withColumns({"chunk_id": F.lit(None).cast("string"), "chunk_index": F.lit(None).cast("int")}))
    else:
        # The page is part of a place, so both sides can meet it first; after a full join rows no longer count as dealt out by file.
        sized = _linked_places(on_page(elements), on_page(evidence))
    sized = _without_item(sized)
    return _region_rows(
        sized, engine, provider, F.lit(model), kinds.layout_kind(F.col("label")), F.lit("docling_document")
    )


def _region_rows(
    placed: DataFrame, engine: str, provider: str, model: Column, kind: Column, source: Column
) -> DataFrame:
    name = F.lit(engine)
    return placed.select(
        ids.region_id(F.col("file_hash"), name, F.col("source_ref"), F.col("page_no"), F.col("raw_bbox")).alias("region_id"),
        "file_hash",
        name.alias("annotation_engine"),
        F.lit(provider).alias("annotation_provider"),
        model.alias("annotation_model"),
        "chunk_id",
        "chunk_index",
        "page_no",
        "source_ref",
        "parent_ref",
        "label",
        "text",
        "context_text",
        "raw_bbox",
        kind.alias("region_kind"),
        F.struct(
            source.alias("source"),
            "item_box",
            F.struct(F.col("source_width").alias("width"), F.col("source_height").alias("height")).alias("source_page"),
            F.struct("page_no", "width", "height").alias("target_page"),
        ).alias("metadata"),
    )


def _unlinked(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "parent_ref": F.lit(None).cast("string"),
            "chunk_id": F.lit(None).cast("string"),
            "chunk_index": F.lit(None).cast("int"),
            "context_text": F.col("text"),
        }
    )


def _without_item(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "item_box": F.lit(None).cast(boxes.BOX_TYPE),
            "source_width": F.lit(None).cast("double"),
            "source_height": F.lit(None).cast("double"),
        }
    )


def _item_member(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "string")


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _content_label() -> Column:
    kind, sub = _filled(_item_member("type")), _filled(_item_member("sub_type"))
    label = F.coalesce(kind, sub, F.lit(CONTENT_LABEL))
    extended = F.concat_ws(":", label, sub)
    return F.when(sub.isNotNull() & ~F.contains(label, sub), extended).otherwise(label)


def _item_box(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "array<string>")


def _content_list(raw: DataFrame, output: str) -> DataFrame:
    data = F.try_parse_json(F.col(output))
    listed = F.coalesce(*[F.try_variant_get(data, f"$.{key}", "array<variant>") for key in ("content_list", "content_list_v2")])
    nested = F.forall("_items", lambda item: F.startswith(F.schema_of_variant(item), F.lit("ARRAY")))
    inner = F.flatten(F.transform("_items", lambda item: F.try_variant_get(item, "$", "array<variant>")))
    items = raw.select("file_hash", F.try_variant_get(data, "$.backend", "string").alias("model"), listed.alias("_items"))
    flat = items.withColumn("_items", F.when(nested, inner).otherwise(F.col("_items")))
    return explode_rows(flat, ["file_hash", "model"], "_items", "item", "item_no")


def _with_sizes(items: DataFrame, source_pages: DataFrame, target_pages: DataFrame) -> DataFrame:
    source = source_pages.select("file_hash", "page_no", F.col("width").alias("source_width"), F.col("height").alias("source_height"))
    target = target_pages.select("file_hash", "page_no", "width", "height")
    return items.join(target, ["file_hash", "page_no"]).join(source, ["file_hash", "page_no"], "left")


def content_regions(
    raw: DataFrame,
    target_pages: DataFrame | None = None,
    engine: str = "mineru",
    provider: str = "local-mineru",
    output: str = "output_json",
) -> DataFrame:
    """Regions of the content-list reader.

    A file uses its content list where that yields any region, else every
    boxed object of its page records.
    """
    source_pages = el.content_pages(raw, output)
    target = source_pages if target_pages is None else target_pages
    listed = _content_list(raw, output)
    index = to_int(_item_member("page_idx"))
    numbered = listed.select(
        "file_hash", "model", "item",
        (F.coalesce(index, F.lit(0)) + 1).alias("page_no"),
        F.concat(F.lit("mineru:content:"), F.col("item_no").cast("string")).alias("source_ref"),
    )
    sized = _with_sizes(numbered, source_pages, target).withColumn(
        "raw_bbox", boxes.autoscale(boxes.box_from_list(_item_box("bbox")), F.col("width"), F.col("height"))
    )
    from_list = sized.filter(F.col("raw_bbox").isNotNull()).withColumn("metadata_source", F.lit("content_list"))

    # Whether a file's list yields a region is decided per file, by a join.
    done = from_list.select("file_hash").distinct()
    data = F.try_parse_json(F.col(output))
    middle = el.variant_object(data, "middle_json")
    model = F.try_variant_get(data, "$.backend", "string").alias("model")
    page_list = F.try_variant_get(middle, "$.pdf_info", "array<variant>")
    rest = explode_rows(raw.join(done, "file_hash", "left_anti"), ["file_hash", model], page_list, "page", "at")
    page_index = F.coalesce(to_int(F.try_variant_get("page", "$.page_idx", "string")), F.col("at"))
    numbered_pages = ["file_hash", "model", (page_index + 1).alias("page_no")]
    walked = explode_rows(rest, numbered_pages, el.boxed_items(F.to_json("page")), "_json", "item_no")
    items = walked.select(
        "file_hash", "model", F.parse_json("_json").alias("item"), "page_no",
        F.concat_ws(":", F.lit("mineru:middle"), F.col("page_no").cast("string"), F.col("item_no").cast("string")).alias("source_ref"),
    )
    placed = _with_sizes(items, source_pages, target).withColumn(
        "raw_bbox",
        boxes.rescale(
            boxes.box_from_list(_item_box("bbox")),
            F.col("source_width"), F.col("source_height"), F.col("width"), F.col("height"),
        ),
    )
    from_pages = placed.filter(F.col("raw_bbox").isNotNull()).withColumn("metadata_source", F.lit("middle_json"))
    both = from_list.unionByName(from_pages).withColumn("label", _content_label())
    texted = both.withColumn("_text", el.item_text(F.to_json("item")))
    texted = texted.withColumn("text", F.when(F.col("_text") != "", F.col("_text")).otherwise(F.col("label")))
    model = F.coalesce(_filled(F.col("model")), F.lit("mineru"))
    placed = _unlinked(texted).withColumn("item_box", boxes.box_from_list(_item_box("bbox")))
    kind = kinds.content_kind(F.col("label"))
    return _region_rows(placed, engine, provider, model, kind, F.col("metadata_source"))


def layout_page_regions(
    raw: DataFrame, engine: str = "infinity", provider: str = "local-infinity-parser2", output: str = "output_json"
) -> DataFrame:
    """Regions of the per-page layout reader; failed pages are skipped."""
    pages = el.explode_layout_pages(raw, output).filter(F.coalesce("status", F.lit("")) != "error")
    result = el.variant_object(F.col("page"), "result")
    with_result = pages.withColumn("_result", result)
    listed = F.coalesce(*[F.try_variant_get("_result", f"$.{key}", "array<variant>") for key in el.ITEM_LIST_KEYS])
    plain = with_result.withColumn("_items", listed)
    base = ["file_hash", "model", "page_no", "width", "height"]
    objects = F.filter("_items", lambda item: F.startswith(F.schema_of_variant(item), F.lit("OBJECT")))
    simple = explode_rows(plain, base, objects, "item", "item_no")
    unlisted = F.when(F.col("_items").isNull(), F.to_json("_result"))
    nested = explode_rows(plain, base, el.placed_items(unlisted), "_json", "item_no")
    items = simple.unionByName(nested.withColumn("item", F.parse_json("_json")).drop("_json"))
    box = boxes.box_from_list(F.coalesce(*[_non_empty(_item_box(key)) for key in el.ITEM_BOX_KEYS]))
    label = F.coalesce(*[_filled(_item_member(key)) for key in ("category", "type", "label", "region_kind")], F.lit(LAYOUT_LABEL))
    texts = [txt.strip(_item_member(key)) for key in ("text", "content", "markdown", "html", "table_body")]
    text = F.array_join(F.filter(F.array(*texts), lambda part: F.coalesce(part, F.lit("")) != ""), "\n\n")
    placed = items.withColumns({"label": label, "_text": text, "_box": box}).withColumn(
        "raw_bbox", boxes.autoscale_strict(F.col("_box"), F.col("width"), F.col("height"))
    )
    kept = placed.filter(F.col("raw_bbox").isNotNull()).withColumns(
        {
            "text": F.when(F.col("_text") != "", F.col("_text")).otherwise(F.col("label")),
            "source_ref": F.concat(
                F.lit("infinity:page:"), F.col("page_no").cast("string"), F.lit(":region:"), F.col("item_no").cast("string")
            ),
        }
    )
    model = F.coalesce(_filled(F.col("model")), F.lit("infinity-parser2"))
    kind = kinds.category_kind(F.col("label"))
    return _region_rows(_without_item(_unlinked(kept)), engine, provider, model, kind, F.lit("infinity_parser2_json"))


def _non_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)
