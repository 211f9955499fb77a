"""Display boxes of regions, styles, page orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import boxes, kinds
from folioscope.functions import text as txt
from folioscope.functions.grouping import grouped_median
from folioscope.session import cut_lineage
from folioscope.sources.keyed import upsert

# Default styles.
ENGINE_COLORS = (
    ("docling", "#d55344"),
    ("docling_normalized", "#f07d5f"),
    ("mineru", "#36cfd1"),
    ("mineru_normalized", "#43b39f"),
    ("infinity", "#8f86ff"),
)
KIND_COLORS = (
    ("text", "#d55344"),
    ("title", "#b85bd4"),
    ("table", "#35a36b"),
    ("table_cell", "#60b878"),
    ("formula", "#d09a23"),
    ("image", "#5f8df7"),
    ("chart", "#4fa9c6"),
    ("code", "#8f86ff"),
    ("list", "#d37b2d"),
    ("header", "#9aa4b2"),
    ("footer", "#9aa4b2"),
    ("footnote", "#b68b62"),
    ("page_number", "#9aa4b2"),
    ("other", "#d55344"),
)
UNKNOWN_ENGINE_COLOR = "#9aa4b2"
DEFAULT_COLOR = "#d55344"
STROKE_OPACITY = 0.82
FILL_OPACITY = 0.14
STROKE_WIDTH = 2.0
PAGE_SPACE_ENGINES = ("docling_normalized", "mineru_normalized", "infinity")

# The sideways-page rule.
ORIENTATION_KINDS = ("text", "title", "header", "footer")
MIN_TEXT_CHARS = 8
MIN_VERTICAL_BOXES = 3
VERTICAL_ASPECT = 2.0
MIN_VERTICAL_RATIO = 0.4
LEFT_SIDE = 0.45
RIGHT_SIDE = 0.55

STYLE_KEYS = ("annotation_engine", "region_kind", "label")
STYLE_FIELDS = ("stroke_color", "fill_color", "stroke_opacity", "fill_opacity", "stroke_width")


def _style(color: Column) -> dict[str, Column]:
    return {
        "stroke_color": color,
        "fill_color": color,
        "stroke_opacity": F.lit(STROKE_OPACITY),
        "fill_opacity": F.lit(FILL_OPACITY),
        "stroke_width": F.lit(STROKE_WIDTH),
    }


def default_styles(spark: SparkSession) -> DataFrame:
    """One style per engine and kind, from fixed colours."""
    rows = [
        (engine, kind, "", engine_color if kind == "other" else kind_color)
        for engine, engine_color in ENGINE_COLORS
        for kind, kind_color in KIND_COLORS
    ]
    colored = spark.createDataFrame(rows, "annotation_engine string, region_kind string, label string, color string")
    return colored.select(*STYLE_KEYS, *[value.alias(name) for name, value in _style(F.col("color")).items()])


def normalized_styles(styles: DataFrame) -> DataFrame:
    """Keys trimmed and lower-cased, values within bounds, bad colours replaced."""
    color = lambda name: F.when(
        F.trim(name).rlike("^#[0-9a-fA-F]{6}$"), F.lower(F.trim(name))
    ).otherwise(F.lit(DEFAULT_COLOR))
    kind = F.lower(F.trim("region_kind"))
    return styles.select(
        F.lower(F.trim("annotation_engine")).alias("annotation_engine"),
        F.when(kind != "", kind).otherwise(F.lit("other")).alias("region_kind"),
        F.trim(F.coalesce("label", F.lit(""))).alias("label"),
        color(F.col("stroke_color")).alias("stroke_color"),
        color(F.col("fill_color")).alias("fill_color"),
        boxes.clamp(F.col("stroke_opacity"), 0.0, 1.0).alias("stroke_opacity"),
        boxes.clamp(F.col("fill_opacity"), 0.0, 1.0).alias("fill_opacity"),
        boxes.clamp(F.col("stroke_width"), 1.0, 8.0).alias("stroke_width"),
    )


def effective_styles(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    return upsert(defaults, normalized_styles(stored), STYLE_KEYS)


def resolve_styles(regions: DataFrame, styles: DataFrame) -> DataFrame:
    """Style of each region: own label, else kind, else engine, else a default.

    The style table is one row per engine, kind and label; whether it is
    broadcast is left to the size check of the optimiser.
    """
    style = F.struct(*STYLE_FIELDS).alias("_style")
    packed = styles.select(*STYLE_KEYS, style)
    engine = F.lower(F.trim("annotation_engine"))
    kind = F.lower(F.trim("region_kind"))
    keyed = regions.withColumns(
        {
            "_engine": F.when(engine != "", engine).otherwise(F.lit(kinds.DEFAULT_ENGINE)),
            "_kind": F.when(kind != "", kind).otherwise(F.lit("other")),
            "_label": F.trim(F.coalesce("label", F.lit(""))),
        }
    )

    def lookup(name: str, kind_key: Column, label_key: Column) -> tuple[DataFrame, Column]:
        side = packed.select(
            F.col("annotation_engine").alias("_e"), F.col("region_kind").alias("_k"), F.col("label").alias("_l"),
            F.col("_style").alias(name),
        )
        return side, (F.col("_engine") == F.col("_e")) & (kind_key == F.col("_k")) & (label_key == F.col("_l"))

    joined = keyed
    for name, kind_key, label_key in (
        ("_by_label", F.col("_kind"), F.col("_label")),
        ("_by_kind", F.col("_kind"), F.lit("")),
        ("_by_engine", F.lit("other"), F.lit("")),
    ):
        side, condition = lookup(name, kind_key, label_key)
        joined = joined.join(side, condition, "left").drop("_e", "_k", "_l")
    color = F.coalesce(
        *[F.when(F.col("_engine") == name, F.lit(value)) for name, value in ENGINE_COLORS], F.lit(UNKNOWN_ENGINE_COLOR)
    )
    fallback = F.struct(*[value.alias(name) for name, value in _style(color).items()])
    resolved = joined.withColumn("style", F.coalesce("_by_label", "_by_kind", "_by_engine", fallback))
    return resolved.drop("_engine", "_kind", "_label", "_by_label", "_by_kind", "_by_engine")


def page_geometry(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Pages with their stored rotation; sizes swap on a quarter turn.

    Pages may carry an ``orientation`` tag; the image is oriented first.
    """
    turned = pages.join(
        overrides.select("file_hash", "page_no", boxes.valid_rotation(F.col("clockwise_degrees")).alias("_turn")),
        ["file_hash", "page_no"],
        "left",
    )
    tag = F.col("orientation") if "orientation" in pages.columns else F.lit(None).cast("int")
    base_width = boxes.oriented_width(F.col("width"), F.col("height"), tag)
    base_height = boxes.oriented_height(F.col("width"), F.col("height"), tag)
    degrees = F.coalesce("_turn", F.lit(0))
    swaps = degrees.isin(90, 270)
    return turned.select(
        "file_hash",
        "page_no",
        F.when(swaps, base_height).otherwise(base_width).alias("width"),
        F.when(swaps, base_width).otherwise(base_height).alias("height"),
        F.col("width").alias("source_width"),
        F.col("height").alias("source_height"),
        tag.alias("orientation"),
        degrees.alias("degrees"),
        base_width.alias("base_width"),
        base_height.alias("base_height"),
    )


def region_overlays(regions: DataFrame, geometry: DataFrame, visibility: DataFrame, styles: DataFrame) -> DataFrame:
    """Everything a viewer needs per region: percent box, style, visibility."""
    engine = kinds.engine_or_default(F.col("annotation_engine"))
    shown = regions.filter(kinds.is_active_engine(F.col("annotation_engine"))).withColumns(
        {
            "annotation_engine": engine,
            "region_kind": F.coalesce("region_kind", F.lit("text")),
            "overlay_id": F.concat(F.lit("region:"), F.col("region_id")),
        }
    )
    hidden = visibility.select("file_hash", "overlay_id", F.col("hidden").alias("_hidden"))
    sized = shown.join(geometry, ["file_hash", "page_no"]).join(hidden, ["file_hash", "overlay_id"], "left")
    is_content = F.col("annotation_engine") == "mineru"
    own_page = F.col("annotation_engine").isin(*PAGE_SPACE_ENGINES)
    target = F.col("metadata.target_page")
    has_target = own_page & (target["width"] > 0) & (target["height"] > 0)
    item_box, source_page = F.col("metadata.item_box"), F.col("metadata.source_page")
    redrawn = boxes.display_box(
        F.col("metadata.source"), item_box, F.col("raw_bbox"),
        source_page["width"], source_page["height"], F.col("base_width"), F.col("base_height"),
    )
    boxed = sized.withColumn("raw_bbox", F.when(is_content, redrawn).otherwise(F.col("raw_bbox")))
    plain = boxes.normalize(F.col("raw_bbox"), target["width"], target["height"])
    content = boxes.normalize(
        F.col("raw_bbox"), F.col("width"), F.col("height"),
        source_width=F.col("base_width"), source_height=F.col("base_height"), degrees=F.col("degrees"),
        base_width=F.col("base_width"), base_height=F.col("base_height"),
    )
    imaged = boxes.normalize(
        F.col("raw_bbox"), F.col("width"), F.col("height"),
        source_width=F.col("source_width"), source_height=F.col("source_height"),
        orientation=F.col("orientation"), degrees=F.col("degrees"),
        base_width=F.col("base_width"), base_height=F.col("base_height"),
    )
    drawn = boxed.withColumn("bbox", F.when(has_target, plain).when(is_content, content).otherwise(imaged))
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.coalesce("context_text", F.lit("")))
    styled = resolve_styles(drawn, styles)
    return styled.select(
        "overlay_id", "file_hash", "annotation_engine",
        F.coalesce("annotation_provider", F.lit("local-docling")).alias("annotation_provider"),
        F.coalesce("annotation_model", F.lit("docling")).alias("annotation_model"),
        "chunk_id",
        F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        "page_no", "raw_bbox", "bbox", "source_ref", "label", "region_kind",
        F.substring(text, 1, txt.PREVIEW_CHARS).alias("text_preview"),
        F.coalesce("_hidden", F.lit(False)).alias("hidden"),
        "style",
    )


def overlay_order() -> list[Column]:
    return [
        F.col("file_hash"),
        F.col("page_no"),
        F.col("annotation_engine"),
        F.when(F.col("chunk_index") >= 0, F.col("chunk_index")).asc_nulls_last(),
        F.col("source_ref"),
        F.col("overlay_id"),
    ]


def visible_overlays(overlays: DataFrame, engine_switches: DataFrame) -> DataFrame:
    """Not hidden, and the engine not switched off; engines are on by default."""
    switches = engine_switches.select("annotation_engine", F.col("visible").alias("_on"))
    joined = overlays.join(switches, "annotation_engine", "left")
    return joined.filter(~F.col("hidden") & F.coalesce("_on", F.lit(True))).drop("_on")


def sideways_pages(regions: DataFrame, pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Pages whose tall narrow text boxes show that the scan lies on its side."""
    fitting = regions.filter(
        (F.col("annotation_engine") == "docling")
        & F.col("region_kind").isin(*ORIENTATION_KINDS)
        & (F.length(txt.strip(F.coalesce("text", F.lit("")))) >= MIN_TEXT_CHARS)
    )
    known = pages if overrides is None else pages.join(overrides, ["file_hash", "page_no"], "left_anti")
    sized = fitting.join(known.select("file_hash", "page_no", "width", "height"), ["file_hash", "page_no"])
    rect = boxes.rectangle(F.col("raw_bbox"), F.col("height"))
    measured = sized.select(
        "file_hash",
        "page_no",
        F.col("width").alias("page_width"),
        (rect["left"] + rect["width"] / 2).alias("x_center"),
        (rect["height"] / F.nullif(rect["width"], F.lit(0.0)) >= VERTICAL_ASPECT).alias("vertical"),
        rect["width"].alias("w"),
        rect["height"].alias("h"),
    ).filter((F.col("w") > 0) & (F.col("h") > 0))
    # narrow, and used by the counts and three times by the medians
    measured = cut_lineage(measured.drop("w", "h"))
    keys = ["file_hash", "page_no"]
    counts = measured.groupBy(*keys).agg(
        F.count("*").alias("eligible_box_count"),
        F.count(F.when(F.col("vertical"), 1)).alias("vertical_box_count"),
        F.max("page_width").alias("page_width"),
    )
    ratio = F.col("vertical_box_count") / F.col("eligible_box_count")
    standing = counts.withColumn("vertical_ratio", ratio).filter(
        (F.col("eligible_box_count") >= MIN_VERTICAL_BOXES)
        & (F.col("vertical_box_count") >= MIN_VERTICAL_BOXES)
        & (ratio >= MIN_VERTICAL_RATIO)
    )
    medians = grouped_median(measured.filter("vertical"), keys, "x_center", 4.0, "median_x")
    placed = standing.join(medians, keys).withColumn(
        "median_x_pct", F.col("median_x") / F.greatest(F.col("page_width"), F.lit(1.0))
    )
    degrees = F.when(F.col("median_x_pct") >= RIGHT_SIDE, 90).when(F.col("median_x_pct") <= LEFT_SIDE, 270)
    return placed.withColumn("clockwise_degrees", degrees).filter(degrees.isNotNull()).select(
        *keys,
        "clockwise_degrees",
        F.lit("docling_layout_heuristic").alias("source"),
        F.least(F.lit(0.9), 0.55 + F.col("vertical_ratio") * 0.35).alias("confidence"),
        "eligible_box_count",
        "vertical_box_count",
        "vertical_ratio",
        "median_x_pct",
    )


def with_page_rotation(pages: DataFrame, overrides: DataFrame, stored: DataFrame, variant: str = "normalized") -> DataFrame:
    """Pages with their rotation (0 where none is stored) and stored size of one variant."""
    turns = overrides.select("file_hash", "page_no", boxes.valid_rotation(F.col("clockwise_degrees")).alias("_turn"))
    sizes = stored.filter(F.col("variant") == variant).select(
        "file_hash", "page_no", F.col("page_width").alias("stored_width"), F.col("page_height").alias("stored_height")
    )
    keys = ["file_hash", "page_no"]
    joined = pages.join(turns, keys, "left").join(sizes, keys, "left")
    return joined.withColumn("rotation_degrees", F.coalesce("_turn", F.lit(0))).drop("_turn")
