"""Box arithmetic on struct columns.

A raw box is ``struct<left, top, right, bottom: double, coord_origin: string>``,
a rectangle is ``struct<left, top, width, height: double>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.binding import bind
from folioscope.functions.casts import to_float

TOP_LEFT = "TOPLEFT"
BOTTOM_LEFT = "BOTTOMLEFT"
NORMALIZED_SCALE = 1000.0
SIDES = ("left", "top", "right", "bottom")
VALID_ROTATIONS = (0, 90, 180, 270)

BOX_TYPE = "struct<left:double,top:double,right:double,bottom:double,coord_origin:string>"
RAW_BOX_JSON = (
    "struct<left:string,top:string,right:string,bottom:string,"
    "l:string,t:string,r:string,b:string,coord_origin:string>"
)


def make_box(left: Column, top: Column, right: Column, bottom: Column, origin: Column | str = TOP_LEFT) -> Column:
    """A box, or NULL when a side is missing."""
    origin = F.lit(origin) if isinstance(origin, str) else origin
    built = F.struct(
        left.cast("double").alias("left"),
        top.cast("double").alias("top"),
        right.cast("double").alias("right"),
        bottom.cast("double").alias("bottom"),
        origin.alias("coord_origin"),
    )
    missing = lambda s: s["left"].isNull() | s["top"].isNull() | s["right"].isNull() | s["bottom"].isNull()
    return bind(built, lambda s: F.when(~missing(s), s))


def _json_sides(raw: Column) -> list[Column]:
    return [to_float(F.coalesce(raw[name], raw[name[0]])) for name in SIDES]


def _json_origin(raw: Column) -> Column:
    return F.when(F.coalesce(raw["coord_origin"], F.lit("")) == "", F.lit(BOTTOM_LEFT)).otherwise(raw["coord_origin"])


def box_from_json(raw: Column) -> Column:
    """Long or short side names; the origin is bottom-left unless given."""
    return make_box(*_json_sides(raw), origin=_json_origin(raw))


def with_box_from_json(df: DataFrame, raw: str, name: str) -> DataFrame:
    """``box_from_json`` as a column: sides are columns first, so that rows are worked on by generated code."""
    sides = {f"_{side}": value for side, value in zip(SIDES, _json_sides(F.col(raw)), strict=True)}
    known = F.lit(True)
    for side in sides:
        known = known & F.col(side).isNotNull()
    box = F.struct(*[F.col(f"_{side}").alias(side) for side in SIDES], _json_origin(F.col(raw)).alias("coord_origin"))
    return df.withColumns(sides).withColumn(name, F.when(known, box)).drop(*sides)


def box_from_list(values: Column) -> Column:
    """First four numbers of an array; fewer, or a non-number, gives NULL."""
    numbers = [to_float(F.try_element_at(values, F.lit(i))) for i in range(1, 5)]
    return make_box(*numbers)


def _scaled(box: Column, x: Column, y: Column) -> Column:
    return F.struct(
        (box["left"] * x).alias("left"),
        (box["top"] * y).alias("top"),
        (box["right"] * x).alias("right"),
        (box["bottom"] * y).alias("bottom"),
        F.lit(TOP_LEFT).alias("coord_origin"),
    )


def _divided(box: Column, scale: float, width: Column, height: Column) -> Column:
    side = lambda name, total: (box[name] / F.lit(scale) * total).alias(name)
    return F.struct(
        side("left", width), side("top", height), side("right", width), side("bottom", height),
        F.lit(TOP_LEFT).alias("coord_origin"),
    )


def autoscale(box: Column, width: Column, height: Column) -> Column:
    """Unit, per-mille or page coordinates, told apart by the largest value."""

    def scaled(b: Column) -> Column:
        largest = F.greatest(*[F.abs(b[side]) for side in SIDES])
        return (
            F.when(b.isNull(), F.lit(None))
            .when(largest <= 1.0, _divided(b, 1.0, width, height))
            .when(largest <= NORMALIZED_SCALE, _divided(b, NORMALIZED_SCALE, width, height))
            .otherwise(_scaled(b, F.lit(1.0), F.lit(1.0)))
        )

    return F.when(width.isNotNull() & height.isNotNull(), bind(box, scaled))


def autoscale_strict(box: Column, width: Column, height: Column) -> Column:
    """As ``autoscale``, but an empty or inverted box is rejected."""
    proper = lambda b: F.when((b["right"] > b["left"]) & (b["bottom"] > b["top"]), autoscale(b, width, height))
    return bind(box, proper)


def rescale(box: Column, source_width: Column, source_height: Column, width: Column, height: Column) -> Column:
    """From source page size to target page size."""

    def moved(b: Column) -> Column:
        sized = (source_width > 0) & (source_height > 0)
        stretched = _scaled(b, width / source_width, height / source_height)
        return F.when(b.isNotNull(), F.when(sized, stretched).otherwise(_scaled(b, F.lit(1.0), F.lit(1.0))))

    known = source_width.isNotNull() & source_height.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.when(known, bind(box, moved))


def display_box(
    source: Column, item_box: Column, stored: Column, source_width: Column, source_height: Column, width: Column, height: Column
) -> Column:
    """Box for display, derived again from the stored reader item where there is one."""
    again = F.when(source == "content_list", autoscale(item_box, width, height)).when(
        source == "middle_json", rescale(item_box, source_width, source_height, width, height)
    )
    return F.coalesce(again, stored)


def rectangle(box: Column, page_height: Column) -> Column:
    """Top-left based rectangle of a raw box."""
    low = F.least(box["top"], box["bottom"])
    high = F.greatest(box["top"], box["bottom"])
    top = F.when(F.upper(box["coord_origin"]) == TOP_LEFT, low).otherwise(page_height - high)
    return F.struct(
        F.least(box["left"], box["right"]).alias("left"),
        top.alias("top"),
        F.abs(box["right"] - box["left"]).alias("width"),
        F.abs(box["bottom"] - box["top"]).alias("height"),
    )


def _rect(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))


def orient(rect: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Apply an image orientation tag (2 to 8); other values change nothing."""
    left, top, w, h = rect["left"], rect["top"], rect["width"], rect["height"]
    from_right = width - left - w
    from_bottom = height - top - h
    return (
        F.when(orientation == 2, _rect(from_right, top, w, h))
        .when(orientation == 3, _rect(from_right, from_bottom, w, h))
        .when(orientation == 4, _rect(left, from_bottom, w, h))
        .when(orientation == 5, _rect(top, left, h, w))
        .when(orientation == 6, _rect(from_bottom, left, h, w))
        .when(orientation == 7, _rect(from_bottom, from_right, h, w))
        .when(orientation == 8, _rect(top, from_right, h, w))
        .otherwise(rect)
    )


def oriented_width(width: Column, height: Column, orientation: Column) -> Column:
    return F.when(orientation.isin(5, 6, 7, 8), height).otherwise(width)


def oriented_height(width: Column, height: Column, orientation: Column) -> Column:
    return F.when(orientation.isin(5, 6, 7, 8), width).otherwise(height)


def rotate(rect: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Clockwise quarter turns of a rectangle on a page of the given size."""
    left, top, w, h = rect["left"], rect["top"], rect["width"], rect["height"]
    from_right = width - left - w
    from_bottom = height - top - h
    turn = F.pmod(F.coalesce(degrees, F.lit(0)), F.lit(360))
    return (
        F.when(turn == 90, _rect(from_bottom, left, h, w))
        .when(turn == 180, _rect(from_right, from_bottom, w, h))
        .when(turn == 270, _rect(top, from_right, h, w))
        .otherwise(rect)
    )


def percent(value: Column, total: Column) -> Column:
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), value / total * 100.0))
    return F.when(total <= 0, F.lit(0.0)).when(value.isNotNull(), bounded)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def normalize(
    box: Column,
    width: Column,
    height: Column,
    *,
    source_width: Column | None = None,
    source_height: Column | None = None,
    orientation: Column | None = None,
    degrees: Column | None = None,
    base_width: Column | None = None,
    base_height: Column | None = None,
) -> Column:
    """Box as percentages of the displayed page."""
    none = F.lit(None)
    sw = F.coalesce(none if source_width is None else source_width, width)
    sh = F.coalesce(none if source_height is None else source_height, height)
    tag = F.lit(None).cast("int") if orientation is None else orientation
    turn = F.lit(0) if degrees is None else degrees
    bw = F.coalesce(none if base_width is None else base_width, oriented_width(sw, sh, tag))
    bh = F.coalesce(none if base_height is None else base_height, oriented_height(sw, sh, tag))

    def as_percent(rect: Column) -> Column:
        return F.struct(
            percent(rect["left"], width).alias("left_pct"),
            percent(rect["top"], height).alias("top_pct"),
            percent(rect["width"], width).alias("width_pct"),
            percent(rect["height"], height).alias("height_pct"),
        )

    def turned(upright: Column) -> Column:
        return bind(rotate(upright, bw, bh, turn), as_percent)

    return bind(rectangle(box, sh), lambda flat: bind(orient(flat, sw, sh, tag), turned))


def union_box(box: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    return F.struct(
        F.min(box["left"]).alias("left"),
        F.min(box["top"]).alias("top"),
        F.max(box["right"]).alias("right"),
        F.max(box["bottom"]).alias("bottom"),
        F.lit(TOP_LEFT).alias("coord_origin"),
    )


def center_distance(a: Column, b: Column) -> Column:
    dx = (a["left"] + a["right"]) / 2 - (b["left"] + b["right"]) / 2
    dy = (a["top"] + a["bottom"]) / 2 - (b["top"] + b["bottom"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def vertical_overlap(token: Column, band: Column, tolerance: float = 8.0) -> Column:
    top = F.least(band["top"], band["bottom"]) - tolerance
    bottom = F.greatest(band["top"], band["bottom"]) + tolerance
    return (token["bottom"] >= top) & (token["top"] <= bottom)


def valid_rotation(degrees: Column) -> Column:
    """Degrees in 0..359, or NULL when not a quarter turn; missing means 0."""
    turn = F.pmod(F.coalesce(degrees.cast("int"), F.lit(0)), F.lit(360))
    return F.when(turn.isin(*VALID_ROTATIONS), turn)
