"""Region kinds from reader labels, and span step and category names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered label fragments per reader family; the first hit wins.
LAYOUT_KINDS = (
    ("table_cell", "table_cell"),
    ("table", "table"),
    ("equation", "formula"),
    ("formula", "formula"),
    ("latex", "formula"),
    ("image", "image"),
    ("chart", "chart"),
    ("code", "code"),
    ("list", "list"),
    ("title", "title"),
    ("page_number", "page_number"),
    ("footnote", "footnote"),
    ("header", "header"),
    ("footer", "footer"),
)
CONTENT_KINDS = (
    ("table", "table"),
    ("equation", "formula"),
    ("math", "formula"),
    ("formula", "formula"),
    ("image", "image"),
    ("chart", "chart"),
    ("code", "code"),
    ("algorithm", "code"),
    ("list", "list"),
    ("index", "list"),
    ("title", "title"),
    ("header", "header"),
    ("footer", "footer"),
    ("footnote", "footnote"),
    ("page_number", "page_number"),
)
CATEGORY_KINDS = (
    ("header", "header"),
    ("title", "title"),
    ("text", "text"),
    ("figure", "image"),
    ("image", "image"),
    ("chart", "chart"),
    ("table", "table"),
    ("formula", "formula"),
    ("footer", "footer"),
    ("figure_caption", "text"),
    ("table_caption", "text"),
    ("formula_caption", "text"),
    ("figure_footnote", "footnote"),
    ("table_footnote", "footnote"),
    ("page_footnote", "footnote"),
)
REGION_KINDS = (
    "text", "title", "table", "table_cell", "formula", "image", "chart",
    "code", "list", "header", "footer", "footnote", "page_number", "other",
)

# Span name fragments and the category they stand for, in order.
SPAN_CATEGORIES = (
    ("markdown", "markdown"),
    ("lmstudio", "lmstudio"),
    ("docling", "docling"),
    ("mineru", "mineru"),
    ("preview", "preview"),
    ("region", "regions"),
)
DEFAULT_CATEGORY = "pipeline"

# Readers whose regions are shown and searched.
ACTIVE_ENGINES = ("docling", "mineru", "infinity", "docling_normalized", "mineru_normalized")
DEFAULT_ENGINE = "docling"


def _first_fragment(text: Column, rules: tuple[tuple[str, str], ...], default: Column) -> Column:
    kinds = [F.when(F.contains(text, F.lit(fragment)), F.lit(kind)) for fragment, kind in rules]
    return F.coalesce(*kinds, default)


def layout_kind(label: Column) -> Column:
    return _first_fragment(F.lower(F.trim(label)), LAYOUT_KINDS, F.lit("text"))


def content_kind(label: Column) -> Column:
    return _first_fragment(F.lower(label), CONTENT_KINDS, F.lit("text"))


def category_kind(label: Column) -> Column:
    name = F.lower(F.trim(label))
    exact = [F.when(name == fragment, F.lit(kind)) for fragment, kind in CATEGORY_KINDS]
    return F.coalesce(*exact, _first_fragment(name, CATEGORY_KINDS, F.lit("other")))


def span_category(name: Column) -> Column:
    return _first_fragment(name, SPAN_CATEGORIES, F.lit(DEFAULT_CATEGORY))


def span_step(name: Column, prefix: str) -> Column:
    starts = F.startswith(name, F.lit(prefix))
    rest = F.when(starts, F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    step = F.translate(rest, ".-", "__")
    return F.when(step != "", step).otherwise(name)


def engine_or_default(engine: Column, default: str = DEFAULT_ENGINE) -> Column:
    return F.coalesce(engine, F.lit(default))


def is_active_engine(engine: Column, engines: tuple[str, ...] = ACTIVE_ENGINES) -> Column:
    return engine_or_default(engine).isin(*engines)
