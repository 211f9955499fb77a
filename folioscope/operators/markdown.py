"""Per-page Markdown: sections, best generator, fallbacks, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as txt
from folioscope.functions.grouping import first_per_group, ordered_concat
from folioscope.functions.rows import explode_rows
from folioscope.operators import elements as el

# Generators in order of trust, their labels, and the reader order for fallbacks.
GENERATOR_LABELS = (
    ("infinity_markdown", "Infinity Parser2"),
    ("markitdown", "MarkItDown"),
    ("markitdown_cu", "MarkItDown CU"),
)
GENERATORS = tuple(name for name, _label in GENERATOR_LABELS)
BEST_GENERATOR = "best_available_markdown"
BEST_LABEL = "Best available"
READER_PREFERENCE = ("infinity", "docling_normalized", "mineru_normalized", "docling", "mineru")

# Page markers.  The first form stands alone on its line.
SECTION_MARKER = r"(?imd)^\s*(?:#{1,6}\s*Page\s+(\d+)|<!--\s*page\s+(\d+)\s*-->)\s*$"
COMMENT_MARKER = r"<!--\s*page\s+(\d+)\s*-->"

PAGE_KEYS = ("file_hash", "page_no", "markdown_engine")


def _sections(text: Column, marker: str) -> Column:
    """Array of (page_no, content) after each marker."""
    parts = F.split(text, marker, -1)
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    found = F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    numbers = F.transform(found, lambda m: F.regexp_extract(m, r"(\d+)\s*(?:-->)?\s*$", 1).try_cast("int"))
    return F.zip_with(
        numbers, bodies, lambda number, body: F.struct(number.alias("page_no"), txt.strip(body).alias("content"))
    )


def split_page_sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """Markdown of one generator split by its page markers.

    Text before the first marker is dropped; sections of the same page are
    joined in order.
    """
    exploded = explode_rows(documents, ["file_hash"], _sections(F.col(text), SECTION_MARKER), "section", "section_no").select("file_hash", "section_no", F.col("section.page_no").alias("page_no"), F.col("section.content").alias("content"))
    filled = exploded.withColumn("content", F.when(F.col("content") != "", F.col("content")))
    return ordered_concat(filled, ["file_hash", "page_no"], "section_no", "content", "\n\n", "markdown_text").withColumn(
        "markdown_text", txt.strip(F.col("markdown_text"))
    )


def page_markdown(
    documents: DataFrame, pages: DataFrame, engine: str, provider: str, model: str, text: str = "text"
) -> DataFrame:
    """Usable page sections with page sizes; a one-page file needs no marker."""
    sections = split_page_sections(documents, text)
    single = pages.groupBy("file_hash").agg(F.count("*").alias("_n"), F.min("page_no").alias("page_no")).filter("_n = 1")
    whole = documents.join(sections.select("file_hash").distinct(), "file_hash", "left_anti").join(single, "file_hash")
    whole = whole.filter(txt.is_usable_text(F.col(text))).select("file_hash", "page_no", txt.strip(F.col(text)).alias("markdown_text"))
    usable = sections.unionByName(whole).filter(txt.is_usable_text(F.col("markdown_text")))
    sizes = pages.select("file_hash", "page_no", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    return usable.join(sizes, ["file_hash", "page_no"], "left").select(
        "file_hash",
        "page_no",
        F.lit(engine).alias("markdown_engine"),
        F.lit(provider).alias("markdown_provider"),
        F.lit(model).alias("markdown_model"),
        "markdown_text",
        "page_width",
        "page_height",
    )


def missing_pages(expected: DataFrame, page_markdown_rows: DataFrame) -> DataFrame:
    """Expected pages without usable Markdown, per file and generator."""
    usable = page_markdown_rows.filter(txt.is_usable_text(F.col("markdown_text"))).select(*PAGE_KEYS)
    return expected.select(*PAGE_KEYS).filter(F.col("page_no") > 0).join(usable, list(PAGE_KEYS), "left_anti")


def markdown_complete(expected: DataFrame, page_markdown_rows: DataFrame) -> DataFrame:
    """Per file and generator: are all expected pages usable?  No expected page means no."""
    keys = ["file_hash", "markdown_engine"]
    wanted = expected.select(*PAGE_KEYS).filter(F.col("page_no") > 0).distinct()
    usable = page_markdown_rows.filter(txt.is_usable_text(F.col("markdown_text"))).select(*PAGE_KEYS).distinct()
    joined = wanted.join(usable.withColumn("_ok", F.lit(True)), list(PAGE_KEYS), "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("expected_pages"),
        F.count("_ok").alias("usable_pages"),
        F.bool_and(F.coalesce("_ok", F.lit(False))).alias("complete"),
    )


def _priority(engine: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(engine == name, F.lit(i)) for i, name in enumerate(order)], F.lit(len(order)))


def best_pages(page_markdown_rows: DataFrame) -> DataFrame:
    """The most trusted usable Markdown of each page, under the virtual engine."""
    active = page_markdown_rows.filter(F.col("markdown_engine").isin(*GENERATORS) & txt.is_usable_text(F.col("markdown_text")))
    ranked = active.withColumn("_rank", _priority(F.col("markdown_engine"), GENERATORS))
    best = first_per_group(ranked, ["file_hash", "page_no"], [F.col("_rank")])
    return best.withColumn("source_engine", F.col("markdown_engine")).withColumn("markdown_engine", F.lit(BEST_GENERATOR)).drop("_rank")


def preferred_reader(raw: DataFrame) -> DataFrame:
    """One good reader row per file, the preferred reader first."""
    good = raw.filter(F.col("status") == "ok")
    rank = _priority(F.col("annotation_engine"), READER_PREFERENCE)
    return first_per_group(good.withColumn("_rank", rank), ["file_hash"], [F.col("_rank"), F.col("annotation_engine")]).drop("_rank")


def comment_pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """Text split by page comments anywhere in it; lead text is page 1, later duplicates win."""
    body = F.coalesce(F.col(text), F.lit(""))
    sections = _sections(body, COMMENT_MARKER)
    lead = txt.strip(F.element_at(F.split(body, COMMENT_MARKER, -1), 1))
    first = F.array(F.struct(F.lit(1).alias("page_no"), lead.alias("content")))
    marked = F.size(sections) > 0
    everything = F.when(marked & (lead != ""), F.concat(first, sections)).when(marked, sections)
    exploded = explode_rows(documents, ["file_hash"], everything, "s", "at")
    return exploded.groupBy(F.col("file_hash"), F.col("s.page_no").alias("page_no")).agg(
        F.max_by("s.content", "at").alias("page_text")
    )


def layout_page_text(layouts: DataFrame) -> DataFrame:
    """Texts of the layout reader joined per page, page of the first place."""
    items = explode_rows(layouts, ["file_hash"], "layout.texts", "item", "item_no")
    text = F.when(F.coalesce("item.text", F.lit("")) != "", F.col("item.text")).otherwise(F.col("item.orig"))
    page = F.try_element_at(F.col("item.prov"), F.lit(1))["page_no"].try_cast("int")
    used = items.select("file_hash", "item_no", page.alias("page_no"), text.alias("text"))
    used = used.filter(F.col("page_no").isNotNull() & (F.coalesce("text", F.lit("")) != ""))
    return ordered_concat(used, ["file_hash", "page_no"], "item_no", "text", "\n\n", "page_text")


def content_page_text(raw: DataFrame, output: str = "output_json") -> DataFrame:
    """Texts of the content-list reader joined per page."""
    data = F.try_parse_json(F.col(output))
    listed = F.try_variant_get(data, "$.content_list", "array<variant>")
    items = explode_rows(raw, ["file_hash"], listed, "item", "item_no")
    member = lambda name: F.try_variant_get("item", f"$.{name}", "string")
    text = F.when(F.coalesce(member("text"), F.lit("")) != "", member("text")).otherwise(member("content"))
    page = F.try_variant_get("item", "$.page_idx", "int") + 1
    used = items.select("file_hash", "item_no", page.alias("page_no"), text.alias("text"))
    used = used.filter(F.col("page_no").isNotNull() & (F.coalesce("text", F.lit("")) != ""))
    return ordered_concat(used, ["file_hash", "page_no"], "item_no", "text", "\n\n", "page_text")


def fallback_pages(raw: DataFrame, stored_pages: DataFrame, engine: str = BEST_GENERATOR) -> DataFrame:
    """Page text from the preferred reader: comments, else its JSON, else all on the first page.

    One row per stored page of every file with a good reader row.
    """
    reader = preferred_reader(raw)
    pages = distinct_page_sizes(stored_pages)
    by_comment = comment_pages(reader)
    rest = reader.join(by_comment.select("file_hash").distinct(), "file_hash", "left_anti")
    layouts = el.parse_layout(rest)
    has_texts = F.col("layout.texts").isNotNull()
    by_layout = layout_page_text(layouts.filter(has_texts))
    by_content = content_page_text(rest.join(layouts.filter(has_texts).select("file_hash"), "file_hash", "left_anti"))
    from_json = by_layout.unionByName(by_content)
    plain = rest.join(from_json.select("file_hash").distinct(), "file_hash", "left_anti")
    first_page = pages.groupBy("file_hash").agg(F.min("page_no").alias("page_no"))
    whole = plain.join(first_page, "file_hash").select("file_hash", "page_no", F.coalesce("text", F.lit("")).alias("page_text"))
    texts = by_comment.unionByName(from_json).unionByName(whole)
    owners = reader.select("file_hash", "annotation_engine", "reader_provider", "reader_model")
    blank = lambda name, default: F.coalesce(F.when(F.col(name) != "", F.col(name)), default)
    joined = pages.join(owners, "file_hash").join(texts, ["file_hash", "page_no"], "left")
    return joined.select(
        "file_hash",
        "page_no",
        F.lit(engine).alias("markdown_engine"),
        blank("reader_provider", F.lit("fallback")).alias("markdown_provider"),
        blank("reader_model", F.col("annotation_engine")).alias("markdown_model"),
        F.coalesce("page_text", F.lit("")).alias("markdown_text"),
        "page_width",
        "page_height",
        F.col("annotation_engine").alias("source_engine"),
    )


def distinct_page_sizes(stored_pages: DataFrame, preferred: str = "normalized") -> DataFrame:
    """One size per page, the preferred variant first."""
    order = [(F.col("variant") != preferred), F.col("variant")]
    one = first_per_group(stored_pages, ["file_hash", "page_no"], order)
    return one.select("file_hash", "page_no", "page_width", "page_height")


def read_markdown(
    page_markdown_rows: DataFrame, raw: DataFrame, stored_pages: DataFrame, engine: str = BEST_GENERATOR, page_no: int | None = None
) -> DataFrame:
    """Markdown of all files by generator, with the fallback for files that have none.

    The best-available view falls back when no page is usable, a known
    generator when it has no row at all, an unknown one is empty.
    """
    columns = ["file_hash", "page_no", "markdown_engine", "markdown_provider", "markdown_model", "markdown_text", "page_width", "page_height", "source_engine"]
    if engine == BEST_GENERATOR:
        rows = best_pages(page_markdown_rows)
    else:
        rows = page_markdown_rows.filter(F.col("markdown_engine") == engine).withColumn("source_engine", F.col("markdown_engine"))
    if page_no is not None:
        rows = rows.filter(F.col("page_no") == page_no)
    if engine != BEST_GENERATOR and engine not in GENERATORS:
        return rows.select(*columns).filter(F.lit(False))
    missing = fallback_pages(raw, stored_pages, engine).join(rows.select("file_hash").distinct(), "file_hash", "left_anti")
    if page_no is not None:
        missing = missing.filter(F.col("page_no") == page_no)
    return rows.select(*columns).unionByName(missing.select(*columns))


def markdown_with_mappings(page_markdown_rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pages beside their region mappings; a page without mapping stays, flat form."""
    return page_markdown_rows.join(mappings, list(PAGE_KEYS), "left")


MAPPING_FIELDS = ("anchor_id", "region_id", "char_start", "char_end", "confidence", "markdown_excerpt", "metadata_json")


def mapping_lists(mappings: DataFrame) -> DataFrame:
    """All mappings of a page and generator as one list, by place, anchor and region; known generators only."""
    known = mappings.filter(F.col("markdown_engine").isin(*GENERATORS))
    entry = F.struct(F.struct("char_start", "anchor_id", "region_id").alias("_order"), F.struct(*MAPPING_FIELDS).alias("mapping"))
    listed = known.groupBy(*PAGE_KEYS).agg(F.array_sort(F.collect_list(entry)).alias("_listed"))
    return listed.select(*PAGE_KEYS, F.transform("_listed", lambda e: e["mapping"]).alias("mappings"))


def markdown_with_mapping_lists(page_markdown_rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pages with the list of their mappings, empty where they have none."""
    joined = page_markdown_rows.join(mapping_lists(mappings), list(PAGE_KEYS), "left")
    return joined.withColumn("mappings", F.coalesce("mappings", F.array()))


def page_counts(page_markdown_rows: DataFrame) -> DataFrame:
    active = page_markdown_rows.filter(F.col("markdown_engine").isin(*GENERATORS))
    return active.groupBy("file_hash", "markdown_engine").agg(F.count("*").alias("page_count"))


def generator_status(files: DataFrame, page_markdown_rows: DataFrame, generators: DataFrame) -> DataFrame:
    """Per file the virtual best generator and every known one, in order of trust."""
    counts = page_counts(page_markdown_rows)
    best = counts.groupBy("file_hash").agg(F.max("page_count").alias("page_count"))
    virtual = files.select("file_hash").join(best, "file_hash", "left").select(
        "file_hash",
        F.lit(0).alias("position"),
        F.lit(BEST_GENERATOR).alias("markdown_engine"),
        F.lit(BEST_LABEL).alias("label"),
        F.when(F.col("page_count").isNotNull(), F.lit("ok")).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.lit(True).alias("is_virtual"),
    )
    known = [F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("engine"), F.lit(label).alias("label")) for i, (name, label) in enumerate(GENERATOR_LABELS)]
    expanded = files.select("file_hash", F.explode(F.array(*known)).alias("g")).select(
        "file_hash", F.col("g.position").alias("position"), F.col("g.engine").alias("markdown_engine"), F.col("g.label").alias("label")
    )
    keys = ["file_hash", "markdown_engine"]
    stored = generators.select(*keys, "status", "error", F.col("page_count").alias("_stored"), F.lit(True).alias("_has_row"))
    joined = expanded.join(stored, keys, "left").join(counts, keys, "left")
    listed = joined.select(
        "file_hash",
        "position",
        "markdown_engine",
        "label",
        "status",
        "error",
        F.when(F.col("_has_row"), F.coalesce("_stored", F.lit(0))).otherwise(F.coalesce("page_count", F.lit(0))).alias("page_count"),
        F.lit(False).alias("is_virtual"),
    )
    return virtual.unionByName(listed)


def result_markdown(result: Column) -> Column:
    """Markdown text of a reader result: a plain string, or one of its text members."""
    data = F.try_parse_json(result)
    members = [txt.strip(F.try_variant_get(data, f"$.{key}", "string")) for key in ("markdown", "text", "content")]
    is_object = F.startswith(F.schema_of_variant(data), F.lit("OBJECT"))
    picked = F.coalesce(*[F.when(member != "", member) for member in members], txt.strip(result))
    as_text = F.when(F.schema_of_variant(data) == "STRING", data.cast("string")).otherwise(result)
    return F.when(is_object, picked).otherwise(txt.strip(F.coalesce(as_text, F.lit(""))))


def quality_gate(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable pages, and the rejects with the reason."""
    texted = outputs.withColumn("markdown_text", result_markdown(F.col("result")))
    failed = F.col("status") == "error"
    usable = txt.is_usable_text(F.col("markdown_text"))
    good = texted.filter(~failed & usable)
    bad = texted.filter(failed | ~usable)
    rejects = bad.withColumns(
        {
            "error_type": F.when(failed, F.col("error_type")).otherwise(F.lit("UnusableMarkdown")),
            "error": F.when(failed, F.col("error")).otherwise(F.lit("The reader returned unusable page Markdown.")),
        }
    )
    return good, rejects


def generator_outcomes(outputs: DataFrame) -> DataFrame:
    """Outcome per file and generator, from page rows with a ``usable`` flag.

    A row without page number stands for a generator that failed as a whole.
    """
    whole = F.col("page_no").isNull()
    counted = outputs.groupBy("file_hash", "markdown_engine").agg(
        F.count("page_no").alias("expected_pages"),
        F.count(F.when(F.col("usable") & ~whole, 1)).alias("page_count"),
        F.count(F.when(~F.col("usable"), 1)).alias("error_count"),
        F.bool_or(whole & ~F.col("usable")).alias("_crashed"),
        F.max(F.when(whole, F.col("error"))).alias("_message"),
    )
    status = F.when(F.col("_crashed"), "error").when(F.col("error_count") == 0, "ok").otherwise("partial")
    failed = F.concat(F.col("error_count").cast("string"), F.lit(" page(s) failed"))
    error = F.when(F.col("_crashed"), F.col("_message")).when(F.col("error_count") > 0, failed)
    return counted.withColumn("status", status).withColumn("error", error).drop("_crashed", "_message")


def merge_summaries(outcomes: DataFrame) -> DataFrame:
    """Per file over its generators; errors do not count once one generator is complete."""
    merged = outcomes.groupBy("file_hash").agg(
        F.sum("page_count").alias("page_count"),
        F.sum("error_count").alias("_errors"),
        F.bool_or((F.col("page_count") > 0) & (F.col("error_count") == 0)).alias("_complete"),
    )
    return merged.select(
        "file_hash", "page_count", F.when(F.col("_complete"), F.lit(0)).otherwise(F.col("_errors")).alias("error_count")
    )


def combined_page_text(page_outputs: DataFrame) -> DataFrame:
    """Per-page reader texts joined into one document with page comments."""
    body = txt.strip(F.coalesce("text", F.lit("")))
    marked = page_outputs.withColumn(
        "_marked", F.when(body != "", F.concat(F.lit("<!-- page "), F.col("page_no").cast("string"), F.lit(" -->\n"), body))
    )
    return ordered_concat(marked, ["file_hash"], "page_no", "_marked", "\n\n", "text")
