"""Reader JSON, regions, boxes and page Markdown over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import boxes, ids, kinds
from folioscope.functions import text as txt
from folioscope.functions.grouping import grouped_median
from folioscope.operators import alignment, chunks, combined, documents, overlays
from folioscope.operators import elements as el
from folioscope.operators import markdown as md
from folioscope.operators import regions as rg
from folioscope.plans import roles
from folioscope.plans.registry import query, view
from folioscope.session import cut_lineage
from folioscope.sources.keyed import stage_table


def layouts(spark: SparkSession, sf: str) -> DataFrame:
    return el.parse_layout(roles.reader_output(spark, sf))


def document_elements(spark: SparkSession, sf: str) -> DataFrame:
    return el.layout_elements(layouts(spark, sf))


def flat_box(box: str = "raw_bbox") -> list[Column]:
    return [F.round(f"{box}.{side}", 4).alias(side[0]) for side in boxes.SIDES]


BOX_SQL = "round(l, 4) AS l, round(t, 4) AS t, round(r, 4) AS r, round(b, 4) AS b"


# --- elements and pages ------------------------------------------------------


@query("text_elements", f"SELECT file_hash, source_ref, label, text, CAST(page_no AS INTEGER) AS page_no, {BOX_SQL} FROM reader_texts")
def text_elements(spark: SparkSession, sf: str) -> DataFrame:
    return el.text_elements(layouts(spark, sf)).select("file_hash", "source_ref", "label", "text", "page_no", *flat_box())


@query(
    "table_elements",
    f"""
    SELECT file_hash, source_ref, parent_ref, label, text, context_text, CAST(page_no AS INTEGER) AS page_no, {BOX_SQL}
    FROM elements WHERE label IN ('table', 'table_cell')
    """,
)
def table_elements(spark: SparkSession, sf: str) -> DataFrame:
    return el.table_elements(layouts(spark, sf)).select(
        "file_hash", "source_ref", "parent_ref", "label", "text", "context_text", "page_no", *flat_box()
    )


@query("table_row_text", "SELECT file_hash, CAST(row_no AS INTEGER) AS row_no, row_text FROM reader_rows")
def table_row_text(spark: SparkSession, sf: str) -> DataFrame:
    tables = el.table_elements(layouts(spark, sf)).filter("label = 'table_cell'")
    numbered = tables.withColumn("cell_no", F.regexp_extract("source_ref", r"(\d+)$", 1).cast("int"))
    table_no = F.regexp_extract("source_ref", r"^#/tables/(\d+)", 1).cast("int")
    cells = numbered.select("file_hash", table_no.alias("table_no"), F.floor(F.col("cell_no") / 4).cast("int").alias("row_no"), "cell_no", "text")
    return el.table_rows(cells).select("file_hash", "row_no", "row_text")


@query("layout_pages", "SELECT file_hash, CAST(page_no AS INTEGER) AS page_no, width, CAST(height AS DOUBLE) AS height FROM (SELECT file_hash, page_no, CAST(width AS DOUBLE) AS width, height FROM reader_pages)")
def layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    return el.layout_pages(layouts(spark, sf))


def linked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Four text items per chunk and the tables of the pages that begin there; one more chunk names a picture no element stands for."""
    lines = F.split("text", "\n")
    source = roles.dealt_texts(spark, sf).select("file_hash", "text", F.size(lines).alias("n"))
    slots = source.select("file_hash", "text", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int") + 1)).alias("chunk_index"))
    slot = F.col("chunk_index")
    box = roles._json_box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(1.0))
    prov = F.array(F.struct(F.lit(1).alias("page_no"), box.alias("bbox")))
    item = lambda ref: F.struct(ref.alias("self_ref"), F.lit("text").alias("label"), prov.alias("prov"))
    numbers = F.sequence(slot * 4, F.greatest(slot * 4, F.least(slot * 4 + 3, F.col("n") - 1)))
    refs = F.transform(numbers, lambda i: item(F.concat(F.lit("#/texts/"), i.cast("string"))))
    picture = F.array(item(F.lit("#/pictures/0")))
    begins = F.filter(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10).cast("int")), lambda p: F.floor(p * 10 / 4) == slot)
    tables = F.transform(begins, lambda p: item(F.concat(F.lit("#/tables/"), p.cast("string"))))
    items = F.when(slot * 4 >= F.col("n"), picture).otherwise(F.concat(refs, tables))
    meta = F.to_json(F.struct(F.struct(items.alias("doc_items")).alias("docling_meta")))
    return slots.select(ids.chunk_id(F.col("file_hash"), slot).alias("chunk_id"), "file_hash", "chunk_index", "text", meta.alias("metadata_json"))


view(
    "evidence",
    """
    SELECT file_hash, i // 4 AS chunk_index, source_ref, page_no, l, t, r, b, label, text FROM reader_texts
    UNION ALL SELECT file_hash, CAST(split_part(parent_ref, '/', 3) AS INTEGER) * 10 // 4, source_ref, page_no, l, t, r, b, label, text FROM elements WHERE parent_ref LIKE '#/tables/%'
    """,
)
view("linked_slots", "SELECT file_hash, unnest(range(max(i) // 4 + 2)) AS chunk_index FROM doc_lines GROUP BY file_hash")


@query("chunk_evidence", "SELECT file_hash, CAST(chunk_index AS INTEGER) AS chunk_index, source_ref, CAST(page_no AS INTEGER) AS page_no, text FROM evidence")
def chunk_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = el.item_evidence(linked_chunks(spark, sf), document_elements(spark, sf))
    return found.select("file_hash", "chunk_index", "source_ref", "page_no", "text")


@query(
    "chunk_evidence_fallback",
    """
    SELECT s.file_hash, CAST(s.chunk_index AS INTEGER) AS chunk_index, CAST(count(*) AS BIGINT) AS n_places FROM linked_slots s
    JOIN (SELECT file_hash, i // 4 AS chunk_index FROM doc_lines UNION ALL SELECT file_hash, max(i) // 4 + 1 FROM doc_lines GROUP BY file_hash) d
      ON d.file_hash = s.file_hash AND d.chunk_index = s.chunk_index
    WHERE (s.file_hash, s.chunk_index) NOT IN (SELECT (file_hash, chunk_index) FROM evidence) GROUP BY 1, 2
    """,
)
def chunk_evidence_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose items no element stands for: the items' own places serve."""
    chunk_rows = linked_chunks(spark, sf)
    found = el.chunk_evidence(chunk_rows, document_elements(spark, sf))
    own = found.filter(F.contains("source_ref", F.lit(":prov:")) & ~F.startswith("source_ref", F.lit("#/tables")))
    return own.groupBy("file_hash", "chunk_index").agg(F.count("*").alias("n_places"))


@query(
    "page_provider_evidence",
    """
    SELECT chunk, source_ref, label, text, page_no, l FROM (
      SELECT file_hash || ':' || turn AS chunk, 'mistral-element-' || i AS source_ref, 'mistral_ocr_element' AS label, trim(line) AS text, CAST(page_no AS INTEGER) AS page_no, CAST(i AS DOUBLE) AS l
      FROM (SELECT file_hash, turn, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM turns WHERE turn % 3 = 0) WHERE trim(line) <> ''
      UNION ALL
      SELECT file_hash || ':' || turn, 'mistral-page-' || page_no, 'mistral_ocr_page', NULL, CAST(page_no AS INTEGER), 5.0 FROM turns WHERE turn % 3 = 1)
    """,
)
def page_provider_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence from the metadata of the page-level provider: its elements, its pages where it has none, nothing beside items."""
    page = F.col("page_no")
    box = lambda left: roles._json_box(left, F.lit(2.0), F.lit(9.0), F.lit(1.0))
    line = lambda text, i: F.struct(text.alias("text"), page.alias("page_no"), box(i.cast("double")).alias("bbox"))
    made = F.to_json(F.struct(F.transform(F.split("text", "\n"), line).alias("mistral_elements"), F.array(F.struct(page.alias("page_no"), box(F.lit(7.0)).alias("bbox"))).alias("mistral_pages")))
    paged = F.to_json(F.struct(F.array(F.struct(page.alias("page_no"), box(F.lit(5.0)).alias("bbox"))).alias("mistral_pages")))
    itemed = F.to_json(F.struct(F.struct(F.array().cast("array<string>").alias("doc_items")).alias("docling_meta"), F.array(F.struct(page.alias("page_no"), box(F.lit(5.0)).alias("bbox"))).alias("mistral_pages")))
    turn = F.col("turn")
    chunk = F.concat_ws(":", "file_hash", turn.cast("string"))
    metadata = F.when(turn % 3 == 0, made).when(turn % 3 == 1, paged).otherwise(itemed)
    chunk_rows = roles.turns(spark, sf).select("file_hash", chunk.alias("chunk_id"), turn.cast("int").alias("chunk_index"), "text", metadata.alias("metadata_json"))
    found = el.page_item_fallback(chunk_rows)
    text = F.when(F.col("label") == "mistral_ocr_element", F.col("text"))
    return found.select(F.col("chunk_id").alias("chunk"), "source_ref", "label", text.alias("text"), "page_no", F.col("raw_bbox.left").alias("l"))


REGION_SQL = f"""
    SELECT substring(sha256(concat_ws('|', e.file_hash, 'docling', e.source_ref, e.page_no, CAST(e.l * 1000 AS BIGINT), CAST(e.t * 1000 AS BIGINT), CAST(e.r * 1000 AS BIGINT), CAST(e.b * 1000 AS BIGINT))), 1, 32) AS region_id,
           e.file_hash, e.source_ref, CAST(e.page_no AS INTEGER) AS page_no, CAST(v.chunk_index AS INTEGER) AS chunk_index,
           CASE WHEN e.label = 'table_cell' THEN 'table_cell' WHEN e.label = 'table' THEN 'table' WHEN e.label = 'list_item' THEN 'list' WHEN e.label = 'section_header' THEN 'header'
                WHEN e.label = 'page_footer' THEN 'footer' ELSE 'text' END AS region_kind
    FROM elements e JOIN reader_pages p ON p.file_hash = e.file_hash AND p.page_no = e.page_no
    LEFT JOIN (SELECT file_hash, source_ref, max(chunk_index) AS chunk_index FROM evidence GROUP BY 1, 2) v ON v.file_hash = e.file_hash AND v.source_ref = e.source_ref
"""
view("layout_region_rows", REGION_SQL)


def layout_regions_of(spark: SparkSession, sf: str) -> DataFrame:
    parsed = layouts(spark, sf)
    elements = el.layout_elements(parsed)
    evidence = el.item_evidence(linked_chunks(spark, sf), elements)
    # Pages are few and wanted twice; made again, the reader output would be read again for them.
    return rg.layout_regions(elements, cut_lineage(el.layout_pages(parsed)), evidence)


@query("layout_regions", "SELECT * FROM layout_region_rows")
def layout_regions(spark: SparkSession, sf: str) -> DataFrame:
    return layout_regions_of(spark, sf).select("region_id", "file_hash", "source_ref", "page_no", "chunk_index", "region_kind")


# --- content lists and page layouts ------------------------------------------

view(
    "content_items",
    """
    SELECT file_hash, turn, i, text, page_no, 100.0 + i AS x0, 20.0 * i AS y0, 500.0 + i AS x1, 20.0 * i + 15 AS y1,
           CASE i % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'interline_equation' WHEN 2 THEN 'table_footnote' WHEN 3 THEN 'text' ELSE 'page_number' END AS kind
    FROM (SELECT file_hash, turn, page_no, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM turns)
    """,
)


def _content_item(line: Column, i: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("title", "interline_equation", "table_footnote", "text", "page_number")])
    corners = [F.lit(100.0) + i, F.lit(20.0) * i, F.lit(500.0) + i, F.lit(20.0) * i + 15]
    return F.struct(F.element_at(names, (i % 5 + 1).cast("int")).alias("type"), line.alias("text"), F.array(*corners).alias("bbox"), F.lit(0).alias("page_idx"))


def content_output(spark: SparkSession, sf: str, *, listed: bool = True) -> DataFrame:
    """Each turn as a one-page file of the content-list reader."""
    items = F.transform(F.split("text", "\n"), _content_item)
    page = F.struct(F.lit(0).alias("page_idx"), F.array(F.lit(1000.0), F.lit(2000.0)).alias("page_size"), items.alias("para_blocks"))
    middle = F.struct(F.array(page).alias("pdf_info"))
    fields = [F.lit("pipeline").alias("backend"), middle.alias("middle_json")]
    if listed:
        fields.append(items.alias("content_list"))
    key = F.concat_ws(":", "file_hash", F.col("turn").cast("string"))
    return roles.turns(spark, sf).select(key.alias("file_hash"), F.to_json(F.struct(*fields)).alias("output_json"))


CONTENT_KIND_SQL = "CASE kind WHEN 'title' THEN 'title' WHEN 'interline_equation' THEN 'formula' WHEN 'table_footnote' THEN 'table' WHEN 'page_number' THEN 'page_number' ELSE 'text' END"


@query(
    "display_boxes",
    """
    SELECT file_hash || ':' || turn AS file_hash, CAST(i AS INTEGER) AS i, CAST(CASE turn % 3 WHEN 0 THEN x0 * 0.6 ELSE 1.0 END AS DOUBLE) AS l, CAST(CASE turn % 3 WHEN 0 THEN y0 * 0.4 ELSE 2.0 END AS DOUBLE) AS t,
      CAST(CASE turn % 3 WHEN 0 THEN x1 * 0.6 ELSE 3.0 END AS DOUBLE) AS r, CAST(CASE turn % 3 WHEN 0 THEN y1 * 0.4 ELSE 4.0 END AS DOUBLE) AS b
    FROM content_items
    """,
)
def display_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes drawn again from the stored reader item: scaled to the page shown, else as stored (no known source, no known size)."""
    lines = roles.turns(spark, sf).select("file_hash", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i, third = F.col("i"), F.col("turn") % 3
    item = boxes.make_box(F.lit(100.0) + i, F.lit(20.0) * i, F.lit(500.0) + i, F.lit(20.0) * i + 15, boxes.TOP_LEFT)
    stored = boxes.make_box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), boxes.TOP_LEFT)
    shown = boxes.display_box(F.when(third != 1, F.lit("middle_json")), item, stored, F.when(third == 0, F.lit(1000.0)), F.lit(2000.0), F.lit(600.0), F.lit(800.0))
    rows = lines.select(F.concat_ws(":", "file_hash", F.col("turn").cast("string")).alias("file_hash"), "i", shown.alias("box"))
    return rows.select("file_hash", "i", *flat_box("box"))


@query(
    "content_regions",
    f"""
    SELECT file_hash || ':' || turn AS file_hash, 'mineru:content:' || i AS source_ref, kind AS label, {CONTENT_KIND_SQL} AS region_kind,
           CASE WHEN trim(text) = '' THEN kind ELSE text END AS text, round(x0 / 1000 * 1000, 4) AS l, round(y0 / 1000 * 2000, 4) AS t, round(x1 / 1000 * 1000, 4) AS r, round(y1 / 1000 * 2000, 4) AS b
    FROM content_items
    """,
)
def content_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = rg.content_regions(content_output(spark, sf))
    return rows.select("file_hash", "source_ref", "label", "region_kind", "text", *flat_box())


@query(
    "content_regions_from_pages",
    f"""
    SELECT file_hash || ':' || turn AS file_hash, 'mineru:middle:1:' || i AS source_ref, {CONTENT_KIND_SQL} AS region_kind, round(x0, 4) AS l, round(y0, 4) AS t, round(x1, 4) AS r, round(y1, 4) AS b
    FROM content_items
    """,
)
def content_regions_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same reader without a content list: boxed objects of its page records."""
    rows = rg.content_regions(content_output(spark, sf, listed=False))
    return rows.select("file_hash", "source_ref", "region_kind", *flat_box())


@query(
    "content_pages",
    "SELECT file_hash || ':' || turn AS file_hash, CAST(1 AS INTEGER) AS page_no, CAST(1000.0 AS DOUBLE) AS width, CAST(2000.0 AS DOUBLE) AS height FROM turns",
)
def content_pages(spark: SparkSession, sf: str) -> DataFrame:
    return el.content_pages(content_output(spark, sf))


def layout_page_output(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a one-page file of the page-layout reader; pages of the system role failed."""

    def item(line: Column, i: Column) -> Column:
        names = F.array(*[F.lit(x) for x in ("Title", "figure_caption", "table_footnote", "text", "sidebar")])
        corners = [F.lit(0.1) + i / 1000, i / 100, F.lit(0.5) + i / 1000, (i + 1) / 100]
        return F.struct(F.element_at(names, (i % 5 + 1).cast("int")).alias("category"), F.array(*corners).alias("bbox"), line.alias("text"))

    items = F.transform(F.split("text", "\n"), item)
    page = F.struct(
        (F.col("turn") + 1).alias("page_no"), F.lit(800).alias("width"), F.lit(1000).alias("height"),
        F.when(F.col("role") == "system", "error").otherwise("ok").alias("status"),
        (F.col("turn") / 4).alias("elapsed_seconds"),
        F.struct(items.alias("elements")).alias("result"),
    )
    key = F.concat_ws(":", "file_hash", F.col("turn").cast("string"))
    output = F.to_json(F.struct(F.lit("parser-2").alias("model"), F.array(page).alias("pages")))
    return roles.turns(spark, sf).select(key.alias("file_hash"), "role", "text", output.alias("output_json"))


@query(
    "page_layout_regions",
    """
    SELECT file_hash || ':' || turn AS file_hash, page_no, 'infinity:page:' || page_no || ':region:' || i AS source_ref,
           CASE i % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'footnote' WHEN 3 THEN 'text' ELSE 'other' END AS region_kind,
           round((0.1::DOUBLE + i / 1000.0::DOUBLE) * 800, 4) AS l, round(i / 100.0::DOUBLE * 1000, 4) AS t, round((0.5::DOUBLE + i / 1000.0::DOUBLE) * 800, 4) AS r, round((i + 1) / 100.0::DOUBLE * 1000, 4) AS b
    FROM content_items WHERE (file_hash, turn) IN (SELECT (file_hash, turn) FROM turns WHERE role <> 'system')
    """,
)
def page_layout_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = rg.layout_page_regions(layout_page_output(spark, sf))
    return rows.select("file_hash", F.col("page_no").cast("long").alias("page_no"), "source_ref", "region_kind", *flat_box())


@query(
    "document_pages",
    """
    SELECT file_hash || ':' || turn AS file_hash, CASE WHEN role = 'user' THEN 1 ELSE page_no END AS page_no, CASE WHEN role = 'user' THEN 1000.0 ELSE 800.0 END::DOUBLE AS width, CAST(CASE WHEN role = 'user' THEN 1 ELSE 2 END AS INTEGER) AS source_rank
    FROM turns
    """,
)
def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Content-list sizes where the role is user, page-layout sizes elsewhere."""
    own = roles.turns(spark, sf).filter("role = 'user'").select(F.concat_ws(":", "file_hash", F.col("turn").cast("string")).alias("file_hash"))
    content = el.content_pages(content_output(spark, sf).join(own, "file_hash", "left_semi"))
    by_page = el.layout_reader_pages(layout_page_output(spark, sf))
    pages = el.document_pages([content.limit(0), content, by_page])
    return pages.select("file_hash", F.col("page_no").cast("long").alias("page_no"), "width", "source_rank")


@query(
    "result_plain_text",
    "SELECT file_hash || ':' || turn AS file_hash, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5 FROM (SELECT file_hash, turn, i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM content_items) WHERE t <> '' GROUP BY 1",
)
def result_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout_page_output(spark, sf)
    page = F.try_variant_get(F.try_parse_json("output_json"), "$.pages[0].result", "variant")
    return rows.select("file_hash", F.md5(el.result_text(F.to_json(page))).alias("text_md5"))


# --- comparison of readers ---------------------------------------------------


@query(
    "region_stats",
    "SELECT file_hash, coalesce(annotation_engine, 'docling') AS annotation_engine, CAST(count(*) AS BIGINT) AS region_count, CAST(count(DISTINCT page_no) AS BIGINT) AS region_pages FROM region_rows GROUP BY 1, 2",
)
def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    return documents.region_stats(roles.regions(spark, sf))


def comparison_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Reader rows per conversation turn: user turns by the page-layout reader, others by the content list."""
    return layout_page_output(spark, sf).select(
        "file_hash", F.lit("infinity").alias("annotation_engine"),
        F.when(F.col("role") == "system", "error").otherwise("ok").alias("status"), F.when(F.col("role") == "system", " no \n page ").alias("error"),
        F.lit("p").alias("reader_provider"), F.lit("m").alias("reader_model"), "text", "output_json",
    )


@query(
    "comparison_report",
    """
    SELECT file_hash || ':' || turn AS file_hash, engine || chr(9) || CASE WHEN engine = 'mineru' THEN '-' WHEN role = 'system' THEN 'error' ELSE 'ok' END || chr(9)
           || CASE WHEN engine = 'infinity' THEN 0 ELSE n END || chr(9) || 1 || chr(9) || CASE WHEN engine = 'infinity' THEN length(text) ELSE 0 END || chr(9) || '-' || chr(9)
           || CASE WHEN engine = 'infinity' THEN printf('%.2f', turn / 4.0) ELSE '-' END || chr(9) || '-' || chr(9) || CASE WHEN engine = 'infinity' AND role = 'system' THEN 'no page' ELSE '-' END AS line
    FROM (SELECT t.*, c.n, unnest(['infinity', 'mineru']) AS engine FROM turns t JOIN (SELECT file_hash, turn, count(*) AS n FROM content_items GROUP BY 1, 2) c USING (file_hash, turn))
    """,
)
def comparison_report(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows of one reader beside regions of another, as report lines."""
    regions = rg.content_regions(content_output(spark, sf))
    report = documents.comparison_report(comparison_inputs(spark, sf), regions)
    return documents.report_lines(report).select("file_hash", "line")


# --- boxes -------------------------------------------------------------------

SCALED = "CASE WHEN greatest(abs(l), abs(t), abs(r), abs(b)) <= 1 THEN {0} * {1} WHEN greatest(abs(l), abs(t), abs(r), abs(b)) <= 1000 THEN {0} / 1000 * {1} ELSE {0} END"


@query(
    "box_autoscale",
    f"""
    SELECT l_orderkey, l_linenumber, round(sum({SCALED.format('l', 'width')}), 4) AS l, round(sum({SCALED.format('t', 'height')}), 4) AS t,
           round(sum({SCALED.format('r', 'width')}), 4) AS r, round(sum({SCALED.format('b', 'height')}), 4) AS b, CAST(count(CASE WHEN r > l AND b > t THEN 1 END) AS BIGINT) AS proper
    FROM box_rows GROUP BY 1, 2
    """,
)
def box_autoscale(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.box_rows(spark, sf)
    loose = boxes.autoscale(F.col("box"), F.col("width"), F.col("height"))
    strict = boxes.autoscale_strict(F.col("box"), F.col("width"), F.col("height"))
    scaled = rows.withColumns({"raw_bbox": loose, "strict": strict})
    sums = [F.round(F.sum(f"raw_bbox.{side}"), 4).alias(side[0]) for side in boxes.SIDES]
    return scaled.groupBy("l_orderkey", "l_linenumber").agg(*sums, F.count("strict").alias("proper"))


@query(
    "box_rescale",
    """
    SELECT l_orderkey, l_linenumber, round(sum(l * (612 / width)), 4) AS l, round(sum(t * (792 / height)), 4) AS t, round(sum(r * (612 / width)), 4) AS r, round(sum(b * (792 / height)), 4) AS b
    FROM box_rows GROUP BY 1, 2
    """,
)
def box_rescale(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.box_rows(spark, sf)
    moved = boxes.rescale(F.col("box"), F.col("width"), F.col("height"), F.lit(612.0), F.lit(792.0))
    sums = [F.round(F.sum(moved[side]), 4).alias(side[0]) for side in boxes.SIDES]
    return rows.groupBy("l_orderkey", "l_linenumber").agg(*sums)


@query(
    "box_percent",
    """
    SELECT l_orderkey, l_linenumber, degrees, CAST(count(*) AS BIGINT) AS n, round(sum(greatest(0, least(100, rl / pw * 100))), 3) AS left_pct, round(sum(greatest(0, least(100, rt / ph * 100))), 3) AS top_pct,
           round(sum(greatest(0, least(100, rw / pw * 100))), 3) AS width_pct, round(sum(greatest(0, least(100, rh / ph * 100))), 3) AS height_pct
    FROM (SELECT *, CASE degrees WHEN 90 THEN height - y - h WHEN 180 THEN width - x - w WHEN 270 THEN y ELSE x END AS rl, CASE degrees WHEN 90 THEN x WHEN 180 THEN height - y - h WHEN 270 THEN width - x - w ELSE y END AS rt,
                 CASE WHEN degrees IN (90, 270) THEN h ELSE w END AS rw, CASE WHEN degrees IN (90, 270) THEN w ELSE h END AS rh,
                 CASE WHEN degrees IN (90, 270) THEN height ELSE width END AS pw, CASE WHEN degrees IN (90, 270) THEN width ELSE height END AS ph
          FROM (SELECT *, least(l, r) AS x, height - greatest(t, b) AS y, abs(r - l) AS w, abs(t - b) AS h, CAST((l_linenumber % 4) * 90 AS INTEGER) AS degrees FROM box_rows))
    GROUP BY 1, 2, 3
    """,
)
def box_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Bottom-left boxes as percentages of pages turned by a multiple of 90 degrees."""
    rows = roles.box_rows(spark, sf).withColumn("degrees", (F.col("l_linenumber") % 4 * 90).cast("int"))
    box = F.col("box").withField("coord_origin", F.lit(boxes.BOTTOM_LEFT))
    swaps = F.col("degrees").isin(90, 270)
    page_width = F.when(swaps, F.col("height")).otherwise(F.col("width"))
    page_height = F.when(swaps, F.col("width")).otherwise(F.col("height"))
    percent = boxes.normalize(
        box, page_width, page_height, source_width=F.col("width"), source_height=F.col("height"), degrees=F.col("degrees")
    )
    sums = [F.round(F.sum(percent[name]), 3).alias(name) for name in ("left_pct", "top_pct", "width_pct", "height_pct")]
    return rows.groupBy("l_orderkey", "l_linenumber", "degrees").agg(F.count("*").alias("n"), *sums)


@query(
    "box_union",
    "SELECT l_orderkey, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, round(max(sqrt(((l + r) / 2 - 100) ** 2 + ((t + b) / 2 - 50) ** 2)), 4) AS farthest, CAST(count(CASE WHEN b >= 42 AND t <= 68 THEN 1 END) AS BIGINT) AS in_band FROM box_rows GROUP BY 1",
)
def box_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.box_rows(spark, sf)
    point = boxes.make_box(F.lit(100.0), F.lit(50.0), F.lit(100.0), F.lit(50.0))
    band = boxes.make_box(F.lit(0.0), F.lit(50.0), F.lit(0.0), F.lit(60.0))
    grouped = rows.groupBy("l_orderkey").agg(
        boxes.union_box(F.col("box")).alias("u"),
        F.round(F.max(boxes.center_distance(F.col("box"), point)), 4).alias("farthest"),
        F.count(F.when(boxes.vertical_overlap(F.col("box"), band), 1)).alias("in_band"),
    )
    return grouped.select("l_orderkey", *[F.col(f"u.{side}").alias(side[0]) for side in boxes.SIDES], "farthest", "in_band")


view(
    "tall_boxes",
    """
    SELECT 'supplier-' || l_suppkey AS file_hash, l_linenumber AS page_no, l_quantity * 10 AS l, 10 + l_discount * 200 AS w, 15 + l_tax * 1000 AS h, 700 - l_tax * 100 AS top, p_name AS text
    FROM lineitem JOIN part ON p_partkey = l_partkey
    """,
)


def tall_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as text boxes, one page per supplier and line number."""
    items = roles.table(spark, sf, "lineitem").join(roles.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    left, width = F.col("l_quantity") * 10, F.lit(10) + F.col("l_discount") * 200
    height, top = F.lit(15) + F.col("l_tax") * 1000, F.lit(700) - F.col("l_tax") * 100
    return items.select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("file_hash"),
        F.col("l_linenumber").alias("page_no"),
        F.lit("docling").alias("annotation_engine"),
        F.lit("text").alias("region_kind"),
        F.col("p_name").alias("text"),
        boxes.make_box(left, top, left + width, top - height, boxes.BOTTOM_LEFT).alias("raw_bbox"),
    )


@query(
    "sideways_pages",
    """
    SELECT file_hash, page_no, CAST(CASE WHEN x >= 0.55 THEN 90 ELSE 270 END AS INTEGER) AS clockwise_degrees, eligible_box_count, vertical_box_count, round(least(0.9, 0.55 + 0.35 * vertical_box_count / eligible_box_count), 4) AS confidence, round(x, 4) AS median_x_pct
    FROM (SELECT file_hash, page_no, CAST(count(*) AS BIGINT) AS eligible_box_count, CAST(count(*) FILTER (WHERE vertical) AS BIGINT) AS vertical_box_count, median(xc) FILTER (WHERE vertical) / 500.0 AS x
          FROM (SELECT file_hash, page_no, least(l, l + w) + abs((l + w) - l) / 2 AS xc, abs(top - (top - h)) / abs((l + w) - l) >= 2 AS vertical FROM tall_boxes WHERE length(trim(text)) >= 8) GROUP BY 1, 2)
    WHERE vertical_box_count >= 3 AND vertical_box_count >= 0.4 * eligible_box_count AND (x >= 0.55 OR x <= 0.45)
    """,
)
def sideways_pages(spark: SparkSession, sf: str) -> DataFrame:
    regions = tall_regions(spark, sf)
    pages = regions.select("file_hash", "page_no").distinct().withColumns({"width": F.lit(500.0), "height": F.lit(800.0)})
    found = overlays.sideways_pages(regions, pages)
    return found.select(
        "file_hash", "page_no", "clockwise_degrees", "eligible_box_count", "vertical_box_count",
        F.round("confidence", 4).alias("confidence"), F.round("median_x_pct", 4).alias("median_x_pct"),
    )


@query("grouped_median", "SELECT l_suppkey, median(l_extendedprice) AS median_price FROM lineitem GROUP BY l_suppkey")
def grouped_median_query(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_median(roles.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 500.0, "median_price")


# --- overlays ----------------------------------------------------------------

STYLE_SQL = "CASE {kind} WHEN 'text' THEN '#d55344' WHEN 'title' THEN '#b85bd4' WHEN 'table' THEN '#35a36b' WHEN 'table_cell' THEN '#60b878' WHEN 'list' THEN '#d37b2d' WHEN 'header' THEN '#9aa4b2' WHEN 'footer' THEN '#9aa4b2' END"


def stored_styles(spark: SparkSession) -> DataFrame:
    """Two stored styles: one for a label, one for a kind (with untidy keys)."""
    fields = "annotation_engine string, region_kind string, label string, stroke_color string, fill_color string, stroke_opacity double, fill_opacity double, stroke_width double"
    rows = [("Docling ", "text", "text", "#ABCDEF", "nocolor", 2.0, -1.0, 99.0), ("mineru", " list", "", "#111111", "#222222", 0.5, 0.5, 0.0)]
    return spark.createDataFrame(rows, fields)


@query(
    "region_overlays",
    """
    SELECT 'region:' || g.region_id AS overlay_id, coalesce(annotation_engine, 'docling') AS engine, h.hidden IS NOT NULL AS hidden,
           CASE WHEN label = 'text' AND coalesce(annotation_engine, 'docling') = 'docling' THEN '#abcdef' WHEN label = 'list_item' AND annotation_engine = 'mineru' THEN '#111111'
                WHEN label = 'text' THEN '#d55344' WHEN label = 'list_item' THEN '#d37b2d' ELSE '#b85bd4' END AS stroke_color,
           round(greatest(0, least(100, l / 600.0 * 100)), 3) AS left_pct, round(greatest(0, least(100, (800.0 - t) / 800.0 * 100)), 3) AS top_pct, substring(text, 1, 260) AS text_preview
    FROM region_rows g LEFT JOIN (SELECT region_id, true AS hidden FROM region_rows WHERE label = 'page_title') h USING (region_id)
    """,
)
def region_overlays(spark: SparkSession, sf: str) -> DataFrame:
    regions = roles.regions(spark, sf)
    no_item = F.struct(
        F.lit("docling_document").alias("source"), F.lit(None).cast(boxes.BOX_TYPE).alias("item_box"),
        F.lit(None).cast("struct<width:double,height:double>").alias("source_page"),
        F.lit(None).cast("struct<page_no:int,width:double,height:double>").alias("target_page"),
    )
    pages = regions.select("file_hash", "page_no").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    turned = pages.limit(0).select("file_hash", "page_no", F.lit(0).alias("clockwise_degrees"))
    hidden = regions.filter("label = 'page_title'").select("file_hash", F.concat(F.lit("region:"), "region_id").alias("overlay_id"), F.lit(True).alias("hidden"))
    styles = overlays.effective_styles(overlays.default_styles(spark), stored_styles(spark))
    drawn = overlays.region_overlays(regions.withColumn("metadata", no_item), overlays.page_geometry(pages, turned), hidden, styles)
    return drawn.select(
        "overlay_id", F.col("annotation_engine").alias("engine"), "hidden", F.col("style.stroke_color").alias("stroke_color"),
        F.round("bbox.left_pct", 3).alias("left_pct"), F.round("bbox.top_pct", 3).alias("top_pct"), "text_preview",
    )


@query(
    "overlay_list",
    """
    SELECT 'region:' || region_id AS overlay_id, CAST(row_number() OVER (PARTITION BY file_hash, page_no ORDER BY engine, turn, source_ref, region_id) AS INTEGER) AS place
    FROM (SELECT *, coalesce(annotation_engine, 'docling') AS engine FROM region_rows)
    """,
)
def overlay_list(spark: SparkSession, sf: str) -> DataFrame:
    """Overlays of each page with their place in the list."""
    rows = roles.regions(spark, sf).select("region_id", "file_hash", "page_no", kinds.engine_or_default(F.col("annotation_engine")).alias("annotation_engine"), "chunk_index", "source_ref")
    listed = rows.withColumn("overlay_id", F.concat(F.lit("region:"), "region_id"))
    place = F.row_number().over(Window.partitionBy("file_hash", "page_no").orderBy(*overlays.overlay_order()))
    return listed.select("overlay_id", place.alias("place"))


@query(
    "visible_overlays",
    "SELECT 'region:' || region_id AS overlay_id FROM region_rows WHERE label <> 'page_title' AND coalesce(annotation_engine, 'docling') <> 'mineru'",
)
def visible_overlays(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.regions(spark, sf).select(
        F.concat(F.lit("region:"), "region_id").alias("overlay_id"), kinds.engine_or_default(F.col("annotation_engine")).alias("annotation_engine"),
        (F.col("label") == "page_title").alias("hidden"),
    )
    switches = spark.createDataFrame([("mineru", False), ("docling", True)], "annotation_engine string, visible boolean")
    return overlays.visible_overlays(rows, switches).select("overlay_id")


@query(
    "page_rotation",
    "SELECT file_hash, page_no, CAST(CASE WHEN role = 'assistant' THEN (turn * 90) % 360 ELSE 0 END AS INTEGER) AS rotation_degrees, CASE WHEN role <> 'system' THEN 600.0::DOUBLE END AS stored_width FROM turns",
)
def page_rotation(spark: SparkSession, sf: str) -> DataFrame:
    pages = roles.turns(spark, sf)
    overrides = pages.filter("role = 'assistant'").select("file_hash", "page_no", (F.col("turn") * 90 - 360).alias("clockwise_degrees"))
    stored = pages.filter("role <> 'system'").select(
        "file_hash", "page_no", F.lit("normalized").alias("variant"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height")
    )
    rows = overlays.with_page_rotation(pages.select("file_hash", "page_no"), overrides, stored)
    return rows.select("file_hash", F.col("page_no").cast("long").alias("page_no"), "rotation_degrees", "stored_width")


# --- Markdown ----------------------------------------------------------------

view("combined", "SELECT file_hash, string_agg('<!-- page ' || page_no || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS text FROM turns GROUP BY file_hash")


@query("combined_page_text", "SELECT file_hash, text FROM combined")
def combined_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return md.combined_page_text(roles.turns(spark, sf))


@query("page_sections", "SELECT file_hash, page_no, trim(text, chr(10) || ' ') AS markdown_text FROM turns")
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Combined documents split again by their page markers."""
    split = md.split_page_sections(md.combined_page_text(roles.turns(spark, sf)))
    return split.withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "heading_sections",
    """
    SELECT doc_id, CAST(slot AS BIGINT) AS page_no, string_agg(t, chr(10) || chr(10) ORDER BY i) AS markdown_text
    FROM (SELECT doc_id, i, (i - 1) % 3 + 1 AS slot, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
    WHERE t <> '' GROUP BY 1, 2
    """,
)
def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every line under a page heading; headings repeat, and their sections join."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.lit("### Page "), (i % 3 + 1).cast("string"), F.lit("\n"), txt.collapse_spaces(line)),
    )
    made = roles.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_hash"), F.concat(F.lit("lead\n"), F.array_join(lines, "\n")).alias("text")
    )
    rows = md.split_page_sections(made)
    return rows.filter(F.col("markdown_text") != "").select(F.col("file_hash").alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), "markdown_text")


@query(
    "comment_pages",
    "SELECT file_hash, 1 AS page_no, 'lead text' AS page_text FROM (SELECT file_hash FROM turns GROUP BY 1 HAVING min(page_no) > 1) UNION ALL SELECT file_hash, page_no, trim(text, chr(10) || ' ') FROM turns",
)
def comment_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Lead text would be page 1, but a marked page 1 comes later and wins."""
    combined = md.combined_page_text(roles.turns(spark, sf)).withColumn("text", F.concat(F.lit("lead text "), "text"))
    return md.comment_pages(combined).withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "best_pages",
    """
    SELECT file_hash, page_no, markdown_engine AS source_engine, markdown_text FROM (
      SELECT *, row_number() OVER (PARTITION BY file_hash, page_no ORDER BY CASE markdown_engine WHEN 'infinity_markdown' THEN 0 WHEN 'markitdown' THEN 1 ELSE 2 END) AS rn
      FROM page_md WHERE length(trim(regexp_replace(markdown_text, '\\s+', ' ', 'g'))) >= 8) WHERE rn = 1
    """,
)
def best_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = md.best_pages(roles.page_markdown(spark, sf))
    return rows.select("file_hash", F.col("page_no").cast("long").alias("page_no"), "source_engine", "markdown_text")


def stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two variants per page; the normalized one is preferred."""
    variants = F.explode(F.array(F.struct(F.lit("raw").alias("v"), F.lit(1.0).alias("w")), F.struct(F.lit("normalized").alias("v"), F.lit(600.0).alias("w"))))
    rows = roles.turns(spark, sf).select("file_hash", "page_no", variants.alias("x"))
    return rows.select("file_hash", "page_no", F.col("x.v").alias("variant"), F.col("x.w").alias("page_width"), F.lit(800.0).alias("page_height"))


@query("distinct_page_sizes", "SELECT file_hash, page_no, 600.0::DOUBLE AS page_width, 800.0::DOUBLE AS page_height FROM turns")
def distinct_page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return md.distinct_page_sizes(stored_pages(spark, sf)).withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "fallback_pages",
    "SELECT file_hash, page_no, 'docling' AS source_engine, trim(text, chr(10) || ' ') AS markdown_text FROM turns",
)
def fallback_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page text from the reader row that is preferred over another one."""
    combined = md.combined_page_text(roles.turns(spark, sf))
    row = lambda engine, text: combined.select(
        "file_hash", F.lit(engine).alias("annotation_engine"), text.alias("text"), F.lit(None).cast("string").alias("output_json"),
        F.lit("ok").alias("status"), F.lit("").alias("reader_provider"), F.lit("").alias("reader_model"),
    )
    raw = row("mineru", F.lit("other")).unionByName(row("docling", F.col("text")))
    rows = md.fallback_pages(raw, stored_pages(spark, sf))
    return rows.select("file_hash", F.col("page_no").cast("long").alias("page_no"), "source_engine", "markdown_text")


@query(
    "layout_page_text",
    "SELECT file_hash, i // 10 + 1 AS page_no, string_agg(raw_line, chr(10) || chr(10) ORDER BY i) AS page_text FROM doc_lines WHERE raw_line <> '' GROUP BY 1, 2",
)
def layout_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return md.layout_page_text(layouts(spark, sf)).withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "content_page_text",
    "SELECT file_hash || ':' || turn AS file_hash, 1 AS page_no, string_agg(text, chr(10) || chr(10) ORDER BY i) AS page_text FROM content_items WHERE text <> '' GROUP BY 1",
)
def content_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return md.content_page_text(content_output(spark, sf))


@query(
    "read_markdown",
    "SELECT file_hash, page_no, md5(markdown_text) AS text_md5 FROM page_md WHERE markdown_engine = 'markitdown_cu' UNION ALL SELECT file_hash, page_no, md5(trim(text, chr(10) || ' ')) FROM turns WHERE file_hash NOT IN (SELECT file_hash FROM page_md WHERE markdown_engine = 'markitdown_cu')",
)
def read_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """One generator for all files, with the fallback for files it never reached."""
    combined = md.combined_page_text(roles.turns(spark, sf)).select(
        "file_hash", F.lit("docling").alias("annotation_engine"), "text", F.lit(None).cast("string").alias("output_json"),
        F.lit("ok").alias("status"), F.lit("").alias("reader_provider"), F.lit("").alias("reader_model"),
    )
    rows = md.read_markdown(roles.page_markdown(spark, sf), combined, stored_pages(spark, sf), "markitdown_cu")
    return rows.select("file_hash", F.col("page_no").cast("long").alias("page_no"), F.md5("markdown_text").alias("text_md5"))


view("usable_md", "SELECT file_hash, page_no, markdown_engine FROM page_md WHERE length(trim(regexp_replace(markdown_text, '\\s+', ' ', 'g'))) >= 8")


@query(
    "markdown_complete",
    """
    SELECT file_hash, markdown_engine, CAST(count(*) AS BIGINT) AS expected_pages, CAST(count(u.page_no) AS BIGINT) AS usable_pages, count(*) = count(u.page_no) AS complete
    FROM (SELECT file_hash, page_no, unnest(['infinity_markdown', 'markitdown', 'markitdown_cu']) AS markdown_engine FROM turns) e
    LEFT JOIN usable_md u USING (file_hash, page_no, markdown_engine) GROUP BY 1, 2
    """,
)
def markdown_complete(spark: SparkSession, sf: str) -> DataFrame:
    engines = F.explode(F.array(*[F.lit(name) for name in md.GENERATORS]))
    expected = roles.turns(spark, sf).select("file_hash", "page_no", engines.alias("markdown_engine"))
    return md.markdown_complete(expected, roles.page_markdown(spark, sf))


@query(
    "missing_pages",
    "SELECT file_hash, page_no, markdown_engine FROM (SELECT file_hash, page_no, unnest(['infinity_markdown', 'markitdown', 'markitdown_cu']) AS markdown_engine FROM turns) EXCEPT SELECT file_hash, page_no, markdown_engine FROM usable_md",
)
def missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    engines = F.explode(F.array(*[F.lit(name) for name in md.GENERATORS]))
    expected = roles.turns(spark, sf).select("file_hash", "page_no", engines.alias("markdown_engine"))
    return md.missing_pages(expected, roles.page_markdown(spark, sf)).withColumn("page_no", F.col("page_no").cast("long"))


@query(
    "generator_outcomes",
    """
    SELECT file_hash, markdown_engine, CAST(count(*) AS BIGINT) AS expected_pages, CAST(count(*) FILTER (WHERE usable) AS BIGINT) AS page_count, CAST(count(*) FILTER (WHERE NOT usable) AS BIGINT) AS error_count,
           CASE WHEN bool_and(usable) THEN 'ok' ELSE 'partial' END AS status
    FROM (SELECT p.*, u.page_no IS NOT NULL AS usable FROM page_md p LEFT JOIN usable_md u USING (file_hash, page_no, markdown_engine)) GROUP BY 1, 2
    """,
)
def generator_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).drop("error")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    pages = roles.page_markdown(spark, sf).withColumn("usable", txt.is_usable_text(F.col("markdown_text")))
    return md.generator_outcomes(pages.withColumn("error", F.lit(None).cast("string")))


@query(
    "markdown_summary",
    """
    SELECT file_hash, CAST(sum(good) AS BIGINT) AS page_count, CAST(CASE WHEN bool_or(good > 0 AND bad = 0) THEN 0 ELSE sum(bad) END AS BIGINT) AS error_count
    FROM (SELECT file_hash, markdown_engine, count(u.page_no) AS good, count(*) - count(u.page_no) AS bad FROM page_md p LEFT JOIN usable_md u USING (file_hash, page_no, markdown_engine) GROUP BY 1, 2) GROUP BY 1
    """,
)
def markdown_summary(spark: SparkSession, sf: str) -> DataFrame:
    return md.merge_summaries(outcomes(spark, sf))


@query(
    "generator_status",
    """
    SELECT f.file_hash, g.engine AS markdown_engine, CAST(g.pos AS INTEGER) AS position, CAST(coalesce(c.n, 0) AS BIGINT) AS page_count, o.status
    FROM conv_files f, (VALUES ('infinity_markdown', 1), ('markitdown', 2), ('markitdown_cu', 3)) g(engine, pos)
    LEFT JOIN (SELECT file_hash, markdown_engine, count(*) AS n FROM page_md GROUP BY 1, 2) c ON c.file_hash = f.file_hash AND c.markdown_engine = g.engine
    LEFT JOIN (SELECT file_hash, 'markitdown' AS engine, 'ok' AS status FROM conv_files) o ON o.file_hash = f.file_hash AND o.engine = g.engine
    UNION ALL SELECT f.file_hash, 'best_available_markdown', 0, n, 'ok' FROM conv_files f JOIN (SELECT file_hash, max(n) AS n FROM (SELECT file_hash, markdown_engine, count(*) AS n FROM page_md GROUP BY 1, 2) GROUP BY 1) USING (file_hash)
    """,
)
def generator_status(spark: SparkSession, sf: str) -> DataFrame:
    pages = roles.page_markdown(spark, sf)
    files = roles.conversation_files(spark, sf)
    counts = md.page_counts(pages).filter("markdown_engine = 'markitdown'")
    stored = counts.withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    return md.generator_status(files, pages, stored).select("file_hash", "markdown_engine", "position", F.col("page_count").cast("long").alias("page_count"), "status")


@query(
    "quality_gate",
    "SELECT file_hash, page_no, markdown_engine, CASE WHEN length(trim(regexp_replace(markdown_text, '\\s+', ' ', 'g'))) >= 8 THEN 'stored' ELSE 'UnusableMarkdown' END AS outcome FROM page_md",
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    outputs = roles.page_markdown(spark, sf).select(
        "file_hash", "page_no", "markdown_engine", F.to_json(F.struct(F.col("markdown_text").alias("markdown"))).alias("result"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error"),
    )
    good, bad = md.quality_gate(outputs)
    columns = ["file_hash", F.col("page_no").cast("long").alias("page_no"), "markdown_engine"]
    return good.select(*columns, F.lit("stored").alias("outcome")).unionByName(bad.select(*columns, F.col("error_type").alias("outcome")))


@query(
    "markdown_mappings",
    "SELECT file_hash, page_no, CAST(count(region_id) AS BIGINT) AS n_mappings FROM page_md LEFT JOIN region_rows USING (file_hash, page_no) WHERE markdown_engine = 'markitdown' GROUP BY 1, 2",
)
def markdown_mappings(spark: SparkSession, sf: str) -> DataFrame:
    pages = roles.page_markdown(spark, sf).filter("markdown_engine = 'markitdown'")
    mappings = roles.regions(spark, sf).select("file_hash", "page_no", F.lit("markitdown").alias("markdown_engine"), "region_id")
    joined = md.markdown_with_mappings(pages, mappings)
    return joined.groupBy("file_hash", F.col("page_no").cast("long").alias("page_no")).agg(F.count("region_id").alias("n_mappings"))


@query(
    "markdown_mapping_lists",
    """
    SELECT p.file_hash, p.page_no, p.markdown_engine, CAST(count(region_id) AS BIGINT) AS n_mappings,
      coalesce(string_agg('a' || i % 3 || '=' || region_id || '@' || i * 7 % 5, ' ' ORDER BY i * 7 % 5, 'a' || i % 3, region_id), '') AS listed
    FROM page_md p LEFT JOIN region_rows r ON r.file_hash = p.file_hash AND r.page_no = p.page_no AND p.markdown_engine <> 'markitdown_cu' GROUP BY 1, 2, 3
    """,
)
def markdown_mapping_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of three generators, two of them with the regions of the page mapped into their text, in order."""
    engine = F.explode(F.array(F.lit("markitdown"), F.lit("infinity_markdown"), F.lit("unheard_of"))).alias("markdown_engine")
    start = (F.col("i") * 7 % 5).alias("char_start")
    mappings = roles.regions(spark, sf).select(
        "file_hash", "page_no", engine, F.concat(F.lit("a"), (F.col("i") % 3).cast("string")).alias("anchor_id"), "region_id", start, (F.col("i") * 7 % 5 + 3).alias("char_end"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("markdown_excerpt"), F.lit("{}").alias("metadata_json"),
    )
    rows = md.markdown_with_mapping_lists(roles.page_markdown(spark, sf), mappings)
    shown = F.transform("mappings", lambda m: F.concat(m["anchor_id"], F.lit("="), m["region_id"], F.lit("@"), m["char_start"].cast("string")))
    return rows.select("file_hash", F.col("page_no").cast("long").alias("page_no"), "markdown_engine", F.size("mappings").cast("long").alias("n_mappings"), F.array_join(shown, " ").alias("listed"))


# --- combined reader output --------------------------------------------------


def page_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Each page of ten lines as the output of a reader that took it for page 1; the number also stands deep inside."""
    lines = roles.texts(spark, sf).select("file_hash", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i")
    label = F.element_at(F.array(*[F.lit(x) for x in ("section_header", "text", "list_item", "page_footer")]), (i % 4 + 1).cast("int"))
    box = roles._json_box(F.lit(40.0) + i % 7, F.lit(700.0) - 20 * (i % 10), F.lit(340.0) + i % 7, F.lit(688.0) - 20 * (i % 10))
    prov = F.array(F.struct(F.lit(1).alias("page_no"), box.alias("bbox")))
    item = F.struct(F.concat(F.lit("#/texts/"), i.cast("string")).alias("self_ref"), label.alias("label"), F.col("line").alias("text"), prov.alias("prov"))
    grouped = lines.groupBy("file_hash", (F.floor(i / 10) + 1).cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("i", item.alias("item")))).alias("items"))
    height = F.lit(800.0) + 10 * (F.col("page_no") - 1)
    size = F.when(F.col("page_no") % 2 == 1, F.struct(F.lit(600.0).alias("width"), height.alias("height")))
    record = F.create_map(F.lit("1"), F.struct(F.lit(1).alias("page_no"), size.alias("size")))
    deep = F.struct(F.lit('"page_no": 1').alias("quoted"), F.array(F.struct(F.lit(1).alias("page_no"), F.lit("page_no").alias("name"))).alias("seen"))
    output = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("texts"), record.alias("pages"), deep.alias("notes")))
    text = F.array_join(F.transform("items", lambda x: x["item"]["text"]), " ")
    return grouped.select(
        "file_hash", F.lit("scan.pdf").alias("source"), "page_no", output.alias("output_json"), text.alias("text"), F.lit(600.0).alias("page_width"), height.alias("page_height"),
        F.sha2(text.cast("binary"), 256).alias("image_sha256"),
    )


@query("combined_reader_output", f"SELECT file_hash, source_ref, label, text, CAST(page_no AS INTEGER) AS page_no, {BOX_SQL} FROM reader_texts")
def combined_reader_output(spark: SparkSession, sf: str) -> DataFrame:
    """Elements read from the combined output of single pages are those of the whole file."""
    whole = el.parse_layout(combined.combined_layout(page_outputs(spark, sf)).select("file_hash", "output_json"))
    return el.text_elements(whole).select("file_hash", "source_ref", "label", "text", "page_no", *flat_box())


@query(
    "combined_reader_pages",
    """
    SELECT file_hash, CAST(page_no AS INTEGER) AS page_no, width, CAST(height AS DOUBLE) AS height, n_pages, seen
    FROM (SELECT file_hash, page_no, CAST(width AS DOUBLE) AS width, height, CAST(count(*) OVER (PARTITION BY file_hash) AS BIGINT) AS n_pages, CAST(page_no AS VARCHAR) AS seen FROM reader_pages)
    """,
)
def combined_reader_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page sizes from the combined output, and the number as it stands deep in each page's own output."""
    whole = stage_table(combined.combined_layout(page_outputs(spark, sf)), "combined")
    sizes = el.layout_pages(el.parse_layout(whole.select("file_hash", "output_json")))
    outputs = F.from_json("output_json", "struct<normalized_page_outputs:array<struct<page_no:int,output:struct<notes:struct<seen:array<struct<page_no:string>>>>>>>")
    listed = whole.select("file_hash", outputs.alias("o")).select("file_hash", F.size("o.normalized_page_outputs").cast("long").alias("n_pages"), F.explode("o.normalized_page_outputs").alias("p"))
    deep = listed.select("file_hash", F.col("p.page_no").alias("page_no"), "n_pages", F.element_at("p.output.notes.seen", 1)["page_no"].alias("seen"))
    return sizes.join(deep, ["file_hash", "page_no"])


@query(
    "combined_content_output",
    """
    SELECT conv AS file_hash, CAST(turn + 1 AS INTEGER) AS page_no, CAST(count(*) AS BIGINT) AS n_regions, CAST(1000 + turn AS DOUBLE) AS width
    FROM (SELECT file_hash AS conv, turn, unnest(string_split(text, chr(10))) AS line FROM turns) GROUP BY conv, turn
    """,
)
def combined_content_output(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as one-page outputs of the content-list reader, combined to one row a conversation."""
    single = content_output(spark, sf).select(F.regexp_extract("file_hash", "^(.*):", 1).alias("conv"), F.regexp_extract("file_hash", r"(\d+)$", 1).cast("int").alias("turn"), "output_json")
    pages = single.select(
        F.col("conv").alias("file_hash"), F.lit("talk.pdf").alias("source"), (F.col("turn") + 1).alias("page_no"), "output_json", F.lit("").alias("text"),
        (F.lit(1000.0) + F.col("turn")).alias("page_width"), F.lit(2000.0).alias("page_height"), F.lit(None).cast("string").alias("image_sha256"),
    )
    whole = stage_table(combined.combined_content(pages, "pipeline", "auto"), "combined-content")
    regions = rg.content_regions(whole.select("file_hash", "output_json")).groupBy("file_hash", "page_no").agg(F.count("*").alias("n_regions"))
    sizes = F.from_json("output_json", "struct<middle_json:struct<pdf_info:array<struct<page_idx:int,page_size:array<double>>>>>")["middle_json"]["pdf_info"]
    widths = whole.select("file_hash", F.inline(sizes)).select("file_hash", (F.col("page_idx") + 1).alias("page_no"), F.element_at("page_size", 1).alias("width"))
    return regions.join(widths, ["file_hash", "page_no"])


# --- alignment ---------------------------------------------------------------

#: Evidence tokens of a text, in SQL.
EVIDENCE_SQL = "list_filter(list_transform(regexp_extract_all({}, '" + txt.EVIDENCE_TOKEN.replace("'", "''") + "', 1), lambda x: lower(trim(x, '._'))), lambda x: x <> '')"


view(
    "page_tokens",
    f"""
    SELECT file_hash, page_no, word, place, row_number() OVER (PARTITION BY file_hash, page_no ORDER BY place, part) AS word_no
    FROM (SELECT file_hash, page_no, place, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS part FROM (
      SELECT file_hash, page_no, place, {EVIDENCE_SQL.format("text")} AS tokens FROM (
        SELECT file_hash, page_no, unnest(words) AS text, generate_subscripts(words, 1) - 1 AS place
        FROM (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS words FROM turns))))
    """,
)
view("page_token_lists", "SELECT file_hash, page_no, list(word ORDER BY word_no) AS words FROM page_tokens GROUP BY 1, 2")
view(
    "line_places",
    f"""
    SELECT l.file_hash, l.page_no, l.source_ref, len(l.tokens) AS n, min(w.word_no) AS start
    FROM (SELECT *, {EVIDENCE_SQL.format("text")} AS tokens FROM region_rows) l
    JOIN page_tokens w ON w.file_hash = l.file_hash AND w.page_no = l.page_no AND w.word = l.tokens[1]
    JOIN page_token_lists p ON p.file_hash = l.file_hash AND p.page_no = l.page_no
    WHERE list_slice(p.words, w.word_no, w.word_no + len(l.tokens) - 1) = l.tokens GROUP BY ALL
    """,
)


@query(
    "text_alignment",
    """
    SELECT p.file_hash, CAST(p.page_no AS INTEGER) AS page_no, source_ref, 1.0::DOUBLE AS score, CAST(min(place % 12 * 50) AS DOUBLE) AS l, CAST(min(place // 12 * 14) AS DOUBLE) AS t,
      CAST(max(place % 12 * 50 + 45) AS DOUBLE) AS r, CAST(max(place // 12 * 14 + 10) AS DOUBLE) AS b
    FROM line_places p JOIN page_tokens w ON w.file_hash = p.file_hash AND w.page_no = p.page_no AND w.word_no BETWEEN start AND start + n - 1 GROUP BY 1, 2, 3
    """,
)
def text_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a turn placed among the words of that turn, each whole; worse matches are compared with brute force in the tests."""
    pages = roles.dealt_turns(spark, sf)
    words = pages.select("file_hash", "page_no", F.posexplode(F.split(txt.collapse_spaces(F.col("text")), " ")).alias("place", "text"))
    x, y = (F.col("place") % 12) * 50.0, F.floor(F.col("place") / 12) * 14.0
    tokens = words.withColumn("box", boxes.make_box(x, y, x + 45, y + 10))
    elements = roles.regions(spark, sf, pages).select(
        "file_hash", "page_no", "source_ref", "parent_ref", "label", "text", F.lit(None).cast(boxes.BOX_TYPE).alias("estimate")
    )
    found = alignment.align_elements(elements, tokens)
    return found.select("file_hash", "page_no", "source_ref", F.round("score", 4).alias("score"), *flat_box())


@query("split_packs", "SELECT file_hash, CAST(count(*) AS BIGINT) AS n_chunks FROM chunks GROUP BY file_hash")
def split_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks per file through the chunker registry."""
    made = chunks.build_chunks("chars", roles.texts(spark, sf).select("file_hash", "text"), max_chars=roles.CHUNK_CHARS, overlap_chars=roles.CHUNK_OVERLAP)
    return made.groupBy("file_hash").agg(F.count("*").alias("n_chunks"))
