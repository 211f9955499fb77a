"""Files, text functions, chunks, terms and search over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import casts, ids, kinds, spans
from folioscope.functions import text as txt
from folioscope.functions.grouping import first_per_group, lookup_join
from folioscope.operators import chunks as ck
from folioscope.operators import documents as docs
from folioscope.operators import block_index, gram_index, search, terms
from folioscope.plans import roles
from folioscope.plans.registry import query, view
from folioscope.session import cut_lineage, scratch_path
from folioscope.sources import files as corpus
from folioscope.sources import keyed, raw_layer


def seconds(column: Column) -> Column:
    return (F.unix_seconds(column) - roles.EPOCH).alias("x")


# --- sources and sinks -------------------------------------------------------


@query("file_scan", "SELECT file_hash, path, filename, extension, CAST(size_bytes AS BIGINT) AS size_bytes, extension <> '.txt' AS supported FROM sightings")
def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.sightings(spark, sf).select("file_hash", "path", "filename", "extension", "size_bytes")
    return rows.withColumn("supported", corpus.is_supported(F.col("extension")))


@query("file_upsert", "SELECT file_hash, filename, extension, CAST(size_bytes AS BIGINT) AS size_bytes, CAST(first_doc AS BIGINT) AS first_seen, CAST(last_doc AS BIGINT) AS last_seen FROM files")
def file_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return roles.files(spark, sf).select(
        "file_hash", "filename", "extension", "size_bytes",
        seconds(F.col("first_seen_at")).alias("first_seen"), seconds(F.col("last_seen_at")).alias("last_seen"),
    )


@query("duplicate_files", "SELECT file_hash, CAST(count(*) AS BIGINT) AS path_count, min(path) AS first_path FROM locations GROUP BY file_hash HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_files(roles.locations(spark, sf))


@query(
    "files_with_paths",
    "SELECT f.file_hash, filename, path FROM files f LEFT JOIN locations l ON l.file_hash = f.file_hash",
)
def files_with_paths(spark: SparkSession, sf: str) -> DataFrame:
    return roles.files(spark, sf).select("file_hash", "filename").join(roles.locations(spark, sf).select("file_hash", "path"), "file_hash", "left")


@query("newest_path", "SELECT f.file_hash, filename, path FROM files f JOIN (SELECT file_hash, arg_max(path, last_doc) AS path FROM locations GROUP BY 1) l USING (file_hash)")
def newest_path(spark: SparkSession, sf: str) -> DataFrame:
    newest = corpus.newest_path(roles.locations(spark, sf))
    return roles.files(spark, sf).select("file_hash", "filename").join(newest, "file_hash")


view(
    "readers",
    """
    SELECT s.file_hash, CASE l.toxic WHEN 1 THEN 'mineru' ELSE 'docling' END AS annotation_engine, s.doc_id AS ingest_run_id,
           CASE l.quality WHEN 1 THEN 'ok' ELSE 'error' END AS status, CASE l.quality WHEN 1 THEN s.text END AS text,
           CASE l.quality WHEN 1 THEN NULL ELSE 'unreadable ' || s.doc_id END AS error
    FROM labels l JOIN sightings s ON s.doc_id = l.doc_id
    """,
)


def reader_results(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as reader results: good quality is a good read.

    What is made of a text is made before the join, so no text goes through it unless it is asked for.
    """
    labels = roles.table(spark, sf, "labels")
    output = F.to_json(F.struct(F.length("text").alias("chars"))).alias("output_json")
    documents = roles.table(spark, sf, "documents").select("doc_id", "text", ids.content_hash(F.col("text")).alias("file_hash"), output)
    joined = lookup_join(documents, labels, ["doc_id"])
    return joined.select(
        "file_hash",
        F.when(F.col("toxic") == 1, "mineru").otherwise("docling").alias("annotation_engine"),
        F.col("doc_id").alias("ingest_run_id"),
        "text",
        "output_json",
        F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"),
        F.concat(F.lit("unreadable "), F.col("doc_id").cast("string")).alias("error"),
        F.lit("local").alias("reader_provider"),
        F.lit("m").alias("reader_model"),
    )


RAW_ROWS = """
    SELECT file_hash, annotation_engine, arg_max(status, ingest_run_id) AS status, max(ingest_run_id) AS run_id,
           arg_max(CASE WHEN text IS NULL THEN -1 ELSE length(text) END, ingest_run_id) AS chars,
           arg_max(CASE WHEN error IS NULL THEN '-' ELSE error END, ingest_run_id) AS error
    FROM readers GROUP BY file_hash, annotation_engine
"""
view("raw_rows", RAW_ROWS)


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    results = reader_results(spark, sf)
    return raw_layer.store_reader_rows(results.limit(0), results)


@query("raw_layer", "SELECT file_hash, annotation_engine, status, CAST(run_id AS BIGINT) AS run_id, CAST(chars AS BIGINT) AS chars, error FROM raw_rows")
def raw_layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return raw_rows(spark, sf).select(
        "file_hash", "annotation_engine", "status", F.col("ingest_run_id").alias("run_id"),
        F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("chars"), F.coalesce("error", F.lit("-")).alias("error"),
    )


@query(
    "keyed_upsert",
    """
    SELECT doc_id, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality, coalesce(l.src, 'base') AS src
    FROM documents LEFT JOIN (SELECT doc_id, quality, 'delta' AS src FROM labels) l USING (doc_id)
    """,
)
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = roles.table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit("base").alias("src"))
    delta = roles.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int"), F.lit("delta").alias("src"))
    return keyed.upsert(base, delta, ["doc_id"])


@query(
    "sticky_status",
    """
    SELECT user_id, CASE WHEN last_status IN ('ok', 'error', 'skipped') THEN last_status ELSE 'planned' END AS status
    FROM (SELECT user_id, arg_max(status, event_id) AS last_status FROM span_rows GROUP BY user_id)
    """,
)
def sticky_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit is planned again; those that ended keep their status."""
    log = roles.spans(spark, sf)
    base = log.groupBy("user_id").agg(F.max_by("status", "event_id").alias("status"))
    delta = log.select("user_id", F.lit("planned").alias("status")).distinct()
    return keyed.upsert_keep_terminal(base, delta, ["user_id"])


@query(
    "slice_replace",
    """
    SELECT doc_id, source, 'old' AS origin FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    UNION ALL SELECT doc_id, source, 'new' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
    """,
)
def slice_replace(spark: SparkSession, sf: str) -> DataFrame:
    base = roles.table(spark, sf, "documents").select("doc_id", "source", F.lit("old").alias("origin"))
    flagged = roles.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    fresh = base.join(flagged, "doc_id").withColumn("origin", F.lit("new"))
    return keyed.replace_slice(base, fresh, fresh, ["source"])


@query("tolerant_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS bad FROM events")
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    """Good JSON is read; text that is no JSON object becomes an empty one."""
    events = roles.table(spark, sf, "events")
    good = casts.json_object(F.col("props"))
    bad = casts.json_object(F.concat(F.lit("["), "props"))
    return events.select("event_id", F.try_variant_get(good, "$.k", "int").alias("k"), F.try_variant_get(bad, "$.k", "string").alias("bad"))


@query(
    "table_status",
    """
    SELECT 'files' AS table_name, CAST((SELECT count(*) FROM files) AS BIGINT) AS row_count
    UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunks)
    UNION ALL SELECT 'regions', (SELECT count(*) FROM region_rows)
    UNION ALL SELECT 'terms', (SELECT sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[.''_-][\\p{L}\\p{N}_]+)*'))) FROM region_rows)
    UNION ALL SELECT 'failed_docs', (SELECT count(*) FROM raw_rows WHERE status = 'error')
    """,
)
def table_status(spark: SparkSession, sf: str) -> DataFrame:
    regions = roles.regions(spark, sf)
    return raw_layer.status_counts(
        {
            "files": roles.files(spark, sf),
            "document_chunks": roles.chunks(spark, sf),
            "document_regions": regions,
            "document_terms": terms.build_terms(regions),
            "ocr_documents": raw_rows(spark, sf),
        }
    )


# --- text functions ----------------------------------------------------------

TOKENS_SQL = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, ceil(length({0}) / 4.0::DOUBLE), ceil(len(regexp_extract_all({0}, '[^\\s]+')) * 1.35::DOUBLE)) END"


@query(
    "text_measures",
    f"""
    SELECT doc_id, CAST({TOKENS_SQL.format('text')} AS BIGINT) AS tokens,
           CAST(greatest(2048, least(8192, ceil({TOKENS_SQL.format('text')} * 1.25::DOUBLE))) AS BIGINT) AS output_tokens,
           CAST({TOKENS_SQL.format('text')} + 903 AS BIGINT) AS prompt_tokens,
           length(regexp_replace(text, '\\s+', ' ', 'g')) > 0 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 8 AS usable,
           CASE WHEN length(text) > 2000 THEN 2000 + 15 ELSE length(text) END AS cut_length,
           md5(substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 260)) AS preview_md5
    FROM documents
    """,
)
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return roles.table(spark, sf, "documents").select(
        "doc_id",
        txt.estimate_tokens(text).alias("tokens"),
        txt.output_tokens(text).alias("output_tokens"),
        txt.prompt_tokens(text, F.lit("be exact")).alias("prompt_tokens"),
        txt.is_usable_text(text).alias("usable"),
        F.length(txt.truncate(text, 2000)).cast("long").alias("cut_length"),
        F.md5(txt.preview(text)).alias("preview_md5"),
    )


@query(
    "query_cleaning",
    """
    SELECT item_id, query, array_to_string(regexp_extract_all(query, '[\\p{L}\\p{N}_.-]+'), '|') AS tokens
    FROM (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query FROM benchmark)
    """,
)
def query_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = roles.table(spark, sf, "benchmark").select("item_id", txt.clean_query(F.col("text")).alias("query"))
    return cleaned.withColumn("tokens", F.array_join(txt.query_tokens(F.col("query")), "|"))


@query(
    "evidence_tokens",
    """
    SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5
    FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[$€£₱]|[A-Za-z0-9]+(?:[./:_-][A-Za-z0-9]+)*'), lambda x: lower(trim(x, '._'))), lambda x: x <> '') AS tokens FROM documents)
    """,
)
def evidence_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = txt.evidence_tokens(F.col("text"))
    rows = roles.table(spark, sf, "documents").select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "null_safe_casts",
    """
    SELECT doc_id, try_cast(trim(word) AS DOUBLE) AS as_float, CAST(trunc(try_cast(trim(word) AS DOUBLE)) AS INTEGER) AS as_int, coalesce(CAST(trunc(try_cast(trim(word) AS DOUBLE)) AS INTEGER), 0) AS or_zero
    FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN split_part(text, ' ', 1) WHEN lang = 'fr' THEN ' ' || doc_id || ' ' ELSE doc_id || '.75' END AS word FROM documents)
    """,
)
def null_safe_casts(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    word = F.when(F.col("lang") == "en", F.split_part("text", F.lit(" "), F.lit(1))).when(F.col("lang") == "fr", F.concat(F.lit(" "), number, F.lit(" "))).otherwise(F.concat(number, F.lit(".75")))
    rows = roles.table(spark, sf, "documents").select("doc_id", word.alias("word"))
    value = F.col("word")
    return rows.select("doc_id", casts.to_float(value).alias("as_float"), casts.to_int(value).alias("as_int"), casts.int_or_zero(value).alias("or_zero"))


# --- chunks ------------------------------------------------------------------


@query("character_chunks", "SELECT chunk_id, file_hash, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(text) AS INTEGER) AS char_count, md5(text) AS text_md5 FROM chunks")
def character_chunks(spark: SparkSession, sf: str) -> DataFrame:
    made = ck.character_chunks(roles.texts(spark, sf).select("file_hash", "text"), roles.CHUNK_CHARS, roles.CHUNK_OVERLAP)
    return made.select("chunk_id", "file_hash", "chunk_index", "char_count", F.md5("text").alias("text_md5"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = roles.texts(spark, sf).select("file_hash", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return lines.withColumn("source_ref", F.concat(F.lit("#/texts/"), F.col("ordinal").cast("string")))


PACKED = f"""
    SELECT file_hash, i AS ordinal, tokens, CAST(floor((sum(tokens) OVER (PARTITION BY file_hash ORDER BY i) - tokens) / 300) AS BIGINT) AS pack_no
    FROM (SELECT file_hash, i, {TOKENS_SQL.format('raw_line')} AS tokens FROM doc_lines)
"""


@query("element_packing", f"SELECT file_hash, CAST(ordinal AS INTEGER) AS ordinal, CAST(tokens AS BIGINT) AS tokens, pack_no FROM ({PACKED})")
def element_packing(spark: SparkSession, sf: str) -> DataFrame:
    return ck.pack_elements(doc_lines(spark, sf), 300, block=64).select("file_hash", "ordinal", "tokens", "pack_no")


def split_sql(source: str, budget: int) -> str:
    """(file_hash, no, part_index, part_text, is_split) of the rows (file_hash, no, text) of a view.

    A fold over lines and, where a line is above the budget, its words, carries
    the open part and the closed ones.
    """
    size = "greatest(1, ceil(length({0}) / 4.0::DOUBLE), ceil(({1}) * 1.35::DOUBLE))".format
    item = "{{'t': {t}, 'w': {w}, 'k': {k}, 'done': CAST([] AS VARCHAR[])}}".format
    line = item(t="rtrim(x)", w="len(regexp_extract_all(x, '[^\\s]+'))", k="'line'")
    word = item(t="y", w="1", k="CASE WHEN len(regexp_extract_all(x, '[^\\s]+')) = 1 THEN 'only' WHEN i = 1 THEN 'first' WHEN i = len(regexp_extract_all(x, '[^\\s]+')) THEN 'last' ELSE 'word' END")
    closed = "CASE WHEN a.t = '' THEN a.done ELSE list_append(a.done, a.t) END"
    joined = "a.t || CASE WHEN x.k = 'line' THEN chr(10) ELSE ' ' END || x.t"
    fits = f"a.t <> '' AND x.k NOT IN ('first', 'only') AND {size(joined, 'a.w + x.w')} <= {budget}"
    grown = f"CASE WHEN {fits} THEN {joined} ELSE ltrim(x.t) END"
    done = f"CASE WHEN {fits} THEN a.done ELSE {closed} END"
    step = (
        f"CASE WHEN x.k IN ('last', 'only') THEN {{'t': '', 'w': 0, 'k': x.k, 'done': list_append({done}, {grown})}} "
        f"ELSE {{'t': {grown}, 'w': CASE WHEN {fits} THEN a.w + x.w ELSE x.w END, 'k': x.k, 'done': {done}}} END"
    )
    return f"""
    SELECT file_hash, no, text, CASE WHEN {TOKENS_SQL.format('text')} <= {budget} THEN [text] ELSE list_filter(list_append(r.done, r.t), lambda p: p <> '') END AS parts
    FROM (SELECT file_hash, no, text, list_reduce(list_prepend({{'t': '', 'w': 0, 'k': 'start', 'done': CAST([] AS VARCHAR[])}}, items), lambda a, x: {step}) AS r
      FROM (SELECT file_hash, no, text, flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x:
              CASE WHEN {TOKENS_SQL.format('x')} <= {budget} THEN [{line}]
              ELSE list_transform(regexp_extract_all(x, '[^\\s]+'), lambda y, i: {word}) END)) AS items
            FROM {source}))
    """


view("whole_texts", "SELECT file_hash, 0 AS no, text FROM texts")
view("line_tokens", """SELECT file_hash, i, tokens FROM (SELECT *, {} AS tokens FROM doc_lines)""".format(TOKENS_SQL.format("raw_line")))
view(
    "filled",
    """
    SELECT file_hash, i, tokens, tokens AS fill, 0 AS pack_no FROM line_tokens WHERE i = 0
    UNION ALL
    SELECT l.file_hash, l.i, l.tokens, CASE WHEN f.fill + l.tokens <= 300 THEN f.fill + l.tokens ELSE l.tokens END, f.pack_no + CASE WHEN f.fill + l.tokens <= 300 THEN 0 ELSE 1 END
    FROM filled f JOIN line_tokens l ON l.file_hash = f.file_hash AND l.i = f.i + 1
    """,
)


@query("greedy_packing", "SELECT file_hash, CAST(i AS INTEGER) AS ordinal, CAST(tokens AS BIGINT) AS tokens, CAST(pack_no AS BIGINT) AS pack_no FROM filled")
def greedy_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each text in packs that are filled one after another."""
    return ck.greedy_packs(doc_lines(spark, sf), 300, block=64).select("file_hash", "ordinal", "tokens", "pack_no")


view("pack_texts", f"SELECT file_hash, pack_no AS no, string_agg(raw_line, chr(10) ORDER BY ordinal) AS text FROM (SELECT p.*, l.raw_line FROM ({PACKED}) p JOIN doc_lines l ON l.file_hash = p.file_hash AND l.i = p.ordinal) GROUP BY 1, 2")


@query(
    "packed_chunks",
    f"""
    SELECT file_hash || ':' || n AS chunk_id, CAST(n AS INTEGER) AS chunk_index, CAST({TOKENS_SQL.format('part')} AS BIGINT) AS tokens, is_split, md5(part) AS text_md5
    FROM (SELECT file_hash, part, length(part) <> length(text) AS is_split, row_number() OVER (PARTITION BY file_hash ORDER BY no, slot) - 1 AS n
          FROM (SELECT file_hash, no, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS slot FROM ({split_sql('pack_texts', 300)})))
    """,
)
def packed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Packed chunks with oversized packs split."""
    return ck.packed_chunks(doc_lines(spark, sf), 300).select("chunk_id", "chunk_index", "tokens", "is_split", F.md5("text").alias("text_md5"))


@query(
    "budget_split",
    f"""
    SELECT file_hash, CAST(slot - 1 AS INTEGER) AS part_index, length(part) <> length(text) AS is_split, CAST({TOKENS_SQL.format('part')} AS BIGINT) AS tokens
    FROM (SELECT file_hash, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS slot FROM ({split_sql('whole_texts', 200)}))
    """,
)
def budget_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts split to a token budget."""
    parts = ck.split_oversized(roles.texts(spark, sf).select("file_hash", "text"), 200)
    return parts.select("file_hash", "part_index", "is_split", txt.estimate_tokens(F.col("part_text")).alias("tokens"))


# --- terms -------------------------------------------------------------------

TERM_SQL = "[\\p{L}\\p{N}_]+(?:[.''_-][\\p{L}\\p{N}_]+)*"
view(
    "term_rows",
    f"""
    SELECT region_id, file_hash, page_no, chunk_id, annotation_engine, n, token,
           length(array_to_string(list_slice(gaps, 1, n), '')) + coalesce(length(array_to_string(list_slice(tokens, 1, n - 1), '')), 0) AS char_start
    FROM (SELECT region_id, file_hash, page_no, chunk_id, annotation_engine, tokens, gaps, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS n
          FROM (SELECT *, regexp_extract_all(text, '{TERM_SQL}') AS tokens, string_split_regex(text, '{TERM_SQL}') AS gaps FROM region_rows))
    """,
)


@query(
    "region_terms",
    """
    SELECT region_id, file_hash, page_no, chunk_id, coalesce(annotation_engine, 'docling') AS annotation_engine, token AS text, lower(token) AS normalized_text,
           CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(token) AS INTEGER) AS char_end
    FROM term_rows
    """,
)
def region_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.build_terms(roles.regions(spark, sf)).select(
        "region_id", "file_hash", F.col("page_no").cast("long").alias("page_no"), "chunk_id", "annotation_engine", "text", "normalized_text", "char_start", "char_end"
    )


@query(
    "word_lookup",
    f"""
    SELECT lower(token) AS normalized_text, file_hash, page_no, region_id, CAST(count(*) AS BIGINT) AS hits, CAST(min(char_start) AS INTEGER) AS first_start
    FROM term_rows WHERE lower(token) IN (SELECT unnest(regexp_extract_all(lower(text), '{TERM_SQL}')) FROM benchmark) GROUP BY 1, 2, 3, 4
    """,
)
def word_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the benchmark texts."""
    words = roles.table(spark, sf, "benchmark").select(F.explode(txt.term_tokens(F.col("text"))).alias("word"))
    found = terms.regions_with_word(terms.build_terms(roles.regions(spark, sf)), words)
    return found.withColumn("page_no", F.col("page_no").cast("long"))


# --- search ------------------------------------------------------------------

BM25 = f"""
    SELECT query_id, chunk_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
    FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(query, '{TERM_SQL}')) AS token FROM asked)
    JOIN (SELECT chunk_id, token, dl, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS token FROM chunk_tokens) GROUP BY ALL) USING (token)
    JOIN (SELECT token, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(toks) AS token FROM chunk_tokens) GROUP BY token) USING (token),
    (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM chunk_tokens)
    GROUP BY query_id, chunk_id
"""
view("chunk_tokens", f"SELECT chunk_id, regexp_extract_all(lower(text), '{TERM_SQL}') AS toks FROM chunks")
view("bm25_rows", BM25)
view(
    "bm25_top",
    "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm25_rows) WHERE rank <= 30",
)


@query("full_text_scores", "SELECT query_id, chunk_id, round(score, 4) AS bm25 FROM bm25_rows")
def full_text_scores(spark: SparkSession, sf: str) -> DataFrame:
    asked = search.prepare_queries(roles.queries(spark, sf))
    scores = search.bm25_scores(roles.chunks(spark, sf), asked)
    return scores.select("query_id", "chunk_id", F.round("bm25", 4).alias("bm25"))


@query("block_top_ten", "SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 4) AS bm25 FROM bm25_top WHERE rank <= 10")
def block_top_ten(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best chunks of each query from an index of blocks, most of which stay closed."""
    path = scratch_path(spark, "blocks")
    block_index.write_block_index(roles.chunks(spark, sf), path, block_docs=64)
    found = block_index.top_hits(spark, path, search.prepare_queries(roles.queries(spark, sf)), 10)
    return found.select("query_id", "rank", "chunk_id", F.round("bm25", 4).alias("bm25"))


SNIPPET_SQL = """
    CASE WHEN length(text) <= 220 THEN text ELSE
      CASE WHEN trim(piece, chr(32) || chr(10)) <> '' THEN trim(piece, chr(32) || chr(10)) ELSE trim(substring(text, 1, 220), chr(32) || chr(10)) END END
"""


@query(
    "ranked_snippets",
    f"""
    SELECT query_id, CAST(rank AS INTEGER) AS position, chunk_id, round(score, 4) AS score, {SNIPPET_SQL} AS snippet
    FROM (SELECT *, substring(text, greatest(0, least(hit - 40, length(text) - 220)) + 1, 220) AS piece FROM (
      SELECT b.*, text, query, CASE WHEN instr(lower(text), query) > 0 THEN instr(lower(text), query) - 1
        ELSE coalesce(list_min(list_filter(list_transform(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_.-]+'), lambda x: instr(lower(text), x) - 1), lambda x: x >= 0)), 0) END AS hit
      FROM bm25_top b JOIN chunks USING (chunk_id) JOIN asked USING (query_id) WHERE rank <= 10))
    """,
)
def ranked_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: chunks, full-text rank and snippet, ten hits per query."""
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf: str, hits: int = 10) -> DataFrame:
    chunks = roles.chunks(spark, sf)
    asked = search.prepare_queries(roles.queries(spark, sf))
    scores = search.bm25_scores(chunks, asked)
    order = [F.round("bm25", 6).desc(), F.col("chunk_id")]
    best = search.top_per_group(scores, ["query_id"], order, hits, "position")
    shown = lookup_join(chunks.select("chunk_id", "text"), cut_lineage(best), ["chunk_id"]).join(asked, "query_id")
    return shown.select(
        "query_id", "position", "chunk_id", F.round("bm25", 4).alias("score"), spans.snippet(F.col("query"), F.col("text")).alias("snippet")
    )


@query("chunk_text_matches", "SELECT query_id, chunk_id FROM asked, chunks WHERE contains(lower(text), query)")
def chunk_text_matches(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks that contain a query, found through anchor words instead of a cross join."""
    asked = search.prepare_queries(roles.queries(spark, sf))
    return search.match_queries(roles.chunks(spark, sf), asked, "chunk_id", "text")


@query(
    "wildcard_matches",
    "SELECT query_id, chunk_id FROM (SELECT query_id, replace(query, 'e', '_') AS query FROM asked), chunks WHERE lower(text) LIKE '%' || query || '%'",
)
def wildcard_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every letter e of a query as a one-character wildcard."""
    asked = search.prepare_queries(roles.queries(spark, sf)).withColumn("query", F.replace("query", F.lit("e"), F.lit("_")))
    return search.match_queries(roles.chunks(spark, sf), asked, "chunk_id", "text")


view(
    "scan_rows",
    """
    SELECT query_id, query, 'document_regions_scan' AS rank_source, region_id AS source_id, file_hash || '.pdf' AS label, text || '  ' || label AS score_text, 78.0 AS base,
           -turn AS o1, -turn AS o2, region_id AS o3
    FROM asked, (SELECT *, lower(text || '  ' || label || ' ' || source_ref) AS hay FROM region_rows) WHERE contains(hay, query)
    UNION ALL
    SELECT query_id, query, 'page_markdown_scan', concat_ws(':', file_hash, page_no, markdown_engine), file_hash || '.pdf', markdown_text, 74.0,
           -page_no, 0, concat_ws(' ', file_hash, lpad(CAST(page_no AS VARCHAR), 12, '0'), markdown_engine)
    FROM asked, page_md WHERE contains(lower(markdown_text), query)
    UNION ALL
    SELECT query_id, query, 'document_chunks_scan', file_hash || ':' || turn, file_hash || '.pdf', text, 62.0, -turn, -turn, file_hash
    FROM asked, turns WHERE contains(lower(text), query)
    """,
)


def scan_entities(spark: SparkSession, sf: str) -> DataFrame:
    files = roles.conversation_files(spark, sf)
    regions = roles.regions(spark, sf)
    chunk_rows = search.chunk_entities(roles.region_chunks(spark, sf), files, regions)
    return (
        chunk_rows.unionByName(search.region_entities(regions, files))
        .unionByName(search.markdown_entities(roles.page_markdown(spark, sf), files))
        .unionByName(search.file_entities(files, roles.conversation_locations(spark, sf)))
    )


@query("indexed_text_matches", "SELECT query_id, chunk_id FROM asked, chunks WHERE contains(lower(text), query)")
def indexed_text_matches(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks that contain a query, found through stored lists of letter groups."""
    return _by_grams(spark, sf, search.prepare_queries(roles.queries(spark, sf)))


@query(
    "indexed_wildcard_matches",
    "SELECT query_id, chunk_id FROM (SELECT query_id, replace(query, 'e', '_') AS query FROM asked), chunks WHERE lower(text) LIKE '%' || query || '%'",
)
def indexed_wildcard_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a wildcard for every e."""
    asked = search.prepare_queries(roles.queries(spark, sf))
    return _by_grams(spark, sf, asked.withColumn("query", F.replace("query", F.lit("e"), F.lit("_"))))


def _by_grams(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    path, chunks = scratch_path(spark, "grams"), roles.chunks(spark, sf)
    gram_index.write_gram_index(chunks, path, "chunk_id", "text")
    return gram_index.match_indexed(chunks, asked, path, "chunk_id", "text")


@query(
    "scan_collectors",
    """
    SELECT query_id, rank_source, source_id, CAST(leg_rank AS INTEGER) AS leg_rank, CASE WHEN contains(score_text, query) THEN CAST(base + 20.0 AS DOUBLE) END AS exact_score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank_source ORDER BY o1, o2, o3) AS leg_rank FROM scan_rows) WHERE leg_rank <= 30
    """,
)
def scan_collectors(spark: SparkSession, sf: str) -> DataFrame:
    """Newest hits of the plain-text collectors; the score where the query occurs as typed."""
    asked = search.prepare_queries(roles.queries(spark, sf))
    hits = search.scan_hits(scan_entities(spark, sf), asked, 30).join(asked, "query_id")
    base = F.coalesce(*[F.when(F.col("rank_source") == name, F.lit(value)) for name, value in search.BASE_SCORES.items()])
    return hits.select(
        "query_id", "rank_source", "source_id", "leg_rank", F.when(F.contains("score_text", "query"), base + 20.0).alias("exact_score")
    )


@query(
    "merged_hits",
    """
    SELECT query_id, CAST(position AS INTEGER) AS position, rank_source, source_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_type, label, source_id) AS position FROM (
        SELECT query_id, rank_source, source_id, label, CAST(base + 20.0 AS DOUBLE) AS score,
          CASE rank_source WHEN 'document_regions_scan' THEN 'document_region' WHEN 'page_markdown_scan' THEN 'page_markdown' ELSE 'document_chunk' END AS source_type
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank_source ORDER BY o1, o2, o3) AS leg_rank FROM scan_rows) WHERE leg_rank <= 30 AND contains(score_text, query)))
    WHERE position <= 10
    """,
)
def merged_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ten hits of each query from all collectors, with their place; those that hold the query as typed, met twice each."""
    asked = search.prepare_queries(roles.queries(spark, sf))
    hits = search.scan_hits(scan_entities(spark, sf), asked, 30).join(asked, "query_id").filter(F.contains("score_text", "query"))
    base = F.coalesce(*[F.when(F.col("rank_source") == name, F.lit(value)) for name, value in search.BASE_SCORES.items()])
    scored = hits.withColumn("score", base + 20.0)
    again = scored.withColumn("rank_source", F.lit("files_scan")).withColumn("score", F.lit(0.0))
    return search.merge_hits(scored.unionByName(again), 10).select("query_id", "position", "rank_source", "source_id", "score")


@query(
    "hit_routes",
    """
    SELECT query_id, rank_source, source_id, CAST(leg_rank AS INTEGER) AS leg_rank, granularity, file, page, overlay, overlays, view, highlight FROM (
      SELECT s.query_id, s.rank_source, s.source_id, row_number() OVER (PARTITION BY s.query_id, s.rank_source ORDER BY o1, o2, o3) AS leg_rank,
        CASE WHEN g.region_id IS NULL THEN 'record' ELSE 'region' END AS granularity, coalesce(g.file_hash, split_part(s.source_id, ':', 1)) AS file,
        CAST(coalesce(g.page_no, CAST(split_part(s.source_id, ':', 2) AS BIGINT)) AS VARCHAR) AS page, 'region:' || g.region_id AS overlay,
        CASE WHEN g.region_id IS NOT NULL THEN 'selected' END AS overlays, CASE WHEN g.region_id IS NULL THEN 'split' END AS view, s.query AS highlight
      FROM scan_rows s LEFT JOIN region_rows g ON g.region_id = s.source_id WHERE s.rank_source <> 'document_chunks_scan') WHERE leg_rank <= 5
    """,
)
def hit_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Where the first region and page hits of each query lead."""
    asked = search.prepare_queries(roles.queries(spark, sf))
    hits = search.scan_hits(scan_entities(spark, sf).filter("source_type IN ('document_region', 'page_markdown')"), asked, 5)
    placed = search.navigation(hits.join(asked, "query_id"), asked, terms.build_terms(roles.regions(spark, sf)))
    route = lambda name: F.col("route")[name].alias(name)
    return placed.select("query_id", "rank_source", "source_id", "leg_rank", "granularity", *[route(name) for name in ("file", "page", "overlay", "overlays", "view", "highlight")])


@query(
    "file_scan_hits",
    """
    SELECT file_query, file_hash, 102.0 AS score FROM (SELECT DISTINCT '/' || source || '/' || lang || '/' AS file_query FROM documents),
    (SELECT DISTINCT file_hash, lower(filename || ' ' || file_hash || ' ' || path) AS hay FROM sightings) WHERE contains(hay, file_query) GROUP BY 1, 2
    """,
)
def file_scan_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Folder names as queries over file names, hashes and paths."""
    documents = roles.table(spark, sf, "documents")
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"))
    asked = documents.select(folder.alias("query_id"), folder.alias("text")).distinct()
    prepared = search.prepare_queries(asked)
    named = roles.sightings(spark, sf).select("file_hash", "filename", "extension", F.col("seen_at").alias("last_seen_at"))
    entities = search.file_entities(named.drop("path"), roles.locations(spark, sf).drop("last_seen_at")).dropDuplicates(["haystack"])
    hits = search.with_scores(search.scan_hits(entities, prepared, None), prepared)
    return hits.groupBy(F.col("query_id").alias("file_query"), "file_hash").agg(F.max("score").alias("score"))


@query(
    "newest_file_hits",
    """
    SELECT query_id, CAST(place AS INTEGER) AS place, source_id, path FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY last_doc DESC, filename || ' ' || path) AS place FROM (
        SELECT DISTINCT '/' || source || '/' || lang || '/' AS query_id FROM documents),
        (SELECT f.file_hash AS source_id, f.filename, l.path, f.last_doc, lower(f.filename || ' ' || f.file_hash || ' ' || l.path) AS hay FROM files f JOIN locations l ON l.file_hash = f.file_hash)
      WHERE contains(hay, query_id)) WHERE place <= 5
    """,
)
def newest_file_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest files below each folder, with their place in the list."""
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"))
    asked = search.prepare_queries(roles.table(spark, sf, "documents").select(folder.alias("query_id"), folder.alias("text")).distinct())
    entities = search.file_entities(roles.files(spark, sf), roles.locations(spark, sf))
    hits = search.scan_hits(entities, asked, 5)
    return hits.select("query_id", F.col("leg_rank").alias("place"), "source_id", F.col("metadata")["path"].alias("path"))


@query(
    "raw_layer_slices",
    "SELECT file_hash, annotation_engine, CASE annotation_engine WHEN 'mineru' THEN 'again' ELSE status END AS status FROM raw_rows WHERE annotation_engine <> 'mineru' OR status = 'ok'",
)
def raw_layer_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The stored reader layer after one engine's slice was written anew; the other slices stay."""
    path = scratch_path(spark, "raw-layer")
    rows = raw_rows(spark, sf).select("file_hash", "annotation_engine", "status")
    raw_layer.write_raw_layer(rows, path)
    raw_layer.write_raw_layer(rows.filter("annotation_engine = 'mineru' and status = 'ok'").withColumn("status", F.lit("again")), path)
    return spark.read.parquet(path).select("file_hash", "annotation_engine", "status")


@query(
    "chunk_best_term",
    """
    SELECT query_id, chunk_id, region_id AS word_region_id, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(token) AS INTEGER) AS char_end FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY char_start, sha256(region_id || '|' || char_start)) AS rn
      FROM (SELECT DISTINCT query_id, file_hash || ':' || turn AS chunk_id FROM asked, turns WHERE contains(lower(text), query))
      JOIN (SELECT query_id, unnest(regexp_extract_all(query, '[\\p{L}\\p{N}_.-]+')) AS word FROM asked) USING (query_id)
      JOIN term_rows USING (chunk_id) WHERE lower(token) = word) WHERE rn = 1
    """,
)
def chunk_best_term(spark: SparkSession, sf: str) -> DataFrame:
    """First word of each matching chunk that the query asks for."""
    asked = search.prepare_queries(roles.queries(spark, sf))
    chunks = roles.region_chunks(spark, sf)
    hits = search.match_queries(chunks, asked, "chunk_id", "text").withColumn("source_type", F.lit("document_chunk"))
    found = search.best_term(hits, asked, terms.build_terms(roles.regions(spark, sf)))
    return found.select("query_id", "chunk_id", "word_region_id", "char_start", "char_end")


def search_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    regions = roles.regions(spark, sf)
    return {
        "files": roles.conversation_files(spark, sf),
        "file_locations": roles.conversation_locations(spark, sf),
        "document_chunks": roles.region_chunks(spark, sf),
        "document_regions": regions,
        "document_page_markdown": roles.page_markdown(spark, sf),
        "document_terms": terms.build_terms(regions),
    }


@query("global_search")
def global_search(spark: SparkSession, sf: str) -> DataFrame:
    """All collectors, merged and ranked, with fuzzy scores; checked against brute force in the tests."""
    found = search.search_global(roles.queries(spark, sf), search_tables(spark, sf), 30)
    return found.select(
        "query_id", "position", "result_id", "source_type", "label", "snippet", F.round("score", 4).alias("score"),
        "rank_source", "navigation_granularity", F.size("highlights").alias("n_highlights"), "page_no", "region_id",
    )


@query(
    "phrase_highlights",
    """
    SELECT query_id, chunk_id, CAST((length(body) - length(replace(body, query, ''))) / length(query) AS BIGINT) AS n_spans, CAST(instr(body, query) - 1 AS BIGINT) AS first_start
    FROM (SELECT query_id, query, chunk_id, lower(text) AS body FROM asked, chunks WHERE contains(lower(text), query))
    """,
)
def phrase_highlights(spark: SparkSession, sf: str) -> DataFrame:
    asked = search.prepare_queries(roles.queries(spark, sf))
    chunks = roles.chunks(spark, sf)
    pairs = search.match_queries(chunks, asked, "chunk_id", "text").join(asked, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    found = pairs.withColumn("s", spans.phrase_spans(F.col("query"), F.col("text")))
    return found.select("query_id", "chunk_id", F.size("s").cast("long").alias("n_spans"), F.element_at("s", 1)["start"].cast("long").alias("first_start"))


# --- documents and folders ---------------------------------------------------


@query(
    "document_summaries",
    """
    SELECT f.file_hash, f.filename, f.extension, l.path, r.docling_status, r.mineru_status, coalesce(r.docling_error, '-') AS docling_error,
           CAST(coalesce(c.n, 0) AS BIGINT) AS chunk_count, CAST(coalesce(g.n, 0) AS BIGINT) AS region_count
    FROM files f
    LEFT JOIN (SELECT file_hash, min(path) AS path FROM locations GROUP BY 1) l USING (file_hash)
    LEFT JOIN (SELECT file_hash, max(status) FILTER (WHERE annotation_engine = 'docling') AS docling_status, max(status) FILTER (WHERE annotation_engine = 'mineru') AS mineru_status,
                      max(nullif(error, '-')) FILTER (WHERE annotation_engine = 'docling') AS docling_error FROM raw_rows GROUP BY 1) r USING (file_hash)
    LEFT JOIN (SELECT file_hash, count(*) AS n FROM chunks GROUP BY 1) c USING (file_hash)
    LEFT JOIN (SELECT file_hash, count(*) AS n FROM elements GROUP BY 1) g USING (file_hash)
    """,
)
def document_summaries(spark: SparkSession, sf: str) -> DataFrame:
    from folioscope.plans.structure import document_elements

    regions = document_elements(spark, sf).withColumn("annotation_engine", F.lit(None).cast("string"))
    rows = docs.document_summaries(roles.files(spark, sf), roles.locations(spark, sf), raw_rows(spark, sf), roles.chunks(spark, sf), regions)
    return rows.select(
        "file_hash", "filename", "extension", "path", "docling_status", "mineru_status",
        F.coalesce("docling_error", F.lit("-")).alias("docling_error"), "chunk_count", "region_count",
    )


view(
    "page_paths",
    """
    SELECT page_id, url, list_filter(string_split(regexp_replace(url, '/+', '/', 'g'), '/'), lambda p: p <> '') AS parts FROM pages
    """,
)


@query("common_root", "SELECT array_to_string(list_slice(list_filter(string_split(min(path), '/'), lambda p: p <> ''), 1, 0), '/') AS root FROM locations")
def common_root(spark: SparkSession, sf: str) -> DataFrame:
    """The document folders differ from the first part on, so the root is empty."""
    return docs.common_root(roles.locations(spark, sf)).select(F.array_join("root_parts", "/").alias("root"))


@query("shared_root", "SELECT 'store/corpus' AS root FROM (SELECT count(*) FROM locations)")
def shared_root(spark: SparkSession, sf: str) -> DataFrame:
    """The same paths below a shared folder, given with mixed separators."""
    below = roles.locations(spark, sf).withColumn("path", F.concat(F.lit("\\store//corpus"), "path"))
    return docs.common_root(below).select(F.array_join("root_parts", "/").alias("root"))


@query(
    "folder_stats",
    """
    SELECT folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(chunk_count) AS BIGINT) AS chunks,
           CAST(any_value(folders) AS BIGINT) AS folders, CAST(count(*) FILTER (WHERE ready) AS BIGINT) AS ready_documents, any_value(extensions) AS extensions
    FROM (SELECT p.*, unnest([source, source || '/' || lang]) AS folder FROM (
            SELECT s.path, s.source, s.lang, s.size_bytes, coalesce(c.n, 0) AS chunk_count, coalesce(r.ready, false) AS ready FROM sightings s
            LEFT JOIN (SELECT file_hash, count(*) AS n FROM chunks GROUP BY 1) c USING (file_hash)
            LEFT JOIN (SELECT file_hash, bool_or(status = 'ok') AS ready FROM raw_rows GROUP BY 1) r USING (file_hash)) p)
    JOIN (SELECT folder, CASE WHEN contains(folder, '/') THEN 0 ELSE n END AS folders FROM (
            SELECT unnest([source, source || '/' || lang]) AS folder, n FROM (SELECT DISTINCT source, lang, count(DISTINCT lang) OVER (PARTITION BY source) AS n FROM documents)) GROUP BY ALL) USING (folder)
    JOIN (SELECT folder, string_agg(extension || ' ' || n, ', ' ORDER BY n DESC, extension) AS extensions FROM (
            SELECT folder, extension, count(*) AS n FROM (SELECT extension, unnest([source, source || '/' || lang]) AS folder FROM sightings) GROUP BY 1, 2) GROUP BY 1) USING (folder)
    GROUP BY folder
    """,
)
def folder_stats(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_rows(spark, sf)
    files = roles.sightings(spark, sf).select("file_hash", "path", "extension", "size_bytes")
    chunk_counts = roles.chunks(spark, sf).groupBy("file_hash").agg(F.count("*").alias("chunk_count"))
    ready = raw.filter("status = 'ok'").select("file_hash").distinct().withColumn("docling_status", F.lit("ok"))
    joined = files.join(chunk_counts, "file_hash", "left").join(ready, "file_hash", "left").withColumns(
        {
            "chunk_count": F.coalesce("chunk_count", F.lit(0)),
            "region_count": F.lit(0),
            "docling_status": F.coalesce("docling_status", F.lit("none")),
            "mineru_status": F.lit("none"),
        }
    )
    placed = docs.relative_folders(joined)
    return docs.folder_stats(placed).select("folder", "files", "size_bytes", "chunks", "folders", "ready_documents", "extensions")


@query(
    "first_region_of_chunk",
    """
    SELECT c.chunk_id, coalesce(filename, c.file_hash) AS label, first_region FROM (SELECT file_hash || ':' || turn AS chunk_id, file_hash FROM turns) c
    LEFT JOIN (SELECT file_hash, file_hash || '.pdf' AS filename FROM conv_files) f USING (file_hash)
    LEFT JOIN (SELECT chunk_id, arg_min(region_id, (page_no, region_id)) AS first_region FROM region_rows GROUP BY 1) r USING (chunk_id)
    """,
)
def first_region_of_chunk(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.chunk_entities(roles.region_chunks(spark, sf), roles.conversation_files(spark, sf), roles.regions(spark, sf))
    return rows.select("chunk_id", "label", F.col("region_id").alias("first_region"))


@query(
    "engine_filter",
    "SELECT region_id, coalesce(annotation_engine, 'docling') AS engine FROM region_rows WHERE coalesce(annotation_engine, 'docling') IN ('docling', 'mineru', 'infinity', 'docling_normalized', 'mineru_normalized')",
)
def engine_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.regions(spark, sf).filter(kinds.is_active_engine(F.col("annotation_engine")))
    return rows.select("region_id", kinds.engine_or_default(F.col("annotation_engine")).alias("engine"))


@query(
    "newest_chunk_per_file",
    "SELECT file_hash, arg_max(chunk_id, chunk_index) AS chunk_id FROM chunks GROUP BY file_hash",
)
def newest_chunk_per_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.chunks(spark, sf)
    return first_per_group(rows, ["file_hash"], [F.col("created_at").desc(), F.col("chunk_index").desc()]).select("file_hash", "chunk_id")
