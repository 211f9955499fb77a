"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import cube, imatch, lm_scoring, lsh_forest, periods, ppm, quality, segment_trees, set_join, suffix_dedup, top_k, weak_labels, winnowing
from folioscope.llm.registry import query
from folioscope.llm.shared import held_out, table

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, o, substr(h, 2 * o + 1, 610) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 256)) AS o FROM d WHERE len(h) >= 100)),
w AS (SELECT doc_id, o + i AS p, substr(part, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, part, unnest(range(least(len(part) // 2 - 49, 256))) AS i FROM k)),
g AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, p FROM w JOIN g USING (s) WHERE w.doc_id > least),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER q + 50 THEN 0 ELSE 1 END AS opens FROM hits WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
lists AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(list_zip(list_prepend(0, b), list_append(a, len(h) // 2)), lambda x: substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), '') END)) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""


@query("op1_suffix_dedup", _REPEATS_SQL)
def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the documents that an earlier document has are removed."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 3 THEN w ELSE list_slice(w, i, i + 2) END, ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS to_id FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.to_id = links.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(to_id) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""


@query("op6_minhash_near_dedup", _NEAR_SQL)
def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are nearly equal, by component."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_LEAKS_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op8_winnowing_decontamination", _LEAKS_SQL)
def contamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that stand in benchmark items."""
    return winnowing.digest(winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op2_quality_boosted_trees")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of good quality of every document, from trees fitted on the learning rows."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_language_ppm")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("row.doc_id")
    return ppm.identify(docs, ppm.train(docs)).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "bits")


@query("op4_cube_mixing")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return cube.digest(cube.mix(table(spark, sf_dir, "documents")))


_SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


@query("op5_exact_top_k", _SEARCH_SQL)
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op7_cross_entropy_difference")
def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more a document is like the good ones than like all."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "target_loss", "background_loss", "score")


@query("op9_weak_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a toxic text of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = weak_labels.score(docs, weak_labels.train(docs, table(spark, sf_dir, "labels")))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "votes")


@query("op10_license_set_join")
def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and license blocks of every document."""
    return set_join.digest(set_join.license_blocks(table(spark, sf_dir, "documents")))


_AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT k, lang, source, unnest(w) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM each GROUP BY ALL),
l AS MATERIALIZED (SELECT lang, term, sum(n) AS overall FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS kinds, sum(overall) AS grand FROM l GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n) FILTER (WHERE l.term IS NOT NULL), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN l USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, l.term, coalesce(n, 0) AS n, overall, grand, kinds,
       1 + CAST(1000000000 * CAST(coalesce(n, 0) + 2 AS HUGEINT) // CAST(total + 2 * kinds AS HUGEINT) AS HUGEINT) AS p
      FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT)
          FROM (SELECT *, 1 + CAST(1000000000 * CAST(overall + 2 AS HUGEINT) // CAST(grand + 2 * kinds AS HUGEINT) AS HUGEINT) AS q FROM p) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op12_segment_tree_audit", _AUDIT_SQL)
def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and their marking terms."""
    return segment_trees.audit(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, one document in ten made periodic."""
    return periods.digest(periods.periodic_runs(periods.with_planted_periods(table(spark, sf_dir, "documents"))))


_PRINT_HASHES_SQL = """SELECT k, v, string_agg(h, '-' ORDER BY j) AS print FROM (
  SELECT k, v, j, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h
  FROM (SELECT k, v, term, j, substr(parts, j, 1) AS place, max(substr(parts, j, 1)) OVER (PARTITION BY k, v, j) AS best FROM {terms}, js) WHERE place = best GROUP BY k, v, j) GROUP BY k, v"""
_PRINTS_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents),
js AS (SELECT unnest(range(1, {imatch.LEXICONS + 1})) AS j),
e AS MATERIALIZED (SELECT a.doc_id, a.k, a.n, a.t, length(a.t) AS n_chars, left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4) AS edited
      FROM d a JOIN d b ON b.k = a.k % a.n + 1),
x AS (SELECT k, 0 AS v, t AS s FROM e UNION ALL SELECT k, 1, edited FROM e),
w AS MATERIALIZED (SELECT DISTINCT k, v, unnest(regexp_extract_all(lower(s), '{_WORDS}')) AS term FROM x),
p AS MATERIALIZED (SELECT term, sum(1 - v) AS docs, sha256(term) AS hashed FROM w GROUP BY term),
l AS MATERIALIZED (SELECT term, docs >= {imatch.shares()[0]!r} * n AND docs <= {imatch.shares()[1]!r} * n AS inside,
      array_to_string(list_transform(range(0, {imatch.LEXICONS}), lambda j: substr('0123456789abcdef', 17 - length(bin(CAST('0x' || substr(hashed, 4 * j + 1, 4) AS BIGINT))), 1)), '') AS parts
      FROM p, (SELECT count(*) AS n FROM d)),
m AS MATERIALIZED (SELECT k, v, term, parts, inside, max(CAST(inside AS INTEGER)) OVER (PARTITION BY k, v) AS found_any FROM w JOIN l USING (term)),
used AS MATERIALIZED (SELECT k, v, term, parts FROM m WHERE inside OR found_any = 0),
f AS ({_PRINT_HASHES_SQL.format(terms="used")}),
every AS MATERIALIZED (SELECT x.k, x.v, coalesce(print, '=' || md5(s)) AS print FROM x LEFT JOIN f ON f.k = x.k AND f.v = x.v),
r AS (SELECT e.doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, c.print AS next_print
      FROM e JOIN every a ON a.k = e.k AND a.v = 0 JOIN every b ON b.k = e.k AND b.v = 1 JOIN every c ON c.k = e.k % e.n + 1 AND c.v = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN length(fingerprint) <> length(edited_fingerprint) THEN 0.0::DOUBLE
       ELSE len(list_filter(list_zip(string_split(fingerprint, '-'), string_split(edited_fingerprint, '-')), lambda q: q[1] = q[2]))::DOUBLE / len(string_split(fingerprint, '-')) END AS near_edited,
  CASE WHEN fingerprint = next_print THEN 1.0::DOUBLE WHEN length(fingerprint) <> length(next_print) THEN 0.0::DOUBLE
       ELSE len(list_filter(list_zip(string_split(fingerprint, '-'), string_split(next_print, '-')), lambda q: q[1] = q[2]))::DOUBLE / len(string_split(fingerprint, '-')) END AS near_next
FROM r
"""


@query("op11_imatch_fingerprints", _PRINTS_SQL)
def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.audit_edits(table(spark, sf_dir, "documents"))
