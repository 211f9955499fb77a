"""A stored index of letter groups, so that a scan for any piece of text opens few posting lists.

Every text is stored under its distinct groups of three neighbouring characters
(its last two positions under what is left), as lists of keys by group and block
of keys, dealt into buckets by group.  A query is looked up by the rarest groups
of its literal pieces; their lists are intersected and the few texts left are
checked.  A query whose pieces are shorter than a group opens the groups that
begin with its longest piece.

Keys are numbered within their block.  Texts are dealt out by block of keys, so
lists are made and intersected where the block is, as numbers; keys are stored
once and looked up for the texts that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.grouping import broadcast_if_small, lookup_join, top_per_group
from folioscope.functions.rows import explode_rows
from folioscope.operators.search import holds, wildcards_only
from folioscope.session import cut_lineage

SIZE = 3
#: So many of a query's rarest groups are intersected; more would open lists that are longer and tell less.
INTERSECTED = 3


def groups_of(text: Column) -> Column:
    """The distinct groups of a text; those of its last positions are shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{SIZE}}}))."), F.lit(1)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def write_gram_index(texts: DataFrame, path: str, key: str, haystack: str, buckets: int = 64, block: int = 4096) -> None:
    """Store posting lists, the number of texts of each group, and the number of buckets under a path.

    ``key`` is unique.  A list has about ``block`` keys at most, so a group
    that all texts hold is many rows.
    """
    spark = texts.sparkSession
    blocks = max(1, -(-texts.count() // block))
    part = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("part")
    lowered = texts.select(F.col(key).alias("key"), F.lower(F.col(haystack)).alias("hay")).filter(F.col("hay").isNotNull())

    def numbered(*columns: str) -> DataFrame:
        """The texts dealt out by block, with the place of each among its keys."""
        dealt = lowered.select("key", part, *columns).repartition(blocks, "part")
        return dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("key")))

    numbered().write.mode("overwrite").parquet(f"{path}/keys")
    rows = explode_rows(numbered("hay"), ["part", "place"], groups_of(F.col("hay")), "gram")
    # The group comes first: a sort compares its first key by eight bytes, which would be the same for all rows of a block.
    lists = rows.groupBy("gram", "part").agg(F.collect_list("place").alias("places")).withColumn("bucket", _bucket(buckets))
    laid = lists.repartition("bucket", F.pmod(F.col("part"), F.lit(4))).sortWithinPartitions("bucket", "gram", "part")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    stored = spark.read.parquet(f"{path}/lists")
    stored.groupBy("gram").agg(F.sum(F.size("places")).alias("texts")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(blocks).alias("blocks")).write.mode("overwrite").parquet(f"{path}/layout")


def asked_groups(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, need, gram): a text must have, for each need of the query, one of its groups.

    A query without a row has no literal character, or a group that no text holds.
    """
    vocabulary = queries.sparkSession.read.parquet(f"{path}/vocabulary")
    pieces = explode_rows(queries, ["query_id"], F.filter(F.split("query", "[%_]"), lambda p: p != ""), "piece")
    long = F.length("piece") >= SIZE
    full = F.filter(groups_of(F.col("piece")), lambda g: F.length(g) == SIZE)
    grams = cut_lineage(explode_rows(pieces.filter(long), ["query_id"], full, "gram").distinct())
    counted = lookup_join(vocabulary, cut_lineage(grams.select("gram").distinct()), ["gram"])
    rated = grams.join(counted, "gram", "left")
    unheld = rated.filter("texts IS NULL").select("query_id").distinct()
    rarest = top_per_group(rated.join(unheld, "query_id", "left_anti"), ["query_id"], [F.col("texts"), F.col("gram")], INTERSECTED, "need").select("query_id", "need", "gram")
    short = pieces.join(pieces.filter(long).select("query_id").distinct(), "query_id", "left_anti")
    longest = cut_lineage(top_per_group(short, ["query_id"], [F.length("piece").desc(), F.col("piece")], 1, "need"))
    begins = vocabulary.select("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(SIZE - 1)), lambda n: F.left(F.col("gram"), n)))).alias("piece"))
    opened = lookup_join(begins, longest, ["piece"], ["gram"]).select("query_id", "need", "gram")
    return rarest.unionByName(opened)


def candidates(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, key) of the texts that hold what every need of the query asks for."""
    spark = queries.sparkSession
    layout = spark.read.parquet(f"{path}/layout").first()
    asked = cut_lineage(asked_groups(queries, path).withColumn("bucket", _bucket(layout["buckets"])))
    needs = asked.groupBy("query_id").agg(F.max("need").alias("_needs"))
    wanted = cut_lineage(asked.join(needs, "query_id"))
    known = broadcast_if_small(asked.select("bucket", "gram").distinct())
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), layout["blocks"])
    lists = spark.read.parquet(f"{path}/lists").join(known, ["bucket", "gram"]).drop("bucket").repartition(width, "part")
    met = lookup_join(lists, wanted.drop("bucket"), ["gram"], ["part"]).select("query_id", "_needs", "need", "part", F.explode("places").alias("place"))
    # several groups of one need may hold a key, so needs are counted as bits
    held = met.groupBy("query_id", "_needs", "part", "place").agg(F.bit_or(F.expr("shiftleft(1, need - 1)")).alias("_held"))
    left = held.filter(F.col("_held") == F.expr("shiftleft(1, _needs) - 1")).select("query_id", "part", "place")
    return lookup_join(spark.read.parquet(f"{path}/keys"), cut_lineage(left), ["part", "place"]).select("query_id", "key")


def match_indexed(texts: DataFrame, queries: DataFrame, path: str, key: str, haystack: str) -> DataFrame:
    """(query_id, key) of every text whose lower-cased haystack contains the query, found through the index.

    Gives what ``search.match_queries`` gives: ``%`` and ``_`` are wildcards,
    and a query of wildcards only meets every text that is long enough.
    """
    asked = cut_lineage(queries.select("query_id", "query"))
    lowered = texts.select(key, F.lower(F.col(haystack)).alias("_hay"))
    bare = asked.filter(F.regexp_replace("query", "[%_]", "") == "")
    found = cut_lineage(candidates(asked.join(bare.select("query_id"), "query_id", "left_anti"), path).withColumnRenamed("key", key))
    matched = lookup_join(lowered, found, [key]).join(asked, "query_id").filter(holds(F.col("_hay"), F.col("query"))).select("query_id", key)
    return matched.unionByName(wildcards_only(lowered, bare, key))
