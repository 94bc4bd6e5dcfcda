"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own characters say so, so that equal passages give equal chunks. A chunk is
known by a 64-bit identifier, and the identifiers are verified against the chunks' content: where two
contents share an identifier, each gets a number of its own. Two texts are equal when their ordered
identifier lists are equal, so whole documents are never shuffled; each distinct chunk moves once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, held, stored, text_of

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: A chunk ends behind a letter from c to f that follows white space or punctuation.
CUT = r"(?<=[^\p{L}\p{N}][c-f])"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK, cut: str = CUT) -> str:
    """Shortest run of ``least`` characters or more that ends at a cut, else ``most`` characters or the rest."""
    return rf"(?s).{{{least},{most - 1}}}?{cut}|.{{1,{most}}}"


def chunks_of(text: Column, pattern: str | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern or chunk_pattern()), F.lit(0))


def chunk_recipes(
    docs: DataFrame, text_col: str = "text", pattern: str | None = None, identify: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """Per row of ``docs``: doc_id, recipe (ordered verified identifiers), text_sha256. Null text is empty.

    ``identify`` gives a chunk's identifier; it may collide, since contents are compared.
    """
    cut = docs.select("doc_id", text_of(docs, text_col).alias("__text"))
    cut = cut.select("doc_id", F.sha2("__text", 256).alias("text_sha256"), held(chunks_of(F.col("__text"), pattern)).alias("__chunks"))
    recipes = stored(
        cut.select("doc_id", "text_sha256", F.transform("__chunks", lambda c: identify(c).cast("long")).alias("recipe")), "recipes"
    )
    contents = (
        docs.select(F.explode(chunks_of(text_of(docs, text_col), pattern)).alias("chunk"))
        .select(identify(F.col("chunk")).cast("long").alias("id"), "chunk")
        .distinct()
    )
    shared = stored(contents.groupBy("id").count().filter("count > 1").select("id"), "shared_ids")
    if shared.isEmpty():
        return recipes.select("doc_id", F.transform("recipe", lambda i: F.struct(i.alias("id"), F.lit(0).alias("n"))).alias("recipe"), "text_sha256")
    return _resolved(docs, text_col, pattern, identify, contents.join(shared, "id"))


def _resolved(docs: DataFrame, text_col: str, pattern: str | None, identify: Callable, contents: DataFrame) -> DataFrame:
    """Recipes in which contents that share an identifier are numbered by their order."""
    from pyspark.sql import Window

    numbered = stored(contents.select("id", "chunk", F.dense_rank().over(Window.partitionBy("id").orderBy("chunk")).alias("n")), "numbered")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), text_of(docs, text_col).alias("__text"))
    rows = rows.select("doc_id", "__row", F.sha2("__text", 256).alias("text_sha256"), F.posexplode_outer(chunks_of(F.col("__text"), pattern)).alias("pos", "chunk"))
    rows = rows.withColumn("id", identify(F.col("chunk")).cast("long")).join(numbered, ["id", "chunk"], "left")
    listed = rows.groupBy("__row", "doc_id", "text_sha256").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", F.coalesce("n", F.lit(0)).alias("n"))))).alias("r")
    )
    return stored(listed.select("doc_id", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))).alias("recipe"), "text_sha256"), "resolved")


def exact_dedup(docs: DataFrame, text_col: str = "text", pattern: str | None = None, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the largest doc_id stays. Null text counts as empty; empty texts are equal. Rows that
    repeat a doc_id with the same text count each in group_size and share one decision. A null doc_id
    stays only where its group has no other. No rows in, none out; other columns of ``docs`` are ignored.
    """
    recipes = chunk_recipes(docs, text_col, pattern, identify)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups, "groups")  # read back, so that both sides of the join are exchanged and a hot recipe can be split
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
