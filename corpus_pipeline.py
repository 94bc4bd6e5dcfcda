"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``doc_id`` names a document: rows that share one stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.llm._common import documents, stored
from fathomlake.llm.exact_dedup import exact_dedup
from fathomlake.llm.mixing import mix_sources
from fathomlake.llm.ngram_join import ngram_join
from fathomlake.llm.packing import pack
from fathomlake.llm.quality import quality_rules, trusted_of


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id ``chosen`` has; a null doc_id is a name like others. A merge join at every size: ids grow with the corpus."""
    ids = chosen.select(F.col("doc_id").alias("__chosen")).hint("merge")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__chosen"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _only(docs, quality_rules(docs, trusted_of(spark, sf_dir)).filter("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return _only(docs, exact_dedup(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays."""
    return _only(docs, ngram_join(docs, width=5, num=80, den=100).filter("doc_id <=> component_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those not taken go."""
    copies = mix_sources(docs, by_size=True).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    copies = copies.select(F.col("doc_id").alias("__chosen"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).hint("merge")
    return docs.join(copies, docs["doc_id"].eqNullSafe(copies["__chosen"])).select(*[docs[c] for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids along the Hilbert curve, as pieces with their ids."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mix_sources", mix), ("packing", packing)]

#: Packing needs the tokenizer, which SQL hasn't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
