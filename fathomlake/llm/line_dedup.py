"""Line deduplication over overlapping three-line windows.

Every window of three consecutive lines is known by the MD5 of its lines' MD5s. Windows found twice or
more anywhere are repeated; the first by (doc_id, line) stays, and the lines covered by later ones go.
Covered positions of a document are merged, so that overlapping windows remove a line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, held, let, stored, text_of

WINDOW = 3


def text_name(text) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(text)


def _windows(docs: DataFrame, width: int) -> DataFrame:
    r"""doc_id, name (of the text), pos, h for every window of ``width`` lines of which one has a word."""
    lines = docs.select("doc_id", text_of(docs).alias("text")).select("doc_id", text_name("text").alias("name"), held(F.split("text", "\n", -1)).alias("lines"))
    lines = lines.filter(F.size("lines") >= width).select(
        "doc_id", "name", held(F.transform("lines", lambda x: F.struct(F.unhex(F.md5(x)).alias("h"), x.rlike(r"[^\x20\x09-\x0D]").alias("w")))).alias("lines")
    )

    def one(i):
        part = F.slice(F.col("lines"), i, width)
        return let(
            part,
            lambda p: F.when(
                F.exists(p, lambda x: x["w"]), F.struct((i - 1).alias("pos"), F.unhex(F.md5(F.aggregate(p, F.lit(b""), lambda a, x: F.concat(a, x["h"])))).alias("h"))
            ),
        )

    found = lines.select("doc_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("lines") - (width - 1)), one)).alias("x"))
    return found.filter("x is not null").select("doc_id", "name", "x.pos", "x.h")


def line_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    r"""Per row of ``docs``: doc_id, text (without removed lines), n_lines, n_removed, spans.

    Lines are split at \n alone and compared whole. ``spans`` lists the removed runs as [first line, lines].
    Texts of fewer than ``width`` lines keep all; a window without a word never counts, so blank runs stay. Null
    text is empty and stays empty; an empty text is one empty line. The first occurrence is the one with the
    smallest doc_id (null first), then line; of a doc_id's different texts one fixed one comes first, and rows that repeat
    doc_id and text keep and lose the same lines. No rows give none; other columns are ignored.
    """
    windows = stored(_windows(docs, width).distinct(), "windows")
    firsts = windows.groupBy("h").agg(F.min(F.struct("doc_id", "name", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("name") == F.col("first.name")) & (F.col("pos") == F.col("first.pos"))
    later = windows.join(firsts, "h").filter(~here)
    marks = later.groupBy("doc_id", "name").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    # a run starts where no window before reaches, and ends where none behind starts
    starts = F.filter("at", lambda p, i: F.coalesce(p > F.get("at", i - 1) + width, F.lit(True)))
    ends = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + 1) > p + width, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("first"), (z + width - a).cast("int").alias("lines")))
    spans = marks.select("doc_id", "name", runs.alias("spans"))
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    both = texts.withColumn("name", text_name("text")).alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.name") == F.col("s.name")), "left")
    both = both.select("d.doc_id", "text", F.coalesce("spans", F.lit([]).cast("array<struct<first:int,lines:int>>")).alias("spans"))

    def cut(text, spans):
        """Pieces between the removed runs."""
        return let(
            F.split(text, "\n", -1),
            lambda lines: F.array_join(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(0), F.size(spans)),
                        lambda i: let(
                            F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["first"] + F.get(spans, i - 1)["lines"]),
                            lambda at: F.slice(lines, at + 1, F.greatest(F.lit(0), F.coalesce(F.get(spans, i)["first"], F.size(lines)) - at)),
                        ),
                    )
                ),
                "\n",
            ),
        )

    kept = F.when(F.size("spans") == 0, F.col("text")).otherwise(cut(F.col("text"), F.col("spans")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["lines"])
    return both.select("doc_id", kept.alias("text"), (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"), removed.alias("n_removed"), "spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3
), k AS (
  SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS win FROM w
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM k WHERE regexp_matches(win, '[^\x20\x09-\x0D]')
), c AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE nth > 1
), e AS (
  SELECT doc_id, unnest(lines) AS txt, unnest(range(len(lines))) AS line FROM l
), j AS (
  SELECT e.doc_id, e.line, e.txt, c.line IS NOT NULL AS gone,
         coalesce(lag(c.line IS NOT NULL) OVER (PARTITION BY e.doc_id ORDER BY e.line), false) AS before
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.line = c.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
       sha256(coalesce(string_agg(txt, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
