"""Mixing sources to target weights by Pareto order sampling.

Targets fill up like water under caps. In each source every document gets the whole copies that its
expected count holds for certain; what is left is a fraction f of the source. Documents are then ranked
by their random odds divided by their inclusion odds, u/(1-u) : o f/(1-f), o being the document's own odds, and taken
in that order while they fit into the words still due: a sample of fixed size, measured in words. A document
that doesn't fit is passed over, and those behind it that fit go on, for ROUNDS rounds.

Places in the order are made in two steps, bins of the rank and then rows of a bin, and a round looks into one bin of
a source: a source with a third of all rows is spread over as many tasks as it has bins, the square root of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, documents, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"
#: Documents that don't fit are passed over so often.
ROUNDS = 6
END = (1 << 63) - 1


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5 of the seed and the key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: source, source_rows, source_size, weight, target. ``sizes`` has source and size.

    Sources take the weights in turn, by code point and null last. A target is the source's share by weight
    of all sizes, at most ``max_copies`` times its size; the excess is shared again by weight. The level that
    this comes to is found in one pass: sources in the order of cap to weight are capped until the rest fit, and every
    later level is lower.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", F.col("source_size") * max_copies).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "turn")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    by = by.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.col("capped")) / F.col("open"))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole), F.max("ratio").over(whole))
    return by.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_rows", "source_size", "weight", "target")


def _passed(ordered: DataFrame, state: DataFrame) -> DataFrame:
    """One round: source, due and stop after it, and its range (after, stop, most) of places and sizes taken.

    Those behind the last stop whose size is within what is due are taken until the first that doesn't fit.
    """
    fits = ordered.alias("d").join(state.select("source", "due", "stop").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    fits = fits.select("d.*", "due", "stop").filter("size > 0 and size <= due and pos > stop")
    bins = fits.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    due = state.select("source", "due").alias("s")
    bins = bins.alias("b").join(due, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "due")
    # the bin in which the words due run out, if one does; all words before it, or of all bins
    cut = bins.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("due"), F.col("bin"))).alias("bin"), F.max(F.when(F.col("upto") <= F.col("due"), F.col("upto"))).alias("before"))
    cut = cut.select("source", "bin", F.coalesce("before", F.lit(0)).alias("before"))
    inside = fits.alias("f").join(cut.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.bin") == F.col("c.bin"))).select("f.*", "before")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    stop = inside.filter("upto > due").groupBy("source").agg(F.min(F.struct("pos", (F.col("upto") - F.col("size")).alias("taken"))).alias("x"))
    found = state.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").join(stop.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    taken = F.coalesce("x.taken", "before", F.lit(0))
    return found.select("s.source", (F.col("due") - taken).alias("due"), F.coalesce("x.pos", F.lit(END)).alias("stop"), F.concat("ranges", F.array(F.struct(F.col("stop").alias("after"), F.coalesce("x.pos", F.lit(END)).alias("stop"), F.col("due").alias("most")))).alias("ranges"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, odds_col: str | None = None, by_size: bool = False, bin_rows: int | None = None
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0). ``odds_col`` multiplies a document's inclusion odds (null: 1), and so
    does the root of its size with ``by_size``. A source's taken words are at most its target, and short of it by less than the
    last document passed over, or all that the target holds beyond whole copies is taken. Equal ranks
    (repeated doc_ids) are ordered by doc_id, then size; rows equal in both are interchangeable. A null doc_id draws
    one fixed number. Empty documents are never taken; no rows give none; other columns are ignored.
    """
    odds = F.coalesce(docs[odds_col].cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0)
    sizes = docs.select("doc_id", "source", F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"), odds.alias("odds"))
    if by_size:
        sizes = sizes.withColumn("odds", F.col("odds") * F.sqrt("size"))
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, weights, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    f = F.col("due") / F.greatest(F.col("source_size"), F.lit(1))
    targets = targets.withColumn("inclusion", F.when(f > 0, f / (1 - f)).otherwise(1.0))
    means = sizes.groupBy("source").agg(F.avg("odds").alias("mean_odds"))  # only bins depend on it
    targets = targets.alias("t").join(means.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source"))).select("t.*", F.greatest("mean_odds", F.lit(1e-9)).alias("mean_odds"))
    targets = stored(targets, "targets")
    rows = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_rows", "source_size", "target", "whole", "inclusion", "mean_odds")
    rows = rows.withColumn("u", unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("rank", F.when(F.col("odds") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("odds") * F.col("inclusion"))).otherwise(F.lit(float("inf"))))
    scaled = F.col("rank") * F.col("inclusion") * F.col("mean_odds")
    n_bins = F.ceil(F.col("source_rows") / bin_rows) if bin_rows else F.ceil(F.sqrt("source_rows"))
    rows = rows.withColumn("bin", F.floor(F.when(scaled < 1e300, scaled / (1 + scaled)).otherwise(1.0) * n_bins))
    bins = rows.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bins = bins.select("source", "bin", before.alias("before"))
    # bins grow with the rows: a merge join at every size
    rows = rows.alias("r").join(bins.alias("b").hint("merge"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin"))).select("r.*", "before")
    pos = F.col("before") + F.row_number().over(Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size"))
    ordered = stored(rows.select("doc_id", "source", "size", "source_size", "target", "whole", "bin", pos.alias("pos")), "ordered")
    state = targets.select("source", "due", F.lit(0).cast("long").alias("stop"), F.lit([]).cast("array<struct<after:bigint,stop:bigint,most:double>>").alias("ranges"))
    for _ in range(ROUNDS):
        state = stored(_passed(ordered.select("source", "bin", "pos", "size"), state), "passed")
    out = ordered.alias("d").join(state.select("source", "ranges").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "ranges")
    more = F.exists("ranges", lambda r: (F.col("pos") > r["after"]) & (F.col("pos") < r["stop"]) & (F.col("size") <= r["most"]))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), by_size=True).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][turn % 3 + 1]::BIGINT AS weight, source_size * 3 AS cap, (source_size * 3)::DOUBLE / [5, 2, 1][turn % 3 + 1] AS ratio FROM s
), v AS (
  SELECT *, ((sum(source_size) OVER ()) - (sum(cap) OVER (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap))::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(max(level) FILTER (level <= ratio) OVER (), max(ratio) OVER ()) * weight) AS target FROM v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, target - whole * source_size AS due, (target - whole * source_size) / greatest(source_size, 1) AS f FROM e
), p AS MATERIALIZED (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.whole,
         row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size > 0 THEN (u / (1 - u)) / (sqrt(size) * CASE WHEN f > 0 THEN f / (1 - f) ELSE 1.0 END) ELSE 'inf'::DOUBLE END, doc_id, size) AS pos
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), s0 AS (
  SELECT source, due, 0::BIGINT AS stop FROM q
""" + "".join(
    f"""), c{i} AS MATERIALIZED (
  SELECT p.source, p.pos, s.due, sum(p.size) OVER (PARTITION BY p.source ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM p JOIN s{i - 1} s ON p.source IS NOT DISTINCT FROM s.source WHERE p.size > 0 AND p.size <= s.due AND p.pos > s.stop
), s{i} AS MATERIALIZED (
  SELECT s.source, any_value(s.due) - coalesce(max(c.upto) FILTER (c.upto <= c.due), 0)::DOUBLE AS due, coalesce(min(c.pos) FILTER (c.upto > c.due), {END}) AS stop
  FROM s{i - 1} s LEFT JOIN c{i} c ON s.source IS NOT DISTINCT FROM c.source GROUP BY s.source
"""
    for i in range(1, ROUNDS + 1)
) + "), x AS (" + " UNION ALL ".join(f"SELECT source, pos FROM c{i} WHERE upto <= due" for i in range(1, ROUNDS + 1)) + """)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN whole + CASE WHEN x.pos IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken
FROM p LEFT JOIN x ON p.source IS NOT DISTINCT FROM x.source AND p.pos = x.pos
"""
