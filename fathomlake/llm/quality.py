"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to buckets. Two multinomials over the buckets are counted over whole
tables: one of the trusted documents (labelled good), one of the raw corpus. A document's score is the mean
of log p_trusted - log p_raw over its n-grams, so that length cancels; one fixed threshold decides for
every document. Weights are rounded to millionths and summed as integers: the order of rows can't matter.

The trusted multinomial has the corpus as its prior, worth PRIOR n-grams: with few trusted texts the two are alike and the
verdict keeps what the base rules keep. It tells junk from the rest once the trusted texts have about as many n-grams.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPACE, WORD, documents, held, let, text_of, words_of

#: The table of weights has at most this many rows, whatever the corpus: a proven bound for broadcasting.
BUCKETS = 1 << 15
PRIOR = 163_840.0
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SCALE = 1_000_000
#: Places of a text that its words can have: a text is shorter than 2**31 bytes.
PLACE_BITS = 30
PLACES = 1 << PLACE_BITS


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")


def _pair(words: Column, word: Column, i: Column) -> Column:
    """A word and its follower; null for the last."""
    return F.concat(word, F.lit(" "), F.get(words, i + 1))


def features(words: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours."""
    single = F.transform(words, lambda w: bucket_of(w, buckets))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket_of(_pair(words, w, i), buckets))
    return F.concat(single, pairs)


def summed(words: Column, weights: Column, buckets: int) -> Column:
    """Sum of the weights of all words and of all pairs of neighbours; the last word has no pair."""
    of = lambda gram: F.get(weights, bucket_of(gram, buckets))
    return F.aggregate(F.transform(words, lambda w, i: of(w) + F.coalesce(of(_pair(words, w, i)), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more in the text."""

    def met(s: Column, k: Column, same: Callable[[Column], Column]) -> Column:
        return same(F.get(s, k - 1)) | same(F.get(s, k + 1))

    def covered(places: Column) -> Column:
        """Windows with equal words are neighbours in this order."""
        at = let(
            F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))),
            lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: met(s, k, lambda y: y["w"] == x["w"])), lambda x: x["i"])),
        )
        # Each window adds the words that the one before it doesn't cover.
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def shared(hashes: Column) -> Column:
        """Places of windows that share 34 bits of their hash with another: one number holds these bits and the place, so the sort is plain."""
        keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-PLACES)).bitwiseOR(i.cast("long"))))
        found = let(keys, lambda s: F.filter(s, lambda x, k: met(s, k, lambda y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0)))
        return F.transform(found, lambda x: x.bitwiseAND(F.lit(PLACES - 1)).cast("int"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    repeated = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(shared(h), covered)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes, repeated))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features_of(text: str, buckets: int) -> Column:
    return let(words_of(F.col(text)), lambda w: features(w, buckets))


def _counted(docs: DataFrame, buckets: int, name: str) -> DataFrame:
    found = docs.select(F.explode(features_of("__text", buckets)).alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """bucket, weight: the log ratio in millionths, for each bucket that the corpus fills.

    The raw counts are of all rows of ``docs``, the trusted ones of those whose doc_id ``trusted`` has. Without
    trusted documents all weights are 0.
    """
    texts = docs.select("doc_id", text_of(docs).alias("__text"))
    good_ids = trusted.select(F.col("doc_id").alias("__id")).filter("__id is not null").distinct()
    # Labels grow with the corpus: a merge join at every size, never a broadcast.
    good = texts.join(good_ids.hint("merge"), F.col("doc_id") == F.col("__id"), "left_semi")
    counts = _counted(texts, buckets, "raw").join(_counted(good, buckets, "good"), "bucket", "left").fillna(0, ["good"])
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.withColumn("all_raw", F.sum("raw").over(whole)).withColumn("all_good", F.sum("good").over(whole))
    share = F.col("raw") / F.col("all_raw")
    ratio = F.log((F.col("good") + prior * share) / (F.col("all_good") + prior)) - F.log(share)
    return counts.select("bucket", F.round(ratio * SCALE).cast("long").alias("weight"))


def weight_table(weights: DataFrame, buckets: int) -> Column:
    """The weights as one array by bucket, a constant of the plan: ``buckets`` whole numbers, whatever the corpus."""
    known = {r["bucket"]: r["weight"] for r in weights.collect()}
    return F.split(F.lit(",".join(str(known.get(k, 0)) for k in range(buckets))), ",").cast("array<int>")


def quality_rules(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD, min_words: int = MIN_WORDS
) -> DataFrame:
    """Per row of ``docs``: doc_id, the five base counts, base_failed, score, kept.

    Base rules: under ``min_words`` words, or repeated words over half of all words. ``score`` is the mean log ratio
    of the document's words and pairs (0 without words); ``kept`` needs a score of ``threshold`` or more. Null text has
    no words and fails; rows that repeat a doc_id are judged each by their own text; an empty ``trusted`` leaves
    the base rules alone; no rows give none; other columns are ignored.
    """
    table = weight_table(bucket_weights(docs, trusted, buckets, prior), buckets)
    rows = docs.select("doc_id", text_of(docs).alias("__text"))
    rows = rows.select("doc_id", "__text", held(words_of(F.col("__text"))).alias("__words"))
    counts = F.struct(*[c.alias(k) for k, c in base_columns(F.col("__text"), F.col("__words")).items()], summed(F.col("__words"), table, buckets).alias("sum"))
    rows = rows.select("doc_id", held(counts).alias("b")).select("doc_id", "b.*")
    score = F.col("sum") / SCALE / F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = rows.select("doc_id", *BASE, failed.alias("base_failed"), score.alias("score"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), trusted_of(spark, sf_dir)).drop("score")


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), w AS (
  SELECT r, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT r, regexp_extract_all(t, '{WORD}') AS x FROM d)
), n AS (
  SELECT r, pos, word, lead(word) OVER o AS next, lead(word, 2) OVER o AS after FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)
), often AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, word, next, after) AS k FROM n WHERE after IS NOT NULL) WHERE k > 1
), cover AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM often) GROUP BY r
), g AS (
  SELECT r, word AS gram FROM n UNION ALL SELECT r, word || ' ' || next FROM n WHERE next IS NOT NULL
), hexed AS (
  SELECT gram, hex(gram) AS h FROM (SELECT DISTINCT gram FROM g)
), steps AS (
  SELECT gram, [4294967295::BIGINT] || flatten(list_transform(range(len(h) // 2), lambda i: [('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM hexed
), hashed AS (
  SELECT gram, xor(list_reduce(s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM steps
), b AS (
  SELECT g.r, hashed.bucket FROM g JOIN hashed USING (gram)
), good AS (
  SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
), raw AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (r IN (SELECT r FROM good)) AS good FROM b GROUP BY bucket
), total AS (
  SELECT sum(raw)::DOUBLE AS raw, sum(good)::DOUBLE AS good FROM raw
), weight AS (
  SELECT bucket, round((ln((raw.good + {PRIOR} * (raw.raw / total.raw)) / (total.good + {PRIOR})) - ln(raw.raw / total.raw)) * {SCALE})::BIGINT AS weight FROM raw, total
), score AS (
  SELECT r, sum(weight)::BIGINT AS s FROM b JOIN weight USING (bucket) GROUP BY r
), c AS (
  SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(s, 0) / {SCALE}::DOUBLE / greatest(2 * coalesce(k.n_words, 0) - 1, 1) AS score
  FROM d LEFT JOIN (SELECT r, count(*) AS n_words FROM w GROUP BY r) k USING (r) LEFT JOIN dup USING (r) LEFT JOIN cover USING (r) LEFT JOIN score USING (r)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {THRESHOLD} AS kept FROM f
"""
