"""Secret scans: pattern rules, and a battery of randomness tests for strings that no rule names.

Candidates are long runs of letters, digits and base-64 signs outside rule matches. For each, the smallest
usual encoding that its characters allow is inferred, and three tests ask whether it could be random text
of that encoding: chi-squared uniformity over the alphabet, a runs test about the alphabet's middle, and
lag-1 serial correlation. A candidate must be under MOST_Z in all three.

The three become one p-value against ordinary text. With u(x) a string's chance as random text of its encoding, w(x)
its chance under a model of words, and q the tests' p-values under randomness, E = u(x) q_chi q_runs q_serial / w(x) has
a mean of at most 1 over ordinary text for each encoding (the q are at most 1), so by Markov's inequality 1 / E, times the
number of encodings as the one was chosen by the text, is a p-value under the word model, whatever the tests' dependence.
The word model has fixed chances of small letters, capitals, digits and signs after each other, as in words, names
and paths, and pairs of letters counted in the short words of every document. The p-values are sorted in
bands of length, and Benjamini and Hochberg's rule in each band bounds the share of false discoveries, whatever the
lengths that the corpus holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, held, let, running, stored, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run is long enough or not, so the least length can stand in the pattern.
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from small to large: pattern and alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z0-9]+$", LOWER + DIGITS),
    ("^[A-Z0-9]+$", UPPER + DIGITS),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/-_"),
)
SIGNS = "/-_+"
#: Chances of a small letter, a capital, a digit and a sign in ordinary long words, names and paths, by what comes before.
CLASS_CHANCES = {
    "start": (0.62, 0.28, 0.06, 0.04),
    "lower": (0.90, 0.04, 0.02, 0.04),
    "capital": (0.80, 0.14, 0.02, 0.04),
    "capitals": (0.05, 0.85, 0.04, 0.06),
    "digit": (0.06, 0.05, 0.79, 0.10),
    "sign": (0.45, 0.13, 0.22, 0.20),
}
SIGN_CHANCES = (0.3, 0.3, 0.3, 0.1)
#: Weights of the counted pairs, the counted letters and equal chances in the chance of a letter after another.
PAIR_WEIGHTS = (0.7, 0.2, 0.1)
#: A test statistic beyond this number of standard deviations is against randomness (0.1 % for three tests).
MOST_Z = 3.4
FALSE_DISCOVERIES = 0.001
#: p-values are binned by tenths of a power of ten, at most so many bins.
BINS = 3000
#: Lower ends of the bands of length.
LENGTHS = (16, 20, 24, 32, 48, 96)


def _no_spans() -> Column:
    return F.lit([]).cast("array<struct<start:int,end:int>>")


def match_spans(text: Column, pattern: str, keep, group: int = 0) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches whose group passes ``keep``."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    fits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), keep)

    def spans(m: Column) -> Column:
        ends = running(F.zip_with(F.slice(m["gaps"], 1, F.size(m["sizes"])), m["sizes"], lambda g, n: g + n), lambda a, b: a + b)
        found = F.zip_with(F.arrays_zip(ends.alias("end"), m["sizes"].alias("size")), m["fits"], lambda x, ok: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end"), ok.alias("ok")))
        return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(F.struct(gaps.alias("gaps"), sizes.alias("sizes"), fits.alias("fits")), spans)).otherwise(_no_spans())


def free_spans(seen: Column, rules: Column) -> Column:
    """Spans of ``seen`` (none of which overlap) that overlap none of ``rules``: one sorted list, each against the largest end before it and its follower's start."""
    listed = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def pick(order: Column) -> Column:
        ends = running(F.transform(order, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        clear = lambda e: F.filter(
            F.transform(order, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), ((x["kind"] == 1) & (F.get(e, i) <= x["start"]) & ~F.coalesce((F.get(order, i + 1)["kind"] == 0) & (F.get(order, i + 1)["start"] < x["end"]), F.lit(False))).alias("free"))),
            lambda x: x["free"],
        )
        return F.transform(let(ends, clear), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when((F.size(seen) == 0) | (F.size(rules) == 0), seen).otherwise(let(F.sort_array(F.concat(listed(rules, 0), listed(seen, 1))), pick))


def letter_pairs(docs: DataFrame) -> dict[str, int]:
    """Counts of neighbouring letters (small; a space before the first) in the short words of the whole documents: at most 702. Words are counted first, then each word's pairs."""
    letters = F.regexp_replace(F.regexp_replace(text_of(docs), CANDIDATE, " "), "[^A-Za-z]+", " ")
    words = docs.select(F.explode(F.split(F.lower(letters), " ")).alias("word")).filter("word != ''").groupBy("word").count()
    pairs = words.select(F.explode(F.regexp_extract_all(F.concat(F.lit(" "), "word"), F.lit("(?=([a-z ][a-z]))"), F.lit(1))).alias("pair"), "count")
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").agg(F.sum("count").alias("count")).collect()}


def _table(values: list) -> Column:
    return F.expr(f"array({','.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)})")


def _word_tables(pairs: dict[str, int]) -> tuple[Column, Column, Column, Column]:
    """Class of a code point, its symbol, and log10 chances: of a class by the two classes before, of a symbol in its class by the letter before.

    Classes are small letter, capital, digit, sign, none; symbols are 26 letters, digit, the signs; no letter before is 26.
    """
    classes, symbols = [4] * 128, [26] * 128
    for k, letters in enumerate((LOWER, UPPER, DIGITS, SIGNS)):
        for i, c in enumerate(letters):
            classes[ord(c)], symbols[ord(c)] = k, (i, i, 26, 27 + i)[k]
    after = [("capitals" if two == 1 else "capital") if one == 1 else ("lower", "", "digit", "sign", "start")[one] for one in range(5) for two in range(5)]
    chances = [math.log10(x) for name in after for x in CLASS_CHANCES[name]]
    single = [sum(pairs.get(a + b, 0) for a in LOWER + " ") for b in LOWER]
    every, like = sum(single), []
    for a in LOWER + " ":
        row = [pairs.get(a + b, 0) for b in LOWER]
        known = sum(row)
        for n, m in zip(row, single):
            one = m / every if every else 1 / 26
            like.append(math.log10(PAIR_WEIGHTS[0] * (n / known if known else one) + PAIR_WEIGHTS[1] * one + PAIR_WEIGHTS[2] / 26))
        like += [-1.0, *map(math.log10, SIGN_CHANCES)]
    return _table(classes), _table(symbols), _table(chances), _table(like)


def _word_chance(codes: Column, tables: tuple[Column, Column, Column, Column]) -> Column:
    """log10 of the chance of a string (code points) under the word model."""
    classes, symbols, chances, like = tables
    at = lambda i: F.coalesce(F.get(codes, i), F.lit(0))
    step = lambda c, i: (
        F.get(chances, (F.get(classes, at(i - 1)) * 5 + F.get(classes, at(i - 2))) * 4 + F.get(classes, c))
        + F.get(like, F.least(F.get(symbols, at(i - 1)), F.lit(26)) * 31 + F.get(symbols, c))
    )
    return F.aggregate(F.transform(codes, step), F.lit(0.0), lambda a, x: a + x)


def _tail(z: Column) -> Column:
    """log10 of both upper tails of the normal distribution, 0 below 0: exp(-0.416 z^2 - 0.717 z)."""
    return let(F.greatest(z, F.lit(0.0)), lambda x: -(0.416 * x * x + 0.717 * x) / math.log(10))


def _tests(values: Column, word: Column, text: Column, size: Column) -> Column:
    """struct(random, bin) for a candidate: values are places in the inferred alphabet, size the alphabet's, word log10 of the chance as a word.

    The bin is ten times -log10 of the p-value, rounded down.
    """
    n = F.size(values).cast("double")
    squares = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.pow(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0))))
    free = size - 1
    chi = size / n * squares - n
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    follows = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.when(v * 2 >= size, 1.0).otherwise(0.0))
    runs = F.aggregate(follows, F.lit(1.0), lambda a, x: a + F.when((x["a"] * 2 >= size) != (x["b"] * 2 >= size), 1.0).otherwise(0.0))
    mean_runs = 2 * high * (n - high) / n + 1
    z_runs = (runs - mean_runs) / F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(0.01)))
    serial = let(
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n,
        lambda mean: F.aggregate(follows, F.lit(0.0), lambda a, x: a + (x["a"] - mean) * (x["b"] - mean))
        / F.greatest(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), F.lit(1e-9))
        * F.sqrt(n),
    )
    rated = let(
        F.struct(z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(serial).alias("serial")),
        lambda z: F.struct(
            ((z["chi"] <= MOST_Z) & (z["runs"] <= MOST_Z) & (z["serial"] <= MOST_Z)).alias("random"),
            (_tail(z["chi"]) + _tail(z["runs"]) + _tail(z["serial"]) - n * F.log10(size) - word - math.log10(len(ENCODINGS))).alias("e"),
        ),
    )
    return let(rated, lambda r: F.struct(r["random"].alias("random"), F.greatest(F.least(F.floor(10 * r["e"]), F.lit(BINS)), F.lit(0)).cast("int").alias("bin")))


def battery(text: Column, tables: tuple[Column, Column, Column, Column]) -> Column:
    """struct(random, bin) of a candidate string; ``tables`` are the word model's."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(text.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    coded = let(
        alphabet,
        lambda letters: F.struct(F.transform(chars, lambda c: (F.call_function("instr", letters, c) - 1).cast("double")).alias("v"), let(F.transform(chars, lambda c: F.ascii(c)), lambda codes: _word_chance(codes, tables)).alias("w"), F.length(letters).cast("double").alias("k")),
    )
    return let(coded, lambda s: _tests(s["v"], s["w"], text, s["k"]))


def band_of(length: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(LENGTHS):
        out = F.when(length >= low, k).otherwise(out)
    return out


def discovery_bins(found: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Least bin that counts as a discovery in each band of length (band, bin): at most len(LENGTHS) rows."""
    counts = found.groupBy("band", "bin").count()
    up = Window.partitionBy("band").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("band")
    ranked = counts.withColumn("rank", F.sum("count").over(up)).withColumn("all", F.sum("count").over(whole))
    ok = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("rank") / F.col("all"))
    return {r["band"]: r["bin"] for r in ok.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def secret_scan(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Per row of ``docs``: doc_id, assign, access, hex, random (arrays of spans, code points, end exclusive).

    ``random`` holds what the battery adds outside the others. Null and empty texts have no spans; repeated rows
    are scanned each; no rows give none; other columns are ignored.
    """
    tables = _word_tables(letter_pairs(docs))
    rows = docs.select("doc_id", text_of(docs).alias("__text"))
    rows = rows.select(
        "doc_id",
        "__text",
        held(
            F.struct(
                match_spans(F.col("__text"), ASSIGN, lambda x: F.length(x) >= MIN_ASSIGNED, 2).alias("assign"),
                match_spans(F.col("__text"), ACCESS, lambda x: F.length(x) >= MIN_ACCESS).alias("access"),
                match_spans(F.col("__text"), HEX, lambda x: F.lit(True)).alias("hex"),
                match_spans(F.col("__text"), CANDIDATE, lambda x: F.lit(True)).alias("seen"),
            )
        ).alias("s"),
    )
    rules = F.concat("s.assign", "s.access", "s.hex")
    free = free_spans(F.col("s.seen"), rules)
    rated = F.transform(
        free,
        lambda c: let(
            let(F.substring(F.col("__text"), c["start"] + 1, c["end"] - c["start"]), lambda t: battery(t, tables)),
            lambda t: F.struct(c["start"].alias("start"), c["end"].alias("end"), t["random"].alias("random"), t["bin"].alias("bin"), band_of(c["end"] - c["start"]).alias("band")),
        ),
    )
    rows = stored(rows.select("doc_id", "s.assign", "s.access", "s.hex", F.when(F.size("s.seen") > 0, rated).otherwise(F.lit([])).alias("rated")), "spans")
    least = discovery_bins(rows.select(F.explode("rated").alias("r")).select("r.band", "r.bin"), rate)
    least_of = lambda band: F.coalesce(*[F.when(band == k, v) for k, v in least.items()], F.lit(BINS + 1))
    chosen = F.filter("rated", lambda r: r["random"] & (r["bin"] >= least_of(r["band"])))
    return rows.select("doc_id", "assign", "access", "hex", F.transform(chosen, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("random"))


def span_text(**kinds: Column) -> Column:
    """kind:start:end by start, then kind in the order given, joined by commas."""
    def listed(place: int, name: str) -> Column:
        return F.transform(kinds[name], lambda s: F.struct(s["start"].alias("s"), F.lit(place).alias("k"), F.concat_ws(":", F.lit(name), s["start"], s["end"]).alias("t")))

    return F.array_join(F.transform(F.sort_array(F.concat(*[listed(k, name) for k, name in enumerate(kinds)])), lambda x: x["t"]), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    base = {k: F.col(k) for k in KINDS[:3]}
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(**base), 256).alias("base_sha256"),
        span_text(**base, random=F.col("random")).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
