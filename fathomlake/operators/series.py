"""Time-series operators: probabilities, transitions, runs, resampling, windows.

Series are partitioned by keys (``by``); a series without a key is one partition, as its order demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import global_ranks

SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def period(time: Column, kind: str) -> Column:
    """month, season, year or doy of a time."""
    if kind == "season":
        out = F.lit(None).cast("string")
        for name, months in SEASONS.items():
            out = F.when(F.month(time).isin(*months), name).otherwise(out)
        return out
    return {"month": F.month, "year": F.year, "doy": F.dayofyear}[kind](time)


def probabilities(df: DataFrame, label: str, time: str | None = None, kind: str | None = None) -> DataFrame:
    """probability of each label, or of each label within each month, season, year or day of the year."""
    by = [period(F.col(time), kind).alias(kind)] if kind else []
    n = df.groupBy(*by, F.col(label)).count()
    whole = Window.partitionBy(kind) if kind else Window.partitionBy(F.lit(1))
    return n.select(*([kind] if kind else []), label, (F.col("count") / F.sum("count").over(whole)).alias("probability"))


def probability_table(df: DataFrame, label: str, labels: list, time: str, kind: str) -> DataFrame:
    """The same with a column for each of the given labels, 0 where it never occurs."""
    wide = df.groupBy(period(F.col(time), kind).alias(kind)).pivot(label, labels).count().fillna(0)
    total = sum((F.col(f"`{x}`") for x in labels[1:]), F.col(f"`{labels[0]}`"))
    return wide.select(kind, *[(F.col(f"`{x}`") / total).alias(f"p_{x}") for x in labels])


def fixed_set_probabilities(df: DataFrame, label: str, labels: list[str], months: list[int] | None = None, time: str | None = None) -> DataFrame:
    """Probability of each label of a fixed set, zero included; within some months on demand."""
    rows = df.filter(F.month(time).isin(*months)) if months else df
    n = rows.groupBy(label).count()
    domain = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    joined = domain.join(F.broadcast(n), label, "left").fillna(0, ["count"])
    return joined.select(label, F.coalesce(F.try_divide(F.col("count"), F.sum("count").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("probability"))


def transitions(df: DataFrame, label: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """prev, cur, n, probability of cur after prev; pairs don't cross series."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    pairs = df.select(F.lag(label).over(w).alias("prev"), F.col(label).alias("cur")).filter("prev is not null")
    n = pairs.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    return n.select("prev", "cur", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("prev"))).alias("probability"))


def runs(df: DataFrame, label: str, order: list[str], by: list[str]) -> DataFrame:
    """by, run, label, start, end (values of the first order column), length: stretches of one label."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(*by, "run").agg(F.first(label).alias(label), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("length"))


def persistences(df: DataFrame, label: str, order: list[str], by: list[str]) -> DataFrame:
    """Runs without the last of each series, whose length is cut by the series' end."""
    last = F.max("run").over(Window.partitionBy(*by))
    return runs(df, label, order, by).withColumn("__last", last).filter("run < __last").drop("__last")


def repeated_values(df: DataFrame, label: str, order: list[str], by: list[str]) -> DataFrame:
    """Runs of two rows or more."""
    return runs(df, label, order, by).filter("length >= 2")


def running_mean(df: DataFrame, value: str, order: list[str], by: list[str], m: int, pad: str = "edge") -> DataFrame:
    """Centred mean of 2m + 1 rows; beyond the ends stand the end values (edge), zeros, ones or the series' mean."""
    part = Window.partitionBy(*by)
    w = part.orderBy(*order)
    near = w.rowsBetween(-m, m)
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(part)
    left, right = F.greatest(F.lit(0), m + 1 - k), F.greatest(F.lit(0), k + m - n)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = {"edge": (F.first(value).over(whole), F.last(value).over(whole)), "zeros": (F.lit(0.0),) * 2, "ones": (F.lit(1.0),) * 2, "mean": (F.avg(value).over(part),) * 2}[pad]
    return df.withColumn("running_mean", (F.sum(value).over(near) + left * edge[0] + right * edge[1]) / (2 * m + 1))


def monthly_running_mean(df: DataFrame, value: str, time: str, by: list[str], half: int) -> DataFrame:
    """Running mean within each calendar month across years."""
    w = Window.partitionBy(*by, F.month(time)).orderBy(time).rowsBetween(-half, half)
    return df.withColumn("running_mean", F.avg(value).over(w))


def block_means(df: DataFrame, value: str, time: str, least: int = 1) -> DataFrame:
    """month, mean, median, n of months with ``least`` rows."""
    out = df.groupBy(F.date_trunc("month", time).alias("month")).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n"))
    return out.filter(F.col("n") >= least)


def forward_fill(df: DataFrame, time: str, cols: list[str], step: str, by: list[str]) -> DataFrame:
    """Each row repeated at every ``step`` until the next row of its series; the last row stands once."""
    nxt = F.lead(time).over(Window.partitionBy(*by).orderBy(time))
    stop = F.coalesce(nxt - F.expr("interval 1 microsecond"), F.col(time))
    rows = df.select(*by, time, *cols, stop.alias("__stop"))
    return rows.select(*by, F.explode(F.sequence(F.col(time), F.col("__stop"), F.expr(f"interval {step}"))).alias(time), *cols)


def spine(df: DataFrame, time: str, step: str) -> DataFrame:
    """Regular times from the first to the last of the frame."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(time))


def pad_to_spine(df: DataFrame, time: str, cols: list[str], step: str) -> DataFrame:
    """Reindexed to a regular spine; missing rows take the last value before them."""
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    joined = spine(df, time, step).join(df, time, "left")
    return joined.select(time, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])


def linear_resample(df: DataFrame, time: str, value: str, seconds: int, by: list[str]) -> DataFrame:
    """Values at multiples of ``seconds`` between the rows of each series, on the line between their neighbours."""
    w = Window.partitionBy(*by).orderBy(time)
    at = F.unix_micros(time) / 1e6
    rows = df.select(*by, at.alias("a"), F.col(value).alias("va"), F.lead(at).over(w).alias("b"), F.lead(value).over(w).alias("vb")).filter("b > a")
    first, last = F.ceil(F.col("a") / seconds), F.ceil(F.col("b") / seconds) - 1
    grid = rows.filter(last >= first).select("*", F.explode(F.sequence(first, last)).alias("k"))
    t = F.col("k") * seconds
    return grid.select(*by, F.timestamp_seconds(t).alias(time), (F.col("va") + (F.col("vb") - F.col("va")) * (t - F.col("a")) / (F.col("b") - F.col("a"))).alias(value))


def year_fraction(time: Column) -> Column:
    """Place in the year: day of the year by its length."""
    y = F.year(time)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.dayofyear(time) / F.when(leap, 366).otherwise(365)


def from_matlab(datenum: Column) -> Column:
    """Timestamp of a MATLAB day number."""
    return F.timestamp_micros(F.round((datenum - 719529) * 86400e6).cast("long"))


def hours_since(base: Column, time: Column) -> Column:
    return F.floor((F.unix_micros(time) - F.unix_micros(base)) / 3.6e9).cast("long")


def upcrossing_waves(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """by, wave, height, period (rows): waves between upward crossings of the mean; parts at the ends don't count.

    The mean is added up in the series' order: where it meets a value, its last bit decides on a crossing, and that must not
    depend on the order in which rows arrive.
    """
    part = Window.partitionBy(*by)
    w = part.orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    z = df.withColumn("__z", F.col(value) - F.avg(value).over(whole)).withColumn("__up", F.when(F.signum(F.lead("__z").over(w)) - F.signum("__z") > 0, 1).otherwise(0))
    z = z.withColumn("wave", F.sum("__up").over(w)).withColumn("__n", F.sum("__up").over(part))
    inside = z.filter("wave > 0 and wave < __n")
    return inside.groupBy(*by, "wave").agg((F.max("__z") - F.min("__z")).alias("height"), F.count(F.lit(1)).alias("period"))


def squared_gradient(df: DataFrame, value: str, lat: str, lon: str, by: list[str]) -> DataFrame:
    """Mean squared one-sided differences in both directions, longitudes over cos(lat); 0 at the border."""
    x, y = Window.partitionBy(*by, lat).orderBy(lon), Window.partitionBy(*by, lon).orderBy(lat)
    sides = [F.col(value) - F.lag(value).over(x), F.lead(value).over(x) - F.col(value), F.col(value) - F.lag(value).over(y), F.lead(value).over(y) - F.col(value)]
    c = F.cos(F.radians(F.abs(F.col(lat))))
    g = [F.pow(sides[0] / c, F.lit(2.0)), F.pow(sides[1] / c, F.lit(2.0)), F.pow(sides[2], F.lit(2.0)), F.pow(sides[3], F.lit(2.0))]
    return df.withColumn("gradient", F.coalesce((g[0] + g[1]) / 2 + (g[2] + g[3]) / 2, F.lit(0.0)))


def lagged(df: DataFrame, value: str, lags: dict, key: str, order: list[str]) -> DataFrame:
    """The frame with ``lagged``: each key's value as many of its rows before as ``lags`` says; null for other keys.

    Rows are numbered in two steps and joined by number, so a key's rows aren't sorted in one task. ``order`` starts with a time.
    """
    lag = F.lit(None).cast("long")
    for k, n in lags.items():
        lag = F.when(F.col(key) == k, n).otherwise(lag)
    rows = global_ranks(df.withColumn("__t", F.unix_micros(order[0]).cast("double")), "__t", [key], name="__i", unique=True, then=list(order))
    before = rows.select(F.col(key).alias("__key"), F.col("__i").alias("__j"), F.col(value).alias("lagged"))
    met = rows.withColumn("__want", F.col("__i") - lag).join(before, (F.col(key) == F.col("__key")) & (F.col("__want") == F.col("__j")), "left")
    return met.select(*df.columns, "lagged")


def transition_table(df: DataFrame, label: str, order: list[str], labels: list[str], by: list[str] | None = None) -> DataFrame:
    """prev and a column p_<label> for each label: the whole matrix of chances, 0 where a change never occurs."""
    spark = df.sparkSession
    found = transitions(df, label, order, by).groupBy("prev").agg(*[F.max(F.when(F.col("cur") == x, F.col("probability"))).alias(f"p_{x}") for x in labels])
    return spark.createDataFrame([(x,) for x in labels], "prev string").join(found, "prev", "left").fillna(0.0)


def hourly_unique(df: DataFrame, time: str, by: list[str], order: list[str]) -> DataFrame:
    """Times rounded to the hour; of several rows of an hour the first stays."""
    hour = F.timestamp_micros(F.floor(F.unix_micros(time) / 3.6e9 + 0.5).cast("long") * 3_600_000_000)
    w = Window.partitionBy(*by, "__h").orderBy(*order)
    rows = df.withColumn("__h", hour)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").withColumn(time, F.col("__h")).drop("__h", "__k")


def marked_times(df: DataFrame, time: str, events: DataFrame, event_time: str, name: str = "max_storms") -> DataFrame:
    """An hourly frame with a flag where an event falls into the row's hour."""
    hour = lambda c: F.date_trunc("hour", c)
    hits = events.select(hour(F.col(event_time)).alias("__h")).distinct()
    return df.join(hits, hour(F.col(time)) == F.col("__h"), "left").withColumn(name, F.col("__h").isNotNull()).drop("__h")


def pad_monthly(df: DataFrame, time: str, cols: list[str]) -> DataFrame:
    """Monthly times from the first row's on, as many as months lie between first and last; a month takes the last row not behind it."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    months = (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a")
    axis = ends.filter(months > 0).select("a", F.explode(F.sequence(F.lit(0), months - 1)).alias("k")).select(F.add_months("a", F.col("k")).cast("timestamp").alias("__at"))
    # the last row at or before a month's start is the last one of the months before, or a row of that very time
    both = axis.select(F.col("__at"), *[F.lit(None).alias(c) for c in cols], F.lit(1).alias("__q")).unionByName(df.select(F.col(time).cast("timestamp").alias("__at"), *cols, F.lit(0).alias("__q")), allowMissingColumns=True)
    last = both.filter("__q = 0").groupBy(F.trunc("__at", "month").alias("__m")).agg(F.max_by(F.struct(*cols), "__at").alias("__last"))
    exact = df.select(F.col(time).cast("timestamp").alias("__at"), F.struct(*cols).alias("__exact"))
    w = Window.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)  # one row for each month
    months_held = axis.select(F.trunc("__at", "month").alias("__m"), "__at").join(last, "__m", "left")
    filled = months_held.withColumn("__before", F.last("__last", ignorenulls=True).over(w))
    value = filled.join(exact.dropDuplicates(["__at"]), "__at", "left")
    return value.select(F.col("__at").alias(time), *[F.coalesce(F.col("__exact"), F.col("__before"))[c].alias(c) for c in cols])


def year_cycle(df: DataFrame, time: str) -> DataFrame:
    """day, fraction: every day from the first to the last of the frame, in years of 365.25 days since the first's new year."""
    ends = df.agg(F.min(time).cast("date").alias("a"), F.max(time).cast("date").alias("b"))
    days = ends.filter("a is not null").select("a", F.explode(F.sequence("a", "b")).alias("day"))
    return days.select("day", (F.datediff("day", F.trunc("a", "year")) / 365.25).alias("fraction"))


def generic_year(spark, year: int = 1981, month: int = 1) -> DataFrame:
    """day: the 365 days of a year from a month on."""
    return spark.range(365).select(F.date_add(F.make_date(F.lit(year), F.lit(month), F.lit(1)), F.col("id").cast("int")).alias("day"))


def sampled_line(df: DataFrame, by: list[str], x: str, y: str, step: float) -> DataFrame:
    """by, k, x, y: a broken line at x0, x0 + step, ... before its last x."""
    w = Window.partitionBy(*by).orderBy(x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(*by, F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("ya"), F.lead(F.col(x).cast("double")).over(w).alias("b"), F.lead(F.col(y).cast("double")).over(w).alias("yb"), F.first(F.col(x).cast("double")).over(whole).alias("x0"))
    rows = rows.filter("b > a").withColumn("k0", F.ceil((F.col("a") - F.col("x0")) / step)).withColumn("k1", F.ceil((F.col("b") - F.col("x0")) / step) - 1)
    at = rows.filter("k1 >= k0").withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("at", F.col("x0") + F.col("k") * step)
    return at.select(*by, "k", F.col("at").alias(x), (F.col("ya") + (F.col("yb") - F.col("ya")) * (F.col("at") - F.col("a")) / (F.col("b") - F.col("a"))).alias(y))
