"""Strategy evaluation: score bands, exact quantiles, Wilson intervals, profit factors, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Lower bounds of the score bands (fixed values; the middle two are the strategy's thresholds).
BANDS = [(0.0, "IGNORE"), (40.0, "WATCHING"), (60.0, "INTERESTING"), (75.0, "STRONG"), (90.0, "HIGH_CONVICTION")]
QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}
Z95 = 1.96
FEW = 1 << 20  # distinct values that are ordered without being cut into ranges first
PIECES = 64  # ranges that a group's values are cut into


def band(score: Column) -> Column:
    """Name of the half-open band; null below the first."""
    out = F.lit(None).cast("string")
    for low, name in BANDS:
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def coverage_bucket(coverage: Column) -> Column:
    return F.when(coverage < 0.5, "<0.5").when(coverage < 0.8, "0.5-0.8").when(coverage >= 0.8, ">=0.8")


def _placed(values: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, _v, _n: a distinct value and for how many rows it stands) with how many rows of the group have smaller values (_before) and its size (_size).

    Few values, counted, are ordered by group. Of more, a group is cut into ranges at approximate quantiles (a sketch of bounded
    size, combined before it is shuffled): counts add up within a range, and over the few ranges of a group, so no task
    orders all values of a group.
    """
    lower = lambda x, over: F.coalesce(F.sum(x).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    if values.count() <= FEW:
        return values.withColumns({"_before": lower("_n", Window.partitionBy(*by).orderBy("_v")), "_size": F.sum("_n").over(Window.partitionBy(*by))})
    points = F.array(*(F.lit(k / PIECES) for k in range(1, PIECES)))
    cuts = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", points, 100 * PIECES)).alias("_cuts"))
    # a row a group
    ranged = _beside(values, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_total"))
    group = Window.partitionBy(*by)
    starts = totals.select(*by, "_range", lower("_total", group.orderBy("_range")).alias("_start"), F.sum("_total").over(group).alias("_size"))
    local = ranged.withColumn("_before", lower("_n", Window.partitionBy(*by, "_range").orderBy("_v")))
    return _beside(local, starts, [*by, "_range"]).withColumn("_before", F.col("_start") + F.col("_before")).drop("_start", "_range")


def _values(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Distinct values by group, counted and kept."""
    return stored(rows.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_v")).agg(F.count("*").alias("_n")))


def quantiles(rows: DataFrame, by: list[str], x: str, points: dict[str, float] = QUANTILES) -> DataFrame:
    """Exact quantiles by group, interpolated between neighbours; null without values."""
    found = _placed(_values(rows.select(*by, F.col(x).cast("double").alias(x)), by, x), by)
    holds = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))
    place = {name: (F.col("_size") - 1) * q for name, q in points.items()}
    ends = found.groupBy(*by).agg(F.max("_size").alias("_size"), *(holds(f(p)).alias(f"_{side}{name}") for name, p in place.items() for side, f in (("a", F.floor), ("b", F.ceil))))
    between = lambda name: F.col(f"_a{name}") + (F.col(f"_b{name}") - F.col(f"_a{name}")) * (place[name] - F.floor(place[name]))
    return ends.select(*by, *(between(name).alias(name) for name in points))


def distribution(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Count, extremes, mean and exact quantiles of each group."""
    whole = rows.groupBy(*by).agg(F.count(x).alias("measured"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.avg(x).alias("mean"))
    return _beside(whole, quantiles(rows, by, x), by)


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """A left join of tables with a row a group; null groups meet."""
    met = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]  # without groups, one row
    return left.alias("l").join(right.alias("r"), met, "left").select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in by))


def wilson(wins: Column, n: Column) -> tuple[Column, Column, Column]:
    """Win rate and its 95 % Wilson interval, within [0, 1]; null without cases."""
    p = F.try_divide(wins.cast("double"), n.cast("double"))
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return p, F.when(some, F.greatest(centre - half, F.lit(0.0))), F.when(some, F.least(centre + half, F.lit(1.0)))


def profit_factor(gain: Column, loss: Column, n: Column) -> tuple[Column, Column]:
    """Factor, and its state: none (no cases), flat (neither gain nor loss), infinite (no loss) or finite."""
    state = F.when(n == 0, "none").when((loss == 0) & (gain == 0), "flat").when(loss == 0, "infinite").otherwise("finite")
    return F.when(state == "finite", F.try_divide(gain, loss)), state


def cells(samples: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """Statistics of each cell; only cells with samples appear."""
    gain, loss = F.when(F.col("return_pct") > 0, F.col("return_pct")), F.when(F.col("return_pct") <= 0, -F.col("return_pct"))
    x = "return_pct"
    # by token first: tokens are counted without another pass
    parts = samples.groupBy(*by, "token_id").agg(F.count("*").alias("n"), F.count(x).alias("measured"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.sum(x).alias("_sum"), F.count_if(F.col(x) > 0).alias("wins"), F.sum(gain).alias("_gain"), F.sum(loss).alias("_loss"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    rows = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.count("token_id").alias("tokens"), F.sum("measured").alias("measured"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.try_divide(F.sum("_sum"), F.sum("measured")).alias("mean"), F.sum("wins").alias("wins"), zero("_gain"), zero("_loss"))
    # the three figures' values in one table
    names = {"return_pct": "r", "max_runup_pct": "u", "max_drawdown_pct": "d"}
    values = samples.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("_of"), F.col(c).alias("_x")) for c, k in names.items()))).alias("_s")).select(*by, "_s.*")
    points = quantiles(values, [*by, "_of"], "_x")
    wide = points.groupBy(*by).agg(*(F.max(F.when(F.col("_of") == "r", F.col(q))).alias(q) for q in QUANTILES), *(F.max(F.when(F.col("_of") == k, F.col("median"))).alias(c) for c, k in (("median_runup", "u"), ("median_drawdown", "d"))))
    rows = _beside(rows, wide, by)
    rate, low, high = wilson(F.col("wins"), F.nullif(F.col("measured"), F.lit(0).cast("long")))
    factor, state = profit_factor(F.col("_gain"), F.col("_loss"), F.col("measured"))
    return rows.withColumns({"sufficient": F.col("measured") >= least, "win_rate": rate, "win_low": low, "win_high": high, "profit_factor": factor, "profit_state": state}).drop("_gain", "_loss")


def exclusions(samples: DataFrame, by: list[str]) -> DataFrame:
    """Samples without a return by reason, unknown where none is given."""
    return samples.filter(F.col("return_pct").isNull()).groupBy(*by, F.coalesce("failure_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def average_rank(rows: DataFrame, by: list[str], x: str, to: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean; null for null.

    Counted by distinct value and joined back, so that ties are no hot spot.
    """
    ranks = _placed(_values(rows, by, x), by).select(*by, F.col("_v").alias(x), (F.col("_before") + (F.col("_n") + 1) / 2).alias(to))
    return _beside(rows, ranks, [*by, x])


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of the pairs without nulls: n and rho; null below three pairs or with a constant side."""
    some = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    # equal pairs have equal ranks and travel as one
    ranked = stored(some.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w")))
    few = ranked.count() <= FEW
    for c in ("_x", "_y"):
        rank = f"_r{c}"
        if few:  # counted: rows up to the value, less half of those that share it
            order = Window.partitionBy(*by).orderBy(c).rangeBetween(Window.unboundedPreceding, 0)
            ranked = ranked.withColumn(rank, F.sum("_w").over(order) - (F.sum("_w").over(Window.partitionBy(*by, c)) - 1) / 2)
        else:
            values = stored(ranked.groupBy(*by, F.col(c).alias("_v")).agg(F.sum("_w").alias("_n")))
            ranked = _beside(ranked, _placed(values, by).select(*by, F.col("_v").alias(c), (F.col("_before") + (F.col("_n") + 1) / 2).alias(rank)), [*by, c])
    w, a, b = F.col("_w").cast("double"), F.col("_r_x"), F.col("_r_y")
    sums = ranked.groupBy(*by).agg(F.sum("_w").alias("n"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"), F.sum(w * a * b).alias("_ab"))
    n = F.col("n").cast("double")
    mean = (n + 1) / 2  # of ranks from 1 to n
    cov, va, vb = (F.col(c) / n - mean * mean for c in ("_ab", "_aa", "_bb"))
    flat = (va <= 1e-13 * n * n) | (vb <= 1e-13 * n * n)
    return sums.select(*by, "n", F.when((F.col("n") >= 3) & ~flat, cov / F.sqrt(va * vb)).alias("rho"))


def feature_contribution(samples: DataFrame, features: str, horizon: str = "horizon") -> DataFrame:
    """For each feature name and horizon: pairs, samples that measured the feature, rho; a name that a sample lacks is unmeasured.

    ``features`` is a map of names to doubles.
    """
    measured = samples.filter(F.col("return_pct").isNotNull()).select(horizon, "return_pct", features)
    # the total of a horizon is a name of its own, so samples are read once for both
    named = measured.select(horizon, F.explode(F.array_append(F.map_keys(features), F.lit(None).cast("string"))).alias("feature")).groupBy(horizon, "feature").agg(F.count("*").alias("total"))
    totals = named.filter("feature IS NULL").select(horizon, "total")
    names = named.filter("feature IS NOT NULL").groupBy().agg(F.collect_set("feature").alias("names"))  # one row
    wanted = totals.crossJoin(F.broadcast(names)).select(horizon, "total", F.explode("names").alias("feature"))
    pairs = measured.select(horizon, "return_pct", F.explode(features).alias("feature", "value"))
    rho = spearman(pairs, [horizon, "feature"], "value", "return_pct")
    return wanted.join(rho, [horizon, "feature"], "left").select(horizon, "feature", "total", F.coalesce("n", F.lit(0)).alias("measured"), "rho")
