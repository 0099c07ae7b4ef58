"""Queries of strategy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev

from .measure import PATHS, samples
from .registry import query, six

_BAND = "CASE WHEN alpha >= 90 THEN 'HIGH_CONVICTION' WHEN alpha >= 75 THEN 'STRONG' WHEN alpha >= 60 THEN 'INTERESTING' WHEN alpha >= 40 THEN 'WATCHING' WHEN alpha >= 0 THEN 'IGNORE' END"
_BUCKET = "CASE WHEN coverage < 0.5 THEN '<0.5' WHEN coverage < 0.8 THEN '0.5-0.8' ELSE '>=0.8' END"
_STATS = ["lowest", "highest", "mean", "p10", "p25", "median", "p75", "p90", "win_rate", "win_low", "win_high", "profit_factor", "median_runup", "median_drawdown"]


def _cells(by: str, source: str) -> str:
    return f""", g AS (SELECT {by}, count(*) AS n, count(DISTINCT token_id) AS tokens, count(return_pct) AS measured, min(return_pct) AS lowest, max(return_pct) AS highest, avg(return_pct) AS mean,
    quantile_cont(return_pct, 0.1) AS p10, quantile_cont(return_pct, 0.25) AS p25, quantile_cont(return_pct, 0.5) AS median, quantile_cont(return_pct, 0.75) AS p75, quantile_cont(return_pct, 0.9) AS p90,
    count(*) FILTER (return_pct > 0) AS wins, coalesce(sum(return_pct) FILTER (return_pct > 0), 0) AS gain, coalesce(-sum(return_pct) FILTER (return_pct <= 0), 0) AS loss,
    quantile_cont(max_runup_pct, 0.5) AS median_runup, quantile_cont(max_drawdown_pct, 0.5) AS median_drawdown FROM {source} GROUP BY {by}),
    q AS (SELECT *, CASE WHEN measured > 0 THEN wins / CAST(measured AS DOUBLE) END AS win_rate FROM g),
    z AS (SELECT *, measured >= 30 AS sufficient, (win_rate + 3.8416 / (2 * measured)) / (1 + 3.8416 / measured) AS centre, 1.96 * sqrt(win_rate * (1 - win_rate) / measured + 3.8416 / (4 * measured * measured)) / (1 + 3.8416 / measured) AS half,
          CASE WHEN measured = 0 THEN 'none' WHEN loss = 0 AND gain = 0 THEN 'flat' WHEN loss = 0 THEN 'infinite' ELSE 'finite' END AS profit_state FROM q),
    y AS (SELECT *, CASE WHEN measured > 0 THEN greatest(centre - half, 0) END AS win_low, CASE WHEN measured > 0 THEN least(centre + half, 1) END AS win_high, CASE WHEN profit_state = 'finite' THEN gain / loss END AS profit_factor FROM z)
    SELECT {by}, n, tokens, measured, wins, sufficient, profit_state, {", ".join(f"round({c}, 6) AS {c}" for c in _STATS)} FROM y"""


@query(PATHS + f", b AS (SELECT *, {_BAND} AS band FROM samples)" + _cells("band, horizon", "b"))
def band_horizon(v):
    """The flagship: return statistics of every score band and horizon."""
    return ev.cells(samples(v).withColumn("band", ev.band(F.col("alpha"))), ["band", "horizon"]).withColumns(six(*_STATS))


@query(PATHS + f", b AS (SELECT *, {_BUCKET} AS bucket FROM samples WHERE horizon = '4h')" + _cells("bucket", "b"))
def by_coverage(v):
    return ev.cells(samples(v).filter("horizon = '4h'").withColumn("bucket", ev.coverage_bucket(F.col("coverage"))), ["bucket"]).withColumns(six(*_STATS))


@query(PATHS + " SELECT signal_id, token_id, version, horizon, alpha, round(return_pct, 6) AS return_pct FROM samples WHERE version = 'v1' AND horizon = '1h' AND t >= 1704500000000000")
def eval_samples(v):
    return samples(v).filter("version = 'v1' AND horizon = '1h' AND start >= 1704500000000000").select("signal_id", "token_id", "version", "horizon", "alpha", F.round("return_pct", 6).alias("return_pct"))


@query(f"SELECT signal_id, {_BAND} AS band FROM signals")
def score_bands(v):
    return v.signals.select("signal_id", ev.band(F.col("alpha")).alias("band"))


@query(f"SELECT signal_id, {_BUCKET} AS bucket FROM signals")
def coverage_buckets(v):
    return v.signals.select("signal_id", ev.coverage_bucket(F.col("coverage")).alias("bucket"))


@query(PATHS + """ SELECT horizon, count(return_pct) AS measured, round(min(return_pct), 6) AS lowest, round(max(return_pct), 6) AS highest, round(avg(return_pct), 6) AS mean, round(quantile_cont(return_pct, 0.1), 6) AS p10,
    round(quantile_cont(return_pct, 0.25), 6) AS p25, round(quantile_cont(return_pct, 0.5), 6) AS median, round(quantile_cont(return_pct, 0.75), 6) AS p75, round(quantile_cont(return_pct, 0.9), 6) AS p90 FROM samples GROUP BY horizon""")
def distribution(v):
    return ev.distribution(samples(v), ["horizon"], "return_pct").withColumns(six("lowest", "highest", "mean", *ev.QUANTILES))


@query("""SELECT l_returnflag, round(w / n, 6) AS win_rate, round(greatest((w / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(w / n * (1 - w / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 6) AS win_low,
    round(least((w / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(w / n * (1 - w / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1), 6) AS win_high
    FROM (SELECT l_returnflag, CAST(count(*) FILTER (l_discount > 0.05) AS DOUBLE) AS w, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)""")
def win_rate(v):
    rows = v.table("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("w"), F.count("*").alias("n"))
    rate, low, high = ev.wilson(F.col("w"), F.col("n"))
    return rows.select("l_returnflag", F.round(rate, 6).alias("win_rate"), F.round(low, 6).alias("win_low"), F.round(high, 6).alias("win_high"))


@query("""SELECT c_mktsegment, CASE WHEN loss = 0 AND gain = 0 THEN 'flat' WHEN loss = 0 THEN 'infinite' ELSE 'finite' END AS state, round(CASE WHEN loss > 0 THEN gain / loss END, 6) AS factor FROM
    (SELECT c_mktsegment, coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0) AS gain, coalesce(-sum(c_acctbal) FILTER (c_acctbal <= 0), 0) AS loss FROM customer GROUP BY 1)""")
def profit_factor(v):
    x = F.col("c_acctbal")
    rows = v.table("customer").groupBy("c_mktsegment").agg(F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("gain"), F.coalesce(F.sum(F.when(x <= 0, -x)), F.lit(0.0)).alias("loss"), F.count("*").alias("n"))
    factor, state = ev.profit_factor(F.col("gain"), F.col("loss"), F.col("n"))
    return rows.select("c_mktsegment", state.alias("state"), F.round(factor, 6).alias("factor"))


@query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank FROM part")
def avg_rank(v):
    return ev.average_rank(v.table("part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "rank").select("p_partkey", F.col("rank").cast("double").alias("rank"))


_RHO = """r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM d)"""


@query(f", d AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), {_RHO} SELECT g AS l_returnflag, count(*) AS n, round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 6) AS rho FROM r GROUP BY g")
def spearman(v):
    return ev.spearman(v.table("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumns(six("rho"))


_FEATURES = """f AS (SELECT horizon, return_pct, unnest(['age', 'coverage', 'noise']) AS feature, unnest([CASE WHEN signal_id % 3 = 0 THEN NULL ELSE alpha END, coverage, CASE WHEN signal_id % 2 = 0 THEN CAST(signal_id % 31 AS DOUBLE) END]) AS value FROM samples WHERE return_pct IS NOT NULL),
    d AS (SELECT concat(horizon, '|', feature) AS g, value AS x, return_pct AS y FROM f WHERE value IS NOT NULL)"""


@query(PATHS + f", {_FEATURES}, {_RHO}, k AS (SELECT g, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM r GROUP BY g)" + """
    SELECT t.horizon, t.feature, t.total, coalesce(k.n, 0) AS measured, round(k.rho, 6) AS rho FROM (SELECT horizon, feature, count(*) AS total FROM f GROUP BY 1, 2) t LEFT JOIN k ON k.g = concat(t.horizon, '|', t.feature)""")
def feature_contribution(v):
    values = F.create_map(F.lit("age"), F.when(F.col("signal_id") % 3 != 0, F.col("alpha")), F.lit("coverage"), F.col("coverage"), F.lit("noise"), F.when(F.col("signal_id") % 2 == 0, (F.col("signal_id") % 31).cast("double")))
    return ev.feature_contribution(samples(v).withColumn("features", values), "features").withColumns(six("rho"))


@query(PATHS + f", b AS (SELECT *, {_BAND} AS band FROM samples) SELECT band, horizon, coalesce(failure_reason, 'unknown') AS reason, count(*) AS n FROM b WHERE return_pct IS NULL GROUP BY 1, 2, 3")
def exclusions(v):
    return ev.exclusions(samples(v).withColumn("band", ev.band(F.col("alpha"))), ["band", "horizon"])


@query(PATHS + " SELECT count(*) FILTER (failure_reason = 'incomplete_tail_coverage') AS uningested, count(*) AS n, round(100.0 * count(*) FILTER (failure_reason = 'incomplete_tail_coverage') / count(*), 6) AS pct FROM samples")
def coverage_warning(v):
    lost = F.count_if(F.col("failure_reason") == "incomplete_tail_coverage")
    return samples(v).agg(lost.alias("uningested"), F.count("*").alias("n"), F.round(lost.cast("double") * 100 / F.count("*"), 6).alias("pct"))


@query(PATHS + " SELECT version, horizon, count(*) AS n FROM samples GROUP BY version, horizon ORDER BY version, min(span)")
def horizons_present(v):
    return samples(v).groupBy("version", "horizon").agg(F.count("*").alias("n"), F.min("span").alias("span")).orderBy("version", "span").drop("span")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events")
def components_map(v):
    """An array of name and value, as JSON, to a map; names without a number stay, as null."""
    raw = F.to_json(F.array(F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").cast("double").alias("raw")), F.struct(F.lit("v").alias("name"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("raw"))))
    entries = F.from_json(raw, "array<struct<name:string,raw:double>>")
    named = F.map_from_entries(F.filter(entries, lambda e: e["name"].isNotNull()))
    return v.table("events").select("event_id", named.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["v"].alias("v"))
