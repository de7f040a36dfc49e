"""Group comparisons (T) and monthly series (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import compare as C
from weftline.operators import temporal as T
from weftline.operators.filters import group_items

from .base import INC, Registry, incidence, table
from .tables import _CLASS, classes

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("y"))


def breadth(spark, sf):
    return incidence(spark, sf).groupBy(F.col("stratum").alias("g"), "unit").agg(F.count("*").alias("breadth"))


_B = f"{INC}, b AS (SELECT stratum AS g, unit, count(*) AS breadth FROM inc GROUP BY ALL), vc AS (SELECT g, breadth AS x, count(*) AS c FROM b GROUP BY ALL)"
_CAL = "cal AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS month)"
_M = f"{_CAL}, cn AS (SELECT o_orderpriority AS g, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS c FROM orders GROUP BY ALL), ser AS (SELECT gs.g, cal.month, coalesce(c, 0) AS count FROM cal CROSS JOIN (SELECT DISTINCT o_orderpriority AS g FROM orders) gs LEFT JOIN cn ON cn.g = gs.g AND cn.month = cal.month)"


def series(spark, sf):
    return T.monthly(orders(spark, sf), "o_orderdate", ["g"])


@R.add("w1_monthly", f"WITH {_CAL}, cn AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS c FROM orders GROUP BY ALL) SELECT month, coalesce(c, 0) AS count, round(avg(coalesce(c, 0)) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM cal LEFT JOIN cn USING (month)")
def w1(spark, sf):
    return T.monthly(orders(spark, sf), "o_orderdate").withColumn("moving", F.round("moving", 6))


@R.add("w2_monthly_panel", f"WITH {_M} SELECT g, month, count FROM ser")
def w2(spark, sf):
    return series(spark, sf).select("g", "month", "count")


@R.add("w3_monthly_item_rates", f"WITH {INC}, n AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT unit) AS n FROM inc GROUP BY ALL) SELECT month, item, count(*) AS count, round(count(*) * 100 / n, 6) AS rate FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, item FROM inc) JOIN n USING (month) GROUP BY month, item, n")
def w3(spark, sf):
    return T.monthly_items(incidence(spark, sf, "o_orderdate"), "o_orderdate").select("month", "item", "count", F.round("rate", 6).alias("rate"))


@R.add("w6_shocks", f"""WITH {_M}, z AS (SELECT *, CASE WHEN count(count) OVER w >= 4 AND stddev_samp(count) OVER w > 0 THEN (count - avg(count) OVER w) / stddev_samp(count) OVER w END AS z FROM ser WINDOW w AS (PARTITION BY g ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT g, month, count, round(z, 6) AS z, coalesce(abs(z) > 2.5, false) AS shock FROM z""")
def w6(spark, sf):
    return T.shocks(series(spark, sf), ["g"]).select("g", "month", "count", F.round("z", 6).alias("z"), "shock")


@R.add("w8_seasonal_means", f"""WITH {_M}, d AS (SELECT g, month(month) AS month_of_year, CASE WHEN count(*) OVER (PARTITION BY g ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN count - (avg(count) OVER (PARTITION BY g ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(count) OVER (PARTITION BY g ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 END AS d FROM ser),
e AS (SELECT g, CAST(month_of_year AS INTEGER) AS month_of_year, avg(d) AS e FROM d GROUP BY ALL) SELECT g, month_of_year, round(e - avg(e) OVER (PARTITION BY g), 6) AS effect FROM e""")
def w8(spark, sf):
    return T.seasonal_means(series(spark, sf), ["g"]).withColumn("effect", F.round("effect", 6))


def _mk(season):
    key = "month(month)" if season else "0"
    return f"""WITH {_M}, s0 AS (SELECT g, {key} AS k, month, count FROM ser), p AS (SELECT a.g, a.k, sum(sign(b.count - a.count)) AS s FROM s0 a JOIN s0 b ON a.g = b.g AND a.k = b.k AND a.month < b.month GROUP BY ALL),
t AS (SELECT g, k, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tied FROM (SELECT g, k, count, count(*) AS c FROM s0 GROUP BY ALL) GROUP BY ALL),
v AS (SELECT t.g, CAST(sum(n) AS BIGINT) AS n, sum(coalesce(s, 0)) AS s, sum(coalesce(s, 0)) / sum(n * (n - 1) / 2) AS tau, sum((n * (n - 1) * (2 * n + 5) - tied) / 18) AS v FROM t LEFT JOIN p ON p.g = t.g AND p.k = t.k GROUP BY ALL)
SELECT g, n, CAST(s AS DOUBLE) AS s, round(tau, 6) AS tau, round((s - sign(s)) / sqrt(v), 6) AS z FROM v"""


@R.add("w10_mann_kendall", _mk(False))
def w10(spark, sf):
    return T.mann_kendall(series(spark, sf), ["g"]).select("g", "n", "s", F.round("tau", 6).alias("tau"), F.round("z", 6).alias("z"))


@R.add("w11_seasonal_mann_kendall", _mk(True))
def w11(spark, sf):
    return T.mann_kendall(series(spark, sf), ["g"], season=F.month("month")).select("g", "n", "s", F.round("tau", 6).alias("tau"), F.round("z", 6).alias("z"))


@R.add("w13_series_summary", f"WITH {_M} SELECT g, min(month) AS first, max(month) AS last, count(*) AS months, round(avg(count), 6) AS mean, round(stddev_samp(count), 6) AS sd FROM ser GROUP BY ALL")
def w13(spark, sf):
    out = T.summary(series(spark, sf), ["g"])
    return out.select("g", "first", "last", "months", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_PART = """yrs AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999), f AS (SELECT o_custkey, min(y) AS a, max(y) AS b, count(*) AS k FROM yrs GROUP BY ALL),
pt AS (SELECT o_custkey, CASE WHEN k = 4 THEN 'Continuous' WHEN k = 1 THEN 'Single Year' WHEN b - a + 1 = k AND b = 1999 THEN 'Entering' WHEN b - a + 1 = k AND a = 1996 THEN 'Leaving' ELSE 'Intermittent' END AS type FROM f)"""


@R.add("w14_participation", f"WITH {_PART} SELECT o_custkey, CAST(y AS INTEGER) AS y, type FROM yrs JOIN pt USING (o_custkey)")
def w14(spark, sf):
    return T.participation(orders(spark, sf), "o_custkey", "y", 1996, 1999)


@R.add("w15_participation_counts", f"WITH {_PART} SELECT CAST(year(o_orderdate) AS INTEGER) AS y, type, count(*) AS units, count(DISTINCT o_custkey) AS entities FROM orders JOIN pt USING (o_custkey) WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY ALL")
def w15(spark, sf):
    kinds = T.participation(orders(spark, sf), "o_custkey", "y", 1996, 1999)
    return orders(spark, sf).join(kinds, ["o_custkey", "y"]).groupBy("y", "type").agg(F.count("*").alias("units"), F.count_distinct("o_custkey").alias("entities"))


@R.add("w17_year_over_year", f"WITH {_M} SELECT a.g, a.month, a.count, b.count AS before, round(CASE WHEN b.count > 0 THEN (a.count - b.count) * 100 / b.count END, 6) AS change FROM ser a LEFT JOIN ser b ON a.g = b.g AND b.month = a.month - INTERVAL 12 MONTH")
def w17(spark, sf):
    return T.year_over_year(series(spark, sf).drop("moving"), ["g"]).select("g", "month", "count", "before", F.round("change", 6).alias("change"))


@R.add("w18_monthly_items", f"WITH {INC} SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, item, count(*) AS n FROM inc WHERE item IN (SELECT item FROM inc GROUP BY ALL ORDER BY count(*) DESC, item LIMIT 3) GROUP BY ALL")
def w18(spark, sf):
    return T.monthly_items(incidence(spark, sf, "o_orderdate"), "o_orderdate", top=3).select("month", "item", F.col("count").alias("n"))


@R.add("t2_breadth_summary", f"WITH {_B} SELECT g, count(*) AS n, median(breadth) AS median, quantile_cont(breadth, .75) - quantile_cont(breadth, .25) AS iqr, round(quantile_cont(breadth, .1), 6) AS p10, round(quantile_cont(breadth, .9), 6) AS p90, round(avg(breadth), 6) AS mean, round(stddev_samp(breadth), 6) AS sd, min(breadth) AS min, max(breadth) AS max FROM b GROUP BY ALL")
def t2(spark, sf):
    out = C.describe(breadth(spark, sf), ["g"], "breadth")
    return out.select("g", "n", "median", "iqr", "min", "max", *[F.round(c, 6).alias(c) for c in ("p10", "p90", "mean", "sd")])


@R.add("t3_ecdf", f"WITH {_B} SELECT g, x, round(sum(c) OVER (PARTITION BY g ORDER BY x) / sum(c) OVER (PARTITION BY g), 6) AS share FROM vc")
def t3(spark, sf):
    return C.ecdf(breadth(spark, sf), "g", "breadth").withColumn("share", F.round("share", 6))


@R.add("t4_lorenz", f"WITH {_B} SELECT g, x, round(sum(c) OVER (PARTITION BY g ORDER BY x) / sum(c) OVER (PARTITION BY g), 6) AS units, round(sum(c * x) OVER (PARTITION BY g ORDER BY x) / sum(c * x) OVER (PARTITION BY g), 6) AS total FROM vc")
def t4(spark, sf):
    out = C.lorenz(breadth(spark, sf), "g", "breadth")
    return out.select("g", "x", F.round("units", 6).alias("units"), F.round("total", 6).alias("total"))


_PAIRS = f"{_B}, gr AS (SELECT a.g AS g1, b.g AS g2, x.x, coalesce(va.c, 0) AS c1, coalesce(vb.c, 0) AS c2 FROM (SELECT DISTINCT g FROM vc) a JOIN (SELECT DISTINCT g FROM vc) b ON a.g < b.g CROSS JOIN (SELECT DISTINCT x FROM vc) x LEFT JOIN vc va ON va.g = a.g AND va.x = x.x LEFT JOIN vc vb ON vb.g = b.g AND vb.x = x.x)"


@R.add("t5_kolmogorov_smirnov", f"WITH {_PAIRS}, k AS (SELECT g1, g2, abs(sum(c1) OVER w / sum(c1) OVER p - sum(c2) OVER w / sum(c2) OVER p) AS gap, c1, c2 FROM gr WINDOW w AS (PARTITION BY g1, g2 ORDER BY x), p AS (PARTITION BY g1, g2)) SELECT g1, g2, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c2) AS BIGINT) AS n2, round(max(gap), 6) AS d FROM k GROUP BY ALL")
def t5(spark, sf):
    return C.kolmogorov_smirnov(breadth(spark, sf), "g", "breadth").select("g1", "g2", "n1", "n2", F.round("d", 6).alias("d"))


@R.add("t6_kruskal", f"""WITH {_B}, vx AS (SELECT x, sum(c) AS t FROM vc GROUP BY ALL), rk AS (SELECT x, t, sum(t) OVER (ORDER BY x) - (t - 1) / 2 AS r FROM vx), s AS (SELECT g, sum(c) AS k, sum(r * c) AS r FROM vc JOIN rk USING (x) GROUP BY ALL), nn AS (SELECT CAST(sum(t) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM vx)
SELECT count(*) AS groups, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * sum(r * r / k) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h FROM s, nn GROUP BY n, ties""")
def t6(spark, sf):
    return C.kruskal(breadth(spark, sf), "g", "breadth").select("groups", "n", F.round("h", 5).alias("h"))


@R.add("t7_cliffs_delta", f"WITH {_B} SELECT a.g AS g1, b.g AS g2, round(sum(a.c * b.c * sign(a.x - b.x)) / sum(a.c * b.c), 6) AS delta FROM vc a JOIN vc b ON a.g < b.g GROUP BY ALL")
def t7(spark, sf):
    return C.cliffs_delta(breadth(spark, sf), "g", "breadth").withColumn("delta", F.round("delta", 6))


@R.add("t11_welch", f"WITH {_B}, a AS (SELECT avg(breadth) AS m, var_samp(breadth) AS v, count(*) AS n FROM b WHERE g = '1-URGENT'), z AS (SELECT avg(breadth) AS m, var_samp(breadth) AS v, count(*) AS n FROM b WHERE g = '5-LOW') SELECT round((a.m - z.m) / sqrt(a.v / a.n + z.v / z.n), 6) AS t, round(pow(a.v / a.n + z.v / z.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(z.v / z.n, 2) / (z.n - 1)), 4) AS df, round((a.m - z.m) / sqrt(((a.n - 1) * a.v + (z.n - 1) * z.v) / (a.n + z.n - 2)), 6) AS cohens_d FROM a, z")
def t11(spark, sf):
    return C.welch(breadth(spark, sf), "g", "breadth", "1-URGENT", "5-LOW").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("cohens_d", 6).alias("cohens_d"))


@R.add("w4_monthly_class_coverage", f"WITH {INC}, {_CLASS}, n AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT unit) AS n FROM inc GROUP BY ALL), k AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, unit, item_group FROM inc JOIN cls USING (item)) SELECT month, item_group AS item, round(count(*) / n, 6) AS rate FROM k JOIN n USING (month) GROUP BY month, item_group, n")
def w4(spark, sf):
    rows = incidence(spark, sf, "o_orderdate").withColumn("month", F.trunc("o_orderdate", "month"))
    n = rows.groupBy("month").agg(F.count_distinct("unit").alias("n"))
    grouped = group_items(rows.select("month", "unit", "item"), classes(spark, sf))
    return grouped.groupBy("month", "item").agg(F.count("*").alias("c")).join(n, "month").select("month", "item", F.round(F.col("c") / F.col("n"), 6).alias("rate"))


@R.add("w5_top_series", f"WITH {_M}, s AS (SELECT g, arg_max(count, month) AS latest, max(count) AS peak, avg(count) AS mean FROM ser GROUP BY ALL) SELECT g, latest, peak, round(mean, 6) AS mean FROM s ORDER BY s.mean DESC, g LIMIT 2")
def w5(spark, sf):
    out = series(spark, sf).groupBy("g").agg(F.max_by("count", "month").alias("latest"), F.max("count").alias("peak"), F.avg("count").alias("m"))
    return out.orderBy(F.desc("m"), "g").limit(2).select("g", "latest", "peak", F.round("m", 6).alias("mean"))


@R.add("w19_month_forms", "SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n FROM orders GROUP BY ALL")
def w19(spark, sf):
    raw = orders(spark, sf).select(F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).alias("ym"), "y", F.month("o_orderdate").alias("m"))
    form = F.coalesce("ym", F.concat_ws("-", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")))
    return raw.groupBy(form.alias("year_month")).agg(F.count("*").alias("n"))


@R.add("w7_breaks")
def w7(spark, sf):
    return T.breaks(series(spark, sf), ["g"])


@R.add("w20_volume_summary")
def w20(spark, sf):
    return T.volume_summary(series(spark, sf), ["g"])
