"""Pair counting (C), metrics (M) and edge lists (ML)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftline.functions import domain as D
from weftline.functions import metrics as M
from weftline.operators import contingency as X
from weftline.operators import significance as S

from .base import INC, STRATUM, TWO_BY_TWO, Registry, incidence, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
PAIR = ["stratum", "left_item", "right_item"]


def pairs(spark, sf):
    return X.pair_counts(incidence(spark, sf), STRATUM)


@R.add("c1_pair_counts", f"WITH {TWO_BY_TWO} SELECT * FROM t")
def c1(spark, sf):
    return pairs(spark, sf)


_STATUS = """st AS (SELECT DISTINCT o_orderkey AS unit, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


@R.add("c2_rectangular_counts", f"""WITH {INC}, {_STATUS},
l AS (SELECT stratum, item, count(*) AS fl FROM inc GROUP BY ALL),
s AS (SELECT DISTINCT stratum, unit, st.item FROM st JOIN inc USING (unit)),
r AS (SELECT stratum, item, count(*) AS fr FROM s GROUP BY ALL),
n AS (SELECT stratum, count(DISTINCT unit) AS n FROM inc GROUP BY ALL),
m AS (SELECT inc.stratum, inc.item AS left_item, s.item AS right_item, count(*) AS a FROM inc JOIN s ON inc.unit = s.unit GROUP BY ALL)
SELECT m.stratum, left_item, right_item, a, fl - a AS b, fr - a AS c, n - fl - fr + a AS d, fl, fr, n FROM m
JOIN l ON l.stratum = m.stratum AND l.item = left_item JOIN r ON r.stratum = m.stratum AND r.item = right_item JOIN n ON n.stratum = m.stratum""")
def c2(spark, sf):
    left = incidence(spark, sf)
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("item"))
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_orderkey").alias("unit"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("stratum"))
    right = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("unit", "item").distinct().join(orders, "unit")
    return X.rectangular_counts(left, right, STRATUM)


@R.add("c3_category_counts", f"""WITH {INC}, un AS (SELECT o_orderkey AS unit, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS cat FROM orders),
rows_ AS (SELECT DISTINCT inc.unit, item, coalesce(cat, '<null>') AS cat FROM inc JOIN un USING (unit)),
l AS (SELECT item, count(*) AS fl FROM rows_ GROUP BY ALL), r AS (SELECT coalesce(cat, '<null>') AS cat, count(*) AS fr FROM un GROUP BY ALL),
m AS (SELECT item, cat, count(*) AS a FROM rows_ GROUP BY ALL), n AS (SELECT count(*) AS n FROM un)
SELECT l.item AS left_item, r.cat AS right_item, coalesce(a, 0) AS a, fl - coalesce(a, 0) AS b, fr - coalesce(a, 0) AS c, n - fl - fr + coalesce(a, 0) AS d, fl, fr, n
FROM l CROSS JOIN r CROSS JOIN n LEFT JOIN m ON m.item = l.item AND m.cat = r.cat""")
def c3(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return X.category_counts(incidence(spark, sf), units, "status")


#: Tri-state values: a brand on an order is 1 if any of its lines was returned, 0 if any was accepted and none returned, else null.
_VALUES = """v AS (SELECT o_orderpriority AS stratum, o_orderkey AS unit, p_brand AS item,
  max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def values(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("item"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("stratum"))
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("unit"), "item").agg(F.max(flag).alias("value"))
    return rows.join(orders, "unit").select("stratum", "unit", "item", "value")


_EXCLUDING = f"""WITH {_VALUES}, items AS (SELECT DISTINCT stratum, item FROM v),
m AS (SELECT x.stratum, x.item AS left_item, y.item AS right_item, count(*) FILTER (x.value = 1 AND y.value = 1) AS a, count(*) FILTER (x.value = 1 AND y.value = 0) AS b,
  count(*) FILTER (x.value = 0 AND y.value = 1) AS c, count(*) FILTER (x.value = 0 AND y.value = 0) AS d
  FROM v x JOIN v y ON x.unit = y.unit AND x.item < y.item GROUP BY ALL),
e AS (SELECT l.stratum, l.item AS left_item, r.item AS right_item, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d
  FROM items l JOIN items r ON l.stratum = r.stratum AND l.item < r.item LEFT JOIN m ON m.stratum = l.stratum AND m.left_item = l.item AND m.right_item = r.item)"""


@R.add("c4_pair_counts_excluding", _EXCLUDING + " SELECT *, a + b AS fl, a + c AS fr, a + b + c + d AS n FROM e")
def c4(spark, sf):
    return X.pair_counts_excluding(values(spark, sf), STRATUM)


@R.add("c6_pooled_counts", _EXCLUDING + ", p AS (SELECT left_item, right_item, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(d) AS BIGINT) AS d FROM e GROUP BY ALL) SELECT *, a + b AS fl, a + c AS fr, a + b + c + d AS n FROM p")
def c6(spark, sf):
    return X.pool(X.pair_counts_excluding(values(spark, sf), STRATUM))


@R.add("c6_pooled_mean_similarity", f"WITH {TWO_BY_TWO} SELECT left_item, right_item, round(avg(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0 END), 6) AS similarity FROM t GROUP BY ALL")
def c6_mean(spark, sf):
    return X.pool(pairs(spark, sf), how="mean_similarity", metric=M.jaccard()).withColumn("similarity", F.round("similarity", 6))


@R.add("c7_binary_check", "SELECT 'l_linenumber' AS \"column\", count(*) FILTER (l_linenumber NOT IN (0, 1)) AS bad FROM lineitem")
def c7(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_quantity") > 10).cast("int").alias("many"))
    return X.check_binary(wide, ["l_linenumber", "many"])


# Metrics: name in METRICS -> (ID, SQL over t; x/0 is null in SQL and becomes 0).
_P = "((a + .5) / (n + 2.))"
_PMI = f"ln(greatest(1e-15, {_P} / (((fl + .5) / (n + 2.)) * ((fr + .5) / (n + 2.)))))"
_NPMI = f"greatest(-1., least(1., {_PMI} / -ln({_P})))"
_CELLS = [("a", "pl * pr"), ("b", "pl * (1 - pr)"), ("c", "(1 - pl) * pr"), ("d", "(1 - pl) * (1 - pr)")]
_PL, _PR = "((a + b + 1.) / (n + 2.))", "((a + c + 1.) / (n + 2.))"
_q = lambda q: q.replace("pl", _PL).replace("pr", _PR)
_MI = "greatest(0., " + " + ".join(f"(({x} + .5) / (n + 2.)) * ln((({x} + .5) / (n + 2.)) / ({_q(q)}))" for x, q in _CELLS) + ")"
_H = lambda f: f"(-(({f} + .5) / (n + 1.) * ln(({f} + .5) / (n + 1.)) + (1 - ({f} + .5) / (n + 1.)) * ln(1 - ({f} + .5) / (n + 1.))))"
_JS = "(.5 * (a / fl * ln(2. * fr / (fl + fr)) + (1 - a / fl) * ln(2.) + a / fr * ln(2. * fl / (fl + fr)) + (1 - a / fr) * ln(2.)))"
SQL_METRICS = {
    "jaccard": ("m1", "a / (a + b + c)"),
    "dice": ("m2", "2. * a / (2 * a + b + c)"),
    "overlap": ("m3", "a / least(fl, fr)"),
    "cosine": ("m4", "a / sqrt(fl * fr)"),
    "conditional_fraction": ("m5", "a / greatest(fl, fr)"),
    "lift": ("m6", "n * a / (fl * fr)"),
    "tversky": ("m8", "a / (a + .5 * b + .5 * c)"),
    "cfws": ("m9", "sqrt(a / (a + b + c)) * sqrt(a / greatest(fl, fr))"),
    "cfws_cosine": ("m10", "sqrt(a / (a + b + c)) * sqrt(a / sqrt(fl * fr))"),
    "jensen_shannon": ("m11", f"1 - sqrt(greatest(0., {_JS}) / ln(2.))"),
    "phi": ("m12", "(a * d - b * c) / sqrt(CAST(fl AS DOUBLE) * fr * (b + d) * (c + d))"),
    "pmi": ("m13", _PMI),
    "npmi": ("m14", _NPMI),
    "npmi01": ("m15", f"({_NPMI} + 1) / 2"),
    "mutual_information": ("m16", _MI),
    "nmi": ("m17", f"{_MI} / sqrt({_H('fl')} * {_H('fr')})"),
    "yules_q": ("m18", "((a + .5) * (d + 1.5) - b * c) / ((a + .5) * (d + 1.5) + b * c)"),
    "yules_y": ("m19", "CASE WHEN b * c = 0 THEN 1. ELSE greatest(-1., least(1., (sqrt((a + .5) * (d + 1.5) / (b * c)) - 1) / (sqrt((a + .5) * (d + 1.5) / (b * c)) + 1))) END"),
}


def _metric(name):
    def query(spark, sf):
        return pairs(spark, sf).select(*PAIR, F.round(M.METRICS[name](), 6).alias("similarity"))

    return query


for _name, (_id, _sql) in SQL_METRICS.items():
    R.add(f"{_id}_{_name}", f"WITH {TWO_BY_TWO} SELECT stratum, left_item, right_item, round(coalesce({_sql}, 0), 6) AS similarity FROM t")(_metric(_name))


@R.add("m7_scaled_lift", f"""WITH {TWO_BY_TWO}, l AS (SELECT *, ln(1 + n * a / (fl * fr)) AS x, greatest(ln(1 + n / fl), ln(1 + n / fr)) AS own FROM t)
SELECT stratum, left_item, right_item, round(x / max(greatest(x, own)) OVER (PARTITION BY stratum), 6) AS similarity FROM l""")
def m7(spark, sf):
    return X.scaled_lift(pairs(spark, sf), STRATUM).select(*PAIR, F.round("similarity", 6).alias("similarity"))


@R.add("m20_tfidf", f"""WITH {INC}, k AS (SELECT stratum, count(DISTINCT item) AS items FROM inc GROUP BY ALL),
w AS (SELECT unit, pow(ln((1 + items) / (1 + count(*))) + 1, 2) AS w FROM inc JOIN k USING (stratum) GROUP BY unit, items)
SELECT x.stratum, x.item AS left_item, y.item AS right_item, round(sum(w), 5) AS similarity
FROM inc x JOIN inc y ON x.unit = y.unit AND x.item < y.item JOIN w ON w.unit = x.unit GROUP BY ALL""")
def m20(spark, sf):
    return X.tfidf(incidence(spark, sf), STRATUM).withColumn("similarity", F.round("similarity", 5))


#: i: pairs with item weights as in contingency.with_item_weights.
_WEIGHTED = TWO_BY_TWO + """,
x0 AS (SELECT f.stratum, item, ln((n + 20.) / (f + 20.)) AS x, ln((n + 1.) / (f + 1.)) + 1 AS i FROM f JOIN u USING (stratum)),
x1 AS (SELECT *, median(x) OVER (PARTITION BY stratum) AS mid FROM x0),
x2 AS (SELECT *, median(abs(x - mid)) OVER (PARTITION BY stratum) AS mad FROM x1),
x3 AS (SELECT stratum, item, i, i / sqrt(sum(i * i) OVER (PARTITION BY stratum)) AS iu, 1 + tanh((x - mid) / (mad + 1e-9)) AS w FROM x2),
w AS (SELECT t.*, l.w AS wl, r.w AS wr, l.i AS il, r.i AS ir, l.iu AS ul, r.iu AS ur FROM t
  JOIN x3 l ON l.stratum = t.stratum AND l.item = left_item JOIN x3 r ON r.stratum = t.stratum AND r.item = right_item)"""
_S = "(greatest(-1., least(1., ln(((a + .5) / (n + 1.)) / (((fl + .5) / (n + 1.)) * ((fr + .5) / (n + 1.)))) / -ln((a + .5) / (n + 1.)))) + 1) / 2"
_WBASE = "(a * least(wl, wr))"
_WCF = f"({_WBASE} / greatest(fl * wl, fr * wr))"
_WJ = f"({_WBASE} / (fl * wl + fr * wr - {_WBASE}))"
_PPMI = "CASE WHEN a < 5 THEN 0. ELSE 1 / (1 + exp(-2. * least(10., greatest(0., ln(greatest(a / n, 1e-9) / (greatest(fl / n, 1e-9) * greatest(fr / n, 1e-9))))))) END"
_MEAN = "(a * (il + ir) / 2)"
_MBASE = f"(sqrt({_MEAN} / (fl * il + fr * ir - {_MEAN})) * sqrt({_MEAN} / greatest(fl * il, fr * ir)))"
_JS4 = "(1 - (" + " + ".join(f".5 * ((({x} + .5) / (n + 2.)) * ln(2 * (({x} + .5) / (n + 2.)) / ((({x} + .5) / (n + 2.)) + {_q(q)})) + ({_q(q)}) * ln(2 * ({_q(q)}) / ((({x} + .5) / (n + 2.)) + {_q(q)})))" for x, q in _CELLS) + ") / ln(2.))"
_NIDF = "exp(.5 * ln(greatest({x}, 0.) + 1e-10) + .5 * ln(greatest({y}, 0.) + 1e-10))"
_SH = f"({_S} * (ul + ur) / 2)"
_WEIGHT_METRICS = {
    "m21_npmi_idf_cfws": (True, lambda: M.npmi_idf(), _NIDF.format(x=f"{_SH} / (fl * ul + fr * ur - {_SH})", y=f"{_SH} / greatest(fl * ul, fr * ur)")),
    "m22_npmi_idf_cosine": (True, lambda: M.npmi_idf(cosine_form=True), _NIDF.format(x=f"{_SH} / sqrt(fl * ul * fr * ur)", y=f"{_SH} / greatest(fl * ul, fr * ur)")),
    "m23_idf_cfws": (False, lambda: M.idf_cfws(), f"sqrt({_WJ}) * sqrt({_WCF})"),
    "m24_idf_cosine": (False, lambda: M.idf_cfws(cosine_form=True), f"sqrt(a / sqrt(fl * fr)) * sqrt({_WCF})"),
    "m25_idf_cfws_ppmi": (False, lambda: M.idf_cfws(ppmi_eta=0.3), f"pow(sqrt({_WJ}) * sqrt({_WCF}), .7) * pow({_PPMI}, .3)"),
    "m26_idf_cosine_ppmi": (False, lambda: M.idf_cfws(cosine_form=True, ppmi_eta=0.3), f"pow(sqrt(a / sqrt(fl * fr)) * sqrt({_WCF}), .7) * pow({_PPMI}, .3)"),
    "m27_act_composite": (False, lambda: M.act_composite(), f"sqrt(greatest(1e-12, least(1., {_MBASE}))) * sqrt(greatest(1e-12, ({_NPMI} + 1) / 2)) * least(1., a / 5.)"),
    "m28_act_jensen": (False, lambda: M.act_jensen(), f"sqrt(greatest(1e-12, least(1., {_MBASE}))) * sqrt(greatest(1e-12, least(1., {_JS4}))) * least(1., a / 5.)"),
}


def _weighted(unit_norm, build):
    def query(spark, sf):
        return X.with_item_weights(pairs(spark, sf), STRATUM, unit_norm=unit_norm).select(*PAIR, F.round(build(), 6).alias("similarity"))

    return query


for _name, (_norm, _build, _sql) in _WEIGHT_METRICS.items():
    R.add(_name, f"WITH {_WEIGHTED} SELECT stratum, left_item, right_item, round(coalesce(greatest(0., least(1., {_sql})), 0), 6) AS similarity FROM w")(_weighted(_norm, _build))


#: Domain factors by the first digit of a brand, from weights of 0 to 3; the last has none and is masked.
_FACTORS = {"1": (3, 3), "2": (2, 1), "3": (1, 1), "4": (0, 2), "5": (0, 0)}
_FACTOR_SQL = lambda item: "CASE substr(" + item + ", 7, 1) " + " ".join(f"WHEN '{d}' THEN {0 if g == n == 0 else (1 + .2 * g / 3) * (1 + .3 * n / 3)!r}" for d, (g, n) in _FACTORS.items()) + " ELSE 1 END"
_THETA = f"pow((({_FACTOR_SQL('left_item')}) + ({_FACTOR_SQL('right_item')})) / 2, .35)"
_STRETCH, _MULTIPLY = f"1 - pow(1 - greatest(0., least(1., coalesce({{base}}, 0))), greatest(1., {_THETA}))", f"least(1., coalesce({{base}}, 0) * {_THETA})"
_B23, _B24 = _WEIGHT_METRICS["m23_idf_cfws"][2], _WEIGHT_METRICS["m24_idf_cosine"][2]


def _factors(spark, sf):
    digit = F.substring("item", 7, 1)
    pick = lambda at: reduce(lambda e, d: e.when(digit == d, _FACTORS[d][at]), _FACTORS, F.when(F.lit(False), 0))
    items = table(spark, sf, "part").select(F.col("p_brand").alias("item")).distinct()
    return D.domain_factors(items.select("item", pick(0).alias("guideline"), pick(1).alias("novelty")), mask=True)


def _with_domain(spark, sf, build):
    return X.with_item_weights(pairs(spark, sf), STRATUM, domain=_factors(spark, sf)).withColumn("similarity", build)


for _name, _build, _sql in (
    ("m23_stretched", lambda: M.idf_cfws(effect="stretch"), _STRETCH.format(base=_B23)),
    ("m23_multiplied", lambda: M.idf_cfws(effect="multiply"), _MULTIPLY.format(base=_B23)),
    ("m24_stretched", lambda: M.idf_cfws(cosine_form=True, effect="stretch"), _STRETCH.format(base=_B24)),
    ("m25_stretched_ppmi", lambda: M.idf_cfws(effect="stretch", ppmi_eta=0.3), f"pow({_STRETCH.format(base=_B23)}, .7) * pow({_PPMI}, .3)"),
    ("m26_multiplied_ppmi", lambda: M.idf_cfws(cosine_form=True, effect="multiply", ppmi_eta=0.3), f"pow({_MULTIPLY.format(base=_B24)}, .7) * pow({_PPMI}, .3)"),
):
    R.add(_name, f"WITH {_WEIGHTED} SELECT stratum, left_item, right_item, round(greatest(0., least(1., {_sql})), 6) AS similarity FROM w")(lambda spark, sf, _build=_build: _with_domain(spark, sf, _build()).select(*PAIR, F.round("similarity", 6).alias("similarity")))

#: Fisher's two-sided p of screened pairs (fp) and their q; a gate needs more pairs than independence gives.
_LPMF = "(lgamma(fl + 1) - lgamma({k} + 1) - lgamma(fl - {k} + 1) + lgamma(n - fl + 1) - lgamma(fr - {k} + 1) - lgamma(n - fl - fr + {k} + 1) - lgamma(n + 1) + lgamma(fr + 1) + lgamma(n - fr + 1))"
_GATED = f"""{_WEIGHTED}, sk AS (SELECT w.*, a >= 5 AND fl >= 20 AND fr >= 20 AS ok FROM w), bk AS (SELECT stratum, left_item, right_item, a, fl, fr, n, unnest(range(greatest(0, fl + fr - n), least(fl, fr) + 1)) AS k FROM sk WHERE ok),
bp AS (SELECT stratum, left_item, right_item, least(1., sum(exp({_LPMF.format(k='k')})) FILTER ({_LPMF.format(k='k')} <= {_LPMF.format(k='a')} + 1e-7)) AS p FROM bk GROUP BY ALL),
br AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS m, row_number() OVER (PARTITION BY stratum ORDER BY p) AS i FROM bp),
bq AS (SELECT stratum, left_item, right_item, least(1., min(p * m / i) OVER (PARTITION BY stratum ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM br),
gw AS (SELECT sk.*, coalesce(q <= .6, false) AND a * n > fl * fr AS gate FROM sk LEFT JOIN bq USING (stratum, left_item, right_item))"""


def _through(spark, sf, build, soft=False):
    edges = X.with_item_weights(pairs(spark, sf), STRATUM).withColumn("similarity", build)
    return S.through_backbone(edges, STRATUM, alpha=0.6, soft=soft).select(*PAIR, "gate", F.round("similarity", 6).alias("similarity"))


@R.add("m23_backbone", f"WITH {_GATED} SELECT stratum, left_item, right_item, gate, round(CASE WHEN gate THEN greatest(0., least(1., coalesce({_B23}, 0))) ELSE 0 END, 6) AS similarity FROM gw")
def m23_backbone(spark, sf):
    return _through(spark, sf, M.idf_cfws())


@R.add("m26_backbone", f"WITH {_GATED} SELECT stratum, left_item, right_item, gate, round(CASE WHEN gate THEN greatest(0., least(1., coalesce({_WEIGHT_METRICS['m26_idf_cosine_ppmi'][2]}, 0))) ELSE 0 END, 6) AS similarity FROM gw")
def m26_backbone(spark, sf):
    return _through(spark, sf, M.idf_cfws(cosine_form=True, ppmi_eta=0.3))


@R.add("m25_soft_backbone")
def m25_soft(spark, sf):
    return _through(spark, sf, M.idf_cfws(ppmi_eta=0.3), soft=True)


@R.add("m29_distance", f"WITH {TWO_BY_TWO} SELECT stratum, left_item, right_item, round(1 - coalesce(a / (a + b + c), 0), 4) AS distance FROM t")
def m29(spark, sf):
    return pairs(spark, sf).select(*PAIR, M.distance(M.jaccard(), 4).alias("distance"))


@R.add("ml1_edge_list", f"""WITH {TWO_BY_TWO}, e AS (SELECT stratum, left_item, right_item, a, fl, fr, round(a / (a + b + c), 6) AS similarity FROM t)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY similarity DESC, left_item, right_item) AS INTEGER) AS rank FROM e WHERE similarity >= 0.05) WHERE rank <= 20""")
def ml1(spark, sf):
    return X.edge_list(pairs(spark, sf), M.jaccard(), STRATUM, threshold=0.05, topk=20, digits=6).select(*PAIR, "a", "fl", "fr", "similarity", "rank")


_ALL = list(SQL_METRICS)


@R.add("ml2_all_metrics", f"WITH {TWO_BY_TWO} SELECT stratum, left_item, right_item, " + ", ".join(f"round(coalesce({SQL_METRICS[m][1]}, 0), 6) AS {m}" for m in _ALL) + " FROM t")
def ml2(spark, sf):
    return pairs(spark, sf).select(*PAIR, *[F.round(M.METRICS[m](), 6).alias(m) for m in _ALL])


@R.add("ml3_stratified_metrics", f"""WITH {INC}, s AS (SELECT unit, item, 'status' AS stratum_key, o_orderstatus AS stratum_level FROM inc UNION ALL SELECT unit, item, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM inc),
f AS (SELECT stratum_key, stratum_level, item, count(*) AS f FROM s GROUP BY ALL), n AS (SELECT stratum_key, stratum_level FROM s GROUP BY ALL HAVING count(DISTINCT unit) >= 2),
m AS (SELECT x.stratum_key, x.stratum_level, x.item AS left_item, y.item AS right_item, count(*) AS a FROM s x JOIN s y ON x.unit = y.unit AND x.stratum_key = y.stratum_key AND x.item < y.item GROUP BY ALL)
SELECT l.stratum_key, l.stratum_level, l.item AS left_item, r.item AS right_item, round(coalesce(a, 0) / (l.f + r.f - coalesce(a, 0)), 6) AS similarity
FROM f l JOIN f r ON l.stratum_key = r.stratum_key AND l.stratum_level = r.stratum_level AND l.item < r.item JOIN n ON n.stratum_key = l.stratum_key AND n.stratum_level = l.stratum_level
LEFT JOIN m ON m.stratum_key = l.stratum_key AND m.stratum_level = l.stratum_level AND left_item = l.item AND right_item = r.item""")
def ml3(spark, sf):
    rows = incidence(spark, sf, "o_orderstatus", "o_orderdate")
    keys = F.array(F.struct(F.lit("status").alias("k"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("year").alias("k"), F.year("o_orderdate").cast("string").alias("v")))
    rows = rows.select("unit", "item", F.explode(keys).alias("s")).select("unit", "item", F.col("s.k").alias("stratum_key"), F.col("s.v").alias("stratum_level"))
    strata = ["stratum_key", "stratum_level"]
    return X.pair_counts(rows, strata).filter("n >= 2").select(*strata, "left_item", "right_item", F.round(M.jaccard(), 6).alias("similarity"))


@R.add("snk4_square_matrix")
def snk4(spark, sf):
    edges = X.pool(X.with_margins(pairs(spark, sf))).withColumn("similarity", F.round(M.jaccard(), 6))
    return X.square(edges, [], [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()])
