"""Sources (SRC, SNK), encodings (P), filters and cohorts (F), joins (J) and coverage tables (A)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import encode as E
from weftline.functions.stats import clopper_pearson
from weftline.operators import contingency as X
from weftline.operators import coverage as V
from weftline.operators import filters as S
from weftline.operators import ordered as O
from weftline.sources import io

from .base import INC, Registry, dealt, incidence, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _written(spark, sf, name, form, columns=None):
    path = io.scratch(spark, name) + {"csv": ".csv", "json": ".json", "parquet": ""}[form]
    df = table(spark, sf, name)
    io.write_flat(df if columns is None else df.selectExpr(*columns), path, form=form)
    return path


@R.add("src1_read_any", "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def src1(spark, sf):
    path = _written(spark, sf, "supplier", "csv", ["s_suppkey as `Unnamed: 0`", "s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    return io.read_any(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@R.add("src2_load_many", "SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src2(spark, sf):
    paths = [_written(spark, sf, "supplier", "json", ["s_suppkey as key", "s_name as name"]), _written(spark, sf, "customer", "parquet", ["c_custkey as key", "c_name as name", "c_mktsegment as segment", "cast(null as string) as nothing"])]
    return io.load_many(spark, [*paths, paths[0] + "-missing"], strict=False).select("key", "name", "segment")


@R.add("src3_text_codes", "SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_size FROM part")
def src3(spark, sf):
    path = _written(spark, sf, "part", "csv", ["lpad(cast(p_partkey as string), 8, '0') as code", "p_size"])
    return io.read_any(spark, path, "code string, p_size int")


@R.add("src4_text_columns", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def src4(spark, sf):
    path = io.scratch(spark, "text")
    io.write_text_columns(table(spark, sf, "nation"), path, 2)
    return io.read_any(spark, path)


@R.add("src5_ready", "SELECT 'nation' AS name, true AS ready UNION ALL SELECT 'missing', false")
def src5(spark, sf):
    nation = table(spark, sf, "nation").limit(1)
    answers = [(n, io.is_ready(spark, f"{sf}/{n}.parquet")) for n in ("nation", "missing")]
    return nation.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("ready")) for n, a in answers])).alias("r")).select("r.*")


@R.add("src6_analysis_table", "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^(house|mach|auto)', 'i')")
def src6(spark, sf):
    df = table(spark, sf, "customer").withColumn("raw_segment", F.col("c_mktsegment"))
    out = io.analysis_table(df, "raw_segment", "^(house|mach|auto)", {"c_mktsegment": {"HOUSEHOLD": "HOME"}}, ["c_acctbal"])
    return out.select("c_custkey", "c_mktsegment")


@R.add("src7_outcome_check", "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'N') AS violations, count(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS kept FROM lineitem GROUP BY ALL")
def src7(spark, sf):
    flag = (F.col("l_returnflag") != "N").cast("int")
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count_if((flag == 0) & F.col("l_linenumber").isNotNull()).alias("violations"), F.count(E.checked_outcome(flag, F.col("l_linenumber"))).alias("kept"))


@R.add("snk1_flat_parquet", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def snk1(spark, sf):
    path = io.scratch(spark, "flat")
    io.write_flat(table(spark, sf, "orders"), path, rows_per_file=5_000)
    return io.read_any(spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("snk2_partitioned", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def snk2(spark, sf):
    path = io.scratch(spark, "parts")
    io.write_flat(table(spark, sf, "orders"), path, partition_by=["o_orderstatus"])
    return io.read_any(spark, path).filter("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@R.add("snk3_csv_tables", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def snk3(spark, sf):
    path = io.scratch(spark, "counts") + ".csv"
    io.write_flat(table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, form="csv")
    return io.read_any(spark, path, "o_orderpriority string, n long")


_RAW_SQL = """CASE l_linenumber % 7 WHEN 0 THEN l_returnflag WHEN 1 THEN 'S/' || l_returnflag WHEN 2 THEN ' ' || lower(l_returnflag) || 'esistant'
  WHEN 3 THEN 'I' WHEN 4 THEN '1' WHEN 5 THEN '-' ELSE NULL END"""
_TOKEN_SQL = """CASE l_linenumber % 7 WHEN 0 THEN CASE l_returnflag WHEN 'R' THEN 'R' END WHEN 1 THEN CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'S' END
  WHEN 2 THEN CASE l_returnflag WHEN 'R' THEN 'R' END WHEN 3 THEN 'I' WHEN 4 THEN 'R' END"""


def raw_results(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_RAW_SQL).alias("raw"))


@R.add("p1_tested_flags", f"SELECT l_linenumber, CAST(sum(CASE WHEN raw IS NULL OR raw IN ('', ' ', 'NA', '-', '.') THEN 0 ELSE 1 END) AS BIGINT) AS tested, count(*) AS n FROM (SELECT *, {_RAW_SQL} AS raw FROM lineitem) GROUP BY ALL")
def p1(spark, sf):
    return raw_results(spark, sf).groupBy("l_linenumber").agg(F.sum(E.tested_flag(F.col("raw")).cast("long")).alias("tested"), F.count("*").alias("n"))


@R.add("p2_result_tokens", f"SELECT {_TOKEN_SQL} AS token, count(*) AS n FROM lineitem GROUP BY ALL")
def p2(spark, sf):
    return raw_results(spark, sf).groupBy(E.result_token(F.col("raw")).alias("token")).agg(F.count("*").alias("n"))


@R.add("p3_outcomes", f"""SELECT token, CASE WHEN token IN ('R', 'I') THEN 1 WHEN token = 'S' THEN 0 END AS ri_vs_s, CASE WHEN token = 'R' THEN 1 WHEN token IN ('S', 'I') THEN 0 END AS r_vs_si,
CASE token WHEN 'R' THEN 2 WHEN 'I' THEN 1 WHEN 'S' THEN 0 END AS ordinal, count(*) AS n FROM (SELECT {_TOKEN_SQL} AS token FROM lineitem) GROUP BY ALL""")
def p3(spark, sf):
    t = F.col("token")
    cols = [E.outcome(t, s).cast("int").alias(a) for s, a in (("RI_vs_S", "ri_vs_s"), ("R_vs_SI", "r_vs_si"), ("ordinal_R2I1S0", "ordinal"))]
    return raw_results(spark, sf).select(E.result_token(F.col("raw")).alias("token")).groupBy("token", *cols).agg(F.count("*").alias("n"))


@R.add("p4_units_with_tests", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL")
def p4(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.tested_units(table(spark, sf, "orders"), lines, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@R.add("p5_rare_items", f"WITH {INC}, n AS (SELECT count(DISTINCT unit) AS n FROM inc) SELECT item, count(*) AS units, round(count(*) / n * 100, 2) AS percent, CASE WHEN count(*) / n >= .16 THEN 'Kept' ELSE 'Dropped' END AS status FROM inc, n GROUP BY item, n")
def p5(spark, sf):
    return S.drop_rare_items(incidence(spark, sf), 0.16)[1]


@R.add("p6_sparse_columns", "SELECT doc_id, lang FROM documents")
def p6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("sparse"), F.lit(None).cast("int").alias("nothing"))
    return S.drop_sparse_columns(docs)


@R.add("p7_present_items", f"WITH {INC} SELECT stratum, item, count(*) AS f FROM inc WHERE o_orderstatus = 'P' GROUP BY ALL")
def p7(spark, sf):
    return X.margins(incidence(spark, sf, "o_orderstatus").filter("o_orderstatus = 'P'"), ["stratum"])[0]


_WIDE = "SELECT o_orderkey AS unit, o_orderpriority AS stratum, CAST(o_totalprice > 100000 AS INTEGER) AS big, CAST(o_orderstatus = 'F' AS INTEGER) AS done, CAST(NULL AS INTEGER) AS nothing FROM orders"


@R.add("p8_unpivot", f"SELECT stratum, item || '_Tested' AS item, count(*) AS n FROM (UNPIVOT ({_WIDE}) ON big, done, nothing INTO NAME item VALUE v) WHERE v > 0 GROUP BY ALL")
def p8(spark, sf):
    wide = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("stratum"), (F.col("o_totalprice") > 100000).cast("int").alias("big_Tested"), (F.col("o_orderstatus") == "F").cast("int").alias("done_Tested"), F.lit(None).cast("int").alias("nothing_Tested"))
    return X.incidence_from_wide(wide, "unit", strata=["stratum"]).groupBy("stratum", "item").agg(F.count("*").alias("n"))


#: The class of a brand: its most frequent part type (ties: the first by name).
_CLASS = "cls AS (SELECT p_brand AS item, p_type AS item_group FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_type) AS k FROM (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL)) WHERE k = 1)"


def classes(spark, sf):
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("item"), "p_type").agg(F.count("*").alias("k"))
    return counts.groupBy("item").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("p_type").alias("t")))["t"].alias("item_group"))


@R.add("p9_item_groups", f"WITH {INC}, {_CLASS} SELECT stratum, item_group AS item, count(DISTINCT unit) AS f FROM inc JOIN cls USING (item) GROUP BY ALL")
def p9(spark, sf):
    return X.margins(S.group_items(incidence(spark, sf), classes(spark, sf)), ["stratum"])[0]


@R.add("p10_items_by_class", f"WITH {INC}, {_CLASS} SELECT stratum, item, count(*) AS f FROM inc WHERE item IN (SELECT item FROM cls WHERE item_group IN ('ECONOMY', 'PROMO')) GROUP BY ALL")
def p10(spark, sf):
    chosen = classes(spark, sf).filter(F.col("item_group").isin("ECONOMY", "PROMO")).select("item")
    return X.margins(incidence(spark, sf).join(chosen, "item", "left_semi"), ["stratum"])[0]


@R.add("p11_restricted_pairs", f"WITH {INC}, i2 AS (SELECT * FROM inc WHERE item LIKE 'Brand#1%') SELECT x.stratum, x.item AS left_item, y.item AS right_item, count(*) AS a FROM i2 x JOIN i2 y ON x.unit = y.unit AND x.item < y.item GROUP BY ALL")
def p11(spark, sf):
    inc = incidence(spark, sf)
    return S.restrict_pairs(X.pair_counts(inc, ["stratum"], complete=False), inc.select("item").distinct().filter("item like 'Brand#1%'")).select("stratum", "left_item", "right_item", "a")


@R.add("p12_label_parts", "SELECT DISTINCT upper(substr(p_type, 1, 3)) AS code, p_brand AS name, upper(substr(p_type, 1, 3)) || ' - ' || p_brand AS combined FROM part")
def p12(spark, sf):
    label = F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit(" - "), F.col("p_brand"), F.lit("_Tested"))
    parts = E.label_parts(F.col("label"))
    return table(spark, sf, "part").select(label.alias("label")).distinct().select(*[v.alias(k) for k, v in parts.items()])


@R.add("p13_decorated_labels", f"WITH {_CLASS} SELECT DISTINCT p_brand AS item, p_brand || ' [' || coalesce(item_group, 'Unknown') || ']' AS label FROM part LEFT JOIN cls ON item = p_brand AND item_group <> 'PROMO'")
def p13(spark, sf):
    dim = classes(spark, sf).filter("item_group <> 'PROMO'")
    items = table(spark, sf, "part").select(F.col("p_brand").alias("item")).distinct().join(dim, "item", "left")
    return items.select("item", F.concat("item", F.lit(" ["), F.coalesce("item_group", F.lit("Unknown")), F.lit("]")).alias("label"))


@R.add("p14_calendar", """SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, monthname(o_orderdate) AS month_name, strftime(o_orderdate, '%Y-%m') AS year_month, CAST(month(o_orderdate) % 12 // 3 + 1 AS INTEGER) AS season_code,
['Winter', 'Spring', 'Summer', 'Fall'][month(o_orderdate) % 12 // 3 + 1] AS season, count(*) AS n FROM orders GROUP BY ALL""")
def p14(spark, sf):
    cols = [v.alias(k) for k, v in E.calendar(F.col("o_orderdate")).items()]
    return table(spark, sf, "orders").groupBy(*cols).agg(F.count("*").alias("n"))





@R.add("p15_age_bands", f"""SELECT CASE WHEN a < 0 OR a >= 120 THEN NULL WHEN a >= 95 THEN '≥95 years' WHEN a < 1 THEN '0 years' WHEN a < 5 THEN '1-4 years' ELSE CAST(a // 5 * 5 AS INTEGER) || '-' || CAST(a // 5 * 5 + 4 AS INTEGER) || ' years' END AS band,
CASE WHEN a < 0 OR a >= 120 THEN NULL WHEN a < 15 THEN '<15' WHEN a >= 90 THEN '90+' ELSE CAST(a // 15 * 15 AS INTEGER) || '–' || CAST(a // 15 * 15 + 14 AS INTEGER) END AS range, count(*) AS n FROM
(SELECT CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) % 130 END AS a FROM customer) GROUP BY ALL""")
def p15(spark, sf):
    raw = F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("age "), (F.floor(F.abs("c_acctbal")) % 130).cast("string"), F.lit(" y")))
    years = E.age(raw)
    return table(spark, sf, "customer").groupBy(E.age_band(years).alias("band"), E.age_range(years).alias("range")).agg(F.count("*").alias("n"))


@R.add("p16_recoded", "SELECT CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' ELSE 'Others' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def p16(spark, sf):
    return table(spark, sf, "orders").groupBy(E.lookup(F.col("o_orderstatus"), {"F": "Done", "O": "Open"}, "Others").alias("status")).agg(F.count("*").alias("n"))


@R.add("p17_assigned", "SELECT CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ALL")
def p17(spark, sf):
    return table(spark, sf, "orders").groupBy(F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")).alias("status")).agg(F.count("*").alias("n"))


@R.add("p18_renamed", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def p18(spark, sf):
    names = spark.createDataFrame([("n_nationkey", "nation_id"), ("n_name", "nation"), ("absent", "nothing")], "old string, new string")
    return S.renamed(table(spark, sf, "nation"), names)


@R.add("p19_after_colon", "SELECT p_type AS tail, count(*) AS n FROM part GROUP BY ALL")
def p19(spark, sf):
    text = F.concat(F.lit("type:  "), F.col("p_type"))
    return table(spark, sf, "part").groupBy(E.after_colon(text).alias("tail")).agg(F.count("*").alias("n"))


@R.add("p20_priority_tiers", "SELECT CASE WHEN regexp_matches(p_type || ' ' || p_name, 'economy|ring', 'i') THEN 'Critical' WHEN regexp_matches(p_type || ' ' || p_name, 'promo', 'i') THEN 'High' ELSE 'Other' END AS tier, count(*) AS n FROM part GROUP BY ALL")
def p20(spark, sf):
    t = E.tier(F.concat_ws(" ", "p_type", "p_name"), [("Critical", "economy|ring"), ("High", "promo")])
    return table(spark, sf, "part").groupBy(t.alias("tier")).agg(F.count("*").alias("n"))


@R.add("p22_row_features", f"WITH {INC}, {_CLASS} SELECT unit, count(DISTINCT item_group) AS n_classes, max(CAST(item_group IN ('PROMO', 'LARGE') AS INTEGER)) AS any_special, max(CAST(item_group = 'PROMO' AS INTEGER)) AS any_promo FROM inc JOIN cls USING (item) GROUP BY ALL")
def p22(spark, sf):
    rows = incidence(spark, sf).join(classes(spark, sf), "item")
    return rows.groupBy("unit").agg(F.count_distinct("item_group").alias("n_classes"), F.max(F.col("item_group").isin("PROMO", "LARGE").cast("int")).alias("any_special"), F.max((F.col("item_group") == "PROMO").cast("int")).alias("any_promo"))


@R.add("p23_breadth", f"WITH {INC} SELECT breadth, count(*) AS units FROM (SELECT unit, count(*) AS breadth FROM inc GROUP BY ALL) GROUP BY ALL")
def p23(spark, sf):
    return incidence(spark, sf).groupBy("unit").agg(F.count("*").alias("breadth")).groupBy("breadth").agg(F.count("*").alias("units"))


@R.add("p24_anonymised", "SELECT n_name, 'Lab ' || row_number() OVER (ORDER BY n_nationkey) AS alias FROM nation")
def p24(spark, sf):
    return O.anonymised(table(spark, sf, "nation"), "n_name", "n_nationkey", "Lab ")


@R.add("p25_region_scores", "SELECT coalesce(r_name, 'Unknown') AS region, round(avg(c_acctbal), 4) AS score FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY ALL")
def p25(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.coalesce("r_name", F.lit("Unknown")).alias("region")).agg(F.round(F.avg("c_acctbal"), 4).alias("score"))


@R.add("p26_population_pivot", "SELECT c_nationkey AS nation, count(*) FILTER (c_acctbal >= 0) AS creditors, count(*) FILTER (c_acctbal < 0) AS debtors, count(*) AS total FROM customer GROUP BY ALL")
def p26(spark, sf):
    long = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") >= 0, "creditors").otherwise("debtors").alias("kind"))
    return long.groupBy("nation").pivot("kind", ["creditors", "debtors"]).count().fillna(0).withColumn("total", F.col("creditors") + F.col("debtors"))


@R.add("p28_distinct_values", "SELECT 'lang' AS \"column\", lang AS value FROM documents GROUP BY ALL UNION ALL SELECT 'source', source FROM documents GROUP BY ALL")
def p28(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").unpivot([], ["lang", "source"], "column", "value").distinct()


@R.add("p29_group_map", f"WITH {_CLASS} SELECT item_group, string_agg(item, ',' ORDER BY item) AS items FROM cls GROUP BY ALL")
def p29(spark, sf):
    return classes(spark, sf).groupBy("item_group").agg(F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))


@R.add("f1_filter_specs", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND regexp_matches(o_orderstatus, 'f|o', 'i') AND year(o_orderdate) = 1997")
def f1(spark, sf):
    df = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    specs = [{"column": "o_orderpriority", "values": ["1-urgent ", "2-HIGH"]}, {"column": "o_orderstatus", "values": "f|o"}, {"column": "y", "values": 1997}]
    return S.apply_filters(df, specs).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("f1_marked_names", "SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('STANDARD', 'SMALL', 'ECONOMY') GROUP BY ALL")
def f1_marked(spark, sf):
    """Values with marks on their letters, in capitals and with space around, are those of the plain list."""
    marked = F.concat(F.lit(" "), F.translate("p_type", "SAEOMDLN", "ŠẬĘŐṀĎĹŇ"), F.lit(" "))
    return S.apply_filters(table(spark, sf, "part").withColumn("marked", marked), [{"column": "marked", "values": ["standard", "Small", "ÉCONOMY"]}]).groupBy("p_type").agg(F.count("*").alias("n"))


@R.add("f2_name_pattern", "SELECT p_name, count(*) AS n FROM part WHERE regexp_matches(p_name, '\\b(?:ring|small)\\b') GROUP BY ALL")
def f2(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_name").rlike(E.names_pattern(["ring", "small"]))).groupBy("p_name").agg(F.count("*").alias("n"))


@R.add("f3_prefilters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('P') AND o_totalprice > 50000 GROUP BY ALL")
def f3(spark, sf):
    return S.prefilter(table(spark, sf, "orders"), [("o_orderstatus", ["P"], "not in"), ("o_totalprice", lambda c: c > 50000, "in")]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@R.add("f4_stratify", "SELECT 'o_orderstatus' AS stratum_key, o_orderstatus AS stratum_level, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def f4(spark, sf):
    return S.stratify(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]).groupBy("stratum_key", "stratum_level").agg(F.count("*").alias("n"))


@R.add("f5_filter_chain", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def f5(spark, sf):
    return S.chain(table(spark, sf, "orders"), [lambda d: d.filter("o_orderstatus = 'F'"), lambda d: d.filter("o_totalprice > 1000")]).agg(F.count("*").alias("n"))


@R.add("f6_cohort", f"WITH {INC}, r AS (SELECT * FROM inc WHERE o_orderstatus IN ('F', 'O') AND regexp_matches(stratum, 'urgent|high', 'i') AND year(o_orderdate) BETWEEN 1996 AND 1998) SELECT item, count(*) AS n FROM r WHERE (SELECT count(DISTINCT unit) FROM r) >= 100 GROUP BY ALL")
def f6(spark, sf):
    inc = incidence(spark, sf, "o_orderstatus", "o_orderdate").withColumn("year", F.year("o_orderdate"))
    spec = S.Cohort(where={"o_orderstatus": ["F", "O"]}, patterns={"stratum": "urgent|high"}, ranges={"year": (1996, 1998)}, min_size=100)
    return S.cohort(inc, spec).groupBy("item").agg(F.count("*").alias("n"))


_SPECS = [("all", None, None), ("done", "F", None), ("done urgent", "F", "1-URGENT"), ("urgent", None, "1-URGENT"), ("odd", "P", "5-LOW")]
_SPEC_SQL = "specs AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in s) + ")" for s in _SPECS) + ") s(cohort_id, o_orderstatus, stratum))"
_COHORTS = f"WITH {INC}, {_SPEC_SQL}, ch AS (SELECT cohort_id, inc.* FROM inc JOIN specs s ON (s.o_orderstatus IS NULL OR s.o_orderstatus = inc.o_orderstatus) AND (s.stratum IS NULL OR s.stratum = inc.stratum))"


def cohort_rows(spark, sf, min_size=0):
    inc = incidence(spark, sf, "o_orderstatus")
    specs = spark.createDataFrame(_SPECS, "cohort_id string, o_orderstatus string, stratum string")
    return S.cohorts(inc, specs, ["o_orderstatus", "stratum"], min_size)


@R.add("f7_cohort_family", f"{_COHORTS} SELECT cohort_id, item, count(*) AS n FROM ch GROUP BY ALL")
def f7(spark, sf):
    return cohort_rows(spark, sf).groupBy("cohort_id", "item").agg(F.count("*").alias("n"))


@R.add("f10_sized_cohorts", f"{_COHORTS} SELECT cohort_id, count(DISTINCT unit) AS units FROM ch GROUP BY ALL HAVING count(DISTINCT unit) >= 1000")
def f10(spark, sf):
    return cohort_rows(spark, sf, 1000).groupBy("cohort_id").agg(F.count_distinct("unit").alias("units"))


@R.add("f11_cohort_catalogue", f"{_COHORTS}, k AS (SELECT cohort_id, item, count(*) AS c FROM ch GROUP BY ALL), b AS (SELECT cohort_id, item, row_number() OVER (PARTITION BY cohort_id ORDER BY c DESC, item) AS k FROM k) SELECT ch.cohort_id, count(DISTINCT unit) AS units, count(DISTINCT ch.item) AS items, max(b.item) AS top_item FROM ch JOIN b ON b.cohort_id = ch.cohort_id AND b.k = 1 GROUP BY ALL")
def f11(spark, sf):
    rows = cohort_rows(spark, sf)
    top = rows.groupBy("cohort_id", "item").agg(F.count("*").alias("c")).groupBy("cohort_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "item"))["item"].alias("top_item"))
    return rows.groupBy("cohort_id").agg(F.count_distinct("unit").alias("units"), F.count_distinct("item").alias("items")).join(top, "cohort_id")


@R.add("c5_cohort_contingency", f"{_COHORTS}, f AS (SELECT cohort_id, item, count(*) AS f FROM ch GROUP BY ALL), n AS (SELECT cohort_id, count(DISTINCT unit) AS n FROM ch GROUP BY ALL), m AS (SELECT x.cohort_id, x.item AS li, y.item AS ri, count(*) AS a FROM ch x JOIN ch y ON x.cohort_id = y.cohort_id AND x.unit = y.unit AND x.item < y.item GROUP BY ALL) SELECT l.cohort_id, l.item AS left_item, r.item AS right_item, coalesce(a, 0) AS a, l.f - coalesce(a, 0) AS b, r.f - coalesce(a, 0) AS c, n - l.f - r.f + coalesce(a, 0) AS d, l.f AS fl, r.f AS fr, n FROM f l JOIN f r ON l.cohort_id = r.cohort_id AND l.item < r.item JOIN n ON n.cohort_id = l.cohort_id LEFT JOIN m ON m.cohort_id = l.cohort_id AND li = l.item AND ri = r.item")
def c5(spark, sf):
    return X.pair_counts(cohort_rows(spark, sf), ["cohort_id"])


@R.add("f12_continuous_customers", "SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY ALL HAVING count(DISTINCT year(o_orderdate)) = 4) GROUP BY ALL")
def f12(spark, sf):
    df = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return S.continuous_entities(df, "o_custkey", "y", 1996, 1999).groupBy("o_custkey").agg(F.count("*").alias("n"))


_UNITS = "un AS (SELECT o_orderkey AS unit, o_orderpriority AS g, o_orderstatus AS s, year(o_orderdate) AS y, n_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_RATES = f"""{INC}, {_UNITS}, sz AS (SELECT g, count(*) AS n FROM un GROUP BY ALL), cn AS (SELECT g, item, count(*) AS count FROM inc JOIN un USING (unit) GROUP BY ALL),
rt AS (SELECT sz.g, i.item, coalesce(count, 0) AS count, n, coalesce(count, 0) / n AS rate FROM sz CROSS JOIN (SELECT DISTINCT item FROM inc) i LEFT JOIN cn ON cn.g = sz.g AND cn.item = i.item)"""


def units(spark, sf):
    orders = table(spark, sf, "orders")
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"), F.col("n_name").alias("region"))
    return dealt(rows, orders, "unit")


def group_rates(spark, sf):
    return V.rates(incidence(spark, sf).select("unit", "item"), units(spark, sf), ["g"])


@R.add("a1_rates", f"WITH {_RATES} SELECT g, item, count, n, round(rate, 6) AS rate FROM rt")
def a1(spark, sf):
    return group_rates(spark, sf).withColumn("rate", F.round("rate", 6))


@R.add("a2_metric_wide", f"WITH {_RATES} SELECT item, " + ", ".join(f"round(max(rate * 100) FILTER (g = '{p}'), 4) AS \"{p}\"" for p in ("1-URGENT", "5-LOW")) + " FROM rt GROUP BY ALL")
def a2(spark, sf):
    return group_rates(spark, sf).groupBy("item").pivot("g", ["1-URGENT", "5-LOW"]).agg(F.round(F.first("rate") * 100, 4))


@R.add("a3_kept_items", f"WITH {_RATES} SELECT g, item, round(rate, 6) AS rate FROM rt WHERE item IN (SELECT item FROM rt GROUP BY ALL HAVING min(rate) >= .15)")
def a3(spark, sf):
    return V.keep_items(group_rates(spark, sf), 0.15, "all").select("g", "item", F.round("rate", 6).alias("rate"))


@R.add("a4_per_100k", f"WITH {INC}, {_UNITS}, p AS (SELECT n_name AS region, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT region, y, count(*) AS count, round(count(*) * 100000 / population, 4) AS per_100k FROM inc JOIN un USING (unit) JOIN p USING (region) GROUP BY region, y, population")
def a4(spark, sf):
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("region")).agg(F.count("*").alias("population"))
    counts = incidence(spark, sf).select("unit", "item").join(units(spark, sf), "unit").groupBy("region", "y").agg(F.count("*").alias("count"))
    return V.per_100k(counts, people, "region").select("region", "y", "count", F.round("per_100k", 4).alias("per_100k"))


@R.add("a5_top_values", "WITH c AS (SELECT lang, source, count(*) AS count FROM documents GROUP BY ALL), f AS (SELECT lang FROM documents GROUP BY ALL ORDER BY count(*) DESC, lang LIMIT 2) SELECT lang, source, count, round(count * 100 / (SELECT count(*) FROM documents), 6) AS share FROM c WHERE lang IN (SELECT lang FROM f)")
def a5(spark, sf):
    return V.top_values(table(spark, sf, "documents"), "lang", 2, "source").withColumn("share", F.round("share", 6))


@R.add("a6_completeness", "SELECT 'text' AS \"column\", count(text) AS present, round(count(text) * 100 / count(*), 6) AS percent FROM documents UNION ALL SELECT 'lang', count(CASE WHEN lang <> 'fr' THEN 1 END), round(count(CASE WHEN lang <> 'fr' THEN 1 END) * 100 / count(*), 6) FROM documents")
def a6(spark, sf):
    docs = table(spark, sf, "documents").select("text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))
    return V.completeness(docs, ["text", "lang"]).withColumn("percent", F.round("percent", 6))


@R.add("a7_counts_by_dimension", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_mktsegment LIMIT 3")
def a7(spark, sf):
    return V.counts_by(table(spark, sf, "customer"), ["c_mktsegment"], 3)


@R.add("a8_coverage_of_top", f"WITH {_RATES} SELECT g, item, count, round(rate, 6) AS rate FROM rt WHERE g IN (SELECT g FROM sz ORDER BY n DESC, g LIMIT 2)")
def a8(spark, sf):
    u = units(spark, sf)
    top = u.groupBy("g").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "g").limit(2).select("g")
    return V.rates(incidence(spark, sf).select("unit", "item"), u.join(top, "g", "left_semi"), ["g"]).select("g", "item", "count", F.round("rate", 6).alias("rate"))


@R.add("a9_crosstab", "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr", "it")) + " FROM documents GROUP BY ALL")
def a9(spark, sf):
    return V.crosstab(table(spark, sf, "documents"), "source", "lang", ["de", "en", "es", "fr", "it"])


_Z = 1.959963984540054


@R.add("a11_wilson", f"WITH {_RATES} SELECT g, item, round((rate + {_Z}*{_Z} / (2 * n) - {_Z} * sqrt(rate * (1 - rate) / n + {_Z}*{_Z} / (4. * n * n))) / (1 + {_Z}*{_Z} / n), 6) AS low, round((rate + {_Z}*{_Z} / (2 * n) + {_Z} * sqrt(rate * (1 - rate) / n + {_Z}*{_Z} / (4. * n * n))) / (1 + {_Z}*{_Z} / n), 6) AS high FROM rt")
def a11(spark, sf):
    low, high = V.wilson(F.col("count").cast("double"), F.col("n").cast("double"))
    return group_rates(spark, sf).select("g", "item", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


#: Bisection for the share at which the count seen, or more (or less), has a probability of .025.
_TAIL = "list_sum(list_transform(range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"
_EXACT = f"""{_RATES}, bi AS (SELECT g, item, count, n, 0 AS k, CAST(0 AS DOUBLE) AS la, CAST(1 AS DOUBLE) AS lb, CAST(0 AS DOUBLE) AS ha, CAST(1 AS DOUBLE) AS hb FROM rt
UNION ALL SELECT g, item, count, n, k + 1, CASE WHEN up < .025 THEN lm ELSE la END, CASE WHEN up < .025 THEN lb ELSE lm END, CASE WHEN down > .025 THEN hm ELSE ha END, CASE WHEN down > .025 THEN hb ELSE hm END
  FROM (SELECT *, {_TAIL.format(a='count', b='n', p='lm')} AS up, {_TAIL.format(a='0', b='count', p='hm')} AS down FROM (SELECT *, (la + lb) / 2 AS lm, (ha + hb) / 2 AS hm FROM bi WHERE k < 30)))"""


@R.add("a11_exact", f"WITH RECURSIVE {_EXACT} SELECT g, item, round(CASE WHEN count = 0 THEN 0 ELSE (la + lb) / 2 END, 6) AS low, round(CASE WHEN count = n THEN 1 ELSE (ha + hb) / 2 END, 6) AS high FROM bi WHERE k = 30")
def a11_exact(spark, sf):
    both = group_rates(spark, sf).select("g", "item", clopper_pearson("count", "n").alias("i"))
    return both.select("g", "item", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


_GINI = "CASE WHEN sum(rate) > 0 THEN 2 * sum(i * rate) / (count(*) * sum(rate)) - (count(*) + 1) / count(*) ELSE 0 END"


@R.add("a12_variation", f"""WITH {_RATES}, o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY rate) AS i, median(rate) OVER (PARTITION BY item) AS med FROM rt)
SELECT item, count(*) AS strata, round(median(rate), 6) AS median, round(quantile_cont(rate, .75) - quantile_cont(rate, .25), 6) AS iqr, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sd, round(min(rate), 6) AS min, round(max(rate), 6) AS max,
round(avg(CAST(rate < .16 AS INTEGER)), 6) AS below, round(median(abs(rate - med)), 6) AS mad, round({_GINI}, 6) AS gini, round(stddev_samp(rate) / avg(rate), 6) AS cv, round((quantile_cont(rate, .75) - quantile_cont(rate, .25)) / median(rate), 6) AS relative_iqr FROM o GROUP BY item""")
def a12(spark, sf):
    out = V.variation(group_rates(spark, sf), ["item"], "rate", 0.16)
    return out.select("item", "strata", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("item", "strata")])


_HALF = {"stddev": "stddev_samp(rate)", "sem": "stddev_samp(rate) / sqrt(count(*))", "ci": "1.96 * stddev_samp(rate) / sqrt(count(*))", "mad": "avg(abs(rate - m))"}
_BARS = {k: (f"avg(rate) - {h}", f"avg(rate) + {h}") for k, h in _HALF.items()} | {"iqr": ("quantile_cont(rate, .25)", "quantile_cont(rate, .75)"), "minmax": ("min(rate)", "max(rate)"), "none": ("avg(rate)", "avg(rate)")}


@R.add("a13_error_bars", f"WITH {_RATES}, c AS (SELECT *, avg(rate) OVER (PARTITION BY item) AS m FROM rt) " + " UNION ALL ".join(f"SELECT item, '{k}' AS mode, round(avg(rate), 6) AS mean, round({low}, 6) AS low, round({high}, 6) AS high FROM c GROUP BY ALL" for k, (low, high) in _BARS.items()))
def a13(spark, sf):
    r = group_rates(spark, sf)
    bars = [V.error_bars(r, ["item"], "rate", m).withColumn("mode", F.lit(m)) for m in _BARS]
    return reduce(DataFrame.unionByName, bars).select("item", "mode", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@R.add("a14_group_extremes", f"WITH {_RATES} SELECT item, round(min(rate), 6) AS min_rate, arg_min(g, (rate, g)) AS bottom, round(max(rate), 6) AS max_rate, arg_min(g, (-rate, g)) AS top, round(max(rate) - min(rate), 6) AS range, round(avg(rate), 6) AS mean, count(*) AS groups FROM rt GROUP BY ALL")
def a14(spark, sf):
    out = V.extremes(group_rates(spark, sf), "g")
    return out.select("item", "bottom", "top", "groups", *[F.round(c, 6).alias(c) for c in ("min_rate", "max_rate", "range", "mean")])


@R.add("a18_top_items", f"WITH {INC}, {_UNITS}, c AS (SELECT region, y, item, count(*) AS n FROM inc JOIN un USING (unit) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY region, y ORDER BY n DESC, item) AS INTEGER) AS rank FROM c) WHERE rank <= 3")
def a18(spark, sf):
    return V.top_items(incidence(spark, sf), units(spark, sf), ["region", "y"], 3)


@R.add("a19_publication_table", "SELECT g, printf('%d (%.1f)', f, round(f * 100 / t, 1)) AS f, printf('%d (%.1f)', o, round(o * 100 / t, 1)) AS o, t AS total FROM (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS t FROM orders GROUP BY ALL)")
def a19(spark, sf):
    counts = V.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    counts = counts.select(F.col("o_orderpriority").alias("g"), F.col("F").alias("f"), F.col("O").alias("o"), (F.col("F") + F.col("O") + F.col("P")).alias("total"))
    return V.with_percent_cells(counts, ["f", "o"], "total")


@R.add("a21_profile", "SELECT 'o_orderkey' AS \"column\", 'bigint' AS type, count(*) AS rows, count(*) - count(o_orderkey) AS nulls, count(DISTINCT o_orderkey) AS \"distinct\", false AS constant, count(*) = count(DISTINCT o_orderkey) AS key FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), false, false FROM orders")
def a21(spark, sf):
    return V.profile(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


@R.add("a21_frequent_values", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey")) + "), c AS (SELECT \"column\", value, count(*) AS count FROM u WHERE value IS NOT NULL GROUP BY ALL), n AS (SELECT count(*) AS n FROM orders) SELECT \"column\", CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS INTEGER) AS place, value, count, round(count / n, 6) AS share FROM c, n WHERE count >= .0005 * n QUALIFY place <= 10")
def a21_values(spark, sf):
    out = V.frequent_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey"), share=0.0005, most=10)
    return out.withColumn("share", F.round("share", 6))


@R.add("a21_full_profile", "SELECT 'o_orderstatus' AS \"column\", 'category' AS role, count(*) AS rows, count(*) - count(o_orderstatus) AS nulls, mode(o_orderstatus) AS top_value, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)) AS top_count FROM orders UNION ALL SELECT 'o_orderkey', 'id', count(*), count(*) - count(o_orderkey), NULL, 0 FROM orders")
def a21_full(spark, sf):
    out = V.full_profile(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), share=0.001)
    return out.select("column", "role", "rows", "nulls", "top_value", F.coalesce("top_count", F.lit(0)).alias("top_count"))


@R.add("a22_class_coverage", f"WITH {INC}, {_CLASS}, g AS (SELECT DISTINCT unit, stratum, item_group FROM inc JOIN cls USING (item)) SELECT stratum, item_group AS item, count(*) AS count, n, round(count(*) / n, 6) AS rate FROM g JOIN (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY ALL) USING (stratum) GROUP BY stratum, item_group, n")
def a22(spark, sf):
    inc = S.group_items(incidence(spark, sf).select("unit", "item"), classes(spark, sf))
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("stratum"))
    return V.rates(inc, u, ["stratum"], complete=False).withColumn("rate", F.round("rate", 6))


@R.add("a23_yearly_variation", f"WITH {INC}, {_UNITS}, sz AS (SELECT y, g, count(*) AS n FROM un GROUP BY ALL), cn AS (SELECT y, g, item, count(*) AS c FROM inc JOIN un USING (unit) GROUP BY ALL), rt AS (SELECT sz.y, sz.g, i.item, coalesce(c, 0) / n AS rate FROM sz CROSS JOIN (SELECT DISTINCT item FROM inc) i LEFT JOIN cn ON cn.y = sz.y AND cn.g = sz.g AND cn.item = i.item) SELECT y, item, count(*) AS strata, round(median(rate), 6) AS median, round(max(rate) - min(rate), 6) AS range FROM rt GROUP BY ALL")
def a23(spark, sf):
    r = V.rates(incidence(spark, sf).select("unit", "item"), units(spark, sf), ["y", "g"])
    return V.variation(r, ["y", "item"], "rate").select("y", "item", "strata", F.round("median", 6).alias("median"), F.round(F.col("max") - F.col("min"), 6).alias("range"))


@R.add("a26_pattern_matrix", f"WITH {_RATES}, i AS (SELECT item, avg(rate) AS mean FROM rt GROUP BY ALL HAVING sum(count) > 0 AND avg(rate) >= .1), q AS (SELECT quantile_cont(mean, .25) AS a, quantile_cont(mean, .5) AS b, quantile_cont(mean, .75) AS c FROM i) SELECT g, rt.item, round(rate, 6) AS rate, round(mean, 6) AS mean, CASE WHEN mean >= c THEN 'Critically' WHEN mean >= b THEN 'Highly' WHEN mean >= a THEN 'Mediumly' ELSE 'Lowly' END AS tier FROM rt JOIN i USING (item) CROSS JOIN q")
def a26(spark, sf):
    return V.pattern_matrix(group_rates(spark, sf), ["g"], 0.1).select("g", "item", F.round("rate", 6).alias("rate"), F.round("mean", 6).alias("mean"), "tier")


@R.add("j1_population_fallback", "WITH e AS (SELECT c_nationkey AS region, 1997 AS year, count(*) AS p FROM customer WHERE c_nationkey < 10 GROUP BY ALL), f AS (SELECT s_nationkey AS region, count(*) AS q FROM supplier GROUP BY ALL) SELECT n_nationkey AS region, y AS year, coalesce(p, q) AS population FROM nation CROSS JOIN (SELECT unnest([1997, 1998]) AS y) LEFT JOIN e ON e.region = n_nationkey AND e.year = y LEFT JOIN f ON f.region = n_nationkey")
def j1(spark, sf):
    exact = table(spark, sf, "customer").filter("c_nationkey < 10").groupBy(F.col("c_nationkey").alias("region")).agg(F.count("*").alias("population")).withColumn("year", F.lit(1997))
    fallback = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("region")).agg(F.count("*").alias("population"))
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.explode(F.array(F.lit(1997), F.lit(1998))).alias("year"))
    return V.population_of(regions, exact, fallback)


@R.add("p21_grouped_levels", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS grp, count(*) AS n FROM part GROUP BY ALL")
def p21(spark, sf):
    size = F.col("p_size")
    grp = S.recoded({"small": size < 10, "middle": size < 30}, "large")
    return table(spark, sf, "part").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))


@R.add("f8_cohort_wildcards", f"{_COHORTS} SELECT cohort_id, coalesce(s.o_orderstatus, '-') AS status, coalesce(s.stratum, '-') AS priority, count(DISTINCT unit) AS units FROM ch JOIN specs s USING (cohort_id) GROUP BY ALL")
def f8(spark, sf):
    specs = spark.createDataFrame(_SPECS, "cohort_id string, status string, priority string")
    sizes = cohort_rows(spark, sf).groupBy("cohort_id").agg(F.count_distinct("unit").alias("units"))
    return sizes.join(specs, "cohort_id").fillna("-", ["status", "priority"])


@R.add("f9_spec_slice", f"WITH {INC} SELECT item, count(*) AS n FROM inc WHERE o_orderstatus = 'F' AND stratum = '5-LOW' GROUP BY ALL")
def f9(spark, sf):
    rows = S.cohort(incidence(spark, sf, "o_orderstatus"), S.Cohort(where={"o_orderstatus": "F", "stratum": "5-LOW"}))
    return rows.groupBy("item").agg(F.count("*").alias("n"))


@R.add("f13_members_and_items", f"WITH {INC} SELECT stratum, item, count(*) AS n FROM inc WHERE stratum IN ('1-URGENT', '2-HIGH') AND item IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12') GROUP BY ALL")
def f13(spark, sf):
    rows = incidence(spark, sf).filter(F.col("stratum").isin("1-URGENT", "2-HIGH") & F.col("item").isin("Brand#1", "Brand#2", "Brand#11", "Brand#12"))
    return rows.groupBy("stratum", "item").agg(F.count("*").alias("n"))


@R.add("j2_mapped_classes", f"WITH {INC}, {_CLASS} SELECT coalesce(item_group, 'Unknown') AS item_group, count(*) AS n FROM inc LEFT JOIN cls ON cls.item = inc.item AND item_group <> 'PROMO' GROUP BY ALL")
def j2(spark, sf):
    dim = classes(spark, sf).filter("item_group <> 'PROMO'")
    return S.mapped(incidence(spark, sf), "item", dim, "Unknown").groupBy("item_group").agg(F.count("*").alias("n"))


@R.add("j3_removed_items", f"WITH {INC} SELECT DISTINCT p_brand AS item FROM part WHERE p_brand NOT IN (SELECT item FROM inc WHERE o_orderstatus = 'P' GROUP BY ALL HAVING count(*) > (SELECT count(*) / count(DISTINCT item) FROM inc WHERE o_orderstatus = 'P'))")
def j3(spark, sf):
    counts = incidence(spark, sf, "o_orderstatus").filter("o_orderstatus = 'P'").groupBy("item").count()
    kept = counts.join(counts.agg(F.avg("count").alias("mean")), F.lit(True)).filter("count > mean").select("item")
    return S.members(table(spark, sf, "part").select(F.col("p_brand").alias("item")).distinct(), "item", kept, keep=False)


@R.add("a10_long_counts", f"WITH {INC}, {_UNITS}, sz AS (SELECT g, s, count(*) AS n FROM un GROUP BY ALL), cn AS (SELECT g, s, item, count(*) AS c FROM inc JOIN un USING (unit) GROUP BY ALL) SELECT sz.g, sz.s, i.item, coalesce(c, 0) AS count, n FROM sz CROSS JOIN (SELECT DISTINCT item FROM inc) i LEFT JOIN cn ON cn.g = sz.g AND cn.s = sz.s AND cn.item = i.item")
def a10(spark, sf):
    return V.rates(incidence(spark, sf).select("unit", "item"), units(spark, sf), ["g", "s"]).select("g", "s", "item", "count", "n")


@R.add("a15_box_table", f"WITH {_RATES} SELECT item, round(quantile_cont(rate, .25), 6) AS q1, round(median(rate), 6) AS median, round(quantile_cont(rate, .75), 6) AS q3, round(avg(rate), 6) AS mean FROM rt GROUP BY ALL")
def a15(spark, sf):
    return V.box_table(group_rates(spark, sf)).select("item", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "mean")])


@R.add("a16_disparity_range", f"WITH {_RATES} SELECT item, round(max(rate) - min(rate), 6) AS range, round(avg(rate), 6) AS mean, count(*) AS groups FROM rt GROUP BY ALL")
def a16(spark, sf):
    return V.extremes(group_rates(spark, sf), "g").select("item", F.round("range", 6).alias("range"), F.round("mean", 6).alias("mean"), "groups")


@R.add("a17_group_totals", f"WITH {INC}, {_CLASS} SELECT item_group, item, count(*) AS n FROM inc JOIN cls USING (item) GROUP BY ALL")
def a17(spark, sf):
    return V.group_totals(incidence(spark, sf), classes(spark, sf))


@R.add("a27_ordered_grid", f"WITH {_RATES} SELECT g, item, round(rate, 6) AS rate, round(avg(rate) OVER (PARTITION BY item), 6) AS order_key FROM rt WHERE g <> '3-MEDIUM'")
def a27(spark, sf):
    rows = V.ordered_grid(group_rates(spark, sf), "g", ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"])
    return rows.select("g", "item", F.round("rate", 6).alias("rate"), F.round("order_key", 6).alias("order_key"))
