"""Queries against their SQL on tables made to have what the given ones lack."""

import math

import duckdb
from pyspark.sql import functions as F

from weftline.operators import coverage, disparity
from weftline.queries import ORACLES, QUERIES, base
from weftline.queries import tables as T

SF = "/root/testdata/sf0.001"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def tables(folder, brands_of):
    """Tables of orders whose brands are ``brands_of(priority, k)`` for the k-th order of a priority."""
    con = duckdb.connect()
    orders = [(100 * i + k, p) for i, p in enumerate(PRIORITIES) for k in range(60)]
    lines = [(o, b) for o, p in orders for b in brands_of(p, o % 100)]
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderdate TIMESTAMP, o_orderpriority VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, 1, 'F', '1997-01-01', ?)", orders)
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?)", lines)
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'Brand#' || i AS p_brand, 'PROMO' AS p_type FROM range(30) t(i)")
    for name in ("orders", "lineitem", "part"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return con


def agree(spark, con, folder, name):
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    assert got == want
    return [dict(zip(columns, r, strict=True)) for r in want]


#: In two priorities brands 1 and 2 meet on one order of 60 and other pairs never, so no pair reaches .0825; in the third all do.
def few_edges(priority, k):
    if priority == "3-MEDIUM":
        return (1, 2, 3) if k % 3 else (1, 2)
    return (1, 2) if k == 0 else (1 + k % 3,)


def test_networks_without_edges_compare_as_in_sql(spark, tmp_path):
    rows = agree(spark, tables(tmp_path, few_edges), tmp_path, "g13_compare_networks")
    assert {r["edge_jaccard"] for r in rows if r["second"] == "2-HIGH"} == {"nan"} and len(rows) == 3


def one_pair_each(priority, k):
    return (1, 2) if k % 2 else (3,)


def test_edges_of_networks_compare_as_in_sql(spark, tmp_path):
    """Edges between .08 and .0825 are compared, and none of them counts at .0825."""
    some = lambda p, k: (1, 2) if k < 4 and p != "3-MEDIUM" else (1 + k % 2,) if k < 49 else (4,)
    rows = agree(spark, tables(tmp_path, some), tmp_path, "g14_compare_edges")
    assert [r["edge_jaccard"] for r in rows] == ["nan"]


def test_networks_in_full_leave_out_those_without_edges(spark, tmp_path):
    rows = agree(spark, tables(tmp_path, few_edges), tmp_path, "g13_networks_in_full")
    assert rows == []
    for k, of in enumerate((one_pair_each, lambda p, k: few_edges("3-MEDIUM", k))):
        (tmp_path / str(k)).mkdir()
        assert len(agree(spark, tables(tmp_path / str(k), of), tmp_path / str(k), "g13_networks_in_full")) == 3


def test_incidence_and_units_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """What a task holds doesn't grow with the table, also where the planner would join small partitions."""
    monkeypatch.setattr(base, "ROWS", 300, raising=False)
    for df in (base.incidence(spark, SF), T.units(spark, SF)):
        per_task = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(per_task) >= 1500 and max(per_task) < 900


def test_items_of_units_without_a_group_are_listed(spark):
    inc = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (9, "c"), (9, "a")], "unit int, item string")
    units = spark.createDataFrame([(1, "x", "k"), (2, None, "k"), (3, "x", None)], "unit int, g string, c string")
    rates = {(r["g"], r["item"]): (r["count"], r["n"]) for r in coverage.rates(inc, units, ["g"]).collect()}
    assert rates == {("x", "a"): (1, 2), ("x", "b"): (0, 2), ("x", "c"): (0, 2), (None, "a"): (0, 1), (None, "b"): (1, 1), (None, "c"): (0, 1)}
    counts = {(r["item"], r["cluster"]): (r["k"], r["n"]) for r in disparity.cluster_counts(inc, units, "g", "c").collect()}
    assert counts == {("a", "k"): (1, 1), ("a", None): (0, 1), ("b", "k"): (0, 1), ("b", None): (0, 1), ("c", "k"): (0, 1), ("c", None): (0, 1)}
