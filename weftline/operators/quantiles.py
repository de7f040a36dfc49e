"""Exact quantiles of groups of any size: histograms of a few bins are refined about the ranks that are asked for, until an interval
holds few values. No buffer holds more than the bins of an interval, or its few values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import KEY, columns_of, key_of
from .lineage import cut

#: Bins of an interval, and values that are sorted in one place.
BINS, FEW = 1024, 4096


def quantiles(df: DataFrame, by: list[str], value: str | Column, shares: tuple[float, ...], bins: int | None = None, few: int | None = None) -> DataFrame:
    """(by, n, q): the number of a group's values and, in the order of ``shares``, its quantiles with linear interpolation between
    neighbours, as ``percentile`` has them. Nulls and NaN are no values; a group without values has no row. A null group is a group.
    """
    bins, few = bins or BINS, few or FEW
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = cut(df.select(key_of(by), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    whole = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if (whole.agg(F.max("n")).first()[0] or 0) <= few:  # every group fits: one aggregate
        small = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
        return small.select(*columns_of(by), "n", "q")
    whole = cut(whole)
    asked = whole.select(KEY, "n", "lo", "hi", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("place", "share"))
    asked = asked.withColumn("at", F.col("share") * (F.col("n") - 1)).withColumn("a", F.floor("at")).withColumn("b", F.ceil("at"))
    spans = [KEY, "lo", "hi"]
    open_ = asked.select(*spans, F.explode(F.array("a", "b")).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size")).distinct()
    found = None
    while True:
        open_ = cut(open_)
        small = open_.filter(F.col("size") <= few).filter("lo < hi")
        inside = lambda spans_: rows.join(spans_.select(*spans).distinct(), KEY).filter("v >= lo and v <= hi")
        lists = inside(small).groupBy(*spans).agg(F.sort_array(F.collect_list("v")).alias("values"))
        got = small.join(lists, spans).select(KEY, "rank", F.element_at("values", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))
        got = got.unionByName(open_.filter("lo = hi").select(KEY, "rank", F.col("lo").alias("v")))
        found = cut(got if found is None else found.unionByName(got))
        rest = open_.filter((F.col("size") > few) & (F.col("lo") < F.col("hi")))
        if rest.isEmpty():
            break
        # halves, as the difference of two large values may be infinite
        place = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)
        counts = inside(rest).groupBy(*spans, F.least(F.lit(bins - 1), place).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("c").over(Window.partitionBy(*spans).orderBy("bin")) - F.col("c")
        counts = counts.withColumn("before", before)
        hit = (F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c"))
        open_ = rest.join(counts, spans).filter(hit).select(KEY, F.col("low").alias("lo"), F.col("high").alias("hi"), "rank", (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("size"))
    at = lambda side: found.select(KEY, F.col("rank").alias(side), F.col("v").alias(f"v{side}"))
    out = asked.join(at("a"), [KEY, "a"]).join(at("b"), [KEY, "b"])
    part = F.col("at") - F.col("a")
    q = F.when(F.col("va") == F.col("vb"), F.col("va")).otherwise((1 - part) * F.col("va") + part * F.col("vb"))
    out = out.groupBy(KEY, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", q.alias("q")))), lambda s: s["q"]).alias("q"))
    return out.select(*columns_of(by), "n", "q")
