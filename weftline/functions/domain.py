"""Item dimensions: weights by code, and matching of names."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.operators.lineage import cut

# Item codes by group, with the least guideline and novelty weight (0 to 3) that a group gives.
CODE_GROUPS = {
    "urinary": (2, 0, ("NFT", "NIT", "FOS", "PIC", "TRP", "NOR", "CIN", "PIM")),
    "reserve": (2, 3, ("CZA", "CZT", "CCO", "CTL", "BPR", "DAL", "ORI", "TLV", "TZD", "LEF", "OMA", "DEL", "PLA")),
    "last_resort": (2, 3, ("COL", "PMB", "CST")),
    "advanced": (2, 2, ("LIZ", "TGC", "DPT", "IPM", "MER", "MEM", "ETP", "DOR", "FEP", "CPI", "CPO")),
    "first_line": (2, 0, ("AMX", "AMP", "AMC", "AMS", "TZP", "PIT", "CEZ", "CXM", "CTX", "CRO", "CAZ", "FEP")),
    "fluoroquinolone": (2, 1, ("CIP", "LEV", "MOX", "OFX", "NOR", "ENO", "GAT", "GEM", "GRE", "DEL")),
    "macrolide_lincosamide": (2, 1, ("ERY", "AZM", "CLR", "CLI", "LIN", "ROX", "TEL")),
    "aminoglycoside": (2, 1, ("GEN", "TOB", "AMK", "NET", "KAN", "SIS", "PLA")),
    "folate": (2, 0, ("SXT", "TRP")),
}
# Codes by reason why they weigh nothing, unless a group above gives them more. Other codes weigh 1 and 1 at least.
NO_WEIGHT = {
    "niche": ("MUP", "FUS", "NOV", "PRI"),
    "antifungal": ("FCA", "ITR", "KET", "MCZ", "NYS", "VOR", "POS", "IVC", "MIC", "ANI", "5FC"),
    "tuberculosis": ("INH", "EMB", "PZA", "ETH", "PAS", "CPR", "CSE", "PTH"),
}


def item_code(label: Column) -> Column:
    """The letters and digits that a label begins with, or the label if it begins with none."""
    text = F.trim(label.cast("string"))
    token = F.regexp_extract(text, r"^[\p{L}\p{N}]+", 0)
    return F.when(token == "", text).otherwise(token)


def domain_weights(items: DataFrame, groups: dict[str, tuple[int, int, tuple[str, ...]]] = CODE_GROUPS, no_weight: dict[str, tuple[str, ...]] = NO_WEIGHT) -> DataFrame:
    """(item, code, guideline, novelty, groups) of (item): the highest weights of the groups that an item's code is in; ``groups``
    names them all, those of no weight too."""
    code = F.col("code")
    nothing = [c for codes in no_weight.values() for c in codes]
    base = F.when(code.isin(nothing), 0).otherwise(1)
    weight = lambda at: F.greatest(base, *[F.when(code.isin(list(g[2])), g[at]).otherwise(0) for g in groups.values()], F.lit(0))
    lists = {name: g[2] for name, g in groups.items()} | no_weight
    names = F.array_compact(F.array(*[F.when(code.isin(list(codes)), name) for name, codes in lists.items()]))
    return items.select("item", item_code(F.col("item")).alias("code")).distinct().select("item", "code", weight(0).alias("guideline"), weight(1).alias("novelty"), F.array_join(names, ",").alias("groups"))


def domain_factors(weights: DataFrame, guideline: float = 0.2, novelty: float = 0.3, mask: bool = False) -> DataFrame:
    """(item, factor) for ``contingency.with_item_weights``: each weight of 0 to 3 raises the factor by its scale, in product.
    ``mask`` gives items that weigh nothing the factor 0; others that are unknown weigh 1 and 1."""
    factor = (1 + guideline * F.col("guideline") / 3) * (1 + novelty * F.col("novelty") / 3)
    if mask:
        factor = F.when((F.col("guideline") == 0) & (F.col("novelty") == 0), 0.0).otherwise(factor)
    return weights.select("item", factor.alias("factor"))


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.arrow_udf(DoubleType())
def name_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def _tokens(name: Column) -> Column:
    """The characters of a name, each with the number of times that it came up to there: a multiset as a set."""
    chars = F.regexp_extract_all(name, F.lit("(?s)(.)"), 1)
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))


def alike_candidates(one: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(n, m) of every name of ``one`` (name) and of ``other`` (name) whose likeness may be ``least`` or more, and few others.

    The likeness of two names, twice the characters of their matching runs over all their characters, is at most twice their shared
    multiset of characters over all. So names alike differ little in length, share enough characters, and share one of the first
    |n| - ceil(|n| least / (2 - least)) + 1 of each one's characters in any one order: here the rarest first. They meet on these.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    reach = least / (2 - least)
    names = cut(one.select("name").unionByName(other.select("name")).distinct().select("name", _tokens(F.col("name")).alias("tokens")))
    seen = names.select("name", F.explode("tokens").alias("token"))
    ranked = seen.join(seen.groupBy("token").agg(F.count("*").alias("k")), "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("order"))
    size = F.size("tokens")
    first = F.slice("order", 1, (size - F.ceil(size * reach - 1e-9) + 1).cast("int"))
    ready = cut(names.join(ranked, "name").select("name", "tokens", first["token"].alias("first")))
    side = lambda df, n: df.select("name").distinct().join(ready, "name").select(F.col("name").alias(n), F.col("tokens").alias(f"{n}_tokens"), F.explode("first").alias("token"))
    met = side(one, "n").join(side(other, "m"), "token")
    a, b = F.size("n_tokens"), F.size("m_tokens")
    met = met.filter(2 * F.least(a, b) >= least * (a + b) - 1e-9).filter(2 * F.size(F.array_intersect("n_tokens", "m_tokens")) >= least * (a + b) - 1e-9)
    return met.select("n", "m").distinct()


def enrich(items: DataFrame, known: DataFrame, synonyms: DataFrame | None = None, least: float = 0.8, default: str = "Not Set") -> DataFrame:
    """(item, name, label, how, ratio): the label of the known name (name, label) that an item's name equals but for case and marks
    (``exact``), that a synonym (synonym, name) leads to, or that is most like it with at least ``least`` (``similar``; ties by name);
    else ``default``. Only names that neither way settles are compared with the list of known ones, both lists of distinct names;
    ``alike_candidates`` finds all that can be alike. Null items and items without letters or digits get the default."""
    names = cut(items.select("item").distinct().withColumn("_n", plain_name(F.col("item"))))
    list_ = cut(known.select("name", "label", plain_name(F.col("name")).alias("_n")).filter("_n <> ''").groupBy("_n").agg(F.min(F.struct("name", "label")).alias("k")))
    ways = [names.join(list_, "_n").select("item", "k.name", "k.label", F.lit("exact").alias("how"), F.lit(1.0).alias("ratio"))]
    if synonyms is not None:
        other = synonyms.select(plain_name(F.col("synonym")).alias("_n"), plain_name(F.col("name")).alias("_to")).distinct()
        via = names.join(list_, "_n", "left_anti").join(other, "_n").join(list_.withColumnRenamed("_n", "_to"), "_to")
        ways.append(via.groupBy("item").agg(F.min("k").alias("k")).select("item", "k.name", "k.label", F.lit("synonym").alias("how"), F.lit(1.0).alias("ratio")))
    settled = cut(reduce(DataFrame.unionByName, ways))
    rest = cut(names.join(settled, "item", "left_anti"))
    near = alike_candidates(rest.filter("_n <> ''").select(F.col("_n").alias("name")).distinct(), list_.select(F.col("_n").alias("name")), least)
    scored = near.withColumn("ratio", name_ratio(F.col("n"), F.col("m"))).filter(F.col("ratio") >= least).join(list_.withColumnRenamed("_n", "m"), "m")
    best = scored.groupBy("n").agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col("k.name").alias("name"), F.col("k.label").alias("label"))).alias("b"))
    similar = rest.join(best, F.col("_n") == F.col("n"), "left").select("item", F.col("b.name").alias("name"), F.coalesce("b.label", F.lit(default)).alias("label"), F.when(F.col("b").isNull(), "none").otherwise("similar").alias("how"), (-F.col("b.r")).alias("ratio"))
    return settled.unionByName(similar)
