"""Mixing sources to target weights.

Every source's documents are hashed into blocks of similar row counts. The words a source may give (its target) decide how many
block draws it owes: whole passes over its blocks, then the first blocks of one more permuted pass. A binary tree splits these exact
quotas among the output shards: at each node the left half's share of every source is drawn from the multivariate hypergeometric
distribution (source after source, each by inverting the exact conditional distribution), so every shard gets disjoint blocks and
the quotas add up exactly. Inside a shard, draws are ordered by a hash.

Only DataFrame and SQL functions are used. Document rows are never windowed or grouped by source alone: what is windowed is the
table of sources, ``RANGES`` ranges of hashes of the table of blocks (one row for about ``rows_per_block`` documents) with running
sums over the ranges, and the documents of one block per source. The driver reads one row of totals. The array of quotas in a tree
node has one entry per source. Texts are shuffled once, to their shards: the table of draws is broadcast below Spark's limit.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_again, whole_row
from .shared import as_table, cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; share of all words that the mix takes; most passes over a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words of a shard, and ranges into which the blocks of a source are cut for running sums.
SHARD_WORDS, RANGES = 4_000_000, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, source_rows) with rank, weight and target: ``share`` of all words by weight, none above
    ``most`` times its source, the excess reshared. This is a water level: sources sorted by cap/weight are full up to the
    first whose cap lies above the level that the words still left would give. One row per source; a null source is last.
    """
    everything = Window.partitionBy()
    up_to = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    out = out.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))))
    out = out.withColumn("level", F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return out.select("source", "source_size", "source_rows", "rank", target.alias("target"))


def _split(nodes: DataFrame, seed: int) -> DataFrame:
    """Children of tree nodes (node, quotas): 2*node takes the left part, 2*node+1 the rest.

    ``e.m`` draws are left, ``e.n`` of them go left, ``quotas[i]`` are of this source. Unnormalised probabilities run from the
    mean less ten deviations to the mean plus ten; what lies beyond weighs less than a double can hold.
    """
    total = "aggregate(quotas, 0L, (s, q) -> s + q)"
    nodes = nodes.withColumn("left_size", F.expr(f"cast(floor({total} / 2) as bigint)"))
    mean = "(case when e.m = 0 then 0D else e.n * (quotas[i] / e.m) end)"
    spread = "(case when e.m < 2 then 0D else sqrt(e.n * (quotas[i] / e.m) * ((e.m - quotas[i]) / e.m) * ((e.m - e.n) / (e.m - 1))) end)"
    low = f"greatest(0L, e.n + quotas[i] - e.m, cast(floor({mean} - 10 * {spread}) - 5 as bigint))"
    high = f"least(quotas[i], e.n, cast(ceil({mean} + 10 * {spread}) + 5 as bigint))"
    step = "((quotas[i] - x) * 1D * (e.n - x)) / ((x + 1D) * greatest(1L, e.m - quotas[i] - e.n + x + 1))"
    total_w = f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 's', 0D), (a, x) -> named_struct('w', a.w * {step}, 's', a.s + a.w), a -> a.s)"
    u = f"((pmod(xxhash64(node, i, {seed}), 9007199254740992L) + 0.5D) / 9007199254740992D)"
    draw = (
        f"element_at(transform(array(named_struct('t', {total_w}, 'lo', {low}, 'hi', {high})), p -> "
        f"aggregate(sequence(p.lo, p.hi), named_struct('w', 1D, 's', 0D, 'k', p.lo), (a, x) -> named_struct('w', a.w * {step}, "
        f"'s', a.s + a.w, 'k', case when a.s + a.w < {u} * p.t and x < p.hi then x + 1 else a.k end), a -> a.k)), 1)"
    )
    # the draw is made once a source: it goes through a one-element array, as SQL lambdas have no local names
    body = f"element_at(transform(array({draw}), d -> named_struct('m', e.m - quotas[i], 'n', e.n - d, 'out', e.out || array(d))), 1)"
    fold = (
        f"aggregate(sequence(0, size(quotas) - 1), named_struct('m', {total}, 'n', left_size, 'out', cast(array() as array<bigint>)), "
        f"(e, i) -> {body}, e -> e.out)"
    )
    nodes = nodes.withColumn("went_left", F.expr(fold))
    return nodes.select(
        F.explode(
            F.expr(
                "array(named_struct('node', node * 2, 'quotas', went_left), "
                "named_struct('node', node * 2 + 1, 'quotas', zip_with(quotas, went_left, (a, b) -> a - b)))"
            )
        ).alias("c")
    ).select("c.node", "c.quotas")


def _running(rows: DataFrame, keys: list[str], place: Column, *totals: str) -> DataFrame:
    """Adds ``at`` (rows before) and ``<total>_before`` of each row in the order of keys[1:], range, place, block within keys[0]. Only
    a range is sorted in one task; ranges are added up beforehand."""
    rows = rows.withColumn("_h", place).withColumn("_range", F.pmod("_h", F.lit(RANGES)))
    by = [*keys, "_range"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in totals])
    before = Window.partitionBy(keys[0]).orderBy(*keys[1:], "_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(*by, F.coalesce(F.sum("_n").over(before), zero).alias("_n"), *[F.coalesce(F.sum(f"_{c}").over(before), zero).alias(f"_{c}") for c in totals])
    inside = Window.partitionBy(*by).orderBy("_h", "block")
    out = rows.withColumn("at", F.row_number().over(inside) - 1)
    for c in totals:
        out = out.withColumn(f"{c}_before", F.sum(c).over(inside) - F.col(c))
    out = out.join(sums, by).withColumn("at", F.col("at") + F.col("_n"))
    for c in totals:
        out = out.withColumn(f"{c}_before", F.col(f"{c}_before") + F.col(f"_{c}"))
    return out.drop("_h", "_range", "_n", *[f"_{c}" for c in totals])


def _order(doc_id: Column, text_key: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, text_key, F.lit(seed))


def _text_key(doc_id: Column, text: Column) -> Column:
    """Tells rows without an id apart."""
    return F.when(doc_id.isNull(), F.xxhash64(text))


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, rows_per_block: int = 256, shard_words: int = SHARD_WORDS, seed: int = 7):
    """(sizes, blocks, sources, shards): sizes is (doc_id, source, size, block, order) with source_size and target, checkpointed;
    blocks is (rank, block, draws), draws an array of (shard, slot, pass, cut, take): the block is taken whole, or, if cut is not
    null, documents of a lower order hash whole and those at it with ``take`` words each; sources is one row per source; shards is
    how many there are, of about ``shard_words`` words each."""
    base = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_key(F.col("doc_id"), F.col("text")).alias("key")))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = cut_lineage(targets(sources, weights, share, most).withColumn("blocks", F.ceil(F.col("source_rows") / rows_per_block)))
    rows = base.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = rows.withColumn("order", _order(F.col("doc_id"), F.col("key"), seed)).withColumn("block", F.pmod(F.xxhash64("order", F.lit(seed + 1)), F.col("blocks")))
    sizes = cut_lineage(rows.select("doc_id", "source", "rank", "block", "order", "size", "source_size", "target"))

    blocks = sizes.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    blocks = blocks.withColumn("full", full.cast("int")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full"))))
    blocks = _by_pass(blocks, seed)
    rest = F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    room = F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.least("words", rest - F.col("words_before")))
    blocks = blocks.withColumn("room", room).filter((F.col("room") > 0) | ((F.col("words") == 0) & (F.col("pass") < F.col("full"))))
    blocks = _running(blocks.drop("at"), ["rank", "pass"], F.xxhash64("block", "pass", F.lit(seed + 2))).withColumnRenamed("at", "position")
    draws = cut_lineage(blocks.select("rank", "block", "pass", "position", "words", "room"))

    quotas = draws.groupBy("rank").agg(F.count("*").alias("q"))
    total, words = draws.agg(F.count("*"), F.sum("room")).first()
    levels = max(0, ceil(log2(max(1, min(total, (words or 0) / shard_words)))))
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "q"))).alias("all"))
    ranks = nodes.select(F.posexplode(F.expr("transform(all, x -> x.rank)")).alias("i", "rank"))
    nodes = nodes.filter("size(all) > 0").select(F.lit(1).cast("long").alias("node"), F.expr("transform(all, x -> x.q)").alias("quotas"))
    for level in range(levels):
        nodes = _split(nodes, seed + 3)
        if level % 6 == 5:
            nodes = cut_lineage(nodes.repartition(max(1, 2 ** (level - 4)), "node"))
    shards = nodes.select((F.col("node") - 2**levels).alias("shard"), F.posexplode("quotas").alias("i", "q")).join(ranks, "i")
    by_shard = Window.partitionBy("rank").orderBy("shard")
    shards = shards.withColumn("stop", F.sum("q").over(by_shard)).filter("q > 0")
    dealt = shards.select("rank", "shard", F.explode(F.sequence(F.col("stop") - F.col("q"), F.col("stop") - 1)).alias("position"))
    dealt = draws.join(dealt, ["rank", "position"])

    part = dealt.filter("room < words").select("rank", "block", "pass", "room")
    docs_cut = sizes.join(part, ["rank", "block"]).groupBy("rank", "block", "pass", "room", "order").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    in_block = Window.partitionBy("rank", "block", "pass").orderBy("order")
    docs_cut = docs_cut.withColumn("left", F.col("room") - F.sum("words").over(in_block) + F.col("words")).filter((F.col("left") >= 0) & (F.col("left") < F.col("words")))
    docs_cut = docs_cut.select("rank", "block", "pass", F.col("order").alias("cut"), F.floor(F.col("left") / F.col("ties")).alias("take"))
    slot = F.xxhash64("rank", "position", "shard", F.lit(seed + 4)).alias("slot")
    dealt = dealt.join(docs_cut, ["rank", "block", "pass"], "left")
    drawn = as_table(dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", slot, "cut", "take"))).alias("draws")))
    return sizes, drawn, sources, 2**levels


def _by_pass(blocks: DataFrame, seed: int) -> DataFrame:
    """Adds words_before: what blocks earlier in the same permuted pass hold."""
    blocks = blocks.withColumn("turn", F.concat_ws("|", F.col("rank").cast("string"), F.col("pass").cast("string")))
    return _running(blocks, ["turn"], F.xxhash64("block", "pass", F.lit(seed + 2)), "words").drop("turn")


def _words(d: Column) -> Column:
    whole = d["cut"].isNull() | (F.col("order") < d["cut"])
    return F.when(whole, F.col("size")).when(F.col("order") == d["cut"], F.least("size", d["take"])).otherwise(F.lit(0)).cast("long")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the shards that take it.

    A null text has size 0. Rows with the same doc_id (without one: with the same text) share a block and an order hash, and share
    what a cut leaves them.
    An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    sizes, drawn, _, _ = plan(docs.select("doc_id", "source", "text"), **options)
    rows = sizes.join(drawn, ["rank", "block"], "left")
    counted = F.transform(F.coalesce("draws", F.expr("cast(array() as array<struct<pass:int,shard:bigint,slot:bigint,cut:bigint,take:bigint>>)")), lambda d: F.struct(d["shard"].alias("shard"), _words(d).alias("words")))
    rows = rows.withColumn("counted", F.filter(counted, lambda d: d["words"] > 0))
    return rows.select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        F.aggregate("counted", F.lit(0).cast("long"), lambda s, d: s + d["words"]).alias("taken"),
        F.array_join(F.transform("counted", lambda d: d["shard"].cast("string")), ",").alias("shards"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it was drawn (at most ``MOST`` times and once more if cut), with
    its own columns only, shuffled within shards, one partition a shard. A document at a cut is taken whole if at least half of it
    was left, else not, so no text is shortened; one without words goes with its block."""
    seed = options.get("seed", 7)
    row = docs.select(whole_row(docs), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "text")
    _, drawn, sources, shards = plan(docs.select("doc_id", "source", "text"), **options)
    facts = as_table(sources.select("source", "rank", "blocks"))
    row = row.withColumn("order", _order(F.col("_id"), _text_key(F.col("_id"), F.col("text")), seed))
    row = row.join(facts, F.col("_source").eqNullSafe(F.col("source"))).withColumn("block", F.pmod(F.xxhash64("order", F.lit(seed + 1)), F.col("blocks")))
    row = row.join(drawn, ["rank", "block"]).withColumn("d", F.explode("draws"))
    enough = F.when(F.col("d.cut").isNull() | (F.col("order") < F.col("d.cut")), True).when(F.col("order") == F.col("d.cut"), F.col("d.take") * 2 >= word_count(F.col("text"))).otherwise(False)
    mixed = row.filter(enough).repartitionById(shards, F.col("d.shard").cast("int"))
    return row_again(mixed.sortWithinPartitions(F.xxhash64("d.slot", "order", F.lit(seed + 5)), "order"), docs.columns)
