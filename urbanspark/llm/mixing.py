"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Targets: the sources, by code point and null last, weigh ``weights`` in repetition and share
``share`` times all words; a target stops at ``most`` times its source's words and what is
over is shared again by weight.

A source's documents, by doc_id, are one stream of words, cut into blocks of ``block`` words
(the last is shorter). Each pass over a source has a permutation of its blocks and takes
them in that order until its words are reached: the block that crosses the end is taken in
part, so a source gives its rounded target to the word and no word is taken more than
once a pass.

The drawn blocks go to output shards of ``per_shard`` blocks or fewer. A binary tree over the shards
splits the sources' quotas: the left half's capacity is exact, its share of each source is
a hypergeometric draw given what the sources before it got, so a shard's composition is
that of a random permutation of all drawn blocks without one being made. A shard takes its
quota as the next blocks in the source's permuted order, disjoint from every other shard's,
and is shuffled by itself. All randomness is a hash of ``seed`` and places, so reruns agree
however the rows are dealt.

The tree's nodes carry one number a source: sources are collections, not documents.

Edge cases: a null text has no words; documents without words are returned with nothing
taken; a null source is a source; rows alike in doc_id, source and size are exchangeable; a
null doc_id comes first. Without words every target is 0. Other columns are neither read
nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions.session import broadcast_if_small, checkpointed
from urbanspark.llm.ranks import ordered, running

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK, PER_SHARD = 1024, 8192
#: Sources up to this many are broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Levels of the tree between two checkpoints.
LEVELS_AT_ONCE = 6


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(s, source, source_size, target): sources numbered in order, with what the mix shall take.

    Capped sources are those of least capacity for their weight: each is held against the
    level that is left when the ones before it have their capacity.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = sums.withColumn("s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    each = each.withColumns({"weight": weight, "most": F.col("source_size") * float(most)})
    by = W.orderBy(F.col("most") / F.col("weight"), "s")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    budget = F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * float(share)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    held = each.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("s"), F.col("level").alias("level")))).over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("capped"), F.col("most")).otherwise(free["level"] * F.col("weight"))
    return held.select("s", "source", "source_size", target.alias("target"))


def uniform(*parts: Column) -> Column:
    """A number within [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """``_drawn`` of arguments that are worked out once: a lambda's variable is a value, a column in it an expression for each step."""
    given = F.array(F.struct(good.alias("good"), total.alias("total"), draws.alias("draws"), u.alias("u")))
    return F.get(F.transform(given, lambda e: _drawn(e["good"], e["total"], e["draws"], e["u"])), 0)


def _drawn(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` are among the ``good``: the inverse of the distribution at ``u``.

    Weights follow from their neighbour by the exact ratio, over 12 deviations (and 12) on
    both sides of the mean; beyond lies less than a double can tell from nothing.
    """
    low, high = F.greatest(F.lit(0), draws - (total - good)), F.least(draws, good)
    p = good / F.greatest(total, F.lit(1))
    mean = draws * p
    reach = 12 * F.sqrt(F.greatest(mean * (1 - p) * (total - draws) / F.greatest(total - 1, F.lit(1)), F.lit(0.0))) + 12
    first = F.greatest(low, F.floor(mean - reach).cast("long"))
    last = F.least(high, F.ceil(mean + reach).cast("long"))
    steps = F.sequence(first + 1, last)
    ratio = lambda x: (good - x + 1) / x * ((draws - x + 1) / (total - good - draws + x))
    one = F.lit(1.0)
    # w is the weight of the number before x; each is added once it has been passed
    summed = F.aggregate(steps, F.struct(one.alias("w"), F.lit(0.0).alias("sum")), lambda acc, x: F.struct((acc["w"] * ratio(x.cast("double"))).alias("w"), (acc["sum"] + acc["w"]).alias("sum")), lambda acc: acc["sum"] + acc["w"])
    start = F.struct(one.alias("w"), (u * summed).alias("left"), first.alias("x"))

    def step(acc: Column, x: Column) -> Column:
        on = acc["left"] >= acc["w"]
        return F.struct(F.when(on, acc["w"] * ratio(x.cast("double"))).otherwise(acc["w"]).alias("w"), F.when(on, acc["left"] - acc["w"]).otherwise(acc["left"]).alias("left"), F.when(on, x).otherwise(acc["x"]).alias("x"))

    return F.when(first == last, first).otherwise(F.aggregate(steps, start, step, lambda acc: acc["x"]))


def left_quotas(quotas: Column, capacity: Column, *place: Column) -> Column:
    """The left half's quotas: each source's draw given what the sources before it got."""
    added = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, v: t + v)

    def step(got: Column, s: Column) -> Column:
        return F.concat(got, F.array(hypergeometric(quotas[s], added(F.slice(quotas, s + 1, F.size(quotas))), capacity - added(got), uniform(*place, s))))

    return F.aggregate(F.sequence(F.lit(0), F.size(quotas) - 1), F.array().cast("array<long>"), step)


def split(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, quotas, begins) of each shard, from one row (quotas: blocks of each source).

    ``begins`` is where the shard's blocks begin in each source's order.
    """
    tasks = max(quotas.sparkSession.sparkContext.defaultParallelism, 1)
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas", F.transform("quotas", lambda q: F.lit(0).cast("long")).alias("begins"))
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        width, half = F.col("hi") - F.col("lo"), F.floor((F.col("hi") - F.col("lo")) / 2)
        whole = F.aggregate("quotas", F.lit(0).cast("long"), lambda t, q: t + q)
        # capacities differ by less than one block a shard: total * half / width, in whole numbers
        capacity = F.floor(whole / width) * half + F.floor((whole % width) * half / width)
        cut = nodes.withColumn("left", F.when(width > 1, left_quotas(F.col("quotas"), capacity, F.lit(seed), F.col("lo"), F.col("hi"))))
        one = F.struct("lo", (F.col("lo") + half).alias("hi"), F.col("left").alias("quotas"), "begins")
        two = F.struct((F.col("lo") + half).alias("lo"), "hi", F.zip_with("quotas", "left", lambda q, a: q - a).alias("quotas"), F.zip_with("begins", "left", lambda b, a: b + a).alias("begins"))
        same = F.struct("lo", "hi", "quotas", "begins")
        nodes = cut.select(F.inline(F.when(width > 1, F.array(one, two)).otherwise(F.array(same))))
        nodes = nodes.repartition(min(2 << level, tasks), "lo")  # halves of a node go to different tasks
        if level % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
            nodes = checkpointed(nodes)
    return nodes.select(F.col("lo").alias("shard"), "quotas", "begins")


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(r, doc_id, s, size, start): each document's place in its source's stream of words."""
    own = sizes.join(broadcast_if_small(sources.select("s", F.col("source").alias("__source")), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__source"))).select("s", "doc_id", "size")
    placed = running(ordered(own, "s", "doc_id", "size"), before=F.col("size"))
    base = sources.select("s", F.coalesce(F.sum("source_size").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return placed.join(broadcast_if_small(base, BROADCAST_SOURCES), "s").select("r", "doc_id", "s", "size", (F.col("before") - F.col("base")).alias("start"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(r, s, b, first, words): each document cut at its source's block borders; first counts within the block."""
    end = F.col("start") + F.col("size")
    div = lambda c: F.floor(c / block)
    cut = placed.where("size > 0").select("r", "s", "start", end.alias("end"), F.explode(F.sequence(div(F.col("start")), div(end - 1))).alias("b"))
    first = F.greatest(F.col("start"), F.col("b") * block)
    return cut.select("r", "s", "b", (first - F.col("b") * block).alias("first"), (F.least("end", (F.col("b") + 1) * block) - first).alias("words"))


def draw(cut: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(s, b, pass, i, taken): the drawn blocks, numbered in each source's permuted order.

    ``taken`` is the block's words that the pass takes, from its start.
    """
    whole = F.round("target").cast("long")
    once = F.least(whole, F.col("source_size"))
    quota = sources.select("s", "source_size", F.ceil(F.col("source_size") / block).alias("blocks"), F.posexplode(F.array(once, whole - once)).alias("pass", "quota")).where("quota > 0")
    earlier = W.orderBy("s", "pass").rowsBetween(W.unboundedPreceding, -1)
    quota = quota.withColumns({"words_before": F.coalesce(F.sum("source_size").over(earlier), F.lit(0)), "blocks_before": F.coalesce(F.sum("blocks").over(earlier), F.lit(0))})
    quota = broadcast_if_small(checkpointed(quota), 2 * BROADCAST_SOURCES)
    # a block's first word is in exactly one document, whose piece stands for the block
    blocks = cut.where("first = 0").select("s", "b").join(quota, "s")
    length = F.least(F.lit(block), F.col("source_size") - F.col("b") * block).alias("length")
    rows = blocks.select("s", "pass", "b", length, "quota", "blocks", "words_before", "blocks_before", F.xxhash64(F.lit(seed), "s", "pass", "b").alias("key"))
    permuted = running(ordered(rows, "s", "pass", "key", "b"), before=F.col("length"), rank=F.lit(1))
    before = F.col("before") - F.col("words_before")
    place = F.col("rank") - F.col("blocks_before") + F.col("pass") * F.col("blocks")
    return permuted.where(before < F.col("quota")).select("s", "b", "pass", place.alias("i"), F.least("length", F.col("quota") - before).alias("taken"))


def dealt(drawn: DataFrame, sources: DataFrame, per_shard: int = PER_SHARD, seed: int = 0) -> DataFrame:
    """(shard, position, s, b, pass, taken): the drawn blocks in their shards, each shuffled by itself."""
    counts = drawn.groupBy("s").agg(F.count("*").alias("n"))
    each = sources.select("s").join(counts, "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n"))
    row = checkpointed(each.agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "n"))), lambda q: q["n"]).alias("quotas"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")))
    shards = -(-row.first()["all"] // per_shard)
    leaves = split(row.where("all > 0"), shards, seed)
    own = leaves.select("shard", "begins", F.posexplode("quotas").alias("s", "n")).where("n > 0")
    begin = F.col("begins")[F.col("s")]
    places = own.select("shard", F.col("s").cast("int").alias("s"), F.explode(F.sequence(begin, begin + F.col("n") - 1)).alias("i"))
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("shuffle"), "s", "i"), "s", "i")
    # both sides grow with the words, though the planner, which sees the tree grow from one row, may think otherwise
    return drawn.hint("merge").join(places, ["s", "i"]).select("shard", (F.row_number().over(order) - 1).alias("position"), "s", "b", "pass", "taken")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, mixed).

    documents: (r, doc_id, s, size, start); sources: (s, source, source_size, target); mixed:
    (shard, position, pass, s, b, r, first, words), the pieces of documents in each place of each shard.
    """
    sizes = checkpointed(sized(docs))
    sources = checkpointed(targets(sizes, weights, share, most))
    placed = checkpointed(streams(sizes, sources))
    cut = pieces(placed, block)
    out = dealt(checkpointed(draw(cut, sources, block, seed)), sources, per_shard, seed)
    words = F.least(F.col("first") + F.col("words"), F.col("taken")) - F.col("first")
    mixed = cut.hint("merge").join(out, ["s", "b"]).where(words > 0).select("shard", "position", "pass", "s", "b", "r", "first", words.alias("words"))
    return placed, sources, mixed


def taken(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, first_position) of every document."""
    placed, sources, mixed = mix(docs, **parameters)
    first = F.min(F.struct("shard", "position"))
    used = mixed.groupBy("r").agg(F.sum("words").alias("taken"), first.alias("at"))
    known = placed.join(broadcast_if_small(sources.drop("source"), BROADCAST_SOURCES), "s").hint("merge").join(used, "r", "left")
    return known.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.col("at.shard").alias("first_shard"), F.col("at.position").alias("first_position"))
