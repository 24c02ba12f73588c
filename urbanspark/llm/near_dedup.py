"""MinHash near-dedup by a signature-coordinate inverted join.

Every distinct shingle set gets a signature of ``coordinates`` minima. The pair
(coordinate, value) is a posting key; two sets collide once for each key they share.
Only pairs with at least ``matches`` collisions matter, so a set is posted under no
more than the ``coordinates - matches + 1`` rarest of its keys: any pair with enough
collisions meets under one of them, and keys that a common passage spreads over many
texts are skipped. Each pair that meets is confirmed on the full sets.

A posting list is never expanded into all its pairs. Each round compares a few leaders of
a list, members of its smallest components first, with the list's other members, and
then takes them out of the list: their pairs there are done. The pairs of the first round are
confirmed in two steps, each set's nearest pair first, then what still lies between
components: a set with ten links to one group travels once. Confirmed links contract
components, and a list that lies in one component is done. Where a group is held together
by its first leaders only its outsiders are ever compared with all of it, and parity bits
of the sets, which bound how far two sets are apart, refute most of these pairs inside
the join. Whatever the lists hold, they end when each pair of different components has
been compared. After the first round a pair is compared under the least key that it
shares, and so once.

Rows: words are runs outside space and U+0009..U+000D, A-Z lower-cased; a set holds the
distinct ``shingle_words``-word shingles, a shorter text its whole sequence as one. Null,
empty and blank texts have no set and are linked with nothing. Exact copies share one
set. Repeated rows keep their own output rows; a null doc_id is its own component unless
its text links it to another. An empty table gives an empty result. Other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions.session import broadcast_if_small, checkpointed
from urbanspark.llm import rowkeys
from urbanspark.llm import textbytes as tb

#: A pair of similarity 0.8 has fewer than MATCHES collisions once in 1,200,000 times.
COORDINATES, MATCHES = 48, 24
#: Two bits of every coordinate are compared first, in the join itself. A pair of similarity 0.8 differs in
#: more than this many of the 96 bits once in some hundred million times; unrelated ones differ in 43.
BITS_APART = 34
#: Columns of a set's parity bits: sixteen longs, as ``parities`` fills them.
PARITIES = tuple(f"p{i}" for i in range(16))
#: Leaders of a list in the first round, and how many times as many in each later round.
LEADERS, MORE_LEADERS = 1, 32
#: Rows up to this many of tables with a few longs are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Leaders up to this many, with signatures and parity bits (some 400 bytes each), are broadcast.
BROADCAST_LEADERS = 10_000
#: Ids of candidate texts up to this many are broadcast to the texts (some 40 bytes each); more are joined by shuffle.
BROADCAST_IDS = 100_000
#: Rows of a round's tables in one partition: small rounds leave few files.
PACKED_ROWS = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few partitions as ``rows`` rows need."""
    return df.coalesce(1 + rows // PACKED_ROWS)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each row, and where each row's begin."""
    n = len(offsets) - 1
    starts, ends, rows = tb.words(tb.LOWER[data], offsets)
    word = tb.hashes(tb.LOWER[data], starts, ends)
    bounds = tb.row_starts(rows, n)
    count = np.diff(bounds)
    # A window for each word that has size - 1 successors in its row, or for the first word of a short row.
    window = np.zeros(len(word), np.uint64)
    width = np.minimum(count, size)
    place = np.arange(len(word)) - bounds[:-1][rows]
    for k in range(size):
        take = np.flatnonzero((width[rows] > k) & (place + k < count[rows]))
        window[take] = tb.mix(window[take] + word[take + k] + np.uint64(k + 1))
    own = place <= (count - width)[rows]
    window, rows = window[own], rows[own]
    at = tb.row_starts(rows, n)
    for i in range(n):
        window[at[i] : at[i + 1]].sort()
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (rows[1:] != rows[:-1])
    return window[new], tb.row_starts(rows[new], n)


def _set_hash(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = tb.row_sums(tb.mix(items ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    return tb.mix(sums + np.diff(bounds).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(items: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """For each row with a set, 32 bits of each coordinate's minimum."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    minima = np.empty((len(full), coordinates), np.uint32)
    if not len(full):
        return minima
    seeds = tb.mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    at = bounds[full]
    for i in range(coordinates):
        least = np.minimum.reduceat(_permuted(items, seeds[2 * i], seeds[2 * i + 1]), at)
        minima[:, i] = tb.mix(least + np.uint64(i + 1)) >> np.uint64(32)
    return minima


def _permuted(items: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    x = (items ^ b) * (a | np.uint64(1))
    return x ^ (x >> np.uint64(29))


def _features(batches: Iterator[pa.RecordBatch], size: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, end, data, offsets in tb.text_slices(batch.column(1)):
            items, bounds = shingles(data, offsets, size)
            count = np.diff(bounds)
            full = count > 0
            minima = signatures(items, bounds, coordinates)
            bits = np.zeros((2, end - first), np.int64)
            for k in (0, 1):
                bits[k, full] = ((minima >> np.uint32(k) & np.uint32(1)).astype(np.int64) << np.arange(coordinates)).sum(axis=1)
            at = np.concatenate([[0], np.cumsum(np.where(full, coordinates, 0))]).astype(np.int32)
            posted = pa.ListArray.from_arrays(pa.array(at), pa.array(minima.ravel().view(np.int32)), mask=pa.array(~full))
            node = pa.array(tb.signed(_set_hash(items, bounds)), mask=~full)
            yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(count.astype(np.int64)), node, posted, pa.array(bits[0]), pa.array(bits[1]), *(pa.array(tb.signed(p)) for p in parities(items, bounds))], ["doc_id", "n", "node", "minima", "s0", "s1", *PARITIES])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in tb.text_slices(batch.column(0)):
            items, bounds = shingles(data, offsets, size)
            node = tb.signed(_set_hash(items, bounds))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tb.signed(items)))], ["node", "items"])


def parities(items: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For each row, whether an odd number of its items falls on each of 64 * len(PARITIES) bits.

    Two rows differ in no more bits than their sets have items apart.
    """
    mixed = tb.mix(items ^ np.uint64(0x2545F4914F6CDD1D))
    word, bit = mixed >> np.uint64(60), np.uint64(1) << ((mixed >> np.uint64(54)) & np.uint64(63))
    for i in range(len(PARITIES)):
        odd = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == i, bit, np.uint64(0)))])
        yield odd[bounds[1:]] ^ odd[bounds[:-1]]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is its component's least node.

    Alternates large-star and small-star rounds until each node points at a root, so chains
    shrink in a logarithmic number of rounds.
    """
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    n = pairs.count()
    while n and not _is_star_forest(pairs, n):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = packed(both.groupBy("a").agg(F.min("b").alias("m")), n).select("a", F.least("a", "m").alias("m"))
        large = packed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"), n).distinct()
        large = checkpointed(packed(large, n))
        down = packed(large.groupBy("a").agg(F.min("b").alias("m")), n)
        small = packed(large.join(down, "a"), n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(packed(small.where("a != b").distinct(), n))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _is_star_forest(pairs: DataFrame, n: int) -> bool:
    """Whether every a has one b, and no b is an a itself."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(packed(pairs.select("b", F.lit(None).cast("int")).distinct(), n))
    return ends.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 2, similarity: tuple[int, int] = (80, 100), coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two texts are linked when ``similarity[1] * |intersection| >= similarity[0] * |union|``;
    component_id is the least id reachable over links and kept marks its row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    features = checkpointed(rows.mapInArrow(partial(_features, size=shingle_words, coordinates=coordinates), ", ".join([f"doc_id {id_type}, n long, node long, minima array<int>, s0 long, s1 long", *(f"{p} long" for p in PARITIES)])))
    full = features.where("node is not null")
    nodes = checkpointed(full.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.max(c).alias(c) for c in ("n", "s0", "s1"))))
    postings = checkpointed(_prefix_postings(full, nodes, matches))
    signed = checkpointed(_signed(full, postings, nodes))
    comps = components(_links(rows, nodes, postings, signed, shingle_words, similarity, matches))
    least = nodes.join(comps, "node", "left").select(nodes["node"], F.coalesce("comp", "node").alias("comp"), "least")
    least = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    found = features.select("doc_id", "n", "node").join(least, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _key(coordinate, minimum):
    """The posting key of a coordinate's value, as one long."""
    return F.shiftleft(coordinate.cast("long"), 32).bitwiseOR(minimum.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _prefix_postings(full: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """(key, node, n, s0, s1) under the rarest keys of each set that could reach ``matches`` collisions."""
    owner = full.join(nodes, (full["doc_id"].eqNullSafe(nodes["least"])) & (full["node"] == nodes["node"])).select(full["node"], full["minima"])
    posted = owner.select("node", F.posexplode("minima").alias("i", "v")).select("node", _key(F.col("i"), F.col("v")).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").cast("int").alias("f")).where("f > 1")
    met = posted.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("f", "key"))).alias("met"))
    # Keys met by nobody else come first in the order of rarity, so they use up the prefix.
    prefix = F.slice("met", 1, F.size("met") - matches + 1)
    kept = met.where(F.size("met") >= matches).select("node", F.explode(prefix).alias("p")).select("node", F.col("p.key").alias("key"))
    return kept.join(nodes.drop("least"), "node")


def _signed(full: DataFrame, postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, minima, mask, parities) of the sets that have a posting; mask: a bit for each coordinate they are posted under."""
    masks = postings.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")).alias("mask"))
    # A hash of the id beside the node spreads copies of one text; repeated rows then go where they are joined.
    ids = nodes.join(masks, "node").select("node", F.xxhash64("least").alias("__of"), F.col("least").alias("__id"), "mask")
    own = full.withColumn("__of", F.xxhash64("doc_id")).join(ids, ["node", "__of"]).where(F.col("doc_id").eqNullSafe(F.col("__id")))
    return own.select("node", "__of", "minima", "mask", *PARITIES).dropDuplicates(["node", "__of"]).drop("__of")


def _sets_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items) of the wanted nodes, read from one text each and partitioned by node for the joins that follow."""
    ids = checkpointed(nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("__id")).distinct())
    few = broadcast_if_small(ids, BROADCAST_IDS)
    texts = rows.join(few, rows["doc_id"].eqNullSafe(few["__id"]), "left_semi").select("text")
    items = texts.mapInArrow(partial(_sets, size=size), "node long, items array<long>")
    return items.join(broadcast_if_small(wanted, BROADCAST_IDS), "node", "left_semi").dropDuplicates(["node"])


def _links(rows: DataFrame, nodes: DataFrame, postings: DataFrame, signed: DataFrame, size: int, similarity: tuple[int, int], matches: int) -> DataFrame:
    """Links (a, b) that hold every component of the sets together; each is confirmed on the full sets."""
    open_ = postings.withColumns({"comp": F.col("node"), "weight": F.lit(1).cast("long")})
    left, leaders, turn, links = open_.count(), LEADERS, 0, None
    while left:
        ranked = open_.withColumn("rank", F.struct("weight", F.xxhash64("node", "key").alias("h"), "node"))
        lead = _leaders(ranked, leaders, left)
        met = _met(ranked, lead, similarity)
        if turn == 0:
            pairs = _colliding(packed(met.distinct(), left), signed, matches, similarity)
        else:
            same = F.transform("minima", lambda x, i: x == F.get("l_minima", i))
            both = F.col("mask").bitwiseAND(F.col("l_mask"))
            least = F.array_position(F.transform(same, lambda s, i: s & (F.call_function("getbit", both, i) == 1)), True) - 1
            pairs = met.where((F.size(F.filter(same, lambda s: s)) >= matches) & (least == F.shiftright("key", 32)))
        pairs = checkpointed(packed(pairs.select("a", "b", "ca", "cb", "odd"), left * leaders))
        if turn == 0:
            nearest = checkpointed(packed(_nearest(pairs), left))
            linked = _confirmed(nearest, rows, nodes, size, similarity, left)
            pairs = checkpointed(packed(_between(pairs, nearest, linked), left))
            linked = linked.union(_confirmed(pairs, rows, nodes, size, similarity, left))
        else:
            linked = _confirmed(pairs, rows, nodes, size, similarity, left * leaders)
        links = linked if links is None else links.union(linked)
        open_ = _still_open(ranked, lead, linked, left)
        if turn == 0:
            open_ = open_.join(signed, "node")
        open_ = checkpointed(packed(open_, left))
        left, turn, leaders = open_.count(), turn + 1, leaders * MORE_LEADERS
    if links is None:
        return postings.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return links.select("a", "b")


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each set the pair in which fewest parity bits differ."""
    each = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("odd", "a", "b", "ca", "cb").alias("pair"))
    return each.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.*").distinct()


def _between(pairs: DataFrame, tried: DataFrame, linked: DataFrame) -> DataFrame:
    """The untried pairs of different components after ``linked``."""
    comps = checkpointed(components(linked.select("a", "b")))
    one, other = (broadcast_if_small(comps.select(F.col("node").alias(k), F.col("comp").alias(f"{k}_into")), BROADCAST_ROWS) for k in "ab")
    rest = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(one, "a", "left").join(other, "b", "left")
    return rest.where(F.coalesce("a_into", "a") != F.coalesce("b_into", "b")).select("a", "b", "ca", "cb", "odd")


def _odd(one: str, other: str) -> Column:
    """How many parity bits two sets differ in."""
    return sum((F.bit_count(F.col(f"{one}{p}").bitwiseXOR(F.col(f"{other}{p}"))) for p in PARITIES), F.lit(0))


def _apart(odd: Column, both: Column, similarity: tuple[int, int]) -> Column:
    """Whether ``odd`` parity bits leave sets of ``both`` shingles together as near as a link needs."""
    return odd * (similarity[0] + similarity[1]) <= both * (similarity[1] - similarity[0])


def _leaders(ranked: DataFrame, leaders: int, n: int) -> DataFrame:
    """The first members of each list, their columns as l_*."""
    first = ranked.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("rank"))).where(F.col("place") <= leaders)
    return checkpointed(packed(first.select("key", *(F.col(c).alias(f"l_{c}") for c in ranked.columns if c not in ("key", "weight"))), n))


def _met(ranked: DataFrame, lead: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Members beside the leaders before them in rank, of other components, if sizes and bits allow a link."""
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("l_s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("l_s1")))
    sizes = F.least("n", "l_n") * similarity[1] >= F.greatest("n", "l_n") * similarity[0]
    if PARITIES[0] in ranked.columns:
        sizes &= _apart(_odd("", "l_"), F.col("n") + F.col("l_n"), similarity)
    met = ranked.join(broadcast_if_small(lead, BROADCAST_LEADERS), "key").where((F.col("rank") > F.col("l_rank")) & (F.col("comp") != F.col("l_comp")) & sizes & (apart <= BITS_APART))
    ends = {"a": F.least("node", "l_node"), "b": F.greatest("node", "l_node"), "both": F.col("n") + F.col("l_n")}
    swapped = F.col("node") > F.col("l_node")
    ends |= {"ca": F.when(swapped, F.col("l_comp")).otherwise(F.col("comp")), "cb": F.when(swapped, F.col("comp")).otherwise(F.col("l_comp"))}
    more = [c for c in ("key", "minima", "mask", "l_minima", "l_mask") if "minima" in ranked.columns]
    if more:
        ends |= {"odd": _odd("", "l_")}
    return met.select(*(v.alias(k) for k, v in ends.items()), *more)


def _colliding(pairs: DataFrame, signed: DataFrame, matches: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose signatures may collide often enough and whose parity bits allow a link.

    Eight bits of each minimum travel with a pair: equal minima stay equal, so no collision is missed, and
    the few pairs that pass by equal bits of different minima are confirmed on full sets like all others.
    """
    short = F.transform("minima", lambda m: (m.bitwiseAND(F.lit(255)) - 128).cast("tinyint")).alias("minima")
    signed = signed.select("node", short, *PARITIES)
    left, right = (signed.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("minima", *PARITIES))) for k in "ab")
    same = F.filter(F.zip_with("a_minima", "b_minima", lambda x, y: x == y), lambda s: s)
    met = pairs.join(left, "a").join(right, "b").where(_apart(_odd("a_", "b_"), F.col("both"), similarity)).where(F.size(same) >= matches)
    return met.withColumn("odd", _odd("a_", "b_"))


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, similarity: tuple[int, int], n: int) -> DataFrame:
    """The pairs whose full sets are similar. The sets are shuffled once: both joins read the one exchange by node."""
    found = pairs.select("a", "b", "ca", "cb")
    if found.isEmpty():
        return found
    ends = packed(found.select(F.col("a").alias("node")).union(found.select("b")).distinct(), n)
    sets = _sets_of(rows, nodes, checkpointed(ends), size)
    left, right = (sets.select(F.col("node").alias(k), F.col("items").alias(f"i{k}")) for k in "ab")
    both = F.size(F.array_intersect("ia", "ib"))
    linked = both * similarity[1] >= (F.size("ia") + F.size("ib") - both) * similarity[0]
    return checkpointed(packed(found.join(left, "a").join(right, "b").where(linked).select("a", "b", "ca", "cb"), n))


def _still_open(ranked: DataFrame, lead: DataFrame, linked: DataFrame | None, n: int) -> DataFrame:
    """The postings without the leaders, their components contracted, of the lists that still hold several."""
    last = packed(lead.groupBy("key").agg(F.max("l_rank").alias("last")), n)
    open_ = ranked.join(broadcast_if_small(last, BROADCAST_ROWS), "key").where("rank > last").drop("rank", "last", "weight")
    if linked is not None:
        merged = checkpointed(components(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("into")))
        open_ = open_.join(broadcast_if_small(merged, BROADCAST_ROWS), "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")
    open_ = checkpointed(packed(open_, n))
    spread = checkpointed(packed(open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"), n))
    open_ = checkpointed(packed(open_.join(broadcast_if_small(spread, BROADCAST_ROWS), "key", "left_semi"), n))
    weights = checkpointed(packed(open_.groupBy("comp").agg(F.count("*").alias("weight")), n))
    return open_.join(broadcast_if_small(weights, BROADCAST_ROWS), "comp")


@rowkeys.apart
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8.

    Null, empty and blank texts are linked with nothing and stay, each row of them. Of rows that agree in
    id and text one stays, whichever it is in its other columns. A null id is an id. An empty table
    gives an empty one; columns of any name are kept.
    """
    rows = rowkeys.keyed(docs)
    copies = link(rowkeys.named(rows), shingle_words=5).where("NOT kept")
    left = rowkeys.without(rows, copies)
    # Rows that agree in id and text are kept or dropped together; one of them stays, if it has any word.
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    repeated = checkpointed(rows.where(worded).groupBy(rowkeys.KEY).agg(F.count("*").alias("n")).where("n > 1").select(F.col(rowkeys.KEY).alias("__again")))
    again = left[rowkeys.KEY].eqNullSafe(repeated["__again"])
    once = left.join(repeated, again, "left_semi").dropDuplicates([rowkeys.KEY])
    return left.join(repeated, again, "left_anti").union(once).select(*docs.columns)
