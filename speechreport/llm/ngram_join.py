"""N-gram Jaccard join by prefix filters under several global orders of the shingles.

A document's set is its distinct 5-word shingles. For a Jaccard similarity of 0.8, two sets that link
share a shingle among the first fifth of each, whatever the global order. The first order puts
shingles that are frequent in the corpus last, so passages that many documents share hardly make
candidates; candidates must then share enough prefix shingles under every one of the orders before
their sets are compared exactly. Texts, not sets, are sent to that comparison, as hashes don't compress.

Equal sets are one node. Frequent prefix shingles would give all pairs of a large group of near
copies, so candidates come in two steps. First every member of a shingle's group meets one hub, the
member with the fewest rare shingles. Then members that are still in different components meet:

* in groups of at most PAIRED members, every pair that the length and position filters leave;
* in larger groups, by what sets them apart from the hub. With X the symmetric difference of a set x
  and the hub h, the difference of x and y is that of X and Y, so x and y link if X and Y overlap
  enough, and two members that are not near the hub must share some of the little that they don't have
  in common with it. These differences are joined by a prefix filter of their own, rare shingles
  first; independent edits of one text share none, however large their group is.

Links inside a component that is already connected don't change the result and aren't compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import dropped, materialize, small
from speechreport.llm.components import components
from speechreport.llm.shingles import WORDS, all_sets, mixed, slices

PERCENT = 80
#: Shingles whose frequency class every task knows; the most frequent ones, so 9 MB at most.
KNOWN = 1 << 20
#: Shingles that a task counts at a time. What occurs once in each such share is not counted.
COUNTED = 1 << 22
ORDERS = 3
#: Members of a group that are compared in pairs at most; members of larger groups meet by their difference to the hub.
PAIRED = 32
#: Shingles with 2**HOT counted occurrences and more have their postings dealt over SALTS tasks.
HOT, SALTS = 13, 64
#: Rows of pairs that meet one text in one task.
SHARE = 4096
#: Rows that a task puts into one batch.
ROWS = 1 << 17


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def summarize(df: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, n, set_key) of documents and rows (shingle, n) of partial counts, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            none = pa.nulls(len(n))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(n.astype(np.int64)), none.cast(pa.binary()), pa.array(_signed(tokens))], names)

        for batch in slices(batches):
            sets = all_sets(batch.column(1).to_pylist(), words)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(sets)).cast(pa.int64())], names)
            for s in sets:
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield counts()
                    held, size = [], 0
        if size:
            yield counts()

    names = ["doc_id", "n", "set_key", "shingle"]
    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, shingle long")


def frequent(partial: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and the classes (log2) of their counts.

    At most KNOWN rows reach the driver: the least class is the first from which that many are left.
    """
    counts = materialize(partial.groupBy("shingle").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("rank")))
    by_class = {r["rank"]: r["count"] for r in counts.groupBy("rank").count().collect()}
    least, found = max(by_class, default=0) + 1, 0
    for rank in sorted(by_class, reverse=True):
        found += by_class[rank]
        if found > KNOWN:
            break
        least = rank
    rows = counts.filter(F.col("rank") >= least).toArrow()
    tokens, ranks = rows["shingle"].to_numpy().view(np.uint64), rows["rank"].to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def classes(s: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The frequency class of each shingle; 0 for those that aren't known to be frequent."""
    tokens, ranks = known
    rank = np.zeros(len(s), np.uint8)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        hit = tokens[at] == s
        rank[hit] = ranks[at[hit]]
    return rank


def in_order(s: np.ndarray, known: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """The shingles in global order number ``order``: by frequency class, then by a hash of their own."""
    return s[np.lexsort((mixed(s + np.uint64(order)) if order else s, classes(s, known)))]


class Rows:
    """Columns of numbers that are gathered and given as batches of about ROWS rows."""

    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, [], 0

    def add(self, n: int, *columns: object) -> None:
        self.held.append([np.full(n, c) if np.isscalar(c) else c for c in columns])
        self.size += n

    def batch(self) -> pa.RecordBatch:
        found = [pa.array(np.concatenate(c)) for c in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays(found, self.names)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def postings(df: DataFrame, known: Broadcast, percent: int) -> DataFrame:
    """(shingle, salt, node, n, place, rare) for the prefix of every row (node, text) in the first order.

    rare: the set's shingles that aren't known to be frequent. salt: -1, or for hot shingles a number by node.
    """

    hot = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(["shingle", "salt", "node", "n", "place", "rare"])
        for batch in slices(batches):
            for node, s in zip(batch.column(0).to_pylist(), all_sets(batch.column(1).to_pylist()), strict=True):
                if len(s):
                    own = in_order(s, known.value, 0)
                    rank = classes(own, known.value)
                    k = prefix_size(len(s), percent)
                    salt = int(mixed(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(SALTS))
                    rows.add(k, _signed(own[:k]), np.where(rank[:k] >= hot, salt, -1).astype(np.int32), np.int64(node), np.int32(len(s)), np.arange(k, dtype=np.int32), np.int32((rank == 0).sum()))
                if rows.size >= ROWS:
                    yield rows.batch()
        if rows.size:
            yield rows.batch()

    return df.mapInArrow(run, "shingle long, salt int, node long, n int, place int, rare int")


def differences(df: DataFrame, known: Broadcast, percent: int, words: int = WORDS) -> DataFrame:
    """What sets rows (node, part, hub, text, hub_text) apart from their hub: base, token, node, part, hub,
    n, d, place, near, core.

    base stands for the hub's set, token for a shingle that one of both has (place -1: none, one such row
    for each row of df), d for how many there are, near for whether row and hub link. With u = 100 + percent
    and v = 100 - percent, x and y link if u * |X - Y| <= v * (|x| + |y|), that is, if X and Y share
    o >= (W(x) + W(y)) / 2u with W(x) = u * |X| - v * |x|. The size of y is at most 100 / percent that of x,
    so o >= |X| - v * |x| / percent for any y. For y of no smaller W, and for y that aren't near (W(y) > v * |h|),
    the first bound gives more, and it is never below 1. Given are the |X| - o + 1 first shingles for any y;
    core tells which of them are enough for the others. Shingles that the hub lacks come first, then those that
    it has, the frequent ones first: what few texts share with the hub is what most of its group lack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(["base", "token", "node", "part", "hub", "n", "d", "place", "near", "core"])
        u, v = 100 + percent, 100 - percent
        for batch in slices(batches):
            nodes, parts, hubs, texts, hub_texts = (c.to_pylist() for c in batch.columns)
            named = list(dict.fromkeys(hub_texts))
            bases = dict(zip(named, all_sets(named, words), strict=True))
            for node, part, hub, x, told in zip(nodes, parts, hubs, all_sets(texts, words), hub_texts, strict=True):
                h = bases[told]
                if not len(x) or not len(h):  # another text of the same key
                    continue
                own, gone = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                gone = gone[np.lexsort((gone, -classes(gone, known.value).astype(int)))]
                more = np.concatenate([in_order(own, known.value, 0), gone])
                d, n = len(more), len(x)
                near = u * d <= v * (n + len(h))
                long = d - max(1, d - v * n // percent) + 1
                w = u * d - v * n
                core = min(long, d - max(1, -(-(w + max(w, v * len(h) + 1)) // (2 * u))) + 1)
                k = core if near else long
                base = np.int64(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                fixed = (np.int64(node), np.int64(part), np.int64(hub), np.int32(n), np.int32(d))
                rows.add(1, base, np.int64(0), *fixed, np.int32(-1), np.bool_(near), np.bool_(False))
                rows.add(k, base, _signed(more[:k]), *fixed, np.arange(k, dtype=np.int32), np.bool_(near), np.arange(k) < core)
                if rows.size >= ROWS:
                    yield rows.batch()
        if rows.size:
            yield rows.batch()

    return df.select("node", "part", "hub", "text", "hub_text").mapInArrow(run, "base long, token long, node long, part long, hub long, n int, d int, place int, near boolean, core boolean")


def heads(df: DataFrame, known: Broadcast, percent: int) -> DataFrame:
    """(node, n, heads) of rows (node, text): its prefixes in every order.

    A shingle is cut to 32 bits here. Two that differ may then look equal, which can only let a
    candidate through to the exact check.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = all_sets(batch.column(1).to_pylist())
            cut = [[(in_order(s, known.value, k)[: prefix_size(len(s), percent)] >> np.uint64(32)).astype(np.uint32).view(np.int32) for k in range(ORDERS)] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int32()), pa.array(cut, pa.list_(pa.list_(pa.int32())))], ["node", "n", "heads"])

    return df.mapInArrow(run, "node long, n int, heads array<array<int>>")


def similar(df: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of rows (a, b, text_a, text_b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = (all_sets(batch.column(i).to_pylist(), words) for i in (2, 3))
            links = []
            for x, y in zip(left, right, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                links.append(len(x) > 0 and (100 + percent) * shared >= percent * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(links, pa.bool_()))

    return df.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def enough(a_n: Column, b_n: Column, left: Column, percent: int) -> Column:
    """Whether ``left`` shared shingles reach the similarity for sets of these sizes."""
    return (100 + percent) * left >= percent * (a_n + b_n)


def need(a_n: Column, b_n: Column, percent: int) -> Column:
    """How many prefix shingles two linked sets share at least.

    They share enough() shingles, and at most those beyond the prefix of one of them lie outside both.
    """
    beyond = F.greatest(*[F.floor((percent * n + 99) / 100) - 1 for n in (a_n, b_n)])
    return F.greatest(F.ceil(percent * (a_n + b_n) / (100 + percent)) - beyond, F.lit(1))


def with_texts(rows: DataFrame, own: DataFrame, **ends: str) -> DataFrame:
    """rows with the columns of ``own`` for each end: name of the end's node, and suffix of the columns.

    rows are written numbers only, so while they are few they go to the texts of the first end. A node at which more than
    SHARE rows end, such as the hub of a large group, is dealt over salts, and its text repeated for each of them.
    """
    numbers, joins, salts = rows.columns, [], []
    for end, suffix in ends.items():
        side = own.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}{suffix}") for c in own.columns if c != "node"])
        heavy = materialize(rows.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_salts")).filter("_salts > 1"))
        if not heavy.isEmpty():
            heavy, salt, n = small(heavy, 16), f"_salt_{end}", F.coalesce("_salts", F.lit(1))
            rows = rows.join(heavy, end, "left").withColumn(salt, F.pmod(F.xxhash64(*numbers), n).cast("int")).drop("_salts")
            side = side.join(heavy, end, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
            salts.append(salt)
        joins.append((side, [c for c in (end, f"_salt_{end}") if c in side.columns]))
    rows = small(materialize(rows) if salts else rows)
    for side, on in joins:
        rows = rows.join(side, on)
    return rows.drop(*salts)


def among(texts: DataFrame, rows: DataFrame, *ends: str) -> DataFrame:
    """The texts of the nodes at these ends of rows."""
    ids = materialize(rows.select(F.explode(F.array(*ends)).alias("node")).distinct())
    return texts.join(small(ids), "node", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, known: Broadcast, percent: int) -> DataFrame:
    """The pairs (a, b) that link: they must share enough of the prefixes in every order, then the sets decide."""
    near = with_texts(pairs, materialize(heads(among(texts, pairs, "a", "b"), known, percent)), a="_a", b="_b")
    least = need(F.col("n_a"), F.col("n_b"), percent)
    for k in range(ORDERS):
        x, y = F.get("heads_a", F.lit(k)), F.get("heads_b", F.lit(k))
        equal = F.size(x) - F.size(F.array_distinct(x))  # shingles that were cut to the same bits count once below
        near = near.filter(F.size(F.array_intersect(x, y)) + equal >= least)
    near = materialize(near.select("a", "b"))
    return similar(with_texts(near, among(texts, near, "a", "b"), a="_a", b="_b"), percent)


def grouped(listed: DataFrame) -> DataFrame:
    """Postings of the shingles that more than one row has, with hub (rare, node, n, place) and size of the group.

    The postings are shuffled once: both readers take all columns, and the same filter, so that they share the shuffle. Those of hot shingles are dealt by salt, and their groups put
    together from one row for each salt.
    """
    listed = listed.filter("shingle is not null and salt is not null").repartition("shingle", "salt")
    dealt = listed.groupBy("shingle", "salt").agg(F.min(F.struct("rare", "node", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("size"))
    dealt = dealt.filter("size > 1 or salt >= 0")
    hubs = dealt.groupBy("shingle").agg(F.min("hub").alias("hub"), F.sum("size").alias("size"), F.collect_list("salt").alias("salts")).filter("size > 1")
    hubs = hubs.select("shingle", "hub", "size", F.explode("salts").alias("salt"))
    return listed.join(hubs.hint("shuffle_hash"), ["shingle", "salt"]).select("shingle", "node", "n", "place", "rare", "hub", "size")


def fits(a: str, b: str, percent: int) -> Column:
    """Whether enough is left of both prefixes' sets from a shared shingle on, which holds for the first one of linked sets."""
    n = [F.col(f"{x}n") for x in (a, b)]
    left = F.least(n[0] - F.col(f"{a}place"), n[1] - F.col(f"{b}place"))
    return enough(n[0], n[1], left, percent)


def paired(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of a group that are in different parts; groups have at most PAIRED members."""
    left, right = (placed.select("shingle", *[F.col(c).alias(f"{side}{c}") for c in ("node", "n", "place", "part")]) for side in ("a_", "b_"))
    met = left.join(right, "shingle").filter((F.col("a_node") < F.col("b_node")) & (F.col("a_part") != F.col("b_part")) & fits("a_", "b_", percent))
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def apart(told: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows of differences() to one hub that are in different parts and not both near it."""
    u, v = 100 + percent, 100 - percent
    shared = told.filter("place >= 0").withColumn("w", u * F.col("d") - v * F.col("n"))
    left, right = (df.select("base", "token", *[F.col(c).alias(f"{side}{c}") for c in ("node", "n", "d", "w", "place", "part", "near")]) for df, side in ((shared.filter("core"), "a_"), (shared.filter("not near"), "b_")))
    once = F.col("a_near") | (F.col("a_w") < F.col("b_w")) | ((F.col("a_w") == F.col("b_w")) & (F.col("a_node") < F.col("b_node")))
    sizes = enough(F.col("a_n"), F.col("b_n"), F.least("a_n", "b_n"), percent)
    rest = F.least(F.col("a_d") - F.col("a_place"), F.col("b_d") - F.col("b_place"))
    met = left.join(right, ["base", "token"]).filter(once & (F.col("a_part") != F.col("b_part")) & sizes & (2 * u * rest >= F.col("a_w") + F.col("b_w")))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


class Sets(NamedTuple):
    """What both joins start from: docs (doc_id, n, set_key), member (doc_id, node of its set), texts and firsts (node, text) of all
    documents and of one for each set, same (a, b) of nodes that are one document, and the frequent shingles."""

    docs: DataFrame
    member: DataFrame
    texts: DataFrame
    firsts: DataFrame
    same: DataFrame
    known: Broadcast


def distinct_sets(df: DataFrame, key: str, text: str, words: int = WORDS) -> Sets:
    spark = df.sparkSession
    own = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = materialize(summarize(own, words))
    docs = found.filter(F.col("set_key").isNotNull())
    known = spark.sparkContext.broadcast(frequent(found.filter(F.col("shingle").isNotNull()).select("shingle", "n")))
    some = docs.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    member = materialize(some.select("doc_id", "set_key").distinct().join(nodes, "set_key").select("doc_id", "node"))
    copies = materialize(member.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter((F.col("low") < F.col("doc_id")) & (F.col("high") < F.col("doc_id"))).select(F.col("doc_id").alias("node")))
    texts = own.filter(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node")
    # documents with one key and several sets are one node of the graph
    same = member.filter(F.col("doc_id") != F.col("node")).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return Sets(docs, member, texts, texts.join(small(copies), "node", "left_anti"), same, known)


def connected(groups: DataFrame, sets: Sets, check: Callable[[DataFrame], DataFrame], percent: int, words: int = WORDS) -> DataFrame:
    """(node, component) of nodes that links reach, for candidate groups as grouped() gives them.

    check(pairs) gives the pairs that link. Hubs come first, then members of a group that are in different components.
    """
    texts, known = sets.texts, sets.known
    stars = groups.filter((F.col("node") != F.col("hub.node")) & fits("", "hub.", percent))
    stars = materialize(stars.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
    part = components(materialize(check(stars).union(sets.same)))

    placed = groups.select("shingle", "size", "node", "n", "place", F.col("hub.node").alias("hub")).join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    open_groups = materialize(placed.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("shingle"))
    placed = materialize(placed.join(open_groups, "shingle", "left_semi"))
    few, many = placed.filter(F.col("size") <= PAIRED), placed.filter((F.col("size") > PAIRED) & (F.col("node") != F.col("hub")))
    held = materialize(many.select("node", "part", "hub").distinct())
    told = with_texts(held, among(texts, held, "node", "hub").withColumnRenamed("text", "_text"), node="", hub="_hub")
    told = materialize(differences(told.withColumnsRenamed({"_text": "text", "_text_hub": "hub_text"}), known, percent, words))
    pairs = paired(few, percent).union(apart(told, percent)).distinct()
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"))
    dropped(stars, placed, held)
    to_hub = told.filter("near and place < 0").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    second = materialize(check(pairs).union(to_hub.distinct()))
    whole = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").union(second))
    dropped(part, second, told, pairs)
    return whole


def labelled(sets: Sets, whole: DataFrame, key: str) -> DataFrame:
    """One row for each document: key, n_shingles, component_id."""
    ends = sets.member.groupBy("doc_id").agg(F.min("node").alias("node"))
    ends = ends.join(whole, "node", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "node").alias("component_id"))
    ends = materialize(ends)
    dropped(whole, sets.member)
    result = sets.docs.select("doc_id", "n").join(ends, F.col("doc_id") == F.col("id"), "left")
    return result.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def link(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id.

    component_id is the smallest key that links reach, equal sets being linked. Null texts and texts
    without words have no shingles and link to nothing; very long texts are compared whole. Rows without
    a key have no component and take no part; rows that share a key are one document, whose texts are all
    compared, and repeated rows give a row each. Keys are whole numbers. An empty table gives no rows. Other columns are not
    read. A result depends neither on partitions nor on the counts, which only steer the order.
    """
    sets = distinct_sets(df, key, text)
    groups = materialize(grouped(postings(sets.firsts, sets.known, percent)))
    whole = connected(groups, sets, lambda pairs: verify(pairs, sets.texts, sets.known, percent), percent)
    dropped(groups)
    return labelled(sets, whole, key)
