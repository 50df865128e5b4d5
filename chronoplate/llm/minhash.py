"""Near-duplicates by a signature-coordinate inverted join.

A text becomes the set of its distinct word shingles (64-bit hashes), the set a signature of `K` minima. Texts with the
same set form one class; one row a class goes on. A class is posted under each of its (coordinate, value) pairs. Two sets
of the wanted similarity agree in at least `T` of the `K` coordinates but for a chance of about 2e-8, so the rarest
K - T + 1 posts of a class are enough to meet every such partner (prefix), the common ones are skipped, and a class with
fewer than T posts that others share too has no partner. Pairs that meet keep on if their whole signatures agree
in `T` places, and are confirmed on the full sets.

Merging with skips. Posting lists up to `SMALL` are merged: their pairs come out with the number of lists they met in. The lists
that the prefix leaves out are skipped, and looked up for pairs that met: collisions there are added to the count. Only components are
asked for, so a longer list isn't expanded to pairs: every member is paired with the list's pivot, the member that stands in most long lists
(copies of one text gather around it). Confirmed links are contracted to components. In lists that still
hold more than one, members that can't reach the wanted similarity with shingles that other components have are done with; all
others are compared in blocks, by matrix products that emit links only. There is no cap: any two that share a listed post are
in one component or were compared.

Nulls: null texts and texts without words have an empty set, link with nothing and are their own component. Rows with a null
key link with nothing and have a null component. Rows that repeat a key count as one vertex: what any of their texts links with is
linked with all of them, and each is kept if the key is its component's smallest. Extra columns don't pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.llm.common import arrow_map, few, words_lower, written
from chronoplate.llm.graph import components

K, T = 32, 12
SMALL = 12
#: Vertices of a crowd that are compared with as many others in one task.
BLOCK = 400
#: Ids of compared documents that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _multipliers(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


class WordHashes(dict):
    """Hashes of words already met; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; a shorter sequence is one shingle, none gives none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mixed(h * _BASE + w[i : i + n])
    return np.unique(h)


def signatures(docs: DataFrame, key: str, text: str, width: int, k: int = K) -> DataFrame:
    """`key`, set size `n`, two sums `s1`, `s2` that stand for the set, and the signature `sig` (empty for an empty set)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, mul = WordHashes(), _multipliers(k)
        sets = [shingle_set(words_lower(t), known, width) for t in batch.column(1).to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        s1, s2 = np.zeros((2, len(sets)), np.uint64)
        sig = np.zeros((len(sets), k), np.uint32)
        if n.sum():
            flat, full = np.concatenate(sets), n > 0
            starts = (np.cumsum(n) - n)[full]
            s1[full] = np.add.reduceat(flat, starts)
            s2[full] = np.add.reduceat(mixed(flat + _BASE), starts)
            for i, m in enumerate(mul):
                sig[full, i] = np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), starts)
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, k, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig[n > 0].ravel().view(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], names=["key", "n", "s1", "s2", "sig"])

    return arrow_map(_two(docs, key, text), "text", f"key {_kind(docs, key)}, n bigint, s1 bigint, s2 bigint, sig array<int>", work)


def shingle_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """`key` and the whole set `shingles` array<bigint>."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = WordHashes()
        sets = [shingle_set(words_lower(t), known, width) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "shingles"])

    return arrow_map(_two(docs, key, text), "text", f"key {_kind(docs, key)}, shingles array<bigint>", work)


def _two(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("key"), docs[text].alias("text"))


def _kind(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def prefix_posts(classes: DataFrame, k: int = K, t: int = T) -> DataFrame:
    """(post, v): the k - t + 1 rarest posts of every class, as far as another class shares them. `classes` has (v, sig)."""
    posts = classes.select("v", F.posexplode("sig")).select("v", (F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("col").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("post"))
    shared = posts.groupBy("post").agg(F.count("*").alias("df")).filter("df > 1")
    # Posts that no one shares are the rarest: they take places of the prefix without being posted.
    own = posts.join(shared, "post").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("df", "post"))).alias("by"))
    return own.filter(F.size("by") >= t).select("v", F.explode(F.slice("by", F.lit(1), F.size("by") - (t - 1))).alias("x")).select("v", F.col("x.post").alias("post"))


def _agreeing(met: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) that collide in t coordinates. `met` has the coordinates (bits of `at`) in which a pair's lists were merged; the skipped ones are looked up."""
    sig = classes.select("v", "sig")
    both = met.join(sig.select(F.col("v").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("v").alias("b"), F.col("sig").alias("sb")), "b")
    found = F.zip_with("sa", "sb", lambda x, y: x == y)
    skipped = F.size(F.filter(F.transform(found, lambda x, i: x & (F.getbit("at", i) == 0)), lambda x: x))
    return both.filter(F.bit_count("at") + skipped >= t).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "compared")
    sets = shingle_sets(docs.join(few(ids, BROADCAST_IDS), docs[key] == ids["v"], "left_semi"), key, text, width)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    met = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y")
    return both.filter(100 * met >= percent * (total - met)).select("a", "b").distinct()


def _between(at: DataFrame) -> DataFrame:
    """(post, v, root) of posts that more than one component shares."""
    shared = at.groupBy("post").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("post")
    return at.join(shared, "post")


def _linkable(at: DataFrame, sizes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(v, root, n, gs) of vertices that may still link with another component, and their shingles gs that stand in sets of other components.

    A link of sets of n and m shingles takes percent * (n + m) / (100 + percent) common ones, m being `percent` of n at least, and not
    below the least set among those that v shares a list with. Most members of a crowd of near copies that no pivot is linked
    with have too many edits of their own for that, and need no comparison after this."""
    at = at.join(sizes.select("v", "n"), "v")
    least = at.groupBy("post").agg(F.min("n").alias("m"))
    who = written(at.join(least, "post").groupBy("v", "root").agg(F.min("m").alias("m")), "who")
    sets = shingle_sets(docs.join(few(who.select("v"), BROADCAST_IDS), docs[key] == F.col("v"), "left_semi"), key, text, width)
    each = sets.join(few(who, BROADCAST_IDS), sets["key"] == who["v"]).select("v", "root", "m", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("of"), F.explode("shingles").alias("g"))
    shared = each.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("g")
    met = each.join(shared, "g").groupBy("v", "root", "n", "m", "of").agg(F.collect_set("g").alias("gs"))
    partner = F.greatest(F.col("m"), F.ceil(percent * F.col("n") / 100))
    return met.filter((100 + percent) * F.size("gs") >= percent * (F.col("n") + partner)).drop("m", "of")


def _block_links(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the vertices of `sets` (v, root, n, gs), at least one for each two components that have any.

    Vertices that posts connect form a crowd. A crowd is dealt into blocks of about BLOCK vertices, and each two blocks
    meet in a task that counts all intersections by a matrix product: pairs are neither joined nor emitted."""
    first = at.groupBy("post").agg(F.min("v").alias("b"))
    crowds = components(at.join(first, "post").select(F.col("v").alias("a"), "b")).withColumnRenamed("root", "crowd")
    sizes = crowds.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = sets.join(crowds, "v").join(sizes, "crowd").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = spread.select("v", "root", "n", "gs", "own", "crowd", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
    kind = at.schema["v"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        v, root = rows.column("v").combine_chunks(), rows.column("root").to_pylist()
        n = rows.column("n").to_numpy().astype(np.int64)
        own = rows.column("own").to_numpy()
        lists = rows.column("gs").combine_chunks()
        owner = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        values, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        _, group = np.unique(np.array(root, dtype=object).astype(str), return_inverse=True)
        met = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, len(values), 4096):  # so many columns of the incidence matrix at a time
            some = (column >= at) & (column < at + 4096)
            part = np.zeros((len(n), min(4096, len(values) - at)), np.float32)
            part[owner[some], column[some] - at] = 1
            met += part @ part.T
        met = np.rint(met).astype(np.int64)
        linked = (100 * met >= percent * (n[:, None] + n[None, :] - met)) & (group[:, None] < group[None, :])
        if own.min() < own.max():
            linked &= own[:, None] != own[None, :]
        a, b = np.nonzero(linked)
        if len(a):
            _, one = np.unique(group[a] * len(n) + group[b], return_index=True)
            a, b = a[one], b[one]
        return pa.table({"a": v.take(pa.array(a)), "b": v.take(pa.array(b))})

    return meeting.groupBy("crowd", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}")


def links(docs: DataFrame, classes: DataFrame, key: str, text: str, width: int, percent: int, k: int = K, t: int = T) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to connect every component."""
    posts = written(prefix_posts(classes, k, t), "posts")
    sizes = posts.groupBy("post").agg(F.count("*").alias("size"))
    small = posts.join(sizes.filter(F.col("size").between(2, SMALL)), "post")
    large = written(posts.join(sizes.filter(F.col("size") > SMALL), "post").select("post", "v"), "large")
    hub = large.groupBy("v").agg(F.count("*").alias("lists"))
    pivot = large.join(hub, "v").groupBy("post").agg(F.min_by("v", F.struct(-F.col("lists"), "v")).alias("pivot"))
    star = large.join(pivot, "post").filter("v <> pivot").select("post", F.least("pivot", "v").alias("a"), F.greatest("pivot", "v").alias("b"))
    pairs = small.select("post", F.col("v").alias("a")).join(small.select("post", F.col("v").alias("b")), "post").filter("a < b").union(star)
    # A post's high half is its coordinate.
    merged = pairs.groupBy("a", "b").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright("post", 32).cast("int"))).alias("at"))
    agreeing = written(_agreeing(merged, classes, t), "agreeing")
    found = written(_confirmed(agreeing, docs, key, text, width, percent), "links")
    labels = components(found)
    at = written(_between(large.join(labels, "v", "left").select("post", "v", F.coalesce("root", "v").alias("root"))), "open")
    if at.isEmpty():
        return found
    sets = written(_linkable(at, classes, docs, key, text, width, percent), "linkable")
    at = written(_between(at.join(sets.select("v"), "v", "left_semi")), "meeting")
    return found.union(_block_links(at, sets, percent)) if not at.isEmpty() else found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = K, t: int = T) -> DataFrame:
    """`key`, `n_shingles`, `component_id` (smallest key reachable by links, itself included) and `kept` (key = component_id).

    `width` words a shingle, `percent` the least Jaccard similarity of linked sets. For another similarity choose `k` (63 at most) and
    `t` so that a binomial of k trials falls short of t with a small enough chance."""
    signed = written(signatures(docs, key, text, width, k), "signatures")
    named = signed.filter("key is not null")
    classes = written(named.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("v"), F.first("sig").alias("sig")), "classes")
    found = links(docs, classes, key, text, width, percent, k, t)
    # A key with several sets joins their classes.
    sets = F.struct("n", "s1", "s2")
    several = written(named.groupBy("key").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).filter("lo <> hi").select(F.col("key").alias("several")), "several")
    rows = signed.select("key", "n", "s1", "s2")
    mine = rows.join(few(several, BROADCAST_IDS), rows["key"] == F.col("several"), "left_semi").join(classes.drop("sig"), ["n", "s1", "s2"])
    labels = components(found.union(mine.select(F.col("key").alias("a"), F.col("v").alias("b"))))
    by = classes.join(labels, "v", "left").select(F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("root", "v").alias("root"))
    joined = rows.join(by, (F.col("n") == F.col("cn")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left").select("key", "n", "root")
    # An empty text of such a key goes with the key's others.
    theirs = labels.join(few(several, BROADCAST_IDS), labels["v"] == F.col("several"), "left_semi").select(F.col("v").alias("several"), F.col("root").alias("their"))
    joined = joined.join(few(written(theirs, "theirs"), BROADCAST_IDS), joined["key"] == F.col("several"), "left").select("key", "n", F.coalesce("their", "root").alias("root"))
    root = F.when(F.col("key").isNotNull(), F.coalesce("root", "key"))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("key") == root, F.lit(True)).alias("kept"))
