"""Exact top-k inner-product search by MaxScore over shards of an inverted index.

A vector's positive and negative components are postings of two terms, (dimension, +) and (dimension, -). A query's component q
weighs the term of its own sign: what that term adds to a score is at most |q| times the greatest size of its postings in the
shard, its bound; postings of the other sign only take away.

In each shard a query sorts its terms by bound. The last ones, whose bounds together don't reach the k-th best score so far, are
not essential: a vector in no other posting can't enter. The essential postings are traversed, which gives the
candidates and their sums; the other terms are probed for these from the greatest bound down, and a candidate leaves as soon as
its sum and the bounds not yet probed can't reach the k-th best. What stays has its exact score. Postings are bitmaps beside a matrix
of components, as nearly every vector has nearly every dimension: traversal is an OR of bitmaps and a product with the essential terms.

Vectors are dealt by hash to shards of about `SHARD_ROWS` rows, queries to blocks of `BLOCK_ROWS`; a task holds one of each.
A block meets one shard first, which gives each of its queries a threshold, and then the others. The lists of shards are merged by
a ranked window, whose limit Spark also applies before the shuffle. Work is that of all queries against all shards, and the query
set is the caller's; a shuffle moves each vector once a block, each query once a shard. Copies of a vector are spread like others.

A vector that is null or has a null or not finite component is neither query nor candidate. Missing components of a shorter vector
count as 0. A row isn't its own candidate, but others of its id or vector are. Ties go to the smaller id, null last. Repeated ids
that are queries give a list each. Sums that doubles can't hold exactly are made of unlimited integers, and cut to 64 bits before they are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplate.llm.common import dropped, written

SHARD_ROWS = 4096
BLOCK_ROWS = 1024


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, short ones filled up with 0."""
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices as they are if every sum of products is exact in doubles, else as Python integers."""
    bound = max((parts[0].shape[1], 1))
    for x in parts:
        bound *= float(np.abs(x).max(initial=1))
    return list(parts) if bound < 2**53 else [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in parts]


#: Terms that are probed between two looks at who stays.
PROBES = 8


class Shard:
    """The postings of a shard: for each dimension the rows with a positive and those with a negative component as bitmaps, and the components by dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.by_dimension = x, np.ascontiguousarray(x.T)
        self.up, self.down = (np.packbits((sign * self.by_dimension > 0).astype(bool), axis=1) for sign in (1, -1))
        self.most = np.maximum(self.by_dimension.max(axis=1, initial=0), 0)
        self.least = np.minimum(self.by_dimension.min(axis=1, initial=0), 0)

    def search(self, q: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all vectors that score `floor` or more (None: of all vectors)."""
        if floor is None or floor <= 0:  # vectors in no posting of the query count too
            return np.arange(len(self.x)), q @ self.by_dimension
        bounds = np.maximum(q * self.most, q * self.least)
        order = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from each on can add together
        essential = int(np.count_nonzero(rest[:-1] >= floor))
        first = np.zeros(len(q), bool)
        first[order[:essential]] = True
        lists = np.concatenate([self.up[first & (q > 0)], self.down[first & (q < 0)]])
        rows = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(lists, axis=0), count=len(self.x))) if len(lists) else np.arange(0)
        sums = (np.where(first, q, 0 * q) @ self.by_dimension)[rows]
        for j in range(essential, len(q), PROBES):
            stay = sums + rest[j] >= floor
            rows, sums = rows[stay], sums[stay]
            if not len(rows):
                break
            terms = order[j : j + PROBES]
            sums = sums + self.x[np.ix_(rows, terms)] @ q[terms]
        stay = sums >= floor
        return rows[stay], sums[stay]


def searched(queries: pa.Table, vectors: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best vectors of a shard for each query of a block, as far as they reach the query's floor."""
    if not queries.num_rows or not vectors.num_rows:
        return schema.empty_table()
    width = max(pc.max(pc.list_value_length(t["v"])).as_py() or 0 for t in (queries, vectors))
    q, x = exact(matrix(queries["v"], width), matrix(vectors["v"], width))
    shard = Shard(x)
    ids = vectors["id"].combine_chunks()
    by_id = np.empty(len(x), np.int64)
    by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(x))
    rows_of = vectors["row"].to_numpy()
    own, floors = queries["row"].to_numpy(), queries["floor"].to_pylist()
    which, found, scores = [], [], []
    for i in range(len(q)):
        rows, sums = shard.search(q[i], floors[i])
        other = rows_of[rows] != own[i]
        rows, sums = rows[other], sums[other]
        if sums.dtype == object:
            sums = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], dtype=object)
        if len(rows) > k:  # what ties with the k-th is looked at by id
            least = np.sort(sums)[-k]
            rows, sums = rows[sums >= least], sums[sums >= least]
        best = np.lexsort((by_id[rows], -sums))[:k]
        which += [i] * len(best)
        found += rows[best].tolist()
        scores += map(int, sums[best])
    which, found = pa.array(which, pa.int64()), pa.array(found, pa.int64())
    return pa.table([queries["row"].take(which), queries["id"].take(which), ids.take(found), pa.array(scores, pa.int64())], schema=schema)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`query_id`, `rank` int from 1, `key` and `score` bigint: the k other rows of greatest inner product for each row where `is_query` holds.

    The vector column holds arrays of whole numbers (any numeric type)."""
    values = F.col("v")
    usable = values.isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(chosen.filter(usable), "vectors")
    n_all, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = -(-max(n_all, 1) // shard_rows), -(-max(n_queries, 1) // block_rows)
    held = rows.select(*(F.col(c).alias(c) for c in ("row", "id", "v")), F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int").alias("shard"))
    asked = rows.filter("asks").select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"))
    id_type = vectors.schema[key].dataType.simpleString()
    result = f"query_row bigint, query_id {id_type}, id {id_type}, score bigint"

    def pairs(queries: DataFrame, of_shards: Column, to_blocks: Column) -> DataFrame:
        """The best of each shard and block that meet; the columns are arrays of the shards of a block, and of the blocks of a shard."""
        left = queries.withColumn("shard", F.explode(of_shards))
        right = held.withColumn("block", F.explode(to_blocks))

        def work(a: pa.Table, b: pa.Table) -> pa.Table:
            kind = a.schema.field("id").type
            schema = pa.schema([("query_row", pa.int64()), ("query_id", kind), ("id", kind), ("score", pa.int64())])
            return searched(a, b, k, schema)

        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(work, result)

    home = F.col("block") % n_shards
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    at_home = F.when(F.col("shard") < n_blocks, F.sequence("shard", F.lit(n_blocks - 1), F.lit(n_shards))).otherwise(F.array().cast("array<int>"))
    first = written(pairs(asked.withColumn("floor", F.lit(None).cast("bigint")), F.array(home), at_home), "first")
    kth = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    away = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != home)
    others = written(pairs(asked.join(kth, "row", "left"), away, F.filter(blocks, lambda b: b % n_shards != F.col("shard"))), "others")
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    merged = first.unionByName(others).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    dropped(rows)
    return merged.select("query_id", "rank", F.col("id").alias(key), "score")
