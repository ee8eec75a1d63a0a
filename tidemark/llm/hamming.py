"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; every segment has a table from its value to the codes that have it.  If two codes
differ in at most s * m + a bits, then of m segments one of the first a + 1 differs in at most s bits, or
another in fewer.  So the search grows the radius of one segment after the other, verifies the full distance
of what it meets, and stops once the k-th best verified distance is no more than the radius that is covered:
nothing nearer can be left.  When the probes of the next radius would outnumber the codes, the rest of a shard
is scanned instead, which is as exact.

Equal codes are one entry with its least ids, so a vector that holds a third of the rows costs no more than
any other.  Codes are dealt by hash into shards of bounded size; every shard gets all different queries, builds
its index once, and streams the queries past it in batches.  The best of all shards are merged by rank.  So a
large table of codes is moved once, and the queries once a shard.  Where there are fewer shards than cores, a
shard is copied for several blocks of its queries, at most until all cores have one.

Results are ordered by distance, then id; a row is not its own neighbour.  Null and empty vectors, and those
with null elements, are neither found nor searched for.  Vectors of different lengths are compared as if
filled up with zeros.  Rows with a null id are left out; repeated rows are neighbours like others, but all
rows with the query's own id are left out, and an id with several codes is a query for each of them.  An empty
table gives an empty result.  Extra columns, also those whose names differ by case only, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, pick, written

K = 10
#: Distinct codes in a shard and queries in a block, about: shards hold no more, blocks no less.
SHARD_CODES, BLOCK_QUERIES = 1 << 19, 256


def sign_codes(vector: Column, dims: int) -> Column:
    """One bit for each element, set where it is positive, as an array of longs."""

    def word(w: int) -> Column:
        bits = F.transform(F.slice(vector, 64 * w + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.array(*(word(w) for w in range(max(1, math.ceil(dims / 64)))))


class Index:
    """Multi-index hashing over the distinct codes of one shard; ``least`` breaks ties."""

    def __init__(self, codes: np.ndarray, least: np.ndarray, bits: int):
        self.codes, self.least, self.bits = codes, least, bits
        n = len(codes)
        self.m = max(1, min(bits, round(bits / max(4.0, min(16.0, math.log2(max(n, 2)))))))
        edges = [bits * j // self.m for j in range(self.m + 1)]
        self.spans = list(zip(edges[:-1], edges[1:], strict=True))
        self.tables = []
        for lo, hi in self.spans:
            value = self.segment(codes, lo, hi)
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << (hi - lo)) + 1)), order))
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def segment(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Bits lo to hi of each code, as numbers."""
        out = np.zeros(len(codes), np.int64)
        for b in range(lo, hi):
            out |= ((codes[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << (b - lo)
        return out

    def masks(self, width: int, s: int) -> np.ndarray:
        if (width, s) not in self._masks:
            self._masks[width, s] = np.array([sum(1 << i for i in c) for c in combinations(range(width), s)], np.int64)
        return self._masks[width, s]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the k nearest codes, by distance, then least id."""
        n = len(self.codes)
        k = min(k, n)
        places = np.empty(0, np.int64)
        far = np.empty(0, np.int64)
        values = [int(self.segment(query[None, :], lo, hi)[0]) for lo, hi in self.spans]
        for s in range(max(hi - lo for lo, hi in self.spans) + 1):
            if sum(math.comb(hi - lo, s) for lo, hi in self.spans) > n:
                places = np.arange(n)
                far = np.bitwise_count(self.codes ^ query).sum(axis=1).astype(np.int64)
                break
            done = False
            for a, (lo, hi) in enumerate(self.spans):
                if s <= hi - lo:
                    start, order = self.tables[a]
                    probe = self.masks(hi - lo, s) ^ values[a]
                    first, size = start[probe], start[probe + 1] - start[probe]
                    hit = size > 0
                    first, size = first[hit], size[hit]
                    if len(first):
                        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        met = order[np.repeat(first, size) + step]
                        d = np.bitwise_count(self.codes[met] ^ query).sum(axis=1).astype(np.int64)
                        places, at = np.unique(np.concatenate([places, met]), return_index=True)
                        far = np.concatenate([far, d])[at]
                        if len(places) > 4 * k + 64:  # only the best can matter
                            keep = far <= np.partition(far, k - 1)[k - 1]
                            places, far = places[keep], far[keep]
                if len(far) >= k and np.partition(far, k - 1)[k - 1] <= s * self.m + a:
                    done = True
                    break
            if done:
                break
        best = np.lexsort((self.least[places], far))[:k]
        return places[best], far[best]


def _search(k: int, bits: int):
    """Over rows sorted by (shard and block, is_query): hold a shard's codes, then answer its queries batch by batch."""
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes, least, index = None, [], [], None
        for batch in batches:
            numbers, asking = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            words = batch.column(2).flatten().to_numpy().reshape(len(batch), -1).view(np.uint64)
            ids = batch.column(3).to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asking.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if lo == hi:
                    continue
                if numbers[lo] != shard:
                    shard, codes, least, index = numbers[lo], [], [], None
                if not asking[lo]:
                    codes.append(words[lo:hi].copy())
                    least.append(ids[lo:hi].copy())
                    continue
                if not codes:
                    continue
                if index is None:
                    index = Index(np.concatenate(codes), np.concatenate(least), bits)
                found = [index.search(q, k) for q in words[lo:hi]]
                near = index.codes[np.concatenate([p for p, _ in found])].view(np.int64)
                whom = np.repeat(words[lo:hi].view(np.int64), [len(p) for p, _ in found], axis=0)
                offsets = pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(offsets, pa.array(x.ravel()), type=lists) for x in (whom, near)] + [pa.array(np.concatenate([d for _, d in found]))],
                    ["query", "near", "distance"],
                )

    return run


def nearest(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = 64, *, shard_codes: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) from (id, code) of all rows and of the queries; codes are arrays of longs."""
    codes = codes.where("id is not null and code is not null")
    queries = queries.where("id is not null and code is not null")
    # The k + 1 least ids of a code are enough, as one of them may be the query's own.
    ranked = codes.select("id", "code").distinct().withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    held = written(ranked, "codes")
    heads = held.where("r = 1").select("code", F.col("id").alias("least"))
    asked = written(queries.select("code").distinct(), "queries")
    shards = max(1, math.ceil(heads.count() / (shard_codes or SHARD_CODES)))
    cores = codes.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(cores // shards, math.ceil(asked.count() / BLOCK_QUERIES)))
    deal = lambda n, salt: F.pmod(F.xxhash64("code", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = (F.col("shard") * blocks + F.col("block")).alias("group")
    rows = heads.withColumn("shard", deal(shards, 1)).withColumn("block", every(blocks)).select(group, F.lit(False).alias("is_query"), "code", "least")
    asks = asked.withColumn("block", deal(blocks, 2)).withColumn("shard", every(shards)).select(group, F.lit(True).alias("is_query"), "code", F.lit(0).cast("long").alias("least"))
    both = rows.unionByName(asks).repartition(shards * blocks, "group").sortWithinPartitions("group", "is_query")
    found = both.mapInArrow(_search(k + 1, bits), "query array<bigint>, near array<bigint>, distance bigint")
    near = found.join(held.select(F.col("code").alias("near"), F.col("id").alias("neighbor_id")), "near")
    # A query needs the best k + 1 ids of its code, whichever rows ask.
    best = near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbor_id"))).where(F.col("r") <= k + 1)
    best = written(best.select("query", "neighbor_id", "distance"), "found")
    discard(held, asked)
    asking = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    out = asking.join(best, "query").where("query_id <> neighbor_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query").orderBy("distance", "neighbor_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def search_vectors(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """Nearest rows by the signs of their vectors, for the rows where ``is_query(id column)`` holds."""
    rows = pick(df, id_col, vector_col).toDF("id", "vector")
    rows = rows.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    codes = written(rows.select(F.col("id").cast("long").alias("id"), sign_codes(F.col("vector"), dims).alias("code")), "signs")
    return nearest(codes, codes.where(is_query(F.col("id"))), k, 64 * math.ceil(dims / 64))
