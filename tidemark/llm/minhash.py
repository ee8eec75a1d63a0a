"""Near-duplicate groups by b-bit MinHash.

A document is the set of its distinct shingles of ``SHINGLE`` words (all its words as one shingle when it
has fewer).  Documents with equal sets form a class.  Each class keeps 128 minima: bands of full minima
generate candidates, and the low four bits of every minimum are packed into eight longs, from which bit
counts give a collision-corrected similarity that discards hopeless candidates.  What is left is confirmed
on the full sets: 100 * |A n B| >= 75 * |A u B|.

A bucket never compares all its pairs.  First each member is held against one pivot of its bucket, which
differs from band to band, in every second band: of all its pivots against the likeliest, and once the classes so connected are
contracted, against those that are still in other components.  In a bucket that still holds several components,
only members outside its largest one are held against the others: a bucket of N members of which r lie outside
costs r * N comparisons, dealt in blocks of at most ``BLOCK`` by ``BLOCK`` members.  Pairs whose bit counts and
sizes allow a link are confirmed.  Every link between candidates is thus found or already implied.  Where one
class meets many others, its set is sent once for every ``BLOCK`` of them, so no key gathers a whole group.

Nulls, empty texts and texts of white space only: empty set, own component.  A null id forms a component
with its class like any other, but is never the smallest id unless its component has no other.  Repeated
rows come back as often as they came.  Texts of any length are taken whole, in blocks.  An empty table gives an
empty result.  Extra columns, also those whose names differ by case only, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import BROADCAST_ROWS, discard, pick, settle, written

SHINGLE, PERCENT = 5, 75
#: Members of a bucket, or partners of a class, that one task handles together.
BLOCK = 1024
#: Every so manieth band lends its buckets' pivots to the first contraction; all bands are compared after it.
PIVOT_BANDS = 2
BANDS, ROWS, BITS = 32, 4, 4
#: A candidate whose estimate is below this, five standard deviations under the threshold, is discarded.
LEAST_ESTIMATE = 0.55
#: Where many candidates of one bucket are left, a longer signature is held against them, with the same five deviations.
LONG_MINIMA, LONG_BITS, LONG_LEAST = 2048, 2, 0.69
_RANDOM = np.random.default_rng(20240229)
_COEFFICIENTS = _RANDOM.integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_COEFFICIENTS = _RANDOM.integers(0, 2**63, (2, LONG_MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a string column."""
    buf, at = B.texts(column)
    if len(buf):
        buf = np.frombuffer(buf.tobytes().translate(B.LOWER), np.uint8)
    words, offsets = B.word_hashes(buf, at, B.WHITE)
    weights = B.powers(max(shingle, 1) + 1)
    for i in range(len(at) - 1):
        w = words[offsets[i] : offsets[i + 1]]
        if len(w) >= shingle:
            n = len(w) - shingle + 1
            h = np.zeros(n, np.uint64)
            for j in range(shingle):
                h += w[j : j + n] * weights[j + 1]
            yield np.unique(B.mix(h))
        elif len(w):
            yield B.mix(np.array([np.sum(w * weights[1 : len(w) + 1]) + np.uint64(len(w))], np.uint64))
        else:
            yield w


def minima(hashes: np.ndarray, coefficients: np.ndarray = _COEFFICIENTS) -> np.ndarray:
    """The least value of each hash function over a set."""
    a, x = coefficients
    out = np.full(len(a), np.iinfo(np.uint64).max)
    step = (1 << 18) // len(a)
    for k in range(0, len(hashes), step):
        block = hashes[None, k : k + step] ^ x[:, None]
        block *= a[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        key = B.mix(key ^ rows[:, j]) + np.uint64(j)
    return key.view(np.int64)


def packed(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, side by side in longs."""
    low = ((m >> np.uint64(5)) & np.uint64((1 << bits) - 1)).reshape(-1, 64 // bits)
    return np.bitwise_or.reduce(low << np.arange(0, 64, bits, dtype=np.uint64), axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.portions(batches, 1):
        n, h1, h2, bands, signs = [], [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            h1.append(int(np.sum(s).view(np.int64)) if len(s) else 0)
            h2.append(int(np.sum(B.mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
            m = minima(s) if len(s) else None
            bands.append(band_keys(m) if len(s) else None)
            signs.append(packed(m) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "node", "check", "bands", "sign"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.portions(batches, 0):
        nodes, sets = [], []
        for s in shingle_sets(batch.column(0)):
            nodes.append(int(np.sum(s).view(np.int64)))
            sets.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])


def _long_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = [packed(minima(s.values.to_numpy().view(np.uint64), _LONG_COEFFICIENTS), LONG_BITS) for s in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.list_(pa.int64()))], ["node", "long_sign"])


def estimate(a: Column, b: Column, minima: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity of two packed signatures: the share of equal low bits, corrected for chance collisions."""
    lowest = F.lit(sum(1 << i for i in range(0, 63, bits)))
    odd = []
    for i in range(minima * bits // 64):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        for shift in (1, 2)[: bits // 2]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        odd.append(F.bit_count(x.bitwiseAND(lowest)))
    equal = 1 - reduce(lambda p, q: p + q, odd) / float(minima)
    return (equal - 1 / 2**bits) / (1 - 1 / 2**bits)


def _possible(a: str, b: str) -> Column:
    """What sizes and bit counts leave open."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (estimate(F.col(f"{a}.sign"), F.col(f"{b}.sign")) >= LEAST_ESTIMATE)


def _beside(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b, salt, ..) with columns a_.. and b_.. of the facts of a and b; b's go once to each of its salts."""
    heads = pairs.select("b", "salt").distinct().join(facts, F.col("b") == F.col("node")).select("b", "salt", *(F.col(c).alias(f"b_{c}") for c in columns))
    one = pairs.join(facts, F.col("a") == F.col("node")).select(*pairs.columns, *(F.col(c).alias(f"a_{c}") for c in columns))
    return one.join(heads, ["b", "salt"])


def _open(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b, salt) that sizes and bit counts leave open, with their estimate."""
    facts = signs.select("node", "n", "sign")
    heads = pairs.select("b", "salt").distinct().join(facts, F.col("b") == F.col("node")).select("b", "salt", "n", "sign").alias("q")
    one = pairs.join(facts, F.col("a") == F.col("node")).select("a", "b", "salt", "n", "sign").alias("p")
    same = (F.col("p.b") == F.col("q.b")) & (F.col("p.salt") == F.col("q.salt"))
    return one.join(heads, same & _possible("p", "q")).select("a", "p.b", "p.salt", estimate(F.col("p.sign"), F.col("q.sign")).alias("est"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, salt), a written table, whose full sets are similar enough."""
    both = F.size(F.array_intersect("a_set", "b_set"))
    whole = F.size("a_set") + F.size("b_set")
    return _beside(pairs.select("a", "b", "salt"), sets, "set").where(100 * both >= PERCENT * (whole - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the least node that can be reached.

    Large-star and small-star steps alternate until the edges no longer change; each step is written to
    the shared folder, and no links come to the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")
        before, now = now, written(small.unionByName(down.select("a", F.col("root").alias("b"))).distinct(), "small")
        discard(before, large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 2**40)).first()
        if seen == mark:
            break
        mark = seen
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = written(pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct()), "components")
    discard(now)
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``df``."""
    docs = pick(df, id_col, text_col).toDF("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    kind = id_type.simpleString()
    signed = written(docs.mapInArrow(_sign, f"doc_id {kind}, n_shingles bigint, node bigint, check bigint, bands array<bigint>, sign array<bigint>"), "signed")
    some = signed.where("n_shingles > 0")
    # One row for each distinct set; equal sets are combined before they are shuffled.
    classes = written(
        some.groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sign").alias("sign")),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("place", "band"))
    # Each band orders the nodes in its own way, so a group that fills many buckets gets many different pivots.
    turned = F.col("node").bitwiseXOR(F.xxhash64("band"))
    buckets = banded.groupBy("band").agg(F.min(turned).alias("pivot"), F.count("*").alias("crowd")).where("crowd > 1")
    buckets = written(buckets.select("band", F.col("pivot").bitwiseXOR(F.xxhash64("band")).alias("pivot"), "crowd"), "buckets")
    members = written(banded.join(buckets, "band"), "members")

    signs = written(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "least", "n", "sign"), "candidates")
    sets = _candidate_sets(docs, signs)
    settle(docs.sparkSession)

    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    spokes = members.where(F.col("place") % PIVOT_BANDS == 0).select(F.col("node").alias("a"), F.col("pivot").alias("b"), "crowd").where("a <> b").groupBy("a", "b").agg(F.max("crowd").alias("crowd"))
    spokes = written(spokes.select("a", "b", deal("a", blocks("crowd")).alias("salt")), "pairs")
    opened = written(_open(spokes, signs), "open")
    best = written(opened.groupBy("a").agg(F.max(F.struct("est", "b", "salt")).alias("m")).select("a", "m.b", "m.salt"), "best")
    edges = written(_confirmed(best, sets), "spokes")
    roots = components(edges)
    discard(spokes)
    settle(docs.sparkSession)
    rooted = signs.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    second = _beside(opened.join(best, ["a", "b"], "left_anti"), rooted, "root").where("a_root <> b_root")
    second = written(second.select("a", "b", "salt"), "second")
    further = written(_confirmed(second, sets), "further")
    edges = edges.unionByName(further)
    if not further.isEmpty():
        discard(roots)
        roots = components(edges)
    discard(opened, best, rooted, second)
    settle(docs.sparkSession)

    # What a bucket still holds apart: members outside its largest component, against members of other components.
    placed = members.select("band", "place", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    discard(members, buckets)
    apart = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("crowd"), F.count("*").alias("kinds"))
    apart = apart.where("kinds > 1").select("band", F.col("major.root").alias("major"), "crowd", (F.col("crowd") - F.col("major.n")).alias("minors"))
    apart = written(apart, "apart")
    held = placed.join(apart, "band")
    longer = sets.join(held.select("node").distinct(), "node", "left_semi").select("node", "set").mapInArrow(_long_signs, "node bigint, long_sign array<bigint>")
    longer = written(longer, "longer")
    held = written(held.join(classes.select("node", "n", "sign", "bands").join(longer, "node"), "node"), "held")
    discard(placed, apart, longer)
    settle(docs.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    p = held.withColumn("own", deal("node", blocks("crowd"))).withColumn("other", every(blocks("minors"))).alias("p")
    q = held.where("root <> major").withColumn("other", deal("node", blocks("minors"))).withColumn("own", every(blocks("crowd"))).alias("q")
    # A pair comes out of the first band that it shares, not of every one.
    same = [F.element_at("p.bands", i + 1) == F.element_at("q.bands", i + 1) for i in range(BANDS)]
    first = reduce(lambda c, i: c.when(same[i], F.lit(i)), range(1, BANDS), F.when(same[0], F.lit(0)))
    together = (F.col("p.band") == F.col("q.band")) & (F.col("p.own") == F.col("q.own")) & (F.col("p.other") == F.col("q.other"))
    once = (F.col("p.root") != F.col("q.root")) & ((F.col("p.root") == F.col("p.major")) | (F.col("p.node") > F.col("q.node")))
    rest = p.join(q, together & once & _possible("p", "q") & (estimate(F.col("p.long_sign"), F.col("q.long_sign"), LONG_MINIMA, LONG_BITS) >= LONG_LEAST) & (first == F.col("p.place")))
    rest = written(rest.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.own").alias("salt")), "rest")
    discard(held)
    more = written(_confirmed(rest, sets), "links")
    discard(rest, sets, signs)
    settle(docs.sparkSession)
    if not more.isEmpty():
        discard(roots)
        roots = components(edges.unionByName(more))

    named = classes.select("node", "check", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    least = written(least, "least")
    labels = written(named.select("node", "check", "root").join(least, "root").select("node", "check", "component_id"), "labels")
    discard(classes, roots, named, least, more)
    out = some.select("doc_id", "n_shingles", "node", "check").join(labels, ["node", "check"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _candidate_sets(docs: DataFrame, signs: DataFrame) -> DataFrame:
    """(node, set) of the classes that share a bucket, from one text of each class.

    The ids are handed to every executor only when they are counted to be few; otherwise the texts are
    joined to them in a shuffle.
    """
    ids = signs.select(F.col("least").alias("doc_id")).distinct()
    few = signs.count() <= BROADCAST_ROWS
    wanted = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    made = wanted.select("text").mapInArrow(_sets, "node bigint, set array<bigint>")
    # Rows with the same id may hold other texts; one set for each class is kept.
    made = written(made.join(signs.select("node"), "node", "left_semi"), "sets")
    return made if made.count() == signs.count() else written(made.dropDuplicates(["node"]), "sets")
