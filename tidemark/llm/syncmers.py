"""Document fingerprints from closed syncmers, in DataFrame operations alone.

A text is a sequence of tokens.  A window of ``K`` = 5 tokens holds four inner pairs; it is a closed syncmer
when the pair with the least hash is its first or its last one.  That depends on the window alone, so an edit
moves no anchors but those it touches, and equal passages share anchors wherever they stand.  The fingerprint
holds all of them in order, each as ten hexadecimal digits of its hash and six of its place, over words and,
for texts of at most ``SHORT`` characters, over characters too.  Places from ``LAST`` on count as ``LAST``.

``likeness`` matches by position.  The k-th place of a hash in one text pairs with its k-th place in the other;
pairs that follow each other at one distance form a run, and the heaviest chain of runs that ascends in both
texts counts.  The likeness is twice the anchors of that chain over the anchors of both texts, all of them.

Tokens are runs without white space, at most 32 characters long, and single characters of scripts written
without spaces.  Texts with fewer than five tokens have one anchor, the hash of all of them.  Null is empty;
a text without tokens has the empty fingerprint, which is like another empty one (1) and nothing else (0).
Repeated rows have equal fingerprints.  Texts of any length are taken whole.  An empty table gives an empty
result.  Extra columns, also those whose names differ by case only, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import fresh, pick, written

K = 5
SHORT = 300
PLACE_BITS = 24
#: The last place told apart; the bit above it says which of two texts an anchor is of.
LAST = 2 ** (PLACE_BITS - 1) - 1
_SINGLE = r"\u0E00-\u0E7F\u2E80-\u9FFF\uAC00-\uD7AF"
TOKEN = rf"[{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}]{{1,32}}"
#: Rows in one range of ids when neighbours are looked up, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 256, 1 << 14


def _tail(a: str, n: int) -> Column:
    """The array without its first n elements."""
    return F.slice(F.col(a), n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _closed(df: DataFrame, tokens: Column, out: str) -> DataFrame:
    """``df`` with the array ``out`` of (place, hash) of the closed syncmers of an array of tokens.

    Each step is a column of its own, so nothing is computed twice.
    """
    h, g, z = fresh(df, "h"), fresh(df, "g"), fresh(df, "z")
    df = df.withColumn(h, F.transform(tokens, lambda t: F.xxhash64(t)))
    pairs = F.zip_with(F.col(h), _tail(h, 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(g, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))
    whole = F.arrays_zip(F.col(g).alias("a"), _tail(g, 1).alias("b"), _tail(g, 2).alias("c"), _tail(g, 3).alias("d"))
    df = df.withColumn(z, F.slice(whole, 1, F.greatest(F.size(g) - 3, F.lit(0))))
    places = F.transform(F.col(z), lambda x, i: F.when(F.least(x["a"], x["d"]) <= F.least(x["b"], x["c"]), F.struct((i + 1).alias("place"), _forty(F.xxhash64(x["a"], x["c"], x["d"])).alias("hash"))))
    few = F.when(F.size(h) > 0, F.array(F.struct(F.lit(1).alias("place"), _forty(F.xxhash64(F.col(h))).alias("hash")))).otherwise(F.array().cast("array<struct<place:int,hash:bigint>>"))
    return df.withColumn(out, F.when(F.size(h) < K, few).otherwise(F.array_compact(places))).drop(h, g, z)


def _forty(h: Column) -> Column:
    return F.shiftrightunsigned(h, 24)


def _packed(anchors: str) -> Column:
    """Each anchor as one number: its hash above its place."""
    return F.transform(F.col(anchors), lambda x: F.shiftleft(x["hash"], PLACE_BITS).bitwiseOR(F.least(x["place"], F.lit(LAST)).cast("bigint")))


def _digits(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ",")


def with_anchors(df: DataFrame, text_col: str = "text", out: str = "anchors") -> DataFrame:
    """``df`` with an array of (place, hash): all closed syncmers over the words of a text, in order."""
    return _closed(df, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0)), out)


def with_places(df: DataFrame, text_col: str = "text", out: str = "places") -> DataFrame:
    """``df`` with a struct of the packed anchors over ``words``, and over ``letters`` of short texts."""
    words, letters = fresh(df, "words"), fresh(df, "letters")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = with_anchors(df, text_col, words)
    df = _closed(df, F.when(F.length(text) <= SHORT, F.split(text, "")).otherwise(F.array().cast("array<string>")), letters)
    return df.withColumn(out, F.struct(_packed(words).alias("words"), _packed(letters).alias("letters"))).drop(words, letters)


def fingerprint(places: str) -> Column:
    """All anchors as a string: those over words, and after a bar those over characters of short texts."""
    c = F.col(places)
    return F.when(F.size(c["words"]) > 0, F.concat(_digits(c["words"]), F.lit("|"), _digits(c["letters"]))).otherwise("")


def likeness(df: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """``df`` with the likeness of two columns of places: over characters where both have them, else over words.

    Each step is a column of its own, so nothing is computed twice.
    """
    a, b, s, g, p, r = (fresh(df, x) for x in "absgpr")
    x, y = F.col(one), F.col(two)
    short = (F.size(x["letters"]) > 0) & (F.size(y["letters"]) > 0)
    df = df.withColumn(a, F.when(short, x["letters"]).otherwise(x["words"])).withColumn(b, F.when(short, y["letters"]).otherwise(y["words"]))
    at = lambda c, i: F.get(F.col(c), i)
    numbers = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    # Anchors of both by hash, text and place, and where a hash of one text begins.
    df = df.withColumn(s, F.sort_array(F.concat(F.col(a), F.transform(b, lambda v: v.bitwiseOR(F.lit(LAST + 1).cast("bigint"))))))
    side, hash_ = lambda v: F.shiftright(v, PLACE_BITS - 1), lambda v: F.shiftright(v, PLACE_BITS)
    df = df.withColumn(g, F.filter(numbers(s), lambda i: (i == 0) | (side(at(s, i)) != side(at(s, i - 1)))))
    both = lambda i, j: hash_(at(s, i)) == hash_(at(s, at(g, j + 1)))
    met = F.filter(F.transform(g, lambda i, j: F.when(both(i, j), F.struct(i.alias("one"), at(g, j + 1).alias("two"), F.coalesce(at(g, j + 2), F.size(s)).alias("end")))), lambda v: v.isNotNull())
    place = lambda v: v.bitwiseAND(F.lit(LAST).cast("bigint"))
    pair = lambda v, k: F.shiftleft(place(at(s, v["one"] + k)), 32).bitwiseOR(place(at(s, v["two"] + k)))
    pairs = F.flatten(F.transform(met, lambda v: F.transform(F.sequence(F.lit(0), F.least(v["two"] - v["one"], v["end"] - v["two"]) - 1), lambda k: pair(v, k))))
    df = df.withColumn(p, F.sort_array(pairs))
    first, second = lambda v: F.shiftright(v, 32), lambda v: v.bitwiseAND(F.lit(2**32 - 1))
    distance = lambda v: first(v) - second(v)
    df = df.withColumn(r, F.filter(numbers(p), lambda i: (i == 0) | (distance(at(p, i)) != distance(at(p, i - 1)))))
    end = lambda j: F.coalesce(at(r, j + 1), F.size(p))
    runs = F.transform(r, lambda i, j: F.struct(second(at(p, i)).alias("low"), second(at(p, end(j) - 1)).alias("high"), (end(j) - i).alias("n")))
    df = df.withColumn(r, runs)

    def longer(chains: Column, run: Column) -> Column:
        """Chains by their end in the second text, without those that another equals or beats by then."""
        best = F.coalesce(F.array_max(F.transform(F.filter(chains, lambda c: c["end"] < run["low"]), lambda c: c["n"])), F.lit(0)) + run["n"]
        grown = F.array(F.struct(run["high"].alias("end"), best.alias("n")))
        return F.concat(F.filter(chains, lambda c: (c["end"] < run["high"]) | (c["n"] > F.get(grown, F.lit(0))["n"])), grown)

    chained = F.aggregate(r, F.array().cast("array<struct<end:bigint,n:int>>"), longer, lambda c: F.coalesce(F.array_max(F.transform(c, lambda v: v["n"])), F.lit(0)))
    most = F.when(F.size(r) == 0, 0).when(F.size(r) == 1, F.size(p)).otherwise(chained)
    total = F.size(a) + F.size(b)
    return df.withColumn(out, F.when(total == 0, 1.0).otherwise(2.0 * most / F.greatest(total, F.lit(1)))).drop(a, b, s, g, p, r)


def _numbers(values: list, kind: str) -> Column:
    """A constant array, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _ranges(ids: DataFrame) -> tuple[list[int], list[int]]:
    """(bounds, parts): where ranges of the ids ``at`` begin, and into how many parts each range is cut.

    Bounds are quantiles, so dense, sparse and hashed ids give even ranges.  An id that fills several quantiles
    is a range of its own, cut by a hash of the text.
    """
    n = ids.count()
    k = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if k <= 1:
        return [], [1]
    found = ids.agg(F.percentile_approx("at", _numbers([i / k for i in range(1, k)], "double"), max(10_000, 4 * k))).first()[0]
    times = {v: found.count(v) for v in dict.fromkeys(found)} if len(set(found)) < len(found) else dict.fromkeys(found, 1)
    bounds = sorted({*times, *(v + 1 for v, m in times.items() if m > 1 and v < 2**63 - 1)})
    return bounds, [1, *(times.get(v, 1) for v in bounds)]


def _with_ranges(docs: DataFrame, bounds: list[int], parts: list[int]) -> DataFrame:
    """``docs`` with ``range``, the number of bounds up to ``at`` by binary search, and ``part`` by ``tie``."""
    held, steps = _numbers(bounds, "bigint"), _numbers([1 << i for i in reversed(range(len(bounds).bit_length()))], "int")
    up = lambda i, step: F.when(F.get(held, i + step - 1) <= F.col("at"), i + step).otherwise(i)
    docs = docs.withColumn("range", F.aggregate(steps, F.lit(0), up) if bounds else F.lit(0))
    even = F.col("tie") / F.lit(2.0**64) + 0.5
    return docs.withColumn("part", F.least(F.floor(even * F.get(_numbers(parts, "int"), F.col("range"))), F.get(_numbers(parts, "int"), F.col("range")) - 1).cast("int"))


def _targets(docs: DataFrame) -> DataFrame:
    """(head, range, part): the first row of every part of a range, and the part whose last row it follows.

    Going down the ids, the first row of a part comes after the last row of the part before, and that of the
    highest after the last row of all.  There are at most twice ``MOST_RANGES`` parts.
    """
    heads = docs.groupBy("range", "part").agg(F.max(F.struct("at", F.bitwise_not("tie").alias("late"))).alias("head"))
    down = W.orderBy(F.desc("range"), "part")
    heads = heads.withColumn("first", F.first("head").over(down)).withColumn("head", F.coalesce(F.lead("head").over(down), "first"))
    return heads.select(F.col("head.at").alias("head_at"), F.col("head.late").alias("head_late"), F.col("range").alias("to_range"), F.col("part").alias("to_part"))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text.

    Next is the row with the next smaller id; rows with equal ids are ordered by a hash of their text, nulls
    come last, and after the last row comes the first.  The edited text has its last third of characters
    replaced by the first characters of the next text.  Ids must be integers.
    """
    docs = pick(df, id_col, text_col).toDF("doc_id", "text")
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("the order of rows goes by integer ids")
    least = F.lit(-(2**63)).cast("long")
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("at", F.coalesce(F.col("doc_id").cast("long"), least)).withColumn("tie", F.xxhash64("text"))
    docs = _with_ranges(docs, *_ranges(docs.select("at")))
    targets = F.broadcast(written(_targets(docs), "targets"))  # at most 2 * MOST_RANGES rows
    first = (F.col("at") == F.col("head_at")) & (F.bitwise_not("tie") == F.col("head_late"))
    copies = docs.join(targets, first).select("doc_id", "text", "at", "tie", F.col("to_range").alias("range"), F.col("to_part").alias("part"))
    rows = docs.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    order = W.partitionBy("range", "part").orderBy("copy", F.desc("at"), "tie")
    # Anchors are taken between two windows of one order: texts are shuffled, anchors are not.
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = with_places(rows).withColumn("next_places", F.lead("places").over(order)).where("copy = 0")
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("third", F.floor(n / 3).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("third")), F.substring(F.col("next_text"), F.lit(1), F.col("third")))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_places(rows, "edited", "edited_places")
    rows = likeness(rows, "places", "edited_places", "near_edited")
    rows = likeness(rows, "places", "next_places", "near_next")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("places").alias("fingerprint"), fingerprint("edited_places").alias("edited_fingerprint"), "near_edited", "near_next")
