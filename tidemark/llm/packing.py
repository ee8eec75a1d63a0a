"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

A document is its ids followed by an end id.  Documents longer than a sequence are cut into full pieces, the
first of which may be shorter.  Counting the pieces of each length gives a histogram of at most ``capacity``
numbers; best-fit decreasing runs over these counts on the driver and yields ranges of slots: pieces
``first`` to ``last`` of a length go to consecutive sequences at one offset.  The number of ranges depends on
the number of different lengths, not of documents.  Pieces then take their slots by rank within their length.

Ranks need no length in one task: pieces are spread over hash buckets, counted, and ranked within a bucket.

Nulls and empty texts are one piece that holds the end id alone.  Rows with a null id and repeated rows are
separate documents; pieces that agree in id and number are ranked in any order, which leaves every sequence
gapless.  Texts of any length are encoded whole.  An empty table gives an empty result.  Extra columns, also those
whose names differ by case only, are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import pick, written

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
BUCKET_ROWS = 20_000
#: Texts are encoded a block at a time.
_BLOCK_CHARS = 1 << 20


def _encoder(name: str, added: str = "text"):
    """A function from texts to lists of ids.

    ``added`` says what the strings of the tokenizer's added tokens, such as ``<|endoftext|>``, are when a text
    holds them: ordinary text, as the files' own description has it, or the ids of these tokens, as the tokenizer
    does by default.  Where the folder also has the vocabulary as ranks, the ranks give the same ids in a quarter
    of the time (a test holds both against each other in either setting); otherwise the tokenizer file is used.
    """
    if added not in ("text", "ids"):
        raise ValueError(f"added tokens are text or ids, not {added!r}")
    import public_tokenizers

    ranks = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken") if name == TOKENIZER else None
    if ranks:
        import json

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            tokens = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=tokens if added == "ids" else {})
        if added == "ids":
            return lambda texts: [coder.encode(t, allowed_special="all") for t in texts]
        return lambda texts: [coder.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = added == "text"
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def _pieces_of(name: str, capacity: int, end_id: int, keep_ids: bool, added: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name, added)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):
                base = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, base + _BLOCK_CHARS, "right")))
                where, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, found in enumerate(encode(texts.slice(i, j - i).to_pylist())):
                    found.append(end_id)
                    held = np.array(found, "<u4")
                    for p, (s, n) in enumerate(cut(len(held), capacity)):
                        where.append(i + k)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(held[s : s + n]))
                        if keep_ids:
                            ids.append(held[s : s + n].astype(np.int32))
                columns = {"doc_id": batch.column(0).take(pa.array(where, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)
                i = j

    return run


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, added: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    docs = pick(df, id_col, text_col).toDF("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_pieces_of(tokenizer, capacity, end_id, keep_ids, added), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: slot ranges (length, first rank, last rank, first sequence, offset), and the sequences used.

    Open sequences with the same room left are kept as runs of consecutive numbers; a length takes whole runs
    from the tightest room that holds it and opens a new run for what is left.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # the different amounts of room left, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    used = 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                # Full sequences of this length alone, then one that takes the remainder.
                for fill, n in ((each, left // each), (left % each, int(left % each > 0))):
                    for j in range(fill if n else 0):
                        slots.append((length, rank, rank + n, used, j * length))
                        rank += n
                    if n:
                        leave(capacity - fill * length, used, n)
                        used += n
                break
            room = rooms[k]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(k)
            take = min(n, left)
            slots.append((length, rank, rank + take, first, capacity - room))
            leave(room - length, first, take)
            if take < n:
                leave(room, first + take, n - take)
            rank, left = rank + take, left - take
    return slots, used


def pack(made: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``made`` with (sequence_id, offset) for every row, by its column ``length``.

    ``made`` must be a written table or cheap to read: it is read twice.
    """
    spark = made.sparkSession
    salt = F.pmod(F.xxhash64(*keys), F.lit(2**20))
    rows = made.count()
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    spread = made.withColumn("bucket", (salt % buckets).cast("int"))
    counted = written(spread.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots, _ = plan(counts, capacity)
    ahead = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counted = written(counted.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n"), "ranks")
    ranked = spread.withColumn("at", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*keys)) - 1)
    ranked = ranked.join(counted, ["length", "bucket"]).withColumn("rank", F.col("at") + F.col("ahead")).drop("at", "ahead", "bucket")
    table = spark.sparkContext.broadcast(_by_length(slots))  # a few ranges for each length
    place = F.pandas_udf(_placer(table), "sequence_id bigint, offset bigint")
    return ranked.withColumn("slot", place("length", "rank")).select(*made.columns, "slot.sequence_id", "slot.offset")


def _by_length(slots: list[tuple[int, int, int, int, int]]) -> dict[str, np.ndarray]:
    """The ranges sorted by (length, first rank) as one array each, with a key that orders both."""
    t = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return {"key": (t[:, 0] << 48) + t[:, 1], "first": t[:, 1], "sequence": t[:, 3], "offset": t[:, 4]}


def _placer(table):
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = table.value
        i = np.searchsorted(t["key"], (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][i] + rank.to_numpy(np.int64) - t["first"][i], "offset": t["offset"][i]})

    return place


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, added: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece."""
    return pack(written(pieces(df, id_col, text_col, tokenizer=tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids, added=added), "pieces"), capacity)
