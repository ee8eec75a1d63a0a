"""Language identification, word first.

A known word scores by its log frequency in each language.  An unseen word backs off: at each of its places
the longest known character n-gram that starts there is taken, from five characters down to one, and the mean
of their log frequencies stands for the word.  The language with the greatest sum wins.

Fitting reads a bounded sample of labelled texts (``PER_LANGUAGE`` a language, but for chance).  Words, and the
n-grams of all words of the sample, are counted by the executors; the model holds the ``WORDS`` most frequent
words and the ``GRAMS`` most frequent n-grams of every language, with their counts in all languages.
Prediction reads whole texts of every row; a word of any length is one word.

``und``, with score 0, is what a text gets that is null or has no letter, or when no language was learned.
Ties go to the language that comes first by code point.  Rows with a null id are predicted like others.
Repeated rows are predicted alike.  An empty table gives an empty result.  Extra columns, also those whose
names differ from the named ones by case only, are ignored unless they are carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import discard, no_clash, pick, written

#: Texts to learn from, words and n-grams to know, all of them by language.
PER_LANGUAGE, WORDS, GRAMS = 3000, 100_000, 50_000
LONGEST = 5
UNKNOWN = "und"
_SMOOTH = 0.5
_BLOCK_CHARS = 1 << 19
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of (text number, lower-case text), long texts cut between words."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        lo = 0
        while lo < len(t):
            hi = min(len(t), lo + _BLOCK_CHARS)
            while hi < len(t) and t[hi - 1].isalpha() and t[hi].isalpha():
                hi += 1
            rows.append(i)
            parts.append(t[lo:hi])
            size += hi - lo
            lo = hi
            if size >= _BLOCK_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _words(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, text number) of the words of a block: runs of letters."""
    codes = np.frombuffer("\n".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    change = np.diff(_letters()[codes].astype(np.int8))
    starts, ends = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    begins = np.cumsum([1, *(len(p) + 1 for p in parts[:-1])])
    return codes, starts, ends, np.array(rows)[np.searchsorted(begins, starts, "right") - 1]


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * B.powers(len(codes)), out=out[1:])
    return out


def _hashes(words: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    out = np.empty(len(words), np.uint64)
    step = 1 << 18  # a block of powers at a time
    for i in range(0, len(words), step // 8):
        j = min(len(words), i + step // 8)
        lo = ends[i - 1] if i else 0
        sums = _sums(codes[lo : ends[j - 1]])
        out[i:j] = B.spans_hash(sums, np.concatenate([[lo], ends[i : j - 1]]) - lo, ends[i:j] - lo)
    return out


class _Lookup:
    """From hashes to row numbers, -1 where unknown: keys are sorted, and a table says where each prefix begins."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        self.rows = np.argsort(keys)
        self.keys = keys[self.rows]
        begins = np.searchsorted((self.keys >> self.shift).astype(np.int64), np.arange((1 << (64 - int(self.shift))) + 1))
        self.begins = begins.astype(np.int32)
        self.most = int(np.diff(begins).max(initial=0))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes >> self.shift).astype(np.int64)
        at, end = self.begins[slots], self.begins[slots + 1]
        out = np.full(len(hashes), -1, np.int64)
        todo = np.flatnonzero(at < end)
        for j in range(self.most):
            todo = todo[at[todo] + j < end[todo]]
            place = at[todo] + j
            hit = self.keys[place] == hashes[todo]
            out[todo[hit]] = self.rows[place[hit]]
            todo = todo[~hit]
        return out


def _gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length, word number) of every n-gram of words with a blank on either side, but for the blank alone."""
    own = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(w) for w in words]) + 1  # a word and the blank before it
    word = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)[word] + 1  # past the blank after the word
    sums, here = _sums(own), np.arange(len(word))
    hashes, lengths, which = [], [], []
    for k in range(1, LONGEST + 1):
        at = here[(here + k <= ends) & ((k > 1) | (own[:-1] != 32))]
        hashes.append(B.spans_hash(sums, at, at + k))
        lengths.append(np.full(len(at), k))
        which.append(word[at])
    return np.concatenate(hashes), np.concatenate(lengths), np.concatenate(which)


def _logs(table: np.ndarray) -> np.ndarray:
    return np.log((table + _SMOOTH) / (table.sum(axis=0) + _SMOOTH * (len(table) + 1))).astype(np.float32)


class Model:
    """Languages, and log frequencies by language of words and n-grams under their hashes."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: dict[tuple[int, int], np.ndarray]):
        """words: word -> times by language; grams: (hash, length) -> times by language."""
        self.languages = languages
        m = len(languages)
        self.word_keys = _hashes(list(words)) if words else np.empty(0, np.uint64)
        self.word_logs = _logs(np.array(list(words.values()), float).reshape(len(words), m))
        self.gram_keys = np.array([g for g, _ in grams], np.int64).view(np.uint64)
        table, size = np.array(list(grams.values()), float).reshape(len(grams), m), np.array([k for _, k in grams], int)
        self.gram_logs = np.zeros(table.shape, np.float32)
        for k in range(1, LONGEST + 1):  # frequencies among the n-grams of one length
            self.gram_logs[size == k] = _logs(table[size == k])
        self._tables: tuple[_Lookup, _Lookup] | None = None

    @classmethod
    def of(cls, counts: dict[str, dict[str, int]]) -> Model:
        """All words and n-grams of counts: language -> word -> times."""
        languages = sorted(counts)
        words: dict[str, np.ndarray] = {}
        grams: dict[tuple[int, int], np.ndarray] = {}
        for j, lang in enumerate(languages):
            for w, n in counts[lang].items():
                words.setdefault(w, np.zeros(len(languages)))[j] += n
            found = list(counts[lang])
            if found:
                for h, k, i in zip(*_gram_hashes(found), strict=True):
                    grams.setdefault((int(h.view(np.int64)), int(k)), np.zeros(len(languages)))[j] += counts[lang][found[i]]
        return cls(languages, words, grams)

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, m = len(texts), len(self.languages)
        if self._tables is None:
            self._tables = _Lookup(self.word_keys), _Lookup(self.gram_keys)
        known, grams = self._tables
        total, units = np.zeros((n, m)), np.zeros(n, np.int64)
        for rows, parts in _parts(texts):
            codes, s, e, w = _words(rows, parts)
            if not len(s):
                continue
            units += np.bincount(w, minlength=n)
            if not m:
                continue
            at = known(B.spans_hash(_sums(codes), s, e))
            hit = at >= 0
            for j in range(m):
                total[:, j] += np.bincount(w[hit], self.word_logs[at[hit], j], n)
            for k in range(0, len(miss := np.flatnonzero(~hit)), 1 << 16):
                self._back_off(codes, s, e, w, miss[k : k + (1 << 16)], grams, total)
        best = total.argmax(axis=1) if m else np.zeros(n, int)
        warm = total / np.sqrt(np.maximum(units, 1))[:, None]
        odds = np.exp(warm - warm.max(axis=1, keepdims=True)) if m else np.zeros((n, 1))
        score = np.where((units > 0) & (m > 0), odds.max(axis=1) / np.maximum(odds.sum(axis=1), 1e-300), 0.0)
        return [self.languages[b] if u and m else UNKNOWN for b, u in zip(best, units, strict=True)], score

    def _back_off(self, codes, s, e, w, miss, grams, total) -> None:
        """Add the scores of the words numbered ``miss``: copied out with a blank on either side."""
        size = e[miss] - s[miss] + 2
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(miss)), size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size)
        own = codes[np.clip(s[miss][word] + place - 1, 0, len(codes) - 1)].copy()
        own[(place == 0) | (place == size[word] - 1)] = 32
        sums = _sums(own)
        here = np.arange(len(own))
        left = size[word] - place  # characters from here to the end of the padded word
        found = np.full(len(own), -1)
        for k in range(LONGEST, 0, -1):
            todo = np.flatnonzero((found < 0) & (left >= k))
            found[todo] = grams(B.spans_hash(sums, here[todo], here[todo] + k))
        hit = found >= 0
        times = np.maximum(np.bincount(word[hit], minlength=len(miss)), 1)
        n = len(total)
        for j in range(total.shape[1]):
            mean = np.bincount(word[hit], self.gram_logs[found[hit], j], len(miss)) / times
            total[:, j] += np.bincount(w[miss], mean, n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for rows, parts in _parts([text]):
                codes, s, e, _ = _words(rows, parts)
                whole = codes.tobytes()
                counts.setdefault(lang, Counter()).update(whole[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(s.tolist(), e.tolist(), strict=True))
        flat = [(lang, w, n) for lang, words in counts.items() for w, n in words.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, size, n) of the n-grams of counted words."""
    for batch in B.portions(batches, 1, 20_000, 1 << 20):
        langs = batch.column(0).dictionary_encode()
        times = batch.column(2).to_numpy(zero_copy_only=False)
        h, k, i = _gram_hashes(batch.column(1).to_pylist())
        code = langs.indices.to_numpy(zero_copy_only=False)[i]
        order = np.lexsort((h, k, code))
        h, k, code, n = h[order], k[order], code[order], times[i][order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (code[1:] != code[:-1])]))
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(code[first])), pa.array(h[first].view(np.int64)), pa.array(k[first].astype(np.int32)), pa.array(np.add.reduceat(n, first))],
            ["lang", "gram", "size", "n"],
        )


def _most_frequent(counted: DataFrame, keys: list[str], most: int, languages: list[str]) -> dict:
    """The ``most`` most frequent keys of each language, ties by key, with their counts in every language."""
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), *keys))).where(F.col("r") <= most)
    chosen = ranked.select(*keys).distinct()
    got = counted.join(chosen, keys, "left_semi").toArrow()  # languages * most keys, at most
    place = {lang: j for j, lang in enumerate(languages)}
    out: dict = {}
    columns = [got[k].to_pylist() for k in keys]
    for key, lang, n in zip(zip(*columns, strict=True) if len(keys) > 1 else columns[0], got["lang"].to_pylist(), got["n"].to_pylist(), strict=True):
        out.setdefault(key, np.zeros(len(languages)))[place[lang]] = n
    return dict(sorted(out.items()))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model from labelled docs (``id``, ``text``, ``lang``)."""
    docs = docs.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return Model([], {}, {})
    bound = reduce(lambda c, i: c.when(F.col("lang") == i[0], F.lit(int(2**32 * min(1.0, per_language / i[1])))), sorted(sizes.items()), F.when(F.lit(False), F.lit(0)))
    drawn = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(2**32)) < bound).select("lang", "text")
    counted = written(drawn.mapInArrow(_count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    parts = written(counted.mapInArrow(_count_grams, "lang string, gram bigint, size int, n bigint").groupBy("lang", "gram", "size").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(sizes)
    model = Model(languages, _most_frequent(counted, ["word"], words, languages), _most_frequent(parts, ["gram", "size"], grams, languages))
    discard(counted, parts)
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    return run


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, labelled: DataFrame | None = None, lang_col: str = "lang", learn=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, *carry) of every row of ``df``.

    The model learns from ``labelled`` (by default ``df`` itself) with the column ``lang_col``, where the
    condition ``learn(id column)`` holds.
    """
    no_clash(carry, "doc_id", "lang_pred", "score")
    known = pick(labelled if labelled is not None else df, id_col, text_col, lang_col).toDF("id", "text", "lang")
    condition: Column = learn(F.col("id")) if learn is not None else F.lit(True)
    docs = pick(df, id_col, text_col, *carry).toDF("__id", "__text", *carry)
    model = docs.sparkSession.sparkContext.broadcast(fit(known.where(condition)))
    types = [f.dataType.simpleString() for f in docs.schema]
    schema = f"doc_id {types[0]}, lang_pred string, score double" + "".join(f", `{c}` {t}" for c, t in zip(carry, types[2:], strict=True))
    return docs.mapInArrow(_predict(model), schema)
