"""Quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, bad or abstain on every document: two look at symbols, two at
marks and capitals, three at repetition, one at function words.  Votes are counted by pattern over the whole
table (at most 3**8 patterns), and expectation-maximisation on those counts estimates, for good documents and for
each kind of bad ones, its share and how often each labeller gives each vote, which is the labeller's accuracy.
There are as many kinds of bad documents as labellers; those that the votes don't need vanish.  All tables are
free: EM starts from the votes' shares alone, so that the majority says which class is the good one.  The
posterior of a pattern is a soft label; a bounded sample of documents with these labels trains a linear scorer
over hashed byte trigrams and hashed buckets of the statistics, which then scores every document.

No given labels are read.  Null and empty texts, and those of white space only: all labellers abstain, the
score is 0 and the document is rejected.  Rows with a null id are scored like others.  Repeated rows are scored
alike.  An empty table gives an empty result.  Texts of any length are scored whole.  Extra columns, also those
whose names differ by case only, are ignored unless they are carried; a carried column may not be named like a
column of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import no_clash, pick

#: Documents that train the scorer, but for chance: a document is drawn with this number over the table's rows, and at most twice as many are.
SAMPLE_ROWS = 4000
THRESHOLD = 0.5
TRIGRAM_BITS = 14
DIM = (1 << TRIGRAM_BITS) + 8 * 16 * 2
GOOD, BAD, ABSTAIN = 1, 0, 2
NAMES = ("symbols", "capitals", "markers", "distinct", "echoes", "leader", "function_words", "tails")

# Frequent function words of the four languages.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it was for on are as with by at from this be",
    "de": "der die und in den das von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas ne plus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
_LISTED = np.array(sorted({B.hash_of(w) for ws in FUNCTION_WORDS.values() for w in ws.split()}), np.uint64)
_LETTERS = B.letters_table()
_SYMBOL, _UPPER, _LETTER, _DIGIT = (np.zeros(256, np.uint8) for _ in range(4))
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_|!"]] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[0xC0:] = 1  # first bytes of characters beyond ASCII
#: For each labeller: bad from here on, good up to here (reversed where low is bad), and the least words.
_RULES = {"symbols": (0.08, 0.03, 1), "capitals": (0.5, 0.25, 2), "markers": (0.12, 0.03, 4), "distinct": (0.3, 0.36, 50), "echoes": (0.2, 0.08, 8), "leader": (0.25, 0.18, 20), "function_words": (0.02, 0.08, 20), "tails": (0.25, 0.1, 2)}
_LOW_IS_BAD = {"distinct", "function_words"}


def statistics(column: pa.Array) -> np.ndarray:
    """Per text: number of words, then the share that each labeller looks at."""
    buf, at = B.texts(column)
    n = len(at) - 1
    out = np.zeros((n, 9))
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    total = lambda table: np.add.reduceat(table[buf], at[full], dtype=np.int64)
    letters = np.maximum(total(_LETTER), 1)
    out[full, 1] = total(_SYMBOL) / np.maximum(total((~B.WHITE).astype(np.uint8)), 1)
    out[full, 2] = total(_UPPER) / letters
    low = np.frombuffer(buf.tobytes().translate(B.LOWER), np.uint8)
    marked, tailed, listed, words, which = [], [], [], [], []
    for b, s, e, w in B.words(low, at, B.WHITE):
        sums = B.prefix_sums(b)
        words.append(B.spans_hash(sums, s, e))
        which.append(w)
        inside = np.concatenate([[0], np.cumsum(_LETTER[b] | _DIGIT[b], dtype=np.int32)])
        marked.append(inside[e] == inside[s])
        odd = np.concatenate([[0], np.cumsum(_SYMBOL[b], dtype=np.int32)])
        tailed.append(odd[e] - odd[s] >= 2)
    for b, s, e, w in B.words(low, at, _LETTERS):
        h = B.spans_hash(B.prefix_sums(b), s, e)
        k = np.minimum(np.searchsorted(_LISTED, h), len(_LISTED) - 1)
        listed.append(np.stack([w, _LISTED[k] == h]))
    words, which, marked = np.concatenate(words), np.concatenate(which), np.concatenate(marked)
    listed = np.concatenate(listed, axis=1)
    count = np.bincount(which, minlength=n)
    safe = np.maximum(count, 1)
    out[:, 0] = count
    out[:, 3] = np.bincount(which, marked, n) / safe
    out[:, 8] = np.bincount(which, np.concatenate(tailed), n) / safe
    out[:, 7] = np.bincount(listed[0], listed[1], n) / np.maximum(np.bincount(listed[0], minlength=n), 1)
    echo = np.zeros(len(words))
    echo[1:] = (words[1:] == words[:-1]) & (which[1:] == which[:-1])
    out[:, 5] = np.bincount(which, echo, n) / safe
    ends = np.cumsum(count)
    for i in np.flatnonzero(count):
        times = np.unique(words[ends[i] - count[i] : ends[i]], return_counts=True)[1]
        out[i, 4], out[i, 6] = len(times) / count[i], times.max() / count[i]
    return out


def votes(stats: np.ndarray) -> np.ndarray:
    """A vote of each labeller on each text, from ``statistics``."""
    out = np.full((len(stats), len(NAMES)), ABSTAIN, np.int8)
    for j, name in enumerate(NAMES):
        bad, good, least = _RULES[name]
        x = stats[:, j + 1]
        is_bad, is_good = (x <= bad, x >= good) if name in _LOW_IS_BAD else (x >= bad, x <= good)
        enough = stats[:, 0] >= least
        out[enough & is_bad, j] = BAD
        out[enough & is_good, j] = GOOD
    return out


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> dict[str, np.ndarray]:
    """EM for good documents (class 0) and one kind of bad ones for each labeller: {share[class], table[class, labeller, vote], posterior of good by pattern, accuracy[labeller]}.

    Votes are taken as independent given the class; to abstain says nothing.  A pattern starts as good by its
    share of good votes, and as kind j of bad by the bad vote of labeller j.
    """
    n = patterns.shape[1]
    said = np.maximum((patterns != ABSTAIN).sum(axis=1), 1)
    bad = (patterns == BAD) / said[:, None]
    post = np.vstack([1 - bad.sum(axis=1), bad.T])
    for _ in range(rounds):
        weight = post * counts
        table = np.ones((n + 1, n, 3))
        for v in (BAD, GOOD):
            table[:, :, v] = weight @ (patterns == v) + 0.5
        table[:, :, :2] /= table[:, :, :2].sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (weight.sum() + n + 1)
        logs = np.log(table[:, np.arange(n)[None, :], patterns]).sum(axis=2) + np.log(share)[:, None]
        new = np.exp(logs - logs.max(axis=0))
        new /= new.sum(axis=0)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    weight = post * counts
    right = weight[0] @ (patterns == GOOD) + weight[1:].sum(axis=0) @ (patterns == BAD)
    return {"share": share, "table": table, "posterior": post[0], "accuracy": right / np.maximum(counts @ (patterns != ABSTAIN), 1e-300)}


def features(column: pa.Array, stats: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: square roots of trigram shares, and one bucket of each statistic."""
    buf, at = B.texts(column)
    grams = 1 << TRIGRAM_BITS
    edges = np.array([0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.25, 0.3, 0.36, 0.45, 0.55, 0.7, 0.85, 0.95])
    for i in range(len(at) - 1):
        seen = np.zeros(grams, np.int64)
        for lo in range(int(at[i]), int(at[i + 1]), B.BLOCK):  # two bytes of overlap join the blocks
            b = buf[lo : min(lo + B.BLOCK + 2, int(at[i + 1]))].astype(np.uint32)
            if len(b) >= 3:
                h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
                seen += np.bincount(h, minlength=grams)
        at_, total = np.flatnonzero(seen), max(int(seen.sum()), 1)
        bucket = np.searchsorted(edges, stats[i, 1:], "right") + 16 * np.arange(8)
        long_ = 128 * int(stats[i, 0] >= 20)  # statistics of a few words say something else
        yield np.concatenate([at_, grams + long_ + bucket]), np.concatenate([np.sqrt(seen[at_] / total), np.full(8, 0.5)])


def fit_scorer(rows: list[tuple[float, np.ndarray, np.ndarray]], rounds: int = 300, ridge: float = 1e-4, rate: float = 2.0) -> np.ndarray:
    """Weights, and the bias last, of a logistic scorer of soft labels; both classes weigh alike."""
    w = np.zeros(DIM + 1)
    if not rows:
        return w
    y = np.array([r[0] for r in rows])
    at = np.concatenate([r[1] for r in rows])
    x = np.concatenate([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    each = y * 0.5 / max(y.sum(), 1e-9) + (1 - y) * 0.5 / max((1 - y).sum(), 1e-9)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)) + w[-1], -40, 40)))
        g = each * (p - y)
        grad = np.bincount(at, x * g[row], DIM + 1) + ridge * w
        grad[-1] = g.sum()
        speed = 0.9 * speed - rate * grad
        w = w + speed
    return w


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.portions(batches, 0):
        v = votes(statistics(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string())], ["votes"])


def _example(posterior: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.portions(batches, 0):
            stats = statistics(batch.column(0))
            keys = ["".join(map(str, r)) for r in votes(stats).tolist()]
            found = [(posterior.get(k, 0.5), *f) for k, f, n in zip(keys, features(batch.column(0), stats), stats[:, 0], strict=True) if n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in found], pa.float64()), pa.array([r[1].astype(np.int32) for r in found], pa.list_(pa.int32())), pa.array([r[2].astype(np.float32) for r in found], pa.list_(pa.float32()))],
                ["p", "at", "x"],
            )

    return run


def _score(weights, posterior):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value, posterior
        for batch in B.portions(batches, 1):
            stats = statistics(batch.column(1))
            keys = ["".join(map(str, r)) for r in votes(stats).tolist()]
            z = np.array([w[at] @ x + w[-1] for at, x in features(batch.column(1), stats)])
            p = np.where(stats[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array(p >= THRESHOLD), pa.array(keys, pa.string()), pa.array([known.get(k, 0.5) for k in keys], pa.float64()), *batch.columns[2:]],
                ["doc_id", "score", "kept", "votes", "posterior", *batch.schema.names[2:]],
            )

    return run


def quality_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Posterior by vote pattern and the scorer's weights, from a frame with the columns ``__id`` and ``__text``."""
    texts = docs.select("__text")
    found = texts.mapInArrow(_vote, "votes string").groupBy("votes").count().collect()  # at most 3**8 rows
    found.sort()
    patterns = np.array([[int(c) for c in r["votes"]] for r in found], np.int8).reshape(-1, len(NAMES))
    counts = np.array([r["count"] for r in found], float)
    model = fit_labellers(patterns, counts)
    posterior = {r["votes"]: float(p) for r, p in zip(found, model["posterior"], strict=True)}
    n = float(counts.sum())
    share = min(1.0, sample_rows / max(n, 1))
    drawn = docs.where(F.pmod(F.xxhash64("__id", "__text"), F.lit(2**32)) < F.lit(int(2**32 * share))).select("__text").limit(2 * sample_rows)
    rows = drawn.mapInArrow(_example(posterior), "p double, at array<int>, x array<float>").toArrow()
    examples = list(zip(rows["p"].to_pylist(), map(np.asarray, rows["at"].to_numpy()), map(np.asarray, rows["x"].to_numpy()), strict=True)) if len(rows) else []
    w = fit_scorer(examples)
    good = float(counts @ model["posterior"]) if len(counts) else 0.0
    w[-1] += np.log((good + 1) / (n - good + 1))  # the scorer weighs both classes alike; the table does not
    return posterior, w


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, kept, votes, posterior, *carry) of every row: score in 0 to 1, kept where it is at least ``THRESHOLD``."""
    no_clash(carry, "doc_id", "score", "kept", "votes", "posterior")
    docs = pick(df, id_col, text_col, *carry).toDF("__id", "__text", *carry)
    posterior, w = quality_model(docs, sample_rows)
    weights = docs.sparkSession.sparkContext.broadcast(w)
    types = [f.dataType.simpleString() for f in docs.schema]
    schema = f"doc_id {types[0]}, score double, kept boolean, votes string, posterior double" + "".join(f", `{c}` {t}" for c, t in zip(carry, types[2:], strict=True))
    return docs.mapInArrow(_score(weights, posterior), schema)
