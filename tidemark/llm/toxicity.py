"""Toxicity classifier with a counterfactual penalty on identity terms.

A linear scorer over the set of hashed words of a text and of their beginnings.  It is fitted on labelled
texts by proximal gradient steps with an L1 penalty, so that words which say nothing weigh nothing however
long a text is.  Two kinds of counterfactual pairs are made of the labelled texts, and the squared change of the
score within a pair is penalised.  A text that names a group comes with its terms swapped for every other one of
their kind: what a group is called must not matter.  And every text comes with a neutral mention of a group put
in, against the same text without it and with the mention swapped: that a group is named must not matter.  Both
take away false positives on neutral mentions.  The terms are a parameter; beginnings of terms are no features.

Fitting reads a bounded sample of labelled rows (``PER_CLASS`` a class, but for chance), weighted back to the
label's shares, and at most four times as many texts, should labelled ids be repeated; scoring reads every row
and whole texts of any length.  Where no labelled text holds a term, as
in the supplied tables, terms have no weight from the start, and the pairs only bind slots that terms share with
other words by their hash.

Nulls and empty texts have no words: their score is the one of the bias alone.  Labels that are null are not
used, nor are those of null ids; of repeated ids the highest label counts.  Without labels of both classes the
score is the share of label 1, or 0.  Rows with a null id are scored like others.  Repeated rows are scored alike.
An empty table gives an empty result.  Extra columns, also those whose names differ by case only, are ignored
unless they are carried; a carried column may not be named like a column of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import no_clash, pick

THRESHOLD = 0.3
PER_CLASS = 2500
BITS = 20
STARTS = (5, 7)
LASSO, RIDGE, PENALTY = 5e-4, 1e-5, 1.0

# Identity terms by kind; any of a kind may stand for any other.
IDENTITY = {
    "gender": "woman women man men girl boy female male transgender nonbinary frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres",
    "orientation": "gay lesbian bisexual queer straight heterosexual homosexual schwul lesbisch homosexuel lesbienne homosexual lesbiana",
    "religion": "muslim muslims christian christians jewish jew jews hindu buddhist atheist catholic protestant muslime christen juden musulman chrétien juif musulmán cristiano judío",
    "origin": "black white asian african european american latino hispanic arab indian chinese mexican immigrant immigrants refugee refugees ausländer flüchtlinge immigré réfugié inmigrante refugiado",
    "condition": "deaf blind disabled elderly old young autistic behindert taub sourd aveugle sordo ciego",
}
_LETTERS = B.letters_table()


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (B.mix(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def term_hashes(terms: Mapping[str, str]) -> dict[str, list[int]]:
    """The hashes of the terms of every kind."""
    return {k: [B.hash_of(w) for w in dict.fromkeys(ws.lower().split())] for k, ws in terms.items()}


def word_features(column: pa.Array, identity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: the distinct slots of its words and beginnings, and its identity terms, of the sorted hashes ``identity``."""
    buf, at = B.texts(pc.utf8_lower(column))
    n = len(at) - 1
    slots, which, terms, term_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b, s, e, w in B.words(buf, at, _LETTERS):
        sums = B.prefix_sums(b)
        h = B.spans_hash(sums, s, e)
        slots.append(_slots(h, 1))
        which.append(w)
        known = np.isin(h, identity) if len(identity) else np.zeros(len(h), bool)
        for k in STARTS:
            longer = (e - s > k) & ~known  # the beginning of an identity term must not stand in for it
            slots.append(_slots(B.spans_hash(sums, s[longer], s[longer] + k), k))
            which.append(w[longer])
        terms.append(h[known])
        term_of.append(w[known])
    both = np.unique((np.concatenate(which) << BITS) | np.concatenate(slots))
    cut = np.searchsorted(both, np.arange(n + 1) << BITS)
    slots = both & ((1 << BITS) - 1)
    terms, term_of = np.concatenate(terms), np.concatenate(term_of)
    cut_terms = np.searchsorted(term_of, np.arange(n + 1))
    for i in range(n):
        yield slots[cut[i] : cut[i + 1]], np.unique(terms[cut_terms[i] : cut_terms[i + 1]])


def _slot(term: int) -> int:
    return int(_slots(np.array([term], np.uint64), 1)[0])


def counterfactuals(found: list[np.ndarray], kinds: Mapping[str, list[int]]) -> list[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """(slots that go, slots that come, weight) from the identity terms of every labelled text.

    Pairs that change the same slots are one entry.  Swaps weigh 1 together, and so do the neutral mentions.
    """
    place = {t: (k, i) for k, ts in kinds.items() for i, t in enumerate(ts)}
    slot = {t: _slot(t) for t in place}
    every = sorted(place)
    swaps: Counter = Counter()
    mentions: Counter = Counter()
    for n, terms in enumerate(found):
        turns = max((len(kinds[place[t][0]]) for t in terms.tolist()), default=1) - 1
        for turn in range(1, turns + 1):  # all terms of the text are swapped together
            gone = {slot[t] for t in terms.tolist()}
            came = {slot[kinds[place[t][0]][(place[t][1] + turn) % len(kinds[place[t][0]])]] for t in terms.tolist()}
            swaps[tuple(sorted(gone - came)), tuple(sorted(came - gone))] += 1 / turns
        if every:
            t = every[n % len(every)]
            k, i = place[t]
            mentions[(), (slot[t],)] += 0.5
            if len(kinds[k]) > 1:
                other = kinds[k][(i + 1 + n // len(every) % (len(kinds[k]) - 1)) % len(kinds[k])]
                mentions[(slot[t],), (slot[other],)] += 0.5
    return [(*key, w / sum(held.values())) for held in (swaps, mentions) for key, w in sorted(held.items())]


def fit(rows: list[tuple[int, float, np.ndarray]], pairs: list[tuple[tuple[int, ...], tuple[int, ...], float]], *, lasso: float = LASSO, ridge: float = RIDGE, penalty: float = PENALTY, rounds: int = 200, least: int = 3) -> np.ndarray:
    """Weights by slot, bias last, from (label, weight, slots) and the pairs of ``counterfactuals``.

    Slots whose pull at the start is below the L1 threshold are left out at first; those that the fit then pulls
    over it join, and the fit is made again, until no slot is left that could gain a weight.
    """
    dim = 1 << BITS
    out = np.zeros(dim + 1)
    if not rows:
        out[-1] = -40.0
        return out
    y, each = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    each = each / each.sum()
    share = float(each @ y)
    if share in (0.0, 1.0):
        out[-1] = 40.0 if share else -40.0
        return out
    at = np.concatenate([r[2] for r in rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    often = np.bincount(at, minlength=dim) >= least
    bar = lasso * (np.bincount(at, each[row], dim) + 1e-3) ** 0.25
    pull = np.bincount(at, (each * (share - y))[row], dim)
    inside = np.zeros(dim, bool)
    while (add := often & ~inside & (np.abs(pull) > bar * (1 + 1e-3))).any():
        inside |= add
        kept = np.flatnonzero(inside)
        w, b = _minimise(y, each, at, row, kept, pairs, share, lasso, ridge, penalty, rounds)
        out[:] = 0
        out[kept], out[-1] = w, b
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, out[at], len(rows)) + b, -500, 500)))
        pull = np.bincount(at, (each * (p - y))[row], dim)
        v = out[:-1]
        for gone, came, weight in pairs:
            change = v[list(came)].sum() - v[list(gone)].sum()
            pull[list(came)] += 2 * penalty * weight * change
            pull[list(gone)] -= 2 * penalty * weight * change
    if not inside.any():
        out[-1] = float(np.log(share / (1 - share)))
    return out


def _minimise(y: np.ndarray, each: np.ndarray, at: np.ndarray, row: np.ndarray, kept: np.ndarray, pairs: list, share: float, lasso: float, ridge: float, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of the slots ``kept``, and the bias."""
    n = len(y)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    sel = place[at] >= 0
    at, row = place[at[sel]], row[sel]
    # Differences of pairs: +1 where a slot comes, -1 where it goes.
    d = [(place[s], k, x) for k, (gone, came, _) in enumerate(pairs) for part, x in ((came, 1.0), (gone, -1.0)) for s in part if place[s] >= 0]
    d_at, d_row, d_x = (np.array([e[i] for e in d], t) for i, t in ((0, int), (1, int), (2, float)))
    weight = np.array([p[2] for p in pairs], float)
    # Slots are scaled by the root of their frequency, so that common and rare ones move alike.
    m = len(kept)
    scale = 1 / np.sqrt(np.bincount(at, each[row], m) + 1e-3)
    cost = lasso * scale**0.5

    def smooth(w: np.ndarray, b: float, slope: bool) -> tuple[float, np.ndarray, float]:
        """The differentiable part of the objective and, if asked for, its gradient."""
        v = scale * w
        z = np.bincount(row, v[at], n) + b
        value = float(each @ (np.logaddexp(0, z) - y * z)) + 0.5 * ridge * float(w @ w)
        change = np.bincount(d_row, d_x * v[d_at], len(pairs)) if len(d_at) else np.zeros(len(pairs))
        value += penalty * float(weight @ change**2)
        if not slope:
            return value, w, 0.0
        g = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = scale * np.bincount(at, g[row], m) + ridge * w
        if len(d_at):
            grad += 2 * penalty * scale * np.bincount(d_at, d_x * (weight * change)[d_row], m)
        return value, grad, float(g.sum())

    # Accelerated proximal steps; the step is halved until the quadratic bound holds, so they cannot diverge.
    w, b, t, step = np.zeros(m), float(np.log(share / (1 - share))), 1.0, 1.0
    z, bz, last = w, b, np.inf
    for _ in range(rounds):
        value, grad, slope = smooth(z, bz, True)
        while True:
            moved = z - step * grad
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * cost, 0)
            nb = bz - step * slope
            dw, db = new - z, nb - bz
            after = smooth(new, nb, False)[0]
            if after <= value + float(grad @ dw) + slope * db + (float(dw @ dw) + db * db) / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        whole = after + float(cost @ np.abs(new))
        if whole > last:  # momentum overshot: start it again from here
            t, z, bz = 1.0, w, b
            last = np.inf
            continue
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        done = last - whole < 1e-6
        w, b, t, last = new, nb, nt, whole
        if done:
            break
    z = np.bincount(row, (scale * w)[at], n)
    for _ in range(30):  # the intercept is not penalised, so it is brought to its optimum last
        q = 1 / (1 + np.exp(-np.clip(z + b, -500, 500)))
        b += float(np.clip(each @ (y - q) / max(float(each @ (q * (1 - q))), 1e-12), -2, 2))
    return scale * w, b


def _example(identity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.portions(batches, 0):
            found = list(word_features(batch.column(0), identity))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())), pa.array([t.view(np.int64) for _, t in found], pa.list_(pa.int64())), *batch.columns[1:]],
                ["at", "terms", "label", "weight"],
            )

    return run


def _score(weights, identity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in B.portions(batches, 1):
            z = np.array([w[s].sum() + w[-1] for s, _ in word_features(batch.column(1), identity)])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, terms: Mapping[str, str] = IDENTITY) -> np.ndarray:
    """Weights from docs (``__id``, ``__text``) and labels (``id``, ``label``)."""
    labels = labels.where("label is not null and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    rate = {k: min(1.0, per_class / n) for k, n in counts.items()}
    drawn = F.lit(False)
    weight = F.lit(1.0)
    for k, r in rate.items():
        drawn = drawn | ((F.col("label") == k) & (F.pmod(F.xxhash64("id"), F.lit(2**32)) < int(2**32 * r)))
        weight = F.when(F.col("label") == k, 1 / r).otherwise(weight)
    few = labels.where(drawn).withColumn("weight", weight)
    texts = docs.join(F.broadcast(few), docs["__id"] == few["id"]).select("__text", F.col("label").cast("int"), "weight").limit(4 * per_class)  # few: 2 * per_class rows
    kinds = term_hashes(terms)
    got = texts.mapInArrow(_example(_sorted(kinds)), "at array<int>, terms array<bigint>, label int, weight double").toArrow()
    if not len(got):
        return fit([], [])
    at = list(map(np.asarray, got["at"].to_numpy()))
    rows = list(zip(got["label"].to_pylist(), got["weight"].to_pylist(), at, strict=True))
    return fit(rows, counterfactuals([np.array(t, np.int64).view(np.uint64) for t in got["terms"].to_pylist()], kinds))


def _sorted(kinds: Mapping[str, list[int]]) -> np.ndarray:
    return np.array(sorted({t for ts in kinds.values() for t in ts}), np.uint64)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_id: str = "doc_id", label_col: str = "toxic", learn=None, per_class: int = PER_CLASS, threshold: float = THRESHOLD, terms: Mapping[str, str] = IDENTITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, *carry) of every row of ``df``.

    ``learn`` is a function from the id column to a condition: only labels of such ids are used.  ``terms`` are
    words that name groups, by kind; any of a kind may stand for any other.
    """
    no_clash(carry, "doc_id", "score", "predicted")
    docs = pick(df, id_col, text_col, *carry).toDF("__id", "__text", *carry)
    known = pick(labels, label_id, label_col).toDF("id", "label").where("label in (0, 1)")
    if learn is not None:
        known = known.where(learn(F.col("id")))
    w = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, known, per_class, terms))
    types = [f.dataType.simpleString() for f in docs.schema]
    schema = f"doc_id {types[0]}, score double" + "".join(f", `{c}` {t}" for c, t in zip(carry, types[2:], strict=True))
    scored = docs.mapInArrow(_score(w, _sorted(term_hashes(terms))), schema)
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"`{c}`") for c in carry))
