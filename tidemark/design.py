"""Declared column roles, and the canonical frames that the engine works on."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import CapabilityError, StudyError
from .functions.expr import code_of, lit

MAX_LEVELS, MAX_CATEGORIES, MIN_ROWS, MIN_PER_ARM = 20, 50, 10, 2


@dataclass(frozen=True)
class PointDesign:
    """Roles of a point-treatment study.  Covariates default to every column without another role."""

    outcome: str
    treatment: str
    id: str
    covariates: tuple[str, ...] | None = None
    delta: str | None = None
    weights: str | None = None
    cluster: str | None = None
    intermediate: str | None = None
    strata: tuple[str, ...] = ()
    treatment_kind: str = "discrete"
    weights_type: str = "sampling"
    check_ids: bool = True
    """Counting different ids shuffles them all; a table whose key is known to be unique need not be asked."""

    def roles(self) -> list[str]:
        named = [self.outcome, self.treatment, self.id, self.delta, self.weights, self.cluster, self.intermediate]
        return [n for n in named if n]


@dataclass(frozen=True)
class PointFrame:
    """A frame with the columns id, y, a, delta, w, cluster, z, s and the design's covariates as doubles.

    ``a`` is the level's code, or the dose.  ``cells`` are the covariates as given, for saturated learners.
    """

    df: DataFrame
    levels: tuple
    x: tuple[str, ...]
    cells: tuple[str, ...]
    n: int
    family: str
    low: float
    high: float
    has_delta: bool = False
    has_cluster: bool = False
    has_intermediate: bool = False
    has_strata: bool = False
    weighted: bool = False
    effective_n: float = 0.0
    dose: bool = False
    notes: tuple[str, ...] = ()
    arm_counts: tuple[int, ...] = ()

    @property
    def arms(self) -> int:
        return len(self.levels)

    @property
    def span(self) -> float:
        return self.high - self.low

    def scaled(self) -> Column:
        """The outcome on [0, 1]; 0 where it was not observed."""
        return F.when(F.col("delta") == 1, (F.col("y") - lit(self.low)) / lit(self.span)).otherwise(lit(0))

    def to_frame(self) -> DataFrame:
        """The frame with labels again: id, y, the arm's level, and what the design declared."""
        level = F.col("a") if self.dose else F.element_at(F.array(*(F.lit(str(v)) for v in self.levels)), F.col("a") + 1)
        more = [c for c, there in (("delta", self.has_delta), ("w", self.weighted), ("cluster", self.has_cluster), ("z", self.has_intermediate), ("s", self.has_strata)) if there]
        return self.df.select("id", "y", level.alias("a"), *more, *self.x, *(c for c in self.cells if c not in self.x))

    def estimand_lines(self) -> list[str]:
        """What population the estimates speak of."""
        if not self.weighted:
            return [f"every one of the {self.n} rows counts alike"]
        return [f"rows are weighted to the population that the weights describe: {self.n} rows, effective size {self.effective_n:.1f}", "estimates are of that population, not of the sample"]

    def subset(self, condition: Column) -> PointFrame:
        """The rows that meet a condition over the canonical columns, with weights that sum to their number again."""
        kept = self.df.where(condition)
        r = kept.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") ** 2), *(F.sum(indicator_of(k)) for k in range(self.arms))).first()
        if r[0] < MIN_ROWS or (not self.dose and min(r[3:]) < MIN_PER_ARM):
            raise StudyError("too few rows are left, in all or in an arm")
        return replace(self, df=kept.withColumn("w", F.col("w") * lit(r[0] / r[1])), n=r[0], effective_n=r[1] ** 2 / r[2], arm_counts=tuple(int(v) for v in r[3:]))

    def with_treatment(self, code: Column) -> PointFrame:
        """The same rows with other arms, as codes of the same levels."""
        return replace(self, df=self.df.withColumn("a", code))

    def with_extra_covariate(self, name: str, values: Column) -> PointFrame:
        """One more covariate, for smooth and for saturated learners."""
        if f"x_{name}" in self.df.columns:
            raise StudyError(f"there is a covariate {name} already")
        return replace(self, df=self.df.withColumn(f"x_{name}", values.cast("double")), x=(*self.x, f"x_{name}"), cells=(*self.cells, f"x_{name}"))

    def without_covariates(self, *names: str) -> PointFrame:
        """Without these covariates, the indicators of labels included."""
        gone = lambda c: any(c in (f"x_{n}", f"c_{n}") or c.startswith(f"x_{n}__") for n in names)
        unknown = [n for n in names if not any(c in (f"x_{n}", f"c_{n}") or c.startswith(f"x_{n}__") for c in (*self.x, *self.cells))]
        if unknown:
            raise StudyError(f"no covariates {unknown}")
        return replace(self, x=tuple(c for c in self.x if not gone(c)), cells=tuple(c for c in self.cells if not gone(c)))

    def with_df(self, df: DataFrame) -> PointFrame:
        return replace(self, df=df)


def indicator_of(code: int) -> Column:
    """1 in this arm, else 0."""
    return F.when(F.col("a") == code, 1).otherwise(0)


def resolve_weight_kind(kind: str) -> str:
    """Sampling and inverse-probability weights are one kind; frequency weights are refused."""
    known = {"sampling": "sampling", "ipw": "sampling", "survey": "sampling", "importance": "importance"}
    if kind in ("frequency", "counts"):
        raise CapabilityError("frequency weights change n; repeat the rows instead")
    if kind not in known:
        raise StudyError(f"unknown kind of weights {kind!r}")
    return known[kind]


def levels_of(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> tuple:
    """The sorted distinct values of a label column; more than ``limit`` are refused without gathering them."""
    found = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    if any(v is None for v in found):
        raise StudyError(f"{column} has nulls")
    if len(found) > limit:
        raise StudyError(f"{column} has more than {limit} levels")
    return tuple(sorted(found))


def _is_numeric(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")


def encode_covariates(df: DataFrame, names: Sequence[str]) -> tuple[dict[str, Column], list[str]]:
    """Double columns by name: numbers and booleans as they are, labels as indicators of all levels but the first."""
    out: dict[str, Column] = {}
    for c in names:
        kind = df.schema[c].dataType.typeName()
        if _is_numeric(df, c) or kind == "boolean":
            out[c] = F.col(c).cast("double")
        elif kind == "string":
            for level in levels_of(df, c, MAX_CATEGORIES)[1:]:
                out[f"{c}__{level}"] = F.when(F.col(c) == level, lit(1)).otherwise(lit(0))
        else:
            raise StudyError(f"{c} has the type {kind}; derive a number or a label from it first")
    return out, list(out)


def point_frame(df: DataFrame, design: PointDesign, q_bounds: tuple[float, float] | None = None) -> PointFrame:
    """Resolve roles, validate them in one aggregate, and select the canonical columns."""
    resolve_weight_kind(design.weights_type)
    missing = [c for c in design.roles() + list(design.covariates or ()) + list(design.strata) if c not in df.columns]
    if missing:
        raise StudyError(f"no columns {missing}")
    claimed = set(design.roles())
    names = list(design.covariates) if design.covariates is not None else [c for c in df.columns if c not in claimed]
    if set(names) & (claimed - {design.cluster}):
        raise StudyError(f"covariates with another role: {sorted(set(names) & claimed)}")
    if not set(design.strata) <= set(names):
        raise StudyError("strata must be covariates too")
    dose = design.treatment_kind == "continuous"
    levels = () if dose else levels_of(df, design.treatment)
    if not dose and len(levels) < 2:
        raise StudyError(f"{design.treatment} has one level only")
    x, x_names = encode_covariates(df, names)
    one = lit(1)
    delta = F.col(design.delta).cast("double") if design.delta else one
    stratum = F.concat_ws("|", *(F.col(c).cast("string") for c in design.strata)) if design.strata else F.lit(None).cast("string")
    base = df.select(
        F.col(design.id).alias("id"),
        F.col(design.outcome).cast("double").alias("y"),
        (F.col(design.treatment).cast("double") if dose else code_of(F.col(design.treatment), levels)).alias("a"),
        delta.alias("delta"),
        (F.col(design.weights).cast("double") if design.weights else one).alias("w"),
        (F.col(design.cluster) if design.cluster else F.lit(None).cast("long")).alias("cluster"),
        (F.col(design.intermediate).cast("double") if design.intermediate else F.lit(None).cast("double")).alias("z"),
        stratum.alias("s"),
        *(v.alias(f"x_{k}") for k, v in x.items()),
        *(F.col(c).alias(f"c_{c}") for c in names if f"c_{c}" not in x),
    )
    bad = lambda c: F.sum(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0))
    seen = F.col("delta") == 1
    checks = [
        F.count("*").alias("n"),
        (F.count_distinct("id") if design.check_ids else F.count("id")).alias("ids"),
        F.sum(F.when(seen & (F.col("y").isNull() | F.isnan("y")), 1).otherwise(0)).alias("bad_y"),
        F.sum(F.when(F.col("delta").isin(0.0, 1.0), 0).otherwise(1)).alias("bad_delta"),
        F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("bad_a"),
        F.min(F.when(seen, F.col("y"))).alias("low"),
        F.max(F.when(seen, F.col("y"))).alias("high"),
        F.max(F.when(seen & ~F.col("y").isin(0.0, 1.0), 1).otherwise(0)).alias("graded"),
        F.sum("w").alias("sum_w"),
        F.sum(F.col("w") * F.col("w")).alias("sum_w2"),
        F.sum(F.when((F.col("w") < 0) | F.col("w").isNull() | F.isnan("w"), 1).otherwise(0)).alias("bad_w"),
        F.max(F.when(F.col("w") != F.floor("w"), 1).otherwise(0)).alias("fractional"),
        F.min("w").alias("min_w"),
    ]
    for k in x_names:
        checks += [bad(f"x_{k}").alias(f"bad_{k}"), F.min(f"x_{k}").alias(f"min_{k}"), F.max(f"x_{k}").alias(f"max_{k}")]
    if design.intermediate:
        checks.append(F.sum(F.when(F.col("z").isin(0.0, 1.0), 0).otherwise(1)).alias("bad_z"))
    if design.cluster:
        checks.append(F.sum(F.when(F.col("cluster").isNull(), 1).otherwise(0)).alias("bad_cluster"))
    if dose:
        checks.append(F.count_distinct("a").alias("doses"))
    checks += [F.sum(indicator_of(k)).alias(f"arm_{k}") for k in range(len(levels))]
    r = base.agg(*checks).first().asDict()
    n = r["n"]
    if n < MIN_ROWS:
        raise StudyError(f"{n} rows; at least {MIN_ROWS} are needed")
    if r["ids"] != n:
        raise StudyError(f"{design.id} is not unique, or null")
    for key in ("bad_y", "bad_delta", "bad_a", "bad_w", "bad_z", "bad_cluster"):
        if r.get(key):
            raise StudyError(f"{r[key]} invalid values of {key[4:]}")
    for k in x_names:
        if r[f"bad_{k}"]:
            raise StudyError(f"{k} has nulls or is not finite")
    if not r["sum_w"] > 0:
        raise StudyError("the weights sum to zero")
    rare = [str(v) for k, v in enumerate(levels) if r[f"arm_{k}"] < MIN_PER_ARM]
    if rare:
        raise StudyError(f"arms with fewer than {MIN_PER_ARM} rows: {rare}")
    if dose and r["doses"] < 2:
        raise StudyError("a dose needs at least two values")
    if r["low"] is None:
        raise StudyError("no outcome is observed")
    notes = []
    constant = [k for k in x_names if r[f"min_{k}"] == r[f"max_{k}"]]
    if constant:
        notes.append(f"constant covariates dropped: {constant}")
    if design.weights and not r["fractional"] and r["min_w"] >= 1 and r["sum_w"] / n >= 1.5:
        notes.append("the weights look like counts; they are read as sampling weights")
    effective = r["sum_w"] ** 2 / r["sum_w2"]
    if n / effective > 4:
        notes.append("the weights are concentrated: the design effect is over 4")
    if dose and r["doses"] < 10:
        notes.append("fewer than ten different doses")
    for note in notes:
        warnings.warn(note, stacklevel=2)
    family = "gaussian" if r["graded"] else "binomial"
    if family == "binomial":
        low, high = 0.0, 1.0
    elif q_bounds:
        low, high = q_bounds
    else:
        pad = 0.1 * (r["high"] - r["low"])
        low, high = r["low"] - pad, r["high"] + pad
    frame = base.withColumn("w", F.col("w") * lit(n / r["sum_w"])).withColumn("y", F.when(seen, F.col("y")))
    return PointFrame(
        frame, levels, tuple(f"x_{k}" for k in x_names if k not in constant), tuple(f"c_{c}" if f"c_{c}" in frame.columns else f"x_{c}" for c in names), n, family, low, high,
        bool(design.delta), bool(design.cluster), bool(design.intermediate), bool(design.strata), bool(design.weights), effective, dose, tuple(notes), tuple(int(r[f"arm_{k}"]) for k in range(len(levels))),
    )


def frame_from_arrays(spark, outcome: Sequence, treatment: Sequence, covariates, *, covariate_names: Sequence[str] | None = None, delta: Sequence | None = None, weights: Sequence | None = None, cluster: Sequence | None = None, weights_type: str = "sampling") -> PointFrame:
    """A point frame from arrays on the driver; ids are places."""
    import numpy as np
    import pandas as pd

    block = np.asarray(covariates, float)
    block = block[:, None] if block.ndim == 1 else block
    names = list(covariate_names or (f"w{i + 1}" for i in range(block.shape[1])))
    if len(names) != block.shape[1] or len(block) != len(outcome) or len(treatment) != len(outcome):
        raise StudyError("arrays of one length, and a name for each covariate, are needed")
    table = pd.DataFrame({"id": np.arange(len(outcome)), "y": np.asarray(outcome, float), "a": list(treatment), **{n: block[:, i] for i, n in enumerate(names)}})
    more = {"delta": delta, "weights": weights, "cluster": cluster}
    for name, values in more.items():
        if values is not None:
            table[name] = list(values)
    roles = {name: name for name, values in more.items() if values is not None}
    return point_frame(spark.createDataFrame(table), PointDesign("y", "a", "id", tuple(names), weights_type=weights_type, **roles))


def arm_fractions(frame: PointFrame) -> DataFrame:
    """(level, fraction): weighted share of each arm."""
    names = F.array(*(F.lit(str(v)) for v in frame.levels))
    sums = frame.df.groupBy("a").agg(F.sum("w").alias("s"))
    whole = frame.df.agg(F.sum("w").alias("t"))
    return sums.join(F.broadcast(whole)).select(F.element_at(names, F.col("a") + 1).alias("level"), (F.col("s") / F.col("t")).alias("fraction"))


def describe_weights(frame: PointFrame) -> dict[str, float]:
    """Effective size, variation, extremes and the share of the largest weights."""
    from .operators.order import order_statistics

    d = frame.df
    r = d.agg(
        F.count("*").alias("n"), F.sum("w").alias("s"), F.sum(F.col("w") ** 2).alias("s2"), F.stddev_pop("w").alias("sd"),
        F.min("w").alias("low"), F.max("w").alias("high"), F.sum(F.when(F.col("w") == 0, 1).otherwise(0)).alias("zeros"),
    ).first()
    out = {"n": r["n"], "effective_n": r["s"] ** 2 / r["s2"], "cv": r["sd"] / (r["s"] / r["n"]), "max_over_mean": r["high"] * r["n"] / r["s"], "zeros": r["zeros"]}
    tops = {share: -(-int(share * 1e6) * r["n"] // 10**6) for share in (0.01, 0.05)}
    edges = order_statistics(d, "w", [r["n"] - k for k in tops.values()], r["n"])
    for (share, k), edge in zip(tops.items(), edges, strict=True):
        over = d.agg(F.sum(F.when(F.col("w") > lit(edge), F.col("w")).otherwise(lit(0))), F.sum(F.when(F.col("w") > lit(edge), 1).otherwise(0))).first()
        out[f"top_{int(share * 100)}pct"] = (over[0] + (k - over[1]) * edge) / r["s"]
    return out


@dataclass(frozen=True)
class LongitudinalDesign:
    """Roles of a wide longitudinal frame, one entry per time.

    ``outcome`` is a column (the mean at the end), a sequence (an absorbing event by time) or a mapping from
    cause to a sequence (competing causes).  ``time_varying`` holds the covariates measured before each time
    after the first; censoring columns are 1 while the unit is still followed.
    """

    outcome: str | Sequence[str] | Mapping[str, Sequence[str]]
    treatment: tuple[str, ...]
    baseline: tuple[str, ...]
    id: str
    time_varying: tuple[tuple[str, ...], ...] = ()
    censoring: tuple[str, ...] = ()
    weights: str | None = None
    cluster: str | None = None

    @property
    def times(self) -> int:
        return len(self.treatment)

    @property
    def kind(self) -> str:
        return "mean" if isinstance(self.outcome, str) else "competing" if isinstance(self.outcome, Mapping) else "survival"

    @property
    def causes(self) -> tuple[str, ...]:
        return tuple(self.outcome) if self.kind == "competing" else ("",)


@dataclass(frozen=True)
class LongitudinalFrame:
    """Columns id, y, w, cluster, a_t, c_t, e_{cause}_t, and covariates; times count from 1."""

    df: DataFrame
    design: LongitudinalDesign
    n: int
    low: float = 0.0
    high: float = 1.0
    history: tuple[tuple[str, ...], ...] = field(default=())
    labels: tuple[tuple, ...] = field(default=())
    """For each time the labels of a treatment that is no number; the frame holds their codes."""

    def code(self, t: int, arm) -> float:
        """The number that stands for an arm at a time."""
        held = self.labels[t - 1] if self.labels else ()
        if not held:
            if isinstance(arm, str):
                raise StudyError(f"the treatment at time {t} has no labels: {arm!r}")
            return float(arm)
        if arm not in held:
            raise StudyError(f"no arm {arm!r} at time {t}; there are {list(held)}")
        return float(held.index(arm))

    def baseline_frame(self) -> DataFrame:
        """id and the baseline covariates."""
        return self.df.select("id", *(F.col(f"l_0_{c}").alias(c) for c in self.design.baseline))


def longitudinal_frame(df: DataFrame, d: LongitudinalDesign, q_bounds: tuple[float, float] | None = None) -> LongitudinalFrame:
    """Select the canonical columns and count every violation in one aggregate.

    Refused are followers after censoring, events that go away, more than one cause, and missing values among
    units that are still followed.
    """
    T = d.times
    cols = [F.col(d.id).alias("id"), (F.col(d.weights).cast("double") if d.weights else lit(1)).alias("w"), (F.col(d.cluster) if d.cluster else F.lit(None).cast("long")).alias("cluster")]
    cols += [F.col(c).cast("double").alias(f"l_0_{c}") for c in d.baseline]
    labels = []
    for t in range(1, T + 1):
        own = d.treatment[t - 1]
        labels.append(levels_of(df.where(F.col(own).isNotNull()), own) if df.schema[own].dataType.typeName() == "string" else ())
        cols.append((code_of(F.col(own), labels[-1]) if labels[-1] else F.col(own)).cast("double").alias(f"a_{t}"))
        cols.append((F.coalesce(F.col(d.censoring[t - 1]).cast("double"), lit(0)) if d.censoring else lit(1)).alias(f"c_{t}"))
        if t > 1 and len(d.time_varying) >= t - 1:
            cols += [F.col(c).cast("double").alias(f"l_{t - 1}_{c}") for c in d.time_varying[t - 2]]
    if d.kind == "mean":
        cols.append(F.col(d.outcome).cast("double").alias("y"))
    else:
        series = d.outcome if d.kind == "competing" else {"": d.outcome}
        for j, names in enumerate(series.values()):
            if len(names) != T:
                raise StudyError("one event column is needed for each time")
            cols += [F.coalesce(F.col(c).cast("double"), lit(0)).alias(f"e_{j}_{t}") for t, c in enumerate(names, 1)]
    base = df.select(*cols)
    causes = range(len(d.causes)) if d.kind != "mean" else ()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    checks = [F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("w").alias("sum_w"), count(F.col("w") < 0).alias("bad_w")]
    followed = F.lit(True)
    for t in range(1, T + 1):
        event_before = F.lit(False)
        for j in causes:
            if t > 1:
                event_before = event_before | (F.col(f"e_{j}_{t - 1}") == 1)
        here = followed & ~event_before
        checks.append(count(here & F.col(f"a_{t}").isNull()).alias(f"null_a_{t}"))
        checks.append(count(~followed & (F.col(f"c_{t}") == 1)).alias(f"censoring_{t}"))
        for c in (x for x in base.columns if x.startswith(f"l_{t - 1}_")):
            checks.append(count(here & F.col(c).isNull()).alias(f"null_{c}"))
        followed = followed & (F.col(f"c_{t}") == 1)
        if t > 1:
            for j in causes:
                checks.append(count(followed & (F.col(f"e_{j}_{t - 1}") == 1) & (F.col(f"e_{j}_{t}") == 0)).alias(f"event_{j}_{t}"))
        if len(d.causes) > 1:
            checks.append(count(sum(F.col(f"e_{j}_{t}") for j in causes) > 1).alias(f"causes_{t}"))
    if d.kind == "mean":
        checks += [count(followed & F.col("y").isNull()).alias("null_y"), F.min(F.when(followed, F.col("y"))).alias("low"), F.max(F.when(followed, F.col("y"))).alias("high"), F.max(F.when(followed & ~F.col("y").isin(0.0, 1.0), 1).otherwise(0)).alias("graded")]
    r = base.agg(*checks).first().asDict()
    if r["n"] < MIN_ROWS or r["ids"] != r["n"]:
        raise StudyError("too few rows, or the id is not unique")
    wrong = {k: v for k, v in r.items() if k not in ("n", "ids", "sum_w", "low", "high", "graded") and v}
    if wrong:
        raise StudyError(f"violations: {wrong}")
    low, high = 0.0, 1.0
    if d.kind == "mean" and r["graded"]:
        pad = 0.1 * (r["high"] - r["low"])
        low, high = q_bounds or (r["low"] - pad, r["high"] + pad)
    history = tuple(tuple(x for x in base.columns if x.startswith("l_") and int(x.split("_")[1]) < t) for t in range(1, T + 1))
    return LongitudinalFrame(base.withColumn("w", F.col("w") * lit(r["n"] / r["sum_w"])), d, r["n"], low, high, history, tuple(labels) if any(labels) else ())
