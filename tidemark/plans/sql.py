"""SQL that says what the engine says, for another engine to run over the same tables.

The text is put together from chained common table expressions; each function adds the ones of one step.
"""

from __future__ import annotations

from collections.abc import Sequence

Z975 = 1.959963984540054

ORDERS = """d0 AS (
  SELECT o_orderkey AS id, o_totalprice / 1e3 AS y, o_orderpriority AS priority, c_mktsegment AS seg, o_custkey AS cl,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS a,
         CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS f,
         (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT) AS h
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def base(y: str = "y", a: str = "a", w: str = "1e0", delta: str = "1e0", z: str = "0e0", s: str = "''", folds: int = 0, seed: int = 0) -> str:
    draw = "h" if not seed else f"('0x' || substr(md5(CAST(id AS VARCHAR) || '/{seed}'), 1, 8))::BIGINT"
    return f"""{ORDERS},
d1 AS (SELECT id, {y} AS y, {a} AS a, seg, cl, CAST({delta} AS DOUBLE) AS delta, CAST({w} AS DOUBLE) AS w0, {z} AS z, {s} AS s, {f'{draw} % {folds}' if folds else '0'} AS fold FROM d0),
d AS (SELECT * EXCLUDE (w0), w0 * count(*) OVER () / sum(w0) OVER () AS w, count(*) OVER () AS n, sum(w0) OVER () * sum(w0) OVER () / sum(w0 * w0) OVER () AS neff FROM d1)"""


def _mean(value: str, cond: str, by: Sequence[str], folds: int) -> str:
    """Weighted mean of a value over rows that meet a condition, by keys; other folds only where there are folds."""
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}" if keys else ""
    num, den = (f"sum(CASE WHEN {cond} THEN w * ({value}) ELSE 0e0 END)", f"sum(CASE WHEN {cond} THEN w ELSE 0e0 END)")
    if not folds:
        return f"{num} OVER ({part}) / {den} OVER ({part})"
    own = "PARTITION BY " + ", ".join([*by, "fold"])
    return f"({num} OVER ({part}) - {num} OVER ({own})) / ({den} OVER ({part}) - {den} OVER ({own}))"


def nuisances(arms: int, *, cells: Sequence[str] = ("seg",), q_cells: Sequence[str] = (), folds: int = 0, delta: bool = False, z: int | None = None, low: str = "least(5e0 / (sqrt(neff) * ln(neff)), 0.49e0)") -> str:
    """Adds g_k (truncated), p_k = 1 / (g pi qz), q_k and qo to d: table u."""
    ks = range(arms)
    g = ", ".join(f"{_mean(f'CASE WHEN a = {k} THEN 1e0 ELSE 0e0 END', 'TRUE', cells, folds)} AS g{k}" for k in ks)
    pi = ", ".join(f"{_mean('delta', f'a = {k}', cells, folds)} AS pi{k}" for k in ks) if delta else ", ".join(f"1e0 AS pi{k}" for k in ks)
    qz = ", ".join(f"{_mean('z' if z else '1e0 - z', f'a = {k}', cells, folds)} AS qz{k}" for k in ks) if z is not None else ", ".join(f"1e0 AS qz{k}" for k in ks)
    zc = f" AND z = {z}" if z is not None else ""
    q = ", ".join(f"{_mean('y', f'a = {k} AND delta = 1{zc}', q_cells, folds)} AS q{k}" for k in ks)
    qo = "" if z is None else ", " + ", ".join(f"{_mean('y', f'a = {k} AND delta = 1 AND z = {1 - z}', q_cells, folds)} AS o{k}" for k in ks)
    if arms == 2:
        cut = f"1e0 - least(greatest(g1, {low}), 1e0 - {low}) AS b0, least(greatest(g1, {low}), 1e0 - {low}) AS b1"
    else:
        cut = ", ".join(f"least(greatest(g{k}, {low}), 1e0) AS b{k}" for k in ks)
    keep = "1e0" if z is None else f"CASE WHEN z = {z} THEN 1e0 ELSE 0e0 END"
    p = ", ".join(f"1e0 / (b{k} * greatest(pi{k}, 0.01e0) * greatest(qz{k}, 0.01e0)) AS p{k}" for k in ks)
    own = " ".join(f"WHEN {k} THEN {f'q{k}' if z is None else f'CASE WHEN z = {z} THEN q{k} ELSE o{k} END'}" for k in ks)
    return f"""u0 AS (SELECT *, {g}, {pi}, {qz}, {q}{qo} FROM d),
u1 AS (SELECT *, {cut}, CASE a {own} END AS qo, {keep} AS keep FROM u0),
u AS (SELECT *, {p} FROM u1)"""


def linear_means(arms: int) -> str:
    """Linear fluctuation of the arm means: tables e (epsilon) and t (s_k, so)."""
    ks = range(arms)
    eps = ", ".join(f"sum(CASE WHEN a = {k} AND delta = 1 THEN w * keep * p{k} * (y - qo) ELSE 0e0 END) / sum(CASE WHEN a = {k} AND delta = 1 THEN w * keep * p{k} * p{k} ELSE 0e0 END) AS e{k}" for k in ks)
    s = ", ".join(f"q{k} + e{k} * p{k} AS s{k}" for k in ks)
    own = " ".join(f"WHEN {k} THEN qo + e{k} * keep * p{k}" for k in ks)
    return f"""e AS (SELECT {eps} FROM u),
t AS (SELECT u.*, {s}, CASE a {own} END AS so FROM u, e)"""


def linear_means_by_fold(arms: int) -> str:
    return linear_means(arms).replace("e AS (SELECT ", "e AS (SELECT fold, ").replace(" FROM u),", " FROM u GROUP BY fold),").replace("FROM u, e)", "FROM u JOIN e USING (fold))")


def logistic_means(arms: int, steps: int = 7, weighted: bool = False) -> str:
    """Logistic fluctuation of the arm means by unrolled Newton steps; y and q must lie in [0, 1].

    Weighted, the covariate is one and its size is in the loss.
    """
    ks = range(arms)
    x = lambda k: "1e0" if weighted else f"p{k}"
    shrink = lambda x: f"least(greatest({x}, 0.0005e0), 0.9995e0)"
    out = ["v AS (SELECT * EXCLUDE (" + ", ".join([*(f"q{k}" for k in ks), "qo"]) + "), " + ", ".join([*(f"{shrink(f'q{k}')} AS q{k}" for k in ks), f"{shrink('qo')} AS qo"]) + " FROM u)"]
    out.append("e_0 AS (SELECT " + ", ".join(f"0e0 AS e{k}" for k in ks) + ")")
    for i in range(steps):
        pk = lambda k: shrink(f"1e0 / (1e0 + exp(-(ln(qo / (1e0 - qo)) + e{k} * {x(k)})))")
        one = lambda k: f"any_value(e{k}) + sum(CASE WHEN a = {k} AND delta = 1 THEN w * keep * p{k} * (y - {pk(k)}) ELSE 0e0 END) / sum(CASE WHEN a = {k} AND delta = 1 THEN w * keep * p{k} * {x(k)} * {pk(k)} * (1e0 - {pk(k)}) ELSE 0e0 END) AS e{k}"
        out.append(f"e_{i + 1} AS (SELECT " + ", ".join(one(k) for k in ks) + f" FROM v, e_{i})")
    s = ", ".join(f"{shrink(f'1e0 / (1e0 + exp(-(ln(q{k} / (1e0 - q{k})) + e{k} * {x(k)})))')} AS s{k}" for k in ks)
    own = " ".join(f"WHEN {k} THEN {shrink(f'1e0 / (1e0 + exp(-(ln(qo / (1e0 - qo)) + e{k} * keep * {x(k)})))')}" for k in ks)
    out.append(f"t AS (SELECT v.*, {s}, CASE a {own} END AS so FROM v, e_{steps})")
    return ",\n".join(out)


def curves(arms: int) -> str:
    """psi (m_k, my) and the curves d_k, dy: table c."""
    ks = range(arms)
    m = ", ".join(f"sum(w * s{k}) / sum(w) AS m{k}" for k in ks)
    d = ", ".join(f"w * (CASE WHEN a = {k} AND delta = 1 THEN keep * p{k} * (y - so) ELSE 0e0 END + s{k} - m{k}) AS d{k}" for k in ks)
    return f"""m AS (SELECT {m}, sum(w * y) / sum(w) AS my FROM t),
c AS (SELECT t.*, {', '.join(f'm{k}' for k in ks)}, my, {d}, w * (y - my) AS dy FROM t, m)"""


def report(rows: Sequence[tuple[str, str, str, str]], table: str = "c", cluster: bool = False, span: str = "1e0") -> str:
    """Final select: (name, psi, curve, scale) each become a row (estimand, psi, std_err, ci_lower, ci_upper, n)."""
    parts = []
    for name, psi, ic, scale in rows:
        if cluster:
            source = f"(SELECT sum({ic}) AS v, any_value({psi}) AS psi, count(*) AS k FROM {table} GROUP BY cl)"
            se, n = "sqrt(count(*) * var_samp(v)) / sum(k)", "sum(k)::BIGINT"
        else:
            source = f"(SELECT {ic} AS v, {psi} AS psi FROM {table})"
            se, n = "sqrt(var_samp(v) / count(*))", "count(*)::BIGINT"
        parts.append(f"SELECT '{name}' AS estimand, any_value(psi) AS psi, {se} AS se, {n} AS n, '{scale}' AS scale FROM {source}")
    body = " UNION ALL ".join(parts)
    lo, hi = (f"CASE WHEN scale = 'ratio' THEN exp(ln(psi) {s} {Z975} * se) ELSE psi {s} {Z975} * se END" for s in "-+")
    return f"SELECT estimand, round(psi, 6) AS psi, round(se, 6) AS std_err, round({lo}, 6) AS ci_lower, round({hi}, 6) AS ci_upper, n FROM ({body})"


def arm_rows(wanted: Sequence[str], names: Sequence[str] = ("0", "1"), ref: int = 0) -> list[tuple[str, str, str, str]]:
    """Rows of ``report`` for arm estimands over table c."""
    ks = [k for k in range(len(names)) if k != ref]
    pair = lambda stem, k: stem if len(names) == 2 else f"{stem}[{names[k]} vs {names[ref]}]"
    out = []
    for e in wanted:
        if e == "ey":
            out += [(f"ey[{v}]", f"m{k}", f"d{k}", "level") for k, v in enumerate(names)]
        elif e in ("ey1", "ey0"):
            out.append((e, f"m{e[2]}", f"d{e[2]}", "level"))
        elif e == "ate":
            out += [(pair(e, k), f"m{k} - m{ref}", f"d{k} - d{ref}", "difference") for k in ks]
        elif e == "ey_obs":
            out.append((e, "my", "dy", "level"))
        elif e == "par":
            out.append((e, f"my - m{ref}", f"dy - d{ref}", "difference"))
        elif e == "paf":
            out.append((e, f"1e0 - m{ref} / my", f"-d{ref} / my + m{ref} / (my * my) * dy", "fraction"))
        elif e == "rr":
            out += [(pair(e, k), f"m{k} / m{ref}", f"d{k} / m{k} - d{ref} / m{ref}", "ratio") for k in ks]
        elif e == "or":
            out += [(pair(e, k), f"(m{k} / (1e0 - m{k})) / (m{ref} / (1e0 - m{ref}))", f"d{k} / (m{k} * (1e0 - m{k})) - d{ref} / (m{ref} * (1e0 - m{ref}))", "ratio") for k in ks]
    return out


def query(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


# Two times of treatment: a plan is a pair of arms, read off a table v (w0, a1, c1, l2, a2, c2, y, fold, events).


def share(num: str, den: str, cells: Sequence[str], folds: int = 0) -> str:
    """Mean of an expression over the rows of a cell that meet a condition; other folds only where there are folds, and their margin where a cell has none."""
    n, d = f"sum(CASE WHEN {den} THEN {num} ELSE 0e0 END)", f"sum(CASE WHEN {den} THEN 1e0 ELSE 0e0 END)"

    def over(keys: Sequence[str]) -> str:
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        if not folds:
            return f"{n} OVER ({part}) / nullif({d} OVER ({part}), 0)"
        own = f"PARTITION BY {', '.join([*keys, 'fold'])}"
        return f"({n} OVER ({part}) - {n} OVER ({own})) / nullif({d} OVER ({part}) - {d} OVER ({own}), 0)"

    return f"coalesce({over(cells)}, {over(())})"


def plan_mechanism(tag: str, arms: tuple[int, int], absorbing: str = "FALSE", folds: int = 0) -> str:
    """Table m{tag}: cumulative mechanisms k1 and k2 of the plan, who follows it (f1, f2) and who is at risk at time 2 (r2)."""
    a, b = arms
    one = lambda c: f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END"
    two = ("w0", "coalesce(l2, 0)")
    return f"""m{tag}a AS (SELECT *, c1 AND NOT ({absorbing}) AS live FROM v),
m{tag}b AS (SELECT *, {share(one(f'a1 = {a}'), 'TRUE', ['w0'], folds)} AS g1, {share(one('c1'), f'a1 = {a}', ['w0'], folds)} AS h1,
  {share(one(f'a2 = {b}'), f'live AND a1 = {a}', two, folds)} AS g2, {share(one('c2'), f'live AND a1 = {a} AND a2 = {b}', two, folds)} AS h2 FROM m{tag}a),
m{tag} AS (SELECT *, least(greatest(g1 * h1, 0.01e0), 1e0) AS k1, least(greatest(g1 * h1 * g2 * h2, 0.01e0), 1e0) AS k2,
  a1 = {a} AND c1 AS f1, live AND a1 = {a} AND coalesce(a2 = {b}, FALSE) AND c2 AS f2, live AND a1 = {a} AS r2 FROM m{tag}b)"""


def plan_mean(tag: str, of: str, end: str, now1: str | None = None, stop1: str = "FALSE", *, horizon: int = 2, coarse: bool = False, folds: int = 0) -> str:
    """Table t{tag} (user_id, psi, ic and what the regressions left) by backward regressions with linear fluctuations."""
    cells = ((), ()) if coarse else (("w0",), ("w0", "coalesce(l2, 0)"))
    last = "CAST(NULL AS DOUBLE)" if horizon == 1 else end
    first = "s2" if now1 is None else f"CASE WHEN {now1} THEN 1e0 ELSE 0e0 END + CASE WHEN {stop1} THEN 0e0 ELSE 1e0 END * {'0e0' if horizon == 1 else 'coalesce(s2, 0.5e0)'}"
    return f"""n{tag} AS (SELECT *, CASE WHEN f2 THEN {last} END AS z2 FROM m{of}),
n{tag}r AS (SELECT *, {share('z2', 'f2', cells[1], folds)} AS q2 FROM n{tag}),
n{tag}e AS (SELECT sum(CASE WHEN f2 THEN (z2 - q2) / k2 END) / sum(CASE WHEN f2 THEN 1e0 / k2 END) AS e2 FROM n{tag}r),
o{tag} AS (SELECT n.*, e2, CASE WHEN r2 THEN q2 + e2 END AS s2 FROM n{tag}r n, n{tag}e),
o{tag}z AS (SELECT *, CASE WHEN f1 THEN {first} END AS z1 FROM o{tag}),
o{tag}r AS (SELECT *, {share('z1', 'f1', cells[0], folds)} AS q1 FROM o{tag}z),
o{tag}e AS (SELECT sum(CASE WHEN f1 THEN (z1 - q1) / k1 END) / sum(CASE WHEN f1 THEN 1e0 / k1 END) AS e1 FROM o{tag}r),
t{tag}s AS (SELECT o.*, e1, q1 + e1 AS s1 FROM o{tag}r o, o{tag}e),
t{tag} AS (SELECT *, avg(s1) OVER () AS psi, s1 - avg(s1) OVER () + coalesce((z1 - s1) / k1, 0e0) + coalesce((z2 - s2) / k2, 0e0) AS ic FROM t{tag}s)"""
