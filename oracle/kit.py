"""Text helpers for the DuckDB twins: rounding, tail integrals, least squares by sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from oracle.prelude import with_tables


def q(tables: str, body: str, floats: str = "", ctes: str = "") -> str:
    """One statement: table CTEs, own CTEs, and ``body`` with the named columns rounded.

    ``floats`` lists columns, 6 digits each unless written as ``name:digits``.
    """
    head = with_tables(*tables.split())
    if ctes:
        head += ",\n" + ctes
    head, body = cut_digits(head), cut_digits(body)
    if not floats:
        return f"{head}\n{body}"
    swaps = []
    for item in floats.split():
        name, _, digits = item.partition(":")
        d = int(digits or 6)
        swaps.append(f"round(round(CAST({name} AS DOUBLE), {d + 4}), {d}) + 0.0::DOUBLE AS {name}")
    return f"{head}\nSELECT * REPLACE ({', '.join(swaps)}) FROM (\n{body}\n)"


def sig(x: str) -> str:
    """Twin of ``stable``: 12 significant digits at any size."""
    scale = f"pow(10.0::DOUBLE, 11 - floor(log10(abs(nullif(CAST({x} AS DOUBLE), 0)))))"
    return f"coalesce(round(CAST({x} AS DOUBLE) * {scale}) / {scale}, CAST({x} AS DOUBLE))"


def cut_digits(sql: str) -> str:
    """Every ``round(x, 12)`` of a twin stands for ``sig(x)``."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6:end - 1]
        if inner.endswith(", 12"):
            new = sig(inner[:-4])
            sql = sql[:at] + new + sql[end:]
            at += new.index("round(") + 6 + len("CAST(")
        else:
            at += 6
    return sql


def gap(a: str, b: str) -> str:
    """Twin of ``gap``: zero where the operands agree in 12 digits."""
    return f"(CASE WHEN abs({a} - {b}) <= greatest(abs({a}), abs({b})) * 1e-12::DOUBLE THEN 0.0::DOUBLE ELSE {a} - {b} END)"


def _simpson(lower: str, upper: str, f: str, steps: int) -> str:
    """Simpson integral; ``f`` is written in terms of ``{u}``."""
    step = f"(({upper}) - ({lower})) / {steps}"
    point = f"(({lower}) + i * {step})"
    return (f"({step} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: "
            f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.format(u=point)}))))")


def t_p(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided p of Student's t: the cosine-power integral beyond atan(|t| / sqrt(df))."""
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"(2 * {scale} * {_simpson(f'atan(abs({t}) / sqrt({df}))', 'pi() / 2', f'pow(greatest(cos({{u}}), 0), {df} - 1)', steps)})"


def r_p(r: str, n: str, steps: int = 4000) -> str:
    """Two-sided p of a correlation."""
    inner = t_p("_t", "_f", steps).replace("_t)", f"({r} * sqrt(({n} - 2) / greatest(1 - {r} * {r}, 1e-300))))")
    return f"CASE WHEN {n} > 2 THEN {inner.replace('_f', f'({n} - 2.0)')} END"


def f_p(f: str, d1: str, d2: str, steps: int = 4000) -> str:
    """Upper tail of F as an integral of sine and cosine powers."""
    scale = f"2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
    end = f"asin(sqrt({d2} / ({d2} + {d1} * greatest({f}, 0.0))))"
    return f"({scale} * {_simpson('0.0', end, f'pow(sin({{u}}), {d2} - 1) * pow(greatest(cos({{u}}), 0), {d1} - 1)', steps)})"


def chi2_p(x: str, k: str, steps: int = 4000) -> str:
    """Upper tail of chi-square."""
    body = f"pow({{u}}, {k} - 1) * exp(-{{u}} * {{u}} / 2)"
    return f"(pow(2.0, 1 - {k} / 2.0) / exp(lgamma({k} / 2.0)) * {_simpson(f'sqrt({x})', f'sqrt({x}) + 14', body, steps)})"


def z_p(z: str, steps: int = 4000) -> str:
    """Upper tail of the standard normal."""
    tail = _simpson(f"abs({z})", f"abs({z}) + 14", "exp(-{u} * {u} / 2) / sqrt(2 * pi())", steps)
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def correlation(rows: str, x: str, y: str, by: str = "", min_n: int = 3, steps: int = 4000) -> str:
    """Twin of ``correlate``: n, Pearson and Spearman with p per group of ``rows``."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    def rank(v: str) -> str:
        return (f"rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}{v}) - 1) / 2.0")
    grouped = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}n, pearson_r, spearman_r, {r_p('pearson_r', 'n', steps)} AS pearson_p, {r_p('spearman_r', 'n', steps)} AS spearman_p FROM (
      SELECT {keys}count(*) AS n, CASE WHEN count(*) >= {min_n} THEN {corr('_x', '_y')} END AS pearson_r,
        CASE WHEN count(*) >= {min_n} THEN {corr('_rx', '_ry')} END AS spearman_r
      FROM (SELECT {keys}_x, _y, {rank('_sx')} AS _rx, {rank('_sy')} AS _ry FROM (
        SELECT {keys}CAST({x} AS DOUBLE) AS _x, CAST({y} AS DOUBLE) AS _y, round(CAST({x} AS DOUBLE), 12) AS _sx, round(CAST({y} AS DOUBLE), 12) AS _sy
        FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)) {grouped})"""


def corr(x: str, y: str) -> str:
    return f"regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0)"


def ols(name: str, rows: str, y: str, features: Sequence[str], by: str = "") -> str:
    """CTEs ``{name}_fit`` (one row per feature) from a sweep of the covariance matrix.

    ``rows`` may hold missing values; incomplete rows are left out. ``{name}_fit`` has the
    columns of the fit with p-values, and ``g`` for the group.
    """
    k, names = len(features), [*features, y]
    g = by or "''"
    whole = " AND ".join(f"{c} IS NOT NULL" for c in names)
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': covar_samp({a}, {b})}}" for i, a in enumerate(names) for j, b in enumerate(names))
    means = ", ".join(f"avg({c})" for c in names)
    typed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names)
    parts = [
        f"{name}_rows AS MATERIALIZED (SELECT {g} AS g, {typed} FROM {rows} WHERE {whole})",
        f"{name}_stat AS MATERIALIZED (SELECT g, count(*) AS n, [{means}] AS m FROM {name}_rows GROUP BY g)",
        f"{name}_s0 AS MATERIALIZED (SELECT g, c.i AS i, c.j AS j, c.v AS v FROM (SELECT g, unnest([{cells}]) AS c FROM {name}_rows GROUP BY g))",
    ]
    for p in range(k):
        a = f"{name}_s{p}"
        parts.append(f"""{name}_s{p + 1} AS MATERIALIZED (SELECT a.g, a.i, a.j, CASE WHEN a.i = {p} AND a.j = {p} THEN -1 / d.v
          WHEN a.i = {p} OR a.j = {p} THEN a.v / d.v ELSE a.v - r.v * c.v / d.v END AS v FROM {a} a
          JOIN {a} d ON d.g = a.g AND d.i = {p} AND d.j = {p} JOIN {a} r ON r.g = a.g AND r.i = a.i AND r.j = {p}
          JOIN {a} c ON c.g = a.g AND c.i = {p} AND c.j = a.j)""")
    last = f"{name}_s{k}"
    labels = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    parts.append(f"""{name}_model AS MATERIALIZED (SELECT s.g, s.n, {k} AS k, s.m, e.v * (s.n - 1) AS ss_res, t.v * (s.n - 1) AS ss_tot, t.v AS vy,
        1 - e.v / t.v AS r_squared, 1 - (e.v / t.v) * (s.n - 1) / (s.n - {k} - 1) AS adj_r_squared, e.v * (s.n - 1) / (s.n - {k} - 1) AS mse
        FROM {name}_stat s JOIN {last} e ON e.g = s.g AND e.i = {k} AND e.j = {k} JOIN {name}_s0 t ON t.g = s.g AND t.i = {k} AND t.j = {k})""")
    parts.append(f"""{name}_fit AS MATERIALIZED (SELECT *, coefficient / std_error AS t_value,
        {t_p('(coefficient / std_error)', '(n - k - 1.0)')} AS p_value FROM (
        SELECT o.g, {labels}[b.i + 1] AS feature, b.v AS coefficient, sqrt(o.mse * -v.v / (o.n - 1)) AS std_error,
          b.v * sqrt(x.v / o.vy) AS beta_weight, -v.v * x.v AS vif, r_squared, adj_r_squared, ss_res, n, k
        FROM {name}_model o JOIN {last} b ON b.g = o.g AND b.j = {k} AND b.i < {k} JOIN {last} v ON v.g = o.g AND v.i = b.i AND v.j = b.i
          JOIN {name}_s0 x ON x.g = o.g AND x.i = b.i AND x.j = b.i
        UNION ALL
        SELECT o.g, 'intercept', o.m[{k + 1}] - (SELECT sum(b.v * o.m[b.i + 1]) FROM {last} b WHERE b.g = o.g AND b.j = {k} AND b.i < {k}),
          sqrt(o.mse * (1.0 / o.n + (SELECT sum(-v.v * o.m[v.i + 1] * o.m[v.j + 1]) FROM {last} v WHERE v.g = o.g AND v.i < {k} AND v.j < {k}) / (o.n - 1))),
          NULL, NULL, r_squared, adj_r_squared, ss_res, n, k FROM {name}_model o))""")
    return ",\n".join(parts)


def nested(base: str, full: str) -> str:
    """Twin of ``nested_f`` over two ``ols`` blocks."""
    return f"""SELECT g, f_stat, {f_p('f_stat', 'k_diff', '(n - kf - 1.0)')} AS f_p, k_diff, n, r_squared_base, r_squared_full FROM (
      SELECT b.g, ((b.ss_res - f.ss_res) / (f.k - b.k)) / (f.ss_res / (f.n - f.k - 1)) AS f_stat, f.k - b.k AS k_diff, f.n, f.k AS kf,
        b.r_squared AS r_squared_base, f.r_squared AS r_squared_full FROM {base}_model b JOIN {full}_model f ON f.g = b.g)"""


FIT = "feature, coefficient, std_error, t_value, p_value, beta_weight, r_squared, adj_r_squared, n, k"
FIT_FLOATS = "coefficient std_error t_value p_value beta_weight r_squared adj_r_squared"
CORR_FLOATS = "pearson_r pearson_p spearman_r spearman_p"
