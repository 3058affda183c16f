"""Logit fits as check SQL: Newton steps in a recursive table, solved by elimination on lists. Independent of the engine's fits."""

from __future__ import annotations


def _inverse(matrix: str, q: int) -> str:
    """Gauss-Jordan over a list of rows of q + q numbers; a step's number rides along as a 1 x 1 matrix."""
    wide = f"list_transform({matrix}, lambda r, i: list_concat(r, list_transform(range({q}), lambda j: CASE WHEN j = i - 1 THEN 1.0::double ELSE 0.0::double END)))"
    steps = f"list_transform(range({q}), lambda k: [[k::double]])"
    k = "(k[1][1]::int + 1)"
    done = (f"list_reduce(list_prepend({wide}, {steps}), lambda m, k: list_transform(m, lambda r, i: list_transform(r, lambda v, j: "
            f"CASE WHEN i = {k} THEN v / m[{k}][{k}] ELSE v - r[{k}] * m[{k}][j] / m[{k}][{k}] END)))")
    return f"list_transform({done}, lambda r: r[{q} + 1 : 2 * {q}])"


def newton(name: str, rows: str, q: int, steps: int = 9, ridge: float = 0.0) -> str:
    """CTEs ending in ``name``(fit, b, inv, n): coefficients (intercept first) and covariance of every fit.

    ``rows`` is a SELECT of (fit, x, y): x a list of q numbers that starts with 1, y 0 or 1, complete rows only. A trace of 1e-10 on the
    diagonal lets features that others determine take the solution of least length; the covariance is corrected for it.
    """
    grad = "[" + ", ".join(f"sum(x[{i}] * (y - p)) - {ridge if i > 1 else 0.0} * any_value(b)[{i}]" for i in range(1, q + 1)) + "]"
    pair = {(i, j): f"sum(p * (1 - p) * x[{i}] * x[{j}]){f' + {ridge}' if ridge and i == j > 1 else ''}" for i in range(1, q + 1) for j in range(i, q + 1)}
    info = "[" + ", ".join("[" + ", ".join(f"h{min(i, j)}_{max(i, j)}" for j in range(1, q + 1)) + "]" for i in range(1, q + 1)) + "]"
    sums = ", ".join(f"{e} AS h{i}_{j}" for (i, j), e in pair.items())
    trace = " + ".join(f"h{i}_{i}" for i in range(1, q + 1))
    firm = "list_transform(info, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j THEN v + 1e-10 * trace ELSE v END))"
    product = "list_transform({a}, lambda r: list_transform({b}, lambda c: list_dot_product(r, c)))"
    return f"""{name}_x AS MATERIALIZED ({rows}),
 {name}_it AS (
  SELECT fit, 0 AS k, list_transform(range({q}), lambda i: 0.0::double) AS b, [[0.0::double]] AS inv, [[0.0::double]] AS info, 0::bigint AS n FROM {name}_x GROUP BY fit
  UNION ALL
  SELECT fit, k + 1, list_transform(b, lambda v, i: v + list_dot_product(inv[i], g)), inv, info, n
  FROM (SELECT fit, k, b, g, n, info, {_inverse(firm, q)} AS inv FROM (SELECT fit, k, b, g, n, {info} AS info, {trace} AS trace FROM (
   SELECT fit, any_value(k) AS k, any_value(b) AS b, count(*) AS n, {grad} AS g, {sums}
   FROM (SELECT t.fit, t.k, t.b, d.x, d.y, 1 / (1 + exp(-list_dot_product(d.x, t.b))) AS p FROM {name}_it t JOIN {name}_x d ON d.fit = t.fit WHERE t.k < {steps}) GROUP BY fit)))
 ),
 {name} AS (SELECT fit, b, {product.format(a=product.format(a='inv', b='info'), b='inv')} AS inv, n FROM {name}_it WHERE k = {steps})"""


def two_sided(z: str) -> str:
    """Normal tail by the continued fraction of erfc (Lentz, unrolled from the far end), good for |z| > 2.2, and by its series below."""
    x = f"(abs({z}) / sqrt(2))"
    series = f"(1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(60), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(greatest({x}, 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))))"
    tail = f"(exp(-{x} * {x}) / sqrt(pi()) / list_reduce(list_prepend({x}, list_transform(range(80), lambda k: (80 - k) / 2.0::double)), lambda a, k: {x} + k / a))"
    return f"CASE WHEN abs({z}) > 2.2 THEN {tail} ELSE {series} END"
