"""The same scalar rules as ``numeric`` / ``text``, rendered as Spark SQL text.

A Column tree built node by node from Python costs one JVM round trip per
node; a wide feature projection has thousands of nodes. Operators that emit
many expressions render them as SQL text and hand the whole select list over
in one ``selectExpr`` call.
"""

from __future__ import annotations

INF = "CAST('Infinity' AS DOUBLE)"
NEG_INF = "CAST('-Infinity' AS DOUBLE)"
NULL_D = "CAST(NULL AS DOUBLE)"


def q(name: str) -> str:
    """Quote a column name."""
    return f"`{name}`"


def ieee(a: str, b: str) -> str:
    """a / b: NULL if either is NULL or both 0, +-inf if only b is 0."""
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN {NULL_D} "
            f"WHEN ({b}) = 0 THEN (CASE WHEN ({a}) = 0 THEN {NULL_D} WHEN ({a}) > 0 THEN {INF} ELSE {NEG_INF} END) "
            f"ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)")


def nan_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN {NULL_D} ELSE CAST({x} AS DOUBLE) END)"


def inf_null(x: str) -> str:
    return f"(CASE WHEN abs({x}) = {INF} THEN {NULL_D} ELSE {x} END)"


def zero_to_one(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1 ELSE {x} END)"


def window(partition: list[str], order: list[str] | None = None, frame: str | None = None) -> str:
    s = "PARTITION BY " + ", ".join(q(c) for c in partition)
    if order:
        s += " ORDER BY " + ", ".join(order)
    if frame:
        s += " " + frame
    return f"({s})"


def round_places(x: str, places: int) -> str:
    """Round on the binary value: round(x * 10^p) / 10^p. Spark's two-argument
    round works on the decimal text of a double and can differ at ties."""
    return f"(round(CAST(({x}) AS DOUBLE) * 1e{places}) / 1e{places})"


def fix_round(sql: str) -> str:
    """Rewrite every two-argument ``round(a, p)`` in ``sql`` to ``round_places``."""
    out, i, n = [], 0, len(sql)
    while i < n:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            break
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 6, None
        while k < n:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                last_comma = k
            k += 1
        inner = sql[j + 6:k]
        if last_comma is not None and sql[last_comma + 1:k].strip().isdigit():
            arg = fix_round(sql[j + 6:last_comma])
            out.append(sql[i:j] + round_places(arg, int(sql[last_comma + 1:k].strip())))
        else:
            out.append(sql[i:j] + "round(" + fix_round(inner) + ")")
        i = k + 1
    return "".join(out)
