"""Fair-value formulas in twice the precision of a double, as a column.

A value is an unevaluated sum of two doubles (about 31 digits); sums and products carry their
rounding errors along. What a formula then gives agrees with decimal arithmetic of 28 digits to the
last place of a double, also where large terms cancel. A formula is evaluated by numpy over Arrow
batches: each step is one pass over a batch, and nothing but the result goes back.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from spreadwatch.functions.formula import FormulaError, number, parsed, undeclared

#: An array or a constant, in two doubles.
Pair = tuple[np.ndarray | np.float64, np.ndarray | np.float64]
#: Cuts a double's 53 bits in halves whose products are exact.
SPLITTER = np.float64(134217729.0)
#: The largest whole exponent that is multiplied out.
MAX_POWER = 64
#: A decimal text of so many digits at most is the shortest of the double it reads as; places behind the point that are tried.
DIGITS, PLACES = 15, 9
ZERO, ONE = np.float64(0.0), np.float64(1.0)


def two_sum(a, b) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    part = s - a
    return s, (a - (s - part)) + (b - part)


def ordered_sum(a, b) -> Pair:
    """The same where b is small beside a."""
    s = a + b
    return s, b - (s - a)


def halves(a) -> Pair:
    t = a * SPLITTER
    high = t - (t - a)
    return high, a - high


def two_product(a, b) -> Pair:
    """a * b and its rounding error."""
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = ordered_sum(s, e + t)
    return ordered_sum(s, e + f)


def negative(x: Pair) -> Pair:
    return -x[0], -x[1]


def product(x: Pair, y: Pair) -> Pair:
    p, e = two_product(x[0], y[0])
    return ordered_sum(p, e + (x[0] * y[1] + x[1] * y[0]))


def quotient(x: Pair, y: Pair) -> Pair:
    """Long division in three digits of a double each; nan by zero."""
    by = np.where(y[0] == 0, np.nan, y[0])
    digits, rest = [], x
    for _ in range(3):
        digits.append(rest[0] / by)
        rest = add(rest, negative(product((digits[-1], ZERO), y)))
    return add(ordered_sum(digits[0], digits[1]), (digits[2], ZERO))


def power(x: Pair, n: int) -> Pair:
    out, square = (ONE, ZERO), x
    for bit in reversed(bin(abs(n))[2:]):
        if bit == "1":
            out = product(out, square)
        square = product(square, square)
    return out if n >= 0 else quotient((ONE, ZERO), out)


def whole(found: pa.Array) -> Pair:
    """Bigints, which may have more bits than a double."""
    n = found.fill_null(0).to_numpy(zero_copy_only=False)
    high = n.astype(np.float64)
    # the largest bigints round up to a double that no bigint holds
    over = high >= 2.0**63
    low = (n - np.where(over, 0.0, high).astype(np.int64)).astype(np.float64)
    low = np.where(over, (n - np.iinfo(np.int64).max) - 1.0, low)
    return np.where(found.is_null().to_numpy(zero_copy_only=False), np.nan, high), low


def shortest(found: pa.Array) -> Pair:
    """Doubles as their shortest decimal texts, where their size lies in 0.01 to 1e17, else as they are."""
    v = found.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    low = np.zeros(len(v))
    waiting = np.flatnonzero((np.abs(v) >= 0.01) & (np.abs(v) <= 1e17))
    for places in range(PLACES + 1):
        x, scale = v[waiting], np.float64(10.0**places)
        units = np.rint(x * scale)
        hit = (np.abs(units) < 10.0**DIGITS) & (units / scale == x)
        p, e = two_product(x[hit], scale)
        low[waiting[hit]] = ((units[hit] - p) - e) / scale
        waiting = waiting[~hit]
    with localcontext() as c:
        c.prec = 60
        low[waiting] = [float(Decimal(repr(x)) - Decimal(x)) for x in v[waiting].tolist()]
    return v, low


def exact_literal(value: object) -> tuple[float, float]:
    """A number as two doubles; a float stands for its shortest text."""
    exact = number(value)
    with localcontext() as c:
        c.prec = 60
        return float(exact), float(exact - Decimal(float(exact)))


def with_exact(df: DataFrame, name: str, text: str, columns: Mapping[str, str], params: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with double column ``name``, the formula over its columns and constant params.

    A double column stands for its shortest decimal text if its size lies in 0.01 to 1e17, else for
    its binary value; decimals (18 digits on either side of the point) and integers are exact. Whole
    constant exponents up to 64 are multiplied out; other powers have a double's precision. Null or
    nan gives null, as does division by zero or a result that is no finite number. A column
    ``name`` is replaced; others stay.
    """
    params = params or {}
    if missing := undeclared(text, [*columns, *params]):
        raise FormulaError(f"undeclared names {sorted(missing)} in {text!r}")
    tree = parsed(text)
    used = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id in columns})
    kinds = {of: df.schema[columns[of]].dataType for of in used}
    sizes = {of: min(kind.scale, 18) for of, kind in kinds.items() if isinstance(kind, DecimalType)}
    whole_ones = {of for of, kind in kinds.items() if isinstance(kind, IntegralType)}

    def given(of: str) -> list[Column]:
        """What a task needs of a column: itself, or a decimal's units and the digits behind its point."""
        value = F.col(f"`{columns[of]}`")
        if of in sizes:
            units = value.cast("bigint")
            return [units, ((value - units.cast("decimal(20,0)")).cast(f"decimal(38,{sizes[of]})") * F.lit(Decimal(10) ** sizes[of])).cast("bigint")]
        return [value.cast("bigint" if of in whole_ones else "double")]

    def literal(value: object) -> Pair:
        high, low = exact_literal(value)
        return np.float64(high), np.float64(low)

    def exponent(node: ast.expr) -> int | None:
        match node:
            case ast.UnaryOp(ast.USub(), operand):
                return None if (n := exponent(operand)) is None else -n
            case ast.Constant(value) if float(value).is_integer() and abs(value) <= MAX_POWER:
                return int(value)
            case ast.Name(p) if p in params and float(params[p]).is_integer() and abs(params[p]) <= MAX_POWER:
                return int(params[p])
        return None

    def build(node: ast.expr, known: Mapping[str, Pair]) -> Pair:
        match node:
            case ast.BinOp(left, ast.Add(), right):
                return add(build(left, known), build(right, known))
            case ast.BinOp(left, ast.Sub(), right):
                return add(build(left, known), negative(build(right, known)))
            case ast.BinOp(left, ast.Mult(), right):
                return product(build(left, known), build(right, known))
            case ast.BinOp(left, ast.Div(), right):
                return quotient(build(left, known), build(right, known))
            case ast.BinOp(left, ast.Pow(), right):
                if (n := exponent(right)) is not None:
                    return power(build(left, known), n)
                base, to = build(left, known), build(right, known)
                base, to = base[0] + base[1], to[0] + to[1]
                return np.where(np.isnan(base) | np.isnan(to), np.nan, np.power(base, to)), ZERO
            case ast.UnaryOp(ast.USub(), operand):
                return negative(build(operand, known))
            case ast.UnaryOp(ast.UAdd(), operand):
                return build(operand, known)
            case ast.Name(of) if of in columns:
                return known[of]
            case ast.Name(of):
                return literal(params[of])
            case ast.Constant(value):
                return literal(value)
        raise FormulaError(f"{type(node).__name__} is not allowed")

    # a formula that is not allowed fails here, not in a task
    with np.errstate(all="ignore"):
        build(tree, dict.fromkeys(used, (ONE, ZERO)))

    @F.arrow_udf("double")
    def evaluated(rows: pa.Array) -> pa.Array:
        parts, known = iter(rows.flatten()), {}
        with np.errstate(all="ignore"):
            for of in used:
                if of in sizes:
                    known[of] = add(whole(next(parts)), quotient(whole(next(parts)), (np.float64(10 ** sizes[of]), ZERO)))
                else:
                    known[of] = whole(next(parts)) if of in whole_ones else shortest(next(parts))
            high, low = build(tree, known)
            total = np.broadcast_to(np.asarray(high + low), len(rows))
            return pa.array(total, pa.float64(), mask=~np.isfinite(total))

    inputs = [c.alias(f"_{i}") for i, c in enumerate(c for of in used for c in given(of))]
    out = df.withColumn(name, evaluated(F.struct(*(inputs or [F.lit(0).alias("_0")]))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)
