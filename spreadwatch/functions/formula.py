"""The fair-value language: arithmetic over names, compiled to a Spark Column.

Only ``+ - * / **``, unary signs, numbers and names are allowed; anything else is refused when the
formula is read, before any data is touched. The compiled Column is ordinary Catalyst input, so
constants fold and the expression runs inside generated code. Text never reaches ``expr``.

Values are doubles by default. ``decimal=(precision, scale)`` computes ``+ - *`` in exact decimals.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """A formula that cannot be accepted."""


def parsed(text: str) -> ast.expr:
    """The syntax tree of a formula."""
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError) as exc:
        raise FormulaError(f"not a formula: {text!r}") from exc


def names_in(text: str) -> set[str]:
    """The names a formula uses; refuses whatever the language does not have."""
    found: set[str] = set()

    def visit(node: ast.expr) -> None:
        match node:
            case ast.BinOp(left, ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Pow(), right):
                visit(left)
                visit(right)
            case ast.UnaryOp(ast.UAdd() | ast.USub(), operand):
                visit(operand)
            case ast.Name(name):
                found.add(name)
            case ast.Constant(value) if type(value) in (int, float):
                pass
            case _:
                raise FormulaError(f"{type(node).__name__} is not allowed in {text!r}")

    visit(parsed(text))
    return found


def number(value: object) -> Decimal:
    """An exact decimal of an int, a float (by its shortest text) or a Decimal; nothing else."""
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
        raise FormulaError(f"not a number: {value!r}")
    return value if isinstance(value, Decimal) else Decimal(str(value))


def undeclared(text: str, declared: Iterable[str]) -> set[str]:
    """Names the formula uses that nothing declares."""
    return names_in(text) - set(declared)


def compile_formula(
    text: str,
    columns: Mapping[str, Column],
    params: Mapping[str, float] | None = None,
    decimal: tuple[int, int] | None = None,
) -> Column:
    """The formula over leg columns and constant params. Division by zero gives null."""
    params = params or {}
    if missing := undeclared(text, [*columns, *params]):
        raise FormulaError(f"undeclared names {sorted(missing)} in {text!r}")
    kind = "double" if decimal is None else f"decimal({decimal[0]},{decimal[1]})"

    def literal(value: object) -> Column:
        return F.lit(str(number(value))).cast(kind)

    def build(node: ast.expr) -> Column:
        match node:
            case ast.BinOp(left, ast.Add(), right):
                return build(left) + build(right)
            case ast.BinOp(left, ast.Sub(), right):
                return build(left) - build(right)
            case ast.BinOp(left, ast.Mult(), right):
                return build(left) * build(right)
            case ast.BinOp(left, ast.Div(), right):
                return F.try_divide(build(left), build(right))
            case ast.BinOp(left, ast.Pow(), right):
                return F.pow(build(left), build(right))
            case ast.UnaryOp(ast.USub(), operand):
                return -build(operand)
            case ast.UnaryOp(ast.UAdd(), operand):
                return build(operand)
            case ast.Name(name):
                return columns[name].cast(kind) if name in columns else literal(params[name])
            case ast.Constant(value):
                return literal(value)
        raise FormulaError(f"{type(node).__name__} is not allowed")

    return build(parsed(text))
