"""Formulas and named algorithms as column expressions, so that any number of scenarios is computed in one projection."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """A formula or algorithm that cannot be turned into an expression."""


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Pow: lambda a, b: F.pow(a, b),
}


def names(formula: str) -> set[str]:
    return {n.id for n in ast.walk(_parsed(formula)) if isinstance(n, ast.Name)}


def _parsed(formula: str) -> ast.Expression:
    try:
        return ast.parse(formula, mode="eval")
    except SyntaxError as error:
        raise FormulaError(f"not a formula: {formula}") from error


def compiled(formula: str, values: Mapping[str, Column]) -> Column:
    """+, -, *, /, **, signs, numbers and the names in values; anything else is an error.  Division by zero gives null."""

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in values:
                raise FormulaError(f"undefined name {node.id}")
            return values[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = walk(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        raise FormulaError(f"not allowed: {ast.dump(node)[:60]}")

    return walk(_parsed(formula).body)


Algorithm = Callable[[Sequence[Column], Mapping], Column]
ALGORITHMS: dict[str, tuple[int, Algorithm]] = {}


def algorithm(name: str, least: int) -> Callable[[Algorithm], Algorithm]:
    """Registers a builder of an expression from `least` or more input columns."""

    def add(build: Algorithm) -> Algorithm:
        ALGORITHMS[name] = least, build
        return build

    return add


def execute(name: str, inputs: Sequence[Column], params: Mapping | None = None) -> Column:
    if name not in ALGORITHMS:
        raise FormulaError(f"unknown algorithm {name}")
    least, build = ALGORITHMS[name]
    if len(inputs) < least:
        raise FormulaError(f"{name} needs {least} inputs")
    return build(list(inputs), params or {})


def _product(inputs: Sequence[Column]) -> Column:
    out = inputs[0]
    for x in inputs[1:]:
        out = out * x
    return out


@algorithm("yield.cascade", 1)
def _cascade(inputs, params):
    inside = None
    for x in inputs:
        ok = (x >= 0) & (x <= 1)
        inside = ok if inside is None else inside & ok
    return F.when(inside, _product(inputs))


@algorithm("capacity.bottleneck", 1)
def _bottleneck(inputs, params):
    return F.least(*inputs) if len(inputs) > 1 else inputs[0]


@algorithm("production.saleable_output", 2)
def _saleable(inputs, params):
    return _product(inputs[:2])


@algorithm("production.oee_capacity", 4)
def _oee(inputs, params):
    return _product(inputs[:4])


@algorithm("finance.revenue", 2)
def _revenue(inputs, params):
    return _product(inputs[:2])


@algorithm("cost.variable_total", 2)
def _variable(inputs, params):
    return _product(inputs[:2])


@algorithm("cost.unit", 2)
def _unit(inputs, params):
    return F.try_divide(inputs[0], inputs[1])


@algorithm("finance.roi", 2)
def _roi(inputs, params):
    return F.try_divide(inputs[0], inputs[1])


@algorithm("finance.payback", 2)
def _payback(inputs, params):
    return F.when(inputs[1] > 0, inputs[0] / inputs[1])
