"""Score expressions: arithmetic over columns, translated to native columns. Nothing is ever evaluated as Python."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

_BINARY: dict[type, Callable] = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Pow: F.pow,
    ast.BitAnd: operator.and_,
    ast.BitOr: operator.or_,
}
_COMPARE: dict[type, Callable] = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def _positive(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Logarithms of 0 and less: NULL in any case, hence worst."""
    return lambda x: F.when(x > 0, f(x))


#: Functions an expression may call, with or without a leading "np." or "numpy.".
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "absolute": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": _positive(F.log),
    "log2": _positive(F.log2),
    "log10": _positive(F.log10),
    "log1p": F.log1p,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "arctan2": F.atan2,
    "hypot": F.hypot,
    "floor": F.floor,
    "ceil": F.ceil,
    "sign": F.signum,
    "square": lambda x: x * x,
    "power": F.pow,
    "deg2rad": F.radians,
    "rad2deg": F.degrees,
    "radians": F.radians,
    "degrees": F.degrees,
    "minimum": F.least,
    "maximum": F.greatest,
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "isnan": F.isnan,
}
_CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045, "inf": float("inf"), "nan": float("nan")}


def score_columns(expression: str, available: Sequence[str]) -> list[str]:
    """Columns an expression refers to, in the order they are available."""
    if expression in available:
        return [expression]
    named = set(_IDENTIFIER.findall(expression))
    return [c for c in available if c in named]


def score_expression(expression: str, number: Callable[[str], Column], available: Sequence[str]) -> Column:
    """``expression`` as a double column; ``number`` gives a column's value as double.

    Allowed: columns, numbers, + - * / // % **, comparisons, & | ~, and FUNCTIONS. Division by zero and logarithms of non-positive numbers
    give NULL. Anything else raises ValueError.
    """
    if expression in available:
        return number(expression)

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() as value):
                return F.lit(value) if isinstance(value, bool) else F.lit(float(value))
            case ast.Name(id=name) if name in available:
                return number(name)
            case ast.Attribute(value=ast.Name(id="np" | "numpy"), attr=name) if name in _CONSTANTS:
                return F.lit(_CONSTANTS[name])
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.UnaryOp(op=ast.Invert(), operand=x):
                return ~build(x)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(build(a), build(b))
            case ast.BinOp(left=a, op=ast.FloorDiv(), right=b):
                return F.floor(F.try_divide(build(a), build(b))).cast("double")
            case ast.BinOp(left=a, op=ast.Mod(), right=b):
                x, y = build(a), build(b)
                return x - y * F.floor(F.try_divide(x, y))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id=name) | ast.Attribute(value=ast.Name(id="np" | "numpy"), attr=name), args=args, keywords=[]) if name in FUNCTIONS:
                return FUNCTIONS[name](*map(build, args))
        raise ValueError(f"not allowed in a score expression: {ast.unparse(node)}")

    try:
        tree = ast.parse(expression, mode="eval")
    except SyntaxError as error:
        raise ValueError(f"{expression!r} is neither a column nor an expression") from error
    return build(tree.body).cast("double")
