"""Small Arrow-batched helpers for formats Spark has no expression for."""

from __future__ import annotations

import ast
import json
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: math.fmod,
              ast.UAdd: operator.pos, ast.USub: operator.neg}
_FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log10, "abs": abs, "ceil": math.ceil, "floor": math.floor}
_NAMES = {"pi": math.pi, "e": math.e}


def evaluate(expression: str) -> float:
    """Arithmetic over numbers, + - * / ^ % and a fixed set of functions; anything else is refused."""

    def walk(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, ast.Name) and node.id in _NAMES:
            return _NAMES[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](walk(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1 and not node.keywords:
            return float(_FUNCTIONS[node.func.id](walk(node.args[0])))
        raise ValueError("not arithmetic")

    return walk(ast.parse(expression.strip().replace("^", "**"), mode="eval").body)


def shown(value: float) -> str:
    """Whole values below 1e10 without decimals, others with at most six."""
    if value == math.floor(value) and abs(value) < 1e10:
        return str(int(value))
    return f"{value:.6f}".rstrip("0").rstrip(".")


def calculate(expression: Column) -> Column:
    """Value of an arithmetic text, null when it is not one."""

    def one(text):
        try:
            return shown(evaluate(text))
        except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(expression)


def pretty(text: Column, indent: int) -> Column:
    """JSON re-printed with ``indent`` blanks per level; text that is not JSON stays."""

    def one(raw):
        try:
            return json.dumps(json.loads(raw), indent=indent, ensure_ascii=False)
        except (TypeError, ValueError):
            return raw

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)
