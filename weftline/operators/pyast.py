"""Symbols of Python files from the standard parser, one file at a time in Arrow batches."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.rows import unnest_fields

SCHEMA = ("array<struct<kind:string,name:string,line_start:int,line_end:int,params:string,return_type:string,docstring:string,"
          "is_async:boolean,complexity:bigint>>")
_DECISIONS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Match, ast.match_case, ast.BinOp, ast.IfExp)


def file_symbols(source: str) -> list[dict]:
    """Functions, methods, classes and imports; nothing for a file that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []

    def visit(node, in_class: bool):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                score = 1 + sum(isinstance(n, _DECISIONS) for n in ast.walk(child))
                out.append(_row(child, "Method" if in_class else "Function", child.name, ast.get_docstring(child), score,
                                ", ".join(a.arg for a in child.args.args), ast.unparse(child.returns) if child.returns else None))
            elif isinstance(child, ast.ClassDef):
                out.append(_row(child, "Class", child.name, ast.get_docstring(child), 1))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out.append(_row(child, "Import", ast.unparse(child), None, 1))
            visit(child, isinstance(child, ast.ClassDef))

    visit(tree, False)
    return out


def _row(node, kind, name, doc, score, params="", returns=None) -> dict:
    return {"kind": kind, "name": name, "line_start": node.lineno, "line_end": node.end_lineno, "params": params, "return_type": returns,
            "docstring": doc, "is_async": isinstance(node, ast.AsyncFunctionDef), "complexity": score}


def python_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    @F.pandas_udf(SCHEMA)
    def parse(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: file_symbols(s or ""))

    return unnest_fields(files, [key], parse(F.col(text)))
