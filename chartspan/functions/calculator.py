"""Arithmetic for the calculator tool, by Python's own grammar without names or calls."""

from __future__ import annotations

import ast
import operator

_OPS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos,
}


def calculate(expression: str) -> str:
    """The result as text, whole numbers without a fraction; `Error: ...` where there is none. Powers stay small."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            a, b = value(node.left), value(node.right)
            if abs(b) <= 64 and abs(a) <= 1e6:
                return a**b
        raise ValueError("not arithmetic")

    try:
        result = value(ast.parse(expression.strip(), mode="eval").body)
    except ZeroDivisionError:
        return "Error: division by zero"
    except (ValueError, SyntaxError, OverflowError, TypeError) as e:
        return f"Error: {e}"
    return str(int(result)) if isinstance(result, float) and result.is_integer() else str(result)
