"""Python conditions over pairs, compiled to Columns.

The condition is parsed as Python; comparisons (chained ones too), boolean operators,
arithmetic, membership in literals, abs, len, str methods and the four match helpers
become Column expressions that Catalyst can push down.  Whatever else Python allows is
evaluated row by row in a UDF with the same names in scope, as is everything once start-up
code is given.  Conditions are code of the user: never take them from others.

regex_match and wildcard_match match the whole value.
"""

from __future__ import annotations

import ast
import fnmatch
import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotCompilable(Exception):
    """The condition needs Python."""


def csv_match(x, csv):
    return x in csv.split(",")


def wildcard_match(x, pattern):
    return re.fullmatch(fnmatch.translate(pattern), x) is not None


def regex_match(x, pattern):
    return re.fullmatch(pattern, x) is not None


def region_match(chrom, pos, region, start=-1, end=-1):
    return chrom == region and start <= pos and (end == -1 or pos <= end)


HELPERS = {f.__name__: f for f in (csv_match, wildcard_match, regex_match, region_match)}
# fixed values: what Java's and Python's patterns have in common
_SAME_REGEX = re.compile(r"(?:[\w\s!@#%&=:;,<>/\"'~`-]|\.|\*\??|\+\??|\?|\||\^|\$|\\[.*+?|()\[\]{}^$\\dwDW]|\[\^?[\w-]+\]|\((?:\?:|(?!\?))|\)|\{\d+(?:,\d*)?\})*", re.A)
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


def _java_wildcard(pattern: str) -> str:
    out = []
    for part in re.findall(r"\*|\?|\[[^\]]+\]|[^*?\[]+|\[", pattern):
        if part == "*":
            out.append("(?s:.*)")
        elif part == "?":
            out.append("(?s:.)")
        elif part[0] == "[" and len(part) > 1:
            out.append("[" + ("^" + part[2:-1] if part[1] == "!" else part[1:-1]).replace("\\", "\\\\") + "]")
        else:
            out.append(re.sub(r"([.^$|()\[\]{}+*?\\])", r"\\\1", part))
    return "".join(out)


class _Compiler:
    def __init__(self, kinds: dict[str, T.DataType]):
        self.kinds = kinds

    def visit(self, node: ast.AST):
        """A Column, or a Python value for constants."""
        method = getattr(self, type(node).__name__, None)
        if method is None:
            raise NotCompilable(type(node).__name__)
        return method(node)

    def column(self, node: ast.AST) -> Column:
        got = self.visit(node)
        return got if isinstance(got, Column) else F.lit(got)

    def boolean(self, node: ast.AST) -> Column:
        if not isinstance(node, (ast.BoolOp, ast.Compare)) and not (isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not)) and not (isinstance(node, ast.Call)) and not (isinstance(node, ast.Constant) and isinstance(node.value, bool)):
            raise NotCompilable("truth value of something that is not a condition")
        return self.column(node)

    def Name(self, node):  # noqa: N802
        if node.id not in self.kinds:
            raise NotCompilable(f"unknown name {node.id}")
        return F.col(f"`{node.id}`")

    def Constant(self, node):  # noqa: N802
        if not isinstance(node.value, (str, int, float, bool)):
            raise NotCompilable("constant")
        return node.value

    def BoolOp(self, node):  # noqa: N802
        op = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        return functools.reduce(op, map(self.boolean, node.values))

    def UnaryOp(self, node):  # noqa: N802
        if isinstance(node.op, ast.Not):
            return ~self.boolean(node.operand)
        if isinstance(node.op, ast.USub):
            return -self.visit(node.operand)
        raise NotCompilable("operator")

    def _is_text(self, node) -> bool | None:
        if isinstance(node, ast.Name) and node.id in self.kinds:
            return isinstance(self.kinds[node.id], T.StringType)
        if isinstance(node, ast.Constant):
            return isinstance(node.value, str)
        if isinstance(node, ast.Subscript):
            return True
        return False

    def Compare(self, node):  # noqa: N802
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    raise NotCompilable("membership in something that is not a literal")
                values = [self.visit(e) for e in right.elts]
                text = self._is_text(left)
                if any(isinstance(v, Column) for v in values) or any(isinstance(v, str) != text for v in values):
                    raise NotCompilable("mixed types")
                hit = self.column(left).isin(values)
                parts.append(~hit if isinstance(op, ast.NotIn) else hit)
            elif type(op) in _COMPARE:
                if self._is_text(left) != self._is_text(right):
                    raise NotCompilable("text compared with a number")
                parts.append(_COMPARE[type(op)](self.column(left), self.column(right)))
            else:
                raise NotCompilable("comparison")
            left = right
        return functools.reduce(operator.and_, parts)

    def BinOp(self, node):  # noqa: N802
        if self._is_text(node.left) or self._is_text(node.right):
            raise NotCompilable("text arithmetic")
        a, b = self.column(node.left), self.column(node.right)
        whole = lambda x: x.cast("long")
        if type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](whole(a) if self._whole(node.left) else a, whole(b) if self._whole(node.right) else b)
        if not self._whole(node.left) or not self._whole(node.right) or not isinstance(node.right, ast.Constant) or node.right.value <= 0:
            raise NotCompilable("division")
        if isinstance(node.op, ast.Mod):
            return F.pmod(whole(a), whole(b))
        if isinstance(node.op, ast.FloorDiv):
            return F.call_function("div", whole(a) - F.pmod(whole(a), whole(b)), whole(b))
        if isinstance(node.op, ast.Div):
            return a.cast("double") / b.cast("double")
        raise NotCompilable("operator")

    def _whole(self, node) -> bool:
        if isinstance(node, ast.Name):
            return isinstance(self.kinds.get(node.id), (T.IntegerType, T.LongType))
        if isinstance(node, ast.Constant):
            return isinstance(node.value, int)
        if isinstance(node, ast.BinOp):
            return not isinstance(node.op, ast.Div) and self._whole(node.left) and self._whole(node.right)
        if isinstance(node, ast.UnaryOp):
            return self._whole(node.operand)
        return isinstance(node, ast.Call)

    def Call(self, node):  # noqa: N802
        if node.keywords and not (isinstance(node.func, ast.Name) and node.func.id == "region_match"):
            raise NotCompilable("keywords")
        if isinstance(node.func, ast.Attribute):
            if node.func.attr in ("startswith", "endswith") and len(node.args) == 1 and self._is_text(node.func.value):
                text = self.visit(node.args[0])
                if isinstance(text, str):
                    return getattr(self.column(node.func.value), node.func.attr)(text)
            raise NotCompilable("method")
        if not isinstance(node.func, ast.Name):
            raise NotCompilable("call")
        name, args = node.func.id, [self.visit(a) for a in node.args]
        if name == "abs" and len(args) == 1 and not self._is_text(node.args[0]):
            return F.abs(args[0] if isinstance(args[0], Column) else F.lit(args[0]))
        if name == "len" and len(args) == 1 and self._is_text(node.args[0]):
            return F.length(self.column(node.args[0]))
        if name in ("csv_match", "wildcard_match", "regex_match"):
            if len(args) != 2 or not isinstance(args[0], Column) or not isinstance(args[1], str) or not self._is_text(node.args[0]):
                raise NotCompilable(name)
            if name == "csv_match":
                return args[0].isin(args[1].split(","))
            if name == "regex_match" and not _SAME_REGEX.fullmatch(args[1]):
                raise NotCompilable("pattern that Java may read differently")
            return args[0].rlike(r"\A(?:" + (args[1] if name == "regex_match" else _java_wildcard(args[1])) + r")\z")
        if name == "region_match":
            names = ["chrom", "pos", "region", "start", "end"]
            given = dict(zip(names, args)) | {k.arg: self.visit(k.value) for k in node.keywords}
            start, end = given.get("start", -1), given.get("end", -1)
            if isinstance(end, Column) or not {"chrom", "pos", "region"} <= given.keys():
                raise NotCompilable(name)
            out = (given["chrom"] == given["region"]) & (given["pos"] >= start)
            return out if end == -1 else out & (given["pos"] <= end)
        raise NotCompilable(name)


def compile_condition(condition: str, schema: T.StructType) -> Column:
    """The condition as a Column; NotCompilable if it needs Python."""
    tree = ast.parse(condition.strip(), mode="eval").body
    return _Compiler({f.name: f.dataType for f in schema}).boolean(tree)


def condition_column(df: DataFrame, condition: str, startup_code: str | None = None, type_cast: dict[str, str] | None = None) -> Column:
    """The condition over df as a boolean Column, natively where possible.

    type_cast: types that columns are read as inside the condition only."""
    casts = {"int": "int", "float": "double", "str": "string"}
    cast = {c: casts.get(t, t) for c, t in (type_cast or {}).items()}
    if not startup_code and not cast:
        try:
            return compile_condition(condition, df.schema)
        except NotCompilable:
            pass
    used = {n.id for n in ast.walk(ast.parse(condition.strip(), mode="eval")) if isinstance(n, ast.Name)}
    names = [c for c in df.columns if c in used]

    def run(*values):
        scope = dict(HELPERS)
        if startup_code:
            exec(startup_code, scope)  # noqa: S102
        scope.update(zip(names, values))
        if not code:
            code.append(compile(text, "<condition>", "eval"))
        return bool(eval(code[0], scope))  # noqa: S307

    text = condition.strip()
    code: list = []  # compiled once per Python worker

    args = [F.col(f"`{c}`").cast(cast[c]) if c in cast else F.col(f"`{c}`") for c in names] or [F.lit(0)]
    if not names:
        return F.udf(lambda _: run(), "boolean")(*args)
    return F.udf(run, "boolean")(*args)
