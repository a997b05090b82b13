"""The display-filter language, compiled to Spark Columns that hold where the filter does.

A filter is a boolean expression of `not`, `and`, `or`, parentheses and atoms: PATH, PATH OP literal, PATH contains
"text", PATH in {literals}. A missing field or a literal of another type makes an atom false, `!=` included. Types are
known when compiling, so mismatches become a constant and the rest are plain comparisons that reach the scan. A missing
field leaves a null, which `where`, `when` and `count_if` take as false; under `not` it is made false first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the language.
MAX_SOURCE, MAX_TOKENS, MAX_DEPTH, MAX_SET = 2048, 512, 64, 128
UINT_LIMIT = 2**64
TOKEN = re.compile(r'(?P<op>==|!=|>=|<=|>|<)|(?P<mark>[(){},])|(?P<num>[0-9]+)|(?P<str>"(?:[^"\\]|\\["\\])*")|(?P<open>"(?:[^"\\]|\\["\\])*)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*)|(?P<bad>.)', re.S)
#: What counts as a blank.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
KEYWORDS = {"and", "or", "not", "in", "contains", "true", "false"}


@dataclass(frozen=True)
class Field:
    """The column that holds a path, and its kind: group, bool, uint or str (addresses are str)."""

    name: str
    kind: str

    @property
    def column(self) -> Column:
        return F.col(self.name)


class FilterError(ValueError):
    def __init__(self, message: str, token: str, position: int) -> None:
        super().__init__(f"{message}: {token!r} at {position}")
        self.message, self.token, self.position = message, token, position


def _units(text: str) -> int:
    """Positions count UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, position); a broken string or one token too many is a token of its own that fails when it is reached."""
    if _units(source) > MAX_SOURCE:
        raise FilterError("Source length limit exceeded", "<source>", 0)
    out, at, place = [], 0, 0
    while at < len(source):
        if source[at] in BLANK:
            at, place = at + 1, place + 1
            continue
        m = TOKEN.match(source, at)
        kind, text = m.lastgroup, m.group()
        if len(out) == MAX_TOKENS:
            out.append(("Token limit exceeded", "<token-limit>", place))
            break
        if kind == "open":
            stop = source[m.end() :]  # nothing, or a backslash before another character
            escaped = stop[1:2]
            where = place + _units(text) + len(stop[:1])
            out.append(("Invalid string escape", escaped or "<end>", where) if stop else ("Unterminated string", "<end>", where))
            break
        out.append((kind, text, place))
        at, place = m.end(), place + _units(text)
    return [*out, ("end", "<end>", _units(source))]


class _Compiler:
    def __init__(self, source: str, fields: dict[str, Field]) -> None:
        self.paths: list[tuple[str, int]] = []
        self.tokens, self.at, self.fields = _tokens(source), 0, {k.lower(): v for k, v in reversed(fields.items())}

    def fail(self, message: str = "Unexpected token") -> FilterError:
        kind, text, position = self.tokens[self.at]
        return FilterError(kind if " " in kind else message, text, position)

    def word(self) -> str:
        kind, text, _ = self.tokens[self.at]
        return text.lower() if kind == "word" else ""

    def take(self, text: str) -> bool:
        hit = self.word() == text or self.tokens[self.at][0] in ("op", "mark") and self.tokens[self.at][1] == text
        self.at += hit
        return hit

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail()

    def joined(self, depth: int) -> Column:
        out = self.both(depth)
        while self.take("or"):
            out = out | self.both(depth)
        return out

    def both(self, depth: int) -> Column:
        out = self.one(depth)
        while self.take("and"):
            out = out & self.one(depth)
        return out

    def one(self, depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise self.fail("Nesting limit exceeded")
        if self.take("not"):
            return ~F.coalesce(self.one(depth + 1), F.lit(False))
        if self.take("("):
            out = self.joined(depth + 1)
            self.need(")")
            return out
        return self.atom()

    def literal(self) -> int | str | bool:
        kind, text, position = self.tokens[self.at]
        if kind == "num":
            value: int | str | bool = min(int(text), UINT_LIMIT)
        elif kind == "str":
            value = re.sub(r"\\(.)", r"\1", text[1:-1])
        elif self.word() in ("true", "false"):
            value = self.word() == "true"
        else:
            raise self.fail()
        self.at += 1
        return value

    def atom(self) -> Column:
        path = self.word()
        if not path or path in KEYWORDS:
            raise self.fail()
        self.at += 1
        self.paths.append((path, self.tokens[self.at - 1][2]))
        field = self.fields.get(path)
        kind, op, _ = self.tokens[self.at]
        if kind == "op":
            self.at += 1
            return _compare(field, op, self.literal())
        if self.take("contains"):
            if self.tokens[self.at][0] != "str":
                raise self.fail()
            text = str(self.literal()).lower()
            return F.contains(F.lower(field.column), F.lit(text)) if field and field.kind == "str" else F.lit(False)
        if self.take("in"):
            self.need("{")
            values = [self.literal()]
            while self.take(","):
                if len(values) >= MAX_SET:
                    raise self.fail("Set size limit exceeded")
                values.append(self.literal())
            self.need("}")
            found = [_compare(field, "==", v) for v in values]
            out = F.lit(False)
            for f in found:
                out = out | f
            return out
        if field is None:
            return F.lit(False)
        return field.column if field.kind == "group" else field.column.isNotNull()


def _compare(field: Field | None, op: str, value: int | str | bool) -> Column:
    kind = "bool" if isinstance(value, bool) else "uint" if isinstance(value, int) else "str"
    if field is None or field.kind != kind or kind != "uint" and op not in ("==", "!="):
        return F.lit(False)
    left = F.lower(field.column) if kind == "str" else field.column
    right = F.lit(value.lower()) if isinstance(value, str) else F.lit(value) if value is True or value is False or value < 2**63 else F.lit(str(value)).cast("decimal(20,0)")
    ops = {"==": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}
    return ops[op]


def compile_filter(source: str, fields: dict[str, Field]) -> Column:
    """The Column of a filter; an empty filter matches all. Raises FilterError with message, token and position."""
    return _compiled(source, fields)[0]


def compile_for_series(source: str, fields: dict[str, Field]) -> Column:
    """As `compile_filter`, for counting: paths that only a viewer knows are refused."""
    out, paths = _compiled(source, fields)
    for path, position in paths:
        if path.startswith("connection."):
            raise FilterError("connection fields are not available in IO graph series", path, position)
        if path.endswith(".response_to"):
            raise FilterError("response_to depends on which packets were sent to the browser and cannot be counted", path, position)
    return out


def connection_fields(columns: dict[str, str]) -> dict[str, Field]:
    """The seven paths of a connection row; every other path is missing there. columns: the column of each name."""
    kinds = {"protocol": "str", "transport": "str", "local_addr": "str", "local_port": "uint", "remote_addr": "str", "remote_port": "uint", "process": "str"}
    return {f"connection.{k}": Field(columns.get(k, k), kind) for k, kind in kinds.items()}


def _compiled(source: str, fields: dict[str, Field]) -> tuple[Column, list[tuple[str, int]]]:
    if not source.strip(BLANK) and _units(source) <= MAX_SOURCE:
        return F.lit(True), []
    c = _Compiler(source, fields)
    out = c.joined(0)
    if c.tokens[c.at][0] != "end":
        raise c.fail()
    return out, c.paths
