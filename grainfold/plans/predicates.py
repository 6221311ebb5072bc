"""Row filters from text, without evaluating code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<str>"[^"]*"|'[^']*')|(?P<op>==|!=|<=|>=|<|>|&|\||~|\(|\))|(?P<name>(?:ws\.)?[A-Za-z_]\w*))""")


def predicate(text: str, columns: list[str]) -> Column:
    """A filter such as `ws.valid == True & (ws.total_umis >= 500 | ~ws.doublet)`.

    Comparisons of columns, numbers, strings, True and False; &, |, ~ and the
    words and, or, not combine them. Anything else, or an unknown column, is an error.
    """
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read the filter at {text[at:]!r}")
        at = m.end()
        tokens.append((m.lastgroup, m[m.lastgroup]))
    known = {c.lower(): c for c in columns}
    pos = 0

    def peek() -> str | None:
        return tokens[pos][1] if pos < len(tokens) else None

    def take() -> tuple[str, str]:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"the filter ends too early: {text!r}")
        pos += 1
        return tokens[pos - 1]

    def value() -> Column:
        kind, t = take()
        if t == "(":
            inner = either()
            if take()[1] != ")":
                raise ValueError(f"unbalanced brackets in {text!r}")
            return inner
        if kind == "num":
            return F.lit(float(t) if re.search(r"[.eE]", t) else int(t))
        if kind == "str":
            return F.lit(t[1:-1])
        if kind == "name":
            if t in ("True", "False"):
                return F.lit(t == "True")
            c = t.removeprefix("ws.")
            if c.lower() not in known:
                raise ValueError(f"no column {c} for the filter {text!r}")
            return F.col(known[c.lower()])
        raise ValueError(f"unexpected {t!r} in {text!r}")

    def comparison() -> Column:
        left = value()
        op = peek()
        if op in ("==", "!=", "<=", ">=", "<", ">"):
            take()
            right = value()
            return {"==": left == right, "!=": left != right, "<=": left <= right, ">=": left >= right, "<": left < right, ">": left > right}[op]
        return left

    def negation() -> Column:
        if peek() in ("~", "not"):
            take()
            return ~negation()
        return comparison()

    def both() -> Column:
        out = negation()
        while peek() in ("&", "and"):
            take()
            out = out & negation()
        return out

    def either() -> Column:
        out = both()
        while peek() in ("|", "or"):
            take()
            out = out | both()
        return out

    if not tokens:
        raise ValueError("an empty filter")
    out = either()
    if pos != len(tokens):
        raise ValueError(f"unexpected {peek()!r} in {text!r}")
    return out
