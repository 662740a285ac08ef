"""Arithmetic texts and their values.

A text is split into numbers and signs by one regular expression, brought into reverse order by the
signs' precedence, and worked out; a batch of texts at a time.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F

#: Signs that stand for others (fixed values).
SAME = str.maketrans({**dict.fromkeys("×✕✖·＊", "*"), **dict.fromkeys("÷／", "/"), **dict.fromkeys("（【［[〔", "("), **dict.fromkeys("）】］]〕", ")"), "＋": "+", **dict.fromkeys("－−–—", "-"), "。": ".", "，": ","})
TOKEN = re.compile(r"\s*((?:[0-9][0-9,_]*(?:\.[0-9_]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[-+*/%^()√])")
#: Precedence, and whether a sign takes what stands to its right first. ``~`` is a sign before a number.
STRENGTH = {"+": (1, False), "-": (1, False), "*": (2, False), "/": (2, False), "%": (2, False), "~": (3, True), "p": (3, True), "√": (5, True), "^": (4, True)}
RESULT = "struct<value:double,text:string,error:string>"


def tokens_of(text: str) -> list[str]:
    text = re.sub(r"^=", "", text.translate(SAME).replace("**", "^").strip()).strip()
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError("not an expression")
            break
        token, before = m[1], out[-1] if out else "("
        value_before = before == ")" or before[0] in "0123456789."
        if token in "+-" and not value_before:
            token = "~" if token == "-" else "p"
        elif value_before and (token in "(√" or token[0] in "0123456789."):
            if token not in "(√" and before != ")":
                raise ValueError("two numbers without a sign between")
            out.append("*")
        out.append(token)
        at = m.end()
    return out


def apply_sign(sign: str, values: list[float]) -> None:
    if len(values) < 1 + (sign not in "~p√"):
        raise ValueError("a number is missing")
    b = values.pop()
    if sign == "~":
        values.append(-b)
    elif sign == "p":
        values.append(b)
    elif sign == "√":
        if b < 0:
            raise ValueError("root of a negative number")
        values.append(math.sqrt(b))
    else:
        a = values.pop()
        if sign in "/%" and b == 0:
            raise ValueError("division by zero")
        power = lambda: a**b if a >= 0 or b == int(b) else math.nan
        values.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": power}[sign]())


def value_of(text: str) -> float:
    values: list[float] = []
    signs: list[str] = []
    for token in tokens_of(text):
        if token[0] in "0123456789.":
            values.append(float(re.sub("[,_]", "", token)))
        elif token == "(":
            signs.append(token)
        elif token == ")":
            while signs and signs[-1] != "(":
                apply_sign(signs.pop(), values)
            if not signs:
                raise ValueError("a bracket is missing")
            signs.pop()
        else:
            own, right = STRENGTH[token]
            before = token in "~p√"  # what stands before a number waits for it
            while not before and signs and signs[-1] != "(" and (STRENGTH[signs[-1]][0] > own or STRENGTH[signs[-1]][0] == own and not right):
                apply_sign(signs.pop(), values)
            signs.append(token)
    while signs:
        if signs[-1] == "(":
            raise ValueError("a bracket is missing")
        apply_sign(signs.pop(), values)
    if len(values) != 1 or not math.isfinite(values[0]):
        raise ValueError("no finite value")
    return values[0]


def shown(value: float) -> str:
    """A whole number without a point, else ten places without zeros at the end."""
    whole = math.floor(abs(value) + 0.5)
    if abs(abs(value) - whole) < 1e-9 and abs(value) < 1e15:
        return str(int(math.copysign(whole, value)) if whole else 0)
    return f"{value:.10f}".rstrip("0").rstrip(".")


def one(text: str | None) -> tuple[float | None, str | None, str | None]:
    if text is None or not text.strip():
        return None, None, None
    try:
        value = value_of(text)
        return value, shown(value), None
    except (ValueError, OverflowError) as e:
        return None, None, str(e)


def calculate(text: Column) -> Column:
    """``struct<value,text,error>`` of arithmetic texts; all null for null and empty ones."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["value", "text", "error"])

    return run(text)
