"""Several values packed in one field, split into one row a value with its position.

The values are read by a parsing expression grammar with ordered alternatives:

    Text   <- ws '[' Items ']' ws end / Items end
    Items  <- Sep* (Item (Sep+ Item)*)? Sep*
    Item   <- Quoted / Bare
    Quoted <- q (q q / '\\' any / !Close any)* Close       Close <- q &(ws (Sep / ']' / end))
    Bare   <- ('\\' (Sep / q / '\\') / '(' balanced ')' / !Sep any)+

An alternative that fails gives way to the next at the same place: an unclosed quote or
bracket is then ordinary text, and the value carries an error flag.
"""

from __future__ import annotations

import json
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate values; white space of any kind does too where values hold none.
MARKS = ",;|，；、｜"
BREAKS = "\n\r\t\v\f  "
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
ITEM = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("item_value", T.StringType()),
    T.StructField("malformed", T.BooleanType()),
])


class Grammar:
    """spaced: values may hold spaces, so a space alone separates none; else no value holds white space."""

    def __init__(self, spaced: bool) -> None:
        self.spaced = spaced
        mark = re.escape(MARKS)
        sep = rf"[{mark}{BREAKS}]" if spaced else rf"[{mark}\s]"
        self.seps = re.compile(rf"(?:\s*{sep})*\s*")
        self.plain = re.compile(rf"[^\\({mark}{BREAKS if spaced else chr(92) + 's'}]+")
        self.escape = re.compile(rf"\\([\\\"'{mark}{BREAKS}\[\]() ])")
        self.is_sep = re.compile(sep)
        self.quoted = {
            q: (re.compile(rf"(?:{re.escape(e)}{re.escape(e)}(?!\s*(?:{sep}|\]|\Z))|{re.escape(e)}{re.escape(e)}(?={re.escape(e)})|\\.|(?!{re.escape(e)}\s*(?:{sep}|\]\s*\Z|\Z)).)*", re.S), e)
            for q, e in _QUOTES.items()
        }

    def parse(self, text: str) -> list[tuple[str, bool]]:
        """Values in order with their error flags; empty pieces are left out."""
        text = text.strip()
        if len(text) > 1 and text[0] == "[" and text[-1] == "]":
            got = self._json(text) or self._items(text[1:-1].strip())
        else:
            got = self._items(text)
        if not self.spaced:  # what is quoted as a whole may itself be a list
            got = [(p, bad) for v, bad in got for p in (self._split(v) if self.is_sep.search(v) else [v])]
        return [(v, bad) for v, bad in ((v.strip(), bad) for v, bad in got) if v]

    def _split(self, text: str) -> list[str]:
        return [x for x in self.is_sep.split(text) if x]

    @staticmethod
    def _json(text: str) -> list[tuple[str, bool]] | None:
        try:
            got = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not all(isinstance(x, (str, int, float, type(None))) for x in got):
            return None
        return [(x if isinstance(x, str) else json.dumps(x), False) for x in got if x is not None]

    def _items(self, text: str) -> list[tuple[str, bool]]:
        at, end, out = 0, len(text), []
        dead: set[str] = set()
        while True:
            at = self.seps.match(text, at).end()
            if at >= end:
                return out
            q, bad = text[at], False
            if q in _QUOTES and q not in dead:
                body, close = self.quoted[q]
                stop = body.match(text, at + 1).end()
                if stop < end and text[stop] == close:
                    out.append((self._unquote(text[at + 1 : stop], close), False))
                    at = stop + 1
                    continue
                dead.add(q)  # no closing quote from here on
            bad = q in _QUOTES and q != "'"
            at, value, unclosed = self._bare(text, at)
            out.append((value, bad or unclosed))

    def _bare(self, text: str, at: int) -> tuple[int, str, bool]:
        parts, open_bracket, end = [], False, len(text)
        while at < end:
            m = self.plain.match(text, at) or self.escape.match(text, at)
            if m:
                parts.append(m[m.lastindex or 0])
                at = m.end()
            elif text[at] == "(":
                stop = None if open_bracket else self._balanced(text, at)
                open_bracket |= stop is None  # then no later one closes either
                parts.append(self.escape.sub(r"\1", text[at : stop or at + 1]))
                at = stop or at + 1
            elif text[at] == "\\":
                parts.append("\\")
                at += 1
            else:
                break
        return at, "".join(parts), open_bracket

    def _balanced(self, text: str, at: int) -> int | None:
        """End of the bracket at at; None if it does not close."""
        depth = 0
        for m in _BRACKETS.finditer(text, at):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if depth == 0:
                return m.end()
        return None

    @staticmethod
    def _unquote(body: str, close: str) -> str:
        body = body.replace(close * 2, close)
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: _ESCAPES.get(m[1]) or (chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), body, flags=re.S)


_BRACKETS = re.compile(r"\\.|[()]", re.S)
#: Escapes that stand for other characters.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


@cache
def grammar(spaced: bool) -> Grammar:
    return Grammar(spaced)


def split_values(text: Column, spaced: Column) -> Column:
    """array<struct<ordinal, item_value, malformed>> of the values in text; spaced as in Grammar.

    Null and blank texts give an empty array.
    """

    @F.pandas_udf(T.ArrayType(ITEM))
    def split(texts: pd.Series, spaces: pd.Series) -> pd.Series:
        return pd.Series([
            [{"ordinal": i, "item_value": v, "malformed": bad} for i, (v, bad) in enumerate(grammar(bool(s)).parse(t), 1)] if isinstance(t, str) else []
            for t, s in zip(texts, spaces, strict=True)
        ])

    return split(text, spaced)


def split_packed(df: DataFrame, key: str, fields: dict[str, bool], least: int = 1) -> DataFrame:
    """(key, field_name, ordinal, item_value, malformed): each value of the fields that hold least or more.

    fields: name -> whether its values may hold spaces. Ordinals count from 1 in the
    text's order; empty pieces have none; repeated values and repeated rows stay. Other
    columns of df do not matter. No rows are moved: each is split where it is read.
    """
    long = df.select(
        F.col(key),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.lit(spaced).alias("spaced"), F.col(f).cast("string").alias("text")) for f, spaced in fields.items()))).alias("x"),
    ).select(key, "x.*")
    some = long.where(F.col("text").rlike(r"(?U)\S"))
    if least > 1:  # two values need a separator between them
        some = some.where(F.trim("text").rlike(rf"(?U)[{re.escape(MARKS)}{BREAKS}]|\S\s+\S"))
    items = some.withColumn("items", split_values(F.col("text"), F.col("spaced")))
    return items.where(F.size("items") >= least).select(key, "field_name", F.inline("items"))
