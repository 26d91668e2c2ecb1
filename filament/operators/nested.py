"""Deeply nested JSON records as flat, related tables.

A first pass infers one merged schema from all records: which paths hold objects, arrays of
objects or plain values anywhere. A second pass writes every record in that shape (names in
snake case, JSON texts read, lone objects in place of arrays wrapped), and each array level is
exploded into a child table that carries its parent's surrogate key and its ordinal.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filament.runtime import persisted

#: Paths a merged schema may have; beyond, objects with many different names are kept as JSON text,
#: those with more than MAX_NAMES first.
MAX_PATHS, MAX_NAMES = 20_000, 1_000
#: Levels of members a merged schema may have; what lies deeper is kept as JSON text.
MAX_DEPTH = 100
#: Where an object stands at a path at which others have a plain value, the value goes here; so
#: does the text of an object with too many names.
PLAIN = "plain_value"

_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


_BLANKS = re.compile(r"[ \t\n\r]*")
_MAY_BE_JSON = re.compile(r'\s*[\[{"]')


def parse(text: str) -> Any:
    """json.loads, however deep the text is nested."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    scan = json.JSONDecoder().raw_decode
    skip = lambda at: _BLANKS.match(text, at).end()
    holders: list[list | dict] = []
    names: list[str | None] = []

    def member(at: int) -> int:
        if text[at : at + 1] != '"':
            raise json.JSONDecodeError("Expecting a member", text, at)
        names[-1], at = scan(text, at)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise json.JSONDecodeError("Expecting ':'", text, at)
        return skip(at + 1)

    at = skip(0)
    while True:
        sign = text[at : at + 1]
        if sign in ("[", "{"):
            value: Any = [] if sign == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if sign == "[" else "}"):
                holders.append(value)
                names.append(None)
                at = at if sign == "[" else member(at)
                continue
            at += 1
        else:
            value, at = scan(text, at)
        # a value has ended: it goes to its holder, and so does each holder that ends with it
        while True:
            at = skip(at)
            if not holders:
                if at < len(text):
                    raise json.JSONDecodeError("Extra data", text, at)
                return value
            holder, sign = holders[-1], text[at : at + 1]
            is_list = isinstance(holder, list)
            if is_list:
                holder.append(value)
            else:
                holder[names[-1]] = value
            if sign == ",":
                at = skip(at + 1)
                at = at if is_list else member(at)
                break
            if sign != ("]" if is_list else "}"):
                raise json.JSONDecodeError("Expecting ',' or an end", text, at)
            at += 1
            value = holders.pop()
            names.pop()


def write(v: Any) -> str:
    """json.dumps with sorted members, however deep the value is nested."""
    try:
        return json.dumps(v, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, v)]
    while todo:
        is_text, x = todo.pop()
        if is_text:
            out.append(x)
        elif isinstance(x, (dict, list)) and x:
            pairs = [(json.dumps(k, ensure_ascii=False) + ": ", x[k]) for k in sorted(x)] if isinstance(x, dict) else [("", y) for y in x]
            out.append("{" if isinstance(x, dict) else "[")
            todo.append((True, "}" if isinstance(x, dict) else "]"))
            for i in range(len(pairs) - 1, -1, -1):
                todo += [(False, pairs[i][1]), (True, (", " if i else "") + pairs[i][0])]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


@functools.lru_cache(1 << 16)
def snake(name: str) -> str:
    return _HUMP.sub("_", name).lower()


def read_value(v: Any) -> Any:
    """A JSON text as what it says, if that is an object or array; else the value itself."""
    for _ in range(8):
        if not isinstance(v, str) or not _MAY_BE_JSON.match(v):
            return v
        t = v.strip()
        try:
            got = parse(t)
        except ValueError:
            return v
        if isinstance(got, str) and got == v:
            return v
        if not isinstance(got, (dict, list, str)):
            return v
        v = got
    return v


def members(obj: dict, names: Container[str] | None = None) -> dict[str, Any]:
    """An object's members by snake-case name, or those of names; of two spellings of a name the one that is not null or empty holds."""
    out: dict[str, Any] = {}
    for k, v in obj.items():
        name = snake(k)
        if names is not None and name not in names:
            continue
        if name not in out or out[name] in (None, "", [], {}):
            out[name] = read_value(v)
    return out


def read_record(payload: str | None) -> dict | None:
    """The record of a payload; None if it is no JSON object."""
    if not isinstance(payload, str):
        return None
    try:
        got = parse(payload)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _unescape(name: str) -> str:
    return name.replace("~1", "/").replace("~0", "~")


def _wanted(child_paths: list[str], only: list[str]) -> dict[str, Any]:
    """The paths as a tree of names; below the end of an only path everything is wanted, which is None there."""
    root: dict[str, Any] = {}
    for path in [*child_paths, *only]:
        node, parts = root, path.split("/")
        for i, part in enumerate(parts):
            if path in only and i == len(parts) - 1:
                node[part] = None
            node = node.setdefault(part, {})
            if node is None:
                break
    return root


def _walk(obj: dict, path: str, found: set[tuple[str, str]], levels: int, wanted: dict[str, Any] | None) -> dict[str, Any]:
    """Add an object's paths with their kinds to found; the object with only the members that are wanted."""
    out: dict[str, Any] = {}
    for name, v in members(obj, wanted).items():
        key = f"{path}/{_escape(name)}"
        out[name] = v
        if levels <= 1:
            found.add((key, "empty" if v is None or v == "" else "plain"))
            continue
        below = None if wanted is None else wanted[name]
        if isinstance(v, list):
            items = out[name] = [read_value(x) for x in v]
            kind = "list"
            for i, x in enumerate(items):
                if isinstance(x, dict):
                    kind = "children"
                    items[i] = _walk(x, key, found, levels - 1, below)
            found.add((key, kind))
        elif isinstance(v, dict):
            found.add((key, "object"))
            out[name] = _walk(v, key, found, levels - 1, below)
        else:
            found.add((key, "empty" if v is None or v == "" else "plain"))
    return out


@dataclass
class Node:
    """A path of the merged schema: kinds seen there, and the members of its objects."""

    kinds: set[str] = field(default_factory=set)
    below: dict[str, Node] = field(default_factory=dict)

    @property
    def many(self) -> bool:
        return "children" in self.kinds

    @property
    def wide(self) -> bool:
        return "wide" in self.kinds

    @property
    def has_objects(self) -> bool:
        return bool(self.kinds & {"children", "object"})

    def data_type(self) -> T.DataType:
        if not self.has_objects:
            return T.ArrayType(T.StringType()) if "list" in self.kinds else T.StringType()
        fields = [T.StructField(k, n.data_type()) for k, n in sorted(self.below.items()) if k != PLAIN]
        struct = T.StructType([*fields, T.StructField(PLAIN, T.StringType())])
        return T.ArrayType(struct) if self.many else struct


def merged_schema(df: DataFrame, payload: str, child_paths: list[str] | None = None, only: list[str] | None = None) -> Node:
    """The schema of all payloads together, from all records.

    child_paths: paths (a/b/c) that are arrays of objects even if no record has one there.
    only: paths to which the schema is cut, with all that lies below them; None is all paths.
    Each batch sends the distinct paths it has; the driver gets these few names only.
    Payloads may be nested to any depth: an object or array below MAX_DEPTH members (or the
    longest of child_paths and only, if that is more) is a plain value, its JSON text. Nor
    do names that are data (objects keyed by id) make the schema grow: beyond MAX_PATHS the
    objects at the paths with most names have the members of child_paths and only, and their
    whole JSON text as PLAIN; at the root, too.
    """
    levels, wanted = _reach(child_paths, only)

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch[payload]:
                record = read_record(text)
                if record is not None:
                    _walk(record, "", found, levels, wanted)
                if len(found) > MAX_PATHS:
                    yield pd.DataFrame(sorted(found), columns=["path", "kind"])
                    found.clear()
        yield pd.DataFrame(sorted(found), columns=["path", "kind"])

    every = df.select(F.col(payload).cast("string").alias(payload)).mapInPandas(paths, "path string, kind string").distinct()
    return _schema_of(every, child_paths, only)


def _reach(child_paths: list[str] | None, only: list[str] | None) -> tuple[int, dict[str, Any] | None]:
    """How many levels of members are looked at, and which members."""
    asked = [*(child_paths or []), *(only or [])]
    return max([MAX_DEPTH, *(p.count("/") + 2 for p in asked)]), None if only is None else _wanted(child_paths or [], only)


def read_once(df: DataFrame, key: str, payload: str, child_paths: list[str], only: list[str]) -> tuple[Node, DataFrame]:
    """The merged schema of the payloads, and (key, text): each payload cut to the members of child_paths and only, as a written table.

    As merged_schema() with the same paths, but each payload is parsed once: the texts that
    shaped_records() takes are as small as what is asked for. Payloads that are no JSON
    object are left out.
    """
    levels, wanted = _reach(child_paths, only)
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str]] = set()
        schema = None
        for batch in batches:
            schema = pa.schema([(key, batch.column(0).type), ("text", pa.string()), ("path", pa.string()), ("kind", pa.string())])
            texts: list[str | None] = []
            for text in batch.column(1).to_pylist():
                record = read_record(text)
                texts.append(None if record is None else write(_walk(record, "", found, levels, wanted)))
            none = pa.nulls(len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), none, none], schema=schema)
            if len(found) > MAX_PATHS:
                yield paths(found, schema)
                found.clear()
        if schema is not None:
            yield paths(found, schema)

    def paths(found: set[tuple[str, str]], schema: pa.Schema) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.nulls(n, schema[0].type), pa.nulls(n, pa.string()), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], schema=schema)

    rows = df.select(F.col(key), F.col(payload).cast("string").alias("text")).mapInArrow(read, f"`{key}` {kind}, text string, path string, kind string")
    rows = persisted(rows, "payloads")
    schema = _schema_of(rows.where(F.col("path").isNotNull()).select("path", "kind").distinct(), child_paths, only)
    return schema, rows.where(F.col("text").isNotNull()).select(key, "text")


def _schema_of(every: DataFrame, child_paths: list[str] | None, only: list[str] | None) -> Node:
    seen = [tuple(r) for r in every.limit(MAX_PATHS + 1).collect()]
    if len(seen) > MAX_PATHS:
        seen = _few_paths(persisted(every, "paths"))
    root = Node({"object"})

    def at(parts: list[str], kind: str | None) -> None:
        node = root
        for i, part in enumerate(parts):
            node = node.below.setdefault(part, Node())
            if i < len(parts) - 1 and not node.has_objects:
                node.kinds.add("object")
        if kind:
            node.kinds.add(kind)

    for path, kind in seen:
        at([_unescape(x) for x in path.split("/")[1:]], kind)
    for path in child_paths or []:
        at(path.split("/"), "children")
    for path in only or []:
        at(path.split("/"), None)
    return root


def _few_paths(seen: DataFrame) -> list[tuple[str, str]]:
    """(path, kind) without what lies below objects with many names, at most MAX_PATHS; these have the kind "wide", too.

    How many names an object may have follows from all paths together, so the result does not
    depend on the order or the partitions of the records.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    lines = persisted(seen.select("path", "kind", above.alias("above")), "path-lines")
    names = persisted(lines.groupBy(F.element_at("above", -1).alias("path")).agg(F.count_distinct("path").alias("names")), "path-names")
    most = MAX_NAMES
    while True:
        wide = names.where(F.col("names") > most).select("path")
        below = lines.select("path", F.explode("above").alias("up")).join(wide.withColumnRenamed("path", "up"), "up", "left_semi").select("path").distinct()
        kept = lines.select("path", "kind").join(below, "path", "left_anti")
        marks = kept.select("path").union(seen.sparkSession.createDataFrame([("",)], "path string")).distinct().join(wide, "path", "left_semi")
        out = kept.union(marks.select("path", F.lit("wide"))).limit(MAX_PATHS + 1).collect()
        if len(out) <= MAX_PATHS or most == 0:
            return [tuple(r) for r in out]
        most //= 2


def _plain(v: Any) -> str | None:
    """A value as text: JSON for objects and arrays, a whole number without a fraction however it was written."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**63:
        return str(int(v))
    return write(v)


def shape(v: Any, node: Node) -> Any:
    """A value in the merged shape of its path. In arrays of objects other members become null and keep their place."""
    v = read_value(v)
    if node.many:
        items = v if isinstance(v, list) else [v]
        if not isinstance(v, (list, dict)):
            return None
        items = [read_value(x) for x in items]
        return [_object(x, node) if isinstance(x, dict) else None for x in items]
    if node.has_objects:
        if isinstance(v, dict):
            return _object(v, node)
        return None if v is None else {PLAIN: _plain(v)}
    if "list" in node.kinds:
        if v is None or v == "":
            return None
        return [_plain(x) for x in (v if isinstance(v, list) else [v])]
    return _plain(v)


def _object(obj: dict, node: Node) -> dict[str, Any]:
    out = {k: shape(v, node.below[k]) for k, v in members(obj, node.below).items()}
    if node.wide:
        out[PLAIN] = _plain(obj)
    return out


def shaped_records(df: DataFrame, key: str, payload: str, schema: Node) -> DataFrame:
    """(key, record): each payload in the merged shape, as a written table. Payloads that are no JSON object are left out."""

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            record = read_record(text)
            return None if record is None else json.dumps(_object(record, schema), ensure_ascii=True)

        return pd.Series([one(t) for t in texts], dtype=object)

    root = T.StructType([*(T.StructField(k, n.data_type()) for k, n in sorted(schema.below.items())), T.StructField(PLAIN, T.StringType())])
    texts = df.select(F.col(key), canonical(F.col(payload).cast("string")).alias("text")).where(F.col("text").isNotNull())
    return persisted(texts.select(key, F.from_json("text", root).alias("record")), "records")


def child_table(records: DataFrame, key: str, path: list[str]) -> DataFrame:
    """(key, parent_id, child_id, ordinal, place, item) of the objects at path, one array level after another.

    path: the members from the record to the array, such as ["collections", "biosamples"]
    or ["extra.fourdn.extra_files"]; a step may pass through single objects by dots.
    child_id is the record's key with path and place, parent_id that of the object around
    (the record's key at the first level). place: ordinals from 0 from the outermost array
    to this one, joined by dots. Members that are no objects have no row but keep their
    ordinal. A missing, null or empty array has no rows.
    """
    name = lambda levels, place: F.concat_ws("/", F.col(key).cast("string"), F.lit(".".join(levels)), place)
    df = records.select(key, F.col(key).cast("string").alias("child_id"), F.lit("").alias("place"), F.col("record").alias("item"))
    for i, step in enumerate(path):
        at = "item" + "".join(f".`{x}`" for x in step.split("."))
        df = df.select(key, F.col("child_id").alias("parent_id"), F.col("place").alias("above"), F.posexplode(at).alias("ordinal", "item")).where(F.col("item").isNotNull())
        place = F.when(F.col("above") == "", F.col("ordinal").cast("string")).otherwise(F.concat_ws(".", "above", "ordinal"))
        df = df.select(key, "parent_id", "ordinal", place.alias("place"), "item").withColumn("child_id", name(path[: i + 1], F.col("place")))
    return df.select(key, "parent_id", "child_id", "ordinal", "place", "item")


def array_paths(schema: Node) -> list[list[str]]:
    """Paths of all array levels of a merged schema, as child_table takes them."""
    out: list[list[str]] = []

    def visit(node: Node, levels: list[str], step: list[str]) -> None:
        for k, n in sorted(node.below.items()):
            if n.many:
                here = [*levels, ".".join([*step, k])]
                out.append(here)
                visit(n, here, [])
            elif n.has_objects:
                visit(n, levels, [*step, k])

    visit(schema, [], [])
    return out


def flat_tables(df: DataFrame, key: str, payload: str) -> dict[str, DataFrame]:
    """All child tables of the payloads by path, and the records themselves under ""."""
    schema = merged_schema(df, payload)
    records = shaped_records(df, key, payload, schema)
    return {"": records} | {"/".join(p).replace(".", "/"): child_table(records, key, p) for p in array_paths(schema)}
