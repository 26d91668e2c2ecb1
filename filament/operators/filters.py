"""Filter trees over nested documents.

A tree is a list (any of), an object (all of its members) or a value (equality). Names are
followed into structs; through arrays a leaf holds if some element along its path equals the
value, each leaf on its own. Members that set no constraint vanish; an empty tree matches all.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filament.functions import scalars

#: Paths whose values are compared stripped and upper case; blanks there set no constraint.
FOLDED = ("accession_id", "collections.accession_id")


def _equal(c: Column, kind: T.DataType, path: list[str], value: Any) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: _equal(x, kind.elementType, path, value))
    if path:
        return _equal(c.getField(path[0]), kind[path[0]].dataType, path[1:], value)
    return c == F.lit(value)


def _leaf(schema: T.StructType, path: tuple[str, ...], value: Any, folded: tuple[str, ...]) -> Column | None:
    if ".".join(path) in folded:
        value = str(value).strip().upper()
        if not value:
            return None
    # a null stays null: trees only combine by and / or, and a plain comparison reaches the scan
    return _equal(F.col(path[0]), schema[path[0]].dataType, list(path[1:]), value)


def leaf_paths(schema: T.StructType) -> list[str]:
    """Dotted paths of all values of a document type."""
    out: list[str] = []

    def visit(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.ArrayType):
            visit(kind.elementType, path)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f.dataType, f"{path}.{f.name}" if path else f.name)
        else:
            out.append(path)

    visit(schema, "")
    return out


def compile_filter(tree: Any, schema: T.StructType, folded: tuple[str, ...] = FOLDED, path: tuple[str, ...] = ()) -> Column | None:
    """The tree as a condition; None if it sets no constraint. Unknown names raise ValueError."""
    if tree is None:
        return None
    if isinstance(tree, (list, tuple)):
        parts = [p for x in tree if (p := compile_filter(x, schema, folded, path)) is not None]
        return reduce(lambda a, b: a | b, parts) if parts else None
    if isinstance(tree, dict):
        parts = [p for k, x in tree.items() if (p := compile_filter(x, schema, folded, (*path, k))) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if ".".join(path) not in leaf_paths(schema):
        raise ValueError(f"no such field: {'.'.join(path)}")
    return _leaf(schema, path, tree, folded)


def matching(tree: Any, schema: T.StructType, folded: tuple[str, ...] = FOLDED) -> Column:
    """As compile_filter; no constraint is true."""
    c = compile_filter(tree, schema, folded)
    return F.lit(True) if c is None else c


def path_values(schema: T.StructType, path: str) -> Column:
    """All values at a dotted path, flat and once each, as an array; for array columns that a leaf can be looked up in."""

    def gather(c: Column, kind: T.DataType, rest: list[str]) -> Column:
        if isinstance(kind, T.ArrayType):
            inner = F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: gather(x, kind.elementType, rest))
            return F.flatten(inner)
        if rest:
            return gather(c.getField(rest[0]), kind[rest[0]].dataType, rest[1:])
        return F.when(c.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(c))

    first, *rest = path.split(".")
    return F.array_distinct(gather(F.col(first), schema[first].dataType, rest))


def access_guard(dcc: Column, level: Column, guarded: str = "hubmap") -> Column:
    """Rows of the guarded centre need the level public; null, blank and others are denied."""
    return (dcc != guarded) | (F.coalesce(level, F.lit("")) == "public")


#: Fixed value: what an identifier in a path may be.
IDENTIFIER = r"\A[A-Za-z0-9._-]+\z"


def is_identifier(c: Column, dots: bool = True) -> Column:
    return c.rlike(IDENTIFIER) & (F.char_length(c) <= 256) & (F.lit(True) if dots else ~c.contains("."))


def url_allowed(url: Column, hosts: list[str], schemes: tuple[str, ...] = ("https",)) -> Column:
    """Whether a URL has an allowed scheme, and a host that is or ends in an allowed one."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    ends = reduce(lambda a, b: a | b, ((host == h) | host.endswith(f".{h}") for h in hosts))
    return F.coalesce(scheme.isin(*schemes) & ends, F.lit(False))


#: Sidecar format tokens.
SIDECARS = ("bai", "tbi", "beddb", "csi", "pairs_px2", "bg_px2")


def sidecar(files: Column, fourdn_files: Column, tokens: tuple[str, ...] = SIDECARS) -> Column:
    """The first extra file whose format is one of tokens, else the first of all; the second list counts only if the first is empty or null.

    A format may be the text of an object with a display_title.
    """
    every = F.when(F.coalesce(F.size(files), F.lit(0)) > 0, files).otherwise(fourdn_files)
    fit = F.filter(every, lambda e: F.lower(scalars.display_title(e["file_format"])).isin(*tokens))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.try_element_at(every, F.lit(1)))


# Processors in the order they are asked, and the format names each takes.
PROCESSORS = {
    "passthrough": ("CSV", "TSV", "bigWig"),
    "alignment_index": ("BAM", "SAM"),
    "interval_index": ("VCF", "GFF", "GFF3", "GTF", "BED", "BroadPeak", "NarrowPeak", "bigBed"),
    "matrix": ("HDF5",),
}


def processor(format_name: Column) -> Column:
    """The first processor that takes a format; null for formats that none takes."""
    out = F.lit(None).cast("string")
    for name, formats in reversed(PROCESSORS.items()):
        out = F.when(format_name.isin(*formats), F.lit(name)).otherwise(out)
    return out


def is_interaction(format_name: Column) -> Column:
    """Whether a file is a set of interactions, which its format name alone tells."""
    return F.coalesce(format_name == "bigInteract", F.lit(False))


def matrix_kind(format_name: Column, filename: Column) -> Column:
    """mcool, cool or hic by the name's suffix for container formats, else null."""
    name = F.lower(filename)
    out = F.lit(None).cast("string")
    for suffix in ("hic", "cool", "mcool"):
        out = F.when(name.endswith(f".{suffix}"), F.lit(suffix)).otherwise(out)
    return F.when(format_name == "HDF5", out)
