"""Scalar functions over metadata columns. All are built-in column expressions; a null argument gives null unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+\z"


def stripped(c: Column) -> Column:
    """c without white space of any kind around it."""
    return F.regexp_replace(c, _EDGES, "")


def nonempty(c: Column) -> Column:
    """c stripped; null if nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_accession(c: Column) -> Column:
    """Stripped and upper case; null for blanks."""
    return F.upper(nonempty(c))


def extract_accession(c: Column) -> Column:
    """First file accession (4DNF…) in a text, upper case."""
    return F.upper(_found(c, "(?i)4DNF[A-Z0-9]+"))


def extract_experiment_accession(c: Column) -> Column:
    """First experiment accession (4DNE…) in a text, upper case."""
    return F.upper(_found(c, "(?i)4DNE[A-Z][A-Z0-9]+"))


# Names of genome assemblies, and the assembly each stands for.
ASSEMBLIES = {"hg38": "GRCh38", "grch38": "GRCh38", "hg19": "GRCh37", "grch37": "GRCh37", "mm10": "GRCm38", "grcm39": "GRCm39"}


def genome_assembly(c: Column) -> Column:
    """First assembly named as a word in a text, by its usual name."""
    key = F.lower(_found(c, rf"(?i)\b({'|'.join(ASSEMBLIES)})\b", 1))
    return _lookup(key, ASSEMBLIES)


def _lookup(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


# File-name tokens that say more than a general format term.
ENRICHED_FORMATS = ("mcool", "cool", "hic", "pairs", "r3d", "nd2", "flex", "spt", "matrix")


def enriched_file_format(filename: Column) -> Column:
    """pairs for names that end in .pairs.gz, else the last dot-separated token if it is one of ENRICHED_FORMATS."""
    name = F.lower(filename)
    token = F.substring_index(name, ".", -1)
    return F.when(name.endswith(".pairs.gz"), F.lit("pairs")).when(token.isin(*ENRICHED_FORMATS), token)


#: Format terms that do not tell the formats in ENRICHED_FORMATS apart.
AMBIGUOUS_FORMATS = ("format:3590", "format:2330")


def format_is_open(raw_format: Column) -> Column:
    """Whether a raw format is blank or too general, so that the file name decides."""
    return nonempty(raw_format).isNull() | raw_format.isin(*AMBIGUOUS_FORMATS)


# Compression suffixes and their terms; None for those without one.
COMPRESSIONS = {".gz": "format:3989", ".gzip": "format:3989", ".tgz": "format:3989", ".bgz": "format:3615", ".bz2": None, ".xz": None, ".zst": None, ".zip": None, ".starch": None}


def compression_format(name_or_url: Column) -> Column:
    """Term of the compression a name's suffix tells; "" for no such suffix; null for no name, or a suffix without term.

    Of a URL (with ://) the decoded path counts, without query and fragment.
    """
    value = nonempty(name_or_url)
    is_url = value.contains("://")
    path = F.regexp_replace(F.regexp_replace(value, r"[?#].*\z", ""), r"\A[^:]*://[^/]*", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    base = F.lower(F.substring_index(F.when(is_url, decoded).otherwise(value), "/", -1))
    by_length = sorted(COMPRESSIONS.items(), key=lambda x: -len(x[0]))
    out = F.when(base == "", F.lit(None).cast("string"))
    for suffix, term in by_length:
        out = out.when(base.endswith(suffix), F.lit(term).cast("string"))
    return F.when(value.isNotNull(), out.otherwise(F.lit("")))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def file_name(url: Column, accession: Column, file_format: Column) -> Column:
    """Last part of the URL's path, else accession.format, else the accession."""
    fmt = nonempty(file_format)
    return F.coalesce(basename(nonempty(url)), F.when(fmt.isNotNull(), F.concat_ws(".", accession, fmt)).otherwise(accession))


def whole_number(c: Column) -> Column:
    """A numeric value as a whole number; null if it has a fraction or does not fit."""
    return F.when(c == F.floor(c), c.try_cast("bigint"))


def parse_int(c: Column) -> Column:
    """Whole number written as an optional sign and digits, else null; see whole_number() for numbers that are no texts."""
    t = stripped(c)
    return F.when(t.rlike(r"^[+-]?\d+\z"), t.try_cast("bigint"))


def donor_ids(c: Column) -> Column:
    """Accessions of a comma-separated list of paths; parts that are no path stay as they are."""
    parts = F.filter(F.transform(F.split(nonempty(c), ","), stripped), lambda p: p != "")
    return F.coalesce(F.transform(parts, lambda p: F.coalesce(_found(p, "/([A-Z0-9]+)/?$", 1), p)), F.array().cast("array<string>"))


def replicate(c: Column, kind: str) -> Column:
    """Token after Biorep or Techrep (with the comma that may follow it)."""
    return _found(c, rf"{kind}\s+(\S+)", 1)


def timestamp_utc(c: Column) -> Column:
    """ISO date or date-time as a zone-less UTC timestamp; null for anything else. A text without offset is UTC already."""
    t = stripped(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?\z")
    zone = F.regexp_extract(t, r"(Z|[+-]\d{2}(?::?\d{2})?)\z", 1)
    clock = F.when(t.rlike(r"^.{10}."), F.regexp_replace(t, r"(Z|[+-]\d{2}(:?\d{2})?)\z", "")).otherwise(t)
    wall = F.replace(clock, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    has_zone = t.rlike(r"^.{10}.") & (zone != "") & (zone != "Z")
    minutes = F.expr("0")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(has_zone, F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))).otherwise(minutes)
    return F.when(iso, wall - F.make_dt_interval(mins=minutes))


def canonical_json(c: Column) -> Column:
    """A JSON text with the members of all its objects sorted by name, at any depth, values as they are; texts that are no JSON give null.

    The variant type keeps the members of objects in the order of their names.
    """
    return F.to_json(F.try_parse_json(c))


def single_or_self(c: Column) -> Column:
    """The element of a JSON list of one element, as text; any other JSON text, and what is no JSON, as it is."""
    v = F.try_parse_json(c)
    alone = F.schema_of_variant(v).startswith("ARRAY<") & F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
    element = F.try_variant_get(v, "$[0]", "variant")
    return F.when(F.coalesce(alone, F.lit(False)), F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.nullif(F.to_json(element), F.lit("null")))).otherwise(c)


def display_title(c: Column) -> Column:
    """display_title of a JSON object, else the text itself."""
    return F.coalesce(F.when(c.startswith("{"), F.get_json_object(c, "$.display_title")), c)


def key_part(c: Column) -> Column:
    """A part of a cache key; null if it is blank or holds a separator or NUL."""
    t = nonempty(c)
    return F.when(~t.rlike(r"[/\\\x00]"), t)


def dcc_name(c: Column) -> Column:
    return F.lower(stripped(c))


def md5_hex(c: Column) -> Column:
    """32 lower-case hex digits, else null."""
    t = F.lower(stripped(c))
    return F.when(t.rlike(r"^[0-9a-f]{32}\z"), t)


def workflow_key(dcc: Column, local_id: Column, md5: Column, version: int) -> Column:
    """dcc/local_id/md5/vN; null if a part is not valid."""
    return _all_or_null("/", F.nullif(dcc_name(dcc), F.lit("")), key_part(local_id), md5_hex(md5), F.lit(f"v{version}"))


def cache_key(dcc: Column, local_id: Column, kind: str, md5: Column, version: int) -> Column:
    """dcc/local_id/kind/md5-vN; null if a part is not valid."""
    return _all_or_null("/", F.nullif(dcc_name(dcc), F.lit("")), key_part(local_id), F.lit(kind), F.concat(md5_hex(md5), F.lit(f"-v{version}")))


def _all_or_null(sep: str, *parts: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (p.isNotNull() for p in parts)), F.concat_ws(sep, *parts))


def local_path(key: Column) -> Column:
    return F.sha2(key, 256)


def byte_range(header: Column, size: Column) -> Column:
    """struct<first, last> of an HTTP range (bytes=a-b, a-, -n), clamped to the size; null if it cannot be served."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    first, last = a.try_cast("bigint"), b.try_cast("bigint")
    good = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    suffix = a == ""
    start = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    stop = F.when(suffix | (b == ""), size - 1).otherwise(F.least(last, size - 1))
    served = good & (start < size) & (start <= stop) & ~(suffix & (last == 0)) & (suffix | (b == "") | (first <= last))
    return F.when(served, F.struct(start.alias("first"), stop.alias("last")))


# Fixed value: the pattern of an absolute path in a message.
ABSOLUTE_PATH = r"(?<![A-Za-z0-9_])/[A-Za-z](?:[A-Za-z0-9_.\\-]*/)+[A-Za-z0-9_.\\-]*"


def scrubbed(c: Column, most: int = 1024) -> Column:
    """A message with absolute paths hidden, at most so many characters."""
    return F.left(F.regexp_replace(c, ABSOLUTE_PATH, "<path>"), F.lit(most))


def presentation(c: Column) -> Column:
    """struct<uid, links>: a tile id without its :links suffix, and whether it had one."""
    return F.struct(F.regexp_replace(c, ":links$", "").alias("uid"), c.endswith(":links").alias("links"))


def redacted_url(c: Column) -> Column:
    """A URL without user, password, query and fragment."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*\z", ""), r"(?<=://)[^/@]*@", "")


def env_list(text: str | None, default: list[str]) -> list[str]:
    """Items of a comma-separated setting, the first of equal ones; unset gives the default, an empty one no items."""
    return list(default) if text is None else list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def memory_cap(text: str) -> bool:
    """Whether a text is a memory size such as 256M."""
    return re.fullmatch(r"\d+[KMGkmg]?", text) is not None
