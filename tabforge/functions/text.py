"""Text, path and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that decide the format of an object path, in
# priority order, and the format of every other path.
PATH_FORMATS = (
    (".parquet", "parquet"),
    (".json", "json"),
    (".jsonl", "jsonl"),
    (".arrow", "arrow"),
)
DEFAULT_PATH_FORMAT = "csv"


# White space of any script, as Python strips it.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip_text(c: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.trim(c, F.lit(BLANKS))


def decode_utf8(content: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD, newlines become ``\\n``."""
    text = F.make_valid_utf8(content.cast("string"))
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\r"), F.lit("\n"))


def clean_document(content: Column) -> Column:
    return strip_text(decode_utf8(content))


def path_format(path: Column) -> Column:
    """Storage format implied by an object path."""
    lowered = F.lower(path)
    out = None
    for needle, name in PATH_FORMATS:
        hit = lowered.contains(needle)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_PATH_FORMAT)


def object_url(scheme: str, bucket: Column, path: Column) -> Column:
    """``scheme://bucket/key`` with the key's leading slashes dropped."""
    return F.concat(F.lit(f"{scheme}://"), bucket, F.lit("/"), F.ltrim(path, F.lit("/")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file; empty when there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty when the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def suffix_glob(suffixes: tuple[str, ...]) -> str:
    """Glob of the suffixes in any case, so a scan never opens other files."""
    def any_case(s: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)

    return "*{" + ",".join(any_case(s) for s in suffixes) + "}"


def plain_path(uri: Column) -> Column:
    """File path of a ``file:`` URI; other URIs stay as they are."""
    return F.regexp_replace(uri, r"^file:/+", "/")
