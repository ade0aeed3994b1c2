"""Text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def searchable(text: Column) -> Column:
    """Words of ASCII letters and digits; a lower-case letter or digit before a capital ends a word. Case stays."""
    split = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(split, r"[^A-Za-z0-9]+", " "))


def token_count(text: Column) -> Column:
    """Runs of Unicode letters, digits and `_`."""
    return F.size(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def lines(text: Column) -> Column:
    """Split at CRLF or LF."""
    return F.split(text, r"\r?\n")


def line_count(text: Column) -> Column:
    """Physical lines: CR and CRLF count as LF, one trailing newline is no line, an empty text has none."""
    unix = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", "")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(unix, "\n"))).cast("long")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, white space collapsed, of 80 characters or more, code fences left out."""
    flat = F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(flat, lambda x: (F.length(x) >= 80) & ~x.startswith("```"))


def json_flag(attributes: Column, *keys: str) -> Column:
    """True if the first of the keys that is there is true, or the string "true"."""
    found = F.coalesce(*(F.get_json_object(attributes, f"$.{k}") for k in keys))
    return F.coalesce(found == "true", F.lit(False))


def json_text(attributes: Column, *keys: str) -> Column:
    """The first key with a string that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(attributes, f"$.{k}"), F.lit("")) for k in keys))


def size_bucket(files: Column) -> Column:
    return F.when(files <= 100, "small").when(files <= 5000, "medium").otherwise("large")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-")


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))
