"""Canonical JSON, digests and the seeds derived from them. Only texts and whole numbers are digested, as they are written alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column | str) -> Column:
    """A JSON string literal; letters beyond ASCII are kept."""
    c = F.col(c) if isinstance(c, str) else c
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_array(values: Column | str, spaced: bool = True) -> Column:
    """A JSON array of values that are JSON already."""
    return F.concat(F.lit("["), F.array_join(values, ", " if spaced else ","), F.lit("]"))


def json_object(fields: dict[str, Column], spaced: bool = True) -> Column:
    """A JSON object of values that are JSON already; keys are sorted."""
    colon, comma = (": ", ", ") if spaced else (":", ",")
    parts = [F.concat(F.lit(f'"{k}"{colon}'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


def digest(json: Column) -> Column:
    return F.sha2(json, 256)


def seed63(of_digest: Column) -> Column:
    """The first 16 hex digits as a number of 63 bits."""
    return (F.conv(F.substring(of_digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
