"""Column builders for slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import col


def name(path: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), "/+$", ""), "([^/]*)$", 1)


def suffix(path: Column | str) -> Column:
    """The last dot of the name and what follows; nothing if the dot starts or ends the name."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def parts(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda p: F.length(p) > 0)


def ancestors(path: Column | str) -> Column:
    """'.' and every folder above the item, from the top."""
    p = parts(path)
    above = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), above)


def has_run(path: Column | str, run: str) -> Column:
    """Whether the parts of run stand in the path one after the other."""
    return F.contains(F.concat(F.lit("/"), F.array_join(parts(path), "/"), F.lit("/")), F.lit(f"/{run}/"))


def module(path: Column | str) -> Column:
    """The dotted module of a .py path; null for others and for a bare __init__.py."""
    bare = F.regexp_replace(F.regexp_replace(col(path), r"\.py$", ""), "(^|/)__init__$", "")
    return F.when((suffix(path) == ".py") & (F.length(bare) > 0), F.translate(bare, "/", "."))
