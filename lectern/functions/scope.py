"""Scope predicates over file paths, all native Columns so that Catalyst can evaluate them in the scan stage."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a source leaves out when it names no excludes of its own.
DEFAULT_EXCLUDES = ("*.tmp", ".*")
DEFAULT_EXTENSIONS = ("md",)

# Byte limits per extension; a missing extension is unlimited.
MIB = 1024 * 1024
HARD_LIMIT = {"md": 10 * MIB, "txt": 10 * MIB, "docx": 30 * MIB, "xlsx": 50 * MIB, "pptx": 100 * MIB}
SOFT_LIMIT = {"docx": 10 * MIB, "xlsx": 20 * MIB, "pptx": 30 * MIB}


@dataclass(frozen=True)
class Source:
    """One scope rule of a notebook: a folder with optional globs."""

    source_id: str
    path: str
    recursive: bool = True
    include_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] | None = None
    enabled: bool = True


@dataclass(frozen=True)
class Notebook:
    notebook_id: str
    sources: tuple[Source, ...] = ()
    extensions: tuple[str, ...] = field(default=DEFAULT_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """The general glob form as an anchored regular expression: ``**`` crosses ``/``, ``*`` does not."""
    out, pos = [], 0
    for m in re.finditer(r"/\*\*/|\*\*|\*", pattern):
        out.append(re.escape(pattern[pos : m.start()]))
        out.append({"/**/": "/(?:.*/)?", "**": ".*", "*": "[^/]*"}[m.group()])
        pos = m.end()
    out.append(re.escape(pattern[pos:]))
    return r"\A" + "".join(out) + r"\z"


def glob_match(path: Column, pattern: str) -> Column:
    """FLT-1: chosen when the plan is built, so the simple forms become pushable string predicates."""
    if not pattern:
        return F.lit(False)
    stars = pattern.count("*")
    exact = path == F.lit(pattern)
    if stars == 0:
        return exact
    if stars == 1 and len(pattern) > 1 and pattern[0] == "*":
        return exact | path.endswith(pattern[1:])
    if stars == 1 and len(pattern) > 1 and pattern[-1] == "*":
        return exact | path.startswith(pattern[:-1])
    return exact | path.rlike(glob_regex(pattern))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def _under(path: Column, base: str) -> Column:
    return (path == F.lit(base)) | path.startswith(base + "/")


def in_source(path: Column, source: Source) -> Column:
    """FLT-2."""
    if not source.enabled:
        return F.lit(False)
    base = source.path.removesuffix("/")
    keep = _under(path, base) if base else F.lit(True)
    if not source.recursive:
        rest = path
        if base:
            rest = F.when(path == F.lit(base), path).otherwise(F.substring(path, len(base) + 2, 2**31 - 1))
        keep = keep & ~rest.contains("/")
    if source.include_globs:
        keep = keep & _any([glob_match(path, g) for g in source.include_globs])
    excludes = DEFAULT_EXCLUDES if source.exclude_globs is None else source.exclude_globs
    drop = [glob_match(path, g) for g in excludes]
    if ".*" in excludes:
        drop.append(path.rlike(r"(?:^|/)\."))
    return keep & ~_any(drop) if drop else keep


def in_scope(path: Column, notebook: Notebook) -> Column:
    """FLT-3 for one notebook."""
    return _any([in_source(path, s) for s in notebook.sources])


def resolve_source(path: Column, notebook: Notebook) -> Column:
    """FLT-4 for one notebook: the id of the first source that matches, null if none does."""
    return F.coalesce(*[F.when(in_source(path, s), F.lit(s.source_id)) for s in notebook.sources], F.lit(None).cast("string"))


def in_notebooks(df: DataFrame, notebooks: Sequence[Notebook], path: str = "file_path") -> DataFrame:
    """FLT-3/FLT-4 for many notebooks: one row per (file, notebook) that covers it, with its first source.

    Notebook rules are configuration (a few per user), so they compile into predicates of one
    narrow pass; the files are neither shuffled nor joined.
    """
    col = F.col(path)
    found = F.array(
        *[
            F.when(in_scope(col, nb), F.struct(F.lit(nb.notebook_id).alias("notebook_id"), resolve_source(col, nb).alias("source_id")))
            for nb in notebooks
        ]
    )
    return (
        df.withColumn("_nb", F.explode(F.array_compact(found)))
        .select("*", "_nb.notebook_id", "_nb.source_id")
        .drop("_nb")
    )


def covers_file(path: Column, notebook: Notebook) -> Column:
    """FLT-5: extension and folder prefix only; globs are not looked at."""
    folders = [
        F.lit(True) if s.path in ("", "/") else _under(path, s.path) for s in notebook.sources if s.enabled
    ]
    return extension(path).isin(*notebook.extensions) & _any(folders)


def _limit(ext: Column, limits: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in limits.items() for x in (kv[0], kv[1])]
    return F.try_element_at(F.create_map(*pairs), ext)


def under_size_limit(ext: Column, size: Column) -> Column:
    """FLT-6."""
    return F.coalesce(size <= _limit(ext, HARD_LIMIT), F.lit(True))


def lane(ext: Column, size: Column) -> Column:
    """FLT-6: ``slow`` for files at or over the soft limit, to be repartitioned apart from the rest."""
    return F.when(size >= _limit(ext, SOFT_LIMIT), F.lit("slow")).otherwise(F.lit("fast"))
