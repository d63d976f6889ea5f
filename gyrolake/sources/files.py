"""Files as tables: listings, and files of named arrays (JSON, NPZ)."""

from __future__ import annotations

import io
import json
import re
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], subset: str = "", whole_path: bool = False, limit: int | None = None) -> DataFrame:
    """(path, relative) of the files under ``root`` with one of the suffixes; a missing root is an error.

    ``subset`` is looked for in the relative path, or the whole one, whatever its case. A
    ``limit`` takes the first files by path, before anything is read from them. Contents are not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/+", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    files = found.select("path", F.when(F.startswith(plain, base), F.substring(plain, F.length(base) + 2, F.length(plain))).otherwise(plain).alias("relative"))
    files = files.filter(suffix_of(F.col("path")).isin(*suffixes))
    if subset:
        files = files.filter(F.contains(F.lower("path" if whole_path else "relative"), F.lit(subset.lower())))
    return files if limit is None else files.orderBy("path").limit(limit)


def with_content(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """(path, content) of the listed files."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return held.join(files.select("path"), "path", "left_semi")


DEEPEST = 64  # levels of nested objects and lists
_STRINGS = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)


def payload_of(content: bytes) -> Any:
    """What a JSON file holds; nesting beyond DEEPEST is an error before anything is parsed."""
    marks = np.frombuffer(_STRINGS.sub(b"", content), np.uint8)
    level = np.cumsum(np.isin(marks, (91, 123)).astype(np.int32) - np.isin(marks, (93, 125)))
    if level.max(initial=0) > DEEPEST:
        raise ValueError("nested too deeply")
    return json.loads(content)


def numeric(value: Any) -> np.ndarray | None:
    """``value`` as an array of doubles, nulls as NaN; None if it is no even table of numbers."""
    try:
        return np.asarray(value, dtype=np.float64)
    except (TypeError, ValueError):
        return None


def arrays_of(path: str, content: bytes) -> dict[str, Any]:
    """A file's named arrays; names and other texts stay as they are, what is neither is left out.

    In JSON a list ``frames`` of objects gives one array for each key that all of them
    have; keys beside it come first. NPZ files with pickled objects are refused.
    """
    if path.lower().endswith(".npz"):
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            return {k: str(held[k]) if held[k].dtype.kind in "US" else held[k].astype(np.float64) for k in held.files}
    payload = payload_of(content)
    if not isinstance(payload, dict):
        raise ValueError("no named arrays")
    frames = payload.pop("frames", None) if isinstance(payload.get("frames"), list) else None
    if frames:
        shared = set.intersection(*[{k for k, x in f.items() if x is not None} for f in frames])
        payload = {**{k: [f[k] for f in frames] for k in shared}, **payload}
    told = {k: x if isinstance(x, str) else numeric(x) for k, x in payload.items()}
    return {k: x for k, x in told.items() if x is not None}
