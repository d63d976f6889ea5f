"""Product codes of vectors: every part of a vector is replaced by the number of its nearest codebook entry.

Codebooks are trained by Lloyd's rounds with Hamerly's bounds. Between rounds each part keeps
its entry, an upper bound of its distance to that entry and one lower bound of its distance to
the second nearest. A part whose upper bound stays strictly below the lower one, or below half
the distance from its entry to the next entry, cannot change and is not compared with the other
entries; where that fails, the exact distance to its own entry is tried as the upper bound, and
only then all entries are scanned. Distances are exact integers; bounds are floats rounded away
from each other, so a tie is always scanned and the lower index wins.

Vectors stay in their partitions throughout: a round is a pass over them and a sum of at most
parts x entries rows a task. The driver holds codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gyrolake.llm.text import salted_join
from gyrolake.plans.staging import staged

LARGEST = 2**27  # of a component: the squares of 64 differences then add up within 64 bits
LOOSE, TIGHT = 1 + 1e-6, 1 - 1e-6  # bounds are kept in 32 bits, whose relative error is at most 6e-8


@dataclass(frozen=True)
class Codebooks:
    """Entries [parts, entries, width] of int64."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_components(vectors: DataFrame, vector_col: str, keep: list[str], parts: int, scale: int) -> DataFrame:
    """(row, v): the columns ``keep`` as a struct, and the vector's components as floor(scale x component).

    Left out are null vectors, those with null or non-finite components, those whose length is
    not a multiple of ``parts`` (or zero), and those with a component beyond LARGEST.
    """
    x = F.col(f"`{vector_col}`")
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(LARGEST)), F.lit(False)))
    fits = (F.size(x) > 0) & (F.size(x) % parts == 0)
    kept = vectors.filter(x.isNotNull() & fits & sound)
    return kept.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def first_entries(rows: DataFrame, id_col: str, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, ties in order of the components; null ids come last, and all have the length of the first."""
    found = rows.select(F.col(f"row.`{id_col}`").alias("id"), "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(found[0].v) // parts if found else 1
    vs = np.array([r.v for r in found if len(r.v) == parts * width], dtype=np.int64).reshape(-1, parts, width)
    return Codebooks(np.ascontiguousarray(vs.transpose(1, 0, 2)))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances [n, entries] of int64."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - book[None, :, k]) ** 2
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries of ``x`` (ties to the lower index), squared distances, upper and lower bounds."""
    d = distances(x, book)
    near = d.argmin(axis=1)
    rows = np.arange(len(x))
    error = d[rows, near]
    if len(book) > 1:
        d[rows, near] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(float))
    else:
        second = np.full(len(x), np.inf)
    return near, error, np.sqrt(error.astype(float)) * LOOSE, second * TIGHT


def half_gaps(book: np.ndarray) -> np.ndarray:
    """Half the distance from every entry to the next one."""
    if len(book) == 1:
        return np.array([np.inf])
    d = distances(book, book)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    return np.sqrt(d.min(axis=1).astype(float)) / 2 * TIGHT


def drifted(now: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far every entry moved, and for every entry how far the others moved at most."""
    moved = np.sqrt(((now - before) ** 2).sum(axis=1).astype(float)) * LOOSE
    order = np.argsort(moved)
    others = np.full(len(moved), moved[order[-1]])
    others[order[-1]] = moved[order[-2]] if len(moved) > 1 else 0.0
    return moved, others


def reassign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``scan`` for parts that have bounds against the entries ``before``, and which parts were scanned."""
    moved, others = drifted(now, before)
    near, upper, lower = near.copy(), (upper + moved[near]) * LOOSE, (lower - others[near]) * TIGHT
    error = ((x - now[near]) ** 2).sum(axis=1)
    bound = np.maximum(lower, half_gaps(now)[near])
    left = ~(upper < bound)
    upper[left] = np.sqrt(error[left].astype(float)) * LOOSE
    left &= ~(upper < bound)
    if left.any():
        near[left], error[left], upper[left], lower[left] = scan(x[left], now)
    return near, error, upper, lower, left


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """An Arrow column of lists without nulls, all ``width`` long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def assigned(rows: DataFrame, now: Codebooks, before: Codebooks | None) -> DataFrame:
    """``rows`` (row, v and, after the first pass, code, upper, lower) with new code, upper, lower, error and the number of parts scanned."""
    parts, _, width = now.entries.shape
    told = StructType.fromDDL("code array<int>, upper array<float>, lower array<float>, error bigint, scanned int")
    schema = StructType([rows.schema["row"], rows.schema["v"], *told.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), parts * width, np.int64).reshape(-1, parts, width)
            n = len(x)
            code, bounds, error, scanned = np.zeros((n, parts), np.int32), np.zeros((2, n, parts), np.float32), np.zeros(n, np.int64), np.zeros(n, np.int32)
            held = None if before is None else [matrix(b.column(c), parts, k) for c, k in (("code", np.int64), ("upper", float), ("lower", float))]
            for p in range(parts):
                if held is None:
                    code[:, p], part_error, bounds[0, :, p], bounds[1, :, p] = scan(x[:, p], now.entries[p])
                    scanned += 1
                else:
                    code[:, p], part_error, bounds[0, :, p], bounds[1, :, p], left = reassign(x[:, p], *(h[:, p] for h in held), now.entries[p], before.entries[p])
                    scanned += left
                error += part_error
            columns = [b.column("row"), b.column("v"), listed(code, pa.int32()), *(listed(x, pa.float32()) for x in bounds), pa.array(error), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry moved to the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            x, code = matrix(b.column("v"), parts * width, np.int64).reshape(-1, parts, width), matrix(b.column("code"), parts, np.int64)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), *(pa.array(sums[p, e, k]) for k in range(width))], ["p", "e", "n", *(f"s{k}" for k in range(width))])

    partial = state.select("v", "code").mapInArrow(run, "p int, e int, n bigint, " + ", ".join(f"s{k} bigint" for k in range(width)))
    moved = books.entries.copy()
    for r in partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect():
        moved[r.p, r.e] = [r[f"s{k}"] // r.n for k in range(width)]
    return Codebooks(moved)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None) -> tuple[DataFrame, Codebooks]:
    """(row, code, error, scanned) of every sound vector, and the trained codebooks.

    ``row`` has the columns ``keep``, by default all but the vector; ``code`` the entry of each
    part; ``error`` the squared distances from the parts to their entries, added up; ``scanned``
    how many parts the bounds did not settle in the last pass. Vectors that ``whole_components``
    leaves out, or whose length is not that of the vector with the smallest id, have no row.
    Repeated rows are vectors of their own; with fewer vectors than ``entries`` the codebooks
    are as short as that. An empty table gives no rows and empty codebooks.
    """
    keep = keep or [c for c in vectors.columns if c != vector_col]
    rows = whole_components(vectors, vector_col, list(dict.fromkeys([id_col, *keep])), parts, scale)
    now, before = first_entries(rows, id_col, parts, entries), None
    state = rows.filter(F.size("v") == now.entries.shape[0] * now.entries.shape[2])
    for k in range(rounds):
        state = staged(assigned(state, now, before).drop("error", "scanned"), f"codes_{k}")
        now, before = updated(state, now), now
    return assigned(state, now, before).select("row", "code", "error", "scanned"), now


def with_group_error(codes: DataFrame, group: str) -> DataFrame:
    """``codes`` with ``group_error``: the error summed over rows of the same ``row.group``; nulls are one group, and a group may hold most rows."""
    label = F.col(f"row.`{group}`")
    keyed = staged(codes.select("*", label.isNull().alias("none"), F.coalesce(label.cast("string"), F.lit("")).alias("of"), F.monotonically_increasing_id().alias("dealt")), "codes")
    totals = keyed.groupBy("none", "of").agg(F.sum("error").alias("group_error"))
    return salted_join(keyed, totals, ["none", "of"], ["dealt"]).drop("none", "of", "dealt")
