"""Dense graphs as packed adjacency: neighbours as 4-byte numbers in binary pieces.

A graph of many edges and comparatively few vertices (``dense``) is written once as pieces of whole vertices, ``PIECE`` edge ends each;
rounds over all edges then read 4 bytes an edge end and no row for each. A round's state, one number for each vertex, is packed as
well and broadcast to the pieces; ``VERTICES`` bounds it.

Defined results: as for ``graph.proper``: null vertices, loops, null ends and edges to vertices outside the table count for nothing;
repeated edges count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ranks import number
from graphloom.functions.storage import materialise
from graphloom.operators.graph import proper, symmetrise

#: Edge ends in a piece.
PIECE = 2_000_000
#: Vertices up to which a state is broadcast (8 bytes each), and edges to a vertex from which a graph counts as dense.
VERTICES, DENSITY = 4_000_000, 8

_PIECES = "own binary, counts binary, near binary, repeats boolean"


def dense(vertices: DataFrame, n_edges: int) -> bool:
    """Whether a graph is worth packing: its state fits a broadcast, and a piece holds far more than the state."""
    return n_edges >= DENSITY * (n := vertices.count()) and n <= VERTICES


def numbered(vertices: DataFrame) -> DataFrame:
    """``(node, i)``: the different vertices, numbered from 0 in the order of their ids."""
    return materialise(number(vertices, "node", "i").select("node", "i"), "packed-ids")


def cut(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Sorted keys ``s << 32 | d`` as pieces ``(own, counts, near, repeats)`` of about PIECE ends and whole vertices."""
    s, near = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    first = np.flatnonzero(np.diff(s, prepend=-1))
    ends = np.append(first, len(s))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
        a, b = ends[lo], ends[hi]
        yield s[first[lo:hi]], np.diff(ends[lo : hi + 1]), near[a:b], bool((key[a + 1 : b] == key[a : b - 1]).any())
        lo = hi


def _packing(merge: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if held:
            key = np.concatenate(held)
            held.clear()
            key.sort()
            if merge:
                key = key[np.diff(key, prepend=-1) != 0]
            for own, counts, near, repeats in cut(key):
                yield pa.RecordBatch.from_pydict({
                    "own": pa.array([own.tobytes()], pa.binary()), "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
                    "near": pa.array([near.tobytes()], pa.binary()), "repeats": pa.array([repeats]),
                })

    return run


def pieces(ids: DataFrame, edges: DataFrame, n_edges: int, merge: bool = False) -> DataFrame:
    """``(own, counts, near, repeats)``: numbers of a piece's vertices, how many neighbours each has, and these, ascending.
    With ``merge`` repeated edges, of either direction, count once."""
    a, b = ids.select(F.col("node").alias("src"), F.col("i").alias("u")), ids.select(F.col("node").alias("dst"), F.col("i").alias("v"))
    return of_numbers(edges.join(a, "src").join(b, "dst").where("u <> v").select(F.col("u").alias("src"), F.col("v").alias("dst")), n_edges, merge)


def of_numbers(edges: DataFrame, n_edges: int, merge: bool = False) -> DataFrame:
    """Pieces of edges between numbers, as they stand: a loop counts at both of its ends."""
    parts = max(1, -(-2 * n_edges // PIECE))
    rows = symmetrise(edges).repartition(parts, "s").select(F.shiftleft("s", 32).bitwiseOR(F.col("d")).alias("key"))
    return materialise(rows.mapInArrow(_packing(merge), _PIECES), "packed")


def numbers(cell: pa.Scalar | bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(cell.as_buffer() if isinstance(cell, pa.Scalar) else cell, kind)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for b in batches:
        for r in range(b.num_rows):
            yield {name: b.column(j)[r] for j, name in enumerate(b.schema.names)}


def _gathered(n: int, kind: type):
    """Parts ``(own, now)`` of a state as one row ``(state)``; vertices without a neighbour have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros(n, kind)
        for r in rows_of(batches):
            state[numbers(r["own"])] = numbers(r["now"], kind)
        yield pa.RecordBatch.from_pydict({"state": pa.array([state.tobytes()], pa.binary())})

    return run


def advance(parts: DataFrame, state: DataFrame | None, step: Callable, n: int, kind: type = np.int32) -> tuple[DataFrame, int]:
    """The next state, one packed row, and how many numbers changed: ``step(own, counts, near, state)`` gives a piece's new numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            own, counts, near = (numbers(r[c]) for c in ("own", "counts", "near"))
            old = numbers(r["state"], kind) if "state" in r else None
            now = step(own, counts, near, old)
            yield pa.RecordBatch.from_pydict({
                "own": pa.array([own.tobytes()], pa.binary()), "now": pa.array([now.astype(kind).tobytes()], pa.binary()),
                "changed": pa.array([len(own) if old is None else int((now != old[own]).sum())], pa.int64()),
            })

    rows = parts if state is None else parts.crossJoin(F.broadcast(state))
    moved = materialise(rows.mapInArrow(run, "own binary, now binary, changed bigint"), "packed-step")
    changed = moved.agg(F.sum("changed")).first()[0] or 0
    one = materialise(moved.select("own", "now").coalesce(1).mapInArrow(_gathered(n, kind), "state binary"), "packed-state")
    return one, changed


def unpacked(ids: DataFrame, state: DataFrame, name: str, kind: type = np.int32) -> DataFrame:
    """``(node, name)`` of a packed state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            now = numbers(r["state"], kind)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(now))), name: pa.array(now.astype(np.float64 if kind is np.float64 else np.int64))})

    values = state.mapInArrow(run, f"i bigint, {name} {'double' if kind is np.float64 else 'bigint'}")
    return ids.join(values, "i").select("node", name)


def h_indices(own: np.ndarray, counts: np.ndarray, near: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The greatest h up to a vertex's number such that h of its neighbours stand at h or more."""
    now = state[own].copy()
    at = np.concatenate([[0], np.cumsum(counts)])
    seen = state[near]
    carried = np.add.reduceat((seen >= np.repeat(now, counts)).astype(np.int32), at[:-1])
    fall = np.flatnonzero(carried < now)
    if len(fall):
        inside = np.repeat(carried < now, counts)
        n = counts[fall].astype(np.int64)
        begin = np.cumsum(n) - n
        group = np.repeat(np.arange(len(fall), dtype=np.int64), n)
        key = group << 32 | (0x7FFFFFFF - seen[inside].astype(np.int64))
        key.sort()  # the greatest first
        value = 0x7FFFFFFF - (key & 0xFFFFFFFF)
        rank = np.arange(len(key)) - np.repeat(begin, n) + 1
        now[fall] = np.minimum(np.maximum.reduceat(np.minimum(value, rank), begin), now[fall])
    return now


def core_numbers(vertices: DataFrame, edges: DataFrame, n_edges: int, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """``(node, core)`` and whether they are final: after ``rounds`` rounds numbers may still be too large, never too small."""
    own, plain = proper(vertices, edges)
    ids = numbered(own)
    n = ids.count()
    parts = pieces(ids, plain, n_edges)
    state, changed = advance(parts, None, lambda own, counts, near, old: counts, n)
    k = 0
    while changed and (rounds is None or k < rounds):
        state, changed = advance(parts, state, h_indices, n)
        k += 1
    return materialise(unpacked(ids, state, "core"), "packed-cores"), not changed
