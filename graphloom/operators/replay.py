"""Snapshots of large dense graphs from packed adjacency: the same rows as ``snapshots._replay``, dealt out over tasks.

Everything that a snapshot sums is a sum of its additions' gains over its subtree of the forest, and the gains need the order of addition
only. One task peels the packed graph (``peel``). Vertices are dealt to ``GROUPS`` groups; a group's task holds the neighbours of its own
vertices, and the additions pass by all of them in blocks, in order, coded by their steps: it keeps the degrees so far of all vertices
and adds up, over its own neighbours of the added vertex, the degrees around each (``around``). That is the dearest part, a step for every two
edges that share a vertex. The first group also joins the components. What is left is a row for each vertex.

Defined results: as for ``snapshots``; a graph with repeated edges is left to the plain way (``None``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.storage import materialise
from graphloom.operators import packed
from graphloom.operators.peel import whole_peel

#: Groups that vertices are dealt to: a group's task holds its share of the edge ends, 8 bytes each, and reads half of all of them.
GROUPS = 12
#: Marks a present neighbour of the added vertex, above any sum of degrees.
MARK = 1 << 40

_LISTS = "block int, own binary, counts binary, near binary"
_DEALT = "g int, block int, own binary, counts binary, before binary, early binary, near binary"
_GAINS = "g int, block int, own binary, before binary, around binary, cubes binary, fulls binary, terms binary, present binary, early binary"
_ROWS = "component bigint, sid bigint, i bigint, deg bigint, nc bigint, sum_deg bigint, q bigint, q_full bigint, parent bigint, tin bigint, tout bigint, at bigint, up bigint"


def _binary(a: np.ndarray, kind: type = np.int32) -> pa.Array:
    return pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())


def _coded(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ascending lists, one after the other, as their steps in three planes of bytes, compressed: some 1.2 bytes a number where one in
    150 is present, 0.8 where it is one in 25."""
    steps = np.diff(values, prepend=0).astype("<i4")
    first = (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = values[first]
    return pa.array([pa.compress(steps.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), "zstd", asbytes=True)], pa.binary())


def _decoded(cell: pa.Scalar, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    planes = np.frombuffer(pa.decompress(cell.as_buffer(), 3 * n, "zstd"), np.uint8).reshape(3, n)
    steps = np.zeros((n, 4), np.uint8)
    steps[:, :3] = planes.T
    steps = steps.view("<i4").ravel()
    values, filled = np.cumsum(steps, dtype=np.int64), counts > 0
    first = (np.cumsum(counts) - counts)[filled]
    return (values - np.repeat(values[first] - steps[first], counts[filled])).astype(np.int32)


def _order(n: int, ends: int):
    """The pieces of a graph to one row: removal order, each vertex's component, whether edges repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, _, label, repeats = whole_peel(batches, n, ends)
        yield pa.RecordBatch.from_pydict({"removed": _binary(order), "label": _binary(label), "repeats": pa.array([repeats])})

    return run


def _renumbered(size: int, edgewise: bool):
    """Pieces, each with the removal order, to the blocks' parts: vertices by place of addition, neighbours by place as well, in its order
    and coded, or edgewise in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for r in packed.rows_of(batches):
            if place is None:
                removed = packed.numbers(r["removed"])
                place = np.empty(len(removed), np.int32)
                place[removed] = np.arange(len(removed) - 1, -1, -1, dtype=np.int32)
            own, counts, near = place[packed.numbers(r["own"])], packed.numbers(r["counts"]), place[packed.numbers(r["near"])]
            if not edgewise:
                key = np.repeat(np.arange(len(own)), counts) << 32 | near
                key.sort()
                near = (key & 0xFFFFFFFF).astype(np.int32)
            ends = np.cumsum(counts)
            block = own // size
            for b in np.unique(block).tolist():
                rows = np.flatnonzero(block == b)
                lists = np.concatenate([near[ends[k] - counts[k] : ends[k]] for k in rows])
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([b], pa.int32()), "own": _binary(own[rows]), "counts": _binary(counts[rows]),
                    "near": _binary(lists) if edgewise else _coded(lists, counts[rows]),
                })

    return run


def _dealt(groups: int, edgewise: bool):
    """Parts of one block after another to a row for each group: all its vertices in order (those without a neighbour left out) with their
    degrees and earlier neighbours, and for the group's own vertices all neighbours in the order of addition. All groups are sent the
    earlier neighbours, so they are coded, as long as their order (edgewise) does not matter."""

    def out(block: int, parts: list) -> Iterator[pa.RecordBatch]:
        own, counts = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        starts = np.cumsum(counts) - counts
        near = np.concatenate([p[2] for p in parts])
        by = np.argsort(own)
        lists = [near[starts[k] : starts[k] + counts[k]] for k in by.tolist()]
        own, counts = own[by], counts[by]
        early = [x[x < t] for x, t in zip(lists, own.tolist())]
        before, early = np.array([len(x) for x in early]), np.concatenate(early)
        head = {
            "block": pa.array([block], pa.int32()), "own": _binary(own), "counts": _binary(counts), "before": _binary(before),
            "early": _binary(early) if edgewise else _coded(early, before),
        }
        for g in range(groups):
            rows = np.flatnonzero(own % groups == g)
            mine = np.concatenate([np.sort(lists[k]) for k in rows]) if len(rows) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), **head, "near": _coded(mine, counts[rows])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for r in packed.rows_of(batches):
            if parts and r["block"].as_py() != block:
                yield from out(block, parts)
                parts = []
            block, own, counts = r["block"].as_py(), packed.numbers(r["own"]), packed.numbers(r["counts"])
            parts.append((own, counts, packed.numbers(r["near"]) if edgewise else _decoded(r["near"], counts)))
        if parts:
            yield from out(block, parts)

    return run


class _Forest:
    """Components of the vertices added so far, and each addition's parent snapshot."""

    def __init__(self, n: int):
        self.label, self.last, self.parent = np.arange(n), np.arange(n), np.full(n, -1, np.int32)
        self.held = {}

    def add(self, t: int, near: np.ndarray) -> None:
        label = self.label
        roots = label[near]
        roots = roots[:1] if (roots == roots[0]).all() else np.unique(roots)
        self.parent[self.last[roots]] = t
        parts = [(r, self.held.pop(r, None)) for r in roots.tolist()]
        size = lambda p: 1 if p[1] is None else sum(map(len, p[1]))
        big = parts[0] if len(parts) == 1 else max(parts, key=size)
        root, held = big[0], big[1] or [np.array([big[0]])]
        for r, h in parts:
            if r != root:
                for part in h or [np.array([r])]:
                    label[part] = root
                    held.append(part)
        label[t] = root
        if len(held) > 64:
            held = [np.concatenate(held)]
        held.append(np.array([t]))
        self.held[root], self.last[root] = held, t


def _gains(n: int, groups: int, edgewise: bool):
    """A group's blocks, in order, to its part of the additions' gains.

    ``around`` is twice the degrees of the present neighbours of each of the group's own neighbours of the vertex added, and one for
    every such neighbour that is one of the added vertex's too. ``edgewise`` keeps the single terms as well: there the neighbours' degrees
    grow one after the other, in the order of their ids, which counts an edge between two of them once, with its full weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, whole, near_of, forest, g = np.zeros(n, np.int64), np.zeros(n, np.int64), {}, None, None
        for r in packed.rows_of(batches):
            if g is None:
                g = r["g"].as_py()
                forest = _Forest(n) if g == 0 else None
            own, counts, before = (packed.numbers(r[c]) for c in ("own", "counts", "before"))
            early = packed.numbers(r["early"]) if edgewise else _decoded(r["early"], before)
            near = _decoded(r["near"], counts[own % groups == g])
            whole[own] = counts
            at = 0
            for k in np.flatnonzero(own % groups == g).tolist():
                near_of[int(own[k])] = near[at : at + counts[k]].astype(np.int64)
                at += counts[k]
            m = len(own)
            twice, cubes, fulls = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            terms, present = [], []
            start = np.concatenate([[0], np.cumsum(before)]).tolist()
            for j, t in enumerate(own.tolist()):
                x = early[start[j] : start[j + 1]]
                k = len(x)
                if k:
                    if forest is not None:
                        a, w = d[x], whole[x]
                        cubes[j] = k**3 + (3 * a * (a + 1) + 1).sum() - 2 * k * (a + 1).sum()
                        fulls[j] = k * int(whole[t]) ** 2 + (w * (w - 2 * whole[t])).sum()
                        forest.add(t, x)
                    mine = np.flatnonzero(x % groups == g)
                    if edgewise:
                        done, fresh = 0, len(terms)
                        for p in mine.tolist():
                            d[x[done:p]] += 1
                            v, done = int(x[p]), p
                            have = int(d[v])
                            terms.append(int(d[near_of[v][:have]].sum()))
                            present.append(have)
                        d[x[done:]] += 1
                        twice[j] = 2 * sum(terms[fresh:])
                    else:
                        haves, total = d[x[mine]].tolist(), 0
                        d[x] += MARK
                        for v, have in zip(x[mine].tolist(), haves):
                            s = int(d[near_of[v][:have]].sum())
                            total += 2 * (s & (MARK - 1)) + (s >> 40)
                        twice[j] = total
                        d[x] += 1 - MARK
                    d[t] = k
            row = {"g": pa.array([g], pa.int32()), "block": pa.array([r["block"].as_py()], pa.int32()), "own": _binary(own), "before": _binary(before)}
            row |= {"around": _binary(twice, np.int64), "cubes": _binary(cubes, np.int64), "fulls": _binary(fulls, np.int64)}
            yield pa.RecordBatch.from_pydict(row | {"terms": _binary(np.array(terms), np.int64), "present": _binary(np.array(present)), "early": _binary(early if edgewise and not g else [])})
        if forest is not None:  # block -1: the parents
            empty = dict.fromkeys(("before", "around", "cubes", "fulls", "terms", "present", "early"), pa.array([b""], pa.binary()))
            yield pa.RecordBatch.from_pydict({"g": pa.array([0], pa.int32()), "block": pa.array([-1], pa.int32()), "own": _binary(forest.parent), **empty})

    return run


def _summed(n: int):
    """All groups' gains, and a row of block -2 with the removal order and the components, to the snapshots' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deg, q, full, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for r in packed.rows_of(batches):
            block, own = r["block"].as_py(), packed.numbers(r["own"])
            if block == -2:
                i, label = own[::-1], packed.numbers(r["before"])
            elif block == -1:
                parent[:] = own
            else:
                q[own] -= packed.numbers(r["around"], np.int64)
                if r["g"].as_py() == 0:
                    deg[own] = packed.numbers(r["before"])
                    q[own] += packed.numbers(r["cubes"], np.int64)
                    full[own] = packed.numbers(r["fulls"], np.int64)
        size, pairs = np.ones(n, np.int64), 2 * deg
        sums = [x.tolist() for x in (size, pairs, q, full)]
        ups = parent.tolist()
        for s, up in enumerate(ups):  # children stand before their parent
            if up >= 0:
                for x in sums:
                    x[up] += x[s]
        size, used, tin, free = sums[0], [0] * n, [0] * n, 0
        for s in range(n - 1, -1, -1):
            up = ups[s]
            if up < 0:
                tin[s], free = free, free + size[s]
            else:
                tin[s] = tin[up] + 1 + used[up]
                used[up] += size[s]
        component = label[i].astype(np.int64)
        sid = pd.Series(component).groupby(component, sort=False).cumcount().to_numpy()
        out = pd.DataFrame({
            "component": component, "sid": sid, "i": i.astype(np.int64), "deg": deg, "nc": size, "sum_deg": sums[1], "q": sums[2], "q_full": sums[3],
            "parent": np.where(parent >= 0, sid[parent], -1), "tin": tin, "tout": np.array(tin) + np.array(size) - 1, "at": np.arange(n), "up": parent,
        })
        yield from pa.Table.from_pandas(out, preserve_index=False).to_batches(100_000)

    return run


def replayed(own: DataFrame, plain: DataFrame, n_edges: int, edgewise: bool = False) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Snapshots by vertex number (``_ROWS``), the numbers ``(node, i)``, and blocks with gains; of a proper graph."""
    ids = packed.numbered(own)
    n = ids.count()
    parts = packed.pieces(ids, plain, n_edges)
    order = materialise(parts.coalesce(1).mapInArrow(_order(n, 2 * n_edges), "removed binary, label binary, repeats boolean"), "replay-order")
    if order.first()["repeats"]:
        return None
    size = max(1, n * packed.PIECE // (2 * n_edges))  # vertices of a block
    lists = parts.select("own", "counts", "near").crossJoin(F.broadcast(order.select("removed"))).mapInArrow(_renumbered(size, edgewise), _LISTS)
    lists = lists.repartition(-(-n // size), "block").sortWithinPartitions("block").mapInArrow(_dealt(GROUPS, edgewise), _DEALT)
    gains = materialise(lists.repartitionById(GROUPS, "g").sortWithinPartitions("block").mapInArrow(_gains(n, GROUPS, edgewise), _GAINS), "replay-gains")
    none = F.lit(b"")
    last = order.select(F.lit(-1).alias("g"), F.lit(-2).alias("block"), F.col("removed").alias("own"), F.col("label").alias("before"),
        *(none.alias(c) for c in ("around", "cubes", "fulls", "terms", "present", "early")))
    sums = gains.withColumns({"terms": none, "present": none, "early": none}).unionByName(last).coalesce(1)
    return materialise(sums.mapInArrow(_summed(n), _ROWS), "replay-rows"), ids, gains


def named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Vertex numbers of ``rows`` as ids."""
    rows = rows.join(ids, "i").drop("i").withColumnRenamed("component", "i")
    return rows.join(ids.withColumnRenamed("node", "component"), "i").drop("i")


def _forest_row(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    f = pd.concat(list(batches), ignore_index=True).sort_values("at")
    yield pd.DataFrame({c: [f[c].to_numpy(np.int64).tobytes()] for c in ("component", "nc", "q", "up", "tin")})


def _best_of_block(eps: float):
    """A block's additions, edge by edge, to the best set of each component within it: the first of the greatest score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["g"] < 0].iloc[0]
        own, before, early = (np.frombuffer(head[c], np.int32) for c in ("own", "before", "early"))
        component, nc, q, up, tin = (np.frombuffer(head[c], np.int64) for c in ("component", "nc", "q", "up", "tin"))
        around, a = np.zeros(len(early), np.int64), np.zeros(len(early), np.int64)
        for r in pdf[pdf["g"] >= 0].itertuples():
            mine = early % GROUPS == r.g
            around[mine], a[mine] = np.frombuffer(r.terms, np.int64), np.frombuffer(r.present, np.int32)
        below = np.lexsort((tin, up))  # snapshots by parent, then place
        first = np.searchsorted(up[below], np.stack([own, own + 1])).T.tolist()
        best: dict[int, tuple] = {}
        start = np.concatenate([[0], np.cumsum(before)]).tolist()
        for j, t in enumerate(own.tolist()):
            lo, k = start[j], int(before[j])
            x, b, s = early[lo : lo + k], a[lo : lo + k], around[lo : lo + k]
            i = np.arange(k)
            grow = i * (2 * i + 1) - 2 * (np.cumsum(b + 1) - b - 1) + b * (2 * b + 1) - 2 * s + (i - b) ** 2
            size = np.zeros(k, np.int64)
            kids = below[first[j][0] : first[j][1]]
            joined, at = np.unique(np.searchsorted(tin[kids], tin[x], "right") - 1, return_index=True)
            size[at] = nc[kids[joined]]
            grow[at] += q[kids[joined]]
            score = np.concatenate([[1], 1 + np.cumsum(size)]) / (np.concatenate([[0], np.cumsum(grow)]) + eps)
            m, c = int(score.argmax()), int(component[t])
            if c not in best or score[m] > best[c][0]:
                held = kids[joined[at < m]]
                best[c] = float(score[m]), 1 + int(nc[held].sum()), t, np.append(tin[held], tin[t]), np.append(tin[held] + nc[held] - 1, tin[t])
        rows = [(c, *b) for c, b in best.items()]
        return pd.DataFrame(rows, columns=["component", "score", "size", "t", "lo", "hi"])

    return run


def best_by_edge(own: DataFrame, plain: DataFrame, n_edges: int, eps: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The best sets as intervals ``(component, score, size, tin, tout)``, snapshots and vertex numbers, of a proper graph: the terms of single
    edges, then blocks on their own with the forest at hand."""
    found = replayed(own, plain, n_edges, edgewise=True)
    if found is None:
        return None
    rows, ids, gains = found
    forest = materialise(rows.select("at", "component", "nc", "q", "up", "tin").coalesce(1).mapInPandas(_forest_row, "component binary, nc binary, q binary, up binary, tin binary"), "replay-forest")
    head = gains.where("g = 0 AND block >= 0").select(F.lit(-1).alias("g"), "block", "own", "before", "early").crossJoin(F.broadcast(forest))
    terms = gains.where("block >= 0").select("g", "block", "terms", "present")
    both = head.unionByName(terms, allowMissingColumns=True)
    tops = both.groupBy("block").applyInPandas(_best_of_block(eps), "component bigint, score double, size bigint, t bigint, lo array<bigint>, hi array<bigint>")
    alone = rows.where("nc = 1 AND up < 0").select("component", F.lit(1.0 / eps).alias("score"), F.lit(1).cast("bigint").alias("size"), F.col("at").alias("t"), F.array("tin").alias("lo"), F.array("tin").alias("hi"))
    tops = materialise(tops.unionByName(alone), "replay-tops")
    first = F.max(F.struct("score", (-F.col("t")).alias("later"))).alias("m")
    top = tops.groupBy("component").agg(first).select("component", (-F.col("m.later")).alias("t"))
    spans = tops.join(top, ["component", "t"]).select("component", "score", "size", F.explode(F.arrays_zip("lo", "hi")).alias("span"))
    spans = spans.select("component", "score", "size", F.col("span.lo").alias("tin"), F.col("span.hi").alias("tout"))
    return spans, rows, ids
