"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has bit b set if more than half of its 3-word shingles' XXH64 hashes have it.
Distinct fingerprints within 3 differing bits are linked. The self-join walks pairs of nodes of a
binary trie together, adds up the bits in which the two paths differ and drops a pair as soon as the
sum exceeds the budget.

To deal the trie out over a cluster, fingerprints that differ in at most 3 of their bits must agree in
one of 4 blocks of them, so each fingerprint goes to 4 groups (block, value) and a group walks the trie
over the remaining bits. A group beyond ``GROUP_ROWS`` is dealt out again by 4 blocks of its remaining
bits, down to groups that are small because few bits remain: nothing is capped or sampled, and no group
is larger than a task can hold. A task reports a spanning forest of the links it found, never all pairs.

Defined results: a null or empty text has the fingerprint zero and links like any other. Repeated rows
are separate members of one group. A null id takes part, but never names a component unless the
component has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import free_names, materialise, named, table
from graphloom.operators.components import component_roots

BUDGET = 3
BLOCKS = BUDGET + 1
SHINGLE = 3
SEED = 42
#: Groups of more distinct fingerprints are dealt out again.
GROUP_ROWS = 2_048
#: Once so few links are left, one task finishes the components.
FINISH_LINKS = 10_000
#: Bound on the candidate pairs that one pass over the trie may hold.
PASS_PAIRS = 4_000_000


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - SHINGLE + 1)
    stop = (start + size)[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), stop.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = h[lo : lo + 65536].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, fp)``: a hash of id and text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fp)], names=["doc_id", "row", "fp"])

    rows = docs.select(named(row_id).alias("doc_id"), F.xxhash64(named(row_id), named(text)).alias("row"), named(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[row_id].dataType.simpleString()}, row bigint, fp bigint")


def trie_pairs(rest: np.ndarray, group: np.ndarray, bits: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within a group whose ``rest`` differs in at most ``budget`` bits.

    Rows are ordered by group, then ``rest`` (unsigned, below 2**bits); each group is the root of a
    trie. All tries are walked level by level, as arrays of node pairs with their differing bits.
    """
    n = len(rest)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    a0, a1 = cut[:-1], cut[1:]
    big = a1 - a0 > 1
    a0, a1 = a0[big], a1[big]
    b0, b1, d = a0, a1, np.zeros(len(a0), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(bits - 1, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((rest >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        other = ~same
        parts = [
            (a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1),
            (am[other], a1[other], b0[other], bm[other], d[other] + 1),
        ]
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts))
        keep = (d <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        a0, a1, b0, b1, d = a0[keep], a1[keep], b0[keep], b1[keep], d[keep]
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(rest[i] ^ rest[j]) <= budget
            found.append((i[near], j[near]))
            a0, a1, b0, b1, d = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], d[~leaf]
    if len(a0):  # ends of the tries: all bits used, several equal rows
        for x0, x1, y0, y1 in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
            i, j = np.meshgrid(np.arange(x0, x1), np.arange(y0, y1), indexing="ij")
            up = (i < j).ravel() if (x0, x1) == (y0, y1) else slice(None)
            found.append((i.ravel()[up], j.ravel()[up]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the least row that the pairs connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows ``(key, bits, rest, fp)`` of whole groups in; spanning links of each group out."""

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, rest, fp = rows["key"].to_numpy(), rows["rest"].to_numpy().view(np.uint64), rows["fp"].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        cost = np.cumsum(np.diff(cut).astype(np.int64) ** 2)
        piece = (cost - 1) // PASS_PAIRS
        for p in np.unique(piece):
            which = np.flatnonzero(piece == p)
            lo, hi = cut[which[0]], cut[which[-1] + 1]
            i, j = trie_pairs(rest[lo:hi], key[lo:hi], int(rows["bits"].iloc[lo:hi].max()))
            if len(i):
                part = fp[lo:hi]
                near = np.bitwise_count(part[i].view(np.uint64) ^ part[j].view(np.uint64)) <= BUDGET
                root = forest(hi - lo, i[near], j[near])
                at = np.flatnonzero(root != np.arange(hi - lo))
                yield pd.DataFrame({"src": part[at], "dst": part[root[at]]})

    held = None
    for b in batches:
        rows = b if held is None else pd.concat([held, b], ignore_index=True)
        key = rows["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last >= 50_000:
            yield from links(rows.iloc[:last].reset_index(drop=True))
            rows = rows.iloc[last:].reset_index(drop=True)
        held = rows
    if held is not None and len(held):
        yield from links(held)


def deal(rows: DataFrame, bits: int) -> DataFrame:
    """Each row ``(key, rest, fp)`` to its BLOCKS groups by a block of ``rest``; ``rest`` loses that block."""
    base, more = divmod(bits, BLOCKS)
    parts, low = [], 0
    for k in range(BLOCKS):
        width = base + (k < more)
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if low + width < 64 else F.lit(0).cast("bigint")
        left = high.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))
        parts.append(F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), F.lit(bits - width).alias("bits"), left.alias("rest")))
        low += width
    return rows.select(F.explode(F.array(*parts)).alias("g"), "fp").select("g.key", "g.bits", "g.rest", "fp")


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links ``(src, dst)`` between the distinct fingerprints ``fp``."""
    out = None
    bits, rows = 64, distinct.select(F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("rest"), "fp")
    while True:
        dealt = deal(rows, bits)
        hot = None
        if 2 ** (bits - bits // BLOCKS) > GROUP_ROWS:
            sizes = dealt.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS)
            hot = materialise(sizes.select(F.col("key").alias("hot")), "simhash-hot")
            if hot.isEmpty():
                hot = None
        small = dealt if hot is None else dealt.join(hot, dealt["key"] == hot["hot"], "left_anti")
        found = small.repartition("key").sortWithinPartitions("key", "rest").mapInPandas(_join, "src bigint, dst bigint")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out
        again = dealt.join(hot, dealt["key"] == hot["hot"], "left_semi")
        # blocks of unequal width leave differing numbers of bits; the larger number holds for all
        bits = bits - bits // BLOCKS
        rows = materialise(again.select("key", "rest", "fp"), "simhash-again")


def components(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``."""
    fps = materialise(fingerprints(docs, row_id, text).drop("row"), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = component_roots(links(distinct), finish=FINISH_LINKS)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return fps.join(by_fp, fps["fp"] == by_fp["of"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: the least id, then the least text hash, then any of equal rows."""
    fps = materialise(fingerprints(docs, row_id, text), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least"))
    roots = component_roots(links(distinct), finish=FINISH_LINKS)
    first = (
        distinct.join(roots, distinct["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("least").alias("least"))
    )
    i, row, n = free_names(docs.columns, "__id", "__row", "__n")
    first = first.select(F.col("least.doc_id").alias(i), F.col("least.row").alias(row))
    out = docs.withColumn(n, F.xxhash64(named(row_id), named(text)))
    # joined by the hash alone, so that the grouping needs no second shuffle; the ids are compared as well, as hashes may meet
    mine, kept_id = F.struct(named(row_id)), F.struct(F.col(i))  # null ids are equal; written so that the planner makes no join key of it
    same_id = (mine >= kept_id) & (mine <= kept_id)
    kept = out.join(first, (F.col(n) == F.col(row)) & same_id, "left_semi")
    return kept.groupBy(named(row_id).alias(i), n).agg(F.first(F.struct(*(named(c) for c in docs.columns))).alias(row)).select(f"{row}.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
