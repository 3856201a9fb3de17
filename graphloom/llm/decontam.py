"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared as sequences of words (lower-cased runs of letters and digits). An
item of m words may differ from a passage in k = floor(m * (1 - SIMILARITY)) word edits. Cut into k + 1
pieces, at least one piece of it then stands unchanged in the passage; every exact piece hit is looked up
by a rolling hash, and the passage around it is verified with Myers' bit-parallel edit distance, one bit
for each word of the item.

A piece that many items share (a prompt that they open with) is not looked up for each of them. Of any k + 3 other words of the
item at least 3 must stand unchanged as well, so such an item is filed under the piece together with each of its k + 3 words
that fewest items have; a text that holds the piece asks with its own words and gets the items that it can match.

The test set is the stated query set: it is read in blocks, and packed blocks of up to ``SCAN_BYTES`` are broadcast and held
against all documents in one scan, so neither side is shuffled. A Python worker prepares them once for all its tasks, and a
text is cut into words once for all items. A larger test set takes another scan for each so many bytes.

Defined results: null and empty texts match nothing, nor do items without a word. Items of so few words that no edit is
allowed (fewer than 5) match where they stand exactly. Of overlapping passages that match one item, the one with the fewest
edits is reported (the first of equals). Repeated rows are reported for each row; repeated items for each item id.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import free_names, map_arrow, named, slices, table

SIMILARITY = 0.8
BLOCK_ITEMS = 5_000
SLICE_BYTES = 4_000_000
#: Packed items to a scan.
SCAN_BYTES = 50_000_000
#: A piece of more items than this is looked up together with another word.
SHARED = 8
#: So many words beside a shared piece must stand unchanged too (fewer if the item has fewer than its budget and these).
WITNESSES = 3
#: Items whose bits are kept for the verification.
KEPT_ITEMS = 20_000

_WORD = re.compile(r"[^\W_]+")
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | bytes | None) -> list[bytes]:
    low = (text if isinstance(text, str) else (text or b"").decode("utf-8", "replace")).lower()
    raw = low.encode("utf-8", "replace")
    return raw.translate(_SPACES).split() if len(raw) == len(low) else [w.encode("utf-8", "replace") for w in _WORD.findall(low)]


def budget(m: int, similarity: float = SIMILARITY) -> int:
    return int(m * (1 - similarity) + 1e-9)


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """Start and end of k + 1 near-equal pieces of m words."""
    cut = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(cut[:-1], cut[1:]))


def myers(pattern: dict[int, int], m: int, text: list[int]) -> list[int]:
    """Edits of the whole pattern against the best passage that ends at each symbol of ``text``.

    ``pattern``: for each symbol, the bits of its places among the m of the pattern.
    """
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = ones, 0, m, []
    for c in text:
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
        out.append(score)
    return out


def bits_of(symbols: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(symbols):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The pieces of items, ready to be held against texts."""

    def __init__(self, items: Iterable[tuple[object, str]], similarity: float = SIMILARITY):
        self.vocab: dict[bytes, int] = {}
        self.ids: list[object] = []
        words, size, rows = array("i"), [0], []
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            for a, b in pieces(len(w), budget(len(w), similarity)):
                rows.append((b - a, self._hash(np.array(ids[a:b], np.uint64), b - a)[0], len(self.ids), a))
            self.ids.append(item_id)
            words.extend(ids)
            size.append(len(words))
        self.words, self.first, self.similarity = np.frombuffer(words, np.int32) if words else np.zeros(0, np.int32), size, similarity
        self.kept: dict[int, tuple] = {}
        many = np.bincount(self.words, minlength=len(self.vocab) + 1)
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {r[0] for r in rows}:
            own = sorted((r[1:] for r in rows if r[0] == n), key=lambda r: r[0])
            keys, item, offset = np.array([r[0] for r in own], np.uint64), np.array([r[1] for r in own]), np.array([r[2] for r in own])
            self.by_len[n] = keys, item, offset, *self._filed(n, keys, item, offset, many)

    def _filed(self, n: int, keys: np.ndarray, item: np.ndarray, offset: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of shared pieces ``(first row << 32 | word, row)``, sorted, and for each row how many of its words must be found."""
        cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        need, pairs = np.zeros(len(keys), np.int64), []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for r in range(lo, hi) if hi - lo > SHARED else ():
                w = self.words[self.first[item[r]] : self.first[item[r] + 1]]
                k = budget(len(w), self.similarity)
                rest = np.concatenate([w[: offset[r]], w[offset[r] + n :]])
                if len(rest) > k:
                    need[r] = min(WITNESSES, len(rest) - k)
                    pairs += [(lo << 32 | x, r) for x in rest[np.argsort(many[rest], kind="stable")[: k + need[r]]].tolist()]
        pairs.sort()
        return np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64), need

    def _item(self, i: int) -> tuple[object, int, int, dict[int, int], dict[int, int]]:
        """Id, words, budget, and the bits of the words forward and backward."""
        if i not in self.kept:
            if len(self.kept) >= KEPT_ITEMS:
                self.kept.clear()
            w = self.words[self.first[i] : self.first[i + 1]].tolist()
            self.kept[i] = self.ids[i], len(w), budget(len(w), self.similarity), bits_of(w), bits_of(w[::-1])
        return self.kept[i]

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for i in range(n):
            h = h * _STEP + ids[i : len(ids) - n + 1 + i] + np.uint64(1)
        return h ^ h >> np.uint64(29)

    def _found(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece length: places of exact hits, and their ranges among the pieces."""
        run = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (keys, *_) in self.by_len.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(run[n:] - run[:-n] == n)  # only where all words occur in some item
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = h * _STEP + ids[at + i].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            hit = hi > lo
            yield n, at[hit], lo[hit], hi[hit]

    def hit_places(self, ids: np.ndarray) -> np.ndarray:
        """Places of exact piece hits."""
        return np.concatenate([np.zeros(0, np.int64), *(f[1] for f in self._found(ids))])

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(item, supposed start of the item)`` of every exact piece hit that can be a match; start may lie before the text."""
        here = None
        for n, at, lo, hi in self._found(ids):
            _, item, offset, filed, rows, need = self.by_len[n]
            asked: dict[int, list[int]] = {}
            for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                if a not in asked:
                    if b - a <= SHARED:
                        asked[a] = list(range(a, b))
                    else:
                        here = np.unique(ids[ids > 0]).astype(np.int64) if here is None else here
                        key = here | a << 32
                        left, right = np.searchsorted(filed, key, "left"), np.searchsorted(filed, key, "right")
                        got = np.bincount(np.concatenate([rows[x:y] for x, y in zip(left, right) if y > x] or [rows[:0]]) - a, minlength=b - a)
                        asked[a] = (a + np.flatnonzero(got >= need[a:b])).tolist()
                for r in asked[a]:
                    yield int(item[r]), p - int(offset[r])

    def match(self, ids: np.ndarray) -> list[tuple[object, int, int, int]]:
        """``(item id, first word, end word, edits)`` of the passages of one text (word ids; 0 is unknown)."""
        around: dict[int, list[int]] = {}
        for item, start in self.hits(ids):
            around.setdefault(item, []).append(start)
        out = []
        for item, starts in around.items():
            item_id, m, k, forward, backward = self._item(item)
            places = sorted(set(starts))
            spans: list[list[int]] = []
            for s in places:  # windows that touch are verified together
                lo, hi = max(0, s - k), min(len(ids), s + m + k)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                text = ids[lo:hi].tolist()
                d = myers(forward, m, text)
                e = 0
                while e < len(d):
                    if d[e] > k:
                        e += 1
                        continue
                    stop = e  # the fewest edits of the run of ends within reach of this one
                    while e < len(d) and e <= stop + m // 2 and (d[e] <= k or e <= stop):
                        if d[e] < d[stop]:
                            stop = e
                        e += 1
                    back = myers(backward, m, text[stop::-1][: m + k])
                    length = min(range(len(back)), key=lambda x: (back[x], x)) + 1
                    out.append((item_id, lo + stop + 1 - length, lo + stop + 1, d[stop]))
        return out


def passages(m: Matcher, texts: pa.Array) -> Iterator[tuple[int, list[tuple[object, int, int, int]]]]:
    """The rows of ``texts`` with an exact piece hit, and their verified passages."""
    get = m.vocab.get
    for lo, hi in slices(texts, SLICE_BYTES):
        part = [words_of(t) for t in texts.slice(lo, hi - lo).to_pylist()]
        codes = np.array([get(w, 0) for p in part for w in (*p, b"")], np.int64)
        ends = np.cumsum([len(p) + 1 for p in part])
        for i in np.unique(np.searchsorted(ends, m.hit_places(codes), "right")).tolist():
            yield lo + i, m.match(codes[ends[i - 1] if i else 0 : ends[i] - 1])


def scans(items: DataFrame, item_id: str, item_text: str, block_items: int) -> Iterator[list[bytes]]:
    """The items in packed blocks, as many as one scan takes."""
    rows = items.select(named(item_id), named(item_text)).where(named(item_text).isNotNull()).toLocalIterator()
    group: list[bytes] = []
    while block := [tuple(r) for r in islice(rows, block_items)]:
        group.append(zlib.compress(pickle.dumps(block), 1))
        if sum(map(len, group)) >= SCAN_BYTES:
            yield group
            group = []
    if group:
        yield group


_READY: dict[str, Matcher] = {}


def _ready(name: str, shared, similarity: float) -> Matcher:
    """The matcher of a scan, prepared once in a Python worker."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Matcher((x for packed in shared.value for x in pickle.loads(zlib.decompress(packed))), similarity)
    return _READY[name]


def matches(docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
            similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, edits)`` of every passage of ``docs`` that matches an item."""
    kind, item_kind = docs.schema[row_id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start_word bigint, end_word bigint, edits int"
    names = ("doc_id", "item_id", "start_word", "end_word", "edits")
    out = None
    source = docs.select(named(row_id).alias("doc_id"), named(text).alias("text"))
    for group in scans(items, item_id, item_text, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(group)  # at most SCAN_BYTES and one block

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _ready(name, shared, similarity)
            for b in batches:
                found = [(b.column(0)[i].as_py(), *x) for i, own in passages(matcher, b.column(1)) for x in own]
                kinds = pa.schema([("doc_id", b.column(0).type), ("item_id", to_arrow_type(item_kind)), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], schema=kinds)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def contaminated(docs: DataFrame, items: DataFrame, flag: str, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with a boolean column ``flag`` behind its own: does the row hold a passage of an item?"""
    names = docs.columns
    out = docs.withColumn(flag, F.lit(False))
    schema = out.schema
    for group in scans(items, item_id, item_text, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _ready(name, shared, similarity)
            for b in batches:
                leak = np.array(b.column(len(names)).to_pylist(), bool)
                leak[[i for i, own in passages(matcher, b.column(names.index(text))) if own]] = True
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(leak)], names=[*names, flag])

        out = map_arrow(out, run, schema)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of an item.

    The matcher is a row filter: no join, so a row without an id is kept or dropped by its own text.
    """
    (flag,) = free_names(docs.columns, "__leak")
    return contaminated(docs, items, flag, text).where(~F.col(flag)).drop(flag)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
