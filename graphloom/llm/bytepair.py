"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Pre-tokenisation without regex. The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is read as an automaton over classes of code points: letter, number, other, space that joins what follows, last white
space before something else, other white space, apostrophe that opens a contraction of two or three characters (all told
from the code point and its neighbours, as arrays). A character is then a function from state to state. These functions
compose associatively, so the states of all places come from a blocked prefix scan over a table of compositions, a slice
of many texts at once; a place is a boundary by its symbol and the state before it.

The slices between boundaries are merged by rank, lowest first and leftmost of equals, through a bounded
cache, all new pieces of a slice together, as a matrix. ``encode``
keeps for each token the byte at which it starts; ``decode`` joins the tokens' bytes.

Defined results: a null text is encoded as an empty one, without tokens. Texts are encoded whole. Bytes that are not UTF-8
count as U+FFFD. Repeated rows give equal results. Rows whose ids are null or hold a null or unknown id decode to null.
Columns that are there already, of any name, stay. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from graphloom.llm.common import extended, map_arrow, named, slices, table

#: Text that is cut into pieces at a time, and the length beyond which a text is itself cut at white space.
SLICE_BYTES = 400_000
#: Pieces whose merges are remembered, and the longest that is.
CACHE_PIECES, CACHE_BYTES = 200_000, 64
#: New pieces that are merged together, and the rank of a pair that is no token.
MERGE_ROWS, NO_RANK = 4_096, 2**31 - 1

LETTER, NUMBER, OTHER, SPACES, LAST, JOINED, SHORT, LONG, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_JOINED, ONE_LEFT, TWO_LEFT = range(8)

# The white space of \s besides U+2000 to U+200A.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Letters and numbers of Unicode 16.0, which the pattern's \p{L} and \p{N} follow, that 15.1 has not.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES for each code point."""
    by = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*WHITE, *range(0x2000, 0x200B)]] = SPACES
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for lo, hi in ranges:
            out[lo : hi + 1] = kind
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state behind a symbol, and whether a piece begins with it."""
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS, SPACES: IN_SPACES}
    if symbol in run and (state == run[symbol] or state == AFTER_JOINED and symbol != SPACES):
        return run[symbol], False
    if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (FRESH if state == ONE_LEFT else ONE_LEFT), False
    after = {LAST: IN_SPACES, JOINED: AFTER_JOINED, SHORT: ONE_LEFT, LONG: TWO_LEFT, END: FRESH}
    return after.get(symbol, run.get(symbol)), True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, compositions (first, then second, flat), states by function and state before, beginnings
    by symbol and state before."""
    gen = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    functions = list(dict.fromkeys(gen))
    place = {f: i for i, f in enumerate(functions)}
    for f in functions:  # grows while it is read, until no composition is new
        for g in gen:
            h = tuple(g[s] for s in f)
            if h not in place:
                place[h] = len(functions)
                functions.append(h)
    compose = np.array([[place[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(s, c)[1] for s in range(8)] for c in range(9)])
    return np.array([place[g] for g in gen], np.uint16), compose.ravel(), np.array(functions, np.uint8), begins


def _compositions(f: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of an array of functions: within blocks, over the blocks' totals, and put together."""
    compose = _automaton()[1]
    many = np.uint16(round(len(compose) ** 0.5))
    n = len(f)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = f
    steps = np.ascontiguousarray(padded.reshape(rows, width).T)
    for k in range(1, width):
        steps[k] = compose[steps[k - 1] * many + steps[k]]
    if rows > 1:
        before = _compositions(steps[-1], width)[:-1]
        steps[:, 1:] = compose[before[None, :] * many + steps[:, 1:]]
    return steps.T.ravel()[:n]


def symbols(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``ends``: the places of the separators behind the texts."""
    kind = classes()[code]
    kind[ends] = END
    after = np.append(kind[1:], np.uint8(END))
    white = kind == SPACES
    last = white & (after != SPACES) & (after != END)
    kind[last] = LAST
    kind[last & (code == 32)] = JOINED
    mark = np.flatnonzero(code == 39)
    mark = mark[kind[mark] != END]
    one, two = (np.append(code, np.zeros(2, code.dtype))[mark + k] for k in (1, 2))
    kind[mark[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]
    kind[mark[(one < 256) & (two < 256) & np.isin(one << 8 | two, pairs)]] = LONG
    return kind


def beginnings(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece (or a separator) begins at each code point."""
    gen, _, states, begins = _automaton()
    symbol = symbols(code, ends)
    after = states[_compositions(gen[symbol]), FRESH]
    return begins[symbol, np.append(np.uint8(FRESH), after[:-1])]


def windows(text: str, size: int = SLICE_BYTES) -> list[str]:
    """A long text cut where white space follows something else, as a piece ends there whatever comes before or after."""
    out, lo = [], 0
    kind = None
    while len(text) - lo > size:
        if kind is None:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = classes()[code] == SPACES
            cuts = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
        k = np.searchsorted(cuts, lo + size)
        if k == len(cuts):
            break
        out.append(text[lo : cuts[k]])
        lo = int(cuts[k])
    return [*out, text[lo:]]


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of some texts in their order, and how many each text has."""
    raw = b"\0".join([t.encode("utf-8", "replace") for t in texts]) + b"\0"
    joined = raw.decode("utf-8")
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    at = np.flatnonzero(beginnings(code, ends))
    if len(raw) == len(code):
        byte = at
    else:
        wide = np.zeros(len(code) + 1, np.int64)
        np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000), out=wide[1:])
        byte = wide[at]
    is_end = np.zeros(len(code), bool)
    is_end[ends] = True
    own = ~is_end[at]
    starts, stops = byte[own[: len(byte)]], np.append(byte[1:], len(raw))[own]
    count = np.diff(np.concatenate([[0], np.searchsorted(at[own], ends)]))
    return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())], count


class Merges(dict):
    """Piece -> ids, as the bytes of int32. The new pieces of a slice are merged together by ``learn``."""

    def __init__(self, tokens: tuple[bytes, ...]):
        super().__init__()
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for whole, rank in self.ranks.items():
            for k in range(1, len(whole)):
                if (a := self.ranks.get(whole[:k])) is not None and (b := self.ranks.get(whole[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([*(pairs[k] for k in self.pair_keys.tolist()), NO_RANK], np.int32)

    def __missing__(self, piece: bytes) -> bytes:
        """Long pieces, which are not kept."""
        return np.array(merge(piece, self.ranks), np.int32).tobytes()

    def learn(self, found: list[bytes]) -> None:
        """Takes in all pieces of up to CACHE_BYTES bytes."""
        if len(self) >= CACHE_PIECES:
            self.clear()
        new = {p for p in set(found).difference(self) if len(p) <= CACHE_BYTES}
        split = sorted(new.difference(self.ranks), key=len)
        for p in new.intersection(self.ranks):
            self[p] = self.ranks[p].to_bytes(4, sys.byteorder)
        for lo in range(0, len(split), MERGE_ROWS):
            part = split[lo : lo + MERGE_ROWS]
            ids, n = self.merged(part)
            flat, stop = ids.tobytes(), (4 * np.cumsum(n)).tolist()
            self.update(zip(part, [flat[a:b] for a, b in zip([0, *stop], stop)]))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours; NO_RANK if it is no token or a side is missing (negative)."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK) if len(self.pair_keys) else np.full(len(a), NO_RANK, np.int32)

    def merged(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of similar length, and how many each has: every round merges in each piece the adjacent pair
        of least rank, the leftmost of equals. A row of the matrix is a piece; merged places are skipped by links."""
        rows, size = len(part), np.fromiter(map(len, part), np.int64, len(part))
        width = int(size.max()) + 2  # an empty place before and at least one behind
        ids = np.full((rows, width), -1, np.int32)
        inside = np.arange(width - 1)[None, :] < size[:, None]
        ids[:, 1:][inside] = self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]
        rank = np.full((rows, width), NO_RANK, np.int32)
        flat_ids, flat = ids.ravel(), rank.ravel()
        left = np.flatnonzero((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0))
        left = left // (width - 1) * width + left % (width - 1)
        flat[left] = self.rank_of(flat_ids[left], flat_ids[left + 1])
        behind, before = np.arange(1, rows * width + 1), np.arange(-1, rows * width - 1)
        live = np.arange(rows)
        while len(live):
            at = rank[live].argmin(1) + live * width
            go = flat[at] < NO_RANK
            live, at = live[go], at[go]
            gone = behind[at]
            after, prior = behind[gone], before[at]
            flat_ids[at], flat_ids[gone] = flat[at], -1
            flat[gone] = NO_RANK
            behind[at], before[after] = after, at
            flat[at] = self.rank_of(flat_ids[at], flat_ids[after])
            flat[prior] = self.rank_of(flat_ids[prior], flat_ids[at])
        kept = ids >= 0
        return ids[kept], kept.sum(1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece of any length, in n log n steps: a linked list of parts and a heap of (rank, place)."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    stop, before, here = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = stop[i]
        if j < n and (r := ranks.get(piece[i : stop[j]])) is not None:
            heapq.heappush(heap, (r, i, stop[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not here[i] or stop[i] >= n or stop[stop[i]] != end:
            continue  # one of its parts has been merged since
        here[stop[i]] = False
        stop[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by id, of a file with a base64 token and its rank on each line; unused ids are empty."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@lru_cache(2)
def _merges(tokens: tuple[bytes, ...]) -> Merges:
    return Merges(tokens)


@lru_cache(2)
def _bytes_of(tokens: tuple[bytes, ...]) -> tuple[pa.Array, np.ndarray]:
    return pa.array([t or None for t in tokens], pa.large_binary()), np.array([len(t) for t in tokens], np.int32)


def encode_slice(texts: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts in their order, and how many each text has."""
    parts = [windows(t) for t in texts]
    long = any(len(p) > 1 for p in parts)
    ids, n = [], []
    for lot in [[p] for q in parts for p in q] if long else [texts]:
        found, count = pieces(lot)
        merges.learn(found)
        lists = list(map(merges.__getitem__, found))
        ids.append(np.frombuffer(b"".join(lists), np.int32))
        size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) // 4])
        n.append(np.diff(size[np.concatenate([[0], np.cumsum(count)])]))
    first = np.cumsum([0, *map(len, parts)])[:-1]
    return np.concatenate(ids), np.add.reduceat(np.concatenate(n), first)


def encode(docs: DataFrame, tokens: list[bytes], text: str = "text", ids: str = "ids", starts: str = "starts") -> DataFrame:
    """``docs`` with the token ids of ``text`` and the byte at which each token starts, behind its own columns.

    ``tokens`` (``read_ranks``) are broadcast: a vocabulary, bounded by its file, not by the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tokens))
    names = docs.columns
    at = names.index(text)
    schema = extended(docs.schema.fields, **{ids: ArrayType(IntegerType()), starts: ArrayType(IntegerType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared.value)
        size = np.array([len(t) for t in shared.value], np.int64)
        for b in batches:
            raw = b.column(at).cast(pa.binary())
            for lo, hi in slices(raw, SLICE_BYTES):
                texts = [(t or b"").decode("utf-8", "replace") for t in raw.slice(lo, hi - lo).to_pylist()]
                flat, n = encode_slice(texts, merges)
                offsets = np.concatenate([[0], np.cumsum(n)])
                upto = np.concatenate([[0], np.cumsum(size[flat])])
                begin = upto[:-1] - np.repeat(upto[offsets[:-1]], n)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (flat, begin)]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=schema.names)

    return map_arrow(docs, run, schema)


def decode(rows: DataFrame, tokens: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for behind its own columns."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(tokens))
    at = rows.columns.index(ids)
    schema = extended(rows.schema.fields, **{out: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False))])
            lo = 0
            while lo < b.num_rows:  # as many rows at a time as hold SLICE_BYTES tokens
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, joined(part.column(at), offsets[lo : hi + 1] - offsets[lo])], names=schema.names)
                lo = hi

    def joined(column: pa.Array, offsets: np.ndarray) -> pa.Array:
        known, size = _bytes_of(shared.value)
        flat = pc.list_flatten(column)
        ok = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(size))), False).to_numpy(zero_copy_only=False)
        place = np.where(ok, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), 0).astype(np.int32)
        bad = np.concatenate([[0], np.cumsum(~ok | (size[place] == 0))])
        none = column.is_null().to_numpy(zero_copy_only=False) | (np.diff(bad[offsets]) > 0)
        data = known.take(pa.array(place)).buffers()[2] if len(place) else pa.py_buffer(b"")
        upto = np.concatenate([[0], np.cumsum(size[place], dtype=np.int64)])[offsets]
        return pa.Array.from_buffers(pa.binary(), len(column), [pa.array(~none).buffers()[1], pa.py_buffer(upto.astype(np.int32)), data])

    return map_arrow(rows, run, schema)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, tokens).select("doc_id", "ids")
    return decode(coded, tokens).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(named("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
