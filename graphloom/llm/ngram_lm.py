"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: ``p(w | v) = L * c(v w) / c(v) + (1 - L) * p1(w)`` with
``p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))``. The weight L depends on the bucket of the context's
frequency c(v) (its power of two; 0 for unseen contexts). The weights are learnt by
expectation-maximisation: one fold of the training texts is held out, the estimates are taken from the
counts of the other folds, and the weights are those under which the held-out fold is likeliest. Scores
then use the counts of all training texts. The context of a text's first word is the end token.

Counts are exact (up to collisions of hashes wide enough for the corpus) and cover every text, and tokens never become rows.
Each task cuts the rows it reads into blocks of about BLOCK_BYTES of text and writes their words as numbers once; texts
are not shuffled. A block sends the sorted distinct keys of its words and word pairs, with its own counts, to the buckets
of the key range they fall in; a bucket adds them up and sends each block the totals in the same order. Both ways the
arrays travel as differences of sorted numbers in byte planes, compressed. A block then knows the counts of all its words
and pairs. What it stores for each text does not depend on N, V and the weights, so these are put in at the end.

Blocks are sized by bytes of text and buckets by share of the key space, so a frequent word is one key of one bucket,
and any number of equal rows fill blocks like others. An exchange between B blocks and K buckets has B * K rows. Where
that is more than ROWS, blocks send to STEPS wide ranges first, where those of a group of blocks are merged on the way
and split on the way back, which leaves B * STEPS + B * K / GROUP rows.

Defined results: a null text counts as empty and has the end token only. Repeated rows are texts of their
own and count as often as they stand. Without training texts N and V are 0 and only p1 is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import fold, materialise, named, slices, table, total_chars

BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
#: Rows of an exchange without a step between, and beyond it wide ranges, and blocks that are merged.
ROWS, STEPS, GROUP = 4_000_000, 64, 64
#: log2 buckets of context frequencies: 0 (unseen), 1, 2-3, 4-7, ...
CONTEXTS = 48
#: Bins of log2(ratio) in the statistics for EM.
BINS, LEAST_LOG2 = 128 * 32, -64.0
#: Bits of a word's key; a pair's has PAIR_SPARE bits more than the bytes of text have, so that the chance of a
#: false match is the same for every size (below 2**-PAIR_SPARE) and keys are no longer than that needs.
WORD_BITS, PAIR_SPARE = 60, 18


def pack(x: np.ndarray, ordered: bool = False) -> bytes:
    """Unsigned numbers as compressed byte planes, ordered ones as differences."""
    x = x.astype(np.uint64)
    if ordered and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(b: bytes, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ordered else x


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 64 - WORD_BITS


END = _key(b"")  # no word is empty


class Tokens:
    """The tokens of a block of texts, and its distinct words and word pairs by ascending key."""

    def __init__(self, size: np.ndarray, words: np.ndarray, word: np.ndarray, pair_bits: int):
        self.size, self.words, self.word = size, words, word
        self.stop = np.cumsum(size)
        token = words[word]
        first = np.concatenate([[0], self.stop[:-1]]).astype(np.int64)
        before = np.concatenate([[np.uint64(END)], token[:-1]])
        before[first] = END
        pair = (before * np.uint64(0x9E3779B97F4A7C15) ^ token * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD)
        pair = (pair ^ pair >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - pair_bits)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.context = np.concatenate([[0], word[:-1]])
        self.context[first] = np.searchsorted(words, np.uint64(END))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, self.size)

    @staticmethod
    def read(block: dict, pair_bits: int) -> Tokens:
        return Tokens(unpack(block["sizes"]).astype(np.int64), unpack(block["words"], True), unpack(block["word"]).astype(np.int64), pair_bits)


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, the distinct keys of the words, and each token's place among them."""
    lists = [(t or b"").lower().split() for t in texts]
    size = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
    flat = pa.array([w for x in lists for w in (*x, b"")], pa.large_binary()).dictionary_encode()
    keys = np.fromiter((_key(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    words, place = np.unique(keys, return_inverse=True)
    return size, words, place[flat.indices.to_numpy()]


_FLAGS = ("held_out", "train", "deleted")
_BLOCK = "block bigint, doc_id array<{id}>, held_out array<boolean>, train array<boolean>, deleted array<boolean>, sizes binary, words binary, word binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows into blocks, numbered within the task."""
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    rows: list[pa.RecordBatch] = []
    space = 0

    def block() -> pa.RecordBatch:
        nonlocal held, rows, space, number
        words = np.unique(np.concatenate([w for _, w, _ in held]))
        word = np.concatenate([np.searchsorted(words, w)[at] for _, w, at in held])
        lists = [pa.ListArray.from_arrays(pa.array([0, sum(len(r) for r in rows)], pa.int32()), pa.concat_arrays([r.column(c) for r in rows])) for c in ("doc_id", *_FLAGS)]
        packed = [pa.array([x], pa.binary()) for x in (pack(np.concatenate([n for n, _, _ in held])), pack(words, True), pack(word))]
        out = pa.RecordBatch.from_arrays([pa.array([task << 24 | number], pa.int64()), *lists, *packed], names=["block", "doc_id", *_FLAGS, "sizes", "words", "word"])
        held, rows, space, number = [], [], 0, number + 1
        return out

    for b in batches:
        for lo, hi in slices(b.column("text"), min(BLOCK_BYTES, 4_000_000)):
            part = b.slice(lo, hi - lo)
            held.append(words_of(part.column("text").cast(pa.binary()).to_pylist()))
            rows.append(part.select(["doc_id", *_FLAGS]))
            space += part.column("text").nbytes
            if space >= BLOCK_BYTES:
                yield block()
    if held:
        yield block()


def edges(buckets: int, bits: int) -> np.ndarray:
    """Lower bounds of the key ranges."""
    return np.array([(i << bits) // buckets for i in range(buckets)], np.uint64)


_KEYS = ("k1", "f1", "g1", "k2", "f2", "g2")
_TOLD = ("f1", "g1", "f2", "g2")


def _send(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, bits: int) -> dict[int, list[bytes]]:
    """For each bucket of the key space, what falls into it of (keys, counts, counts without the deleted) of words and of pairs."""
    rows: dict[int, list[bytes]] = {}
    for kind, (keys, full, rest, width) in enumerate(((*parts[0], WORD_BITS), (*parts[1], bits))):
        cut = np.append(np.searchsorted(keys, edges(buckets, width)), len(keys))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            at = slice(cut[b], cut[b + 1])
            rows.setdefault(b, [pack(keys[:0])] * 6)[kind * 3 : kind * 3 + 3] = [pack(keys[at], True), pack(full[at]), pack(rest[at])]
    return rows


def _requests(buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                t = Tokens.read(block, bits)
                train = t.per_text(np.array(block["train"], bool))
                tuned = train & t.per_text(np.array(block["deleted"], bool))
                parts = []
                for keys, of in ((t.words, t.word), (t.pairs, t.pair)):
                    full = np.bincount(of, train, len(keys))
                    parts.append((keys, full, full - np.bincount(of, tuned, len(keys))))
                rows = _send(parts, buckets, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.int32()), pa.array([block["block"]] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(6))],
                    names=["bucket", "from", *_KEYS],
                )

    return run


def _merged(rows: pa.Table, n: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different keys of kind ``n`` of some rows, for each key of each row its place among them, and where rows begin."""
    keys = [unpack(x, True) for x in rows.column("k" + n).to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, where, np.concatenate([[0], np.cumsum([len(k) for k in keys])])


def _merge(buckets: int, bits: int):
    """Of a group of blocks and one wide range: one request for all, to the buckets."""

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for n in "12":
            every, where, _ = _merged(rows, n)
            parts.append((every, *(np.bincount(where, np.concatenate([unpack(x) for x in rows.column(c + n).to_pylist()]), len(every)) for c in "fg")))
        sent = _send(parts, buckets, bits)
        at = rows.column("via")[0].as_py()
        return pa.table(
            [pa.array(list(sent), pa.int32()), pa.array([at] * len(sent), pa.int64()), *(pa.array([r[i] for r in sent.values()], pa.binary()) for i in range(6))],
            names=["bucket", "from", *_KEYS],
        )

    return run


def _split(rows: pa.Table, told: pa.Table) -> pa.Table:
    """The way back: to each block of the group its part of the totals."""
    order = np.argsort(told.column("bucket").to_numpy(), kind="stable")
    out = {}
    for n in "12":
        _, where, cut = _merged(rows, n)
        for c in "fg":
            parts = told.column(c + n).to_pylist()
            total = np.concatenate([unpack(parts[i]) for i in order])
            out[c + n] = [pack(total[where[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    v = [[sum(told.column(c).to_pylist())] + [0] * (rows.num_rows - 1) for c in ("v", "v_rest")]
    return pa.table(
        [rows.column("from").combine_chunks(), rows.column("bucket").combine_chunks(), *(pa.array(out[c], pa.binary()) for c in _TOLD), *(pa.array(x, pa.int64()) for x in v)],
        names=["to", "bucket", *_TOLD, "v", "v_rest"],
    )


def _replies(bucket: pa.Table) -> pa.Table:
    out: dict[str, list[bytes]] = {}
    distinct = []
    for n in "12":
        every, where, cut = _merged(bucket, n)
        for c in "fg":
            own = np.concatenate([unpack(x) for x in bucket.column(c + n).to_pylist()])
            total = np.bincount(where, own, len(every))
            if n == "1":
                distinct.append(int((total > 0).sum()))
            out[c + n] = [pack(total[where[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    rows = bucket.num_rows
    # the first block carries the bucket's number of distinct words, so that each is counted once
    first = lambda n: pa.array([n] + [0] * (rows - 1), pa.int64())
    return pa.table(
        [bucket.column("from").combine_chunks(), bucket.column("bucket").combine_chunks(), *(pa.array(out[k], pa.binary()) for k in _TOLD), first(distinct[0]), first(distinct[1])],
        names=["to", "bucket", *_TOLD, "v", "v_rest"],
    )


_ASKED = "bucket int, from bigint, k1 binary, f1 binary, g1 binary, k2 binary, f2 binary, g2 binary"
_ANSWER = "to bigint, bucket int, f1 binary, g1 binary, f2 binary, g2 binary, v bigint, v_rest bigint"


def exchange(blocks: DataFrame, n_blocks: int, buckets: int, bits: int) -> DataFrame:
    """``(to, bucket, f1, g1, f2, g2, v, v_rest)``: for each block the totals of its words and pairs, by key range."""
    direct = n_blocks * buckets <= ROWS
    asked = blocks.select("block", "train", "deleted", "sizes", "words", "word").mapInArrow(_requests(buckets if direct else STEPS, bits), _ASKED)
    if direct:
        return asked.groupBy("bucket").applyInArrow(_replies, _ANSWER)
    groups = -(-n_blocks // GROUP)
    asked = asked.withColumn("via", F.pmod(F.xxhash64("from"), F.lit(groups)) * STEPS + F.col("bucket"))
    asked = materialise(asked, "lm-asked")
    # a wide range is cut at its own edges and those of the buckets, so that a bucket takes from one range or more, in order
    merged = asked.groupBy("via").applyInArrow(_merge(buckets, bits), _ASKED)
    told = merged.groupBy("bucket").applyInArrow(_replies, _ANSWER)
    return asked.groupBy("via").cogroup(told.groupBy("to")).applyInArrow(_split, _ANSWER)


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c)[1], CONTEXTS - 1)


def _terms(t: Tokens, lo: int, hi: int, c1: np.ndarray, c2: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Of one text: by context bucket the tokens of unseen and of seen pairs, and the ratios (times 1/D) of the seen."""
    v, w, pair = c1[t.context[lo:hi]], c1[t.word[lo:hi]], c2[t.pair[lo:hi]]
    bucket = context_bucket(v)
    seen = pair > 0
    ratio = pair[seen] / (v[seen] * (w[seen] + 0.5))
    order = np.lexsort((ratio, bucket[seen]))
    count = lambda x: np.bincount(x, minlength=CONTEXTS).tolist()
    return count(bucket[~seen]), count(bucket[seen]), rounded(ratio[order])


def rounded(x: np.ndarray) -> bytes:
    """Numbers above 0 to 14 significant bits (one part in 16,000), in byte planes that compress well."""
    x = (x.astype(np.float32).view(np.uint32) + np.uint32(1 << 9)) & np.uint32(0xFFFFFC00)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def restored(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.float32).ravel().astype(float)


_OUT = (
    "doc_id {id}, held_out boolean, train boolean, deleted boolean, n_tokens bigint, n_known bigint, log_base double, log_rest double, "
    "unseen array<int>, seen array<int>, ratio binary, unseen_rest array<int>, seen_rest array<int>, ratio_rest binary, v bigint, v_rest bigint"
)


def _score(bits: int, block: pa.Table, replies: pa.Table) -> pa.Table:
    row = block.slice(0, 1).select(["block", *_FLAGS, "sizes", "words", "word"]).to_pylist()[0]
    ids = block.column("doc_id").combine_chunks().flatten()
    t = Tokens.read(row, bits)
    order = np.argsort(replies.column("bucket").to_numpy(), kind="stable")
    got = {}
    for c in _TOLD:
        parts = replies.column(c).to_pylist()
        got[c] = np.concatenate([unpack(parts[i]) for i in order]).astype(np.float64)
    c1, c2, r1, r2 = got["f1"], got["f2"], got["g1"], got["g2"]
    deleted = row["deleted"]
    log1, logr = np.log10(c1 + 0.5)[t.word], np.log10(r1 + 0.5)[t.word]
    known = (c1 > 0)[t.word]
    rows = {k: [] for k in ("n_known", "log_base", "log_rest", "unseen", "seen", "ratio", "unseen_rest", "seen_rest", "ratio_rest")}
    for i, (lo, hi) in enumerate(zip((t.stop - t.size).tolist(), t.stop.tolist())):
        full = _terms(t, lo, hi, c1, c2)
        rest = _terms(t, lo, hi, r1, r2) if deleted[i] else (None, None, None)
        for k, x in zip(rows, (int(known[lo:hi].sum()), float(log1[lo:hi].sum()), float(logr[lo:hi].sum()), *full, *rest)):
            rows[k].append(x)
    n = len(ids)
    ints = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.float64(), pa.float64(), ints, ints, pa.binary(), ints, ints, pa.binary())
    part = lambda c: pa.array([sum(replies.column(c).to_pylist())] + [0] * (n - 1), pa.int64())
    flag = lambda c: pa.array(row[c], pa.bool_())
    return pa.table(
        [ids, flag("held_out"), flag("train"), flag("deleted"), pa.array(t.size), *(pa.array(x, k) for x, k in zip(rows.values(), kinds)), part("v"), part("v_rest")],
        names=["doc_id", "held_out", "train", "deleted", "n_tokens", *rows, "v", "v_rest"],
    )


def _statistics(scale: float):
    """Of the held-out fold: for each context bucket and bin of log2(ratio), the tokens and the sum of ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((CONTEXTS, BINS + 1)), np.zeros((CONTEXTS, BINS + 1))
        for b in batches:
            for unseen, seen, ratio in zip(*(b.column(c).to_pylist() for c in ("unseen_rest", "seen_rest", "ratio_rest"))):
                n[:, 0] += unseen
                r = restored(ratio) * scale
                at = np.repeat(np.arange(CONTEXTS), seen) * (BINS + 1) + 1 + np.clip((np.log2(r) - LEAST_LOG2) * 32, 0, BINS - 1).astype(np.int64)
                n += np.bincount(at, minlength=n.size).reshape(n.shape)
                total += np.bincount(at, r, n.size).reshape(n.shape)
        c, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k), pa.array(n[c, k]), pa.array(total[c, k])], names=["context", "bin", "n", "total"])

    return run


def learn_weights(context: np.ndarray, n: np.ndarray, ratio: np.ndarray, rounds: int = 200) -> np.ndarray:
    """EM for each context bucket: the weight of the pair estimate, from counts of its ratio to the word estimate."""
    weight = np.where(np.arange(CONTEXTS) > 0, 0.5, 0.0)
    every = np.maximum(np.bincount(context, n, CONTEXTS), 1e-300)
    for _ in range(rounds):
        a = weight[context] * ratio
        share = np.divide(a, a + 1 - weight[context], out=np.zeros_like(a), where=a > 0)
        new = np.bincount(context, n * share, CONTEXTS) / every
        new[0] = 0.0
        if np.abs(new - weight).max() < 1e-9:
            break
        weight = new
    # one who has not been seen in the held-out fold takes after the next rarer one
    seen = np.bincount(context, n, CONTEXTS) > 0
    for c in range(1, CONTEXTS):
        if not seen[c]:
            weight[c] = weight[c - 1]
    return np.clip(weight, 0.0, 1 - 1e-6)


def score(docs: DataFrame, train: Column, deleted: Column, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of ``docs``.

    ``train``: rows whose texts are learnt from; ``deleted``: those of them held out to learn the weights.
    """
    kind = docs.schema[row_id].dataType
    source = docs.select(named(row_id).alias("doc_id"), named(text).alias("text"), (~train).alias("held_out"), train.alias("train"), (train & deleted).alias("deleted"))
    blocks = materialise(source.mapInArrow(_cut, _BLOCK.format(id=kind.simpleString())), "lm-blocks")
    n_blocks = blocks.count()
    _, size = total_chars(docs, text)
    buckets = max(1, -(-size // BUCKET_BYTES))
    bits = min(64, max(32, size.bit_length() + PAIR_SPARE))
    told = exchange(blocks, n_blocks, buckets, bits)
    terms = blocks.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(
        lambda block, replies: _score(bits, block, replies), _OUT.format(id=kind.simpleString())
    )
    terms = materialise(terms, "lm-terms", compression="zstd")

    totals = terms.agg(
        F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("n"), F.sum(F.when(F.col("train") & ~F.col("deleted"), F.col("n_tokens"))).alias("n_rest"),
        F.sum("v").alias("v"), F.sum("v_rest").alias("v_rest"),
    ).first()
    n, below = totals["n"] or 0, (totals["n"] or 0) + 0.5 * ((totals["v"] or 0) + 1)
    below_rest = (totals["n_rest"] or 0) + 0.5 * ((totals["v_rest"] or 0) + 1)
    stats = (
        terms.where("deleted").select("unseen_rest", "seen_rest", "ratio_rest").mapInArrow(_statistics(below_rest), "context bigint, bin bigint, n double, total double")
        .groupBy("context", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
    )  # at most CONTEXTS x BINS rows
    ratio = np.where(stats["bin"] > 0, stats["total"] / np.maximum(stats["n"], 1), 0.0) if len(stats) else np.zeros(0)
    weight = learn_weights(stats["context"].to_numpy(np.int64), stats["n"].to_numpy(float), ratio)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.log10(1 - weight)
        for b in batches:
            tokens = b.column("n_tokens").to_numpy()
            base = b.column("log_base").to_numpy() - tokens * np.log10(below)
            gain = []
            for unseen, seen, packed in zip(*(b.column(c).to_pylist() for c in ("unseen", "seen", "ratio"))):
                w = np.repeat(weight, seen)
                r = restored(packed) * below
                gain.append(float((rest * unseen).sum() + np.log10(w * r + 1 - w).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), b.column("n_known"), pa.array(np.full(len(tokens), n, np.int64)), pa.array(base), pa.array(base + np.array(gain, float))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return terms.select("doc_id", "held_out", "n_tokens", "n_known", "log_base", "unseen", "seen", "ratio").mapInArrow(
        finish, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 5)
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), train=part != 1, deleted=part == 2)
