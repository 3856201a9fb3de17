"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after ``.``, ``!`` or ``?`` before white space, after the sentence ends of
other scripts (``ENDS``), and at line ends. A sentence of more than ``LONG`` words is cut again after the word
of least crc32 of every ``WINDOW`` words, so that a passage pasted into the middle of a sentence falls into
the same pieces wherever it stands. In scripts without blanks between words, each character is a word. From
every sentence starts a run of at least ``RUN`` sentences and ``MIN_WORDS`` words (the
shortest such); the run is hashed over its lower-cased words. All runs of the corpus are joined by hash,
and every sentence covered by a run that is not the first of its hash (smallest id, then row, then
position) is removed.

No passage of 51 or more words escapes: at each end at most 15 of its words stand in pieces that differ from
text to text (a sentence of up to 16 words that reaches beyond it, or ``2 * WINDOW - 2`` words of a longer
one), so at least 21 fall into the same pieces, and no piece has 20.

A run that a large share of all texts hold is one hot key of that join: the first places of the 1000
most frequent runs (a bounded table) are broadcast, and only the others are shuffled by hash.

Defined results: a null text stays null and an empty one empty. Runs repeated within one text count as
well. Repeated rows (same id and text) are one document: both get the same result. Rows that share an
id but differ in text are documents of their own. A null id sorts first. Extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import extended, free_names, map_arrow, materialise, named, table

RUN = 2
MIN_WORDS = 20
LONG = 16
WINDOW = 8
#: Most frequent runs whose first places are broadcast.
HOT_RUNS = 1_000

_BREAK = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|[\x0A\x0D]+")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Sentence ends that need no blank after them: ideographic, full-width, Devanagari, Arabic and Urdu.
ENDS = ("\u3002", "\uff01", "\uff1f", "\u0964", "\u061f", "\u06d4")
_ENDS = [x.encode() for x in ENDS]
_BREAK_ANY = re.compile(_BREAK.pattern + rb"|(?:" + b"|".join(_ENDS) + rb")[\x20\x09-\x0D]*")
# characters of scripts without blanks: kana, ideographs, full-width forms, Thai and Lao
_NO_BLANKS = rb"[\xE3-\xE9][\x80-\xBF]{2}|\xEF[\xBC-\xBF][\x80-\xBF]|\xE0[\xB8-\xBB][\x80-\xBF]"
_WIDE = re.compile(_NO_BLANKS)
_WORD_ANY = re.compile(_NO_BLANKS + rb"|(?:(?!" + _NO_BLANKS + rb")[^\x20\x09-\x0D])+")
_MULTIPLIER = 0x9E3779B97F4A7C15


def _least(words: list[bytes]) -> set[int]:
    """The places of the words of least crc32 (the last of equals) of every ``WINDOW`` words in a row."""
    h = [zlib.crc32(w) for w in words]
    best, out = -1, set()
    for end in range(WINDOW, len(h) + 1):
        if best < end - WINDOW:
            best = min(range(end - 1, end - WINDOW - 1, -1), key=h.__getitem__)
        elif h[end - 1] <= h[best]:
            best = end - 1
        out.add(best)
    return out


def sentences(text: bytes) -> tuple[list[int], list[list[bytes]]]:
    """Where each sentence ends, and its words; the ends tile the text."""
    low = text.lower()
    ends = [m.end() for m in (_BREAK_ANY if any(x in low for x in _ENDS) else _BREAK).finditer(low)]
    word = _WORD_ANY if not low.isascii() and _WIDE.search(low) else _WORD
    if not ends or ends[-1] < len(low):
        ends.append(len(low))
    stops: list[int] = []
    words: list[list[bytes]] = []
    start = 0
    for end in ends:
        part = low[start:end].split() if word is _WORD else word.findall(low, start, end)
        if len(part) > LONG:
            held, least = [], _least(part)
            for i, m in enumerate(word.finditer(low, start, end)):
                held.append(m[0])
                if i in least:
                    stops.append(m.end())
                    words.append(held)
                    held = []
            if held:
                stops.append(end)
                words.append(held)
            elif stops:
                stops[-1] = end
        elif part:
            stops.append(end)
            words.append(part)
        elif stops:
            stops[-1] = end
        start = end
    return stops, words


def runs(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and end (exclusive) of the run that starts at each sentence; sentences too near the end have none."""
    n = len(words)
    if n < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64)
    count = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    end = np.maximum(np.searchsorted(count, count[:-1] + MIN_WORDS), np.arange(n) + RUN)
    end = end[end <= n]
    m = np.uint64(_MULTIPLIER)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, m)]), dtype=np.uint64)
    # sum of unit[i] * m**i, made independent of i by the inverse power
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(unit * power[:n], dtype=np.uint64)])
    inverse = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    start = np.arange(len(end))
    h = (prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64) * m
    return h.view(np.int64), end


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, counts = [], []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            words = sentences(t or b"")[1]
            hashes.append(runs(words)[0])
            counts.append(len(words))
        sizes = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("row"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int64()))],
            names=["id", "row", "n_sentences", "h"],
        )


def cut(text: bytes, starts: list[int]) -> tuple[bytes, int, int, int]:
    """``text`` without the sentences covered by the runs that start at ``starts``; sentences, removed sentences and words."""
    stops, words = sentences(text)
    _, end = runs(words)
    gone = np.zeros(len(stops) + 1, np.int64)
    for s in starts:
        gone[s] += 1
        gone[end[s]] -= 1
    out = np.cumsum(gone[:-1]) > 0
    begin = [0, *stops[:-1]]
    kept = b"".join(text[a:b] for a, b, x in zip(begin, stops, out.tolist()) if not x)
    return kept.rstrip(), len(stops), int(out.sum()), sum(len(w) for w, x in zip(words, out.tolist()) if x)


def repeated_runs(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, row, n_sentences, starts)``: for each document (by its id and a hash of its text) the sentences at which a
    non-first run starts, null where none does. The runs are written once, as arrays."""
    kind = docs.schema[row_id].dataType.simpleString()
    keyed = docs.select(named(row_id).alias("id"), F.xxhash64(named(text)).alias("row"), named(text).alias("text"))
    found = materialise(keyed.mapInArrow(_find, f"id {kind}, row bigint, n_sentences bigint, h array<bigint>"), "spans-runs")
    places = found.select("id", "row", F.posexplode("h").alias("at", "h"))
    rep = materialise(
        places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "at")).alias("first")).where("n > 1"), "spans-repeated"
    )
    top = rep.where(F.col("n") > 1_000).orderBy(F.desc("n"), "h").limit(HOT_RUNS)
    hot = materialise(top.select(F.col("h").alias("hot"), F.col("first").alias("hot_first")), "spans-hot")
    rest = rep.join(F.broadcast(hot), rep["h"] == hot["hot"], "left_anti").select(F.col("h").alias("of"), "first")
    dealt = places.join(F.broadcast(hot), places["h"] == hot["hot"], "left").withColumn(
        "of", F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64("id", "row", "at"))
    )
    met = dealt.join(rest, "of", "left").withColumn("first", F.coalesce("hot_first", "first"))
    later = met.where(F.col("first").isNotNull() & ~F.struct("id", "row", "at").eqNullSafe(F.col("first"))).select("id", "row", "at")
    # one aggregation of a row for each document and each later place
    every = found.select("id", "row", "n_sentences", F.lit(None).cast("int").alias("at")).unionByName(later.withColumn("n_sentences", F.lit(None).cast("bigint")))
    out = every.groupBy("id", "row").agg(F.max("n_sentences").alias("n_sentences"), F.collect_set("at").alias("starts"))
    return out.withColumn("starts", F.when(F.size("starts") > 0, F.sort_array("starts")))


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its text cut, and ``n_sentences``, ``n_removed`` (sentences) and ``words_removed``."""
    added = ("n_sentences", "n_removed", "words_removed")
    kept = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in kept]
    i, row, at_, n_ = free_names(names, "__id", "__row", "__starts", "__n")
    starts = repeated_runs(docs, row_id, text).select(F.col("id").alias(i), F.col("row").alias(row), F.col("starts").alias(at_), F.col("n_sentences").alias(n_))
    same = named(row_id).eqNullSafe(F.col(i)) & (F.xxhash64(named(text)) == F.col(row))
    joined = docs.select(*(named(n) for n in names)).join(starts, same, "left").select(*(named(n) for n in names), at_, n_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, s, held in zip(b.column(names.index(text)).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                if not t or not s:
                    texts.append(t)
                    counts.append((held, 0, 0))
                else:
                    out, *n = cut(t, s)
                    texts.append(out)
                    counts.append(tuple(n))
            columns = b.columns[: len(names)]
            columns[names.index(text)] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names=[*names, *added])

    return map_arrow(joined, run, extended(kept, **dict.fromkeys(added, "long")))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_sentences", "n_removed", "words_removed")
