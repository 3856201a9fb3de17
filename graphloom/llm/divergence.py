"""Source divergence audit: how differently the sources of a language use its words.

Terms are counted by DuckDB over slices of texts where they are read, and Spark adds the counts up. The counts are dealt to
shards by hash of language and term. In each shard DuckDB's SQL keeps the terms that enough documents hold, and then, with the
totals of the language's groups, forms the shard's part of every pair's sum and each group's most telling terms. Spark
merges sums and ranks.

Most groups lack most terms, and all terms that a group lacks have one probability. A pair's sum therefore starts from the
number of kept terms times the difference of these two, and is corrected for the terms that one of the two has, which are
counted by distinct count first, and for those that both have. All arithmetic is in whole numbers.

Scale: a shard has about ``SHARD_ROWS`` counts whatever the size of the corpus, and its language's totals; a term is spread
over as many rows as there are sources. The result has a row for each two sources of a language, which bounds the number of
sources that can be asked for; totals are a row for each source.

Defined results: null texts, languages and sources are empty strings. Repeated rows are documents of their own. A group
without terms has all its differences to the others; a language without kept terms has pairs of value 0 and no terms. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.llm.common import materialise, named, slices, table

#: Documents of a language that must hold a term.
MIN_DOCS = 30
#: Added to every count; probabilities are in parts of SCALE, rounded down, and one more.
PRIOR, SCALE = 5, 1_000_000_000
#: Terms to a group in the result.
TOP_TERMS = 50
SLICE_BYTES = 2_000_000
SHARD_ROWS = 100_000
#: Memory of DuckDB in a task.
MEMORY = "250MB"

#: What each byte is read as: letters and bytes beyond ASCII are kept, A-Z lower-cased, all else parts terms.
_READ = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNT = """
SELECT lang, term, source, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM (
  SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(string_split(text, ' ')) AS term FROM texts)
  WHERE term <> '' GROUP BY ALL) GROUP BY ALL
"""

# source is null: the term's count in the whole language
_KEEP = f"""
WITH kept AS (SELECT term, sum(n)::BIGINT AS n FROM counts GROUP BY term HAVING sum(docs) >= {MIN_DOCS})
SELECT term, source, counts.n FROM counts SEMI JOIN kept USING (term) UNION ALL SELECT term, NULL, n FROM kept
"""

_P = f"(1 + {SCALE}::HUGEINT * ({{n}} + {PRIOR}) // t.per)::BIGINT"

_PARTS = f"""
WITH t AS (SELECT source, (total::HUGEINT + {PRIOR} * kept::HUGEINT) AS per, kept FROM totals),
z AS (SELECT source, {_P.format(n=0)} AS z FROM t WHERE source IS NOT NULL AND kept > 0),
p AS (SELECT term, source, n, {_P.format(n="n")} AS p, z FROM counts JOIN t USING (source) JOIN z USING (source)),
q AS (SELECT term, {_P.format(n="n")} AS q, count(*) OVER () AS many FROM counts, t WHERE counts.source IS NULL AND t.source IS NULL),
one AS (SELECT a.source, b.source AS item, sum(a.times * (abs(a.p - b.z) - abs(a.z - b.z))) AS value
  FROM (SELECT source, p, z, count(*) AS times FROM p GROUP BY ALL) a JOIN z b ON a.source <> b.source GROUP BY ALL),
two AS (SELECT a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)) AS value
  FROM p a JOIN p b ON a.term = b.term AND a.source < b.source GROUP BY ALL),
pairs AS (
  SELECT a.source, b.source AS item, abs(a.z - b.z) * (SELECT coalesce(max(many), 0) FROM q) AS value FROM z a JOIN z b ON a.source < b.source
  UNION ALL SELECT least(source, item), greatest(source, item), value FROM one
  UNION ALL SELECT * FROM two)
SELECT 'pair' AS part, source, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL
UNION ALL
SELECT 'pair', a.source, b.source, 0 FROM t a JOIN t b ON a.source < b.source WHERE a.kept = 0
UNION ALL
SELECT 'term', source, term, p - q FROM p JOIN q USING (term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term) <= {TOP_TERMS}
"""


@lru_cache(1)
def _duckdb():
    """The task's own database: one thread, bounded memory, nothing on disk."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
    con.execute("SET temp_directory = ''")
    con.execute("SET preserve_insertion_order = false")
    return con


def _asked(sql: str, **tables: pa.Table) -> pa.Table:
    con = _duckdb()
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, term, source, n, docs)``: how often a group uses a term, and in how many documents."""
    empty = F.lit("")
    own = docs.select(*(F.coalesce(named(c).cast("string"), empty).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                raw = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
                raw = pa.concat_arrays([raw])  # from its own first byte
                valid, offsets, data = raw.buffers()
                read = pa.py_buffer(data.to_pybytes().translate(_READ) if data else b"")
                texts = pa.Array.from_buffers(pa.large_string(), len(raw), [None, offsets, read], offset=raw.offset)
                rows = pa.table({"lang": part.column("lang"), "source": part.column("source"), "doc": pa.array(range(lo, hi)), "text": texts})
                yield from _asked(_COUNT, texts=rows).cast(schema).to_batches()

    found = own.mapInArrow(run, "lang string, term string, source string, n bigint, docs bigint")
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each group's distances to the other sources of its language, and the terms
    that it uses more than the language does."""
    counts = materialise(term_counts(docs, lang, source, text), "terms")
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards))

    def keep(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1)
        out = _asked(_KEEP, counts=rows.select(["term", "source", "n", "docs"]))
        same = {c: pa.array([first.column(c)[0].as_py()] * len(out), rows.schema.field(c).type) for c in ("lang", "shard")}
        return pa.table({"lang": same["lang"], "shard": same["shard"], "term": out.column("term").cast(pa.string()), "source": out.column("source").cast(pa.string()), "n": out.column("n").cast(pa.int64())})

    by = counts.withColumn("shard", shard)
    kept = materialise(by.groupBy("lang", "shard").applyInArrow(keep, "lang string, shard bigint, term string, source string, n bigint"), "kept")

    # every group of the table, with terms or not, and each language as a group without a source
    groups = docs.select(*(F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("many"))
    whole = sums.where(F.col("source").isNull()).select("lang", F.col("total").alias("in_lang"), F.col("many").alias("kept"))
    own = sums.where(F.col("source").isNotNull()).select("lang", "source", "total")
    totals = groups.join(own, ["lang", "source"], "left").unionByName(whole.select("lang", F.lit(None).cast("string").alias("source"), F.col("in_lang").alias("total")))
    totals = totals.join(whole.select("lang", "kept"), "lang", "left").na.fill(0, ["total", "kept"])
    dealt = totals.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("kept") > 0, shards - 1).otherwise(0).cast("bigint"))))

    def parts(rows: pa.Table, per: pa.Table) -> pa.Table:
        if not len(per):
            raise ValueError("a shard's language has no totals")
        name = per.column("lang")[0].as_py()
        out = _asked(_PARTS, counts=rows.select(["term", "source", "n"]), totals=per.select(["source", "total", "kept"]))
        columns = {c: out.column(c).cast(pa.string()) for c in ("part", "source", "item")}
        return pa.table({"lang": pa.array([name] * len(out), pa.string()), **columns, "value": out.column("value").cast(pa.int64())})

    found = kept.groupBy("lang", "shard").cogroup(dealt.groupBy("lang", "shard")).applyInArrow(parts, "lang string, part string, source string, item string, value bigint")
    found = materialise(found, "parts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "value")
    pairs = pairs.select("lang", F.col("p.source").alias("source"), F.lit("pair").alias("part"), F.col("p.item").alias("item"), "value")
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(order)
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= TOP_TERMS))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, coalesce(x.n, 0) AS n, kept.n AS whole FROM g JOIN kept ON kept.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = kept.term),
p AS (SELECT lang, source, term, n,
  1 + {SCALE}::HUGEINT * (n + {PRIOR}) // (sum(n) OVER s + {PRIOR} * count(*) OVER s) AS p,
  1 + {SCALE}::HUGEINT * (whole + {PRIOR}) // (sum(whole) OVER s + {PRIOR} * count(*) OVER s) AS q
  FROM c WINDOW s AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
  GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
QUALIFY rank <= {TOP_TERMS}
"""
