"""Mixing sources to target weights, with DataFrame operations only.

The texts of a source, in a fixed order, are one stream of words, packed into blocks of ``BLOCK`` words
(the last one shorter). The mix has as many slots for a source as bring it to its target, dealt to output
shards of ``SHARD_SLOTS`` slots each:

* how many slots of each source a shard gets is drawn at random. A pseudorandom permutation of all slots of the
  mix puts them into shards, so a shard's source counts are a multinomial draw given that the counts of a
  source over all shards add up to its slots; independent draws would miss the targets of small sources.
* the slots of a source are numbered along the shards, by prefix sums of the drawn counts;
* slot i of a source takes block ``permuted(i mod blocks)``, by a pseudorandom permutation of the source's block
  indices, a fresh one for each pass over the source; slots and blocks are joined by index.

Within a pass no block comes twice, so no document is taken more often than the passes allow (``MAX_PASSES``), and a
pass that ends early has taken a random sample of the source's blocks.

Prefix sums are made in two steps (within a bucket or range, then over the totals of these), and slots are unrolled
from chunks, so a source that holds a third of all rows is spread over many tasks. Rows are put in order by a hash of
the id as text, then size, so any type of id will do; rows that agree in source, id and size are numbered
within the task that read them, so a third of all rows may be copies of one. On one task are only tables of
a row for each source, and for each source and bucket or range.

Sources in code point order, null last, weigh 5, 2, 1, 5, ...; a target stops at MAX_PASSES times the
source's size, and what is cut off is shared again by weight among the others until none is above.

Defined results: a null text has size 0. Rows of size 0, and sources that hold only such, take nothing.
A null source is a source of its own. A null id is ordered as the empty text. Repeated rows are separate
stretches of the stream. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.llm.common import materialise, table

BLOCK = 256
SHARD_SLOTS = 1_024
MAX_PASSES = 3
WEIGHTS = (5, 2, 1)
#: Least number of id buckets, and rows to a bucket beyond it.
BUCKETS, BUCKET_ROWS = 64, 100_000
CHUNK_SLOTS = 65_536
#: Shards to a range in which slots are numbered.
RANGE_SHARDS = 256
#: Rounds of the permutations (an even number).
ROUNDS = 4
SPACES = r"[^\x20\x09-\x0D]+"


def _draw(text: Column) -> Column:
    """A number below 2**52 from the hash of a text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _turn(left: Column, right: Column, k: int | Column, key: Column, m: Column) -> Column:
    return (left + _draw(F.concat_ws(",", key, k, right)) % m) % m


def permute(df: DataFrame, x: Column, n: Column, key: Column, name: str) -> DataFrame:
    """Adds ``name``: ``x`` put through the pseudorandom permutation of 0 .. n-1 chosen by ``key``.

    An alternating Feistel network over the pairs (i, j) with i < a, j < b for a about sqrt(n) and a * b >= n, walked on
    until it falls below n. Fewer than a of the a * b numbers are not below n, so the walk visits them all at most; about
    one number in a has to walk at all.
    """
    keep = df.columns
    out = df.withColumns({"pn": n, "pk": key, "pa": F.greatest(F.floor(F.sqrt(n)).cast("bigint"), F.lit(1).cast("bigint"))})
    out = out.withColumns({"pb": F.ceil(F.col("pn") / F.col("pa")).cast("bigint"), "pl": x % F.col("pa"), "pr": F.floor(x / F.col("pa")).cast("bigint")})
    a, b, left, right = F.col("pa"), F.col("pb"), F.col("pl"), F.col("pr")
    for k in range(1, ROUNDS + 1):
        out = out.withColumns({"pl": right, "pr": _turn(left, right, F.lit(k), F.col("pk"), a if k % 2 else b)})

    def again(v: Column) -> Column:
        start = F.struct((v % a).alias("l"), F.floor(v / a).cast("bigint").alias("r"))
        step = lambda s, k: F.struct(s["r"].alias("l"), _turn(s["l"], s["r"], k, F.col("pk"), F.when(k % 2 == 1, a).otherwise(b)).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] + s["r"] * a)

    y, n = F.col("py"), F.col("pn")
    walk = F.aggregate(F.sequence(F.lit(1).cast("bigint"), a * b - n), y, lambda v, _: F.when(v < n, v).otherwise(again(v)))
    # never null: a join on it would push a test for nulls, and with it all rounds again, below this
    return out.withColumn("py", left + right * a).select(*keep, F.coalesce(F.when(y < n, y).otherwise(walk), F.lit(0).cast("bigint")).alias(name))


def measured(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, size, h, part)``: with a hash of the id, and the task that read the row. Written once, as every
    later step needs it, so that ``part`` stays."""
    size = F.greatest(F.size(F.regexp_extract_all(f"`{text}`", F.lit(SPACES), 0)), F.lit(0))
    return materialise(
        docs.select(
            F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
            _draw(F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit(""))).alias("h"), F.spark_partition_id().alias("part"),
        ),
        "mix-sizes",
    )


def targets(sizes: DataFrame) -> DataFrame:
    """One row for each source: its place, size, weight, target, blocks and slots, and the slots of the sources before it."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("bigint")
    cap = F.col("source_size") * MAX_PASSES
    by = by.withColumn("place", place.cast("bigint")).withColumn("weight", w).withColumn("cap", cap)
    # caps are reached in the order of cap / weight, so the capped sources are a prefix of that order;
    # beyond it the level only falls, so the common level is the greatest of the uncapped
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    by = by.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    by = by.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free * F.col("weight")))
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("bigint"))
    slots = F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("bigint"), F.col("blocks") * MAX_PASSES)
    by = by.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("bigint")))
    along = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return by.select(
        "source", "place", "source_size", "weight", "target", "blocks", "slots", (F.sum("slots").over(along) - F.col("slots")).alias("slots_before"),
        F.sum("slots").over(every).alias("all_slots"),
    )


def stream(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Every row of size above 0 with its source's goal and ``offset``, where it starts in its source's stream of words."""
    n = sizes.count()
    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    # a group holds rows of one task only; the ids as structs, so that null ones stay
    alike = sizes.where("size > 0").groupBy("source", "h", "size", "part").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    alike = alike.withColumn("total", F.size("ids") * F.col("size")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    alike = materialise(alike, "mix-groups")
    sums = alike.groupBy("source", "bucket").agg(F.sum("total").alias("total"))
    prior = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        (F.sum("total").over(W.partitionBy("source").orderBy("bucket")) - F.col("total")).alias("base"),
    )
    order = W.partitionBy("source", "bucket").orderBy("h", "size", "part").rowsBetween(W.unboundedPreceding, 0)
    goal = goals.select(F.col("source").alias("g"), "place", "source_size", "target", "blocks")
    return (
        alike.withColumn("inner", F.sum("total").over(order) - F.col("total"))
        .join(prior, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .join(goal, F.col("source").eqNullSafe(F.col("g")))
        .select("source", "size", "place", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"), F.posexplode("ids").alias("k", "x"))
        .select("x.doc_id", "source", "size", "place", "source_size", "target", (F.col("start") + F.col("k") * F.col("size")).alias("offset"))
    )


def shard_counts(goals: DataFrame) -> DataFrame:
    """``(shard, place, n, first)``: the slots of a source drawn for a shard, and the number of the first of them."""
    chunks = goals.where("slots > 0").select("place", "slots", "slots_before", "all_slots", F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK_SLOTS}L)")).alias("lo"))
    chunks = chunks.repartition(F.col("place"), F.col("lo"))
    slots = chunks.select("place", "all_slots", F.explode(F.expr(f"sequence(slots_before + lo, slots_before + least(lo + {CHUNK_SLOTS}L, slots) - 1)")).alias("x"))
    at = permute(slots, F.col("x"), F.col("all_slots"), F.lit("shards"), "y")
    counts = at.groupBy(F.expr(f"y div {SHARD_SLOTS}").alias("shard"), "place").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("range", F.expr(f"shard div {RANGE_SHARDS}")), "mix-counts")
    sums = counts.groupBy("place", "range").agg(F.sum("n").alias("total"))
    prior = sums.select("place", "range", (F.sum("total").over(W.partitionBy("place").orderBy("range")) - F.col("total")).alias("base"))
    order = W.partitionBy("place", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("inner", F.sum("n").over(order) - F.col("n")).join(prior, ["place", "range"]).select("shard", "place", "n", (F.col("base") + F.col("inner")).alias("first"))


def plan(placed: DataFrame, goals: DataFrame) -> DataFrame:
    """The mix: ``(shard, place, slot, block, doc_id, offset, first_word, n_words)``, a row for each document's part of a slot.

    ``offset`` is where the document starts in its source's stream and tells repeated rows apart.
    """
    parts = placed.withColumn("block", F.explode(F.sequence(F.expr(f"offset div {BLOCK}"), F.expr(f"(offset + size - 1) div {BLOCK}"))))
    first = F.greatest(F.col("block") * BLOCK - F.col("offset"), F.lit(0).cast("bigint"))
    stop = F.least((F.col("block") + 1) * BLOCK - F.col("offset"), F.col("size"))
    parts = parts.select("place", "block", "doc_id", "offset", first.alias("first_word"), (stop - first).alias("n_words"))

    slots = shard_counts(goals).select("shard", F.col("place").alias("p"), F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    slots = slots.join(F.broadcast(goals.select(F.col("place").alias("g"), "blocks")), F.col("p") == F.col("g"))  # a row for each source
    key = F.concat_ws(",", F.lit("blocks"), F.col("p"), F.expr("slot div blocks"))
    slots = permute(slots, F.expr("slot % blocks"), F.col("blocks"), key, "index").select("shard", "p", "slot", "index")
    # the planner takes the slots for as few as the counts they are unrolled from: never broadcast them
    return slots.hint("merge").join(parts, (F.col("p") == F.col("place")) & (F.col("index") == F.col("block"))).select(
        "shard", "place", "slot", "block", "doc_id", "offset", "first_word", "n_words"
    )


def mix(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, first_shard)``, one row for each row of ``docs``: the words that
    the mix takes of it, and the first output shard that gets some of them."""
    sizes = measured(docs, row_id, text, source)
    goals = materialise(targets(sizes), "mix-goals")
    placed = materialise(stream(sizes, goals), "mix-stream")
    used = plan(placed, goals).groupBy("place", "offset").agg(F.sum("n_words").alias("used"), F.min("shard").alias("first_shard"))
    used = used.withColumnsRenamed({"place": "p", "offset": "o"})
    out = ["doc_id", "source", "size", "source_size", "target"]
    some = placed.join(used, (F.col("place") == F.col("p")) & (F.col("offset") == F.col("o")), "left").select(*out, F.coalesce("used", F.lit(0).cast("bigint")).alias("taken"), "first_shard")
    goal = goals.select(F.col("source").alias("g"), "source_size", "target")
    none = sizes.where("size = 0").join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("g")))
    return some.unionByName(none.select(*out, F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("first_shard")))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def _sql_permuted(name: str, numbers: str) -> str:
    """Two common table expressions for DuckDB: ``name(id, y)``, the numbers ``(id, x, n, key)`` of a table put through the permutation."""
    return f"""
{name}_w AS (SELECT id, 0 AS k, n, key, greatest(floor(sqrt(n))::BIGINT, 1) AS a, ceil(n / greatest(floor(sqrt(n))::BIGINT, 1))::BIGINT AS b,
  x % greatest(floor(sqrt(n))::BIGINT, 1) AS l, x // greatest(floor(sqrt(n))::BIGINT, 1) AS r FROM {numbers}
  UNION ALL
  SELECT id, k % {ROUNDS} + 1, n, key, a, b, r, (l + ('0x' || substr(md5(concat_ws(',', key, k % {ROUNDS} + 1, r)), 1, 13))::BIGINT % (CASE WHEN k % 2 = 0 THEN a ELSE b END))
   % (CASE WHEN k % 2 = 0 THEN a ELSE b END) FROM {name}_w WHERE k < {ROUNDS} OR l + r * a >= n),
{name} AS (SELECT id, l + r * a AS y FROM {name}_w WHERE k = {ROUNDS} AND l + r * a < n)"""


#: DuckDB's form of op4 (bucket count as for fewer than BUCKETS * BUCKET_ROWS rows, or by the same rule beyond).
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACES}')), 0)::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM documents),
k AS (SELECT greatest({BUCKETS}, -(-count(*) // {BUCKET_ROWS}))::BIGINT AS buckets FROM d),
r AS (SELECT d.*, row_number() OVER () AS rid, h % buckets AS bucket FROM d, k),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT]::BIGINT AS weight, source_size * {MAX_PASSES} AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, cap <= level * weight AS capped FROM s3),
s5 AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE max(CASE WHEN NOT capped THEN level END) OVER () * weight END AS target,
  ceil(source_size / {BLOCK})::BIGINT AS blocks FROM s4),
g AS MATERIALIZED (SELECT *, sum(slots) OVER ()::BIGINT AS all_slots, (sum(slots) OVER (ORDER BY place) - slots)::BIGINT AS slots_before FROM
  (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, blocks * {MAX_PASSES}) ELSE 0 END AS slots FROM s5)),
o AS MATERIALIZED (SELECT r.*, g.place, g.source_size, g.target, g.blocks,
  sum(size) OVER (PARTITION BY r.source ORDER BY bucket, h, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS off
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
sx AS MATERIALIZED (SELECT x AS id, x, all_slots AS n, 'shards' AS key FROM (SELECT unnest(range(all_slots)) AS x, all_slots FROM (SELECT DISTINCT all_slots FROM g))),
{_sql_permuted("sp", "sx")},
sl AS (SELECT place, blocks, y // {SHARD_SLOTS} AS shard, row_number() OVER (PARTITION BY place ORDER BY y // {SHARD_SLOTS}) - 1 AS slot
  FROM sp JOIN g ON id >= slots_before AND id < slots_before + slots),
bx AS MATERIALIZED (SELECT [place, shard, slot] AS id, slot % blocks AS x, blocks AS n, concat_ws(',', 'blocks', place, slot // blocks) AS key FROM sl),
{_sql_permuted("bp", "bx")},
n AS (SELECT id[1] AS place, y AS block, count(*) AS times, min(id[2]) AS shard FROM bp GROUP BY ALL),
p AS (SELECT rid, place, size, off, unnest(range((off // {BLOCK})::BIGINT, ((off + size - 1) // {BLOCK})::BIGINT + 1)) AS block FROM o WHERE size > 0),
t AS (SELECT rid, sum((least((p.block + 1) * {BLOCK} - off, size) - greatest(p.block * {BLOCK} - off, 0)) * times) AS taken, min(shard) AS shard FROM p JOIN n USING (place, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, shard::BIGINT AS first_shard FROM o LEFT JOIN t USING (rid)
"""
