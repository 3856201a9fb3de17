"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily: the acceptor of a conversation's turns (a chain of symbols: role initial and fault), the
transducer of edits (Keep, Rerole, Delete, Insert) and the acceptor of the role grammar ``(s?(ua)+)?``. A path's weight is the
pair (cost, labels): costs add up and labels are joined; of two weights the lower cost wins, then the string that is least in
ASCII. Joining a label in front keeps that order, so shortest distances are summed from the end backwards, in topological
order; the labels that leave a state differ, so a tie is settled by the first of them and strings need not be compared. The
arcs that leave a pair of states depend on the turn's symbol and the grammar's state alone, and distances to the end differ
by a few units between the grammar's states: both are expanded once and remembered.

Two passes, each sorted by conversation and place. The first holds a conversation's symbols, a byte for each turn, and gives
the audit string, which is a value of the result and as long. In the second the texts stream behind their audit, to be
hashed: a task holds no text but a batch's. A conversation's hash is one chain by its definition, so its turns pass
through one task, whatever their number; no more than a batch of them is held.

Defined results: null roles and texts are one space. Turns of a conversation stand by turn (nulls first), then role, then the
hash of the text; equal rows are duplicates of the first of them. Rows without a conversation id form one conversation. Gaps
count turns that are not null. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import named, table

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: More for a truncated turn that stays.
TRUNCATED_COST = 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = "sua"
NAMES = {"u": "user", "a": "assistant"}
#: The grammar: the state behind each role, by state. States 0 (nothing yet) and 3 (behind an answer) accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
FAR = 1 << 40


def symbol(initial: str, fault: int) -> int:
    return max(0, ROLES.find(initial) + 1 if initial else 0) * 4 + fault


@lru_cache(None)
def arcs(turn: int, state: int) -> list[tuple[str, int, int]]:
    """``(label, cost, next state)`` of what the composed machine may do with a turn in a state of the grammar. All but
    INSERT go on to the next turn."""
    role, fault = " sua"[turn // 4], turn % 4
    out = [(DELETE, COST[DELETE], state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        if role in GRAMMAR[state]:
            out.append((KEEP, COST[KEEP] + more, GRAMMAR[state][role]))
        out += [(REROLE, COST[REROLE] + more, to) for r, to in GRAMMAR[state].items() if r in NAMES]
    return out + inserts(state)


@lru_cache(None)
def inserts(state: int) -> list[tuple[str, int, int]]:
    return [(INSERT, COST[INSERT], to) for r, to in GRAMMAR[state].items() if r in NAMES]


def _relax(found: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Inserts put before what follows: two at most lead from any state to any other that they reach."""
    for _ in range(2):
        found = [min([own, *((cost + found[to][0], label, to) for label, cost, to in inserts(s))], key=lambda x: x[:2]) for s, own in enumerate(found)]
    return found


@lru_cache(1 << 16)
def before(turn: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """From the distances behind a turn (less the least of them) to those before it: the least, the distances less it, and for
    each state the label and next state of the shortest path."""
    found = []
    for s in range(len(GRAMMAR)):
        own = [(cost + after[to], label, to) for label, cost, to in arcs(turn, s) if label != INSERT]
        found.append(min(own, key=lambda x: x[:2]))
    found = _relax(found)
    least = min(x[0] for x in found)
    return least, tuple(min(x[0] - least, FAR) for x in found), tuple(x[1:] for x in found)


@lru_cache(1)
def at_end() -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Distances to acceptance when no turn is left, and the label and next state of each state's path."""
    found = _relax([(0 if s in ACCEPTING else FAR, "", s) for s in range(len(GRAMMAR))])
    return tuple(x[0] for x in found), tuple(x[1:] for x in found)


def shortest(turns: bytes) -> tuple[int, str]:
    """Cost and labels of the shortest path through the composition with a chain of turns."""
    distance, last = at_end()
    total, steps = 0, []
    for t in reversed(turns):
        least, distance, choice = before(t, distance)
        total += least
        steps.append(choice)
    labels, state = [], 0
    for choice in [*reversed(steps), last]:
        while True:
            label, to = choice[state]
            labels.append(label)
            state = to
            if label != INSERT:
                break
    return total + distance[0], "".join(labels)


class Repair:
    """The repaired turns of a conversation, one after the other, by its audit string."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _insert(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._as("ua", "")

    def _as(self, roles: str, text: str) -> tuple[str, str]:
        role = next(r for r in GRAMMAR[self.state] if r in roles)
        self.state = GRAMMAR[self.state][role]
        return NAMES[role], text

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What stands in the place of one turn."""
        yield from self._insert()
        label = self.audit[self.at]
        self.at += 1
        if label == REROLE:
            yield self._as("ua", text)
        elif label == KEEP:
            self.state = GRAMMAR[self.state][role[:1]]
            yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insert()


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """``(conv, gone, turn, role, text, digest)``: the rows in the operator's own names."""
    own = rows.select(
        named(conv).alias("conv"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"),
        named(turn).cast("bigint").alias("turn"), F.coalesce(named(role), F.lit(" ")).alias("role"), F.coalesce(named(text), F.lit(" ")).alias("text"),
    )
    return own.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _faults(own: DataFrame) -> DataFrame:
    """``(conv, gone, turn, role, digest, fault)``: each turn's fault, but for repeats of equal rows, which their order shows."""
    # texts that are seen in several turns: aggregated before the shuffle, and only they go into the join
    seen = (
        own.where(~F.col("gone")).groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
        .where(F.col("first") < F.col("last"))
        .select(F.struct("conv", "role", "digest").alias("k"), F.col("first.turn").alias("first"), F.lit(True).alias("often"))
    )
    own = own.withColumns({
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "open": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    }).drop("text")
    own = own.join(seen, F.struct("conv", "role", "digest") == F.col("k"), "left")
    # nulls stand first: a turn with a number comes later than one without
    later = F.col("often") & F.coalesce(F.col("turn") > F.col("first"), F.col("turn").isNotNull())
    fault = F.when(F.col("blank"), BLANK).when(F.coalesce(later, F.lit(False)), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    return own.select("conv", "gone", "turn", "role", "digest", fault.cast("tinyint").alias("fault"))


def _symbols(batches: Iterator[pa.RecordBatch], counts: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of whole conversations in, a row for each conversation out."""
    schema = None
    done: list[tuple] = []
    conv = key = None
    started = False

    def row() -> tuple:
        cost, audit = shortest(bytes(held))
        low, high, many = turns_seen
        gaps = min(high - low + 1 - many, 2**63 - 1) if many else 0
        return (conv, gaps, *n[1:], illegal, cost, audit)

    for b in batches:
        if schema is None:
            schema = pa.schema([pa.field("conv", b.schema.field(0).type), *(pa.field(c, pa.int64()) for c in counts), pa.field("audit", pa.string())])
        for c, gone, turn, role, digest, fault in zip(*(x.to_pylist() for x in b.columns)):
            if not started or c != conv:
                if started:
                    done.append(row())
                conv, key, started = c, None, True
                held, n, illegal, initial, turns_seen = bytearray(), [0] * 4, 0, None, (0, 0, 0)
            if gone:
                continue
            if key == (turn, role, digest) and fault != BLANK:
                fault = DUPLICATE
            if turn is not None and (not turns_seen[2] or turn != turns_seen[1]):
                turns_seen = (turns_seen[0] if turns_seen[2] else turn, turn, turns_seen[2] + 1)
            key = (turn, role, digest)
            n[fault] += 1
            if initial is not None and initial + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            initial = role[:1]
            held.append(symbol(initial, fault))
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema=schema)
                done = []
    if started:
        done.append(row())
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema=schema)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *(c for c in rows.columns if c in ("place",)), "turn", "role", "digest")


def _audits(own: DataFrame) -> DataFrame:
    kind = own.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string"
    return _sorted(_faults(own)).mapInArrow(lambda batches: _symbols(batches, COUNTS), schema)


def _behind_audits(own: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit row (place 0) and then its turns (place 1), in order."""
    none = F.lit(None)
    lead = audits.select("conv", F.lit(0).alias("place"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("digest"), *COUNTS, "audit")
    rest = own.where(~F.col("gone")).select("conv", F.lit(1).alias("place"), "turn", "role", "text", "digest", *(none.cast("bigint").alias(c) for c in COUNTS), none.cast("string").alias("audit"))
    return _sorted(lead.unionByName(rest)).drop("digest")


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, a row for each conversation.

    Rows for which ``gone`` holds count for nothing, but their conversation is reported.
    """
    own = _turns(rows, conv, turn, role, text, gone)
    kind = own.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, at = None, None

        def close() -> dict:
            for r, x in at.end():
                put(r, x)
            return {**lead, "repaired_sha256": chain.hexdigest()}

        def put(r: str, x: str) -> None:
            nonlocal first
            chain.update(f"{'' if first else chr(10)}{r}:{x}".encode())
            first = False

        names = ["conv", *COUNTS, "audit"]
        schema, out = None, []
        for b in batches:
            if schema is None:
                schema = pa.schema([*(b.schema.field(c) for c in names), pa.field("repaired_sha256", pa.string())])
            leads = b.select(names).to_pylist() if b.num_rows else []
            for i, (place, r, x) in enumerate(zip(*(b.column(c).to_pylist() for c in ("place", "role", "text")))):
                if place == 0:
                    if lead is not None:
                        out.append(close())
                    lead, at, chain, first = leads[i], Repair(leads[i]["audit"]), hashlib.sha256(), True
                else:
                    for r2, x2 in at.turn(r, x):
                        put(r2, x2)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if lead is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=schema)

    schema = f"conv {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    return _behind_audits(own, _audits(own)).mapInArrow(run, schema).withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """``(conv_id, place, role, text)``: the repaired conversations, turns numbered from 0."""
    own = _turns(rows, conv, turn, role, text, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, at, n = None, None, 0
        for b in batches:
            schema = pa.schema([b.schema.field("conv"), pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())])
            out = []
            for c, place, r, x, audit_now in zip(*(b.column(k).to_pylist() for k in ("conv", "place", "role", "text", "audit"))):
                if place == 0:
                    if at is not None:
                        out += [(conv_now, *made) for made in at.end()]
                    conv_now, at = c, Repair(audit_now)
                else:
                    out += [(c, *made) for made in at.turn(r, x)]
            yield from numbered(out, schema)
        if at is not None:
            yield from numbered([(conv_now, *made) for made in at.end()], schema)

    last: list = [None, -1]

    def numbered(made: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows_out = []
        for c, r, x in made:
            last[:] = [[c], last[1] + 1 if last[0] == [c] else 0]
            rows_out.append({"conv": c, "place": last[1], "role": r, "text": x})
        if rows_out:
            yield pa.RecordBatch.from_pylist(rows_out, schema=schema)

    kind = own.schema["conv"].dataType.simpleString()
    return _behind_audits(own, _audits(own)).mapInArrow(run, f"conv {kind}, place bigint, role string, text string").withColumnRenamed("conv", conv)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` as the query damages them, by crc32 of ``conv_id:turn`` modulo 20: 0 marks a row as gone, 1 empties its
    text, 2 takes out its sentence marks, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    done = marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return done.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "again")


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    return audit(damage(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


#: The same in DuckDB: all suffixes' cheapest (cost, labels, turns) are carried from the end, whole strings compared.
OP12_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations
), crc AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(bytes, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS k
  FROM src
), hurt AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM crc CROSS JOIN (VALUES (1), (2)) t(again) WHERE k <> 0 AND (again = 1 OR k = 3)
), placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS ini,
    lag(left(role, 1)) OVER w || left(role, 1) AS two
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), first_seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM placed
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN dup THEN 2
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f
  FROM first_seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
    count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), go(conv_id, i, e) AS (
  SELECT conv_id, n + 1, [{'c': 0, 'a': '', 't': []::VARCHAR[]}, {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']},
    {'c': 2, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': []::VARCHAR[]}] FROM counts
  UNION ALL
  SELECT conv_id, i, list_transform(range(1, 5), lambda s: list_min([e1[s], {'c': 2 + e1[CASE s WHEN 3 THEN 4 ELSE 3 END].c,
    'a': 'I' || e1[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
    't': list_prepend(CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END, e1[CASE s WHEN 3 THEN 4 ELSE 3 END].t)}]))
  FROM (SELECT conv_id, i, list_transform(range(1, 5), lambda s: list_min([o[s], {'c': 2 + o[CASE s WHEN 3 THEN 4 ELSE 3 END].c,
    'a': 'I' || o[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
    't': list_prepend(CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END, o[CASE s WHEN 3 THEN 4 ELSE 3 END].t)}])) AS e1
  FROM (SELECT r.conv_id, r.i, list_transform(range(1, 5), lambda s: list_min(
    [{'c': 3 + e[s].c, 'a': 'D' || e[s].a, 't': e[s].t}]
    || CASE WHEN f IN (1, 2) THEN [] ELSE [{'c': 2 + (f = 3)::INT + e[CASE s WHEN 3 THEN 4 ELSE 3 END].c,
      'a': 'R' || e[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
      't': list_prepend(CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || text, e[CASE s WHEN 3 THEN 4 ELSE 3 END].t)}] END
    || CASE WHEN f IN (1, 2) OR NOT (ini = 's' AND s = 1 OR ini = 'u' AND s <> 3 OR ini = 'a' AND s = 3) THEN []
      ELSE [{'c': (f = 3)::INT + e[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c,
      'a': 'K' || e[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
      't': list_prepend(role || ':' || text, e[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t)}] END)) AS o
  FROM go JOIN faults r ON r.conv_id IS NOT DISTINCT FROM go.conv_id AND r.i = go.i - 1))
), best AS (SELECT conv_id, e[1] AS b FROM go WHERE i = 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""
