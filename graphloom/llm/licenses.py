"""License scans by diagonal voting, with DataFrame operations only.

Every word k-gram of every text is hashed and joined to the positions of the same k-gram in the license
templates. A hit at word p of a text and word q of a template votes for the diagonal p - q: where the
template would start. Votes are counted for each diagonal, neighbouring diagonals are merged (words put in
or left out, such as the name of a holder, move what follows to another diagonal) and the merged spans are verified by the
share of the template's k-grams they hold. Templates are phrases, notices and whole bodies of licenses, so a body is
recognised without its heading and with parts missing.

The templates are a fixed list, so their table is small by construction and is broadcast; the k-grams
stream through that join inside one scan, and only hits and one row for each text are shuffled.

Defined results: a null text counts as empty. A text without words has n_words 0. Without hits the labels
are empty strings, the score 0 and the positions null. Repeated rows give equal rows. A place is counted
for each phrase that stands there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.llm.common import materialise, named, table
from graphloom.llm.license_texts import BODIES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a k-gram; templates of fewer words use k-grams of their own length.
K = 3
#: Diagonals at most so far apart are merged; of long templates, as far as one word in so many.
NEAR, NEAR_SHARE = 2, 20
#: Least share of a template's k-grams in a verified span.
COVER = 0.6

# The phrases of the base labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Wordings of notices that the method itself labels, matched by diagonal votes.
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def templates() -> list[tuple[int, str, bool, int, int, int, str]]:
    """``(template, label, is_base, k, grams, position, gram)`` of every k-gram."""
    out = []
    for t, (label, phrase, base) in enumerate([*((a, b, True) for a, b in BASE), *((a, b, False) for a, b in (*NOTICES, *BODIES))]):
        w = re.findall(WORD, phrase.lower())
        k = min(K, len(w))
        out += [(t, label, base, k, len(w) - k + 1, i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return out


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, a row for each row of ``docs``."""
    spark = docs.sparkSession
    known = spark.createDataFrame(templates(), "tpl int, label string, base boolean, k int, grams int, tpos int, gram string")
    # a gram may stand in several templates: one row for each gram, so that the join never multiplies rows
    by_gram = {
        k: F.broadcast(
            known.where(F.col("k") == k).groupBy(F.xxhash64(F.split("gram", " ")).alias(f"h{k}"))
            .agg(F.collect_list(F.struct("tpl", "label", "base", "grams", "tpos")).alias(f"at{k}"))
        )
        for k in sorted({t[3] for t in templates()})
    }
    words = F.regexp_extract_all(F.translate(F.coalesce(named(text), F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    rows = docs.select(named(row_id).alias("doc_id"), F.struct(named(row_id).alias("id"), F.xxhash64(named(text)).alias("h")).alias("row"), words.alias("w"))
    rows = rows.select("doc_id", "row", "w", F.posexplode_outer("w").alias("pos", "word"))
    for k, grams in by_gram.items():
        gram = F.array(*(F.get("w", F.col("pos") + i) for i in range(k)))
        rows = rows.join(grams.withColumnRenamed(f"h{k}", f"g{k}"), F.xxhash64(gram) == F.col(f"g{k}"), "left")
    ats = [F.coalesce(F.col(f"at{k}"), F.array()) for k in by_gram]
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    rows = rows.where(first | F.coalesce(*(F.col(f"at{k}") for k in by_gram)).isNotNull())
    seen = materialise(
        rows.select("doc_id", "row", "pos", first.alias("first"), F.size("w").cast("bigint").alias("n_words"), F.concat(*ats).alias("hits")), "license-hits"
    )

    hits = seen.where(F.size("hits") > 0).select("row", "pos", F.inline("hits")).withColumn("diag", F.col("pos") - F.col("tpos"))
    hits = hits.select("row", "tpl", "label", "base", "grams", "diag", "tpos").distinct()
    votes = hits.groupBy("row", "tpl", "label", "base", "grams", "diag").agg(F.collect_set("tpos").alias("tpos"))
    places = votes.where(F.col("base") & (F.size("tpos") == F.col("grams")))
    order = W.partitionBy("row", "tpl").orderBy("diag")
    near = F.greatest(F.lit(NEAR), F.floor(F.col("grams") / NEAR_SHARE))
    apart = F.coalesce(F.col("diag") - F.lag("diag").over(order) > near, F.lit(False)).cast("int")
    spans = (
        votes.where(~F.col("base")).withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
        .groupBy("row", "tpl", "label", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("n"))
        .withColumn("cover", F.col("n") / F.col("grams")).where(F.col("cover") >= COVER)
    )
    found = (
        places.select("row", "label", F.lit(True).alias("base"), F.col("diag").cast("bigint").alias("start"), F.lit(1.0).alias("cover"))
        .unionByName(spans.select("row", "label", F.lit(False).alias("base"), F.lit(None).cast("bigint").alias("start"), "cover"))
        .groupBy(F.col("row").alias("r"))
        .agg(
            F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
        )
    )
    return seen.where("first").join(found, F.col("row") == F.col("r"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({t}, '{label}', {str(base).lower()}, {k}, {n}, {i}, '{gram}')" for t, label, base, k, n, i, gram in templates())
#: DuckDB's form of op7, with grams compared as strings.
OP7_SQL = rf"""
WITH tg(tpl, label, base, k, grams, tpos, gram) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
n AS (SELECT rid, pos, word, lead(word, 1) OVER r AS w1, lead(word, 2) OVER r AS w2 FROM p WINDOW r AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, 2 AS k, word || ' ' || w1 AS gram FROM n UNION ALL SELECT rid, pos, 3, word || ' ' || w1 || ' ' || w2 FROM n),
h AS (SELECT rid, tpl, label, base, grams, tpos, pos - tpos AS diag FROM g JOIN tg USING (k, gram)),
v AS (SELECT rid, tpl, label, base, grams, diag, list(DISTINCT tpos) AS tpos FROM h GROUP BY ALL),
b AS (SELECT rid, label, true AS base, diag::BIGINT AS start, 1.0::DOUBLE AS cover FROM v WHERE base AND len(tpos) = grams),
s0 AS (SELECT *, coalesce((diag - lag(diag) OVER (PARTITION BY rid, tpl ORDER BY diag) > greatest({NEAR}, grams // {NEAR_SHARE}))::INT, 0) AS apart FROM v WHERE NOT base),
s1 AS (SELECT *, sum(apart) OVER (PARTITION BY rid, tpl ORDER BY diag) AS span FROM s0),
s2 AS (SELECT rid, label, grams, len(list_distinct(flatten(list(tpos)))) / grams AS cover FROM s1 GROUP BY rid, tpl, label, grams, span),
f AS (SELECT * FROM b UNION ALL SELECT rid, label, false, NULL, cover FROM s2 WHERE cover >= {COVER}),
a AS (SELECT rid, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
  coalesce(string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END), '') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (rid)
"""
