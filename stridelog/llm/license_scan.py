"""License texts found by diagonal voting on word k-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Words of a k-gram. Two, because the shortest phrases have two words.
K = 2
#: Diagonals this near each other belong to one span: so many words may be missing or added at a
#: place. In all a span may be longer than its template by as many and a quarter.
DRIFT = 3
#: Positions of a template whose votes share a number.
BLOCK = 63
#: Least share of a template's k-grams that a span of its own labels must hold.
MIN_COVER = 0.7

# Phrases whose every occurrence counts, by label.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Sentences of well-known licenses, by label.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of "
    "the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the creative commons attribution": "cc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
}

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z only): runs of letters, digits and all beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lower, _BREAK), lambda w: w != "")


def _templates(spark: SparkSession, phrases: dict[str, str], base: bool) -> DataFrame:
    """One row per k-gram of each template: as many rows as the given phrases have words."""
    rows = [
        (phrase, label, base, len(phrase.split()), at, *phrase.split()[at : at + K])
        for phrase, label in phrases.items()
        for at in range(len(phrase.split()) - K + 1)
    ]
    names = "template string, label string, base boolean, size int, at int, w0 string, w1 string"
    return spark.createDataFrame(rows, names)


def spans(
    docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES
) -> DataFrame:
    """Verified occurrences: doc_id, text_key, template, label, base, first, last, cover.

    All k-grams of all texts are hashed and joined to the positions of the templates' k-grams
    (which are given, so they are broadcast), and the words are compared where hashes agree.
    Votes are counted by offset diagonal (position in the text minus position in the template),
    within tasks before the shuffle. A base phrase is found where its diagonal has all its
    k-grams. For other templates (of any length) a diagonal that holds ``MIN_COVER`` of the
    template is an occurrence; else diagonals at most ``DRIFT`` apart are merged to a span, which
    is verified: of its k-grams, each at its first place there, those count that stand after all
    that precede them in the template, and the words from the first to the last of these may be
    no more than the template's, a quarter and ``DRIFT``. Words in another order are no occurrence.
    """
    spark = docs.sparkSession
    grams = _templates(spark, base, True).unionByName(_templates(spark, templates, False))
    grams = F.broadcast(grams.withColumn("gram", F.xxhash64("w0", "w1")))
    gram = "transform(words, (w, i) -> struct(xxhash64(w, get(words, i + 1)) AS gram, w AS x0, get(words, i + 1) AS x1))"
    places = (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
        .select("doc_id", "text_key", F.posexplode(F.expr(gram)).alias("pos", "found"))
        .select("doc_id", "text_key", "pos", "found.gram", "found.x0", "found.x1")
    )
    of = ["doc_id", "text_key", "template", "label", "base", "size"]
    votes = (
        places.join(grams, "gram")
        .filter((F.col("x0") == F.col("w0")) & (F.col("x1") == F.col("w1")))
        .groupBy(*of, (F.col("pos") - F.col("at")).alias("diagonal"), F.expr(f"at DIV {BLOCK}").alias("block"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, at % {BLOCK})")).alias("seen"))
    )
    # All blocks of a diagonal: its votes, and the first and last place of them.
    low = F.min(F.expr(f"diagonal + CAST(block AS INT) * {BLOCK} + bit_count((seen & -seen) - 1)"))
    high = F.max(F.expr(f"diagonal + CAST(block AS INT) * {BLOCK} + length(bin(seen)) - 1"))
    share = F.sum(F.bit_count("seen")) / (F.col("size") - K + 1)
    diagonals = votes.groupBy(*of, "diagonal").agg(
        share.alias("cover"), low.alias("first"), high.alias("last")
    )
    exact = diagonals.filter(F.when(F.col("base"), F.col("cover") == 1).otherwise(F.col("cover") >= MIN_COVER))
    by_text = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_text)
    apart = (F.coalesce(gap, F.lit(DRIFT + 1)) > DRIFT).cast("int")
    merged = (
        votes.filter(~F.col("base"))
        .withColumn("span", F.sum(apart).over(by_text))
        .withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {BLOCK - 1}), b -> shiftright(seen, b) & 1 = 1)")))
        .withColumn("at", (F.col("block") * BLOCK + F.col("bit")).cast("int"))
        .groupBy(*of, "span", "at")
        .agg(F.min(F.col("diagonal") + F.col("at")).alias("pos"))
    )
    in_order = Window.partitionBy("doc_id", "text_key", "template", "span").orderBy("at")
    before = F.max("pos").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    verified = (
        merged.withColumn("before", before)
        .filter(F.col("before").isNull() | (F.col("pos") > F.col("before")))
        .groupBy(*of, "span")
        .agg(
            (F.count(F.lit(1)) / (F.col("size") - K + 1)).alias("cover"),
            F.min("pos").alias("first"),
            F.max("pos").alias("last"),
        )
        .filter(F.col("cover") >= MIN_COVER)
        .filter(F.col("last") - F.col("first") + K <= F.col("size") + F.expr("size DIV 4") + DRIFT)
    )
    columns = ["doc_id", "text_key", "template", "label", "base", "first", "last", "cover"]
    return exact.select(*columns).unionByName(verified.select(*columns))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: words, places of base phrases, labels, score of the best span.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase, NULL if
    there is none; ``score`` is the largest cover of a template, 0 without one. NULL and empty
    texts have no words. A row is identified by id and text, so rows with equal or NULL ids do
    not mix and repeated rows get equal results. Other columns of ``docs`` are not read.
    """
    found = spans(docs).groupBy("doc_id", "text_key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("last_word"),
        _joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        _joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"),
    )
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    on = rows.doc_id.eqNullSafe(found.found_id) & (rows.text_key == found.found_key)
    return rows.join(found, on, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(labels)), ",")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    """The same votes in standard SQL, from single places instead of bit sets."""
    rows = ", ".join(
        f"('{phrase}', '{label}', {base}, {len(phrase.split())}, {at}, '{pair}')"
        for phrases, base in ((BASE, "true"), (TEMPLATES, "false"))
        for phrase, label in phrases.items()
        for at, pair in enumerate(map(" ".join, zip(phrase.split(), phrase.split()[1:])))
    )
    return rf"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ),
        template(phrase, label, base, size, place, pair) AS (VALUES {rows}),
        places AS (
            SELECT doc_id, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS pair
            FROM split, range(1, len(words)) AS r(i)
        ),
        votes AS (
            SELECT doc_id, phrase, label, base, size, pos - place AS diagonal, place, pos
            FROM places JOIN template USING (pair)
        ),
        diagonals AS (
            SELECT doc_id, phrase, label, base, size, diagonal, min(pos) AS first,
                   count(DISTINCT place)::DOUBLE / (size - 1) AS cover
            FROM votes GROUP BY doc_id, phrase, label, base, size, diagonal
        ),
        exact AS (
            SELECT doc_id, label, base, first, cover FROM diagonals
            WHERE CASE WHEN base THEN cover = 1 ELSE cover >= {MIN_COVER} END
        ),
        steps AS (
            SELECT doc_id, phrase, diagonal, diagonal - lag(diagonal) OVER w AS gap
            FROM diagonals WHERE NOT base WINDOW w AS (PARTITION BY doc_id, phrase ORDER BY diagonal)
        ),
        islands AS (
            SELECT *, sum((coalesce(gap, {DRIFT + 1}) > {DRIFT})::INT) OVER w AS span FROM steps
            WINDOW w AS (PARTITION BY doc_id, phrase ORDER BY diagonal)
        ),
        firsts AS (
            SELECT v.doc_id, v.phrase, label, size, span, place, min(pos) AS pos
            FROM votes v JOIN islands i
              ON v.doc_id = i.doc_id AND v.phrase = i.phrase AND v.diagonal = i.diagonal
            WHERE NOT v.base GROUP BY ALL
        ),
        chained AS (
            SELECT *, pos > coalesce(max(pos) OVER (PARTITION BY doc_id, phrase, span ORDER BY place
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS in_order
            FROM firsts
        ),
        near AS (
            SELECT doc_id, label, false AS base, min(pos) AS first,
                   count(*)::DOUBLE / (size - 1) AS cover
            FROM chained WHERE in_order GROUP BY doc_id, phrase, label, size, span
            HAVING count(*)::DOUBLE / (size - 1) >= {MIN_COVER}
               AND max(pos) - min(pos) + {K} <= size + size // 4 + {DRIFT}
        ),
        found AS (
            SELECT doc_id, count(*) FILTER (WHERE base) AS n_base,
                   min(first) FILTER (WHERE base) AS first_word,
                   max(first) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
            FROM (SELECT * FROM exact UNION ALL SELECT * FROM near) GROUP BY doc_id
        )
        SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
               first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0)::DOUBLE AS score
        FROM split s LEFT JOIN found f ON s.doc_id = f.doc_id
    """


SQL = {"op3_license_scan": _sql()}
