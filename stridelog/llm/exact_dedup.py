"""Exact duplicates: a 128-bit digest finds the groups, the bytes confirm them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, null_safe, staged, stripped, texts, unused

#: Members of a group that are compared with one copy of the group's first text.
MEMBERS_PER_COPY = 1000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Texts are equal when they are so without their white space; NULL counts as empty. The row
    with the most code points in its original text stays, then the one with the smallest id
    (a NULL id comes last), then the first of rows that agree in both, so exactly one row of a
    group has ``kept``. ``keep_id`` is the id of that row, ``group_size`` counts rows. An empty
    input gives an empty result; other columns of ``docs`` are not read.

    Groups come from an MD5 digest, counted before the shuffle. Inside each group every text is
    then compared byte by byte with one text of the group, which is copied once per
    ``MEMBERS_PER_COPY`` members so that no task sees a large group whole. A text that differs
    in spite of an equal digest forms a group by its SHA-256.
    """
    rows = texts(docs, id_col, text_col)
    bare = stripped(F.col("text"))
    light = staged(
        rows.select(
            "doc_id",
            F.unhex(F.md5(bare)).alias("digest"),
            F.sha2(bare, 256).alias("text_sha256"),
            F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    differing = _differing(rows, light).withColumn("differs", F.lit(True))
    keys = ["doc_id", "digest", "text_sha256"]
    classed = null_safe(light, differing, keys, "left").withColumn(
        "variant", F.when(F.col("differs"), F.col("text_sha256")).otherwise("")
    )
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")
    best = F.min(order)
    groups = classed.groupBy("digest", "variant").agg(
        best.alias("best"), F.count("*").alias("group_size")
    )
    return classed.join(groups, ["digest", "variant"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def _differing(rows: DataFrame, light: DataFrame) -> DataFrame:
    """Keys of the rows whose bytes differ from those of the first row of their digest."""
    groups = light.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    members = (
        light.join(groups.filter("n > 1"), "digest")
        .groupBy("doc_id", "digest", "text_sha256")
        .agg(F.max(F.col("row") == F.col("first")).alias("is_first"), F.max("n").alias("n"))
        .withColumn("copies", F.ceil(F.col("n") / MEMBERS_PER_COPY).cast("int"))
    )
    bytes_of = (
        null_safe(rows, members, ["doc_id"], "inner")
        .withColumn("bare", stripped(F.col("text")))
        .filter(F.sha2("bare", 256) == F.col("text_sha256"))
        .drop("text")
    )
    first = (
        bytes_of.filter("is_first")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("digest", "copy", F.col("bare").alias("first_bare"))
    )
    copy = F.pmod(F.xxhash64("doc_id", "text_sha256"), F.col("copies")).cast("int")
    return (
        bytes_of.withColumn("copy", copy)
        .join(first, ["digest", "copy"])
        .groupBy("doc_id", "digest", "text_sha256")
        .agg(F.max(F.col("bare") == F.col("first_bare")).alias("same"))
        .filter(~F.col("same"))
        .drop("same")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of rows repeated with one id, one stays."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    sha, copy = unused(docs, "sha", "copy")
    same = Window.partitionBy("doc_id", sha).orderBy(F.char_length("text").desc_nulls_last())
    marked = docs.withColumn(sha, F.sha2(stripped(F.col("text")), 256))
    return (
        null_safe(marked, kept.withColumnRenamed("text_sha256", sha), ["doc_id", sha], "left_semi")
        .withColumn(copy, F.row_number().over(same))
        .filter(F.col(copy) == 1)
        .select(*docs.columns)
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op4_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               row_number() OVER w = 1 AS kept, sha AS text_sha256
        FROM bare WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
    """
}
