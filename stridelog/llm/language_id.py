"""Language identification by compression: the dictionary that compresses a text best wins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, is_held_out

#: Rows per language and code points of each that the dictionaries are cut from.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 1024
#: Bytes compressed at once, so that the dictionary stays in reach in long texts.
BLOCK = 4096
LEVEL = 3
#: Smallest lead of the winner over the runner-up, as a share of the runner-up's bytes.
MIN_MARGIN = 0.01
#: Bits of lead that make the winner ten times as likely as the runner-up in ``score``.
BITS_PER_TENFOLD = 64
UNKNOWN = "und"
# ASCII characters that are no letters become spaces.
_TO_WORDS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"


def learn_dictionaries(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Raw-content dictionaries by language from a bounded sample.

    Learns from rows that are not held out and have a text and a language: for each language the
    ``sample_rows`` rows whose ids hash lowest, and of each the first ``SAMPLE_CHARS`` code
    points, so at most 256 times 4 KB per language reach the driver. Only ids are ranked, after
    a limit inside each task; the texts of the chosen rows are fetched by a join.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(~is_held_out(F.col("doc_id")) & (F.length("text") > 0))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        rows.select("lang", "doc_id")
        .withColumn("nth", F.row_number().over(by_hash))
        .filter(F.col("nth") <= sample_rows)
    )
    cut = F.substring("text", 1, SAMPLE_CHARS).alias("cut")
    parts = (
        rows.select("lang", "doc_id", cut)
        .join(chosen, ["lang", "doc_id"])
        .groupBy("lang", "nth")
        .agg(F.min("cut").alias("cut"))
        .collect()
    )
    found: dict[str, list[tuple[int, str]]] = {}
    for row in parts:
        found.setdefault(row.lang, []).append((row.nth, row.cut))
    return {lang: plain(" ".join(t for _, t in sorted(cuts))) for lang, cuts in found.items()}


@lru_cache(maxsize=2)
def compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, object]]:
    out = []
    for lang, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        packed = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False
        )
        out.append((lang, packed.compress))
    return out


def plain(text: str) -> bytes:
    """Lower-cased words with single spaces: layout and marks tell nothing about the language."""
    return b" ".join(text.lower().encode().translate(_TO_WORDS).split())


def classify(text: str, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, accepted) of one whole text that holds a letter, whatever its case."""
    data = plain(text)
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = [
        (sum(len(compress(b)) for b in blocks), at, lang)
        for at, (lang, compress) in enumerate(compressors(dictionaries))
    ]
    ranked = sorted(sizes)
    best, lang = ranked[0][0], ranked[0][2]
    if len(ranked) == 1:
        return lang, 1.0, True
    second = ranked[1][0]
    odds = sum(10.0 ** (-8 * (size - best) / BITS_PER_TENFOLD) for size, _, _ in ranked)
    return lang, 1 / odds, (second - best) / second >= MIN_MARGIN


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row per input row with the predicted language of its whole text.

    ``und`` with score 0 if the text is NULL or has no letter (or no language was learned). Of
    equally small encodings the language first in order of name wins. ``score`` is the winner's
    share of the odds; ``accepted`` is false when the margin over the runner-up is narrow, which
    callers that want to reject use. Rows are independent: ids may be NULL or repeated, texts of
    any length are compressed whole in blocks. Only id and text are read.
    """
    models = tuple(sorted(dictionaries.items()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float, bool]] = []
            for value in batch.column(2):
                text = value.as_py()
                if not text or not models or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, False))
                else:
                    out.append(classify(text, models))
            langs, scores, accepted = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(accepted, pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").alias("text"),
    ).mapInArrow(predict, SCHEMA)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify_language(docs, learn_dictionaries(docs))
