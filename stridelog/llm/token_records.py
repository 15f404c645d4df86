"""Token ids in length-delimited binary records with checksums and a separate offset index.

A shard is two files. ``<name>.records`` holds, for each document in order,

    length    8 bytes, little-endian, of the payload
    checksum  4 bytes, masked CRC-32 of the length field
    payload   the ids, little-endian, 2 bytes each (4 for vocabularies above 65,536)
    checksum  4 bytes, masked CRC-32 of the payload

and ``<name>.index`` one entry per record: document id and a byte that says whether it is NULL,
offset and length of the payload. A checksum is masked (rotated, then a constant added) so that
the checksum of data that holds checksums does not degenerate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_folder, staged, texts
from .vocabulary import encoder

INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u8")])
HEAD, TAIL = 12, 4
MANIFEST = "shard int, path string, width int, records bigint, ids bigint"
RECORDS = "shard int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint"
BUFFER = 1 << 20


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return ((((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")


def framed(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head), payload, masked(payload)))


def checked(record: bytes) -> bytes:
    """The payload of one whole record; ValueError if a length or checksum does not fit."""
    head, payload = record[:8], record[HEAD:-TAIL]
    if record[8:HEAD] != masked(head) or int.from_bytes(head, "little") != len(payload):
        raise ValueError("damaged record length")
    if record[-TAIL:] != masked(payload):
        raise ValueError("damaged record payload")
    return payload


def write_token_records(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write every document's ids and ``end_id`` in ascending id order; returns the manifest.

    Documents are range-partitioned by id, so a shard is one range and shards are in order (a
    NULL id comes first; rows with one id keep no particular order among themselves). A NULL or
    empty text is ``end_id`` alone; an empty input gives no shard. Each task attempt writes
    files of its own name and the manifest lists those of the attempts that succeeded, so a
    lost executor leaves at most files that nobody reads. Other columns of ``docs`` are not
    read. ``folder`` is any place that ``pyarrow.fs`` can write to.
    """
    spark = docs.sparkSession
    ordered = (
        texts(docs, id_col, text_col)
        .select("doc_id", F.col("text").cast("binary").alias("text"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        .sortWithinPartitions("doc_id")
    )
    return staged(ordered.mapInArrow(_writer(vocabulary, end_id, folder), MANIFEST), "manifest")


def read_token_records(manifest: DataFrame) -> DataFrame:
    """One row per record, read through the index and checked.

    ``first`` is the position of its first id in the shard. Shards are read by as many tasks as
    there are shards.
    """
    shards = manifest.repartition(int(manifest.count()) or 1, "shard")
    return shards.mapInArrow(_reader, RECORDS)


def read_record(path: str, entry: np.void, width: int) -> np.ndarray:
    """The ids of one record, found by its index entry (for reads in shuffled order)."""
    source, name = fs.FileSystem.from_uri(path + ".records")
    with source.open_input_file(name) as file:
        file.seek(int(entry["offset"]) - HEAD)
        record = file.read(int(entry["length"]) + HEAD + TAIL)
    return np.frombuffer(checked(record), f"<u{width}")


def read_index(path: str) -> np.ndarray:
    source, name = fs.FileSystem.from_uri(path + ".index")
    with source.open_input_stream(name) as file:
        return np.frombuffer(file.read(), INDEX)


def _writer(vocabulary: str, end_id: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/{context.partitionId():06d}-{uuid4().hex}"
        target, name = fs.FileSystem.from_uri(path)
        words = encoder(vocabulary)
        at = ids = records = 0
        data = index = None
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if data is None:
                        target.create_dir(name.rpartition("/")[0], recursive=True)
                        data = target.open_output_stream(name + ".records", buffer_size=BUFFER)
                        index = target.open_output_stream(name + ".index", buffer_size=BUFFER)
                    payload = np.append(words.encode(text.as_py()), end_id).astype(words.dtype)
                    data.write(framed(payload.tobytes()))
                    size = payload.nbytes
                    entry = (doc_id or 0, doc_id is not None, at + HEAD, size)
                    index.write(np.array([entry], INDEX).tobytes())
                    at, ids, records = at + size + HEAD + TAIL, ids + len(payload), records + 1
        finally:
            for file in (data, index):
                if file is not None:
                    file.close()
        if records:
            row = (context.partitionId(), path, words.dtype.itemsize, records, ids)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                ["shard", "path", "width", "records", "ids"],
            )

    return write


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            entries = read_index(shard["path"])
            if len(entries) != shard["records"]:
                raise ValueError(f"{shard['path']}: index and manifest differ")
            source, name = fs.FileSystem.from_uri(shard["path"] + ".records")
            first, sizes, crcs = 0, [], []
            with source.open_input_stream(name, buffer_size=BUFFER) as file:
                for length in entries["length"].tolist():
                    payload = checked(file.read(length + HEAD + TAIL))
                    ids = np.frombuffer(payload, f"<u{shard['width']}")
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            starts = np.cumsum([first, *sizes[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(entries), shard["shard"]), pa.int32()),
                    pa.array(entries["doc_id"], pa.int64(), mask=entries["known"] == 0),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
            )


def token_records(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the records to the shared folder and describe what is read back from the files.

    ``start`` counts the ids of all documents before; the sums that it needs are over shards.
    """
    manifest = write_token_records(docs, vocabulary, end_id, shared_folder(docs.sparkSession))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return read_token_records(manifest).join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_records(documents(spark, sf_dir), vocabulary, end_id=2)
