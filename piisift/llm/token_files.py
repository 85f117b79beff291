"""Token-id files: one zstandard dictionary for all, each document compressed alone.

A shard file holds, in this order: ``MAGIC``, the SHA-256 of the shared dictionary, one zstandard frame
per document (its ids as little-endian unsigned 32-bit integers), the offset index (three little-endian
arrays: 64-bit frame offsets, 32-bit frame lengths, 32-bit id counts), the document count (64 bits) and
``MAGIC`` again.  A reader takes the tail, then seeks to any document without touching the others.
The dictionary lies beside the shards; a reader refuses a shard whose hash names another one.

``write_token_files`` encodes and compresses documents where they are read and stores the frames in the
shared folder.  Only frames are then ordered by key, over ranges as many as the input has splits; each task
writes one shard under a name of its own attempt, and the row index (Parquet, committed by Spark) names the
shards that count, so a task that is lost or run twice leaves no trace in the result.

Defined cases: null text is empty; an empty text has the end id alone; null keys come first; rows with
equal keys are all kept, in the order of their texts' hashes; an empty table gives no shard and no row;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_ids import ids_for
from .common import by_range, scratch, slices, store_of, table, text_of, written

MAGIC = b"TOKIDS01"
#: Documents whose ids train the dictionary, and the most bytes taken of each, from a hashed place of its text.
#: The dictionary changes sizes only, never ids; the sample is the rows of smallest key hash.
SAMPLE_DOCS, SAMPLE_BYTES = 512, 16_384
DICT_BYTES = 65_536


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; empty when there is too little to learn."""
    import zstandard
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the trainer refuses samples without common parts
        return b""


def _codec(dictionary: bytes):
    import zstandard
    zd = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    kw = {"dict_data": zd} if zd else {}
    return zstandard.ZstdCompressor(level=3, **kw), zstandard.ZstdDecompressor(**kw)


class ShardWriter:
    def __init__(self, sink, dictionary: bytes):
        self.sink, (self.press, _) = sink, _codec(dictionary)
        self.at, self.offsets, self.sizes, self.counts = 0, [], [], []
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, ids: bytes) -> int:
        return self.add_frame(self.press.compress(ids), len(ids) // 4)

    def add_frame(self, frame: bytes, n_tokens: int) -> int:
        """A document's compressed ids; its place in the shard."""
        self.offsets.append(self.at)
        self.sizes.append(len(frame))
        self.counts.append(n_tokens)
        self._put(frame)
        return len(self.offsets) - 1

    def close(self) -> None:
        self._put(np.array(self.offsets, "<u8").tobytes() + np.array(self.sizes, "<u4").tobytes()
                  + np.array(self.counts, "<u4").tobytes()
                  + len(self.offsets).to_bytes(8, "little") + MAGIC)
        self.sink.close()


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, source, dictionary: bytes):
        self.source, (_, self.open) = source, _codec(dictionary)
        head = self._get(0, len(MAGIC) + 32)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or written with another dictionary")
        end = source.size()
        tail = self._get(end - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("the token file is cut short")
        n = int.from_bytes(tail[:8], "little")
        index = self._get(end - 16 - 16 * n, 16 * n)
        self.offsets = np.frombuffer(index, "<u8", n)
        self.sizes = np.frombuffer(index, "<u4", n, 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 12 * n)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def __len__(self) -> int:
        return len(self.offsets)

    def ids(self, i: int) -> bytes:
        frame = self._get(self.offsets[i], self.sizes[i])
        return self.open.decompress(frame, max_output_size=max(1, int(self.counts[i]) * 4))


def _sample(docs: DataFrame, key: str, text: str, path: str) -> list[bytes]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = ids_for(path).encode(b.column(0).to_pylist())
            yield pa.record_batch([pa.array([x[:SAMPLE_BYTES] for x in ids], pa.binary())], ["ids"])

    # the sample only looks for common byte runs, so a piece of each text serves
    size = 4 * SAMPLE_BYTES
    place = F.pmod("p", F.greatest(F.length("t") - size, F.lit(0)) + 1) + 1
    hashed = docs.withColumn("h", F.xxhash64(key))
    # the keys alone tell which rows these are, so that no other row's text is looked at
    last = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    few = (hashed.filter(F.col("h") <= F.lit(last)).select(text_of(text).alias("t"), F.xxhash64(F.lit("place"), key).alias("p"), "h")
           .select(F.substring("t", place.cast("int"), F.lit(size)).alias("t"), "h")
           .orderBy("h").limit(SAMPLE_DOCS).select("t"))
    return [bytes(r[0]) for r in few.mapInArrow(encode, "ids binary").collect()]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                      end_id: int = 0) -> DataFrame:
    """Write all documents' ids under ``folder``; return the row index:
    key, shard, ordinal, part, local_start, n_tokens, start."""
    spark = docs.sparkSession
    dictionary = train_dictionary(_sample(docs, key, text, tokenizer))
    fs, path = store_of(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.zdict") as out:
        out.write(dictionary)
    end = int(end_id).to_bytes(4, "little")
    key_type = docs.schema[key].dataType

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, _ = _codec(dictionary)
        for b in slices(batches):
            ids = [x + end for x in ids_for(tokenizer).encode(b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(press.compress, ids), pa.binary()),
                                   pa.array([len(x) // 4 for x in ids], pa.int64())], ["key", "h", "frame", "n_tokens"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, total = None, 0
        for b in slices(batches):
            if writer is None:
                name = f"shard-{uuid.uuid4().hex}.tok"  # of this attempt alone
                store, where = store_of(folder)
                writer = ShardWriter(store.open_output_stream(f"{where}/{name}"), dictionary)
            n = b.column(2).to_numpy()
            starts = total + np.cumsum(n) - n
            total += int(n.sum())
            ordinals = [writer.add_frame(x, k) for x, k in zip(b.column(1).to_pylist(), n.tolist())]
            yield pa.record_batch([b.column(0), pa.array([name] * len(n)), pa.array(ordinals, pa.int64()),
                                   b.column(3), pa.array(starts), b.column(2)],
                                  ["key", "shard", "ordinal", "part", "local_start", "n_tokens"])
        if writer is not None:
            writer.close()

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("t")).select("key", F.xxhash64("t").alias("h"), "t")
    frames = written(rows.mapInArrow(compress, f"key {key_type.simpleString()}, h long, frame binary, n_tokens long"), "frames")
    ordered = (by_range(frames, "key").sortWithinPartitions("key", "h")
               .select("key", "frame", "n_tokens", F.spark_partition_id().cast("long").alias("part")))
    schema = f"key {key_type.simpleString()}, shard string, ordinal long, part long, local_start long, n_tokens long"
    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    index = spark.read.schema(schema).parquet(f"{folder}/index")
    # one row per shard: partitions are ranges of the key, so sums over parts give each shard's start
    shards = index.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("tokens"))
    bases = shards.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("base"))
    return (index.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")
            .withColumnRenamed("key", key))


def read_token_files(index: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """The documents of the given index rows, read from their shards: key, start, n_tokens, ids."""
    key_type = index.schema[key].dataType
    fs, path = store_of(folder)
    with fs.open_input_file(f"{path}/dictionary.zdict") as src:
        dictionary = src.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = store_of(folder)
        shard, reader = None, None
        for b in slices(batches):
            ids = []
            for name, i in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if name != shard:
                    if reader is not None:
                        reader.source.close()
                    shard, reader = name, ShardReader(store.open_input_file(f"{where}/{name}"), dictionary)
                ids.append(reader.ids(i))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())],
                                  ["key", "start", "n_tokens", "ids"])
        if reader is not None:
            reader.source.close()

    cols = index.select(F.col(key).alias("key"), "start", "n_tokens", "shard", "ordinal")
    return cols.mapInArrow(read, f"key {key_type.simpleString()}, start long, n_tokens long, ids binary") \
        .withColumnRenamed("key", key)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids in token files, read the files back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "token-files")
    index = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(index, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
