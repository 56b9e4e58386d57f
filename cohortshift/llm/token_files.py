"""Token-ID output: fixed-width bit packing in files of blocks.

A file holds whole documents in ascending doc_id order, and all files together, by name, hold the corpus in
that order. Little-endian layout: magic, bits, block size, documents, ids (HEADER); doc_id (int64) and id
count (int64) of each document; a byte offset (int64) for each block and the end; the payload. Every id takes
the fewest bits that hold the vocabulary; `block` ids make a block, so that numpy unpacks any block by itself.

Executors write each file under a temporary name and rename it, so a repeated task leaves the same files.
A file takes about `file_bytes`, more only if one document does.

Defined cases: a null or empty text is the end id alone; rows without a doc_id are left out; repeated doc_ids
stay in text order; an empty table writes no file and reads back as no row; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, small_batches
from .tokens import encoder

MAGIC, HEADER, BLOCK, FILE_BYTES = b"TKB1", struct.Struct("<4sIIqq"), 4096, 32 << 20


def bit_width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian bit fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    fields = np.zeros((n, 32), np.uint8)
    fields[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(fields, axis=1, bitorder="little").view("<u4").ravel()


def to_bytes(doc_ids: list[int], counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A whole file."""
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<i8")
    head = HEADER.pack(MAGIC, bits, block, len(doc_ids), len(ids))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to a file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, blocks = HEADER.size, -(-self.n_ids // self.block)
        self.doc_ids, self.counts = (np.frombuffer(self.data, "<i8", n, at + k * 8 * n) for k in (0, 1))
        self.offsets = np.frombuffer(self.data, "<i8", blocks + 1, at + 16 * n)
        self.payload = at + 16 * n + 8 * (blocks + 1)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start`; only their blocks are unpacked."""
        if not n:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            size = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.data[self.payload + self.offsets[b] : self.payload + self.offsets[b + 1]], self.bits, size))
        return np.concatenate(parts)[start - first * self.block :][:n]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))


def write_token_files(docs: DataFrame, out: str, scratch: Scratch, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns their list (file, n_docs, n_ids, first): first counts the ids of files before."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        part, k, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        bits = bit_width(enc.tokenizer.get_vocab_size())
        doc_ids, pieces, size = [], [], 0

        def flush():
            nonlocal k, doc_ids, pieces, size
            name = f"{part:07d}-{k:06d}.tokbin"
            data = to_bytes(doc_ids, [len(p) for p in pieces], np.concatenate(pieces), bits)
            own = f"{root}/_tmp-{uuid.uuid4().hex}-{os.getpid()}"
            with store.open_output_stream(own) as f:
                f.write(data)
            store.move(own, f"{root}/{name}")
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([sum(map(len, pieces))], pa.int64())})
            doc_ids, pieces, size, k = [], [], 0, k + 1
            return row

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                pieces.append(np.append(ids, np.array(end_id, enc.dtype)))
                size += len(pieces[-1]) * bits // 8
                if size >= file_bytes:
                    yield flush()
        if pieces:
            yield flush()

    files = scratch.save(d.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "files")
    # sums of the ids before: of whole parts, a row for each shuffle partition, then within a part
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("t")).select("part", before("t", Window.orderBy("part")).alias("base"))
    own = files.withColumn("own", before("n_ids", Window.partitionBy("part").orderBy("file"))).join(parts, "part")
    return own.select("file", "n_docs", "n_ids", (F.col("base") + F.col("own")).alias("first"))


def read_token_files(spark, out: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' bytes."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = TokenFile(data.as_buffer())
                ids = f.ids(0, f.n_ids)
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                name = [path.rsplit("/", 1)[-1]] * len(crcs)
                yield pa.record_batch({"file": name, "doc_id": pa.array(f.doc_ids), "local": pa.array(f.starts[:-1]), "n_tokens": pa.array(f.counts), "ids_crc32": pa.array(crcs, pa.int64())})

    blobs = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.tokbin").load(out).select("path", "content")
    rows = blobs.mapInArrow(read, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("file", "first"), "file").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark)
    out = scratch.path("tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_token_files(docs, out, scratch, public_tokenizers.path("byte_bpe_50k.json"), 0)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, out, files)
