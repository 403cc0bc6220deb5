"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file is, in this order:

* frames of at most FRAME_IDS ids (more only for one longer document), each a whole number of
  documents as little-endian unsigned 32-bit ids, each a zstandard frame with content size and
  checksum;
* a skippable frame with the document index: a zstandard frame of (key, flag for a null key,
  ids, frame) columns, little-endian 64-bit;
* the seek table in the zstandard seekable format: a skippable frame of (compressed size,
  decompressed size, checksum) for each frame, the number of frames, a descriptor byte, and
  the magic number 0x8F92EAB1. Checksums are the low 32 bits of XXH64 of the decompressed data.

Readers take the last bytes of the file, then the index, then only the frames they want.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import fresh_path, partitions, written
from quillspan.llm.ordered import NULL_KEY
from quillspan.llm.tokens import crc32, encoder, with_end

# Fixed values of the formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids in a frame before it is closed.
FRAME_IDS = 1 << 16


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a path, and the path in it; plain paths are local or mounted folders."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one file under a temporary name and renames it when it is whole."""

    def __init__(self, uri: str, level: int = 1):
        self.uri = uri
        self.store, self.path = filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.part)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.waiting and self.waiting + len(ids) > FRAME_IDS:
            self._frame()
        self.index.append((key or 0, int(key is None), len(ids), len(self.frames)))
        self.held.append(ids)
        self.waiting += len(ids)

    def _frame(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.waiting = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.pack.compress(np.array(self.index, dtype="<i8").reshape(-1, 4).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # The index is listed as a frame of no decompressed bytes, so offsets add up to the seek table.
        entries = [*self.frames, (len(index) + 8, 0, 0)]
        body = b"".join(struct.pack("<III", *x) for x in entries) + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.out.close()
        self.store.move(self.part, self.path)


class Reader:
    """Random access to one file; ``frames_read`` counts the frames it had to decompress."""

    def __init__(self, uri: str):
        self.store, self.path = filesystem(uri)
        self.file = self.store.open_input_file(self.path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri}: no seek table")
        table = self.file.read_at(12 * count, size - 9 - 12 * count)
        self.entries = [struct.unpack_from("<III", table, 12 * i) for i in range(count)]
        self.offsets = np.concatenate(([0], np.cumsum([e[0] for e in self.entries]))).tolist()
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(self.file.read_at(self.entries[-1][0] - 8, self.offsets[count - 1] + 8))
        self.index = np.frombuffer(raw, dtype="<i8").reshape(-1, 4)
        self.frames_read = 0

    def frame(self, i: int) -> np.ndarray:
        packed, size, checksum = self.entries[i]
        raw = self.unpack.decompress(self.file.read_at(packed, self.offsets[i]))
        self.frames_read += 1
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"{self.path}: frame {i} is damaged")
        return np.frombuffer(raw, dtype="<u4")

    def documents(self, keys: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, ids before it in the file, ids) of all documents or of those asked for, frame by frame."""
        before, frame, data, at = 0, -1, np.zeros(0, dtype="<u4"), 0
        for key, null, n, of in self.index.tolist():
            if of != frame:
                frame, data, at = of, None, 0
            if keys is None or (not null and key in keys):
                if data is None:
                    data = self.frame(of)
                yield (None if null else key), before, data[at : at + n]
            at += n
            before += n

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write (doc_id, text) rows as token-id files in ascending doc_id order; the manifest as a written table.

    Every document's ids end with id 0; null texts are that id alone. Nulls sort first, rows of
    one doc_id by a digest of their text. Sampled ranges of doc_ids become files, so that files
    too are in order; a retried task replaces its file by an equal one. The manifest has file,
    place (the range), documents and ids, one row for each file. An empty table has no files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"), "text", F.xxhash64("text").alias("h"))
    ranges = rows.repartitionByRange(partitions(spark), "k").sortWithinPartitions("k", "h", "text").select("k", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, place, writer = encoder(vocabulary), TaskContext.get().partitionId(), None
        for x in batches:
            for k, ids in zip(x["k"].tolist(), encode.encode(x["text"].tolist()), strict=True):
                writer = writer or Writer(f"{folder}/{place:08d}.ids.zst")
                writer.add(None if k == NULL_KEY else k, with_end(ids))
        if writer:
            writer.close()
            yield pd.DataFrame([(writer.uri, place, len(writer.index), sum(x[2] for x in writer.index))], columns=["file", "place", "documents", "ids"])

    return written(ranges.mapInPandas(write, "file string, place int, documents long, ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts ids over all files.

    Files are dealt over the tasks; a task holds one frame at a time.
    """
    spark = manifest.sparkSession
    # One row for each file: the window holds a few rows for each shuffle partition.
    starts = manifest.select("file", "ids", F.coalesce(F.sum("ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, first in zip(x["file"], x["first"].tolist(), strict=True):
                reader, out, held = Reader(file), [], 0
                for key, before, ids in reader.documents():
                    out.append((key, first + before, len(ids), ids))
                    held += len(ids)
                    if held > 1 << 20:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
                        out, held = [], 0
                reader.close()
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    return starts.repartition(n, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids array<long>")


def digest_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ids stay in the task that reads them."""
    spark = manifest.sparkSession
    starts = manifest.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, first in zip(x["file"], x["first"].tolist(), strict=True):
                reader = Reader(file)
                rows = [(key, first + before, len(ids), crc32(ids)) for key, before, ids in reader.documents()]
                reader.close()
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return starts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
