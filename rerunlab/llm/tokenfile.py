"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of whole documents, in order, as little-endian unsigned 32-bit
integers:

    data frames     zstandard frames of at most FRAME_IDS ids, each decodable alone
    index frame     a skippable frame: doc_id, null flag and first id of each document
    seek table      a skippable frame, last: for each data frame its compressed size,
                    its size and the low 32 bits of XXH64 over its bytes; then the
                    number of frames, a flag byte and a magic number (the public
                    seekable zstandard layout)

A reader takes the seek table from the end of the file, finds the frames that hold the
documents asked for, decompresses those alone and verifies their checksums.

Documents are dealt by ranges of doc_id, so files follow each other in ascending
order. Each task writes under a name of its own and renames, so a repeated task
leaves the same file. Files lie in the folder that the whole cluster shares.

Defined results: a null text counts as empty; every document ends with ``end_id``.
Null ids come first; rows with one id follow each other in the order of their texts.
An empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, shared_dir
from .vocab import BYTE_BPE, byte_encoder

FRAME_IDS = 1 << 16
PART_BYTES = 16 << 20
#: The public format's numbers: skippable frames and the end of a seek table.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_END, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class Writer:
    """Writes one file; memory holds one frame's ids and the document index."""

    def __init__(self, out, level: int = 3, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.none: list[bool] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.none.append(doc_id is None)
        self.starts.append(self.total)
        self.total += len(ids)
        if self.waiting and self.waiting + len(ids) > self.frame_ids:
            self._flush()
        for at in range(0, len(ids), self.frame_ids):
            part = ids[at : at + self.frame_ids]
            self.pending.append(part)
            self.waiting += len(part)
            if self.waiting >= self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        if self.waiting:
            raw = np.concatenate(self.pending).astype("<u4").tobytes()
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.waiting = [], 0

    def close(self) -> None:
        self._flush()
        body = struct.pack("<Q", len(self.docs)) + np.array(self.docs, "<i8").tobytes() + np.array(self.none, "u1").tobytes() + np.array([*self.starts, self.total], "<u8").tobytes()
        index = self.zip.compress(body)
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<QIBI", len(index), len(self.frames), HAS_CHECKSUM, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(table)) + table)


class Reader:
    """Reads one file by its seek table; keeps the last frame it decompressed."""

    FOOT = struct.calcsize("<QIBI")

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - self.FOOT)
        index_size, count, flag, magic = struct.unpack("<QIBI", source.read(self.FOOT))
        if magic != SEEK_END or not flag & HAS_CHECKSUM:
            raise ValueError("no seek table")
        table_at = size - self.FOOT - 12 * count - 8
        source.seek(table_at - index_size)
        body = zstandard.ZstdDecompressor().decompress(source.read(index_size))
        source.seek(table_at + 8)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3)
        self.packed, self.sizes, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.first = np.concatenate([[0], np.cumsum(self.sizes // 4)])
        n = struct.unpack("<Q", body[:8])[0]
        self.docs = np.frombuffer(body, "<i8", n, 8)
        self.none = np.frombuffer(body, "u1", n, 8 + 8 * n).astype(bool)
        self.starts = np.frombuffer(body, "<u8", n + 1, 8 + 9 * n).astype(np.int64)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.packed[k])))
            if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, np.frombuffer(raw, "<u4"))
        return self.held[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        start, end = int(self.starts[i]), int(self.starts[i + 1])
        parts, k = [], int(np.searchsorted(self.first, start, "right")) - 1
        while start < end:
            frame = self._frame(k)
            low = start - int(self.first[k])
            part = frame[low : low + end - start]
            parts.append(part)
            start, k = start + len(part), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def find(self, wanted: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of the documents asked for; absent ones are left out."""
        wanted = set(wanted)
        return {int(d): self.ids(i) for i, (d, none) in enumerate(zip(self.docs, self.none, strict=True)) if not none and int(d) in wanted}


def open_file(path: str) -> Reader:
    store, where = fs.FileSystem.from_uri(path)
    return Reader(store.open_input_file(where), store.get_file_info(where).size)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = BYTE_BPE, end_id: int = 0, text: str = "text", key: str = "doc_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the files; returns part, path, docs, ids for each, in ascending order of part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, writer = byte_encoder(vocabulary).ids, TaskContext.get().partitionId(), None
        end = np.array([end_id], np.uint32)
        store, where = fs.FileSystem.from_uri(f"{folder}/part-{part:07d}.ids.zst")
        partial = f"{where}.{uuid.uuid4().hex}.partial"
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(partial)
                    writer = Writer(out)
                writer.add(doc_id, np.concatenate([encode(t.as_py() or ""), end]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(partial, where)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:07d}.ids.zst"], "docs": [len(writer.docs)], "ids": [writer.total]})

    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(max(1, -(-size // part_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    return Table(dealt.mapInArrow(run, "part long, path string, docs long, ids long")).df


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = open_file(path)
                for low in range(0, len(f.docs), 10_000):
                    some = range(low, min(low + 10_000, len(f.docs)))
                    sums = [zlib.crc32(f.ids(i).tobytes()) for i in some]
                    starts = f.starts[low : some.stop + 1]
                    ids = pa.array(f.docs[low : some.stop], pa.int64(), mask=f.none[low : some.stop])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "path", (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before"))
    return files.repartition(max(1, min(2000, manifest.count())), "part").select("path", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, **how) -> DataFrame:
    """Write ``docs`` as token files and return what reading them back gives."""
    return read_tokens(write_tokens(docs, f"{shared_dir(docs.sparkSession)}/tokens", **how))
