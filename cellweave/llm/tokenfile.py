"""Token files: independent zstandard frames with per-frame checksums, a document index and a trailing seek table.

Layout of a file, in the public seekable zstandard format: data frames of at most ``FRAME_IDS``
little-endian unsigned 32-bit ids of one document each; a skippable frame with the index (for each
document its id, whether it has one, and its number of frames); a skippable frame with the seek
table (for each data frame its compressed size, its size and the low 32 bits of the xxh64 of its
content; then the number of frames, a descriptor byte and the magic number). Any zstandard reader
gets all ids; :func:`read_file` decompresses only the frames of the documents asked for.

Files are written by tasks under names of their own, so a repeated task spoils nothing: only files
in the manifest count. Null or empty texts are documents of the end id alone, rows with a null
``doc_id`` come first, repeated rows are kept in order of their text, an empty table gives no file.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.tokens import encoder, vocabulary
from cellweave.storage import materialise, shared_path

END_ID = 2
FRAME_IDS = 1 << 20
LEVEL = 1
#: A reader fetches neighbouring frames together up to so many bytes.
SPAN = 8 << 20
#: Fixed values of the public formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

ENTRY, INDEX_ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<qBI"), struct.Struct("<IBI")


class TokenFileWriter:
    """Writes documents, in order, to an open binary sink."""

    def __init__(self, sink, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        self.sink, self.frame_bytes = sink, 4 * frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames, self.docs, self.ids = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = 0
        for at in range(0, len(ids), self.frame_bytes):
            part = ids[at : at + self.frame_bytes]
            packed = self.compressor.compress(part)
            self.sink.write(packed)
            self.frames.append(ENTRY.pack(len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
            n += 1
        self.docs.append(INDEX_ENTRY.pack(doc_id or 0, doc_id is not None, n))
        self.ids += len(ids) // 4

    def finish(self) -> None:
        index = b"".join(self.docs)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(self.frames) + FOOTER.pack(len(self.frames), HAS_CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


def _tables(source, size: int) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    frames, flags, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
    if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
        raise ValueError("no seek table")
    begin = size - FOOTER.size - ENTRY.size * frames
    table = np.frombuffer(source.read_at(ENTRY.size * frames, begin), dtype="<u4").reshape(-1, 3).astype(np.int64)
    data = int(table[:, 0].sum())
    kind, length = struct.unpack("<II", source.read_at(8, data))
    if kind != SKIPPABLE_INDEX or data + 8 + length + 8 != begin:
        raise ValueError("no document index")
    return table, [(d if has else None, n) for d, has, n in INDEX_ENTRY.iter_unpack(source.read_at(length, data + 8))]


def read_file(path: str, doc_ids: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, first id's position in the file, ids) of all documents or of those asked for, each frame's checksum checked."""
    system, name = fs.FileSystem.from_uri(path)
    size = system.get_file_info(name).size
    with system.open_input_file(name) as source:
        table, docs = _tables(source, size)
        begins = np.concatenate([[0], np.cumsum(table[:, 0])]).tolist()
        held, held_at, open_, frame, position = b"", 0, zstandard.ZstdDecompressor(), 0, 0
        for doc_id, n in docs:
            parts, at = [], position
            for k in range(frame, frame + n):
                packed, length, check = table[k].tolist()
                position += length // 4
                if doc_ids is not None and doc_id not in doc_ids:
                    continue
                if not held_at <= begins[k] or begins[k] + packed > held_at + len(held):
                    last = k + 1
                    while doc_ids is None and last < len(table) and begins[last + 1] - begins[k] <= SPAN:
                        last += 1
                    held, held_at = source.read_at(begins[last] - begins[k], begins[k]), begins[k]
                part = open_.decompress(held[begins[k] - held_at : begins[k] - held_at + packed], max_output_size=length)
                if len(part) != length or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                    raise ValueError(f"{path}: frame {k} is damaged")
                parts.append(part)
            frame += n
            if doc_ids is None or doc_id in doc_ids:
                yield doc_id, at, b"".join(parts)


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, level: int = LEVEL, path: str | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending ``doc_id`` order, one file a range; returns the manifest (part, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    vocab = vocabulary(spark, path)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode_all = TaskContext.get().partitionId(), encoder(vocab).encode_all
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), encode_all(b.column(1)), strict=True))
        first = next(rows, None)
        if first is None:
            return
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        with system.open_output_stream(f"{top}/{name}", compression=None) as sink:
            writer = TokenFileWriter(sink, level)
            for doc_id, ids in itertools.chain([first], rows):
                writer.add(doc_id, b"".join((ids, end)))
            writer.finish()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``manifest``, a task for each few files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each file
    files = manifest.select("part", "path", (F.sum("n_ids").over(before) - F.col("n_ids")).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = read_file(path)
                while rows := [(d, base + at, len(ids) // 4, zlib.crc32(ids)) for d, at, ids in itertools.islice(found, 4096)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
