"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``size`` tokens. Only the histogram of piece
lengths (at most ``size`` rows, whatever the corpus) reaches the driver, which places lengths from
the longest to the shortest and keeps counts of packing patterns, not packs. The patterns become
intervals of ranks among the pieces of a length, and each piece finds its interval by its rank.

Null or empty texts are documents of the end id alone; null ``doc_id`` rows are packed like others;
repeated rows are packed as often as they occur; an empty table gives no rows; extra columns are
ignored. Whole texts are tokenised, however long: a document has as many pieces as it needs.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.tokens import encoder, vocabulary
from cellweave.storage import materialise

SIZE = 2048
END_ID = 1
#: Ranks of pieces of one length stay below this.
RANKS = 1 << 48


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(count, [(length, copies), ...])]``: patterns that pack all ``histogram`` pieces.

    Lengths go from the longest to the shortest; each fills the packs with most room first, and
    new packs take as many copies as fit. A length adds at most a few patterns, so the number of
    patterns depends on ``size`` alone.
    """
    room: list[tuple[int, int, int, tuple]] = []  # (-room, serial, count, pattern)
    done: list[tuple[int, list]] = []
    serial = 0

    def put(left: int, count: int, pattern: tuple) -> None:
        nonlocal serial
        if not count:
            return
        if left:
            serial += 1
            heapq.heappush(room, (-left, serial, count, pattern))
        else:
            done.append((count, list(pattern)))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n and room and -room[0][0] >= length:
            left, _, count, pattern = heapq.heappop(room)
            # Copies of one length go into a pattern together when there are enough of them.
            copies = min(-left // length, max(1, n // count))
            used = min(count, n // copies)
            put(-left, count - used, pattern)
            put(-left - copies * length, used, (*pattern, (length, copies)))
            n -= used * copies
        if n:
            copies = size // length
            whole, rest = divmod(n, copies)
            put(size - copies * length, whole, ((length, copies),))
            if rest:
                put(size - rest * length, 1, ((length, rest),))
    return done + [(count, list(pattern)) for _, _, count, pattern in room]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset, count), by length and first rank.

    Of the pieces of a length, those with ranks from ``first`` to ``first + copies * count - 1``
    belong to the pattern: rank ``first + q`` is copy ``q // count`` in sequence ``q % count``.
    """
    rows, ranks, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, copies, sequence, offset, count))
            ranks[length] = first + copies * count
            offset += length * copies
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its partition."""
    vocab = vocabulary(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"))])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), {}, encoder(vocab).encode
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py()) + end
                total = len(raw) // 4
                for start in range(0, total, size):
                    piece = raw[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    out.append((doc_id, start, length, zlib.crc32(piece), total, part, rank))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local_rank long")


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pack ``docs(doc_id, text)``: the pieces with ``sequence_id`` and ``offset``, gapless in each sequence."""
    spark = docs.sparkSession
    rows = materialise(pieces(docs, size, end_id, path), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition and length: the ranks that a partition's pieces of a length begin at.
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = counts.withColumn("first", F.sum("n").over(order) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(pack_histogram(histogram, size)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] * RANKS + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = t[np.searchsorted(keys, length * RANKS + rank, side="right") - 1]
            q = rank - at[:, 1]
            added = [pa.array(at[:, 3] + q % at[:, 5]), pa.array(at[:, 4] + length * (q // at[:, 5]))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in columns] + added, names=[*columns, "sequence_id", "offset"])

    ranked = rows.join(first, ["part", "length"]).select(*columns, (F.col("first") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))
