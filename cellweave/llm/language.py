"""Language identification by compression with per-language zstandard raw-content dictionaries.

A dictionary holds raw text of one language, from a bounded hash-ordered sample of the labelled
training rows (``docs_per_language`` texts, ``dictionary_bytes`` bytes; the driver holds no more than
that for each language). A text is cut into chunks,
so that it never learns from itself, and each chunk is compressed with every dictionary; the
language with the smallest total wins (at a tie, the one with more training rows). ``score`` is the share of bytes saved against the second
language; a document is ``rejected`` when that margin is under ``min_margin`` or it has no letters.

Null texts and texts without a letter get ``und``, score 0, rejected. Rows with a null ``doc_id``
are predicted like others but never learned from (their fold is unknown: ``held_out`` is false).
Repeated rows give repeated results, an empty table gives none; extra columns are ignored. Without
any labelled row every text gets ``und``; with one language, that language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDECIDED = "und"
DOCS_PER_LANGUAGE = 96
DICTIONARY_BYTES = 112 << 10
CHUNK = 2048
#: Short matches matter more than speed: words are short, and a chunk must show its language within 2 KB.
PARAMETERS = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 3, "min_match": 4, "target_length": 0, "strategy": zstandard.STRATEGY_LAZY}
MIN_MARGIN = 0.005
FOLDS, HELD_OUT_FOLD = 4, 2

_letter = re.compile(b"[a-z]")
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def normal(text: str) -> bytes:
    """Lower case, with runs of ASCII characters other than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split())


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from rows that are labelled and not held out.

    Ids are picked first, from two narrow columns; only the picked rows' texts are read.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r[0] for r in rows.select("lang", "doc_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_language).select("doc_id").collect()]
    if not ids:
        return {}
    texts: dict[str, list[tuple]] = {}
    # An id with several rows of a language gives one text, so what is collected keeps its bound.
    picked = rows.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, dictionary_bytes)).alias("text"))
    for r in picked.collect():
        texts.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    # Each text gives an even share, so that one long text cannot fill a dictionary.
    out = {}
    for lang, found in texts.items():
        found = [normal(t) for _, t in sorted(found)]
        share = max(512, 2 * dictionary_bytes // max(1, len(found)))
        # The library takes no dictionary under 8 bytes.
        out[lang] = b" ".join(t[:share] for t in found)[:dictionary_bytes].ljust(8)
    rank = {r[0]: (-r[1], r[0]) for r in rows.groupBy("lang").count().collect()}
    return {lang: out[lang] for lang in sorted(out, key=rank.__getitem__)}


class Classifier:
    """Compressors of every language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names, self.compressors = list(dictionaries), []
        parameters = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **PARAMETERS)
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))

    def predict(self, text: str | None) -> tuple[str, float]:
        data = normal(text) if text else b""
        if not data or not self.names or not (_letter.search(data) or any(map(str.isalpha, text))):
            return UNDECIDED, 0.0
        chunks = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        # A stable sort: at equal sizes the language with more training rows comes first.
        sizes = sorted((sum(len(c.compress(x)) for x in chunks), k) for k, c in enumerate(self.compressors))
        return self.names[sizes[0][1]], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


_made: dict = {}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sent.value
        if _made.get("data") != data:
            _made.update(data=data, classifier=Classifier(data))
        classify = _made["classifier"].predict
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column("text")]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            rejected = [n == UNDECIDED or s < min_margin for n, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_decided(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sent.value
        if _made.get("data") != data:
            _made.update(data=data, classifier=Classifier(data))
        classify = _made["classifier"].predict
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([n != UNDECIDED and s >= min_margin for n, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
