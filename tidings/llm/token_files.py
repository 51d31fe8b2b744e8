"""Token ids in Parquet list columns, laid out for selective reads.

The files hold one row per document in ascending id order: ``doc_id``, ``shard`` (the file's place in
that order), ``start_in_shard``, ``n_tokens`` and the list ``tokens``. Token ids are dictionary
encoded; the sorted integer columns are delta encoded (Parquet's second data page version). Row groups
and pages are small, and every page has index entries, so that a range of documents, or the metadata
alone, is read without the other tokens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidings.llm.common import broadcast_file, given_back, per_worker, short_batches
from tidings.llm.wordpiece import Cutter, Remembered, words_and_stops

#: Chunks and pre-tokens whose ids a task remembers, in each of two generations.
REMEMBERED = 300_000
#: Bytes of text that a task encodes at a time; besides a longer text at most as much.
ENCODED_BYTES = 16 << 20
#: Pre-tokens that the library merges in one call.
MERGED_PIECES = 1000
#: Up to so many files their offsets are broadcast, which saves a shuffle of the tokens.
FEW_FILES = 100_000
FILE_SCHEMA = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, tokens array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.columnindex.truncate.length": "64",
}


def lists_of(sizes: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """Lists of these sizes, one behind the other in ``ids``."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids, pa.int32()))


class ChunkIds:
    """Ids of white-space separated chunks, as lists or as packed little-endian 32-bit numbers.

    Texts that come together are cut in Arrow, and each of their different words is merged once. Chunks
    that are more than a word and its stops are cut one by one; of those, ids are remembered.
    """

    def __init__(self, cutter: Cutter, remembered: int = REMEMBERED) -> None:
        self.cutter, self.tokenizer = cutter, cutter.tokenizer
        self.pieces = Remembered(self._piece, remembered)
        self.chunks = Remembered(self._chunk, remembered)

    def clear(self) -> None:
        for memory in (self.chunks, self.pieces):
            memory.old.clear()
            memory.clear()

    def packed(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def lists(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Ids of each text, with the end id."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = words.flatten().dictionary_encode()
        chunks = self._chunk_lists(flat.dictionary)
        known = pa.concat_arrays([chunks, lists_of(np.ones(1, np.int64), np.array([end_id], np.int32))])
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        # The end id stands behind each text as one more chunk.
        codes = np.insert(flat.indices.to_numpy(zero_copy_only=False), offsets[1:], len(chunks))
        ids = known.take(pa.array(codes))
        ends = ids.offsets.to_numpy()[offsets + np.arange(len(offsets))]
        return pa.ListArray.from_arrays(pa.array(ends), ids.values)

    def _chunk_lists(self, chunks: pa.Array) -> pa.ListArray:
        """Ids of each of some different chunks."""
        words, stops, plain = words_and_stops(chunks)
        both = pa.concat_arrays([words.filter(plain), stops.filter(plain)]).dictionary_encode()
        other = [self.chunks[c] for c in chunks.filter(pc.invert(plain)).cast(pa.binary()).to_pylist()]
        pieces = self._merged(both.dictionary.to_pylist())
        others = lists_of(np.array([len(c) // 4 for c in other], np.int64), np.frombuffer(b"".join(other), "<i4"))
        nothing = lists_of(np.zeros(1, np.int64), np.zeros(0, np.int32))
        known = pa.concat_arrays([pieces, others, nothing])
        # A word and its stops, or another chunk and nothing.
        pair = np.full((len(chunks), 2), len(known) - 1)
        is_plain = plain.to_numpy(zero_copy_only=False)
        pair[is_plain] = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
        pair[~is_plain, 0] = len(pieces) + np.arange(len(other))
        ids = known.take(pa.array(pair.ravel()))
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[::2]), ids.values)

    def _merged(self, pieces: list[str]) -> pa.ListArray:
        """Ids of each of some different pre-tokens, a block at a time."""
        spelled = list(map(self.cutter.spelled, pieces))
        blocks = [self.cutter.merged(spelled[i : i + MERGED_PIECES]) for i in range(0, len(spelled), MERGED_PIECES)]
        sizes, ids = zip((np.zeros(0, np.int64), np.zeros(0, np.int32)), *blocks, strict=True)
        return lists_of(np.concatenate(sizes), np.concatenate(ids))

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        cut = self.cutter.pieces(text)
        if cut is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return self.pieces[cut[0]] if len(cut) == 1 else b"".join(map(self.pieces.__getitem__, cut))

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)


def _by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, text) dealt anew into batches of about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = block = 0
    for batch in batches:
        sizes = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        for cut in np.flatnonzero(np.diff(sizes // most, prepend=block)).tolist():
            held.append(batch.slice(start, cut - start))
            yield pa.concat_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        if len(sizes):
            size = int(sizes[-1])
            block = size // most
    if held:
        yield pa.concat_batches(held)


def _encoder(key: str, file: Broadcast, end_id: int, remembered: int, together: int):
    """Encodes sorted rows (doc_id, text) and numbers their tokens within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds(per_worker(f"cutter-{key}", lambda: Cutter(file.value)), remembered)
        shard, start = TaskContext.get().partitionId(), 0
        for rows in _by_bytes(given_back(batches, known), together):
            if not rows.num_rows:
                continue
            lists = known.lists(rows.column(1), end_id)
            ends = lists.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.full(len(lists), shard, np.int32)),
                    pa.array(start + ends[:-1]),
                    pa.array(np.diff(ends)),
                    lists,
                ],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "tokens"],
            )
            start += int(ends[-1])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    layout: dict[str, str] | None = None,
    remembered: int = REMEMBERED,
    together: int | None = None,
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them by ascending id.

    ``vocabulary``: a word-end byte-level BPE ``.json`` file of the tokenizers library, on the driver.
    Texts are range-partitioned by id once, so every file holds a range of ids, larger than the ranges
    before it. A null text counts as empty (only the end id); null ids come first; repeated ids are
    kept, ordered by their texts' hash; other columns are not read; an empty table gives empty files.
    A task remembers the ids of at most four times ``remembered`` short strings, of chunks that are more
    than a word and its stops, and encodes ``together`` bytes of text at a time (``ENCODED_BYTES`` if not
    given): fewer take less memory and more time, and give the same files.
    """
    key, file = broadcast_file(docs.sparkSession, vocabulary)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(_encoder(key, file, end_id, remembered, together or ENCODED_BYTES), FILE_SCHEMA)
    # Texts of 8 KB on average come in batches of that many bytes.
    with short_batches(docs.sparkSession, min(1000, max(1, (together or ENCODED_BYTES) >> 13))):
        encoded.write.options(**{**LAYOUT, **(layout or {})}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files with ``start``: the ids of all documents before. Filters on ``doc_id``
    and column choice reach the scan."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("tokens_in_shard"))
    # One row per file: the running total over files is a small table.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("tokens_in_shard").over(before), F.lit(0)).alias("offset"))
    # Files are listed on the driver anyway; so many rows of two numbers are known to be small.
    if len(files.inputFiles()) <= FEW_FILES:
        offsets = F.broadcast(offsets)
    return files.join(offsets, "shard").select(
        "doc_id", (F.col("offset") + F.col("start_in_shard")).alias("start"), "n_tokens", "tokens"
    )


@F.arrow_udf(LongType())
def ids_crc32(tokens: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of each list as little-endian unsigned 32-bit integers."""
    flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    ends = np.cumsum([0, *(n or 0 for n in tokens.value_lengths().to_pylist())])
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
