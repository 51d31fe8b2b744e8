"""Sparse text vectors over the exact vocabulary, and their cosine join.

A document's vector has one weight per word it holds: tf * (ln((1 + n) / (1 + df)) + 1), scaled to length
one. No two words share a dimension, as they may in a hashed vector.

The join orders all words alike, the rarest first. At a word that two vectors share, the product of what each
has left from there on bounds all that they share from there on. So all words at which the product is above a
value slightly below the threshold add up to at least the difference, if the vectors are similar. Vectors are
stored once, in blocks of bounded size. Every unordered pair of blocks is a task that reads the two blocks, adds up
the words its documents share early, and compares those that may be similar in full; nothing but at most ``k``
neighbours per document and task is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions.text import TOKEN_PATTERN, mixed, term_counts, with_words
from tidings.operators import similarity
from tidings.operators.kernels import best_of_pairs
from tidings.sources.layout import TEXT_BYTES, ids_repeat, materialize, text_partitions

#: Documents and words of documents of a block at most, documents that are packed together, and text of a block.
TILE_ROWS, TILE_WORDS, PIECE_ROWS, TILE_BYTES = 16_384, 2_000_000, 256, 12 << 20
#: Words of documents that are numbered together.
CHUNK_WORDS = 1 << 19
#: Steps in which early weights, and what is left, are stored.
STEPS = 65_535
#: Pairs of documents whose shared words are added up at a time.
CELLS = 250_000
#: How far below the threshold shared words are still added up.
MARGIN = 0.02
_ROOM = 1e-5
#: Cosines are compared and ranked at so many decimals, so that rounding does not tell copies apart.
DECIMALS = 9

_EDGES = "id BIGINT, other BIGINT, similarity DOUBLE"
_CHUNK = "chunk BIGINT, docs ARRAY<{0}>, held BIGINT, size BIGINT, words BINARY, own BINARY, counts BINARY, codes BINARY, tfs BINARY"
_BLOCK = (
    "block BIGINT, ids ARRAY<BIGINT>, h1 ARRAY<BIGINT>, h2 ARRAY<BIGINT>, size BIGINT, words BINARY, early BIGINT, code BINARY, "
    "doc BINARY, left BINARY, weight BINARY, counts BINARY, ranks ARRAY<BINARY>, weights ARRAY<BINARY>"
)


def _pack(values: np.ndarray) -> bytes:
    """An array, byte by byte, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes | pa.Buffer, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def word_weights(docs: DataFrame, doc: str = "doc_id", text: str = "text", nested: bool = False) -> DataFrame:
    """Unit-length weights in long form: ``doc, word, df, weight``; documents without words have no rows.

    Words are counted where their text lies, and travel twice: to the others of the same word, and back to
    those of their document. Rows of one id count as one document.

    ``nested`` gives ``doc, words, weights`` instead, a row per document, with its words as 64-bit hashes, the
    rarest first. A document's words then stay together: only the different words of a chunk of documents travel,
    and those found in other chunks too come back with their frequency.
    """
    parts = text_partitions(docs, text)
    repeated = ids_repeat(docs, doc)
    if nested:
        listed = _by_document(word_weights(docs, doc, text), doc) if repeated else _nested_weights(docs, doc, text, parts)
        return listed.coalesce(max(1, math.ceil(parts * TEXT_BYTES / TILE_BYTES)))
    counts = term_counts(with_words(docs.select(doc, text), text), "words", doc).withColumnRenamed("term", "word").drop("share")
    if repeated:
        counts = counts.groupBy(doc, "word").agg(F.sum("tf").alias("tf"))
    total = docs.sparkSession.range(1).select(F.lit(_documents_with_words(docs, doc, text)).alias("n"))
    spread = counts.repartition(parts, "word")
    # Both counts, so that this side needs the same columns and reads the same shuffle as the other.
    seen = spread.groupBy("word").agg(F.greatest(F.count("tf"), F.count(doc)).alias("df"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = spread.join(seen.hint("shuffle_hash"), "word").crossJoin(F.broadcast(total))
    weighted = weighted.withColumn("weight", F.col("tf") * idf).select(doc, "word", "df", "weight").repartition(parts, doc)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(doc)))
    return weighted.select(doc, "word", "df", (F.col("weight") / length).alias("weight"))


def _documents_with_words(docs: DataFrame, doc: str, text: str) -> int:
    """How many different ids (null is none) have a text with a word."""
    start = F.lower(F.substring(text, 1, 200))
    worded = start.rlike(TOKEN_PATTERN) | F.lower(F.col(text)).rlike(TOKEN_PATTERN)
    return docs.filter(worded).select(F.count_distinct(doc)).head()[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, hashes of words) in chunks, their different words numbered by their hash."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        batch, sizes = batch.filter(pa.array(sizes > 0)), sizes[sizes > 0]
        ends = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_WORDS, side="right")))
            ids, row = batch.column(0).slice(low, high - low), np.repeat(np.arange(high - low), sizes[low:high])
            words, code = np.unique(batch.column(1).slice(low, high - low).flatten().to_numpy(), return_inverse=True)
            met, tf = np.unique(row * len(words) + code, return_counts=True)
            row, code = met // len(words), met % len(words)
            counts = np.bincount(row, minlength=high - low)
            steps = np.diff(code, prepend=0)
            steps[_starts(counts)[:-1]] = code[_starts(counts)[:-1]]
            packed = [words, np.bincount(code).astype(np.int32), counts.astype(np.int32), steps.astype(np.int32), tf.astype(np.int32)]
            columns = [
                pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([len(ids) - ids.null_count], pa.int64()), pa.array([len(words)], pa.int64()),
                *(pa.array([_pack(x)], pa.binary()) for x in packed),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "docs", "held", "size", "words", "own", "counts", "codes", "tfs"])
            chunk, low = chunk + 1, high
        pa.default_memory_pool().release_unused()


def _words_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each chunk: ``word, chunk, place, own``, with the number of its documents in the chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            size = row["size"]
            columns = [_unpack(row["words"], np.int64, size), np.full(size, row["chunk"]), np.arange(size, dtype=np.int32)]
            columns = [pa.array(x) for x in (*columns, _unpack(row["own"], np.int32, size))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "chunk", "place", "own"])


def _weighted(doc: str, total: int):
    """A chunk's documents with their weights, the words by rarity, then by hash."""

    def run(chunks: pa.Table, frequent: pa.Table) -> pa.Table:
        kind = chunks.schema.field("docs").type.value_type
        found = [pa.table([pa.array([], kind), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], [doc, "words", "weights"])]
        for row, ids in zip(chunks.drop_columns(["docs"]).to_pylist(), chunks.column("docs").combine_chunks(), strict=True):
            words, df = _unpack(row["words"], np.int64, row["size"]), _unpack(row["own"], np.int32, row["size"])
            df[frequent.column("place").to_numpy()] = frequent.column("df").to_numpy()
            counts = _unpack(row["counts"], np.int32, len(ids))
            starts = _starts(counts)
            steps = _unpack(row["codes"], np.int32, starts[-1]).astype(np.int64)
            code = np.cumsum(steps)
            code -= np.repeat(code[starts[:-1]] - steps[starts[:-1]], counts)
            weight = _unpack(row["tfs"], np.int32, starts[-1]) * (np.log((1 + total) / (1 + df)) + 1)[code]
            weight /= np.repeat(np.sqrt(np.add.reduceat(weight**2, starts[:-1])), counts)
            place = np.empty(len(words), np.int64)
            place[np.lexsort((words, df))] = np.arange(len(words))
            order = np.argsort(np.repeat(np.arange(len(ids)), counts) * len(words) + place[code])
            offsets = pa.array(starts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (words[code[order]], weight[order])]
            found.append(pa.table([ids.values, *lists], [doc, "words", "weights"]))
        return pa.concat_tables(found)

    return run


def _nested_weights(docs: DataFrame, doc: str, text: str, parts: int) -> DataFrame:
    """``word_weights`` in nested form, of documents whose ids are all different."""
    kind = docs.schema[doc].dataType.simpleString()
    hashed = with_words(docs.select(doc, text), text).select(doc, F.transform("words", lambda w: F.xxhash64(w)))
    chunks = materialize(hashed.mapInArrow(_chunks, _CHUNK.format(kind)))
    total = chunks.agg(F.sum("held")).head()[0] or 0
    listed = chunks.select("chunk", "size", "words", "own").mapInArrow(_words_of_chunks, "word BIGINT, chunk BIGINT, place INT, own INT")
    seen = F.sum("own").over(W.partitionBy("word"))
    frequent = listed.repartition(parts, "word").withColumn("df", seen).filter("df > own").select("chunk", "place", F.col("df").cast("int"))
    schema = f"`{doc}` {kind}, words ARRAY<BIGINT>, weights ARRAY<DOUBLE>"
    return chunks.groupBy("chunk").cogroup(frequent.groupBy("chunk")).applyInArrow(_weighted(doc, total), schema)


def _by_document(weights: DataFrame, doc: str) -> DataFrame:
    """Long weights in nested form."""
    word = F.struct("df", F.xxhash64("word").alias("h"), "weight")
    listed = weights.groupBy(doc).agg(F.array_sort(F.collect_list(word)).alias("v"))
    return listed.select(doc, F.col("v.h").alias("words"), F.col("v.weight").alias("weights"))


def sparse_vectors(weights: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``id, ranks, weights``: a document's words by rarity, then by their hash; a word is known by its hash.

    One list per document, as long as it has words. Weights may be long or nested.
    """
    listed = weights if "words" in weights.columns else _by_document(weights, doc)
    return listed.select(F.col(doc).alias("id"), F.col("words").alias("ranks"), "weights")


def prefix_lengths(weights: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """Words of each vector until what is left is shorter than the threshold."""
    squares = np.concatenate([[0.0], np.cumsum(weights**2)])
    ends = starts[1:]
    before = squares[:-1] - np.repeat(squares[starts[:-1]], np.diff(starts))
    left = np.repeat(squares[ends] - squares[starts[:-1]], np.diff(starts)) - before
    counted = np.concatenate([[0], np.cumsum(left >= threshold**2 * (1 - 1e-9))])
    return counted[ends] - counted[starts[:-1]]


def _block(number: int, ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, weights: np.ndarray, least: float) -> dict:
    """A block's vectors: words numbered by hash, what stands early (by word, what is left falling), and all of them."""
    starts, doc = _starts(sizes), np.repeat(np.arange(len(sizes)), sizes)
    known, code = np.unique(words, return_inverse=True)
    rounded = np.round(weights, 12).view(np.uint64)
    hashes = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        each = mixed(words.view(np.uint64) ^ mixed(rounded + np.uint64(salt)))
        hashes.append(np.add.reduceat(each, starts[:-1]).view(np.int64))
    lengths = prefix_lengths(weights, starts, least)
    early = np.arange(len(words)) - starts[doc] < lengths[doc]
    squares = np.concatenate([[0.0], np.cumsum(weights**2)])
    left = np.sqrt(np.maximum(squares[starts[doc + 1]] - squares[:-1], 0.0))[early]
    # Both in steps, rounded up, so that bounds stay bounds.
    left = np.ceil(np.clip((left - least) / (1.0 - least), 0.0, 1.0) * STEPS).astype(np.uint16)
    early_code, early_doc, early_weight = code[early], doc[early], np.ceil(np.minimum(weights[early], 1.0) * STEPS).astype(np.uint16)
    order = np.lexsort((STEPS - left.astype(np.int32), early_code))
    pieces = [slice(starts[a], starts[min(a + PIECE_ROWS, len(sizes))]) for a in range(0, len(sizes), PIECE_ROWS)]
    return {
        "block": number, "ids": ids, "h1": hashes[0], "h2": hashes[1], "size": len(known), "words": _pack(known),
        "early": len(order), "code": _pack(early_code[order].astype(np.int32)), "doc": _pack(early_doc[order].astype(np.uint16)),
        "left": _pack(left[order]), "weight": _pack(early_weight[order]), "counts": _pack(sizes.astype(np.int32)),
        "ranks": [_pack(code[x].astype(np.int32)) for x in pieces], "weights": [_pack(weights[x]) for x in pieces],
    }


def _blocks(tile_rows: int, least: float):
    """The vectors of each partition in blocks, a row each."""
    most = min(tile_rows, 1 << 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *((x, pa.list_(pa.int64()) if x in ("ids", "h1", "h2") else pa.int64()) for x in ("block", "ids", "h1", "h2", "size")),
            ("words", pa.binary()), ("early", pa.int64()), *((x, pa.binary()) for x in ("code", "doc", "left", "weight", "counts")),
            ("ranks", pa.list_(pa.binary())), ("weights", pa.list_(pa.binary())),
        ])
        number, held, words = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            ids, sizes, ranks, weights = (np.concatenate(side) for side in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist([_block(number, ids, sizes, ranks, weights, least)], schema)

        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                rows, before = sum(len(x[0]) for x in held), ends[low - 1] if low else 0
                fit = min(int(np.searchsorted(ends, before + TILE_WORDS - words, side="right")), low + most - rows)
                if fit <= low and held:
                    yield packed()
                    number, held, words = number + 1, [], 0
                    continue
                high = max(fit, low + 1)
                ids, ranks, weights = (batch.column(i).slice(low, high - low) for i in range(3))
                sizes = ranks.value_lengths().to_numpy(zero_copy_only=False)
                held.append((ids.to_numpy(), sizes, *(x.flatten().to_numpy() for x in (ranks, weights))))
                words, low = words + int(sizes.sum()), high
        if held:
            yield packed()

    return run


class _Stored:
    """A block in a row of pairs of blocks, read where it lies."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        self.batch, self.at, self.side = batch, row, side

    def __getitem__(self, name: str) -> int | pa.Buffer | pa.Array | None:
        value = self.batch.column(self.batch.schema.get_field_index(f"{self.side}_{name}"))[self.at]
        if not value.is_valid:
            return None
        kind = value.type
        return value.values if pa.types.is_list(kind) else value.as_buffer() if pa.types.is_binary(kind) else value.as_py()


def _early(block: _Stored, lower: float) -> tuple[np.ndarray, ...]:
    """What stands early in a block's vectors: word, document, what is left, weight; not of copies of other vectors."""
    kinds = {"code": np.int32, "doc": np.uint16, "left": np.uint16, "weight": np.uint16}
    columns = [_unpack(block[x], kind, block["early"]) for x, kind in kinds.items()]
    if block["dropped"] is not None:
        dropped = np.unpackbits(np.frombuffer(block["dropped"], np.uint8), bitorder="little").astype(bool)
        kept = ~dropped[columns[1]]
        columns = [x[kept] for x in columns]
    code, doc, left, weight = columns
    return code, doc, lower + left * ((1.0 - lower) / STEPS), weight / STEPS


def _possible(one: _Stored, two: _Stored, here: np.ndarray, lower: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents of two blocks whose early shared words add up to more than ``least``.

    ``here`` has the number in the second block of the first one's words, or -1. A word's documents in the second
    block come by what they have left, so those that are too far on are not looked at.
    """
    code, doc, left, weight = _early(one, lower)
    codes, docs, lefts, weights = _early(two, lower)
    code = here[code]
    shared = np.flatnonzero(code >= 0)
    start = np.searchsorted(codes, np.arange(two["size"]))[code[shared]]
    n = np.searchsorted(codes * 2.0 + (1.0 - lefts), code[shared] * 2.0 + (1.0 - (lower - _ROOM) / left[shared])) - start
    shared, start, n = shared[n > 0], start[n > 0], n[n > 0]
    order = np.argsort(doc[shared], kind="stable")
    doc, weight, start, n = doc[shared][order].astype(np.int64), weight[shared][order], start[order], n[order]
    width, docs = int(docs.max(initial=0)) + 1, docs.astype(np.int64)
    step = max(1, CELLS // width)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for first in range(0, int(doc.max(initial=-1)) + 1, step):
        low, high = np.searchsorted(doc, (first, first + step))
        if low < high:
            m = n[low:high]
            at = np.arange(m.sum()) + np.repeat(start[low:high] - (np.cumsum(m) - m), m)
            cell = np.repeat((doc[low:high] - first) * width, m) + docs[at]
            sums = np.bincount(cell, np.repeat(weight[low:high], m) * weights[at])
            met = np.flatnonzero(sums > least)
            found.append((met // width + first, met % width))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


class _Full:
    """A block's whole vectors, unpacked a piece at a time as they are asked for; ``most`` pieces are kept."""

    def __init__(self, block: _Stored, most: int):
        self.block, self.starts, self.most = block, _starts(_unpack(block["counts"], np.int32, len(block["ids"]))), most
        self.packed, self.pieces = {x: block[x] for x in ("ranks", "weights")}, {}

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        piece = i // PIECE_ROWS
        first = self.starts[piece * PIECE_ROWS]
        if piece not in self.pieces:
            size = self.starts[min((piece + 1) * PIECE_ROWS, len(self.starts) - 1)] - first
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            kinds = (("ranks", np.int32), ("weights", np.float64))
            self.pieces[piece] = [_unpack(self.packed[name][piece].as_buffer(), kind, size) for name, kind in kinds]
        part = slice(self.starts[i] - first, self.starts[i + 1] - first)
        return tuple(x[part] for x in self.pieces[piece])


def _cosines(one: _Stored, two: _Stored, here: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of documents of two blocks, by the first one's document."""
    firsts, seconds, scores = _Full(one, 1), _Full(two, 64), np.zeros(len(a))
    spread = np.zeros(two["size"] + 1)  # the last place takes words that the second block doesn't have
    heads = np.flatnonzero(np.diff(a, prepend=-1))
    for low, high in zip(heads, [*heads, len(a)][1:], strict=True):
        words, weights = firsts.row(a[low])
        spread[here[words]] = weights
        spread[-1] = 0.0
        for i in range(low, high):
            words_b, weights_b = seconds.row(b[i])
            scores[i] = spread[words_b] @ weights_b
        spread[here[words]] = 0.0
    return np.round(scores, DECIMALS)


def _meet(k: int, threshold: float, lower: float):
    """The ``k`` best neighbours that documents of two blocks have among each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (_Stored(batch, i, side) for side in ("a", "b"))
                words, others = (_unpack(x["words"], np.int64, x["size"]) for x in (one, two))
                at = np.minimum(np.searchsorted(others, words), len(others) - 1)
                here = np.where(others[at] == words, at, -1)
                a, b = _possible(one, two, here, lower, threshold - lower - _ROOM)
                if one["block"] == two["block"]:
                    a, b = a[a < b], b[a < b]
                scores = _cosines(one, two, here, a, b)
                kept = scores > threshold
                a, b, scores = one["ids"].to_numpy()[a[kept]], two["ids"].to_numpy()[b[kept]], scores[kept]
                found = []
                for own, other in ((a, b), (b, a)):
                    best = best_of_pairs(own, scores, other, k)
                    found.append((own[best], other[best], scores[best]))
                columns = [pa.array(np.concatenate(side)) for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "other", "similarity"])
            pa.default_memory_pool().release_unused()

    return run


def _copies(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal vectors (``rep, own``), known by a 128-bit hash, and their other members (``rep, id, block, row``)."""
    groups = keys.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    others = keys.join(groups, ["h1", "h2"]).filter("id <> rep").select("rep", "id", "block", "row")
    return groups.select("rep", F.lit(1.0).alias("own")), others


def sparse_neighbours(vectors: DataFrame, k: int, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The ``k`` most similar other documents above a threshold: ``id, other, similarity, rank``.

    ``vectors`` is read once. Every partition of it becomes a block, or several if it holds much; partitions of some
    thousand documents are best. Ties go to the lower id.
    """
    if not 0 < threshold < 1:
        raise ValueError("the prefix filter needs a threshold between 0 and 1")
    lower = max(threshold - MARGIN, threshold / 2)
    known = vectors.filter("id IS NOT NULL").select("id", "ranks", "weights")
    blocks = materialize(known.mapInArrow(_blocks(tile_rows, lower), _BLOCK))
    zipped = F.posexplode(F.arrays_zip("ids", "h1", "h2")).alias("row", "_d")
    keys = materialize(blocks.select("block", zipped).select("block", "row", F.col("_d.ids").alias("id"), "_d.h1", "_d.h2"))
    groups, others = (materialize(x) for x in _copies(keys))
    # Of each block, 4 KB that tell which of its vectors are copies of others.
    dropped = others.groupBy("block").agg(F.bitmap_construct_agg(F.col("row").cast("bigint")).alias("dropped"))
    held = blocks.join(F.broadcast(dropped), "block", "left").drop("h1", "h2")
    one, two = (held.select([F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in ("a", "b"))
    met = one.join(two.hint("shuffle_replicate_nl"), F.col("a_block") <= F.col("b_block"))
    edges = met.mapInArrow(_meet(k, threshold, lower), _EDGES)
    best = W.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    ranked = edges.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
    return similarity.expand_copies(keys, groups, others, ranked, k, threshold)
