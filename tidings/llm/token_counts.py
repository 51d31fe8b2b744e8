"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of an Arrow batch are laid end to end in one array of symbols. In every
step each pre-token's lowest-rank pair is merged, for all pre-tokens at once; when no pair of a
pre-token has a rank any more, its surviving symbols are its tokens. A long pre-token takes its ranks
one after the other too, each at all its places at once, but only looks where pairs changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import as_bytes, broadcast_file, given_back, per_worker
from tidings.llm.wordpiece import Cutter, model_of

#: Chunks and pre-tokens whose counts a task remembers; then the memory starts anew.
REMEMBERED = 300_000
#: Longer chunks and pre-tokens are not remembered, so the memories hold some tens of MB at most.
REMEMBERED_BYTES = 48
#: Symbols laid out in one array.
BLOCK_SYMBOLS = 1 << 20
#: Pre-tokens of more symbols are merged by places, not by passes over the array.
LONG_SYMBOLS = 256


class RankMerger:
    """Merges many pre-tokens at once, in the order in which the vocabulary file ranks its merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.suffix, self.vocab = suffix, vocab
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.order], made
        # A merge that makes a symbol which an earlier merge uses can open an earlier-ranked pair;
        # then its occurrences are taken one by one.
        first_use = np.full(self.width, len(pairs), np.int64)
        ranks = np.arange(len(pairs))
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.single = first_use[made] < ranks
        self.none = len(pairs)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], self.none)

    def symbols(self, piece: str) -> list[int]:
        return [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.suffix]]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none is empty), in bounded blocks."""
        out, start = [], 0
        while start < len(pieces):
            end, size = start, 0
            while end < len(pieces) and (end == start or size + len(pieces[end]) <= BLOCK_SYMBOLS):
                size += len(pieces[end])
                end += 1
            out.append(self._block(pieces[start:end]))
            start = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def long_count(self, symbols: list[int]) -> int:
        """Tokens of one long pre-token.

        Symbols are linked by places; ``waiting`` holds the places at which each rank may be applied. A
        place whose pair has changed since is passed over. Places 0 and n + 1 are the ends.
        """
        n = len(symbols)
        symbol = np.r_[-1, np.asarray(symbols, np.int64), -1]
        after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
        rank = np.full(n + 2, self.none)
        waiting: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def renew(places: np.ndarray) -> np.ndarray:
            """Rank the pairs that begin at the places, and have them wait."""
            places = places[(places > 0) & (after[places] <= n)]
            new = self.ranks(symbol[places], symbol[after[places]])
            rank[places] = new
            order = np.argsort(new, kind="stable")
            order = order[: np.searchsorted(new[order], self.none)]
            found, starts = np.unique(new[order], return_index=True)
            for r, some in zip(found.tolist(), np.split(places[order], starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(lowest, r)
                waiting[r].append(some)
            return found

        def merge(at: np.ndarray, r: int) -> np.ndarray:
            gone = after[at]
            symbol[at] = self.made[r]
            rank[at] = rank[gone] = self.none
            after[at] = after[gone]
            before[after[at]] = at
            return renew(np.union1d(at, before[at]))

        renew(np.arange(1, n + 1))
        merges = 0
        while lowest:
            r = heapq.heappop(lowest)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not self.single[r] and len(at):
                # Of pairs that overlap, every second one counts, from the left.
                run = np.cumsum(np.r_[True, after[at[:-1]] != at[1:]]) - 1
                first = np.flatnonzero(np.r_[True, np.diff(run) > 0])
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
                merge(at, r)
                merges += len(at)
                continue
            for i in range(len(at)):
                if rank[at[i]] != r:
                    continue
                found = merge(at[i : i + 1], r)
                merges += 1
                if len(found) and found[0] < r and i + 1 < len(at):
                    # A pair of an earlier rank has come up; the rest waits for it.
                    waiting[r] = [at[i + 1 :]]
                    heapq.heappush(lowest, r)
                    break
        return n - merges

    def _block(self, pieces: list[str]) -> np.ndarray:
        laid = [self.symbols(p) for p in pieces]
        done = np.zeros(len(pieces), np.int64)
        for i, x in enumerate(laid):
            if len(x) > LONG_SYMBOLS:
                done[i], laid[i] = self.long_count(x), []
        lengths = np.array([len(x) for x in laid])
        symbols = np.fromiter((s for x in laid for s in x), np.int64, lengths.sum())
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols):
            rank = np.full(len(symbols), self.none)
            joined = owner[:-1] == owner[1:]
            rank[:-1][joined] = self.ranks(symbols[:-1][joined], symbols[1:][joined])
            starts = np.flatnonzero(np.r_[True, ~joined])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == self.none
            done[owner[starts[over]]] = sizes[over]
            best = np.repeat(lowest, sizes)
            chosen = (rank == best) & (rank < self.none)
            # Of pairs that overlap (as in x x x), every second one counts, from the left.
            at = np.flatnonzero(chosen)
            if len(at):
                run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
                first = np.flatnonzero(np.r_[True, np.diff(run) > 0])
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
                alone = self.single[rank[at]]
                if alone.any():
                    new = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
                    at = at[~alone | new]
                symbols[at] = self.made[rank[at]]
            stays = np.repeat(~over, sizes)
            stays[at + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return done


class TokenCounter:
    """Counts tokens of texts; remembers the counts of chunks and pre-tokens it has seen."""

    def __init__(self, cutter: Cutter, merger: RankMerger) -> None:
        self.cutter, self.merger = cutter, merger
        self.chunks: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        #: Long keys of the last block, to be forgotten.
        self.long: list[bytes | str] = []

    def clear(self) -> None:
        self.chunks.clear()
        self.pieces.clear()

    def learn(self, words: list[list[bytes]]) -> None:
        """Count every chunk that is not remembered yet."""
        for memory in (self.chunks, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
            for key in self.long:
                memory.pop(key, None)
        self.long.clear()
        new = {w for text in words for w in text if w not in self.chunks}
        cut = {w: self.cutter.all_pieces(w.decode()) for w in new}
        fresh = list({p for pieces, _ in cut.values() for p in pieces if p not in self.pieces})
        self.pieces.update(zip(fresh, self.merger.counts(fresh).tolist(), strict=True))
        for w, (pieces, specials) in cut.items():
            self.chunks[w] = specials + sum(map(self.pieces.__getitem__, pieces))
        self.long.extend(x for x in (*cut, *fresh) if len(x) > REMEMBERED_BYTES)

    def count(self, texts: list[bytes], step: int = 500) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), step):
            words = [t.split() for t in texts[i : i + step]]
            self.learn(words)
            out.extend(sum(map(self.chunks.__getitem__, w)) for w in words)
        return out


def new_counter(key: str, file: bytes) -> TokenCounter:
    """A task's counter for a vocabulary, which the worker keeps in its parsed form."""

    def parsed() -> tuple[Cutter, RankMerger]:
        model = model_of(file)
        return Cutter(file), RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")

    return TokenCounter(*per_worker(f"merger-{key}", parsed))


def token_count(text: Column, key: str, file: Broadcast) -> Column:
    """Tokens of a text column. ``key``, ``file``: digest and broadcast bytes of the vocabulary."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = new_counter(key, file.value)
        for batch in given_back(batches, counter):
            yield pa.array(counter.count(as_bytes(batch)), pa.int64())

    return counted(text)


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """UTF-8 bytes, tokens and whether they exceed ``limit``, for every row.

    One pass without a shuffle. ``vocabulary`` is the path of a word-end byte-level BPE ``.json`` file
    on the driver. A null text counts as empty (0 tokens); null ids and repeated rows are kept as they
    are; other columns are not read; an empty table gives an empty result.
    """
    key, file = broadcast_file(docs.sparkSession, vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        token_count(text, key, file).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
