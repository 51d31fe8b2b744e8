"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 q)`` words that no
neighbouring word extends. Each pair of neighbouring words of a run stands in it three times or more, so
a text is first cut where a rarer pair stands; what is left in pieces of six words or more is compressed:
in every round all pairs that stand twice or more are replaced where they outrank (more frequent first)
the pairs they overlap, and the positions of each rule are kept. When no pair repeats, neighbours are
joined in a balanced tree. A run lies inside the expansion of some symbol and crosses the boundary of its
two halves, so the runs that cross a boundary are computed once per rule, translated to all positions of
the rule, and pieces of one run are merged into its maximal interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import as_bytes

#: Fewest words of a run, and fewest periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def chosen_pairs(key: np.ndarray) -> np.ndarray:
    """Places of the pairs (given by neighbouring keys) that are replaced in one round.

    A pair must stand twice, and must not be outranked by a pair it shares a symbol with. Ranks go by
    frequency, then by a hash of the pair, so equal surroundings are always cut alike; of a stretch of one
    repeated symbol every other pair is taken.
    """
    pairs, back, count = np.unique(key, return_inverse=True, return_counts=True)
    if count.max() < 2:
        return np.empty(0, np.int64)
    order = np.lexsort((pairs.astype(np.uint64) * _MIX, -count))
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs))
    rank[count < 2] = len(pairs)
    own = rank[back]
    padded = np.concatenate([[len(pairs)], own, [len(pairs)]])
    at = np.arange(len(own))
    stretch = np.maximum.accumulate(np.where(padded[:-2] != own, at, 0))
    best = (own < len(pairs)) & (padded[:-2] >= own) & (padded[2:] >= own)
    return np.flatnonzero(best & ((at - stretch) % 2 == 0))


def rules(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size of the left half, size, all positions) of each rule of a text's grammar."""
    n = len(ids)
    symbols, starts = ids, np.arange(n + 1)
    base, named = 2 * n + 1, {}
    found: list[tuple[int, int, list[np.ndarray]]] = []
    fresh = n
    while len(symbols) > 1:
        key = symbols[:-1] * base + symbols[1:]
        at = chosen_pairs(key)
        if not len(at):
            at = np.arange(0, len(symbols) - 1, 2)  # nothing repeats: a balanced tree over the rest
        pairs, first, back = np.unique(key[at], return_index=True, return_inverse=True)
        grouped = np.split(starts[at][np.argsort(back, kind="stable")], np.cumsum(np.bincount(back))[:-1])
        names = np.empty(len(pairs), np.int64)
        for i, (pair, place) in enumerate(zip(pairs.tolist(), at[first].tolist(), strict=True)):
            if pair not in named:
                named[pair] = fresh + len(found)
                begin, middle, end = starts[place], starts[place + 1], starts[place + 2]
                found.append((int(middle - begin), int(end - begin), []))
            names[i] = named[pair]
            found[names[i] - fresh][2].append(grouped[i])
        symbols = symbols.copy()
        symbols[at] = names[back]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols, starts = symbols[kept], starts[np.append(kept, True)]
    for left, size, positions in found:
        yield left, size, np.concatenate(positions)


def stretch_around(t: np.ndarray, s: int, e: int, q: int, x: int) -> tuple[int, int]:
    """The longest interval of ``t[s:e]`` around ``x`` and ``x + q`` in which words q apart are equal."""
    differ = t[x : e - q] != t[x + q : e]
    ahead = int(differ.argmax()) if differ.any() else len(differ)
    differ = (t[s:x] != t[s + q : x + q])[::-1]
    behind = int(differ.argmax()) if differ.any() else len(differ)
    return x - behind, x + ahead + q


def crossing_runs(t: np.ndarray, s: int, c: int, e: int) -> set[Run]:
    """(start, end, period) of the runs of ``t[s:e]`` that have two periods on one side of ``c``."""
    found: set[Run] = set()
    for side in (1, -1):
        room = e - c if side > 0 else c - s
        most = min((e - s) // LEAST_PERIODS, room // 2)
        if most < 1:
            continue
        edge = c if side > 0 else c - 1
        line = t[edge : edge + 2 * most] if side > 0 else t[edge - 2 * most + 1 : edge + 1][::-1]
        periods = np.flatnonzero(line[1 : most + 1] == line[0]) + 1
        for k in (1, 2):
            periods = periods[(periods <= k) | (line[np.minimum(periods + k, 2 * most - 1)] == line[min(k, most)])]
        while len(periods):
            q, periods = int(periods[0]), periods[1:]
            if not np.array_equal(line[:q], line[q : 2 * q]):
                continue
            start, end = stretch_around(t, s, e, q, c if side > 0 else c - 1 - q)
            # Multiples of q that lie well inside its stretch are no smallest period of anything.
            reach = (end - c if side > 0 else c - start) - q
            periods = periods[(periods % q != 0) | (periods > reach)]
            if any(q % p == 0 and a <= start and end <= b for a, b, p in found):
                continue
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.add((start, end, q))
    return found


def merged_runs(pieces: list[np.ndarray]) -> list[Run]:
    """Maximal (start, end, period) of pieces of runs: those that share a whole period are one."""
    if not pieces:
        return []
    whole: list[list[int]] = []
    for q, start, end in np.unique(np.concatenate(pieces), axis=0).tolist():
        if whole and whole[-1][2] == q and start + q <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end, q])
    return [tuple(run) for run in whole]


def frequent_pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches whose neighbouring pairs all stand in the text three times."""
    if len(ids) < LEAST_WORDS:
        return []
    _, back, count = np.unique(ids[:-1] * len(ids) + ids[1:], return_inverse=True, return_counts=True)
    if count.max() < LEAST_PERIODS - 1:
        return []
    often = np.concatenate([[False], count[back] >= LEAST_PERIODS - 1, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1]).reshape(-1, 2)
    return [(a, b + 1) for a, b in edges.tolist() if b + 1 - a >= LEAST_WORDS]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of word ids (0 to n - 1), by start, then period."""
    found: list[tuple[int, int, int]] = []
    for first, last in frequent_pieces(ids):
        _, t = np.unique(ids[first:last], return_inverse=True)
        pieces = []
        for left, size, positions in rules(t):
            if size < LEAST_WORDS:
                continue
            s = int(positions[0])
            for start, end, q in crossing_runs(t, s, s + left, s + size):
                piece = np.empty((len(positions), 3), np.int64)
                piece[:, 0] = q
                piece[:, 1] = positions + (start - s)
                piece[:, 2] = positions + (end - s)
                pieces.append(piece)
        found.extend((first + start, end - start, q) for start, end, q in merged_runs(pieces))
    return sorted(found, key=lambda run: (run[0], run[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers below n that are equal for equal words."""
    number = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in the first period of every run that holds them."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def found_runs(text: Column) -> Column:
    """Words, runs and collapsed text of a text column."""

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("start", "length", "period")
        for batch in batches:
            counts, every, texts = [], [], []
            for data in as_bytes(batch):
                words = data.split()
                runs = runs_of(word_ids(words))
                counts.append(len(words))
                every.append([dict(zip(names, run, strict=True)) for run in runs])
                texts.append(b" ".join(collapsed_words(words, runs)))
            columns = [pa.array(counts, pa.int64()), pa.array(every, _RUNS)]
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.StructArray.from_arrays(columns, names=["n_words", "runs", "collapsed"])

    return found(text)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, runs (by start, then period) and collapsed text of every row, without a shuffle.

    Words are cut at blanks, tabs and line ends. The collapsed text keeps the first period of every run.
    A null or empty text has no words, no runs and an empty collapsed text. Null ids and repeated rows
    stay as they are; other columns are not read; an empty table gives an empty result. Memory follows
    the longest text.
    """
    return docs.select(F.col(id_col), found_runs(F.col(text_col)).alias("f")).select(id_col, "f.*")
