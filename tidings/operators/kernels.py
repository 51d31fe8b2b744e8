"""Small NumPy helpers that run inside Spark tasks on one Arrow batch or one tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


def best_columns(
    scores: np.ndarray, column_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k best scores of every row, ties by column id.

    Entries of minus infinity are never returned.
    """
    rows_n, cols_n = scores.shape
    if not rows_n or not cols_n or k <= 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty
    if cols_n > k:
        cut = np.partition(scores, cols_n - k, axis=1)[:, cols_n - k]
        keep = (scores >= cut[:, None]) & np.isfinite(scores)
    else:
        keep = np.isfinite(scores)
    rows, cols = np.nonzero(keep)
    order = np.lexsort((column_ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(rows_n))
    first = np.arange(len(rows)) - starts[rows] < k
    return rows[first], cols[first]


#: Pairs above the threshold per row, beyond which all scores of a slice are ranked instead.
FEW_PAIRS = 32


def close_pairs(
    a: np.ndarray, b: np.ndarray, floor: float, floors: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of two unit matrices whose cosine is above ``floor``, with the cosine; None if they are many.

    With ``floors``, a pair has to come up to the floor of either of its rows too. Single precision finds the
    pairs, with room for its rounding; double precision decides.
    """
    room = 4.0 * (a.shape[1] + 4) * float(np.finfo(np.float32).eps)
    scores = a.astype(np.float32) @ b.astype(np.float32).T
    if floors is None:
        near = scores > np.float32(floor - room)
    else:
        near = scores > (np.maximum(floors[0], floor) - room).astype(np.float32)[:, None]
        near |= scores > (np.maximum(floors[1], floor) - room).astype(np.float32)[None, :]
    if np.count_nonzero(near) > FEW_PAIRS * len(a):
        return None
    rows, cols = np.nonzero(near)
    return rows, cols, np.einsum("ij,ij->i", a[rows], b[cols])


def best_of_pairs(
    rows: np.ndarray, scores: np.ndarray, column_ids: np.ndarray, k: int
) -> np.ndarray:
    """Which of the pairs (row, score, id) are among the k best of their row, ties by id; by row, best first."""
    order = np.lexsort((column_ids, -scores, rows))
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    return order[place < k]
