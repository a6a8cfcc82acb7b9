"""Sparse matrices in compressed rows, built by hand from numpy arrays.

A block of documents is one such matrix: small enough for a task, while Spark deals the blocks.
"""

from __future__ import annotations

import numpy as np

#: Partial products that a multiplication holds at once.
HELD = 1 << 18


class CSR:
    """Row i holds ``data[indptr[i]:indptr[i + 1]]`` in the columns ``indices`` of the same places."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, width: int):
        self.indptr = np.asarray(indptr, dtype=np.int64)
        self.indices = np.asarray(indices, dtype=np.int64)
        self.data = np.asarray(data, dtype=np.int64)
        self.width = int(width)

    @classmethod
    def summed(cls, row: np.ndarray, col: np.ndarray, data: np.ndarray, height: int, width: int) -> CSR:
        """From entries in any order; those of one place are added up."""
        if len(row):
            place = row * max(width, 1) + col
            if np.any(place[1:] <= place[:-1]):
                order = np.argsort(place, kind="stable")
                place, data = place[order], data[order]
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                place, data = place[first], np.add.reduceat(data, first)
            row, col = np.divmod(place, max(width, 1))
        counts = np.bincount(row, minlength=height) if len(row) else np.zeros(height, dtype=np.int64)
        return cls(np.concatenate(([0], np.cumsum(counts))), col, data, width)

    @classmethod
    def counted(cls, row: np.ndarray, col: np.ndarray, height: int, width: int) -> CSR:
        """How often each place occurs; sorting the places alone is faster than ordering entries."""
        place = np.sort(row * max(width, 1) + col)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
        row, col = np.divmod(place[first], max(width, 1))
        counts = np.bincount(row, minlength=height) if len(row) else np.zeros(height, dtype=np.int64)
        return cls(np.concatenate(([0], np.cumsum(counts))), col, np.diff(np.append(first, len(place))), width)

    @classmethod
    def one_per_row(cls, col: np.ndarray, width: int) -> CSR:
        """A single 1 in each row."""
        return cls(np.arange(len(col) + 1), col, np.ones(len(col), dtype=np.int64), width)

    @classmethod
    def runs(cls, lengths: np.ndarray) -> CSR:
        """Row i has 1 in the next ``lengths[i]`` columns: intervals laid end to end."""
        ends = np.cumsum(lengths, dtype=np.int64)
        width = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate(([0], ends)), np.arange(width), np.ones(width, dtype=np.int64), width)

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.indptr))

    def transposed(self) -> CSR:
        return CSR.summed(self.indices, self.rows(), self.data, self.width, self.height)

    def row_sums(self) -> np.ndarray:
        """Sums of the entries, a row."""
        total = np.concatenate(([0], np.cumsum(self.data)))
        return total[self.indptr[1:]] - total[self.indptr[:-1]]

    def row_counts(self) -> np.ndarray:
        """Entries that are not zero, a row."""
        marks = np.concatenate(([0], np.cumsum(self.data != 0)))
        return marks[self.indptr[1:]] - marks[self.indptr[:-1]]

    def times_vector(self, vector: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.data * np.asarray(vector, dtype=np.int64)[self.indices])))
        return total[self.indptr[1:]] - total[self.indptr[:-1]]

    def times(self, other: CSR) -> CSR:
        """Gustavson's product: row i is the sum of the rows of ``other`` that row i's columns name,
        each weighted by its entry.

        Rows are taken together until they make ``HELD`` partial products; a row that makes more
        is taken alone.
        """
        if self.width != other.height:
            raise ValueError("the inner sides differ")
        width = np.diff(other.indptr)[self.indices]
        made = np.concatenate(([0], np.cumsum(width)))
        at_row = made[self.indptr]
        row, col, data, start = [], [], [], 0
        rows = self.rows()
        while start < self.height:
            end = max(start + 1, int(np.searchsorted(at_row, at_row[start] + HELD, side="right")) - 1)
            part = slice(self.indptr[start], self.indptr[end])
            length = width[part]
            within = np.arange(int(length.sum())) - np.repeat(made[part] - made[part.start], length)
            place = np.repeat(other.indptr[self.indices[part]], length) + within
            product = CSR.summed(
                np.repeat(rows[part] - start, length), other.indices[place],
                np.repeat(self.data[part], length) * other.data[place], end - start, other.width)
            row.append(product.rows() + start)
            col.append(product.indices)
            data.append(product.data)
            start = end
        none = [np.zeros(0, dtype=np.int64)]
        return CSR.summed(*(np.concatenate(x or none) for x in (row, col, data)), self.height, other.width)
