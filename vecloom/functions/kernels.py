"""Numpy kernels for Arrow batches. Distances of whole numbers are exact: products stay below 2^53.

Distances of floats are never rounded. `l2` and products of matrices find candidates; their last digits depend on the
block, so `scores` gives float candidates their distance anew, summed alike for any pair: equal vectors tie exactly.
"""

from __future__ import annotations


def matrix(column, dtype="float64"):
    """A list column of equally long vectors as a 2-d array."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype)


def l2(a, b):
    """All squared distances between rows of a and of b, in one product: (-2a, |a|^2, 1) with (b, 1, |b|^2)."""
    import numpy as np

    one = lambda x: np.ones((len(x), 1))
    square = lambda x: (x * x).sum(1)[:, None]
    return np.concatenate([-2.0 * a, square(a), one(a)], 1) @ np.concatenate([b, one(b), square(b)], 1).T


def slack(q, v):
    """For each row of q, more than a matrix product can be off by in its distance or product with any row of v."""
    import numpy as np

    return 1e-12 * ((q * q).sum(1) + (v * v).sum(1).max(initial=0) + np.finfo(float).tiny)


def scores(q, v, metric: str = "l2", cells: int = 1 << 21):
    """The distance of each row of q and the row of v beside it, or for ip their product with its sign changed."""
    import numpy as np

    out, step = np.empty(len(q)), max(1, cells // max(1, q.shape[1]))
    for s in range(0, len(q), step):
        a, b = q[s : s + step], v[s : s + step]
        out[s : s + step] = ((a - b) ** 2).sum(1) if metric == "l2" else -(a * b).sum(1)
    return out


def within_edge(d, n: int):
    """(rows, columns) of the values that aren't above the n-th least of their row: n a row or, at ties, more."""
    import numpy as np

    if n >= d.shape[1]:
        return np.repeat(np.arange(d.shape[0]), d.shape[1]), np.tile(np.arange(d.shape[1]), d.shape[0])
    return np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n])


def first_of_each(key, n: int):
    """Places of the first n of each run of equal keys, for sorted keys."""
    import numpy as np

    if not len(key):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.flatnonzero(np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key)))) < n)


def smallest(d, n: int):
    """(places, values) of the n least of each row, in order of value and then place."""
    import numpy as np

    n = min(n, d.shape[1])
    if n == 1:
        at = d.argmin(1)[:, None]
        return at, np.take_along_axis(d, at, 1)
    row, at = within_edge(d, n)
    value = d[row, at]
    order = np.lexsort((at, value, row))
    order = order[first_of_each(row[order], n)]
    return at[order].reshape(-1, n), value[order].reshape(-1, n)


def encode(r, codebook):
    """Codes of residuals r (n, d) by the codebook (m, ksub, dsub): the nearest word of each part, the lowest at ties."""
    import numpy as np

    m, _, dsub = codebook.shape
    return np.stack([smallest(l2(r[:, i * dsub : (i + 1) * dsub], codebook[i]), 1)[0][:, 0] for i in range(m)], 1)


def decode(code, codebook):
    """The vectors (n, d) that codes (n, m) stand for: the words of their parts side by side."""
    import numpy as np

    m, _, dsub = codebook.shape
    return codebook[np.arange(m), code].reshape(len(code), m * dsub)


def lut(r, codebook, metric: str = "l2"):
    """(n, m * ksub) table of part distances, or part products for metric ip."""
    import numpy as np

    m, ksub, dsub = codebook.shape
    parts = [r[:, i * dsub : (i + 1) * dsub] for i in range(m)]
    return np.concatenate([l2(p, w) if metric == "l2" else p @ w.T for p, w in zip(parts, codebook)], 1)


class TopK:
    """The k best (score, id) of each of n queries, over blocks of scores. Scores are least first.

    `limit` is what a query's k-th best can't exceed any more: scores above it are dropped at once. exact: gives the
    scores of some (queries, columns) anew where those of a block are only good to within `slack` of each query.
    """

    def __init__(self, k: int, n: int, most: int = 1 << 21):
        import numpy as np

        self.k, self.limit, self.most, self.parts, self.size = k, np.full(n, np.inf), most, [], 0

    def add(self, queries, scores, ids, exact=None, slack=0.0) -> None:
        """scores: a row for each of queries (numbers below n), a column for each of ids."""
        import numpy as np

        limit = self.limit[queries]
        if scores.shape[1] > self.k:
            self.limit[queries] = limit = np.minimum(limit, np.partition(scores, self.k - 1, axis=1)[:, self.k - 1] + slack)
        row, at = np.divmod(np.flatnonzero(scores <= (limit + slack)[:, None]), scores.shape[1])
        self.parts.append((queries[row], exact(row, at) if exact else scores[row, at], ids[at]))
        self.size += len(row)
        if self.size > self.most:
            self._cut()
            self.most = max(self.most, 2 * self.size)

    def _cut(self) -> None:
        import numpy as np

        query, score, ident = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ident, score, query))
        order = order[first_of_each(query[order], self.k)]
        query, score, ident = query[order], score[order], ident[order]
        self.parts, self.size = [(query, score, ident)], len(order)
        if len(query) >= self.k:
            full = np.flatnonzero(query[self.k - 1 :] == query[: len(query) - self.k + 1]) + self.k - 1
            self.limit[query[full]] = np.minimum(self.limit[query[full]], score[full])

    def table(self):
        """(query, score, id) columns."""
        import numpy as np

        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self._cut()
        return self.parts[0]
