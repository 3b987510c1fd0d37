"""Benchmark passages in documents: q-gram lemma filter in diagonal bands, then banded alignment."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import append, cache, documents, unused

Q = 7
#: Edits allowed for each character of a passage.
RATE = 0.08
#: Characters that a passage must have to be looked for. Shorter items are answers ("yes", "42") that any text may hold.
LEAST = 13
#: Passages of fewer characters count only where they begin and end with a word of the text.
WORDS_BELOW = 50
#: Characters that a passage must have for a document to go because of it.
LEAST_DROPPED = 50
#: Characters of benchmark passages in an index; larger benchmarks have several, which a task uses in turn.
BLOCK_CHARS = 1 << 20
#: Characters of text that are looked at together; longer texts are cut in parts that overlap by the longest passage.
PART = 1 << 18
#: Shared q-grams of a text's part and the passages, and counts of windows and passages, that are looked at together,
#: about; parts with more are halved.
MOST_HITS = 1 << 21
MOST_CELLS = 1 << 21
#: Characters of text that are aligned with a passage at once: rows of its length and the band's.
ALIGNED = 1 << 20

HITS = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: int>>"


def code_points(text: str):
    """Lower case, white space as blanks, one number per character of the text."""
    import numpy as np

    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 9) & (a <= 13)] = 32
    return a


def grams(a, q: int):
    """64-bit hashes of all windows of q characters."""
    import numpy as np

    if len(a) < q:
        return np.zeros(0, np.uint64)
    n, base = len(a) - q + 1, np.uint64(0x9E3779B97F4A7C15)
    a = a.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h *= base
        h += a[i : i + n]
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


class Index:
    """Passages of one block: sorted q-gram hashes with the places where they occur."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, least: int = LEAST):
        import numpy as np

        if least < q:
            raise ValueError(f"passages of {least} characters have no {q}-gram")
        self.q, self.items = q, [(i, code_points(t)) for i, t in items if t and len(t.strip()) >= least]
        self.edits, self.bound = [], []
        for _, a in self.items:
            e = int(rate * len(a))
            while e and len(a) - q + 1 - q * e < 1:
                e -= 1
            self.edits.append(e)
            self.bound.append(max(1, len(a) - q + 1 - q * e))
        found = [(grams(a, q), k) for k, (_, a) in enumerate(self.items)]
        h = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in found)])
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g), k, np.int64) for g, k in found)])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g, _ in found)])
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.longest = max((len(a) for _, a in self.items), default=0)
        self.margin = self.longest + max(self.edits, default=0)


def _shared(index: Index, a):
    """(places in the text, number of the q-gram there) of all q-grams that passages have too."""
    import numpy as np

    h = grams(a, index.q)
    p = np.flatnonzero(index.seen[(h >> np.uint64(64 - index.bits)).astype(np.int64)])
    g = np.searchsorted(index.hashes, h[p])
    g[g == len(index.hashes)] = 0
    ok = index.hashes[g] == h[p] if len(index.hashes) else np.zeros(len(p), bool)
    return p[ok], g[ok]


def _hits(index: Index, p, g):
    """(item, text place minus item place, text place) of all shared q-grams, one for each place in a passage."""
    import numpy as np

    n = index.count[g]
    place = np.repeat(index.first[g] - np.concatenate([[0], n.cumsum()[:-1]]) if len(n) else n, n) + np.arange(n.sum())
    p = np.repeat(p, n)
    return index.item[place], p - index.at[place], p


def align(item, texts, low: int, width: int):
    """(edits, start, end) of the best place of item in each row of texts, on diagonals low to low + width - 1.

    Ends are free in the text. texts: rows of len(item) + width - 1 characters, the first at diagonal `low`. Costs and
    starts share a number, so that the least cost and then the least start win.
    """
    import numpy as np

    rows, one = len(texts), np.int64(1) << 32
    lane = np.arange(width, dtype=np.int64)
    d = np.broadcast_to(lane, (rows, width)).copy()  # cost 0, start at this diagonal
    step = lane * one
    for j, c in enumerate(item):
        missing = d[:, 1:] + one  # a character of the item has none in the text
        d = d + (texts[:, j : j + width] != c) * one  # the same diagonal: equal or replaced
        np.minimum(d[:, :-1], missing, out=d[:, :-1])
        d = np.minimum.accumulate(d - step, axis=1) + step  # characters more in the text
    best = d.argmin(1)
    value = d[np.arange(rows), best]
    return (value >> 32).astype(np.int64), (value & (one - 1)) + low, best + len(item) + low


def find(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """(item_id, start, end, edits) of the passages in each text, in order of place; end is exclusive.

    Of overlapping places of one passage the one with least edits stays, then the first.
    """
    parts, group, size, whole = [], [], 0, [code_points(t or "") for t in texts]
    for k, a in enumerate(whole):
        for s in range(0, max(1, len(a)), PART):
            group.append((k, s, a[s : s + PART + index.margin]))
            size += len(group[-1][2])
            if size >= PART:
                parts.append(group)
                group, size = [], 0
    parts.append(group)
    found: list[set] = [set() for _ in texts]
    for group in parts:
        if group and index.items:
            _find_part(index, group, found)
    return [_distinct({(index.items[k][0], s, e, n) for k, s, e, n in x if len(index.items[k][1]) >= WORDS_BELOW or _words(a, s, e)}) for a, x in zip(whole, found)]


def _words(a, start: int, end: int) -> bool:
    """Whether no word of the text goes on over either end of the place."""
    joined = lambda i: 0 < i < len(a) and chr(a[i - 1]).isalnum() and chr(a[i]).isalnum()
    return not joined(start) and not joined(end)


def _distinct(found: set) -> list[tuple[int, int, int, int]]:
    kept: list[tuple] = []
    by: dict[int, list[tuple[int, int]]] = {}
    for e, s, end, i in sorted((e, s, end, i) for i, s, end, e in found):
        if all(end <= a or s >= b for a, b in by.get(i, ())):
            by.setdefault(i, []).append((s, end))
            kept.append((i, s, end, e))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def _find_part(index: Index, group: list, found: list[set]) -> None:
    import numpy as np

    gap = np.full(index.q, 0xFFFFFFFF, np.uint32)
    starts, pieces, at = [], [], 0
    for _, _, a in group:
        starts.append(at)
        pieces += [a, gap]
        at += len(a) + len(gap)
    starts = np.array(starts)
    whole = np.concatenate(pieces)
    p, g = _shared(index, whole)
    if not len(p):
        return
    window = 1 << int(index.margin).bit_length()
    if int(index.count[g].sum()) > MOST_HITS or len(whole) // window * len(index.items) > MOST_CELLS:
        k, off, a = group[0]
        middle = len(a) // 2
        halves = [group[: len(group) // 2], group[len(group) // 2 :]] if len(group) > 1 else [[(k, off, a[: middle + index.margin])], [(k, off + middle, a[middle:])]]
        if len(group) > 1 or len(a) > 4 * index.margin:
            for half in halves:
                _find_part(index, half, found)
            return
    item, diagonal, p = _hits(index, p, g)
    n, bound, width = len(index.items), np.array(index.bound), np.array(index.edits) + 1
    # A place of a passage lies in two neighbouring windows of the text. Windows where these two share fewer q-grams
    # with it in all than the bound asks of one band are out.
    bins = (p // window) * n + item
    count = np.bincount(bins, minlength=(len(whole) // window + 2) * n).reshape(-1, n)
    near = np.zeros_like(count)
    near[1:] = count[:-1]
    near[:-1] = np.maximum(near[:-1], count[1:])
    part = np.searchsorted(starts, p, side="right") - 1
    on = ((count + near) >= bound).ravel()[bins]
    item, diagonal, pair = item[on], diagonal[on] - starts[part[on]] + index.margin, (part * n + item)[on]
    # Bands of 2 * width diagonals start at each multiple of width: those of any alignment within the budget lie in one.
    band = diagonal // width[item]
    slots = int(band.max(initial=0)) + 2
    key, count = np.unique(np.concatenate([pair * slots + band + 1, pair * slots + band]), return_counts=True)
    pair = key // slots
    keep = count >= bound[pair % n]
    pair, band = pair[keep], key[keep] % slots - 1
    for k in np.unique(pair % n).tolist():
        pattern = index.items[k][1]
        w = int(width[k])
        mine = np.flatnonzero(pair % n == k)
        step = max(1, min(256, ALIGNED // (len(pattern) + 2 * w)))
        for s in range(0, len(mine), step):
            some = mine[s : s + step]
            rows = np.full((len(some), len(pattern) + 2 * w - 1), 0xFFFFFFFF, np.uint32)
            lows = band[some] * w - index.margin
            for r, (g, low) in enumerate(zip((pair[some] // n).tolist(), lows.tolist())):
                a = group[g][2]
                x, y = max(0, low), min(len(a), low + rows.shape[1])
                if y > x:
                    rows[r, x - low : y - low] = a[x:y]
            edits, first, end = align(pattern, rows, 0, 2 * w)
            for g, low, e, f, z in zip((pair[some] // n).tolist(), lows.tolist(), edits.tolist(), first.tolist(), end.tolist()):
                if e <= index.edits[k]:
                    doc, off, a = group[g]
                    found[doc].add((k, max(0, f + low) + off, min(len(a), z + low) + off, e))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS):
    """The passages, at most `chars` characters at a time (a longer one alone), in order of their ids."""
    some, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), text).where(F.col(text).isNotNull()).orderBy(item_id, text).toLocalIterator():
        if some and size + len(r[1]) > chars:
            yield some
            some, size = [], 0
        some.append((r[0], r[1]))
        size += len(r[1])
    if some:
        yield some


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", q: int = Q, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """docs with the benchmark passages in each whole text, as an array of (item_id, start, end, edits) in order of place.

    A passage of L characters counts if rate * L edits at most turn it into a part of the text; letter case and kinds
    of white space don't count as edits. By the q-gram lemma such a place shares at least L - q + 1 - q * edits q-grams
    on neighbouring diagonals. Short passages get fewer edits, so that this bound is 1 at least, and below WORDS_BELOW
    characters must be whole words of the text; those of fewer than `least` characters, null and blank ones are never
    found. Null and empty texts have no hits; equal texts have equal hits; without passages every array is empty.
    The passages are broadcast; a task reads its documents once and takes them through one index after the other,
    BLOCK_CHARS of passages at a time, so neither an index nor the plan grows with the benchmark.
    """
    spark = docs.sparkSession
    # Packed, since a worker keeps what it has read of them.
    parts, token = [spark.sparkContext.broadcast(zlib.compress(json.dumps(items).encode("utf-8", "surrogatepass"))) for items in blocks(benchmark)], uuid.uuid4().hex

    def make():
        import pyarrow as pa

        def index(k):
            held = cache("passages", dict)
            if held.get("of") != (token, k):
                held.clear()  # one index at a time
                held.update(of=(token, k), index=Index(json.loads(zlib.decompress(parts[k].value)), q, rate, least))
            return held["index"]

        names = ("item_id", "start", "end", "edits")
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

        def apply(texts):
            data = texts.to_pylist()
            rows = [[] for _ in data]
            for k in range(len(parts)):
                for row, found in zip(rows, find(index(k), data)):
                    row += found
            return [pa.array([[dict(zip(names, x)) for x in sorted(r, key=lambda x: (x[1], x[2], x[0]))] for r in rows], kind)]

        return apply

    return append(docs, [(out, HITS)], text, make)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST_DROPPED) -> DataFrame:
    """The documents without a benchmark passage of at least `least` characters, with the columns of docs only."""
    hits = unused(docs, "hits")
    return with_hits(docs, benchmark, text, hits, least=least).where(F.size(hits) == 0).drop(hits)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document: doc_id, item_id, start, end (code points, end exclusive), edits."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_hits(documents(spark, sf_dir).select("doc_id", "text"), benchmark).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
