"""Adding up fingerprints of a whole corpus with little to shuffle.

Rows are dealt into bundles by a hash of their contents, each small enough for one task.  A bundle sends each distinct key
once, with the number of its own occurrences, to the task of the key's range, as sorted differences in byte planes,
compressed; that task adds up, judges the sums and sends one number for each key back, in the order in which they came.  A key
that a third of all rows hold is so sent once for each bundle.  What a bundle sends depends on its rows only, not on their order,
so a task that is run again, or a second pass over the bundle, gets the same order.

A source cuts its keys into FAN ranges at most, so the rows that are sent grow in proportion to the bundles.  With more than FAN
bundles the exchange has levels: what FAN sources sent to one range is merged by a task, which cuts it into finer ranges and
sends those on as one source; on the way back it spreads the numbers over its sources.  log_FAN(bundles) levels do for any corpus.

A key is a fingerprint, by which it is dealt, and perhaps `more`: further bytes that tell keys of one fingerprint apart.
Rows that are alike in all that bundle_of hashes meet in one bundle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import lean, spool

#: Characters in a bundle: some million words, below 150 MB in a task.  LEAST_BUNDLES: also for small inputs, so that all cores work.
BUNDLE_CHARS, LEAST_BUNDLES = 6_000_000, 64
#: Ranges that a source sends to, and sources that a task merges; a power of two.
FAN = 256

SENT = "r bigint, source int, fps binary, more binary, counts binary, extra binary"
BACK = "bundle int, r bigint, totals binary, extra binary"

#: (fps, more, sums) of the sorted distinct keys of a range -> a number below 2^32 for each.
Judge = Callable[[np.ndarray, np.ndarray | None, np.ndarray], np.ndarray]


def n_bundles(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(LEAST_BUNDLES, -(-chars // BUNDLE_CHARS))


def bundle_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def squeeze(a: np.ndarray) -> bytes:
    """An array of integers as compressed byte planes."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Windows:
    """Fingerprints of runs of consecutive words anywhere in a sequence of word hashes: a polynomial in them, then mixed."""

    def __init__(self, words: np.ndarray) -> None:
        powers = np.full(len(words) + 1, _POWER)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], out=self.sums[1:])
        powers[1:] = _INVERSE
        self.back = np.cumprod(powers, out=powers)

    def at(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + size] - self.sums[starts]) * self.back[starts] + np.uint64(1) * np.asarray(size).astype(np.uint64))


def distinct(fps: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): keys sorted by fps[order], equal ones together, each run of them beginning at order[first]."""
    if more is None:
        order = np.argsort(fps, kind="stable")
        fps = fps[order]
        new = fps[1:] != fps[:-1]
    else:
        order = np.lexsort((*(more[:, j] for j in range(more.shape[1] - 1, -1, -1)), fps))
        fps, more = fps[order], more[order]
        new = (fps[1:] != fps[:-1]) | (more[1:] != more[:-1]).any(axis=1)
    return order, np.flatnonzero(np.concatenate([[True], new])) if len(fps) else np.zeros(0, np.int64)


def fan(sources: int) -> int:
    """Ranges for so many sources."""
    return sources if sources <= FAN else FAN


def _cuts(fps: np.ndarray, low: int, step: int, n: int) -> list[int]:
    """Where each of n ranges of `step` fingerprints from low on begins, and the end."""
    edges = np.array([min(low + i * step, (1 << 64) - 1) for i in range(1, n)], np.uint64)
    return [0, *np.searchsorted(fps, edges).tolist(), len(fps)]


def _rows(source: int, fps, more, counts, cuts: list[int], begin: int, extra: bytes | None, at: int) -> pa.Table:
    rows = []
    counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own = extra if i == at else None
        if a < b:
            rows.append((begin + i, source, squeeze_sorted(fps[a:b]), None if more is None else squeeze(more[a:b].reshape(-1)), squeeze(counts[a:b]), own))
        elif own is not None:
            rows.append((begin + i, source, None, None, None, own))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["r", "source", "fps", "more", "counts", "extra"])


def send(bundle: int, fps: np.ndarray, counts: np.ndarray, n: int, bits: int, more: np.ndarray | None = None, extra: bytes | None = None) -> pa.Table:
    """Rows of SENT for one of n bundles: distinct keys in order, fingerprints of so many bits.  more: (keys, columns) of uint64.

    extra, if given, is handed through to the totals of the bundle."""
    ranges = fan(n)
    return _rows(bundle, fps, more, counts, _cuts(fps, 0, -(-(1 << bits) // ranges), ranges), 0, extra, bundle % ranges)


class _Merged:
    """What several sources sent to one range."""

    def __init__(self, sent: pa.Table, width: int) -> None:
        columns = (sent.column(c).to_pylist() for c in ("source", "r", "fps", "more", "counts", "extra"))
        self.rows = sorted(zip(*columns, strict=True), key=lambda x: x[:2])
        self.held = [i for i, x in enumerate(self.rows) if x[2] is not None]
        parts = [expand_sorted(self.rows[i][2]) for i in self.held]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        fps = np.concatenate([np.zeros(0, np.uint64), *parts])
        more = None
        if width:
            more = np.concatenate([np.zeros((0, width), np.uint64), *(expand(self.rows[i][3], np.uint64).reshape(-1, width) for i in self.held)])
        self.order, self.first = distinct(fps, more)
        counts = np.concatenate([np.zeros(0, np.uint64), *(expand(self.rows[i][4], np.uint32).astype(np.uint64) for i in self.held)])[self.order]
        at = self.order[self.first]
        self.fps, self.more = fps[at], None if more is None else more[at]
        self.sums = np.minimum(np.add.reduceat(counts, self.first), 0xFFFFFFFF) if len(fps) else counts

    def spread(self, numbers: np.ndarray) -> pa.Table:
        """Rows of BACK: each source's keys get the numbers of the distinct keys."""
        n, back = len(self.order), [None] * len(self.rows)
        totals = np.empty(n, np.uint32)
        totals[self.order] = np.repeat(numbers.astype(np.uint32), np.diff(np.append(self.first, n)))
        for i, part in zip(self.held, np.split(totals, np.cumsum(self.sizes)[:-1]), strict=True) if self.held else ():
            back[i] = squeeze(part)
        sources, ranges, extras = ([x[j] for x in self.rows] for j in (0, 1, 5))
        return pa.table([pa.array(sources, pa.int32()), pa.array(ranges, pa.int64()), pa.array(back, pa.binary()), pa.array(extras, pa.binary())], names=["bundle", "r", "totals", "extra"])


def sums(fps: np.ndarray, more: np.ndarray | None, counts: np.ndarray) -> np.ndarray:
    """The judge that only adds up."""
    return counts


def add_up(sent: DataFrame, n: int, bits: int, judge: Judge = sums, width: int = 0) -> DataFrame:
    """BACK rows from the SENT rows of n bundles.  width: columns of `more`."""
    return _level(sent, n, bits - FAN.bit_length() + 1, judge, width)


def _level(sent: DataFrame, sources: int, below: int, judge: Judge, width: int) -> DataFrame:
    """below: bits of a fingerprint that its range doesn't tell."""
    if sources <= FAN:

        def judged(table: pa.Table) -> pa.Table:
            m = _Merged(table, width)
            return m.spread(judge(m.fps, m.more, m.sums))

        return sent.groupBy("r").applyInArrow(lean(judged), BACK)

    merged_sources = -(-sources // FAN)
    deal = max(1, min(FAN, 1 << (merged_sources - 1).bit_length()).bit_length() - 1)  # bits of the finer ranges

    def merge(table: pa.Table) -> pa.Table:
        m, r = _Merged(table, width), table.column("r")[0].as_py()
        n = 1 << deal
        return _rows(table.column("source")[0].as_py() // FAN, m.fps, m.more, m.sums, _cuts(m.fps, r << below, 1 << (below - deal), n), r << deal, None, -1)

    def spread(table: pa.Table, back: pa.Table) -> pa.Table:
        m, (numbers, _) = _Merged(table, width), received(back)
        return m.spread(numbers)

    grouped = spool(sent, "sent").withColumn("g", F.floor(F.col("source") / FAN)).groupBy("r", "g")
    finer = _level(grouped.applyInArrow(lean(merge), SENT), merged_sources, below - deal, judge, width)
    back = finer.withColumn("above", F.shiftright("r", deal)).withColumn("g", F.col("bundle").cast("bigint"))
    return grouped.cogroup(back.groupBy("above", "g")).applyInArrow(lean(spread), BACK)


def received(back: pa.Table) -> tuple[np.ndarray, bytes | None]:
    """The totals of one bundle's keys in their order, and what it sent as extra."""
    rows = sorted(zip(*(back.column(c).to_pylist() for c in ("r", "totals")), strict=True), key=lambda x: x[0])
    parts = [expand(t, np.uint32) for _, t in rows if t is not None]
    extra = [x for x in back.column("extra").to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), extra[0] if extra else None
