"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Each position of a text with DEPTH words left is a suffix.  The trees are built from the root down to depth DEPTH: a
passage of DEPTH words occurs twice if an internal node lies as deep.

1. Prefixes of FIRST words are counted over the whole corpus.  A suffix with a unique prefix, in itself or in one of the
   suffixes that begin inside its window, is a leaf above DEPTH and drops out.
2. The others are partitioned by prefix into groups.  A prefix with more suffixes than GROUP is lengthened, doubling its
   words for each factor of GROWTH, so the suffixes of the commonest passage too are dealt over many groups.
3. A task gets the suffixes of a range of prefixes: each one's path from its prefix down to DEPTH, once for each bundle of texts
   that has it, with its number of leaves.  It sorts them by path; how far neighbours agree is the depth of the internal node that
   joins them.  Each suffix learns the depth of the deepest internal node above its leaf.
4. Windows below nodes of depth DEPTH are repeats; overlapping ones join to the repeated stretches of each text.

Edges are labelled by fingerprints of their words, not by the words: 48 bits for the prefix, 16 at each third of the way down, 64 at
DEPTH.  Two unequal windows count as one only if prefix and window collide, or, where they share the prefix, if the windows do: at 10^13
suffixes some 0.02 such windows are expected.  Node depths above DEPTH are known to the third, and too deep once in 2^16.
Texts are shuffled once; both rounds and the last pass read that one exchange (see packed.py for the exchange of suffixes).

Defined results: null or empty texts have no words and no repeats; texts of fewer than DEPTH words have none; very long texts are
whole in one task; rows that repeat one text are repeats of each other, of which all windows are removed; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstrata.llm import packed
from quillstrata.llm.common import lean

DEPTH, FIRST = 35, 8
#: Suffixes below one prefix; more lengthen it, to twice the words, again for each GROWTH times as many.
GROUP, GROWTH = 1 << 15, 32
_STEPS, _PREFIX_BITS, _STEP_BITS = 3, 48, 16


def step_depths(first: int, depth: int) -> list[int]:
    """Depths between prefix and DEPTH at which a path has a label."""
    return [first + (depth - first) * k // _STEPS for k in range(1, _STEPS)]


def paths(windows: packed.Windows, starts: np.ndarray, first: int, depth: int) -> np.ndarray | None:
    """The labels of each suffix's edges from its prefix to depth, in the leading 96 of 128 bits."""
    if depth == first:
        return None
    one, two = (windows.at(starts, size) >> np.uint64(64 - _STEP_BITS) for size in step_depths(first, depth))
    deep, half = windows.at(starts, depth), np.uint64(32)
    return np.stack([one << np.uint64(48) | two << half | deep >> half, deep << half], axis=1)


def subtree_depths(fps: np.ndarray, more: np.ndarray | None, leaves: np.ndarray, first: int, depth: int) -> np.ndarray:
    """For each distinct path, sorted: the depth of the deepest internal node above its leaves (0: none below the prefix)."""
    if not len(fps):
        return leaves
    joined = np.zeros(len(fps) + 1, np.int64)  # depth of the node that joins a path and the one before it
    if more is not None:
        one, two = step_depths(first, depth)
        differ = more[1:, 0] ^ more[:-1, 0]
        node = np.where(differ >> np.uint64(32) == 0, two, np.where(differ >> np.uint64(48) == 0, one, first))
        joined[1:-1] = np.where(fps[1:] == fps[:-1], node, 0)
    return np.where(leaves > 1, depth, np.maximum(joined[1:], joined[:-1]))


class _Bundle:
    """The suffixes of a bundle's texts."""

    def __init__(self, texts: list[str | None], depth: int, first: int) -> None:
        self.words = [(t or "").encode().split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        hashes = np.concatenate([np.zeros(0, np.uint64), *map(packed.word_hashes, self.words)])
        self.windows, self.depth, self.first = packed.Windows(hashes), depth, first
        self.prefix_starts = self._starts(first)
        prefixes = self.windows.at(self.prefix_starts, first) >> np.uint64(64 - _PREFIX_BITS)
        self.labels, self.place, self.counts = np.unique(prefixes, return_inverse=True, return_counts=True)

    def _starts(self, size: int) -> np.ndarray:
        """Where windows of so many words begin."""
        fit = np.maximum(self.sizes - size + 1, 0)
        return np.repeat(self.begins[:-1] - np.concatenate([[0], np.cumsum(fit)[:-1]]), fit) + np.arange(fit.sum())

    def prefix_words(self, totals: np.ndarray) -> np.ndarray:
        """For each label: 0 if its prefix is unique, else the words to which it is lengthened."""
        size = np.full(len(totals), self.first, np.uint8)
        size[totals <= 1] = 0
        most, words = GROUP, self.first
        while words < self.depth:
            words = min(2 * words, self.depth)
            size[totals > most] = words
            most *= GROWTH
        return size

    def suffixes(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(starts, labels, paths) of the suffixes that may lie below a deep node, given prefix_words."""
        at = np.zeros(self.begins[-1] + 1, np.uint8)
        at[self.prefix_starts] = sizes[self.place]
        run = np.concatenate([[0], np.cumsum(at > 0)])
        inside = self.depth - self.first + 1
        starts = self._starts(self.depth)
        starts = starts[run[starts + inside] - run[starts] == inside]
        labels = self.windows.at(starts, at[starts].astype(np.int64)) >> np.uint64(64 - _PREFIX_BITS)
        return starts, labels, paths(self.windows, starts, self.first, self.depth)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """A flag for each word: whether a window from one of the starts covers it."""
        change = np.zeros(self.begins[-1] + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.depth, -1)
        return np.cumsum(change[:-1]) > 0


def _leaves(labels: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(place of each suffix among the distinct ones; labels, paths and leaves of those)."""
    order, begin = packed.distinct(labels, more)
    counts = np.diff(np.append(begin, len(order)))
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(begin)), counts)
    at = order[begin]
    return place, labels[at], None if more is None else more[at], counts


def repeated(docs: DataFrame, finish, schema: str, depth: int = DEPTH) -> DataFrame:
    """finish(ids, words, flags) -> columns after doc_id, for the texts of a bundle: words by text and whether a repeat of `depth` words covers each."""
    n, first = packed.n_bundles(docs), min(FIRST, depth)
    width = 2 if depth > first else 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(packed.bundle_of(n, "doc_id", "text").alias("bundle"), "doc_id", "text")

    def load(table: pa.Table) -> _Bundle:
        return _Bundle(table.column("text").to_pylist(), depth, first)

    def count_prefixes(table: pa.Table) -> pa.Table:
        b = load(table)
        return packed.send(table.column("bundle")[0].as_py(), b.labels, b.counts, n, _PREFIX_BITS)

    def send_suffixes(table: pa.Table, back: pa.Table) -> pa.Table:
        b = load(table)
        sizes = b.prefix_words(packed.received(back)[0])
        _, labels, more, counts = _leaves(*b.suffixes(sizes)[1:])
        return packed.send(table.column("bundle")[0].as_py(), labels, counts, n, _PREFIX_BITS, more, packed.squeeze(sizes) if len(sizes) else None)

    def judge(fps: np.ndarray, more: np.ndarray | None, leaves: np.ndarray) -> np.ndarray:
        return subtree_depths(fps, more, leaves, first, depth)

    def cover(table: pa.Table, back: pa.Table) -> pa.Table:
        depths, extra = packed.received(back)
        b = load(table)
        starts, labels, more = b.suffixes(packed.expand(extra, np.uint8) if extra else np.zeros(0, np.uint8))
        place = _leaves(labels, more)[0]
        flags = b.covered(starts[depths[place] >= depth])
        columns = finish(b.words, [flags[x:y] for x, y in zip(b.begins[:-1], b.begins[1:], strict=True)])
        return pa.table({"doc_id": table.column("doc_id"), **columns})

    grouped = rows.groupBy("bundle")
    prefixes = packed.add_up(grouped.applyInArrow(lean(count_prefixes), packed.SENT), n, _PREFIX_BITS)
    suffixes = grouped.cogroup(prefixes.groupBy("bundle")).applyInArrow(lean(send_suffixes), packed.SENT)
    depths = packed.add_up(suffixes, n, _PREFIX_BITS, judge, width)
    return grouped.cogroup(depths.groupBy("bundle")).applyInArrow(lean(cover), f"doc_id {kind}, {schema}")


def spans(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, spans: the stretches of each text that repeats cover, as [start, stop) in words; repeats that overlap or touch are one stretch."""

    def finish(words, flags):
        out = []
        for f in flags:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
            out.append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        return {"spans": pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))}

    return repeated(docs, finish, "spans array<struct<start:int,stop:int>>", depth)


def remove(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, text: the words that no repeat covers, joined by spaces."""

    def finish(words, flags):
        return {"text": pa.array([b" ".join(w[i] for i in np.flatnonzero(~f)).decode() for w, f in zip(words, flags, strict=True)], pa.string())}

    return repeated(docs, finish, "text string", depth)


def report(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The columns of query op10."""

    def finish(words, flags):
        kept = [hashlib.sha256(b" ".join([w[i] for i in np.flatnonzero(~f).tolist()] if f.any() else w)).hexdigest() for w, f in zip(words, flags, strict=True)]
        return {"n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array([int(f.sum()) for f in flags], pa.int64()), "kept_sha256": pa.array(kept, pa.string())}

    return repeated(docs, finish, "n_words bigint, n_removed bigint, kept_sha256 string", depth)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, s, sha256(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM g JOIN r USING (h)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(ps, []), p)), lambda p: w[p]), ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
