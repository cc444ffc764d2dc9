"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is one token with which its BPE encoding ends.  `PrefixState` keeps that token for each
prefix: the encoding of prefix i ends with the one token t, ending at i, for which t may follow the last token of
prefix i - len(t).  Two tokens may follow each other if no merge across their border comes before the merges
that made them; the border is followed down both tokens' merges, latest merge first, and what is found is remembered in a table of
fixed size.  Appending bytes only adds entries; an edit
redoes the entries behind it.  Encodings are read backwards along the chain of last tokens, in time linear in the length, however
long the piece.

The text is first cut into pieces by the vocabulary's pattern, each encoded separately.  Pieces are remembered in a
table of bounded size for each Python worker.

Defined results: a null text is an empty text and has no tokens; rows are answered one by one, so repeated rows repeat and ties
don't arise; a very long text is encoded whole; an empty table gives an empty result; extra columns are ignored, whatever their names;
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillstrata.llm.common import give_back

#: Pieces that a worker remembers (some 60 MB), and places for token pairs (a power of two; 8 bytes each).
MOST_PIECES, PAIRS = 400_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte strings, lower merged first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.tokens, self.longest = ranks, {rank: token for token, rank in ranks.items()}, max(map(len, ranks))
        #: finds the tokens that end at each byte, longest first
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        #: at a pair's place: its number, and whether its second token may follow its first
        self.pairs = array("Q", bytes(8 * PAIRS))
        #: token -> the two tokens whose merge makes it; a token that its own bytes don't lead to has none
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                first, second = ranks.get(token[:i]), ranks.get(token[i:])
                if first is not None and second is not None and first < rank and second < rank and self.whole(first) and self.whole(second) and self.may_follow(first, second, rank):
                    self.halves[rank] = first, second
                    break

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        return token in self.halves or len(self.tokens[token]) == 1

    def may_follow(self, first: int, second: int, before: int | None = None) -> bool:
        """Whether the encoding of both tokens' bytes is just these two; of merges only those of ranks below `before` count, if given.

        At the border the two tokens' last merges are undone, the later one first: were the pieces that then meet at the border
        a token of lower rank than the merge that was undone, they'd have been merged instead."""
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        left, right = first, second
        limit = (1 << 60) if before is None else before
        while True:
            made = ranks.get(tokens[left] + tokens[right])
            if made is not None and made < limit:
                return False
            one, two = halves.get(left), halves.get(right)
            if one is None and two is None:
                return True
            # of two merges of one rank the left one comes first, so it is undone last
            if two is None or (one is not None and left > right):
                limit, left = left, one[1]
            else:
                limit, right = right + 1, two[0]

    def last_tokens(self, data: bytes, last: list[int], begin: int = 0) -> list[int]:
        """Extends last, which holds the last token of the prefixes of 1..begin bytes, to all of data."""
        pairs, mask = self.pairs, PAIRS - 1
        for at, (token, size) in self.automaton.iter(data.decode("latin-1"), max(0, begin - self.longest)):
            if at != begin:
                continue  # this prefix has its token
            start = at + 1 - size
            if start:
                before = last[start - 1]
                key = (before << 32 | token) << 2
                place = (before * 40503 + token * 69069) & mask
                known = pairs[place]
                if known | 1 != key | 3:
                    known = pairs[place] = key | 2 | self.may_follow(before, token)
                if not known & 1:
                    continue
            elif not self.whole(token):
                continue
            last.append(token)
            begin += 1
        if begin != len(data):
            raise ValueError("a byte has no token")
        return last

    def backwards(self, last: list[int]) -> list[int]:
        at, ids = len(last), []
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.backwards(self.last_tokens(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixState:
    """The encodings of all prefixes of one piece, kept through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last, len(self.last))

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; the prefixes up to start keep their entries."""
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start:]
        self.vocabulary.last_tokens(self.data, self.last, start)

    def ids(self, prefix: int | None = None) -> list[int]:
        return self.vocabulary.backwards(self.last if prefix is None else self.last[:prefix])


class Encoder:
    """Texts to ids by a pattern and a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        vocabulary = self.vocabulary

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = vocabulary.encode_piece(piece.encode())
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64 and len(self) < MOST_PIECES:
                    self[piece] = packed
                return packed

        self.pieces = Pieces()

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return list(self._unpack(self.packed(text)))

    def decode(self, packed: bytes) -> bytes:
        return self.vocabulary.decode(self._unpack(packed))

    @staticmethod
    def _unpack(packed: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(packed) // 4}I", packed)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker and vocabulary, kept as long as the worker lives: some 50 MB, whatever it encodes."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (binary) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed = [enc.packed(t or "") for t in part.column("text").to_pylist()]
                ids = [list(enc._unpack(p)) for p in packed]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(p) for p in packed], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded binary")


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of query op4; only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, digest = encoder(path, pattern), lambda data: hashlib.sha256(data).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed = [enc.packed(t or "") for t in batch.column("text").to_pylist()]
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([digest(p) for p in packed], pa.string()), pa.array([digest(enc.decode(p)) for p in packed], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
