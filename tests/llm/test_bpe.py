import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstrata.llm import bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


def merged(ranks, data):
    """BPE by its definition: merge the leftmost pair of least rank until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def both():
    enc = B.encoder(PATH, P.PATTERN)
    return enc, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs.encode_ordinary(text) and mine.decode(mine.packed(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeéñ漢🙂 <|>\n\t'sltoin", max_size=200))
def test_likely_text(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_pairs_and_whole_tokens_by_definition(both):
    import random

    v, rng = both[0].vocabulary, random.Random(5)
    for _ in range(20_000):
        a, b = rng.randrange(len(v.ranks)) if rng.random() < 0.5 else rng.randrange(2000), rng.randrange(2000)
        if v.whole(a) and v.whole(b):
            assert v.may_follow(a, b) == (merged(v.ranks, v.tokens[a] + v.tokens[b]) == [a, b])
    for t in rng.sample(range(len(v.ranks)), 3000):
        assert v.whole(t) == (merged(v.ranks, v.tokens[t]) == [t])


def test_long_pieces_take_linear_time(both):
    text = "x" * 30_000 + "aéb" * 5_000 + " " * 20_000
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_appends_and_edits(both):
    v = both[0].vocabulary
    fresh = lambda data: v.backwards(v.last_tokens(data, []))
    s = B.PrefixState(v, b"interna")
    s.append(b"tionalisation")
    assert s.ids() == fresh(b"internationalisation") == merged(v.ranks, b"internationalisation")
    assert all(s.ids(n) == merged(v.ranks, s.data[:n]) for n in range(len(s.data) + 1))
    s.edit(5, 9, b"XY")
    assert s.data == b"interXYonalisation" and s.ids() == fresh(s.data)
    assert len(s.last) == len(s.data)


def test_tables(frame, both):
    texts = [None, "", "Hello <|endoftext|>", "word " * 20_000]
    docs = frame([*texts, "Hello <|endoftext|>"], [0, 1, 2, 3, 2])
    got = B.report(docs, PATH, P.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        ids = both[1].encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert B.report(frame([]), PATH, P.PATTERN).count() == 0
    assert {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in B.encode_table(frame(texts[:3]), PATH, P.PATTERN).collect()}[2] == (both[1].encode_ordinary(texts[2]), texts[2].encode())
