import collections
import hashlib
import random

import pytest

from quillstrata.llm import packed
from quillstrata.llm import substring as S


def flags(texts, depth):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + depth]) for w in words for i in range(len(w) - depth + 1))
    out = []
    for w in words:
        f = [False] * len(w)
        for i in range(len(w) - depth + 1):
            if seen[tuple(w[i : i + depth])] > 1:
                f[i : i + depth] = [True] * depth
        out.append((w, f))
    return out


def sample():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passage = [word() for _ in range(60)]
    texts = [None, "", "a b", " ".join(passage), " ".join(passage[:34]), " ".join(passage[:35]), "loop " * 40, "é 漢 " * 30, "A\u00a0b " * 50]
    for _ in range(30):
        own = [word() + str(rng.randrange(1000)) for _ in range(rng.randint(0, 120))]
        cut = rng.randint(0, len(own))
        texts.append(" ".join(own[:cut] + passage[rng.randint(0, 20) : rng.randint(30, 60)] + own[cut:]))
    return [*texts, texts[12]]


@pytest.mark.parametrize("depth", [35, 5, 1])
def test_equals_brute_force(frame, depth):
    texts = sample()
    want = flags(texts, depth)
    got = {r.doc_id: r for r in S.report(frame(texts), depth).collect()}
    for i, (w, f) in enumerate(want):
        kept = b" ".join(x for x, gone in zip(w, f, strict=True) if not gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(f), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("group, growth", [(2, 2), (1, 1000), (3, 1)])
def test_large_prefixes_are_lengthened(frame, monkeypatch, group, growth):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "GROWTH", growth)
    texts = sample()
    n = [sum(f) for _, f in flags(texts, 35)]
    assert [r.n_removed for r in S.report(frame(texts)).orderBy("doc_id").collect()] == n


def test_spans_texts_and_repeated_rows(frame):
    p = " ".join(f"w{i}" for i in range(40))
    docs = frame([f"x y {p} z", f"{p} q", "r", "r"], [1, 2, 3, 3]).selectExpr("*", "1 AS bundle", "2 AS source", "3 AS g")
    assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in S.spans(docs).collect()} == {1: [(2, 42)], 2: [(0, 40)], 3: []}
    assert {r.doc_id: r.text for r in S.remove(docs).collect()} == {1: "x y z", 2: "q", 3: "r"}
    twice = S.report(frame([p, p], [4, 4])).collect()
    assert [r.n_removed for r in twice] == [40, 40]
    assert S.report(frame([])).count() == 0


def test_subtree_depths_equal_brute_force():
    """Deepest internal node above each suffix: the longest prefix that it shares with another, to the third below the prefix."""
    import numpy as np

    rng, first, depth = random.Random(3), 8, 35
    base = [rng.choice("ab") for _ in range(40)]
    texts = []
    for _ in range(60):
        w = list(base[:35])
        cut = rng.randint(0, 35)
        texts.append(w[:cut] + [rng.choice("cdefghij") + str(rng.randrange(50)) for _ in range(35 - cut)])
    words = packed.word_hashes([x.encode() for t in texts for x in t])
    win, starts = packed.Windows(words), np.arange(len(texts)) * 35
    labels, more = win.at(starts, first) >> np.uint64(16), S.paths(win, starts, first, depth)
    place, fps, paths, leaves = S._leaves(labels, more)
    got = S.subtree_depths(fps, paths, leaves, first, depth)[place].tolist()
    steps = [0, first, *S.step_depths(first, depth), depth]
    for t, d in zip(texts, got, strict=True):
        i = texts.index(t)
        shared = max(next((k for k in range(35) if t[k] != u[k]), 35) for j, u in enumerate(texts) if j != i)
        assert d == max(s for s in steps if s <= shared)


def test_exchange_has_levels(spark, frame, monkeypatch):
    """Many bundles and a small fan: sums and depths are the same, and rows sent grow in proportion to the bundles."""
    monkeypatch.setattr(packed, "FAN", 4)
    texts = sample()
    want = {i: sum(f) for i, (_, f) in enumerate(flags(texts, 35))}
    for least in (5, 33):
        monkeypatch.setattr(packed, "LEAST_BUNDLES", least)
        assert {r.doc_id: r.n_removed for r in S.report(frame(texts)).collect()} == want
    sent = {}
    for n in (16, 64, 256):
        import numpy as np

        fps = np.sort(np.random.default_rng(0).integers(0, 2**48, 3000).astype(np.uint64))
        sent[n] = packed.send(0, fps, np.ones(len(fps), np.uint64), n, 48).num_rows * n
    assert sent[256] == 4 * sent[64] == 16 * sent[16]


def test_packing():
    import numpy as np

    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))):
        assert (packed.expand_sorted(packed.squeeze_sorted(a)) == a).all()
    h = rng.integers(0, 2**64, 50, dtype=np.uint64)
    w = packed.Windows(np.concatenate([h, h[10:30]]))
    assert (w.at(np.arange(50, 63), 8) == w.at(np.arange(10, 23), 8)).all() and len(set(w.at(np.arange(43), 8).tolist())) == 43
    assert w.at(np.array([0]), 3) != w.at(np.array([0]), 4)
