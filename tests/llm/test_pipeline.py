import hashlib
import struct

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_on_what_the_one_before_kept(spark):
    assert [n for n, _ in C.STAGES] == ["language", "near_copies", "contamination", "secrets", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:4]:
        docs = C.spool(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == C.COLUMNS
        rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(rows) == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near_copies":
            ids = sorted(before)
            assert set(rows) == {d for d, _, c in components([before[i] for i in ids], ids) if d == c}
        elif name == "contamination":
            assert set(rows) == {i for i, t in before.items() if not contaminated(t, bench)[3]}
        else:
            assert set(rows) == set(before)
        before = rows
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=C.bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in C.STAGES[4][1](spark, docs, SF).collect():
        ids = enc.encode_ordinary(before[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_run(spark):
    assert C.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_rows(spark, frame):
    docs = frame([None, "", "  ", "un texte the and with " * 10, "un texte the and with " * 10], [1, 2, 3, 4, 4]).select(*C.COLUMNS)
    for name, stage in C.STAGES:
        docs = C.spool(stage(spark, docs, SF), name)
    assert {r.doc_id for r in docs.collect()} <= {4}
    empty = frame([]).select(*C.COLUMNS)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
