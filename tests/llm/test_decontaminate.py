import re

from quillstrata.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(text, items):
    words, hit, found = WORD.findall(lower(text or "")), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(13, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if wins else ():
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_equals_brute_force(spark, frame):
    long = " ".join(f"w{i % 17}x{i % 5}" for i in range(40))
    items = [(1, long), (2, "short one"), (2, "other text"), (3, None), (4, "!!"), (5, "É été"), (1, long)]
    texts = [None, "", "nothing", long.upper(), "a " * 300 + " ".join(long.split()[3:17]), "x SHORT, one y short-one", "été", "É ÉTÉ É été", "zero " + long + " " + long, long.replace("w3x3", "q"), "other text", "w0x0 " * 50, "word " * 5000 + "short one"]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, pos int")
    docs = frame([*texts, texts[3]], [*range(len(texts)), 3])
    got = D.contamination(docs, bench).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) == brute(texts[r.doc_id], items), texts[r.doc_id]
    kept = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute(t, items)[3]} and D.clean(docs, bench).columns == docs.columns


def test_rows_that_share_an_id(spark, frame):
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    got = sorted((r.doc_id is None, r.n_hit) for r in D.report(frame(["one two", "two one", "one two three"], [5, 5, None]), bench).collect())
    assert got == [(False, 0), (False, 2), (True, 2)]


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.report(frame([]), bench).count() == 0
    assert [r.contaminated for r in D.report(frame(["a b"]), bench).collect()] == [False]


def test_proximity(spark, frame):
    index = D.PositionalIndex.build(frame(["a x x b a", "b", None, "a " + "x " * 9 + "b"]))
    assert sorted((r.doc_id, r.a, r.b) for r in index.near("a", "b", 3).collect()) == [(0, 0, 3), (0, 4, 3)]
