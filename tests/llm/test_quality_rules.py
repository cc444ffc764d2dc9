import collections
import re

from quillstrata.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w = WORD.findall(t or "")
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(frame):
    texts = [None, "", " \n ", "a b", "a a a a", "a b c a b c d", "x\ny\nx\n \nx\n\n", "é漢🙂 # $$ <|>", "one two\u00a0three\x0bfour", "l\r\nl\r\n", "word " * 3000, "p q r s " * 2 + "t"]
    got = {r.doc_id: r for r in Q.report(frame(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_empty_table_and_repeated_rows(frame):
    assert Q.report(frame([])).count() == 0
    assert Q.report(frame(["a", "a"], [1, 1])).count() == 2


def test_em_learns_which_rules_to_trust():
    # the second rule votes bad whenever the first two do, the last votes at random
    bad, good = (-1, -1, -1, 0, 0, 0, 0, 1), (0, 0, 1, 0, 0, 0, 0, 1)
    prior, accuracy = Q.fit([(bad, 300), (good, 700), ((-1, 0, 1, 0, 0, 0, 0, -1), 10)])
    assert 0.6 < prior < 0.85 and accuracy[0] > 0.9 and accuracy[7] < accuracy[0]
    assert Q.fit([]) == (Q.GOOD_PRIOR, [Q.START[r] for r in Q.RULES])


def test_labelled_texts(spark):
    sf = "/root/testdata/sf0.01"
    kept = Q.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    fit = kept[~kept.base_failed]
    assert (fit.kept == (fit.quality == 1)).mean() > 0.97
