from quillstrata.llm import jaccard_join as J

LONG = "a b c d e f g h i j k l m n o p q r s t u v w x y z"


def test_rows_of_null_or_shared_ids_fall_alone(frame):
    rows = [
        (None, LONG), (1, LONG), (None, "a clean text of its own"), (None, None), (None, " "), (None, None),
        (5, LONG + " 1"), (5, "another clean text"),
        (None, "no id has this one"), (None, "no id has this one"), (None, LONG.upper() + " 0 1 2 3 4 5 6 7"), (None, LONG + " 0 1 2 3 4 5 6 7"),
        (7, "said twice by seven"), (7, "said twice by seven"), (9, "SAID twice by seven"),
    ]
    docs = frame([t for _, t in rows], [i for i, _ in rows])
    kept = J.keep_one(docs)
    found = sorted(((r.doc_id, r.text and r.text.lower()) for r in kept.collect()), key=repr)
    clean = [(1, LONG), (None, "a clean text of its own"), (None, None), (None, None), (None, " "), (5, "another clean text"), (None, "no id has this one"), (7, "said twice by seven")]
    assert kept.columns == docs.columns
    assert found == sorted([*clean, (None, LONG + " 0 1 2 3 4 5 6 7")], key=repr)


def test_a_group_without_ids_keeps_one_text(frame):
    docs = frame([LONG, LONG.upper(), LONG + " 1", "far from all of them"], [None] * 4)
    found = sorted(r.text.lower()[:3] for r in J.keep_one(docs).collect())
    assert found == ["a b", "far"]
