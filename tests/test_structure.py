import random

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import layout as L
from quillstrata.operators import structure as S
from quillstrata.schemas import ELEMENTS


def element(doc, order, kind, level=None, text=None, page=1):
    return (doc, f"p{page}e{order:03d}", order, page, kind, level, None, (0.0, 0.0, 1.0, 1.0), text, None, None, {})


def test_parents_equal_a_stack(spark):
    rng, rows, want = random.Random(3), [], {}
    for d in range(30):
        stack = []
        for o in range(rng.randint(1, 25)):
            level = rng.choice([None, None, 1, 2, 3, 4])
            e = f"p1e{o:03d}"
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
            want[str(d), e] = stack[-1][1] if stack else None
            if level:
                stack.append((level, e))
            rows.append(element(str(d), o, "heading" if level else "paragraph", level, "x"))
    got = {(r.doc_id, r.element_id): r.parent_id for r in S.assign_parents(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert got == want


def test_chunks_pack_greedily_and_never_split(spark):
    rows = [element("d", 0, "heading", 1, "H"), element("d", 1, "paragraph", None, "a" * 600), element("d", 2, "paragraph", None, " " + "b" * 600), element("d", 3, "paragraph", None, "c" * 600), element("d", 4, "paragraph", None, "d" * 2000), element("d", 5, "footer", None, "f"), element("d", 6, "heading", 2, "K"), element("d", 7, "paragraph", None, "e"), element("d", 8, "paragraph", None, "  ")]
    got = S.chunks(spark.createDataFrame(rows, ELEMENTS)).orderBy("chunk_seq").collect()
    assert [(r.chunk_id, r.heading, [e[-1] for e in r.element_ids]) for r in got] == [("d:c000", "H", ["1", "2"]), ("d:c001", "H", ["3"]), ("d:c002", "H", ["4"]), ("d:c003", "K", ["7"])]
    assert got[0].text == "a" * 600 + "\n\n" + "b" * 600


def block(i, page, x0, y0, x1, y1, text="body text of a paragraph", size=11.0, bold=False, lines=1, kind="text"):
    return ("d", i, page, (float(x0), float(y0), float(x1), float(y1)), text if kind == "text" else "", size if kind == "text" else 0.0, bold, lines, kind, None, (None, 1, 1, "png", None) if kind == "image" else None)


@pytest.fixture(scope="module")
def laid_out(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [block(10 * p, p, 72, 20, 300, 30, f"Annual report {p}", 9.0), block(10 * p + 1, p, 290, 770, 310, 780, str(p), 9.0)]
        rows += [block(10 * p + 2 + k, p, 72 if k < 2 else 340, 200 + 100 * (k % 2), 280 if k < 2 else 540, 280 + 100 * (k % 2)) for k in range(4)]
    rows += [block(1, 1, 72, 100, 400, 130, "Title", 18.0), block(2, 1, 72, 150, 200, 162, "Part", 11.0, True)]
    rows += [block(40, 4, 100, 100, 300, 300, kind="image"), block(41, 4, 110, 310, 290, 320, "Figure 1: a", 9.0), block(42, 4, 110, 85, 290, 95, "small", 8.0)]
    blocks = spark.createDataFrame(rows, L.BLOCKS)
    pages = spark.createDataFrame([("d", n, 612.0, 792.0) for n in (1, 2, 3, 4)], "doc_id string, number int, width double, height double")
    return {(r.page_number, r.text): r for r in L.elements(blocks, pages).collect()}, rows


def test_layout(laid_out):
    got, _ = laid_out
    assert got[1, "Annual report 1"].type == "header" and got[2, "2"].type == "page_number"
    assert (got[1, "Title"].type, got[1, "Title"].level) == ("heading", 1)
    assert (got[1, "Part"].type, got[1, "Part"].level, got[1, "Part"].parent_id) == ("heading", 2, got[1, "Title"].element_id)
    image, caption = got[4, None], got[4, "Figure 1: a"]
    assert caption.type == "caption" and image.image.caption_id == caption.element_id and caption.attrs["captions"] == image.element_id
    assert got[4, "small"].type == "paragraph"


def test_plain_layout_agrees(laid_out):
    from quillstrata.sources.decode import Box, set_parents

    got, rows = laid_out
    plain = [dict(zip(("doc_id", "index", "page", "bbox", "text", "max_size", "is_bold", "line_count", "kind", "table", "image"), r, strict=True)) for r in rows]
    for b in plain:
        b["bbox"] = Box(*b["bbox"])
        b["image"] = None
    elements = L.plain_elements(plain, [(n, 612.0, 792.0) for n in (1, 2, 3, 4)])
    set_parents(elements)
    mine = {(e.page_number, e.text, e.order): (e.type, e.level, e.element_id, e.parent_id) for e in elements}
    want = {(p, t, r.order): (r.type, r.level, r.element_id, r.parent_id) for (p, t), r in got.items()}
    assert {k: mine[k] for k in want} == want


def test_gutters():
    two = [(72, 100 + 50 * i, 280, 140 + 50 * i) for i in range(3)] + [(320, 100 + 50 * i, 540, 140 + 50 * i) for i in range(3)]
    assert L.gutters_of(two) == [300.0]
    assert L.gutters_of(two[:3]) == [] and L.gutters_of([*two[:3], (320, 100, 540, 140)]) == []


def test_claims_take_each_caption_once():
    pairs = [(1, 100.0, 1, True, True, 5.0, 7), (1, 200.0, 2, False, True, 5.0, 7), (1, 200.0, 2, False, False, 1.0, 8)]
    assert L.claim_captions(pairs) == {1: 7, 2: 8}


def test_gap_and_mask(spark):
    b = spark.createDataFrame([block(1, 1, 0, 0, 10, 10), block(2, 1, 0, 15.5, 10, 20), block(3, 1, 0, 18, 10, 30)], L.BLOCKS)
    assert [r.gap_below for r in L.gaps(b).orderBy("index").collect()] == [5.5, 0.0, 0.0]
    region = spark.createDataFrame([("d", 1, (0.0, 14.0, 20.0, 21.0))], "doc_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r["index"] for r in L.mask_tables(b, region).select(F.col("index")).orderBy("index").collect()] == [1, 3]
