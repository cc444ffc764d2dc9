import random

from pyspark.sql import functions as F

from quillstrata.operators import structure as S
from quillstrata.operators import views as V
from quillstrata.schemas import ELEMENTS
from quillstrata.sources import files
from test_structure import element


def test_depth_equals_a_stack(spark):
    rng, rows, want = random.Random(5), [], {}
    for d in range(30):
        stack, seq = [], 0
        for o in range(rng.randint(1, 25)):
            level = rng.choice([None, None, 1, 2, 3, 4, 6])
            rows.append(element(f"d{d}", o, "heading" if level else "paragraph", level, "x"))
            if level:
                while stack and stack[-1] >= level:
                    stack.pop()
                seq += 1
                want[f"d{d}", seq] = len(stack)
                stack.append(level)
            elif not seq:
                want[f"d{d}", 0] = 0
    found = S.section_outline(spark.createDataFrame(rows, ELEMENTS)).collect()
    assert {(r.doc_id, r.section_seq): r.depth for r in found} == want


def test_views_of_elements(spark):
    table = (["a", "b"], [["1", "2"]], 1, 2)
    one = lambda order, kind, t, attrs: ("d", f"p1e{order:03d}", order, 1, kind, None, None, (1.0, 2.0, 4.0, 7.0), None if t else "text", t, None, attrs)
    rows = [one(0, "table", table, {"sheet": "S"}), one(1, "table", table, {"table_title": "T", "sheet": "S", "formulas": "{}"}), one(2, "paragraph", None, {}), one(3, "table", table, {"table_title": ""})]
    e = spark.createDataFrame(rows, ELEMENTS)
    assert [(r.order, r.title, r.formulas, r.headers) for r in V.table_listing(e).orderBy("order").collect()] == [(0, "S", None, ["a", "b"]), (1, "T", "{}", ["a", "b"]), (3, None, None, ["a", "b"])]
    assert [r.order for r in V.element_table(e, ["paragraph"]).collect()] == [2]
    assert V.visible(e).count() == 4 and V.visible(e, []).count() == 0 and V.table_listing(e.filter("false")).isEmpty()
    assert {(r.gid, r.width, r.height, r.text) for r in V.inspected(e).filter("order > 1").collect()} == {("d:p1e002", 3.0, 5.0, "text"), ("d:p1e003", 3.0, 5.0, "a | b\n1 | 2")}
    told = spark.createDataFrame([("d", "p1e002", "c", "x"), ("d", None, "parse_failed", "y")], "doc_id string, element_id string, code string, detail string")
    assert {(r.code, r.order) for r in V.warning_table(told, e).collect()} == {("c", 2), ("parse_failed", None)}


def test_synthetic_geometry(spark):
    metas = spark.createDataFrame([({"parser": "markdown"},), ({"parser": "spreadsheet"},), ({"parser": "pdf"},), ({},), (None,)], "meta map<string,string>")
    assert [r[0] for r in metas.select(V.is_synthetic(F.col("meta"))).collect()] == [True, True, False, False, False]


def test_samples_are_files_that_a_decoder_takes(spark, tmp_path):
    for folder, name in (("a", "x.md"), ("a", "x.txt"), ("b", "y.PDF")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"1234")
    found = files.samples(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert {(r.name, r.length) for r in found.collect()} == {("x.md", 4), ("y.PDF", 4)}
