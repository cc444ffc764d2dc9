import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstrata.functions import ids
from quillstrata.functions import tables as TB
from quillstrata.functions import text as T


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


def test_tokens_keep_compounds_whole_and_in_parts(spark):
    assert one(spark, "Incident INC-2391 happened", T.tokens) == ["incident", "inc-2391", "inc", "2391", "happened"]
    assert one(spark, "code PAYMENT_502 raised.", T.tokens) == ["code", "payment_502", "payment", "502", "raised"]
    assert one(spark, None, T.tokens) == []


def test_names(spark):
    assert one(spark, "  Payment-API (v2) ", T.normal_name) == "payment api v2"
    assert one(spark, "Révolut", T.normal_name) == "r volut"
    assert one(spark, " 漢字!", T.normal_name) == ""
    assert one(spark, "漢字", lambda c: T.entity_key(c, F.lit("Team"))) is None


def test_page_numbers_and_captions(spark):
    rows = spark.createDataFrame([("3",), (" Page 3 of 12 ",), ("xiv",), ("civic",), ("page",), ("3a",)], "x string").select(T.is_page_number(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == [True, True, True, True, False, False]
    rows = spark.createDataFrame([("Figure 1: x",), ("fig. 2",), ("Table3",), ("A figure 1",)], "x string").select(T.is_caption(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == [True, True, True, False]


def test_citations_and_questions(spark):
    assert one(spark, "a [d:p1e002] b [d:p1e002] [x.y:p10e1000] [no]", T.citations) == ["d:p1e002", "x.y:p10e1000"]
    assert one(spark, "Which Team owns INC-2391 and Payment API?", T.question_names) == ["INC-2391", "Which Team", "INC", "Payment API"]


def test_ids(spark):
    row = spark.sql("select cast('abc' as binary) c").select(ids.document_id(F.col("c")).alias("d"), ids.element_id(F.lit(2), F.lit(1234)).alias("e"), ids.blob_ref(F.lit(1), F.lit(0), F.lit("png")).alias("b"), ids.safe_blob_ref(F.lit("../x")).alias("s")).first()
    assert row.d == "ba7816bf8f01cfea" and row.e == "p2e1234" and row.b == "p1_i000.png" and not row.s


def test_table_cleaning(spark):
    t = spark.sql("select array(array(' a ', 'b'), array(null, ''), array('1')) r").select(TB.table_of(F.col("r")).alias("t"), TB.table_text(TB.table_of(F.col("r"))).alias("s")).first()
    assert (t.t.headers, t.t.rows, t.t.n_rows, t.t.n_cols, t.s) == (["a", "b"], [["1", ""]], 1, 2, "a | b\n1 | ")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=8))
def test_squash_is_pythons_split(spark, texts):
    got = [r.y for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.squash(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [" ".join(t.split()) for t in texts]
    assert [re.sub(r"\s+", " ", t).strip() for t in texts] == got
