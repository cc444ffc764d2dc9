"""Queries over all of their rows, against brute force."""

import math
import re
from itertools import product

import pytest

from quillstrata.plans.catalogue import QUERIES


def test_caption_candidates_of_odd_and_even_orders(spark, tmp_path):
    lines = [(k, n, n, n, 10.0 + (k * n) % 13, 1.0, (k + 3 * n) % 9 / 100, "R" if (k + n) % 3 == 0 else "N") for k in range(1, 9) for n in range(1, 7)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    wanted = set()
    for f, c in product(lines, lines):
        x, under, over = abs(f[4] - c[4]) * 8, c[6] * 1000 - (f[6] * 1000 + 10), f[6] * 1000 - (c[6] * 1000 + 10)
        if f[0] == c[0] and f[7] == "R" != c[7] and (100 - x) / 100 >= 0.5 and (0 <= under <= 40 or 0 <= over <= 40):
            wanted.add((f[0], f[1], c[1], 0 <= under <= 40))
    found = [(r.doc_id, r.figure, r.caption, r.below) for r in QUERIES["caption_candidates"](spark, str(tmp_path)).collect()]
    assert {k % 2 for k, *_ in wanted} == {0, 1} and len(found) == len(wanted) and set(found) == wanted


def named(text):
    found = re.findall(r"\b[A-Z][A-Z0-9]*[-_][A-Z0-9]+\b", text or "")
    for run in re.findall(r"\b[A-Z][A-Za-z0-9]*(?:[ -][A-Z][A-Za-z0-9]*)*\b", text or ""):
        if run not in "What Which Who Where When Why How The A An".split() and run not in found:
            found.append(run)
    return found


def test_question_entities_of_accented_and_null_texts(spark, tmp_path):
    texts = ["Which Team owns INC-2391?", "Él vio Señal ÑA-1 y INC-2391 en León Norte", "Was macht Über Alles, Größe A-1é und Payment API?", "漢字 Tokyo Tower é", "The A", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.item_id: r.names for r in QUERIES["question_entities"](spark, str(tmp_path)).collect()}
    assert found == {i: named(x) for i, x in enumerate(texts)}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_question_entities_of_all_items(spark, size):
    items = {r.item_id: r.text for r in spark.read.parquet(f"/root/testdata/{size}/benchmark.parquet").collect()}
    found = {r.item_id: r.names for r in QUERIES["question_entities"](spark, f"/root/testdata/{size}").collect()}
    assert found == {i: named(x) for i, x in items.items()}


def test_questions_score_by_words_after_the_eighth(spark, tmp_path):
    spark.createDataFrame([(1, "a short\nlate term"), (2, "b other\nnothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "q q q q q q q q late, nothing"), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.query_id, r.gid): r.score for r in QUERIES["bm25_batch_topk"](spark, str(tmp_path)).collect()}
    texts = {"1:p1e000": "a short", "1:p1e001": "late term", "2:p1e000": "b other", "2:p1e001": "nothing"}
    idf, average = math.log(1 + 3.5 / 1.5), 7 / 4
    wanted = {(7, g): idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(x.split()) / average)) for g, x in texts.items() if "late" in x or "nothing" in x}
    assert found == pytest.approx(wanted, abs=1e-8)


def customers_and_suppliers(spark, folder, customers, suppliers):
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in customers], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return sorted((r.c_custkey, r.s_suppkey) for r in QUERIES["alias_match"](spark, str(folder)).collect())


def broadcast_rows(spark):
    """The largest number of rows that the last query broadcast."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    said = store.executionMetrics(last)
    counts = [m.accumulatorId() for n in each(store.planGraph(last).allNodes()) if n.name() == "BroadcastExchange" for m in each(n.metrics()) if m.name() == "number of output rows"]
    return max(int(said.apply(k).replace(",", "")) for k in counts if said.contains(k))


def test_alias_match_broadcasts_no_exploded_names(spark, tmp_path):
    found = customers_and_suppliers(spark, tmp_path, range(20_000), [(k, f"Supplier#{k % 1000:09d}") for k in range(3000)])
    assert found == sorted((k % 1000, k) for k in range(3000))
    assert broadcast_rows(spark) <= 2000  # 1000 names, some 1000 pieces of them


def test_alias_match_lists_every_customer_of_an_alias(spark, tmp_path):
    keys = [7, *range(10_000_000_000, 10_000_000_012)]  # beyond nine digits lpad cuts, in SQL as well
    assert customers_and_suppliers(spark, tmp_path, keys, [(1, "Supplier#100000000"), (2, "Supplier#000000008"), (3, None)]) == [(k, 1) for k in keys[1:]]
