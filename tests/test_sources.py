import io
import json
import time
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from quillstrata.operators import graph as G
from quillstrata.operators import ingest, knowledge
from quillstrata.sources import decode as D
from quillstrata.sources import detect, files
from quillstrata.streaming import ingest as ST


def pdf(content: bytes, pages: int = 1) -> bytes:
    z = zlib.compress(content)
    kids = " ".join(f"{4 + i} 0 R" for i in range(pages))
    objs = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {pages}/MediaBox[0 0 612 792]/Resources<</Font<</F1 {4 + pages} 0 R/F2 {5 + pages} 0 R>>>>>>".encode(), f"<</Length {len(z)}/Filter/FlateDecode>>\nstream\n".encode() + z + b"\nendstream"]
    objs += [b"<</Type/Page/Parent 2 0 R/Contents 3 0 R>>"] * pages + [b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold>>"]
    return b"%PDF-1.4\n" + b"".join(f"{i} 0 obj\n".encode() + o + b"\nendobj\n" for i, o in enumerate(objs, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"


def xlsx() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Services" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Inventory</t></si><si><t>Name</t></si><si><r><t>Own</t></r><r><t>er</t></r></si></sst>")
        cell = lambda r, t, v: f'<c r="{r}" t="{t}"><v>{v}</v></c>'
        rows = [cell("A1", "s", 0), cell("A2", "s", 1) + cell("B2", "s", 2), cell("A3", "str", "Redis") + '<c r="B3"><v>2.0</v></c>', '<c r="B4"><f>SUM(B3:B3)</f></c>']
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData><mergeCells><mergeCell ref=\"A1:B1\"/></mergeCells></worksheet>")
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\xe0\0\0\1,\x08\2\0\0\0"
TEXT = b"BT /F2 18 Tf 72 700 Td (Title \\(one\\)) Tj ET BT /F1 11 Tf 72 660 Td 13 TL (First line of body text here) Tj T* (second line goes on) Tj ET"


def test_markdown():
    d = D.decode("a.md", b"pre\n\n# Top\n\n- a\n  - b\n\n## Sub\n\n| x | y |\n|---|:-:|\n| 1 |\n\n```py\nz\n```\n<div>\nskip\n</div>\n\n---\n> q\n\nSet\n===\n")
    assert d["error"] is None and d["title"] == "Top"
    assert [(e["type"], e["text"], e["level"], e["parent_id"]) for e in d["elements"]] == [
        ("paragraph", "pre", None, None), ("heading", "Top", 1, None), ("list_item", "a", None, "p1e001"), ("list_item", "b", None, "p1e001"), ("heading", "Sub", 2, "p1e001"),
        ("table", None, None, "p1e004"), ("code", "z\n", None, "p1e004"), ("paragraph", "q", None, "p1e004"), ("heading", "Set", 1, None),
    ]
    assert d["elements"][5]["table"] == {"headers": ["x", "y"], "rows": [["1", ""]], "n_rows": 1, "n_cols": 2}
    assert d["elements"][0]["bbox"] == {"x0": 72.0, "y0": 72.0, "x1": 540.0, "y1": 86.0}
    assert "UTF-8" in D.decode("a.md", b"\xff\xfe")["error"]


def test_workbook():
    d = D.decode("inventory.xlsx", xlsx())
    table = d["elements"][1]
    assert d["error"] is None and d["title"] == "inventory" and d["elements"][0]["text"] == "Services"
    assert table["table"] == {"headers": ["Name", "Owner"], "rows": [["Redis", "2"]], "n_rows": 1, "n_cols": 2}
    assert table["attrs"]["table_title"] == "Inventory" and json.loads(table["attrs"]["formulas"]) == {"B4": "=SUM(B3:B3)"}
    assert D.decode("x.xlsx", b"PK\x03\x04nope")["error"]


def test_images_and_errors():
    d = D.decode("d.png", PNG)
    assert (d["elements"][0]["image"]["width"], d["elements"][0]["image"]["height"], d["blobs"][0]["ref"]) == (480, 300, "p1_i000.png")
    jpg = D.decode("d", b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x10\0\x20\x03")
    assert (jpg["mime"], jpg["elements"][0]["image"]["width"]) == ("image/jpeg", 32)
    assert D.decode("x.bin", b"1")["error"].startswith("no decoder") and D.decode("x.pdf", b"%PDF-1.4 nothing")["error"]


def test_pdf_text_and_tables():
    rules = b" q 72 500 m 300 500 l 72 520 m 300 520 l 72 540 m 300 540 l 72 500 m 72 540 l 180 500 m 180 540 l 300 500 m 300 540 l S Q BT /F1 10 Tf 76 526 Td (Name) Tj ET BT /F1 10 Tf 190 526 Td (Team) Tj ET BT /F1 10 Tf 76 506 Td (Redis) Tj ET BT /F1 10 Tf 190 506 Td [(Co) -20 (re)] TJ ET"
    d = D.decode("a.pdf", pdf(TEXT + rules))
    assert d["error"] is None and d["title"] == "Title (one)"
    assert [(e["type"], e["text"]) for e in d["elements"]] == [("heading", "Title (one)"), ("paragraph", "First line of body text here\nsecond line goes on"), ("table", None)]
    assert d["elements"][2]["table"]["headers"] == ["Name", "Team"] and d["elements"][2]["table"]["rows"] == [["Redis", "Core"]]
    assert len(D.decode("b.pdf", pdf(TEXT, 3))["pages"]) == 3


def test_detection(spark):
    rows = spark.createDataFrame([("a.MD", bytearray(b"x")), ("dir.x/noext", bytearray(b"%PDF-1")), ("b.txt", bytearray(PNG)), ("c.txt", bytearray(b"x")), (".hidden", bytearray(b"PK\x03\x04"))], "n string, c binary")
    assert [r.k for r in rows.select(detect.detect(F.col("n"), F.col("c")).alias("k")).collect()] == [".md", ".pdf", ".png", ".txt", ".xlsx"]
    assert [detect.detect_plain(r.n, bytes(r.c)) for r in rows.collect()] == [".md", ".pdf", ".png", ".txt", ".xlsx"]


MD = b"# Ops\n\nPayment API (Service) and Redis (Database).\n\nPayment API depends on Redis.\n"


def test_batches_isolate_failures_and_repeat_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.md", MD), ("b/copy.md", MD), ("broken.pdf", b"%PDF-1.4"), ("d.png", PNG), ("skip.txt", b"x")):
        p = tmp_path / "in" / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    rows = files.files(spark, str(tmp_path / "in"))
    assert rows.count() == 4
    store, store_graph = files.DocumentStore(spark, str(tmp_path / "store")), G.GraphStore(spark, str(tmp_path / "graph"))
    review = ingest.ingest_batch(rows, store, store_graph, knowledge.rule_extractor, 0, commit=False)
    assert review.count() == 4 and store.read("documents") is None
    for batch in (0, 1):
        done = ingest.ingest_batch(rows, store, store_graph, knowledge.rule_extractor, batch)
        got = {r.name: r for r in done.collect()}
        assert (got["broken.pdf"].stage, got["d.png"].stage, got["a.md"].n_facts, got["a.md"].n_entities) == ("failed", "done", 1, 2)
        assert (store.read("documents").count(), store.read("blobs").count(), store_graph.facts().count(), store_graph.entities().count()) == (2, 1, 1, 2)
    assert ingest.totals(done).first().n_facts == 2  # both copies count
    fact = store_graph.facts().first()
    assert (fact.source_key, fact.relation, fact.target_key, fact.confidence, list(fact.element_ids)) == ("service|payment api", "DEPENDS_ON", "database|redis", "high", ["p1e002"])
    doc = store.ids().first().doc_id
    assert store.exists(doc) and not store.exists("0" * 16) and store.get(doc)["documents"].count() == 1
    assert store.report().agg(F.sum("n_elements")).first()[0] == 4
    text = store.read("elements").orderBy("doc_id", "order").select(files.canonical_json(F.struct("order", "text", "level")).alias("j")).first().j
    assert text.startswith('{\n  "level"') and text.endswith("}\n")


def test_the_model_is_asked_once_for_each_chunk(spark, tmp_path):
    told = tmp_path / "calls"

    def extractor(text, heading):
        with open(told, "a") as f:
            f.write("call\n")
        return {"entities": [{"name": f"Service {time.time_ns()}", "type": "Service", "aliases": []}], "facts": []}  # never the same answer twice

    rows = files.uploaded(spark, [("a.md", b"# One\n\ntext\n"), ("b.md", b"# Two\n\nother text\n")])
    store, store_graph = files.DocumentStore(spark, str(tmp_path / "store")), G.GraphStore(spark, str(tmp_path / "graph"))
    done = ingest.ingest_batch(rows, store, store_graph, extractor, 0)
    assert sorted((r.name, r.stage, r.chunks_done, r.n_entities) for r in done.collect()) == [("a.md", "done", 1, 1), ("b.md", "done", 1, 1)]
    assert store_graph.entities().count() == 2 and len(told.read_text().splitlines()) == 2


def test_file_stream_takes_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.md", "b.md", "c.md"):
        (tmp_path / "in" / name).write_bytes(MD)
    seen = []
    run = lambda: ST.ingest_stream(ST.new_contents(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert run() and sum(seen) == 1
    (tmp_path / "in" / "d.md").write_bytes(b"# other\n")
    assert run() and sum(seen) == 2


def test_conversation_stream(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, question string, answer string, names array<string>"
    write = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) or n

    def run():
        out = ST.conversation_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)

    write([(1, i, f"q{i}", f"a{i}", [f"n{i}", "x", "y", "z"]) for i in range(6)], 0)
    run()
    write([(1, 6, "q6", "a6", []), (2, 0, "p0", "b0", ["k"])], 1)
    run()
    got = {(r.conv_id, r.n): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 8 and [h.question for h in got[1, 7].history] == ["q2", "q3", "q4", "q5"]
    assert list(got[1, 7].carried) == ["n5", "x", "y"] and list(got[2, 1].carried) == []


def test_uploaded_keeps_its_name(spark):
    d = files.decode_all(files.uploaded(spark, [("up/inventory.xlsx", xlsx())]))
    assert files.documents(d).first().title == "inventory"
    assert isinstance(d.select("doc_id").toPandas(), pd.DataFrame)
