import random

from pyspark.sql import functions as F

from quillstrata.operators import answering as A
from quillstrata.operators import graph as G
from quillstrata.operators import knowledge as K
from quillstrata.operators import search as S
from quillstrata.schemas import CHUNKS


def chunk(i, text, ids=("p1e001",)):
    return (f"d:c{i:03d}", "d", i, 1, None, text, list(ids))


def elements(spark, texts):
    from quillstrata.schemas import ELEMENTS

    return spark.createDataFrame([("d", f"p1e{i:03d}", i, 1, "paragraph", None, None, (0.0, 0.0, 1.0, 1.0), t, None, None, {}) for i, t in enumerate(texts)], ELEMENTS)


def test_extract_resolve_bind(spark):
    texts = ["Payment API (Service) depends on", "x", "Redis (Database)  and Payment API   depends on Redis.", "bad"]
    chunks = spark.createDataFrame([chunk(0, texts[2], ["p1e000", "p1e002"]), chunk(1, "bad"), chunk(2, " ")], CHUNKS)

    def model(text, heading):
        if text == "bad":
            raise ValueError("no")
        return {
            "entities": [{"name": "Payment API", "type": "Service", "aliases": ["PAY"]}, {"name": "payment-api", "type": "Service", "aliases": []}, {"name": "Redis", "type": "Database", "aliases": []}, {"name": "漢", "type": "Team", "aliases": []}],
            "facts": [
                {"source": "PAY", "relation": " depends_on ", "target": "Redis", "evidence": "Payment API depends on REDIS"}, {"source": "Redis", "relation": "OWNS", "target": "Nobody", "evidence": "q"},
                {"source": "Payment API", "relation": "USES", "target": "payment api", "evidence": "q"}, {"source": "Redis", "relation": "EATS", "target": "PAY", "evidence": "q"}, {"source": "Redis", "relation": "USES", "target": "PAY", "evidence": "not there"},
            ],
        }

    extracted = K.extract(chunks, model)
    resolved = K.resolve(K.candidates(extracted))
    facts, warnings = K.bind(extracted, resolved, elements(spark, texts))
    got = {(r.source_key, r.relation, r.target_key): (list(r.element_ids), r.confidence) for r in facts.collect()}
    assert got == {("service|payment api", "DEPENDS_ON", "database|redis"): (["p1e002"], "high"), ("database|redis", "USES", "service|payment api"): (["p1e000", "p1e002"], "low")}
    assert sorted((r.code, r.detail) for r in warnings.collect()) == [("chunk_failed", "ValueError: no"), ("empty_entity_key", "漢"), ("self_reference", "payment api"), ("unknown_entity", "Nobody"), ("unknown_relation", "EATS")]


def reference_fold(rows, judge):
    known, out = {}, []
    for name, aliases in rows:
        normal = name.lower()
        key = f"team|{normal}"
        hit = key if key in known else next((k for k, v in known.items() if normal in v[1]), None)
        if hit is None and judge:
            near = [k for k, v in known.items() if normal in v[0] or v[0] in normal]
            hit = judge(name, near)
        if hit is None:
            known[key] = (normal, set(aliases) - {normal})
            hit = key
        else:
            known[hit][1].update(set(aliases) | {normal})
            known[hit][1].discard(known[hit][0])
        out.append(hit)
    return out


def test_resolution_equals_a_plain_registry():
    rng = random.Random(5)
    for judged in (False, True):
        for _ in range(200):
            rows = [(rng.choice("a b ab abc c bc".split()), rng.sample("a b ab abc c bc d".split(), rng.randint(0, 2))) for _ in range(12)]
            mine = K.resolve_fold([(i, n, n, f"team|{n}", a) for i, (n, a) in enumerate(rows)], [], (lambda n, t, near: sorted(k for k, _ in near)[0] if len(n) > 1 else None) if judged else None)
            theirs = reference_fold(rows, (lambda n, near: sorted(near)[0] if near and len(n) > 1 else None) if judged else None)
            assert [k for _, k, _ in mine] == theirs


def test_merges(spark):
    log = spark.createDataFrame([(2, "t|x", "X2", "T", ["b", "X"]), (1, "t|x", "X", "T", ["A!", ""]), (3, "t|y", "Y", "T", [])], "seq int, key string, name string, type string, aliases array<string>")
    assert {r.key: (r.name, list(r.aliases)) for r in K.merge_entities(log).collect()} == {"t|x": ("X", ["a", "b", "x2"]), "t|y": ("Y", [])}
    facts = spark.createDataFrame([(1, "a", "R", "b", "d", ["e2", "e1"], "first", "low"), (2, "a", "R", "b", "d", ["e1", "e3"], "second", "high")], "seq int, source_key string, relation string, target_key string, doc_id string, element_ids array<string>, evidence string, confidence string")
    r = K.merge_facts(facts).first()
    assert (list(r.element_ids), r.evidence, r.confidence) == (["e2", "e1", "e3"], "first", "low")


def test_traversal_equals_breadth_first_search(spark):
    rng = random.Random(9)
    edges = [(i, f"k{rng.randrange(15)}", "R", f"k{rng.randrange(15)}", "d", [f"p1e{i:03d}"]) for i in range(30)]
    facts = spark.createDataFrame(edges, "seq int, source_key string, relation string, target_key string, doc_id string, element_ids array<string>")
    entities = spark.createDataFrame([(f"k{i}",) for i in range(15)], "key string")
    seeds = spark.createDataFrame([(q, f"k{q}") for q in range(15)] + [(1, "nowhere")], "query_id int, key string")
    for hops, limit in ((1, 200), (2, 5), (3, 200), (9, 200)):
        got = {}
        for r in G.traverse(facts, entities, seeds, hops, limit).collect():
            got.setdefault(r.query_id, {})[r.seq] = r.hop
        for q in range(15):
            frontier, seen, want = {f"k{q}"}, {f"k{q}"}, {}
            for hop in range(1, min(hops, 3) + 1):
                nxt = set()
                for e in edges:
                    if frontier & {e[1], e[3]}:
                        want.setdefault(e[0], hop)
                        nxt |= {e[1], e[3]}
                frontier = nxt - seen
                seen |= nxt
            want = dict(sorted(want.items(), key=lambda x: (x[1], x[0]))[:limit])
            assert got.get(q, {}) == want


def test_store_is_idempotent(spark, tmp_path):
    store = G.GraphStore(spark, str(tmp_path / "graph"))
    assert store.entities() is None
    docs = spark.createDataFrame([(1, "d", "n")], "seq int, doc_id string, source_name string")
    ents = spark.createDataFrame([(1, "t|x", "X", "T", ["y"]), (2, "t|z", "Z", "T", [])], "seq int, key string, name string, type string, aliases array<string>")
    facts = spark.createDataFrame([(1, "t|x", "USES", "t|z", "d", ["p1e001"], "q", "high")], "seq int, source_key string, relation string, target_key string, doc_id string, element_ids array<string>, evidence string, confidence string")
    els = spark.createDataFrame([(1, "d:p1e001", "text")], "seq int, gid string, text string")
    for batch in (0, 1):
        told = store.apply(batch, docs, ents, facts, els).first()
        assert (told.documents, told.entities, told.facts, told.elements) == (1, 2, 1, 1)
    assert (store.entities().count(), store.facts().count(), store.documents().count(), store.elements().count()) == (2, 1, 1, 1)
    assert [r.key for r in G.known_entities(store.entities(), 1).collect()] == ["t|x"]
    store.reset(confirm=True)
    assert store.entities() is None


def test_find_entities(spark):
    ents = spark.createDataFrame([("service|payment api", "Payment API", "Service", 1, ["pay"]), ("team|payments", "Payments", "Team", 2, []), ("database|redis", "Redis", "Database", 3, [])], "key string, name string, type string, seq int, aliases array<string>")
    names = spark.createDataFrame([(1, 0, "PAY!"), (1, 1, "redis"), (2, 0, "zzz"), (2, 1, "?")], "query_id int, pos int, name string")
    got = [(r.query_id, r.key) for r in G.find_entities(ents, names).orderBy("query_id", "place").collect()]
    assert got == [(1, "service|payment api"), (1, "team|payments"), (1, "database|redis")]


def test_search_and_fusion(spark, tmp_path):
    p = spark.createDataFrame([("d:1", "Redis is a database"), ("d:2", "Payments team owns redis redis"), ("d:3", ""), ("d:4", "ledger PAYMENT_502")], "gid string, text string")
    q = spark.createDataFrame([(1, "redis"), (2, "payment_502 payment_502"), (3, "nothing here")], "query_id int, text string")
    index = S.Index.build(p).save(str(tmp_path / "index"))
    got = [(r.query_id, r.gid, r["rank"]) for r in index.search(q).orderBy("query_id", "rank").collect()]
    assert got == [(1, "d:2", 1), (1, "d:1", 2), (2, "d:4", 1)]
    graph = spark.createDataFrame([(1, "gone", 1), (1, "d:1", 2)], "query_id int, gid string, rank int")
    top = S.hybrid(index, graph, p, q, 2).orderBy("query_id", "rank").collect()
    assert [(r.gid, list(r.sources)) for r in top if r.query_id == 1] == [("d:1", ["graph", "bm25"]), ("d:2", ["bm25"])]


def test_answers(spark):
    q = spark.createDataFrame([(1, "who?"), (2, "what?"), (3, "fails")], "query_id int, text string")
    ctx = spark.createDataFrame([(1, "c"), (3, "c")], "query_id int, context string")
    ev = spark.createDataFrame([(1, "d:p1e002"), (3, "d:p1e002")], "query_id int, gid string")

    def model(prompt):
        if "fails" in prompt:
            raise RuntimeError("down")
        return " Team [d:p1e002] and [d:p9e999]. "

    got = {r.query_id: r for r in A.answer(q, ctx, ev, model).collect()}
    assert (list(got[1].citations), list(got[1].dropped), got[1].grounded) == (["d:p1e002"], ["d:p9e999"], True)
    assert got[2].text == A.NO_EVIDENCE and not got[2].grounded
    assert "down" in got[3].text and not got[3].grounded


def test_conversations(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "s")] + [(r, f"{r}{i}") for i in range(7) for r in ("user", "assistant")])]
    turns = A.turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = A.rewrite(A.history(turns), lambda p: "" if "user3" in p.split("Question: ")[1] else "R").orderBy("n").collect()
    assert [len(r.history) for r in got] == [0, 1, 2, 3, 4, 4, 4]
    assert [r.rewritten for r in got] == ["user0", "R", "R", "user3", "R", "R", "R"]
    assert got[6].history[0].question == "user2"
    named = A.analyse(spark.createDataFrame([(1, "Is Redis up?"), (2, "x")], "query_id int, text string"), lambda t: ["M"] if t == "x" else []).orderBy("query_id").collect()
    assert [list(r.names) for r in named] == [["Is Redis"], ["M"]]


def test_context_is_blank_without_results(spark):
    f = spark.createDataFrame([], "query_id int, hop int, seq int, source string, relation string, target string, doc_id string, element_ids array<string>")
    e = spark.createDataFrame([(1, 1, "d:p1e000", "n.md", 1, " t ")], "query_id int, rank int, gid string, source_name string, page_number int, text string")
    assert A.contexts(f, e).select(F.col("context")).first()[0] == "Evidence:\n\n[d:p1e000] (n.md, page 1)\nt"


def test_fuzzy_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    names = {f"{rng.choice(['part', 'pay', 'p', 'a b', 'ab'])}{rng.choice(['', ' ', '-'])}{rng.choice(['', '1', '12', '123', 'api', 'payments'])}" for _ in range(60)}
    rows = [(f"{t.lower()}|{n}", n, t) for n in sorted(names) for t in ("Team", "Service")]
    normal = lambda n: " ".join("".join(c if c.isalnum() else " " for c in n).split())
    want = {(k, *sorted((a, b))) for k in ("team", "service") for a, n, t in rows for b, m, u in rows if t.lower() == u.lower() == k and a != b and normal(n) in normal(m)}
    got = {(r.kind, r.a, r.b) for r in K.fuzzy_pairs(spark.createDataFrame(rows, "key string, name string, type string")).collect()}
    assert got == want
