from quillstrata.operators import answering, ask, search


def test_a_follow_up_question_finds_its_evidence(spark):
    passages = spark.createDataFrame(
        [("d:p1e001", "Payment API depends on Redis", "ops.md", 1), ("d:p1e002", "Payments Team owns Payment API", "ops.md", 1), ("d:p1e003", "INC-2391 affects Payment API", "ops.md", 2), ("d:p1e004", "unrelated ledger", "ops.md", 3)],
        "gid string, text string, source_name string, page_number int",
    )
    entities = spark.createDataFrame([("service|payment api", "Payment API", "Service", 1, []), ("team|payments team", "Payments Team", "Team", 2, []), ("incident|inc 2391", "INC-2391", "Incident", 3, [])], "key string, name string, type string, seq int, aliases array<string>")
    facts = spark.createDataFrame(
        [(1, "team|payments team", "OWNS", "service|payment api", "d", ["p1e002"], "q", "high"), (2, "incident|inc 2391", "AFFECTS", "service|payment api", "d", ["p1e003"], "q", "high")],
        "seq int, source_key string, relation string, target_key string, doc_id string, element_ids array<string>, evidence string, confidence string",
    )
    asked = spark.createDataFrame([(1, 1, "Which team owns the service affected by INC-2391?", [], []), (1, 2, "and who is on call?", [("q", "a")], ["INC-2391"]), (2, 1, "zzz", [], [])], "conv_id int, n int, question string, history array<struct<question:string,answer:string>>, carried array<string>")
    model = lambda prompt: f"See [d:p1e002] and [d:p9e999]: {'OWNS' in prompt}"
    answers, found = ask.ask(asked, search.Index.build(passages), passages, entities, facts, model)
    got = {(r.conv_id, r.n): r for r in answers.collect()}
    assert got[1, 1].text.endswith("True") and (list(got[1, 1].citations), list(got[1, 1].dropped), got[1, 1].grounded) == (["d:p1e002"], ["d:p9e999"], True)
    assert got[1, 2].grounded and got[2, 1].text == answering.NO_EVIDENCE
    first = [r.gid for r in found.evidence.filter("query_id = '1:1'").orderBy("rank").collect()]
    assert set(first[:2]) == {"d:p1e002", "d:p1e003"} and "d:p1e004" not in first
    trace = {r.query_id: (r.n_seeds, r.n_facts) for r in found.trace.collect()}
    assert trace == {"1:1": (1, 2), "1:2": (1, 2), "2:1": (0, 0)}
