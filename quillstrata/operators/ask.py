"""A question from history to validated answer: the retrieval and answering operators in their order, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import answering, graph, search


@dataclass
class Retrieved:
    """seeds (query_id, key, ..., place), facts (traversed), evidence (query_id, gid, score, rank, sources and the passage), trace (query_id and counts)."""

    seeds: DataFrame
    facts: DataFrame
    evidence: DataFrame
    trace: DataFrame


def retrieve(queries: DataFrame, index: search.Index, passages: DataFrame, entities: DataFrame, facts: DataFrame, hops: int = 2, limit: int = search.LIMIT) -> Retrieved:
    """queries: query_id, text, names, carried.  Carried names seed the graph only; the lexical arm reads the text alone."""
    named = queries.select("query_id", F.posexplode(F.array_distinct(F.concat("names", "carried"))).alias("pos", "name"))
    seeds = graph.find_entities(entities, named)
    walked = graph.traverse(facts, entities, seeds, hops)
    fused = search.hybrid(index, graph.evidence_ids(walked), passages, queries, limit)
    evidence = fused.join(passages, "gid")
    counts = [df.groupBy("query_id").agg(F.count("*").alias(name)) for name, df in (("n_seeds", seeds), ("n_facts", walked), ("n_evidence", evidence))]
    trace = queries.select("query_id", "names", "carried")
    for c in counts:
        trace = trace.join(c, "query_id", "left")
    return Retrieved(seeds, walked, evidence, trace.na.fill(0, ["n_seeds", "n_facts", "n_evidence"]))


def ask(asked: DataFrame, index: search.Index, passages: DataFrame, entities: DataFrame, facts: DataFrame, model: answering.Model, rewriter: answering.Model | None = None, namer: Callable[[str], list[str]] | None = None, hops: int = 2, limit: int = search.LIMIT) -> tuple[DataFrame, Retrieved]:
    """asked: conv_id, n, question, history, carried, as answering.history and answering.carried make them; passages with source_name and page_number.

    Returns (answers, retrieved): conv_id, n, question, rewritten, text, citations, dropped, grounded, and what they rest on."""
    alone = answering.rewrite(asked, rewriter).withColumn("query_id", F.concat_ws(":", "conv_id", "n"))
    queries = answering.analyse(alone.select("query_id", F.col("rewritten").alias("text"), "carried"), namer)
    found = retrieve(queries, index, passages, entities, facts, hops, limit)
    context = answering.contexts(graph.with_names(found.facts, entities), found.evidence)
    answers = answering.answer(queries, context, found.evidence, model)
    return alone.select("query_id", "conv_id", "n", "question", "rewritten").join(answers, "query_id").drop("query_id"), found
