"""A batch of files to the document store and the graph, with an outcome for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import ids
from quillstrata.operators import graph, knowledge
from quillstrata.operators.structure import chunks, text_content
from quillstrata.scratch import spool
from quillstrata.sources import files


def upsert(decoded: DataFrame, extractor: knowledge.Extractor, known: DataFrame | None = None, judge: knowledge.Judge | None = None) -> dict[str, DataFrame]:
    """The logs' rows for a batch: documents, entities, facts, elements; and chunks and warnings.

    What the models say is written in the shared folder before anything is made of it, so a chunk is asked for once and all logs, and the
    outcomes, tell of that one answer."""
    docs, elements = files.documents(decoded), files.elements(decoded)
    chunked = spool(knowledge.extract(chunks(elements), extractor), "extracted")
    found = knowledge.candidates(chunked)
    resolved = spool(knowledge.resolve(found, known, judge), "resolved")
    facts, warned = (spool(part, "bound") for part in knowledge.bind(chunked, resolved, elements))
    seq = F.struct("doc_id", "chunk_seq", "pos")
    entities = resolved.filter(F.col("resolved_key").isNotNull()).select(seq.alias("seq"), "doc_id", F.col("resolved_key").alias("key"), "name", "type", "aliases")
    fact_rows = facts.select(seq.alias("seq"), "source_key", "relation", "target_key", "doc_id", "element_ids", "evidence", "confidence")
    cited = fact_rows.select("doc_id", F.explode("element_ids").alias("element_id")).distinct()
    refs = elements.join(cited, ["doc_id", "element_id"], "left_semi").join(docs.select("doc_id", "source_name"), "doc_id")
    refs = refs.select(F.struct("doc_id", "order").alias("seq"), ids.global_id(F.col("doc_id"), F.col("element_id")).alias("gid"), "doc_id", "element_id", "type", "page_number", "bbox", "order", text_content().alias("text"), "source_name")
    return {"documents": docs.select(F.struct("doc_id").alias("seq"), "doc_id", "source_name", "mime", "title", "checksum"), "entities": entities, "facts": fact_rows, "elements": refs, "chunks": chunked, "warnings": warned}


def outcomes(decoded: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """name, stage, error, chunks_done, chunks_total, n_entities, n_facts, n_warnings for each file; a failed file fails alone."""
    ch = parts["chunks"].groupBy("doc_id").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("chunks_done"), F.count("*").alias("chunks_total"))
    en = parts["entities"].groupBy("doc_id").agg(F.count_distinct("key").alias("n_entities"))
    fa = parts["facts"].groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    wa = parts["warnings"].groupBy("doc_id").agg(F.count("*").alias("n_warnings"))
    rows = decoded.select("path", "doc_id", F.col("source_name").alias("name"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("stage"), "error")
    for part in (ch, en, fa, wa):
        rows = rows.join(part, "doc_id", "left")
    numbers = ["chunks_done", "chunks_total", "n_entities", "n_facts", "n_warnings"]
    return rows.na.fill(0, numbers).select("name", "stage", "error", *numbers)


def totals(done: DataFrame) -> DataFrame:
    """Sums over the files that succeeded; what each wrote, so copies count again."""
    return done.filter(F.col("stage") == "done").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks_total", "n_entities", "n_facts", "n_warnings")))


def ingest_batch(rows: DataFrame, store: files.DocumentStore, store_graph: graph.GraphStore, extractor: knowledge.Extractor, batch_seq: int, judge: knowledge.Judge | None = None, commit: bool = True) -> DataFrame:
    """Decodes files (path, name, content), extracts and resolves in document order, writes documents before graph; returns outcomes.  commit=False only reviews."""
    decoded = spool(files.decode_all(rows), "decoded")
    parts = upsert(decoded, extractor, store_graph.entities() if commit else None, judge)
    done = outcomes(decoded, parts)
    if commit:
        store.put(decoded)
        store_graph.apply(batch_seq, *(parts[n] for n in graph.GraphStore.LOGS[:1]), parts["entities"].drop("doc_id"), parts["facts"], parts["elements"])
    return done
