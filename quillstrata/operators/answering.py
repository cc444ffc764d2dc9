"""Contexts, validated citations, grounded answers, conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions.text import citations, question_names, strip

#: Fixed value: the answer to a question that finds nothing.
NO_EVIDENCE = "No evidence was found in the ingested documents for this question. Try ingesting the relevant document, or rephrasing using terms that appear in it."
HISTORY, CARRIED = 4, 3
#: prompt -> text
Model = Callable[[str], str]


def contexts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, context.  facts: query_id, hop, seq, source, relation, target, doc_id, element_ids; evidence: query_id, rank, gid, source_name, page_number, text."""
    cited = F.array_join(F.transform("element_ids", lambda e: F.concat(F.lit("["), F.concat_ws(":", F.col("doc_id"), e), F.lit("]"))), " ")
    line = F.rtrim(F.concat(F.lit("- "), F.concat_ws(" ", "source", "relation", "target"), F.lit("  (hop "), F.col("hop").cast("string"), F.lit(") "), cited))
    block = F.concat(F.lit("["), F.col("gid"), F.lit("] ("), F.col("source_name"), F.lit(", page "), F.col("page_number").cast("string"), F.lit(")\n"), strip(F.col("text")))
    ordered = lambda key, text: F.sort_array(F.collect_list(F.struct(*key, text.alias("t"))))["t"]
    f = facts.groupBy("query_id").agg(F.concat(F.lit("Facts from the knowledge graph:\n"), F.array_join(ordered(("hop", "seq"), line), "\n")).alias("f"))
    e = evidence.groupBy("query_id").agg(F.concat(F.lit("Evidence:\n\n"), F.array_join(ordered(("rank",), block), "\n\n")).alias("e"))
    return f.join(e, "query_id", "full").select("query_id", F.concat_ws("\n\n", "f", "e").alias("context"))


def validate(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (query_id, text) with kept and dropped citations, in order of appearance, and grounded.  Only retrieved passages (query_id, gid) may be cited."""
    cited = answers.select("query_id", F.posexplode(citations(F.col("text"))).alias("pos", "gid"))
    known = evidence.select("query_id", "gid").distinct().withColumn("known", F.lit(True))
    marked = cited.join(known, ["query_id", "gid"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "gid", F.coalesce("known", F.lit(False)).alias("known")))).alias("c"))
    ids = lambda keep: F.coalesce(F.transform(F.filter("c", lambda x: x["known"] == keep), lambda x: x["gid"]), F.array().cast("array<string>"))
    out = answers.join(marked, "query_id", "left").withColumn("citations", ids(True)).withColumn("dropped", ids(False)).drop("c")
    return out.withColumn("grounded", F.size("citations") > 0)


def answer(queries: DataFrame, context: DataFrame, evidence: DataFrame, model: Model) -> DataFrame:
    """query_id, text, citations, dropped, grounded.  Questions without context never reach the model; a failing model costs one answer, which is then ungrounded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for query_id, text, ctx in frame[["query_id", "text", "context"]].itertuples(index=False, name=None):
                try:
                    out.append((query_id, model(f"{ctx}\n\nQuestion: {text}").strip(), True))
                except Exception as error:  # noqa: BLE001 - a model's failure is an answer
                    out.append((query_id, f"The answer could not be generated: {error}", False))
            yield pd.DataFrame(out, columns=["query_id", "text", "ok"])

    known = queries.join(context, "query_id", "left").withColumn("has", F.coalesce(F.col("context") != "", F.lit(False)))
    kind = queries.schema["query_id"].dataType.simpleString()
    said = known.filter("has").select("query_id", "text", "context").mapInPandas(run, f"query_id {kind}, text string, ok boolean")
    silent = known.filter(~F.col("has")).select("query_id", F.lit(NO_EVIDENCE).alias("text"), F.lit(False).alias("ok"))
    checked = validate(said.union(silent).withColumn("shown", F.col("text")).withColumn("text", F.when(F.col("ok"), F.col("text")).otherwise("")), evidence)
    return checked.select("query_id", F.col("shown").alias("text"), "citations", "dropped", "grounded")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n, turn, question, answer: each user row with the next row's answer, numbered from 1; system rows aside."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = conversations.filter(F.col("role") != "system").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    asked = said.filter(F.col("role") == "user")
    return asked.select("conv_id", F.row_number().over(w).alias("n"), "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def history(asked: DataFrame, last: int = HISTORY) -> DataFrame:
    """Adds history: the questions and answers of up to `last` turns before."""
    w = W.partitionBy("conv_id").orderBy("n").rowsBetween(-last, -1)
    return asked.withColumn("history", F.collect_list(F.struct("question", F.coalesce("answer", F.lit("")).alias("answer"))).over(w))


def carried(asked: DataFrame, names: str = "names", most: int = CARRIED) -> DataFrame:
    """Adds carried: the first names of the turn before."""
    w = W.partitionBy("conv_id").orderBy("n")
    return asked.withColumn("carried", F.coalesce(F.slice(F.lag(names).over(w), 1, most), F.array().cast("array<string>")))


def analyse(queries: DataFrame, model: Callable[[str], list[str]] | None = None) -> DataFrame:
    """queries with names: the model's, or those that the text itself shows where there is no model, it fails or finds none."""
    shown = question_names(F.col("text"))
    if model is None:
        return queries.withColumn("names", shown)

    @F.pandas_udf("array<string>")
    def ask(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[str] | None:
            try:
                return model(text) or None
            except Exception:  # noqa: BLE001 - fall back on the text
                return None

        return texts.map(one)

    return queries.withColumn("asked", ask("text")).withColumn("names", F.coalesce(F.when(F.size("asked") > 0, F.col("asked")), shown)).drop("asked")


def rewrite(asked: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds rewritten: a question that stands alone.  The first turn, no model, a failure or a blank leave the question as it is."""
    if model is None:
        return asked.withColumn("rewritten", F.col("question"))

    @F.pandas_udf("string")
    def ask(questions: pd.Series, told: pd.Series) -> pd.Series:
        def one(q: str, h: str) -> str | None:
            try:
                return model(f"{h}\n\nQuestion: {q}").strip() or None
            except Exception:  # noqa: BLE001 - fall back on the question
                return None

        return pd.Series([one(q, h) for q, h in zip(questions, told, strict=True)], dtype=object)

    later = asked.filter(F.size("history") > 0).select("conv_id", "n", ask("question", F.to_json("history")).alias("r"))
    return asked.join(later, ["conv_id", "n"], "left").withColumn("rewritten", F.coalesce("r", "question")).drop("r")
