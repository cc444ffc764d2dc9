"""Tables of a document, its structure and an answer's path, as a reader looks at them.

Each is a projection; none sorts the whole table, as the order is a column (`order`, or `place` within its group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions import ids
from quillstrata.functions import text as T
from quillstrata.operators import graph
from quillstrata.operators.structure import text_content

# --- fixed values -------------------------------------------------------------------------------------------------
SYNTHETIC_PARSERS = ("markdown", "spreadsheet")


def is_synthetic(meta: Column) -> Column:
    """Whether boxes were made up by the decoder instead of measured; false without a parser."""
    return F.coalesce(meta["parser"].isin(*SYNTHETIC_PARSERS), F.lit(False))


def visible(elements: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Elements of the chosen types; all for None, none for no types."""
    return elements if types is None else elements.filter(F.col("type").isin(*types))


def element_table(elements: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """doc_id, page_number, order, element_id, type, level, parent_id, the text's preview and the box's corners."""
    return visible(elements, types).select("doc_id", "page_number", "order", "element_id", "type", "level", "parent_id", T.preview(text_content()).alias("text"), "bbox.*")


def inspected(elements: DataFrame) -> DataFrame:
    """Each element whole: its place, box and size, full text, attributes, and the global id that citations use."""
    size = [(F.col(f"bbox.{a}1") - F.col(f"bbox.{a}0")).alias(name) for a, name in (("x", "width"), ("y", "height"))]
    gid = ids.global_id(F.col("doc_id").cast("string"), F.col("element_id")).alias("gid")
    return elements.select(gid, "doc_id", "element_id", "type", "order", "page_number", "parent_id", "level", "bbox", *size, text_content().alias("text"), "attrs")


def table_listing(elements: DataFrame) -> DataFrame:
    """doc_id, order, element_id, page_number, n_rows, n_cols, title (or the sheet's name), formulas, headers and rows of each table."""
    attr = lambda name: F.when(F.col("attrs")[name] != "", F.col("attrs")[name])
    of = [F.col(f"table.{c}").alias(c) for c in ("n_rows", "n_cols", "headers", "rows")]
    return elements.filter(F.col("table").isNotNull()).select("doc_id", "order", "element_id", "page_number", *of, F.coalesce(attr("table_title"), attr("sheet")).alias("title"), attr("formulas").alias("formulas"))


def warning_table(warnings: DataFrame, elements: DataFrame) -> DataFrame:
    """Warnings (doc_id, element_id, code, detail) with their element's order and page; those of whole files have neither."""
    return warnings.join(elements.select("doc_id", "element_id", "order", "page_number"), ["doc_id", "element_id"], "left")


def path_table(traversed: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, place, hop, source, relation, target, evidence: the facts that an answer walked, in their order, by names."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "seq"))
    return graph.with_names(traversed, entities).select("query_id", place.alias("place"), "hop", "source", "relation", "target", "evidence")
