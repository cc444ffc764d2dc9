"""Tables inside elements: struct<headers, rows, n_rows, n_cols>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE = "struct<headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int>"


def table_text(table: Column) -> Column:
    lines = F.transform(table["rows"], lambda r: F.array_join(r, " | "))
    head = F.when(F.size(table["headers"]) > 0, F.array(F.array_join(table["headers"], " | "))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines), "\n")


def cleaned_rows(rows: Column) -> Column:
    """Cells stripped, blank rows dropped, short rows padded."""
    stripped = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    some = F.filter(stripped, lambda r: F.exists(r, lambda c: c != ""))
    widest = F.transform(F.array(some), lambda s: F.struct(s.alias("s"), F.array_max(F.transform(s, lambda r: F.size(r))).alias("n")))[0]
    return F.transform(F.array(widest), lambda w: F.transform(w["s"], lambda r: F.concat(r, F.array_repeat(F.lit(""), w["n"] - F.size(r)))))[0]


def table_of(rows: Column) -> Column:
    """Cleaned rows as a table; the first is the header if there are two or more and it has no blank.  Null without a row."""

    def build(clean: Column) -> Column:
        headed = (F.size(clean) >= 2) & F.forall(clean[0], lambda c: c != "")
        body = F.when(headed, F.slice(clean, 2, F.size(clean))).otherwise(clean)
        head = F.when(headed, clean[0]).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(clean) > 0, F.struct(head.alias("headers"), body.alias("rows"), F.size(body).alias("n_rows"), F.size(clean[0]).alias("n_cols")))

    return F.transform(F.array(cleaned_rows(rows)), build)[0]


def well_formed(table: Column) -> Column:
    return (table["n_rows"] == F.size(table["rows"])) & F.forall(table["rows"], lambda r: F.size(r) == table["n_cols"]) & ((F.size(table["headers"]) == 0) | (F.size(table["headers"]) == table["n_cols"]))
