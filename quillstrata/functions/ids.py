"""Identities: everything is named by its content or its place, never by when it was seen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(content: Column) -> Column:
    return F.substring(checksum(content), 1, 16)


def element_id(page: Column, index: Column) -> Column:
    return F.format_string("p%de%03d", page.cast("int"), index.cast("int"))


def blob_ref(page: Column, index: Column, extension: Column) -> Column:
    return F.format_string("p%d_i%03d.%s", page.cast("int"), index.cast("int"), extension)


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s:c%03d", document, index.cast("int"))


def global_id(document: Column, element: Column) -> Column:
    return F.concat_ws(":", document, element)


def safe_blob_ref(ref: Column) -> Column:
    """No path separators and no leading dot."""
    return ref.rlike(r"^[^./\\][^/\\]*$")
