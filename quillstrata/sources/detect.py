"""Which decoder a file takes: by a known suffix, else by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = (".pdf", ".md", ".markdown", ".png", ".jpg", ".jpeg", ".xlsx")
#: Leading bytes in hexadecimal.
MAGIC = (("255044462D", ".pdf"), ("89504E470D0A1A0A", ".png"), ("FFD8FF", ".jpg"), ("504B0304", ".xlsx"))


def suffix(name: Column) -> Column:
    """The last dot and what follows, lower case; empty without one or if the name begins with it."""
    return F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^.+(\.[^.]+)$", 1))


def detect(name: Column, content: Column) -> Column:
    found = suffix(name)
    head = F.hex(F.substring(content, 1, 16))
    by_magic = found
    for magic, known in reversed(MAGIC):
        by_magic = F.when(head.startswith(magic), known).otherwise(by_magic)
    return F.when(found.isin(*SUFFIXES), found).otherwise(by_magic)


def detect_plain(name: str, content: bytes) -> str:
    """The same outside of Spark."""
    tail = name.rsplit("/", 1)[-1]
    found = f".{tail.rsplit('.', 1)[1].lower()}" if "." in tail[1:] else ""
    if found in SUFFIXES:
        return found
    return next((s for m, s in MAGIC if content.startswith(bytes.fromhex(m))), found)
