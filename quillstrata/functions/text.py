"""Column builders over text: tokens, names, citations, previews.  None of them needs a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
#: White space as Unicode has it, for Java's regex, whose own class is narrower.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
TOKEN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
CAPTION = r"(?i)^(?:figure|fig\.|table|chart)" + SPACE + r"*\p{Nd}+"
PAGE_NUMBER = rf"(?i)^(?:(?:page{SPACE}*)?\p{{Nd}}+(?:{SPACE}*(?:of|/){SPACE}*\p{{Nd}}+)?|[ivxlcdm]+)$"
CITATION = r"\[([A-Za-z0-9_.\-]+:p\d+e\d+)\]"
IDENTIFIER = r"(?U)\b[A-Z][A-Z0-9]*[-_][A-Z0-9]+\b"
CAPITALISED = r"(?U)\b[A-Z][A-Za-z0-9]*(?:[ -][A-Z][A-Za-z0-9]*)*\b"
QUESTION_WORDS = ("What", "Which", "Who", "Where", "When", "Why", "How", "The", "A", "An")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squash(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased terms; a compound (`inc-2391`) stands whole, then in parts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike("[-_.]"), F.concat(F.array(t), F.split(t, "[-_.]"))).otherwise(F.array(t))))


def normal_name(name: Column) -> Column:
    """Lower case; all but ASCII letters and digits become spaces; spaces squashed."""
    return squash(F.regexp_replace(F.lower(strip(F.coalesce(name, F.lit("")))), r"[^a-z0-9\t-\r\x1c-\x20\x85\p{Z}]+", " "))


def entity_key(name: Column, kind: Column) -> Column:
    """Null where the name has nothing to normalise: callers turn that into a warning."""
    normal = normal_name(name)
    return F.when(normal != "", F.concat(F.lower(kind), F.lit("|"), normal))


def flat_quote(text: Column) -> Column:
    return F.lower(squash(F.coalesce(text, F.lit(""))))


def margin_key(text: Column) -> Column:
    """Running headers that differ in a number only share this."""
    return F.regexp_replace(F.lower(squash(text)), r"\p{Nd}+", "#")


def is_caption(text: Column) -> Column:
    return strip(text).rlike(CAPTION)


def is_page_number(text: Column) -> Column:
    return strip(text).rlike(PAGE_NUMBER)


def citations(text: Column) -> Column:
    """Distinct cited ids in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def question_names(text: Column) -> Column:
    """Identifiers, then runs of capitalised words that are neither question words nor named before."""
    identifiers = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    runs = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))), lambda r: ~r.isin(*QUESTION_WORDS))
    return F.concat(identifiers, F.array_except(runs, identifiers))


def preview(text: Column, blob_ref: Column | None = None, limit: int = 90) -> Column:
    shown = squash(F.coalesce(text, F.lit("")))
    if blob_ref is not None:
        shown = F.when((shown == "") & blob_ref.isNotNull(), F.concat(F.lit("[image "), blob_ref, F.lit("]"))).otherwise(shown)
    return F.when(F.length(shown) > limit, F.concat(F.substring(shown, 1, limit), F.lit("…"))).otherwise(shown)


def sentence(source: Column, relation: Column, target: Column) -> Column:
    return F.concat_ws(" ", source, relation, target)
