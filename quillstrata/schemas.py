"""The data model: closed vocabularies and table layouts."""

from __future__ import annotations

from pyspark.sql import Column

# --- fixed values -------------------------------------------------------------------------------------------------
ELEMENT_TYPES = ("heading", "paragraph", "list_item", "table", "image", "caption", "code", "header", "footer", "page_number")
FURNITURE = ("header", "footer", "page_number")
ENTITY_TYPES = ("Person", "Team", "Service", "Product", "Database", "Technology", "Organization", "Incident", "Document", "Policy", "Location", "Concept", "Other")
RELATIONS = ("OWNS", "DEPENDS_ON", "USES", "AFFECTS", "DOCUMENTED_BY", "BELONGS_TO", "CREATED_BY", "RESOLVES", "PART_OF", "RELATED_TO")
STAGES = ("queued", "parsing", "extracting", "committing", "done", "failed")

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLE = "struct<headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int>"
IMAGE = "struct<blob_ref:string,width:int,height:int,format:string,caption_id:string>"
ELEMENT = f"element_id string, `order` int, page_number int, type string, level int, parent_id string, bbox {BBOX}, text string, `table` {TABLE}, image {IMAGE}, attrs map<string,string>"
ELEMENTS = f"doc_id string, {ELEMENT}"
WARNING = "element_id string, code string, detail string"
PAGE = "number int, width double, height double"
#: What decoding one file yields: a document with all that belongs to it, or an error.
DECODED = (
    f"doc_id string, source_name string, mime string, checksum string, title string, meta map<string,string>, error string, pages array<struct<number:int,width:double,height:double>>, "
    f"elements array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ELEMENT.split(', '))}>>, blobs array<struct<ref:string,data:binary>>, warnings array<struct<element_id:string,code:string,detail:string>>"
)
CHUNKS = "chunk_id string, doc_id string, chunk_seq int, page_number int, heading string, text string, element_ids array<string>"
EXTRACTION = "entities array<struct<name:string,type:string,aliases:array<string>>>, facts array<struct<source:string,relation:string,target:string,evidence:string>>"
ENTITY_LOG = "batch_seq bigint, seq bigint, key string, name string, type string, aliases array<string>"
FACT_LOG = "batch_seq bigint, seq bigint, source_key string, relation string, target_key string, doc_id string, element_ids array<string>, evidence string, confidence string"


def valid_relation(relation: Column) -> Column:
    """The relation in canonical form, or null if it isn't one."""
    from pyspark.sql import functions as F

    found = F.upper(F.trim(relation))
    return F.when(found.isin(*RELATIONS), found)
