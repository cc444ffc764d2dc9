"""Queries over the test tables, each with the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions import geometry as G
from quillstrata.functions import ids
from quillstrata.functions import text as T
from quillstrata.operators import answering, graph, knowledge, layout, search, structure, views
from quillstrata.plans import adapters as A
from quillstrata.scratch import shared_dir, spool
from quillstrata.sources import detect, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments ------------------------------------------------------------------------------------------------
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
SQUASH = lambda x: STRIP(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
NORMAL = lambda x: SQUASH(rf"regexp_replace(lower({STRIP(x)}), '[^a-z0-9\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g')")
TOKENS = lambda x: f"flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-_.][a-z0-9]+)*'), lambda t: CASE WHEN regexp_matches(t, '[-_.]') THEN list_concat([t], regexp_split_to_array(t, '[-_.]')) ELSE [t] END))"
ELEMENTS = f"""
l0 AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIP('x')} <> '') AS ls FROM documents),
elements AS (SELECT doc_id, i AS "order", 'p1e' || printf('%03d', i) AS element_id, x AS text,
  CASE WHEN i = 0 AND n > 1 AND length(x) <= 80 THEN 'heading' WHEN contains(x, ' | ') THEN 'table' WHEN starts_with(x, '- ') OR starts_with(x, '* ') THEN 'list_item' ELSE 'paragraph' END AS type
  FROM (SELECT doc_id, len(ls) AS n, unnest(ls) AS x, CAST(unnest(range(0, len(ls))) AS INT) AS i FROM l0)),
passages AS (SELECT CAST(doc_id AS VARCHAR) || ':' || element_id AS gid, doc_id, {STRIP('text')} AS text FROM elements)"""
INDEX = f"""{ELEMENTS},
pt AS (SELECT gid, {TOKENS('text')} AS ts FROM passages),
corpus AS (SELECT count(*) AS n_passages, avg(len(ts)) AS avg_n FROM pt),
postings AS (SELECT gid, term, count(*) AS tf FROM (SELECT gid, unnest(ts) AS term FROM pt) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, ln(1 + (any_value(n_passages) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, corpus GROUP BY term)"""
SCORES = f"""{INDEX},
q AS (SELECT item_id AS query_id, text FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({TOKENS('text')}) AS term FROM q) GROUP BY ALL),
s AS (SELECT query_id, p.gid, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg_n))), 9) AS score FROM qt JOIN terms USING (term) JOIN postings p USING (term) JOIN pt ON pt.gid = p.gid, corpus GROUP BY 1, 2),
r AS (SELECT query_id, gid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS rank FROM s)"""
ENTITIES = """
el AS (SELECT 0 AS t, CAST(r_regionkey AS BIGINT) AS k, r_name AS name, 'Location' AS type FROM region UNION ALL SELECT 1, n_nationkey, n_name, 'Location' FROM nation UNION ALL SELECT 2, c_custkey, c_name, 'Organization' FROM customer
  UNION ALL SELECT 3, s_suppkey, s_name, 'Team' FROM supplier UNION ALL SELECT 4, p_partkey, 'part ' || p_partkey, 'Product' FROM part UNION ALL SELECT 5, o_orderkey, 'order ' || o_orderkey, 'Document' FROM orders),
ek AS (SELECT *, lower(type) || '|' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM el),
entities AS MATERIALIZED (SELECT key, arg_min(name, (t, k)) AS name, arg_min(type, (t, k)) AS type, min((t, k)) AS seq FROM ek GROUP BY key)"""
_LOC, _ORD, _PART = "'location|' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))", "'document|order ' || {}", "'product|part ' || {}"
_ORG, _TEAM = "'organization|' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))", "'team|' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
FACTS = f"""{ENTITIES},
facts AS (
  SELECT 0 AS t, CAST(n_nationkey AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, {_LOC.format('n_name')} AS s, 'PART_OF' AS relation, {_LOC.format('r_name')} AS o, 'nation' AS doc_id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1, c_custkey, 0, {_ORG.format('c_name')}, 'BELONGS_TO', {_LOC.format('n_name')}, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 2, s_suppkey, 0, {_TEAM.format('s_name')}, 'BELONGS_TO', {_LOC.format('n_name')}, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 3, o_orderkey, 0, {_ORD.format('o_orderkey')}, 'CREATED_BY', {_ORG.format('c_name')}, 'orders' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 4, l_suppkey, l_partkey, {_TEAM.format('s_name')}, 'OWNS', {_PART.format('l_partkey')}, 'partsupp' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 5, l_orderkey, l_partkey, {_ORD.format('l_orderkey')}, 'USES', {_PART.format('l_partkey')}, 'lineitem' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, k1, k2) AS pos FROM facts)"""
SEEDS = "seeds AS (SELECT query_id, key FROM (VALUES (1, 'location|france'), (1, 'team|supplier 000000001'), (2, 'product|part 7'), (3, 'organization|customer 000000005'), (3, 'nowhere|x')) v(query_id, key) WHERE key IN (SELECT key FROM entities))"


# --- text ---------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS('coalesce(text, chr(32))')}) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"WITH {INDEX} SELECT gid, CAST(len(ts) AS BIGINT) AS n FROM pt")
def doc_lengths(spark, d):
    return search.Index.build(A.passages(A.table(spark, d, "documents"))).lengths


@query(f"WITH {INDEX} SELECT term, df, round(idf, 9) AS idf FROM terms")
def term_document_frequency(spark, d):
    return search.Index.build(A.passages(A.table(spark, d, "documents"))).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {SCORES} SELECT gid, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10 AND query_id = (SELECT min(item_id) FROM benchmark)")
def bm25_topk(spark, d):
    asked = A.questions(A.table(spark, d, "benchmark"))
    first = asked.join(asked.agg(F.min("query_id").alias("query_id")), "query_id", "left_semi")
    return search.Index.build(A.passages(A.table(spark, d, "documents"))).search(first).select("gid", "score", "rank")


@query(f"WITH {SCORES} SELECT query_id, gid, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def bm25_batch_topk(spark, d):
    return search.Index.build(A.passages(A.table(spark, d, "documents"))).search(A.questions(A.table(spark, d, "benchmark")))


@query(f"SELECT s_suppkey, {NORMAL('s_name')} AS normal, 'team|' || {NORMAL('s_name')} AS key FROM supplier")
def normalize_names(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", T.normal_name(F.col("s_name")).alias("normal"), T.entity_key(F.col("s_name"), F.lit("Team")).alias("key"))


@query(rf"SELECT doc_id, CASE WHEN length(s) > 90 THEN substr(s, 1, 90) || '…' ELSE s END AS preview FROM (SELECT doc_id, {SQUASH('coalesce(text, chr(32))')} AS s FROM documents)")
def text_preview(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query()
def question_entities(spark, d):
    """Names that a question shows; a null text shows none."""
    return A.table(spark, d, "benchmark").select("item_id", T.question_names(F.coalesce("text", F.lit(""))).alias("names"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(pdf|md|markdown|png|jpg|jpeg|xlsx)$') THEN regexp_extract(lower(url), '(\\.[a-z]+)$', 1) ELSE regexp_extract(lower(list_last(string_split(url, '/'))), '^.+(\\.[^.]+)$', 1) END AS kind FROM pages")
def magic_detect(spark, d):
    """Kind of each page by suffix of its url, else by its first bytes, else the raw suffix."""
    return A.table(spark, d, "pages").select("page_id", detect.detect(F.col("url"), F.col("html").cast("binary")).alias("kind"))


@query("SELECT DISTINCT sha256(text)[1:16] AS document_id, sha256(text) AS checksum FROM documents")
def content_dedup(spark, d):
    c = F.col("text").cast("binary")
    return A.table(spark, d, "documents").filter(F.col("text").isNotNull()).select(ids.document_id(c).alias("document_id"), ids.checksum(c).alias("checksum")).dropDuplicates(["checksum"])


# --- structure ----------------------------------------------------------------------------------------------------
@query(f'WITH {ELEMENTS} SELECT doc_id, element_id, "order", type, CASE WHEN type = \'heading\' THEN 1 END AS level, 72 + 14.0 * "order" AS y0, 86 + 14.0 * "order" AS y1, text FROM elements')
def elements_from_documents(spark, d):
    return A.elements(A.table(spark, d, "documents")).select("doc_id", "element_id", "order", "type", "level", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), "text")


@query(f"WITH {ELEMENTS} SELECT e.doc_id, e.element_id, CASE WHEN e.\"order\" > 0 AND h.doc_id IS NOT NULL THEN 'p1e000' END AS parent_id FROM elements e LEFT JOIN (SELECT doc_id FROM elements WHERE type = 'heading') h USING (doc_id)")
def assign_parents(spark, d):
    return structure.assign_parents(A.elements(A.table(spark, d, "documents"))).select("doc_id", "element_id", "parent_id")


#: Headings of three levels from numbers, so that nesting is deeper than documents show.
_LEVELS = "SELECT doc_id, i AS \"order\", 'p1e' || printf('%03d', i) AS element_id, CASE WHEN length(x) % 3 = 0 THEN 1 + length(x) % 4 END AS level FROM (SELECT doc_id, unnest(ls) AS x, CAST(unnest(range(0, len(ls))) AS INT) AS i FROM l0)"


@query(
    f"""WITH {ELEMENTS}, e AS ({_LEVELS}) SELECT a.doc_id, a.element_id, max_by(b.element_id, b."order") AS parent_id FROM e a LEFT JOIN e b ON a.doc_id = b.doc_id AND b."order" < a."order" AND b.level < coalesce(a.level, 7)
  GROUP BY ALL"""
)
def nested_parents(spark, d):
    """Parents under headings of up to four levels: the nearest heading before of any higher rank, which a stack would hold."""
    e = A.elements(A.table(spark, d, "documents"))
    n = F.length("text")
    e = e.withColumn("level", F.when(n % 3 == 0, 1 + n % 4)).withColumn("type", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph"))
    return structure.assign_parents(e).select("doc_id", "element_id", "parent_id")


@query(f"WITH {ELEMENTS} SELECT doc_id, h AS section_seq, any_value(heading) AS heading, CAST(count(*) FILTER (type <> 'heading') AS BIGINT) AS n_elements FROM (SELECT *, CAST(sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY \"order\") AS INT) AS h, first_value(CASE WHEN type = 'heading' THEN text END) OVER (PARTITION BY doc_id ORDER BY \"order\") AS heading FROM elements) GROUP BY doc_id, h")
def section_outline(spark, d):
    return structure.section_outline(A.elements(A.table(spark, d, "documents"))).select("doc_id", "section_seq", "heading", "n_elements")


@query(
    f"""WITH {ELEMENTS}, e AS ({_LEVELS}), s AS (SELECT *, CAST(sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "order") AS INT) AS section_seq FROM e),
o AS (SELECT b.doc_id, b."order", b.level, min(c."order") AS closed FROM e b LEFT JOIN e c ON c.doc_id = b.doc_id AND c."order" > b."order" AND c.level <= b.level WHERE b.level IS NOT NULL GROUP BY ALL),
p AS (SELECT a.doc_id, a."order", count(*) AS depth FROM e a JOIN o ON o.doc_id = a.doc_id AND o."order" < a."order" AND o.level < a.level AND (o.closed IS NULL OR o.closed >= a."order") GROUP BY ALL)
SELECT s.doc_id, section_seq, CAST(coalesce(max(level), 0) AS INT) AS level, CAST(coalesce(max(CASE WHEN level IS NOT NULL THEN depth END), 0) AS INT) AS depth, count(*) FILTER (level IS NULL) AS n_elements FROM s LEFT JOIN p USING (doc_id, "order") GROUP BY ALL"""
)
def nested_outline(spark, d):
    """Sections under headings of up to four levels: a heading lies in each heading before it that none of its rank or higher has closed; level 0 is before any."""
    e = A.elements(A.table(spark, d, "documents"))
    n = F.length("text")
    e = e.withColumn("level", F.when(n % 3 == 0, 1 + n % 4)).withColumn("type", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph"))
    return structure.section_outline(e).na.fill(0, ["level"]).select("doc_id", "section_seq", "level", "depth", "n_elements")


@query(rf"""WITH {ELEMENTS}, p AS (SELECT doc_id, "order", element_id, type, {SQUASH('text')} AS s FROM elements WHERE type IN ('heading', 'list_item'))
SELECT doc_id, "order", element_id, type, CASE WHEN length(s) > 90 THEN substr(s, 1, 90) || '…' ELSE s END AS text, 72 + 14.0 * "order" AS y0 FROM p""")
def element_table(spark, d):
    """The element table with two types shown."""
    return views.element_table(A.elements(A.table(spark, d, "documents")), ("heading", "list_item")).select("doc_id", "order", "element_id", "type", "text", "y0")


@query(f"""WITH {ELEMENTS} SELECT doc_id, element_id, 1 AS n_rows, CAST(len(string_split(text, ' | ')) AS INT) AS n_cols, md5(text) AS text_md5 FROM elements WHERE type = 'table'""")
def table_listing(spark, d):
    """Tables of the documents, and their flattened text: lines with bars as tables of one row."""
    e = A.elements(A.table(spark, d, "documents"))
    cells = F.split("text", r" \| ")
    made = F.struct(F.array().cast("array<string>").alias("headers"), F.array(cells).alias("rows"), F.lit(1).alias("n_rows"), F.size(cells).alias("n_cols"))
    e = e.withColumn("table", F.when(F.col("type") == "table", made))
    flat = views.inspected(e).select("doc_id", "element_id", F.md5("text").alias("text_md5"))
    return views.table_listing(e).join(flat, ["doc_id", "element_id"]).select("doc_id", "element_id", "n_rows", "n_cols", "text_md5")


@query(f"WITH {ELEMENTS} SELECT doc_id, min(text) FILTER (type = 'heading' AND text <> '') AS title FROM elements GROUP BY doc_id")
def title_projection(spark, d):
    return structure.titles(A.elements(A.table(spark, d, "documents")))


@query(f"WITH {ELEMENTS} SELECT doc_id, type, count(*) AS n FROM elements GROUP BY ALL")
def element_type_counts(spark, d):
    return structure.type_counts(A.elements(A.table(spark, d, "documents")))


@query(f"WITH {ELEMENTS} SELECT doc_id, element_id FROM elements WHERE type NOT IN ('header', 'footer', 'page_number') AND {STRIP('text')} <> ''")
def furniture_filter(spark, d):
    return structure.content_only(A.elements(A.table(spark, d, "documents"))).select("doc_id", "element_id")


@query(
    f"""WITH RECURSIVE {ELEMENTS},
c AS (SELECT doc_id, element_id, text, length(text) AS n, CAST(type = 'heading' AS INT) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY "order") AS i FROM elements WHERE type <> 'heading' AND {STRIP('text')} <> ''),
w AS (SELECT doc_id, i, 0 AS batch, n AS size, n >= 1500 AS closed FROM c WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN w.closed OR w.size + c.n > 1500 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.closed OR w.size + c.n > 1500 THEN c.n ELSE w.size + c.n END, CASE WHEN w.closed OR w.size + c.n > 1500 THEN c.n ELSE w.size + c.n END >= 1500
  FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1)
SELECT CAST(w.doc_id AS VARCHAR) || ':c' || printf('%03d', batch) AS chunk_id, count(*) AS n_elements, md5(string_agg({STRIP('c.text')}, chr(10) || chr(10) ORDER BY w.i)) AS text_md5
FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id, batch"""
)
def greedy_chunks(spark, d):
    c = structure.chunks(A.elements(A.table(spark, d, "documents")).withColumn("doc_id", F.col("doc_id").cast("string")))
    return c.select("chunk_id", F.size("element_ids").cast("long").alias("n_elements"), F.md5("text").alias("text_md5"))


@query(f"WITH {ELEMENTS}, a AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(10), ''), '')) AS ch FROM documents) GROUP BY ALL), b AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM elements) GROUP BY ALL) SELECT doc_id, CAST(sum(a.n) - coalesce(sum(b.n), 0) AS BIGINT) AS lost FROM a LEFT JOIN b USING (doc_id, ch) GROUP BY doc_id HAVING sum(a.n) <> coalesce(sum(b.n), 0)")
def lossless_check(spark, d):
    """Documents whose elements lack characters of the text (line feeds and blank lines aside): none, but for blank lines of spaces."""
    docs = A.table(spark, d, "documents")
    kept = A.elements(docs).groupBy("doc_id").agg(F.sum(F.length("text")).alias("kept"))
    full = docs.select("doc_id", F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))).cast("long").alias("n")).filter("n > 0")
    lost = full.join(kept, "doc_id", "left").select("doc_id", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("lost"))
    return lost.filter("lost <> 0")


# --- layout -------------------------------------------------------------------------------------------------------


@query("WITH g AS (SELECT l_suppkey AS doc_id, l_quantity AS size, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY size) AS cum, sum(w) OVER (PARTITION BY doc_id) AS total FROM g) SELECT doc_id, min(size) AS body_size FROM c WHERE 2 * cum >= total GROUP BY doc_id")
def font_median(spark, d):
    """The weighted lower median on numbers: quantities of each supplier's lines, weighted by line number."""
    rows = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").alias("size"), "l_linenumber")
    return layout.weighted_median(rows, "doc_id", "size", F.col("l_linenumber"), "body_size")


@query(
    """WITH c AS (SELECT p_partkey, p_brand, p_retailprice AS s, count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS cum, count(*) OVER (PARTITION BY p_brand) AS total FROM part),
m AS (SELECT p_brand, min(s) AS body FROM c WHERE 2 * cum >= total GROUP BY p_brand)
SELECT p_partkey, CASE WHEN s >= body * 1.15 THEN CAST(least(dense_rank() OVER (PARTITION BY p_brand, s >= body * 1.15 ORDER BY round_even(s * 2, 0) / 2 DESC), 6) AS INT) END AS level FROM c JOIN m USING (p_brand)"""
)
def heading_ranks(spark, d):
    """Body size, candidates and levels by half-point size: parts as lines of their brand, prices as sizes."""
    blocks = A.table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", F.lit("text").alias("kind"), F.lit("x").alias("text"), F.col("p_retailprice").alias("max_size"), F.lit(False).alias("is_bold"), F.lit(1).alias("line_count"), F.lit(0.0).alias("gap_below"))
    return layout.heading_levels(blocks).select("p_partkey", "level")


_KEY = lambda x: rf"regexp_replace(lower({SQUASH(x)}), '\p{{Nd}}+', '#', 'g')"


@query(f"WITH {ELEMENTS} SELECT doc_id, {_KEY('text')} AS same, count(*) AS times FROM elements GROUP BY ALL HAVING count(*) > 1")
def margin_repeats(spark, d):
    e = A.elements(A.table(spark, d, "documents"))
    return e.groupBy("doc_id", T.margin_key(F.col("text")).alias("same")).agg(F.count("*").alias("times")).filter("times > 1")


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM region r WHERE e.user_id % 5 = r.r_regionkey AND e.value BETWEEN 10 * r.r_regionkey AND 10 * r.r_regionkey + 15)")
def table_mask_antijoin(spark, d):
    """Blocks outside all regions of their page: events as points, one region for each remainder of the user."""
    e = A.table(spark, d, "events").filter("value is not null").select(F.lit(1).alias("doc_id"), (F.col("user_id") % 5).cast("int").alias("page"), "event_id", G.box(F.col("value"), F.lit(0), F.col("value"), F.lit(0)).alias("bbox"))
    r = A.table(spark, d, "region").select(F.lit(1).alias("doc_id"), F.col("r_regionkey").alias("page"), G.box(10 * F.col("r_regionkey"), F.lit(-1), 10 * F.col("r_regionkey") + 15, F.lit(1)).alias("bbox"))
    return layout.mask_tables(e, r).select("event_id")


_BLOCKS = """b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS i, l_quantity * 8 AS x0, l_quantity * 8 + 100 AS x1, l_tax * 1000 AS y0, l_tax * 1000 + 10 AS y1, l_returnflag = 'R' AS figure FROM lineitem)"""


@query(
    f"""WITH {_BLOCKS.replace('l_linenumber AS page', '1 AS page')} SELECT f.doc_id, f.i AS figure, c.i AS caption, c.y0 - f.y1 BETWEEN 0 AND 40 AS below FROM b f JOIN b c ON f.doc_id = c.doc_id AND f.figure AND NOT c.figure
  WHERE greatest(0, least(f.x1, c.x1) - greatest(f.x0, c.x0)) / 100 >= 0.5 AND (c.y0 - f.y1 BETWEEN 0 AND 40 OR f.y0 - c.y1 BETWEEN 0 AND 40)"""
)
def caption_candidates(spark, d):
    """Figures and texts of one page, near and overlapping: order lines as blocks."""
    li = A.table(spark, d, "lineitem")
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    x, y = F.col("l_quantity") * 8, F.col("l_tax") * 1000
    b = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), i.alias("index"), G.box(x, y, x + 100, y + 10).alias("bbox"), F.lit("Figure 1").alias("text"), F.lit(9.0).alias("max_size"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("kind"), F.lit(None).cast("string").alias("zone"), F.lit(11.0).alias("body_size"))
    return layout.caption_candidates(b).select("doc_id", "figure", "caption", "below")


# --- knowledge and graph ------------------------------------------------------------------------------------------
_MENTIONS = "m AS (SELECT event_id AS seq, 'service|' || event_type AS key, event_type || ' ' || CAST(user_id % 7 AS VARCHAR) AS name FROM events)"


@query(f"WITH {_MENTIONS} SELECT key, arg_min(name, seq) AS name, list_sort(list_filter(list(DISTINCT {NORMAL('name')}), lambda a: a <> {NORMAL('arg_min(name, seq)')} AND a <> '')) AS aliases FROM m GROUP BY key")
def entity_merge(spark, d):
    """The entity log's fold: the first name stands, later ones are aliases."""
    log = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("service|"), "event_type").alias("key"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 7).cast("string")).alias("name"), F.lit("Service").alias("type"), F.array().cast("array<string>").alias("aliases"))
    return knowledge.merge_entities(log).select("key", "name", "aliases")


@query(
    """WITH l AS (SELECT (l_orderkey, l_linenumber) AS seq, 'team|' || l_suppkey AS source_key, 'product|' || l_partkey AS target_key, 'p1e' || l_linenumber AS e, l_returnflag AS evidence FROM lineitem),
o AS (SELECT source_key, target_key, e, min(seq) AS first FROM l GROUP BY ALL)
SELECT source_key, target_key, array_to_string(list(e ORDER BY first), ',') AS element_ids, any_value(ev) AS evidence FROM o JOIN (SELECT source_key, target_key, arg_min(evidence, seq) AS ev FROM l GROUP BY ALL) USING (source_key, target_key) GROUP BY source_key, target_key"""
)
def fact_merge(spark, d):
    """The fact log's fold: element ids unite in order, the first evidence stands."""
    log = A.table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("seq"), F.concat(F.lit("team|"), "l_suppkey").alias("source_key"), F.lit("OWNS").alias("relation"), F.concat(F.lit("product|"), "l_partkey").alias("target_key"), F.lit("x").alias("doc_id"),
        F.array(F.concat(F.lit("p1e"), "l_linenumber")).alias("element_ids"), F.col("l_returnflag").alias("evidence"), F.lit("low").alias("confidence"),
    )
    return knowledge.merge_facts(log).select("source_key", "target_key", F.array_join("element_ids", ",").alias("element_ids"), "evidence")


_FLAT = lambda x: f"lower({SQUASH(x)})"


@query(
    f"""WITH {ELEMENTS}, f AS (SELECT doc_id, {_FLAT("arg_max(text, \"order\")")} AS quote FROM elements GROUP BY doc_id)
SELECT f.doc_id, coalesce(arg_min(element_id, "order") FILTER (quote <> '' AND contains({_FLAT('text')}, quote)), '*') AS element_id FROM f JOIN elements e USING (doc_id) GROUP BY f.doc_id"""
)
def bind_evidence(spark, d):
    """Each document's last element as a quote: the first element that holds it."""
    e = A.elements(A.table(spark, d, "documents"))
    f = e.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("order", "element_id"))).alias("o"), F.max_by("text", "order").alias("t"))
    f = f.select("doc_id", F.lit("c").alias("chunk_id"), F.lit(0).alias("pos"), F.col("o.element_id").alias("element_ids"), F.col("t").alias("evidence"))
    return knowledge.bind_evidence(f, e).select("doc_id", F.when(F.col("confidence") == "high", F.col("element_ids")[0]).otherwise("*").alias("element_id"))


@query("SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey + 1400 AS VARCHAR), 9, '0') AS missing FROM orders WHERE o_custkey + 1400 NOT IN (SELECT c_custkey FROM customer)")
def unknown_entity_warnings(spark, d):
    """Facts that name an entity which their chunk didn't declare: an order a chunk, by a customer moved beyond the last."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("order "), "o_orderkey").alias("order"), (F.col("o_custkey") + 1400).alias("c_custkey"))
    fact = F.struct(F.col("order").alias("source"), F.lit("CREATED_BY").alias("relation"), F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("target"), F.lit("").alias("evidence"))
    said = o.select(F.lit("orders").alias("doc_id"), "chunk_id", F.lit(0).alias("chunk_seq"), F.array(F.lit("p1e000")).alias("element_ids"), F.struct(F.array(fact).alias("facts")).alias("extraction"), F.lit(None).cast("string").alias("error"))
    one = lambda name, kind, pos: (F.lit("orders").alias("doc_id"), "chunk_id", F.lit(pos).alias("pos"), F.array().cast("array<string>").alias("aliases"), name.alias("name"), T.entity_key(name, F.lit(kind)).alias("key"), T.entity_key(name, F.lit(kind)).alias("resolved_key"))
    named = o.select(*one(F.col("order"), "Document", 0)).union(o.join(A.table(spark, d, "customer"), "c_custkey").select(*one(F.col("c_name"), "Organization", 1)))
    warned = knowledge.bind(said, named, A.elements(A.table(spark, d, "documents")).withColumn("doc_id", F.col("doc_id").cast("string")))[1]
    return warned.filter("code = 'unknown_entity'").select(F.col("chunk_id").cast("bigint").alias("o_orderkey"), F.col("detail").alias("missing"))


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON lower(replace(s.s_name, '#', ' ')) = 'supplier ' || lpad(CAST(c.c_custkey AS VARCHAR), 9, '0')")
def alias_match(spark, d):
    """Entities found by alias: customers that bear a supplier's name as alias, asked for by the suppliers' names."""
    c = A.table(spark, d, "customer")
    known = c.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.lit("Team").alias("type"), F.col("c_custkey").alias("seq"), F.array(F.concat(F.lit("supplier "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("aliases"))
    asked = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.lit(0).alias("pos"), F.col("s_name").alias("name"))
    return graph.find_entities(known, asked, limit=None).select(F.col("key").cast("bigint").alias("c_custkey"), F.col("query_id").alias("s_suppkey"))


@query("SELECT DISTINCT 'x' AS kind, least(a.p_name, b.p_name) AS a, greatest(a.p_name, b.p_name) AS b FROM (SELECT DISTINCT lower(p_name) AS p_name FROM part) a JOIN (SELECT DISTINCT lower(p_name) AS p_name FROM part) b ON a.p_name <> b.p_name AND contains(b.p_name, a.p_name)")
def fuzzy_candidates(spark, d):
    """Distinct part names of which one contains the other."""
    names = A.table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct().select(F.col("name").alias("key"), "name", F.lit("x").alias("type"))
    return knowledge.fuzzy_pairs(names)


_NAMES = "(1, 0, 'France'), (1, 1, 'supplier 000000001'), (2, 0, 'customer 00000001'), (3, 0, 'asia'), (3, 1, 'FRANCE!')"


@query(
    f"""WITH {ENTITIES}, n AS (SELECT query_id, pos, {NORMAL('name')} AS needle FROM (VALUES {_NAMES}) v(query_id, pos, name)),
h AS (SELECT query_id, e.key, min(pos) AS pos, any_value(seq) AS seq FROM n JOIN entities e ON contains({NORMAL('e.name')}, needle) GROUP BY 1, 2)
SELECT query_id, key, CAST(place AS INT) AS place FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY pos, seq, key) AS place FROM h) WHERE place <= 10"""
)
def find_entities(spark, d):
    names = spark.sql(f"SELECT * FROM VALUES {_NAMES} AS v(query_id, pos, name)")
    return graph.find_entities(A.entities(spark, d), names).select("query_id", "key", "place")


def _traverse(spark, d, hops):
    seeds = spark.sql("SELECT * FROM VALUES (1, 'location|france'), (1, 'team|supplier 000000001'), (2, 'product|part 7'), (3, 'organization|customer 000000005'), (3, 'nowhere|x') AS v(query_id, key)")
    rows = graph.traverse(spool(A.fact_log(spark, d), "facts"), A.entities(spark, d), seeds, hops)
    return rows.select("query_id", "hop", "source_key", "relation", "target_key")


def _traverse_sql(hops: int) -> str:
    steps, last = [f"{SEEDS}, n0 AS (SELECT query_id, key, 0 AS dist FROM seeds)"], "n0"
    for h in range(1, hops):
        steps.append(f"n{h} AS MATERIALIZED (SELECT query_id, key, min(dist) AS dist FROM (SELECT * FROM {last} UNION ALL SELECT query_id, o, {h} FROM {last} JOIN f ON s = key UNION ALL SELECT query_id, s, {h} FROM {last} JOIN f ON o = key) GROUP BY ALL)")
        last = f"n{h}"
    return f"""WITH {FACTS}, {', '.join(steps)}, e AS (SELECT query_id, pos, 1 + min(dist) AS hop FROM (SELECT query_id, pos, dist FROM {last} JOIN f ON s = key UNION ALL SELECT query_id, pos, dist FROM {last} JOIN f ON o = key) GROUP BY ALL)
SELECT query_id, CAST(hop AS INT) AS hop, s AS source_key, relation, o AS target_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, pos) AS place FROM e) JOIN f USING (pos) WHERE place <= 200"""


@query(_traverse_sql(1))
def traverse_1hop(spark, d):
    return _traverse(spark, d, 1)


@query(_traverse_sql(2))
def traverse_2hop(spark, d):
    return _traverse(spark, d, 2)


@query(_traverse_sql(3))
def traverse_3hop(spark, d):
    return _traverse(spark, d, 3)


@query(
    f"""WITH t AS ({_traverse_sql(1).replace('SELECT query_id, CAST(hop AS INT) AS hop,', 'SELECT query_id, CAST(place AS INT) AS place, CAST(hop AS INT) AS hop,')}), {ENTITIES}
SELECT query_id, place, hop, a.name AS source, relation, b.name AS target FROM t JOIN entities a ON a.key = source_key JOIN entities b ON b.key = target_key"""
)
def path_table(spark, d):
    """What an answer walked, by names."""
    seeds = spark.sql("SELECT * FROM VALUES (1, 'location|france'), (1, 'team|supplier 000000001'), (2, 'product|part 7'), (3, 'organization|customer 000000005'), (3, 'nowhere|x') AS v(query_id, key)")
    entities = A.entities(spark, d)
    walked = graph.traverse(spool(A.fact_log(spark, d), "facts"), entities, seeds, 1)
    return views.path_table(walked, entities).select("query_id", "place", "hop", "source", "relation", "target")


@query(f"WITH {FACTS} SELECT CAST(6 AS BIGINT) AS documents, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM f) AS facts, (SELECT count(DISTINCT doc_id || k1) FROM f) AS elements")
def graph_stats(spark, d):
    facts = A.fact_log(spark, d)
    elements = facts.select(F.explode(F.transform("element_ids", lambda e: F.concat_ws(":", F.col("doc_id"), e))).alias("gid")).distinct()
    return graph.stats(facts.select("doc_id").distinct(), A.entities(spark, d), facts, elements)


@query(f"WITH {ENTITIES} SELECT key, name FROM (SELECT *, row_number() OVER (ORDER BY seq, key) AS i FROM entities) WHERE i <= 2000")
def known_entities(spark, d):
    return graph.known_entities(A.entities(spark, d)).select("key", "name")


@query(f"WITH {FACTS} SELECT doc_id || ':' || printf('p1e%03d', k1) AS gid, key FROM (SELECT DISTINCT doc_id, k1, unnest([s, o]) AS key FROM f)")
def mentioned_in(spark, d):
    """Which elements mention which entities, derived from facts."""
    return graph.mentions(A.fact_log(spark, d))


@query(f"WITH {ELEMENTS}, a AS (SELECT DISTINCT 'x' || item_id AS gid FROM benchmark UNION ALL SELECT DISTINCT CAST(item_id AS VARCHAR) || ':p1e000' FROM benchmark) SELECT gid FROM passages SEMI JOIN a USING (gid)")
def fetch_elements(spark, d):
    asked = A.table(spark, d, "benchmark").select(F.explode(F.array(F.concat(F.lit("x"), "item_id"), F.concat(F.col("item_id").cast("string"), F.lit(":p1e000")))).alias("gid"))
    return A.passages(A.table(spark, d, "documents")).join(asked, "gid", "left_semi").select("gid")


# --- retrieval ----------------------------------------------------------------------------------------------------
def _graph_ranking(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """A stand-in for traversal: the first five elements of the document that bears the question's number; the third id is no element."""
    return asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("gid", F.when(F.col("rank") == 3, "missing:p1e000").otherwise(F.concat(F.col("query_id").cast("string"), F.lit(":p1e00"), (F.col("rank") - 1).cast("string"))))


_FUSED = f"""{SCORES}, g AS (SELECT query_id, CAST(query_id AS VARCHAR) || ':p1e00' || CAST(k - 1 AS VARCHAR) AS gid, k AS rank FROM (SELECT query_id, unnest([1, 2, 4, 5]) AS k FROM q)),
u AS (SELECT query_id, gid, rank, 'graph' AS source FROM g WHERE gid IN (SELECT gid FROM passages) UNION ALL SELECT query_id, gid, rank, 'bm25' FROM r WHERE rank <= 24),
x AS (SELECT query_id, gid, sum(1.0 / (60 + rank)) AS score, array_to_string(list_reverse_sort(list(source)), '+') AS sources FROM u GROUP BY ALL)"""


@query(f"WITH {_FUSED} SELECT query_id, gid, round(score, 9) AS score, sources FROM x")
def rrf_fusion(spark, d):
    docs, asked = A.table(spark, d, "documents"), A.questions(A.table(spark, d, "benchmark"))
    passages = A.passages(docs)
    ranked = _graph_ranking(docs, asked).join(passages.select("gid"), "gid", "left_semi").select("query_id", F.lit("graph").alias("source"), "gid", "rank")
    lexical = search.Index.build(passages).search(asked, 24).select("query_id", F.lit("bm25").alias("source"), "gid", "rank")
    return search.fuse(ranked.union(lexical)).select("query_id", "gid", F.round("score", 9).alias("score"), F.array_join("sources", "+").alias("sources"))


@query(f"WITH {_FUSED} SELECT query_id, gid, CAST(rank AS INT) AS rank, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS rank FROM x) WHERE rank <= 8")
def hybrid_topk(spark, d):
    docs, asked = A.table(spark, d, "documents"), A.questions(A.table(spark, d, "benchmark"))
    passages = A.passages(docs)
    return search.hybrid(search.Index.build(passages), _graph_ranking(docs, asked), passages, asked).select("query_id", "gid", "rank", F.array_join("sources", "+").alias("sources"))


@query(
    "SELECT query_id, gid, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, gid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gid) AS rank FROM (SELECT b.vec_id AS query_id, CAST(a.vec_id AS VARCHAR) AS gid, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)) WHERE rank <= 10"
)
def vector_topk(spark, d):
    """The third ranking: cosine among vectors; queries are the vectors whose id is divisible by 100, against all."""
    v = A.table(spark, d, "embeddings")
    return search.vector_ranking(v.select(F.col("vec_id").cast("string").alias("gid"), F.col("embedding").alias("vector")), v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))


_CONTEXT_FACTS = "SELECT n_regionkey AS query_id, 1 AS hop, n_nationkey AS seq, n_name AS source, 'PART_OF' AS relation, r_name AS target, 'nation' AS doc_id, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(
    rf"""WITH f AS ({_CONTEXT_FACTS}), a AS (SELECT query_id, 'Facts from the knowledge graph:' || chr(10) || string_agg('- ' || source || ' PART_OF ' || target || '  (hop 1) [nation:p1e' || lpad(CAST(k AS VARCHAR), 3, '0') || ']', chr(10) ORDER BY seq) AS f FROM f GROUP BY 1),
b AS (SELECT r_regionkey AS query_id, 'Evidence:' || chr(10) || chr(10) || '[region:p1e' || lpad(CAST(r_regionkey AS VARCHAR), 3, '0') || '] (region, page 1)' || chr(10) || r_name AS e FROM region)
SELECT query_id, f || chr(10) || chr(10) || e AS context FROM a JOIN b USING (query_id)"""
)
def context_render(spark, d):
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    pad = lambda c: F.concat(F.lit("p1e"), F.lpad(c.cast("string"), 3, "0"))
    facts = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("query_id"), F.lit(1).alias("hop"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("source"), F.lit("PART_OF").alias("relation"), F.col("r_name").alias("target"), F.lit("nation").alias("doc_id"), F.array(pad(F.col("n_nationkey"))).alias("element_ids"))
    evidence = r.select(F.col("r_regionkey").alias("query_id"), F.lit(1).alias("rank"), F.concat(F.lit("region:"), pad(F.col("r_regionkey"))).alias("gid"), F.lit("region").alias("source_name"), F.lit(1).alias("page_number"), F.col("r_name").alias("text"))
    return answering.contexts(facts, evidence)


@query(
    r"""WITH a AS (SELECT item_id AS query_id, 'See [' || item_id || ':p1e000], [x:p9e999] and [' || item_id || ':p1e000] or [' || (item_id + 1) || ':p1e001]; not [bad].' AS text FROM benchmark),
k AS (SELECT item_id AS query_id, CAST(item_id AS VARCHAR) || ':p1e000' AS gid FROM benchmark WHERE item_id % 3 <> 0),
c AS (SELECT query_id, unnest(list_transform(list_sort(list_transform(list_distinct(x), lambda g: (list_position(x, g), g))), lambda p: p[2])) AS gid, unnest(range(len(list_distinct(x)))) AS i FROM (SELECT query_id, regexp_extract_all(text, '\[([A-Za-z0-9_.\-]+:p\d+e\d+)\]', 1) AS x FROM a))
SELECT c.query_id, coalesce(string_agg(c.gid, ' ' ORDER BY i) FILTER (k.gid IS NOT NULL), '') AS citations, coalesce(string_agg(c.gid, ' ' ORDER BY i) FILTER (k.gid IS NULL), '') AS dropped, count(k.gid) > 0 AS grounded FROM c LEFT JOIN k ON c.query_id = k.query_id AND c.gid = k.gid GROUP BY c.query_id"""
)
def validate_citations(spark, d):
    b = A.table(spark, d, "benchmark")
    n = F.col("item_id").cast("string")
    said = b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("See ["), n, F.lit(":p1e000], [x:p9e999] and ["), n, F.lit(":p1e000] or ["), (F.col("item_id") + 1).cast("string"), F.lit(":p1e001]; not [bad].")).alias("text"))
    known = b.filter("item_id % 3 <> 0").select(F.col("item_id").alias("query_id"), F.concat(n, F.lit(":p1e000")).alias("gid"))
    return answering.validate(said, known).select("query_id", F.array_join("citations", " ").alias("citations"), F.array_join("dropped", " ").alias("dropped"), "grounded")


_TURNS = "t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM t WHERE role = 'user')"


@query(f"WITH {_TURNS} SELECT a.conv_id, CAST(a.n AS INT) AS n, count(b.n) AS n_history, md5(coalesce(string_agg(b.question || chr(10) || coalesce(b.answer, ''), chr(10) ORDER BY b.n), '')) AS history_md5 FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 4 AND a.n - 1 GROUP BY ALL")
def history_window(spark, d):
    rows = answering.history(answering.turns(A.table(spark, d, "conversations")))
    said = F.transform("history", lambda h: F.concat(h["question"], F.lit("\n"), h["answer"]))
    return rows.select("conv_id", "n", F.size("history").cast("long").alias("n_history"), F.md5(F.array_join(said, "\n")).alias("history_md5"))


@query(f"WITH {_TURNS}, k AS (SELECT conv_id, n, {TOKENS('question')} AS names FROM u) SELECT a.conv_id, CAST(a.n AS INT) AS n, coalesce(array_to_string(b.names[1:3], ' '), '') AS carried FROM k a LEFT JOIN k b ON a.conv_id = b.conv_id AND b.n = a.n - 1")
def carried_seeds(spark, d):
    """The first three names of the turn before; here a question's terms stand for the names it found."""
    asked = answering.turns(A.table(spark, d, "conversations")).withColumn("names", T.tokens(F.col("question")))
    return answering.carried(asked).select("conv_id", "n", F.array_join("carried", " ").alias("carried"))


# --- batches ------------------------------------------------------------------------------------------------------
@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS stage, count(*) AS n_files, CAST(sum(user_id % 4) AS BIGINT) AS chunks_total, CAST(sum(CASE WHEN user_id % 4 > 1 THEN user_id % 4 - 1 ELSE user_id % 4 END) AS BIGINT) AS chunks_done,
  CAST(sum(CASE WHEN user_id % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_entities, CAST(sum(user_id % 3) AS BIGINT) AS n_facts, CAST(sum(user_id % 2) AS BIGINT) AS n_warnings FROM events GROUP BY 1"""
)
def outcome_table(spark, d):
    """Outcomes of files by stage: events as files, numbers from their user as what was made of each."""
    from quillstrata.operators.ingest import outcomes

    e = A.table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("doc_id"), "user_id")
    many = lambda n, *cols: e.select("doc_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))).alias("i")).select("doc_id", *cols)
    decoded = e.select(F.col("doc_id").alias("path"), "doc_id", F.col("doc_id").alias("source_name"), F.when(F.col("event_id") % 3 == 0, "broken").alias("error"))
    parts = {
        "chunks": many(F.col("user_id") % 4, F.when(F.col("i") == 2, "lost").alias("error")), "entities": many(F.col("user_id") % 4, F.lit("one").alias("key")),
        "facts": many(F.col("user_id") % 3), "warnings": many(F.col("user_id") % 2),
    }
    numbers = ("chunks_total", "chunks_done", "n_entities", "n_facts", "n_warnings")
    return outcomes(decoded, parts).groupBy("stage").agg(F.count("*").alias("n_files"), *(F.sum(c).alias(c) for c in numbers))


@query("SELECT CAST(sum(user_id) AS BIGINT) AS chunks_total, CAST(sum(user_id % 7) AS BIGINT) AS n_entities, CAST(sum(user_id % 5) AS BIGINT) AS n_facts, CAST(sum(user_id % 3) AS BIGINT) AS n_warnings FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def batch_totals(spark, d):
    """Sums over the files that succeeded: events of the first type."""
    from quillstrata.operators.ingest import totals

    e = A.table(spark, d, "events")
    done = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("ok")))).select(F.when(F.col("event_type") == F.col("ok"), "done").otherwise("failed").alias("stage"), F.col("user_id").alias("chunks_total"), (F.col("user_id") % 7).alias("n_entities"), (F.col("user_id") % 5).alias("n_facts"), (F.col("user_id") % 3).alias("n_warnings"))
    return totals(done)


@query()
def resolver_fold(spark, d):
    """Sequential resolution of names that vary in case and number: customers' segments seen again and again."""
    c = A.table(spark, d, "customer")
    found = c.select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("chunk_seq"), F.lit(0).alias("pos"),
        F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("name"), F.lit("Organization").alias("type"), F.array(F.concat(F.col("c_mktsegment"), F.lit(" inc"))).alias("aliases"),
    )
    found = found.withColumn("key", T.entity_key(F.col("name"), F.col("type")))
    return knowledge.resolve(found).groupBy("resolved_key").agg(F.count("*").alias("n"))


@query()
def laid_out_pages(spark, d):
    """The whole layout step over synthetic blocks: documents' lines as blocks of three pages, with running heads."""
    e = A.elements(A.table(spark, d, "documents"))
    page = (F.col("order") % 3 + 1).alias("page")
    y = F.floor(F.col("order") / 3) * 30 + 90
    size = F.when(F.length("text") % 7 == 0, 16.0).otherwise(11.0)
    lines = e.select("doc_id", F.col("order").alias("index"), page, G.box(F.when(F.col("order") % 2 == 0, 72).otherwise(320), y, F.when(F.col("order") % 2 == 0, 290).otherwise(540), y + 12).alias("bbox"), "text", size.alias("max_size"), F.lit(False).alias("is_bold"), F.lit(1).alias("line_count"), F.lit("text").alias("kind"), "table", "image")
    heads = e.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")).select("doc_id", (100_000 + F.col("page")).alias("index"), "page", G.box(F.lit(72), F.lit(20), F.lit(300), F.lit(30)).alias("bbox"), F.concat(F.lit("Report part "), F.col("page").cast("string")).alias("text"), F.lit(9.0).alias("max_size"), F.lit(False).alias("is_bold"), F.lit(1).alias("line_count"), F.lit("text").alias("kind"), F.lit(None).cast(e.schema["table"].dataType).alias("table"), F.lit(None).cast(e.schema["image"].dataType).alias("image"))
    pages = e.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return layout.elements(lines.unionByName(heads), pages).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


# --- sources ------------------------------------------------------------------------------------------------------
def _markdown(spark, d):
    """Documents as Markdown files: a title, and each line that isn't blank a paragraph of plain words."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9\n]+", " ")
    body = F.concat(F.lit("# Title "), F.col("doc_id"), F.lit("\n\n"), F.replace(words, F.lit("\n"), F.lit("\n\n")))
    return A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat("doc_id", F.lit(".md")).alias("name"), body.cast("binary").alias("content"))


_MARKDOWN = """w AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\\n]+', ' ', 'g') AS t FROM documents),
f AS (SELECT doc_id, sha256('# Title ' || doc_id || chr(10) || chr(10) || replace(t, chr(10), chr(10) || chr(10)))[1:16] AS document, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS ls FROM w)"""


@query(
    f"""WITH {_MARKDOWN} SELECT document, 'heading' AS type, CAST(1 AS BIGINT) AS n, CAST(length('Title ' || doc_id) AS BIGINT) AS chars FROM f
UNION ALL SELECT document, 'paragraph', CAST(len(ls) AS BIGINT), CAST(list_sum(list_transform(ls, lambda x: length(trim(x)))) AS BIGINT) FROM f WHERE len(ls) > 0"""
)
def decoded_markdown(spark, d):
    """Files through format detection, the decoder registry and the Markdown decoder to the element table."""
    found = files.elements(files.decode_all(_markdown(spark, d)))
    return found.groupBy(F.col("doc_id").alias("document"), "type").agg(F.count("*").alias("n"), F.sum(F.length(T.strip(F.col("text")))).alias("chars"))


@query(f"WITH {_MARKDOWN} SELECT document, CAST(doc_id AS VARCHAR) || '.md' AS source_name, 1 + len(ls) AS n_elements FROM f")
def stored_documents(spark, d):
    """The document store: everything written, half of it twice, and read back by the report."""
    store = files.DocumentStore(spark, f"{shared_dir(spark)}/quillstrata/{uuid.uuid4().hex}/store")
    decoded = spool(files.decode_all(_markdown(spark, d)), "decoded")
    store.put(decoded.filter(F.col("path").cast("bigint") % 2 == 0))
    store.put(decoded)
    return store.report().select(F.col("doc_id").alias("document"), "source_name", "n_elements")


@query(f"WITH {FACTS} SELECT s AS source_key, relation, o AS target_key, doc_id, array_to_string(list(DISTINCT printf('p1e%03d', k1) ORDER BY printf('p1e%03d', k1)), ',') AS element_ids FROM f GROUP BY ALL")
def stored_graph(spark, d):
    """The graph store: a batch applied twice changes nothing; facts as the logs fold."""
    store = graph.GraphStore(spark, f"{shared_dir(spark)}/quillstrata/{uuid.uuid4().hex}/graph")
    facts = spool(A.fact_log(spark, d), "facts")
    docs = facts.groupBy("doc_id").agg(F.min("seq").alias("seq"))
    elements = facts.select("seq", F.concat_ws(":", "doc_id", F.col("element_ids")[0]).alias("gid"))
    for batch in (1, 2):
        store.apply(batch, docs, A.entity_log(spark, d), facts, elements)
    return store.facts().select("source_key", "relation", "target_key", "doc_id", F.array_join(F.array_sort("element_ids"), ",").alias("element_ids"))


@query(f"WITH {_MARKDOWN} SELECT document, CAST(doc_id AS VARCHAR) || '.md' AS name FROM f")
def streamed_contents(spark, d):
    """Files that arrive in a folder as a stream, each content once: the files are written twice under different names."""
    from quillstrata.streaming import ingest as streaming

    root = f"{shared_dir(spark)}/quillstrata/{uuid.uuid4().hex}"
    spool_files = _markdown(spark, d).select("name", F.col("content").cast("string").alias("value"))
    found: list[DataFrame] = []
    source = spool_files.unionByName(spool_files)
    source.write.parquet(f"{root}/arrived")
    rows = spark.readStream.schema("name string, value string").parquet(f"{root}/arrived")
    once = streaming.each_content_once(rows.select(F.col("name").alias("path"), "name", F.col("value").cast("binary").alias("content")))

    def keep(batch: DataFrame, number: int) -> None:
        found.append(spool(batch.select(ids.document_id(F.col("content")).alias("document"), "name"), "arrived"))

    streaming.ingest_stream(once, keep, f"{root}/checkpoint").awaitTermination()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
