"""Benchmark decontamination over a stored positional inverted index, in DataFrame operations only.

The index is a table of postings (row, term, position) in the shared folder, written from one pass over the
training texts without a shuffle; behind each text's last word stands the empty word, whose position is the text's length.
`terms` may restrict it to a test vocabulary: postings of other terms can't take part in
a match.  A phrase search starts at the rarest terms of each window: their postings, less the offset of the term, name the
diagonal (row, item, first position) on which the item would lie.  Only stretches of a diagonal, two windows long, in which the
two rarest lists of a window agree are intersected with the lists of the item's other terms there, however long the item.  Common
terms are so never expanded by themselves, and every join key holds a row's position, so a frequent passage is spread over as many
keys as rows hold it.

Defined results: null or empty texts have no words and no hits; very long texts are indexed whole; repeated rows are answered one by
one, rows that share a doc_id but not the text likewise; of equally rare terms those that come first in the item are taken; an item without
words is never found; items with one id count once; an empty table gives an empty result, an empty benchmark leaves all clean; extra
columns are ignored, and kept by `clean`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import NOT_WORD, ascii_lower, fresh, row_key, small, split_words, spool

WINDOW = 13
#: A test vocabulary of up to so many terms (some 100 MB) is broadcast; beyond it the joins shuffle.
BROADCAST_TERMS = 1_000_000


def term_list(text):
    return split_words(ascii_lower(text), NOT_WORD)


@dataclass
class PositionalIndex:
    """postings: doc_id, k (row key), pos, term (xxhash64 of the term)."""

    postings: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, terms: DataFrame | None = None) -> PositionalIndex:
        """terms: one column, term, without repeats; None indexes every term."""
        listed = F.concat(term_list(F.col("text")), F.array(F.lit("")))
        words = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.posexplode(listed).alias("pos", "word"))
        if terms is not None:
            wanted = terms.select(F.col("term").alias("word")).union(docs.sparkSession.range(1).select(F.lit("").alias("word")))
            words = words.join(small(wanted, BROADCAST_TERMS), "word")
        return cls(spool(words.select("doc_id", "k", "pos", F.xxhash64("word").alias("term")), "postings"))

    def lengths(self) -> DataFrame:
        """doc_id, k, n_words of each row."""
        return self.postings.filter(F.col("term") == F.xxhash64(F.lit(""))).select("doc_id", "k", F.col("pos").cast("long").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("tf"))

    def phrases(self, items: DataFrame, window: int = WINDOW) -> DataFrame:
        """items: entry, words.  A row for each occurrence of a window (window consecutive words of an item; a shorter item whole): doc_id, k, entry, start, size."""
        items = items.filter(F.size("words") > 0)
        item_terms = items.select("entry", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")).withColumn("term", F.xxhash64("word")).drop("word")
        size = F.least(F.col("n"), F.lit(window))
        known = item_terms.join(self.frequencies(), "term")
        # every window that holds the term: first word s in [off - size + 1, off]
        windows = known.select("entry", "term", "off", "tf", size.alias("size"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - size + 1), F.least(F.col("off"), F.col("n") - size))).alias("s"))
        rarest = windows.groupBy("entry", "s").agg(F.sort_array(F.collect_list(F.struct("tf", "off", "term"))).alias("by"), F.first("size").alias("size"))
        rarest = rarest.filter(F.size("by") == F.col("size"))  # a term that the corpus lacks rules its windows out
        anchors = rarest.select("entry", "size", F.explode(F.slice("by", 1, 2)).alias("a")).select("entry", "size", F.col("a.off").alias("off"), F.col("a.term").alias("term")).distinct()
        anchors, item_terms = small(anchors, BROADCAST_TERMS), small(item_terms, BROADCAST_TERMS)
        near = self.postings.join(anchors, "term").withColumn("diag", F.col("pos") - F.col("off"))
        # a window lies in one of the stretches (cell - 1) * size .. (cell + 1) * size of its item
        near = near.withColumn("cell", F.explode(F.array((F.col("off") / F.col("size")).cast("int"), (F.col("off") / F.col("size")).cast("int") + 1)))
        near = near.groupBy("doc_id", "k", "entry", "diag", "cell").agg(F.min("off").alias("lo"), F.max("off").alias("hi"), F.first("size").alias("size"))
        stretches = near.filter((F.col("lo") != F.col("hi")) | (F.col("size") == 1)).select("doc_id", "k", "entry", "diag", "size", F.explode(F.expr("sequence(greatest((cell - 1) * size, 0), (cell + 1) * size - 1)")).alias("off"))
        asked = stretches.join(item_terms.select("entry", "off", "term"), ["entry", "off"]).select("doc_id", "k", "entry", "diag", "size", "off", "term", (F.col("diag") + F.col("off")).alias("pos")).filter("pos >= 0").distinct()
        have = self.postings.select(F.col("doc_id").alias("d"), F.col("k").alias("h"), F.col("pos").alias("p"), F.col("term").alias("t"))
        met = asked.join(have, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("h")) & (F.col("pos") == F.col("p")) & (F.col("term") == F.col("t")))
        met = met.groupBy("doc_id", "k", "entry", "diag").agg(F.sort_array(F.collect_set("off")).alias("offs"), F.first("size").alias("size"))
        runs = met.filter(F.size("offs") >= F.col("size")).withColumn(
            "starts", F.expr("filter(transform(sequence(0, size(offs) - size), i -> if(offs[i + size - 1] - offs[i] = size - 1, offs[i], -1)), s -> s >= 0)")
        )
        return runs.select("doc_id", "k", "entry", "size", F.explode(F.expr("transform(starts, s -> s + diag)")).alias("start"))

    def near(self, first: str, second: str, slop: int) -> DataFrame:
        """Proximity: positions of the two terms in one row, no more than slop words apart: doc_id, k, a, b.

        Positions are dealt into cells of slop + 1 words, so only neighbouring cells of one row meet."""
        cell = F.floor(F.col("pos") / (slop + 1))
        one = self.postings.filter(F.col("term") == F.xxhash64(F.lit(first))).select("doc_id", "k", F.col("pos").alias("a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
        two = self.postings.filter(F.col("term") == F.xxhash64(F.lit(second))).select(F.col("doc_id").alias("d"), F.col("k").alias("h"), F.col("pos").alias("b"), cell.alias("c")).distinct()
        on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("h")) & (F.col("cell") == F.col("c"))
        return one.join(two, on).filter((F.abs(F.col("a") - F.col("b")) <= slop) & (F.col("a") != F.col("b"))).select("doc_id", "k", "a", "b")


def item_entries(benchmark: DataFrame) -> DataFrame:
    """entry (hash of id and words), item_id, words: repeated rows once."""
    rows = benchmark.select("item_id", term_list(F.col("text")).alias("words")).distinct()
    return rows.select(F.xxhash64("item_id", F.to_json(F.struct("words"))).alias("entry"), "item_id", "words")


def hits(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, k, n_hit, item_ids (sorted strings) of the rows that hold a window of an item (entry, item_id, words)."""
    found = index.phrases(items, window).join(small(items.select("entry", "item_id"), BROADCAST_TERMS), "entry")
    words = found.select("doc_id", "k", "item_id", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
    one = words.groupBy("doc_id", "k", "pos").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    return one.groupBy("doc_id", "k").agg(F.count("*").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, k, n_words, n_hit, item_ids, contaminated, for each row of docs."""
    items = item_entries(benchmark)
    index = PositionalIndex.build(docs, items.select(F.explode("words").alias("term")).distinct())
    found = hits(index, items, window).select(F.col("doc_id").alias("d"), F.col("k").alias("h"), "n_hit", "item_ids")
    base = index.lengths()
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "k", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns kept."""
    key, bad_id, bad_key = fresh(docs, "row_key"), fresh(docs, "bad_id"), fresh(docs, "bad_key")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("k").alias(bad_key)).distinct()
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of query op1."""
    c = contamination(docs, benchmark)
    return c.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dw AS (
  SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
