"""Self-join of texts by Jaccard similarity of their word n-grams, with adaptive prefixes of several matches.

1. Shingles are 48-bit hashes of SIZE lower-cased words.  Their document frequencies are counted over the whole corpus (packed.py;
   texts with one set in one bundle count once).  A text that shares fewer shingles with any others than a link
   takes is done.
2. The shingles of each other text are ordered by frequency, rarest first.  If two sets share c shingles, the prefixes of
   |set| - c + l shingles share at least l.  Each text chooses its own l: a longer prefix means more postings to read and fewer
   candidates to verify; both are estimated from the frequencies.  A pair is a candidate if its prefixes, as long as both sizes
   ask for, share the smaller of both l.
3. Texts with equal sets are one vertex.  Pairs inside a large group of near copies are not listed: first every vertex
   is verified against two others that lead its postings, which finds most groups; then only postings that hold vertices of
   different components are joined, in blocks; every candidate across components is verified.  So a link that
   isn't verified joins two vertices that are known to be in one component, and the components are exact.

Defined results: a null text or one without words has an empty set and no link; one with fewer than SIZE words has its whole
sequence as its only shingle; a very long text is one set, whole in one task; rows that repeat are copies of each other; component_id is
the least doc_id of the component, null ids aside, so ties don't arise; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm import packed
from quillstrata.llm.common import discard, fresh, give_back, lean, row_key, small, spool
from quillstrata.llm.components import components

SIZE, PERCENT = 5, 80
#: Rows of a block of one posting list.
BLOCK = 256
#: Shared prefix shingles that a text may ask for.
MOST_MATCHES = 32
#: Pairs that one copy of a vertex's set serves; vertices of more pairs are looked up by a broadcast of so many rows at most.
SHARE, BROADCAST_ROWS = 2048, 200_000
#: Cost of verifying a candidate for each of its shingles, in postings read.
VERIFY = 0.1
_BITS = 48


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 48-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = packed.word_hashes(words)
    n = min(size, len(words))
    return np.unique(packed.Windows(hashes).at(np.arange(len(words) - n + 1), n) >> np.uint64(64 - _BITS))


class _Bundle:
    def __init__(self, texts: list[str | None], size: int) -> None:
        self.sets: list[np.ndarray] = []
        self.keys: list[bytes] = []
        for t in texts:  # one text at a time: its words are gone before the next comes
            found = shingles(t, size)
            self.sets.append(found)
            self.keys.append(hashlib.blake2b(found.tobytes(), digest_size=8).digest())
        seen: dict[bytes, int] = {}
        for i, k in enumerate(self.keys):
            seen.setdefault(k, i)
        self.own = sorted(seen.values())
        joined = np.concatenate([self.sets[i] for i in self.own]) if self.own else np.zeros(0, np.uint64)
        self.fps, self.place, self.counts = np.unique(joined, return_inverse=True, return_counts=True)
        self.cuts = np.concatenate([[0], np.cumsum([len(self.sets[i]) for i in self.own])])


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any set that it links to, at least."""
    return -(-n * percent // 100)


def choose(df: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(l, prefix) for the frequencies, ascending, of the set's shared shingles; the n - len(df) unshared ones stand before them.

    prefix counts shared shingles only.  It must do for partners of any size; what it costs is estimated for one of the same size."""
    alone = n - len(df)
    reads = np.concatenate([[0], np.cumsum(df.astype(np.float64) - 1)])
    ls = np.arange(1, min(MOST_MATCHES, least_overlap(n, percent)) + 1)
    like = np.clip(n - -(-2 * n * percent // (100 + percent)) + ls - alone, 0, len(df))
    l = int(ls[np.argmin(reads[like] * (1 + VERIFY * n / ls))])  # noqa: E741
    return l, int(np.clip(n - least_overlap(n, percent) + l - alone, 0, len(df)))


KIND = "n_shingles bigint, v bigint, alone int, l int, prefix array<bigint>, shared binary"


def sets_table(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, v (hash of the set); for the first text of each candidate set in a bundle also l, prefix and shared (its shingles that other sets have)."""
    n_b = packed.n_bundles(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(packed.bundle_of(n_b, "doc_id", "text").alias("bundle"), "doc_id", "text")

    def count(table: pa.Table) -> pa.Table:
        b = _Bundle(table.column("text").to_pylist(), size)
        return packed.send(table.column("bundle")[0].as_py(), b.fps, b.counts, n_b, _BITS)

    def prefixes(table: pa.Table, back: pa.Table) -> pa.Table:
        totals, _ = packed.received(back)
        b = _Bundle(table.column("text").to_pylist(), size)
        n = len(b.sets)
        alone: list[int | None] = [None] * n
        ls: list[int | None] = [None] * n
        pre: list[np.ndarray | None] = [None] * n
        shared: list[bytes | None] = [None] * n
        for k, i in enumerate(b.own):
            df = totals[b.place[b.cuts[k] : b.cuts[k + 1]]]
            often = df > 1
            m = int(often.sum())
            if m == 0 or m < least_overlap(len(df), percent):
                continue
            toks, df = b.sets[i][often], df[often]
            order = np.lexsort((toks, df))
            ls[i], p = choose(df[order], len(b.sets[i]), percent)
            pre[i] = toks[order[:p]].astype(np.int64)
            alone[i], shared[i] = len(b.sets[i]) - m, packed.squeeze_sorted(toks)
        return pa.table(
            {"doc_id": table.column("doc_id"), "n_shingles": pa.array([len(s) for s in b.sets], pa.int64()), "v": pa.array([int.from_bytes(k, "little", signed=True) for k in b.keys], pa.int64()), "alone": pa.array(alone, pa.int32()), "l": pa.array(ls, pa.int32()), "prefix": pa.array(pre, pa.list_(pa.int64())), "shared": pa.array(shared, pa.binary())}
        )

    grouped = rows.groupBy("bundle")
    back = packed.add_up(grouped.applyInArrow(lean(count), packed.SENT), n_b, _BITS)
    return grouped.cogroup(back.groupBy("bundle")).applyInArrow(lean(prefixes), f"doc_id {kind}, {KIND}")


def with_sets(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """pairs with n<side> and s<side>, size and shingles of one of their vertices.  A vertex of many pairs (one that leads a large group)
    is copied, once for each SHARE of them, so that its pairs are dealt over many tasks."""
    copies = F.ceil(F.col("count") / SHARE).cast("int").alias("copies")
    many = small(pairs.groupBy(side).count().select(side, copies).filter("copies > 1"), BROADCAST_ROWS)
    dealt = pairs.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    held = sets.select(F.col("v").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("shared").alias(f"s{side}"))
    copied = held.join(many, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return dealt.join(copied, [side, "salt"]).drop("salt")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the pairs that link; sets: v, n_shingles, shared, one row for each v.  pairs are read several times: spool them."""
    met = with_sets(with_sets(pairs.select("a", "b"), "a", sets), "b", sets).select("a", "b", "na", "nb", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for i, (b, na, nb, sa, sb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "na", "nb", "sa", "sb")), strict=True)):
                if b != last:
                    last, held = b, packed.expand_sorted(sb)
                mine = packed.expand_sorted(sa)
                at = np.minimum(np.searchsorted(held, mine), len(held) - 1)
                both = int((held[at] == mine).sum())
                if 100 * both >= percent * (na + nb - both):
                    keep.append(i)
            if keep:
                yield pa.record_batch([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], ["a", "b"])
        give_back()

    return met.mapInArrow(check, "a bigint, b bigint")


def leaders(postings: DataFrame) -> DataFrame:
    """a, b: each vertex with up to two vertices that lead lists it is in: the commonest lead, and one drawn by hash.

    A list is led by the vertex with the fewest shingles of its own: of the copies of a text, one that was hardly edited, to which most others link."""
    edited = F.floor(F.log2(F.col("alone") + 1))
    heads = postings.groupBy("tok").agg(F.count("*").alias("n"), F.min_by("v", F.struct("alone", "v")).alias("first"), F.min_by("v", F.struct(edited, F.xxhash64("v", "tok"))).alias("drawn")).filter("n > 1")
    met = postings.select("tok", "v").join(heads, "tok")
    per = met.select("v", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("first").alias("lead")), F.struct(F.lit(2).alias("kind"), F.col("drawn").alias("lead")))).alias("h")).filter("v <> h.lead")
    counted = per.groupBy("v", "h").agg(F.count("*").alias("n"))
    best = counted.groupBy("v", "h.kind").agg(F.max(F.struct("n", F.xxhash64("v", "h.lead").alias("o"), "h.lead")).alias("m"))
    return best.select(F.least("v", "m.lead").alias("a"), F.greatest("v", "m.lead").alias("b")).distinct()


def across(vertices: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: candidates among vertices (v, n_shingles, alone, l, prefix, root) of different components.

    Sets of x and y shingles that link share at least percent / (100 + percent) (x + y), which shortens both prefixes the more, the larger the
    partner: the shingle at place p counts only with partners of up to `most` = (100 + percent) / percent (x + l - 1 - p) - x shingles.  Vertices
    for which no other in the list is small enough leave it; those that stay meet in blocks."""
    n = F.col("n_shingles")
    most = (F.expr(f"(n_shingles + l - 1 - alone - i) * {100 + percent} div {percent}") - n).cast("int")
    lists = vertices.select("v", n.cast("int").alias("n"), "l", "alone", "root", F.posexplode("prefix").alias("i", "tok"), F.col("n_shingles")).withColumn("most", most)
    lists = lists.select("tok", "v", "root", "n", "l", "most").filter(100 * F.col("most") >= percent * F.col("n"))
    mixed = lists.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).filter("lo <> hi").select("tok", "least")
    able = lists.join(mixed, "tok").filter("most >= least").drop("least")
    again = able.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("tok", "size")
    chunk = F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / BLOCK))
    blocks = able.join(again, "tok").groupBy("tok", chunk.alias("chunk")).agg(F.ceil(F.first("size") / BLOCK).alias("chunks"), F.collect_list(F.struct("v", "root", "n", "l", "most")).alias("xs"))
    blocks = spool(blocks, "blocks")
    # a long list's pairs of blocks are dealt by its second block
    other = blocks.select("tok", F.col("chunk").alias("chunk2"), F.col("xs").alias("ys"))
    met = blocks.withColumn("chunk2", F.explode(F.expr("sequence(chunk, chunks - 1)"))).join(other, ["tok", "chunk2"]).select((F.col("chunk") == F.col("chunk2")).alias("same"), "xs", "ys")

    def fields(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        flat = column.flatten()
        return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), {k: flat.field(k).to_numpy() for k in ("v", "root", "n", "l", "most")}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xb, x), (yb, y) = fields(batch.column("xs")), fields(batch.column("ys"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k, same in enumerate(batch.column("same").to_pylist()):
                i, j = slice(xb[k], xb[k + 1]), slice(yb[k], yb[k + 1])
                fits = (x["root"][i, None] != y["root"][None, j]) & (x["most"][i, None] >= y["n"][None, j]) & (y["most"][None, j] >= x["n"][i, None])
                if same:
                    fits &= x["v"][i, None] < y["v"][None, j]
                a, b = np.nonzero(fits)
                if len(a):
                    va, vb = x["v"][i][a], y["v"][j][b]
                    out.append((np.minimum(va, vb), np.maximum(va, vb), np.minimum(x["l"][i][a], y["l"][j][b])))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "need"])
        give_back()

    found = met.mapInArrow(pairs, "a bigint, b bigint, need int")
    out = spool(found.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need").select("a", "b"), "candidates")
    discard(blocks)
    return out


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    table = spool(sets_table(docs, size, percent), "sets")
    least = table.groupBy("v").agg(F.min("doc_id").alias("rep"))
    held = table.filter(F.col("shared").isNotNull())
    sets = spool(held.dropDuplicates(["v"]), "vertices")  # rows of one set are alike, whichever bundle they come from
    postings = sets.select("v", "alone", F.explode("prefix").alias("tok"))
    star = spool(leaders(postings), "star")
    found = components(verify(star, sets, percent))
    vertices = sets.select("v", "n_shingles", "alone", "l", "prefix").join(found, "v", "left").withColumn("root", F.coalesce("root", "v"))
    met = across(vertices, percent)
    more = spool(met.join(star, ["a", "b"], "left_anti"), "more")
    # the components so far are stars around their roots
    final = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")).union(verify(more, sets, percent)))
    known = least.join(final, "v", "left").withColumn("root", F.coalesce("root", "v"))
    label = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_v = known.join(label, "root").select("v", "component_id")
    out = table.select("doc_id", "n_shingles", "v").join(by_v, "v")
    done = spool(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "classes")
    discard(table, sets, star, found, met, more, final)
    return done


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op2."""
    return classes(docs)


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, of least doc_id, null ids last; all columns kept, whatever their names.

    Rows are told apart by id and text, so a row falls only for its own text; of rows that repeat both, the one stays whose other columns
    come first as JSON.  Rows without words have no component and all stay."""
    key, gone = fresh(docs, "row_key"), fresh(docs, "gone_id")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    kind = f"struct<nil:boolean,id:{docs.schema['doc_id'].dataType.simpleString()},k:bigint>"  # fields that may be null, as Arrow gives them back
    whole = keyed.select(F.struct(F.col("doc_id").isNull(), "doc_id", key).cast(kind).alias("doc_id"), "text")
    found = classes(whole, size, percent).filter("n_shingles > 0")
    drop = found.filter("doc_id <> component_id").select(F.col("doc_id.id").alias(gone), F.col("doc_id.k").alias(key)).distinct()
    often = found.groupBy(F.col("doc_id.id").alias(gone), F.col("doc_id.k").alias(key)).count().filter("count > 1").drop("count")
    same = lambda a, b: (a[key] == b[key]) & a["doc_id"].eqNullSafe(b[gone])
    kept = keyed.join(drop, same(keyed, drop), "left_anti")
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    twice = kept.join(often, same(kept, often), "left_semi")
    first = twice.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias(gone)) if rest else twice.select("doc_id", "text").distinct()
    one = first.select("doc_id", "text", *(F.col(f"{gone}.`{c}`").alias(c) for c in rest)).select(*docs.columns)
    return kept.join(often, same(kept, often), "left_anti").select(*docs.columns).union(one)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT y, c FROM r JOIN l ON r.v = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = w.doc_id
"""
