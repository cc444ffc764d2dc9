"""Reading files into the element tables, and the document store.

Decoding runs in Arrow batches of one Python function for each file; a file that fails is a row with an error.  `files` takes a
folder through Spark's binaryFile source, `uploaded` takes rows (name, data)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import ids
from quillstrata.schemas import DECODED
from quillstrata.sources.detect import SUFFIXES, suffix


#: The columns of schemas.DECODED.
COLUMNS = ("doc_id", "source_name", "mime", "checksum", "title", "meta", "error", "pages", "elements", "blobs", "warnings")


def files(spark: SparkSession, path: str, known_only: bool = True) -> DataFrame:
    """path, name, content of all files below a folder.  Order by path where order matters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return rows.filter(suffix(F.col("name")).isin(*SUFFIXES)) if known_only else rows


def samples(spark: SparkSession, *folders: str) -> DataFrame:
    """path, name, length of the files in the given folders that a decoder takes; their contents aren't read."""
    rows = spark.read.format("binaryFile").load(list(folders)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return rows.filter(suffix(F.col("name")).isin(*SUFFIXES))


def uploaded(spark: SparkSession, given: list[tuple[str, bytes]]) -> DataFrame:
    """path, name, content of bytes at hand."""
    return spark.createDataFrame([(n, n, bytearray(d)) for n, d in given], "path string, name string, content binary")


def decode_all(rows: DataFrame) -> DataFrame:
    """path and the columns of schemas.DECODED."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quillstrata.sources.decode import decode

        for frame in frames:
            yield pd.DataFrame([{"path": p, **decode(n, bytes(c))} for p, n, c in zip(frame["path"], frame["name"], frame["content"], strict=True)], columns=["path", *COLUMNS])

    # files are large and few: small batches bound a worker's memory
    return rows.select("path", "name", "content").mapInPandas(run, f"path string, {DECODED}")


def documents(decoded: DataFrame) -> DataFrame:
    """One row for each content, the first path's name."""
    good = decoded.filter(F.col("error").isNull())
    kept = good.groupBy("doc_id").agg(F.min_by(F.struct("source_name", "mime", "checksum", "title", "meta", F.size("pages").alias("page_count")), "path").alias("d"))
    return kept.select("doc_id", "d.*")


def pages(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull()).dropDuplicates(["doc_id"]).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def elements(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull()).dropDuplicates(["doc_id"]).select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*")


def blobs(decoded: DataFrame) -> DataFrame:
    rows = decoded.filter(F.col("error").isNull()).dropDuplicates(["doc_id"]).select("doc_id", F.explode("blobs").alias("b")).select("doc_id", "b.*")
    return rows.filter(ids.safe_blob_ref(F.col("ref")))


def warnings(decoded: DataFrame) -> DataFrame:
    """Decoders' warnings, and a row for each file that failed."""
    told = decoded.select("doc_id", "source_name", F.explode("warnings").alias("w")).select("doc_id", "source_name", "w.*")
    failed = decoded.filter(F.col("error").isNotNull()).select("doc_id", "source_name", F.lit(None).cast("string").alias("element_id"), F.lit("parse_failed").alias("code"), F.col("error").alias("detail"))
    return told.unionByName(failed)


def canonical_json(row: Column) -> Column:
    """A struct as JSON with sorted keys, nulls kept, indented by two, not escaped, a newline at the end: the same bytes for the same content."""

    @F.pandas_udf("string")
    def write(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: json.dumps(json.loads(t), sort_keys=True, indent=2, ensure_ascii=False) + "\n")

    return write(F.to_json(row, {"ignoreNullFields": "false"}))


class DocumentStore:
    """Tables below a folder, partitioned by the first two digits of doc_id.  Writing the same content again changes nothing."""

    TABLES = ("documents", "pages", "elements", "blobs")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def read(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.root}/{name}").drop("shard")
        except AnalysisException:
            return None

    def put(self, decoded: DataFrame) -> DataFrame:
        """Appends the documents that aren't there yet; returns their ids.  The document row is written last, so a half-written document is written again."""
        known = self.read("documents")
        new = decoded.filter(F.col("error").isNull())
        new = new if known is None else new.join(known.select("doc_id"), "doc_id", "left_anti")
        ids_ = documents(new).select("doc_id")
        for name, make in (("pages", pages), ("elements", elements), ("blobs", blobs), ("documents", documents)):
            make(new).withColumn("shard", F.substring("doc_id", 1, 2)).repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{self.root}/{name}")
        return ids_

    def get(self, doc_id: str) -> dict[str, DataFrame]:
        """The tables' rows of one document; only its shard is read."""
        return {n: self.spark.read.parquet(f"{self.root}/{n}").filter((F.col("shard") == doc_id[:2]) & (F.col("doc_id") == doc_id)).drop("shard") for n in self.TABLES}

    def exists(self, doc_id: str) -> bool:
        known = self.read("documents")
        return known is not None and not known.filter(F.col("doc_id") == doc_id).isEmpty()

    def ids(self) -> DataFrame:
        return self.read("documents").select("doc_id").orderBy("doc_id")

    def report(self) -> DataFrame:
        """doc_id, source_name, page_count, n_elements."""
        n = self.read("elements").groupBy("doc_id").agg(F.count("*").alias("n_elements"))
        return self.read("documents").select("doc_id", "source_name", "page_count").join(n, "doc_id", "left").na.fill(0, ["n_elements"])
