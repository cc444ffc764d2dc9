"""Streams: files that arrive in a folder, and conversations turn by turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from quillstrata.operators.answering import CARRIED, HISTORY


def new_contents(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content, checksum of files as they arrive, each content once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(path)
    return each_content_once(rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def each_content_once(rows: DataFrame) -> DataFrame:
    """path, name, content of a stream, with checksum, each content once.

    The state holds checksums, not files, of all that ever came: it has no bound but what arrives (about 100 bytes a file, on disk with
    the RocksDB store), as a copy may come at any time."""
    return rows.select("path", "name", "content", F.sha2("content", 256).alias("checksum")).dropDuplicates(["checksum"])


def ingest_stream(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `each` (an ingest_batch over a micro-batch and its number) on what has arrived, then stops.  Batches come one at a time, so the entity registry has one writer."""
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TURN_STATE = "n long, question string, answer string, names array<string>"
TURN_OUT = "conv_id bigint, n bigint, question string, history array<struct<question:string,answer:string>>, carried array<string>"
TURN_COLUMNS = ["conv_id", "n", "question", "history", "carried"]


class Conversation(StatefulProcessor):
    """Keeps the last turns of a conversation; each new one sees them and the names that the one before found."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", TURN_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = list(self.turns.get()) if self.turns.exists() else []
        new = pd.concat(list(rows)).sort_values("turn")
        out = []
        for _, r in new.iterrows():
            n = kept[-1][0] + 1 if kept else 1
            carried = list(kept[-1][3] or [])[:CARRIED] if kept else []
            out.append((key[0], n, r["question"], [{"question": k[1], "answer": k[2]} for k in kept[-HISTORY:]], carried))
            kept = [*kept, (n, r["question"], r["answer"], list(r["names"]))][-HISTORY:]
        if kept:
            self.turns.put(kept)
        yield pd.DataFrame(out, columns=TURN_COLUMNS)

    def close(self) -> None:
        pass


def conversation_stream(turns: DataFrame) -> DataFrame:
    """A streaming frame conv_id, turn, question, answer, names to TURN_OUT.  Needs the RocksDB state store."""
    return turns.groupBy("conv_id").transformWithStateInPandas(Conversation(), TURN_OUT, "Append", "None")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Progress(StreamingQueryListener):
    """Calls back with (rows so far, rows of the last batch)."""

    def __init__(self, told: Callable[[int, int], None]) -> None:
        self.told, self.rows = told, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.told(self.rows, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
