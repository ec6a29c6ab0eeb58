"""A sink that sends each chunk to a service once, whatever tasks and jobs are repeated."""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

Send = Callable[[list[str]], str]
Find = Callable[[list[str]], str | None]


class Ledger:
    """Small JSON files in a shared folder that tell what was begun and what was sent.

    Tasks reach it by URI (file, hdfs and what else Arrow opens), as the folder has to be the
    same for all executors.  A file is written aside and moved when it is whole.
    """

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path, recursive=True)
        return store, path

    def read(self, name: str) -> dict | None:
        store, path = self._open()
        try:
            with store.open_input_stream(f"{path}/{name}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, name: str, content: dict) -> None:
        store, path = self._open()
        aside = f"{path}/_{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps(content).encode())
        store.move(aside, f"{path}/{name}.json")


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent: (chunk, items, answer)."""

    chunks: list[tuple[int, int, str]]


class ChunkWriter(DataSourceWriter):
    """Writes the rows (chunk, item) of a task, which come sorted by chunk."""

    def __init__(self, ledger: Ledger, send: Send, find: Find):
        self.ledger, self.send, self.find = ledger, send, find

    def write(self, iterator: Iterator[Row]) -> Sent:
        return Sent([(chunk, len(ids := [r["item"] for r in rows]), self.once(chunk, ids)) for chunk, rows in itertools.groupby(iterator, key=lambda r: r["chunk"])])

    def once(self, chunk: int, ids: list[str]) -> str:
        digest = hashlib.sha256(json.dumps(ids).encode()).hexdigest()
        for state in ("sent", "begun"):
            known = self.ledger.read(f"{state}-{chunk}")
            if known is not None and known["digest"] != digest:
                raise ValueError(f"chunk {chunk} was another one when it was {state}")
            if known is not None and state == "sent":
                return known["answer"]
        # Begun and not known as sent: only the receiver can tell whether the call came through.
        answer = self.find(ids) if known is not None else None
        if answer is None:
            self.ledger.write(f"begun-{chunk}", {"digest": digest})
            answer = self.send(ids)
        self.ledger.write(f"sent-{chunk}", {"digest": digest, "chunk": chunk, "n_items": len(ids), "answer": answer})
        return answer

    def commit(self, messages: list[Sent | None]) -> None:
        sent = [c for m in messages if m is not None for c in m.chunks]
        self.ledger.write("committed", {"chunks": len(sent), "items": sum(n for _, n, _ in sent)})

    def abort(self, messages: list[Sent | None]) -> None:
        """Nothing is taken back: the ledger stays, and a repeated job goes on from it."""


def chunk_sink(short_name: str, send: Send, find: Find) -> type[DataSource]:
    """A data source to register: `df.write.format(short_name).mode("append").option("ledger", uri).save()`."""

    class Chunks(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return "chunk long, item string"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return ChunkWriter(Ledger(self.options["ledger"]), send, find)

    return Chunks


def send_once(batches: DataFrame, send: Send, find: Find, ledger: str, key: str = "provider_track_id", order: str = "ordinal") -> DataFrame:
    """Send each batch of `batches` (batch, key, order) once; (batch, n_items, snapshot_id).

    Before a call the ledger says that it is begun, and after it what was answered.  A task
    or job that is repeated leaves out what was sent; of a call that was begun and not
    recorded `find` asks the receiver, which gives its answer if the items are there, else
    None.  So a batch is sent again only if it did not arrive.  Attempts of one task must not
    run at the same time: leave speculation off for this job.  Driver memory holds three
    values for each batch.
    """
    spark = batches.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    spark.dataSource.register(chunk_sink(name, send, find))
    rows = batches.repartition("batch").sortWithinPartitions("batch", order).select(F.col("batch").cast("long").alias("chunk"), F.col(key).cast("string").alias("item"))
    rows.write.format(name).mode("append").option("ledger", ledger).save()
    if batches.isEmpty():
        return spark.createDataFrame([], "batch long, n_items long, snapshot_id string")
    return spark.read.schema("chunk long, n_items long, answer string").json(f"{ledger.rstrip('/')}/sent-*.json").toDF("batch", "n_items", "snapshot_id")
