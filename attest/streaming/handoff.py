"""Handoffs as a Spark data source: tasks send them, several at a time, and each goes out once."""

import hashlib
import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..ship import ship

log = logging.getLogger(__name__)


class Ledger:
    """Keys of what went out, as empty files of a folder that pyarrow reaches."""

    def __init__(self, path: str):
        self.store, self.root = pyarrow.fs.FileSystem.from_uri(path) if urlparse(path).scheme else (pyarrow.fs.LocalFileSystem(), path)

    def _at(self, key: str | None) -> str:
        name = hashlib.sha256(str(key).encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}"

    def has(self, key: str | None) -> bool:
        return self.store.get_file_info(self._at(key)).type != pyarrow.fs.FileType.NotFound

    def enter(self, key: str | None) -> None:
        at = self._at(key)
        self.store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.store.open_output_stream(at).close()


@dataclass
class Sent(WriterCommitMessage):
    """What a task did with its rows."""

    sent: int = 0
    known: int = 0
    failed: int = 0


class HandoffWriter(DataSourceWriter, DataSourceStreamWriter):
    """Sends rows that the ledger does not have and enters those that went out.

    `write` runs in tasks. A row's key is entered right after it was sent, so a task that is run
    again, or a batch that is replayed after a crash, sends only what is missing; between a send
    and its entry lies the one moment in which a crash makes a second send possible. A send that
    fails is logged and not entered, and is tried again when the batch is replayed.
    """

    def __init__(self, send: Callable[[Row], bool], ledger: str, key: str, concurrency: int):
        self.send, self.ledger, self.key, self.concurrency = send, ledger, key, concurrency

    def write(self, iterator: Iterator[Row]) -> Sent:
        ledger, done = Ledger(self.ledger), Sent()

        def one(row: Row) -> str:
            if ledger.has(row[self.key]):
                return "known"
            if not self.send(row):
                return "failed"
            ledger.enter(row[self.key])
            return "sent"

        with ThreadPoolExecutor(self.concurrency) as pool:
            for what in bounded(pool, one, iterator, 4 * self.concurrency):
                setattr(done, what, getattr(done, what) + 1)
        return done

    def commit(self, messages: list[Sent | None], batchId: int | None = None) -> None:
        own = [m for m in messages if m is not None]
        log.info("handoffs of batch %s: %d sent, %d known, %d failed", batchId, *(sum(getattr(m, k) for m in own) for k in ("sent", "known", "failed")))

    def abort(self, messages: list[Sent | None], batchId: int | None = None) -> None:
        log.error("handoffs of batch %s were broken off", batchId)


def bounded(pool: ThreadPoolExecutor, do: Callable, rows: Iterator, most: int) -> Iterator:
    """Results in order, with at most so many rows taken ahead."""
    waiting = []
    for row in rows:
        waiting.append(pool.submit(do, row))
        if len(waiting) >= most:
            yield waiting.pop(0).result()
    for future in waiting:
        yield future.result()


def register(spark: SparkSession, send: Callable[[Row], bool], ledger: str, name: str = "handoff", key: str = "message_id", concurrency: int = 4) -> str:
    """Makes `df.write.format(name)` and `df.writeStream.format(name)` hand rows over with `send`.

    send returns whether it worked, such as `ChatwootHandoff(...).send`; it is pickled. The ledger is a
    folder that all executors share, with an empty file for each key that went out. Rows need the
    column `key`; of rows with one key in a task, later ones may go out beside the first, so keys
    should be told apart before.
    """
    ship(spark)

    class Handoff(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> HandoffWriter:
            return HandoffWriter(send, ledger, key, concurrency)

        def streamWriter(self, schema, overwrite: bool) -> HandoffWriter:
            return HandoffWriter(send, ledger, key, concurrency)

    spark.dataSource.register(Handoff)
    return name
