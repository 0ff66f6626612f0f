"""Steps counted by worker in the state store, so a stream that starts again goes on counting where it stopped."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Keyed state of several variables needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the queries that start inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Steps(StatefulProcessor):
    """Numbers the rows of each worker in the given order inside of a batch, after those of earlier batches, and keeps the worker's last row."""

    def __init__(self, order: Sequence[str], fields: Sequence[str]) -> None:
        self.order, self.fields = list(order), list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("step", "step long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step = self.state.get()[0] if self.state.exists() else 0
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            step += 1
            yield Row(**{c: row[c] for c in self.fields}, step=step)
        self.state.update((step,))

    def close(self) -> None:
        pass


class _Cursor(StatefulProcessor):
    """Keeps the greatest cursor of each worker, and gives it whenever it has moved."""

    def __init__(self, cursor: str, keys: Sequence[str]) -> None:
        self.cursor, self.keys = cursor, list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursor", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get()[0] if self.state.exists() else None
        latest = max((r[self.cursor] for r in rows if r[self.cursor] is not None), default=None)
        if latest is not None and (before is None or latest > before):
            self.state.update((latest,))
            yield Row(**dict(zip(self.keys, key)), **{self.cursor: latest})

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, worker: str, order: Sequence[str]) -> DataFrame:
    """The rows with step, the number of each among its worker's rows, from 1 over all batches. What a task holds is one worker's rows of one batch."""
    schema = StructType.fromDDL("step long")
    return stream.groupBy(worker).transformWithState(_Steps(order, stream.columns), StructType([*stream.schema, *schema]), "Append", "None")


def last_cursors(stream: DataFrame, keys: Sequence[str], cursor: str) -> DataFrame:
    """The greatest cursor of each key that a batch has moved: keys and cursor."""
    found = StructType([*stream.select(*keys).schema, *StructType.fromDDL(f"{cursor} long")])
    return stream.groupBy(*keys).transformWithState(_Cursor(cursor, keys), found, "Append", "None")
