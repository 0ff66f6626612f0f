"""Python functions over rows: parallel maps, outside judges, cascades of retries, a registry of datasets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict[str, Any]


class Registry:
    """DataFrame factories by name."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, factory: Callable[..., DataFrame]) -> None:
        self._factories[name] = factory

    def make(self, name: str, *args: Any) -> DataFrame:
        if name not in self._factories:
            raise KeyError(f"no dataset {name!r}; there are {', '.join(self.names())}")
        return self._factories[name](*args)

    def names(self) -> list[str]:
        return sorted(self._factories)


def parallel_map(rows: DataFrame, f: Callable[[Row], Row | None], schema: str) -> DataFrame:
    """f of every row as a dict, in Arrow batches, so nulls stay None and whole numbers whole; rows for which it gives None are dropped."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for x in map(f, batch.to_pylist()) if x is not None], kinds)

    return rows.mapInArrow(run, schema)


def with_retries(call: Callable[[str], str], prompt: str, tries: int = 3, wait: float = 1.0, longest: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """What a call returns, or its last error; before each retry the wait doubles up to the longest."""
    error = None
    for k in range(tries):
        try:
            return call(prompt), None
        except Exception as e:  # whatever a client raises is a failed try
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                sleep(min(wait * 2**k, longest))
    return None, error


def judged(rows: DataFrame, key: str, prompt: str, call: Callable[[str], str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """key, verdict and error of each row; a failed judge says false."""
    kind = rows.schema[key].dataType.simpleString()

    def one(row: Row) -> Row:
        reply, error = with_retries(call, row[prompt], tries, wait)
        return {key: row[key], "verdict": (reply or "").strip().lower() == "true", "error": error}

    return parallel_map(rows, one, f"{key} {kind}, verdict boolean, error string")


def cascade(ways: dict[str, Callable[[Row], str | None]], key: str) -> Callable[[Row], Row]:
    """A function from a row to its key and the name of the first way that gives an output."""
    return lambda row: {key: row[key], "way": next((name for name, f in ways.items() if f(row)), None)}
