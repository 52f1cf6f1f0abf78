"""Batch streams between senders and a reader, and fragments: plans with named inputs and outputs."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import exchange
from tessera.sources import scratch


class StoredBatches:
    """Record batches of a sender that the executors wrote; the driver has their place alone.

    Each row of the stored table is one batch of at most ``rows`` rows in Arrow's stream format."""

    def __init__(self, df: DataFrame, rows: int = 10_000):
        self.schema: pa.Schema = df.limit(0).toArrow().schema
        self._spark, self._rows_schema = df.sparkSession, df.schema
        self.path = scratch.path(df.sparkSession, "batches")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(at, rows))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

        df.mapInArrow(pack, "batch binary").write.parquet(self.path)

    def _stored(self) -> DataFrame:
        return self._spark.read.schema("batch binary").parquet(self.path)

    def rows(self) -> DataFrame:
        """All rows of the batches, read where they lie."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    yield from pa.ipc.open_stream(data.as_buffer())

        return self._stored().mapInArrow(unpack, self._rows_schema)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The batches at the driver, one partition of the stored table at a time."""
        for r in self._stored().toLocalIterator():
            for batch in pa.ipc.open_stream(bytes(r["batch"])):
                yield pa.RecordBatch.from_arrays(batch.columns, schema=self.schema)


class BatchStream:
    """Record batches from declared senders. It ends when every one of them has closed; the first failure wins, and
    no order is kept between senders. Pushing never waits."""

    def __init__(self, schema: pa.Schema, senders: list[str]):
        if not senders:
            raise ValueError("at least one sender must be declared")
        self.schema, self._open, self._known = schema, set(senders), set(senders)
        self._held: deque[pa.RecordBatch | StoredBatches] = deque()
        self._error: Exception | None = None
        self._changed = threading.Condition()

    def push(self, sender: str, batch: pa.RecordBatch | StoredBatches) -> None:
        with self._changed:
            if sender not in self._open:
                raise ValueError(f"{sender} is {'closed' if sender in self._known else 'not declared'}")
            if batch.schema != self.schema:
                raise ValueError("the batch has another schema")
            if self._error is None:
                self._held.append(batch)
                self._changed.notify_all()

    def close(self, sender: str) -> None:
        with self._changed:
            if sender not in self._known:
                raise ValueError(f"{sender} is not declared")
            self._open.discard(sender)
            self._changed.notify_all()

    def fail(self, error: Exception) -> None:
        with self._changed:
            self._error = self._error or error
            self._changed.notify_all()

    @property
    def ended(self) -> bool:
        return self._error is None and not self._open and not self._held

    def try_pull(self) -> pa.RecordBatch | StoredBatches | None:
        """What was pushed next if there is something; the failure as an error."""
        with self._changed:
            if self._error is not None:
                raise self._error
            return self._held.popleft() if self._held else None

    def wait(self, seconds: float | None = None) -> bool:
        """Until there is a batch, an end or a failure; False if time runs out."""
        with self._changed:
            return self._changed.wait_for(lambda: self._held or self._error is not None or not self._open, seconds)

    def drain(self, seconds: float | None = None) -> Iterator[pa.RecordBatch | StoredBatches]:
        """All that is pushed, to the end."""
        while True:
            if not self.wait(seconds):
                raise TimeoutError("the stream has not ended")
            batch = self.try_pull()
            if batch is None and self.ended:
                return
            if batch is not None:
                yield batch

    def table(self, seconds: float | None = None) -> pa.Table:
        """All batches to the end, at the driver."""
        found = []
        for batch in self.drain(seconds):
            found += batch.batches() if isinstance(batch, StoredBatches) else [batch]
        return pa.Table.from_batches(found, self.schema)


def stream_source(spark: SparkSession, stream: BatchStream, seconds: float | None = None) -> DataFrame:
    """The rows of a stream, once it has ended; stored batches are read by the executors."""
    found = list(stream.drain(seconds))
    stored = [b for b in found if isinstance(b, StoredBatches)]
    held = [b for b in found if not isinstance(b, StoredBatches)]
    parts = [b.rows() for b in stored]
    if held or not stored:
        parts.append(spark.createDataFrame(pa.Table.from_batches(held, stream.schema)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Fragment:
    """A plan over named inputs; each output is dealt to its consumers by a mode and keys.

    ``relay_from`` makes an output of one fragment an input of another: Spark plans both as stages of one job."""

    def __init__(self, plan: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]):
        self._plan, self._inputs, self._given = plan, {}, {}
        self._outputs: dict[str, tuple[str, list[str] | None, int]] = {}
        self._built: dict[str, DataFrame] | None = None

    def declare_input(self, name: str, schema: str) -> None:
        self._inputs[name] = schema

    def declare_output(self, name: str, mode: str = "local", keys: list[str] | None = None, consumers: int = 1) -> None:
        if mode not in exchange.MODES:
            raise ValueError(f"mode must be one of {exchange.MODES}")
        if mode in ("hash", "crc32", "range") and not keys:
            raise ValueError(f"{mode} needs keys")
        self._outputs[name] = (mode, keys, consumers)

    def feed(self, name: str, rows: DataFrame) -> None:
        if name not in self._inputs:
            raise ValueError(f"input {name} is not declared")
        wanted = rows.sparkSession.createDataFrame([], self._inputs[name]).schema
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in wanted]:
            raise ValueError(f"input {name} has another schema")
        self._given[name] = rows

    def relay_from(self, name: str, other: Fragment, output: str, consumer: int = 0) -> None:
        self.feed(name, other.run()[output][consumer])

    def build(self) -> None:
        if missing := sorted(set(self._inputs) - set(self._given)):
            raise ValueError(f"inputs {missing} are not fed")
        self._built = self._plan(dict(self._given))
        if missing := sorted(set(self._outputs) - set(self._built)):
            raise ValueError(f"the plan has no outputs {missing}")

    def run(self) -> dict[str, list[DataFrame]]:
        """By output, what each of its consumers gets."""
        if self._built is None:
            self.build()
        return {name: exchange.routed(self._built[name], mode, n, keys) for name, (mode, keys, n) in self._outputs.items()}
