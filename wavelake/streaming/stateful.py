"""Operators with state per stream: chunks of a fixed count, and processors that carry on where the last batch ended."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.recurrences import KINDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = "stream_id long, chunk_no long, n int, data array<double>"
SAMPLES = "stream_id long, pos long, sample double"


def use_rocksdb(spark) -> None:  # noqa: ANN001
    """Stateful processors need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, bool]:
    """A batch's samples by position, and whether it says that the stream ends: by a true ``eos``, whose row needs no sample."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values("pos", kind="stable")
    return rows[rows["sample"].notna()], bool("eos" in rows and rows["eos"].fillna(False).any())


class Chunker(StatefulProcessor):
    """Samples of a stream, by position, to chunks of ``size``; n tells how many samples a chunk has. What is left over
    is kept. At the end of the stream, or when nothing has come for ``idle`` milliseconds, it is padded with zeros."""

    def __init__(self, size: int, idle: int = 0) -> None:
        self.size, self.idle = size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "data array<double>")
        self.done = handle.getValueState("done", "n long")

    def flushed(self, key: tuple) -> pd.DataFrame:
        """The chunk that is left over, if any, as the next one."""
        rest, done = (list(self.rest.get()[0]) if self.rest.exists() else []), self.done.get()[0] if self.done.exists() else 0
        self.rest.update(([],))
        self.done.update((done + (len(rest) > 0),))
        data = [rest + [0.0] * (self.size - len(rest))] if rest else []
        return pd.DataFrame({"stream_id": pd.Series([key[0]] * len(data)), "chunk_no": done, "n": len(rest), "data": pd.Series(data, dtype=object)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield self.flushed(key)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        kept = list(self.rest.get()[0]) if self.rest.exists() else []
        done = self.done.get()[0] if self.done.exists() else 0
        part, ended = _ordered(rows)
        data = np.array(kept + part["sample"].tolist(), float)
        n = len(data) // self.size
        self.rest.update((data[n * self.size :].tolist(),))
        self.done.update((done + n,))
        if n:
            parts = [data[i * self.size : (i + 1) * self.size].tolist() for i in range(n)]
            yield pd.DataFrame({"stream_id": key[0], "chunk_no": np.arange(done, done + n), "n": self.size, "data": parts})
        if ended:
            yield self.flushed(key)
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def close(self) -> None:
        pass


class Processed(StatefulProcessor):
    """Samples of a stream, by position, through a processor of ``KINDS``, whose state lives between batches. At the end of the stream ``tail`` frames of silence let it ring out."""

    def __init__(self, kind: str, params: dict, tail: int = 0) -> None:
        self.kind, self.params, self.tail = kind, params, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary")
        self.last = handle.getValueState("last", "pos long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        processor = KINDS[self.kind](1, **self.params)
        if self.state.exists():
            processor.__dict__.update(pickle.loads(bytes(self.state.get()[0])))
        part, ended = _ordered(rows)
        pos = part["pos"].to_numpy(np.int64)
        last = pos[-1] if len(pos) else self.last.get()[0] if self.last.exists() else -1
        tail = self.tail if ended else 0
        x = np.concatenate([part["sample"].to_numpy(float), np.zeros(tail)])
        out = processor.process(x[None, :])[0] if len(x) else x
        self.state.update((pickle.dumps(processor.__dict__),))
        self.last.update((int(last),))
        yield pd.DataFrame({"stream_id": key[0], "pos": np.concatenate([pos, last + 1 + np.arange(tail)]), "sample": out})

    def close(self) -> None:
        pass


def chunked(stream: DataFrame, size: int, idle: int = 0) -> DataFrame:
    """stream: SAMPLES, and eos where ends are told. CHUNK rows as soon as they are full, the last one at the end."""
    return stream.groupBy("stream_id").transformWithStateInPandas(Chunker(size, idle), CHUNK, "Append", "ProcessingTime" if idle else "None")


def processed(stream: DataFrame, kind: str, tail: int = 0, **params: float) -> DataFrame:
    """stream: SAMPLES in order between batches, and eos where ends are told. The same samples as one call over the whole stream, and its tail, gives."""
    return stream.groupBy("stream_id").transformWithStateInPandas(Processed(kind, params, tail), SAMPLES, "Append", "None")
