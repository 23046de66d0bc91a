"""Token windows of streams of documents: what a batch leaves over is kept in the state and goes on in the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolith.functions.patterns import STRIDE
from chronolith.operators.tokens import Tokenizer, word_ids
from chronolith.streaming.tail import drain, session_conf

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Packer(StatefulProcessor):
    """Windows of stride + 1 ids at every `stride` ids of a key's stream.

    State: the ids behind the last window's beginning, as a list of (date, ids) in order, and how many windows were made.
    The last id of a window is the first of the next one. What a batch holds of a key is sorted here, so it has to fit one
    task: the source's bound on a batch (maxFilesPerTrigger, maxBytesPerTrigger) is the bound of a key's rows.
    """

    def __init__(self, keys: list[str], order: list[str], date: str, stride: int):
        self.keys, self.order, self.date, self.stride = keys, order, date, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "date bigint, ids array<int>")
        self.made = handle.getValueState("made", "windows bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        kept = [(int(d), np.asarray(ids, np.int32)) for d, ids in self.tail.get()]
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        pieces = kept + [(int(d), np.asarray(ids, np.int32)) for d, ids in zip(new[self.date], new["ids"], strict=True)]
        ids = np.concatenate([x for _, x in pieces])
        dates = np.repeat([d for d, _ in pieces], [len(x) for _, x in pieces])
        n = max(0, (len(ids) - 1) // self.stride)
        first = self.made.get()[0] if self.made.exists() else 0
        rest = [(d, x) for d, x in _split(pieces, n * self.stride) if len(x)]
        if rest:
            self.tail.put([(d, x.tolist()) for d, x in rest])
        else:
            self.tail.clear()
        self.made.update((first + n,))
        if not n:
            return
        at = np.arange(n) * self.stride
        # round() of a quotient of whole numbers: half to even, as for whole windows
        means = [round(int(dates[a : a + self.stride].sum()) / self.stride) for a in at]
        yield pd.DataFrame({**{c: [v] * n for c, v in zip(self.keys, key, strict=True)}, "window_no": first + np.arange(n, dtype=np.int64), "tokens": pd.Series([ids[a : a + self.stride + 1].tolist() for a in at], dtype=object), self.date: np.array(means, np.int64)})

    def close(self) -> None:
        pass


def _split(pieces: list[tuple[int, np.ndarray]], at: int) -> Iterator[tuple[int, np.ndarray]]:
    """The pieces without their first `at` ids."""
    for date, ids in pieces:
        yield date, ids[at:]
        at = max(0, at - len(ids))


def packed_stream(stream: DataFrame, keys: list[str], order: list[str], out: str, text: str = "text", date: str = "created_utc", tokenizer: Tokenizer = word_ids, end: int = 0, stride: int = STRIDE) -> None:
    """Reads what is there of `stream` and appends its whole windows to the table at `out`; run again, it goes on.

    The table has keys, window_no, tokens and the date of token_windows(), and the batch that made them. Rows of a key have to
    come in order from batch to batch; inside a batch they are sorted by `order`.
    """
    spark = stream.sparkSession
    rows = stream.select(*keys, *order, *[c for c in [date] if c not in order], F.concat(tokenizer(F.col(text)), F.array(F.lit(end))).alias("ids"))
    kinds = ", ".join(f"`{c}` {dict(stream.dtypes)[c]}" for c in keys)
    schema = f"{kinds}, window_no bigint, tokens array<int>, `{date}` bigint"
    with session_conf(spark, ROCKSDB):
        made = rows.groupBy(*keys).transformWithStateInPandas(Packer(keys, order, date, stride), schema, "append", "none")
        drain(made, out, "append")


def packed_windows(spark: SparkSession, out: str) -> DataFrame:
    """The windows that the stream has made so far."""
    return spark.read.parquet(out).drop("batch")
