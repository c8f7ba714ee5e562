"""The edit log as a stream: the fold of ``operators.edits`` with its state in a store, so that a stopped query goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import edits

#: transformWithState keeps maps in this store only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXT = T.StructType([T.StructField("text", T.StringType())])
_LINES = T.StructType([T.StructField("lines", T.ArrayType(T.StringType()))])
_KEY = T.StructType([T.StructField("key", T.StringType())])
_ORDER = T.StructType([T.StructField("seq", T.LongType()), T.StructField("sub", T.IntegerType())])


class EditFold(StatefulProcessor):
    """State of a paper: the texts of its composed lines, the lines inserted behind each, and the order of the last operation folded."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", _KEY, _TEXT)
        self.lines = handle.getMapState("lines", _KEY, _LINES)
        self.last = handle.getValueState("last", _ORDER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        found = sorted((int(r.seq), int(r.sub), r.op, r.anchor, int(r.place), r.text) for part in rows for r in part.itertuples(index=False))
        last = tuple(self.last.get()) if self.last.exists() else (-(1 << 63), 0)
        before = last
        for seq, sub, op, anchor, place, text in found:
            if (seq, sub) <= before:
                continue
            last = (seq, sub)
            if op == edits.PRUNE:
                for (other,), (kept,) in list(self.lines.iterator()):
                    self._put(other, edits.step(list(kept), op, place if other == anchor else -1, ""))
            elif op == edits.INSERT or place >= 0:
                now = list(self.lines.getValue((anchor,))[0]) if self.lines.containsKey((anchor,)) else None
                self._put(anchor, edits.step(now, op, place, text))
            else:
                self.texts.updateValue((anchor,), (text if op == edits.SET else "",))
        self.last.update(last)
        rows_out = [(key[0], last[0], "edit", k, 0, t) for (k,), (t,) in self.texts.iterator()]
        rows_out += [(key[0], last[0], "insert", k, n, t) for (k,), (ts,) in self.lines.iterator() for n, t in enumerate(ts)]
        yield pd.DataFrame(rows_out, columns=["paper_id", "seq", "kind", "key", "ord", "text"])

    def _put(self, anchor: str, lines: list[str] | None) -> None:
        if lines:
            self.lines.updateValue((anchor,), (lines,))
        elif self.lines.containsKey((anchor,)):
            self.lines.removeKey((anchor,))

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    """Have the session keep streaming state where ``edit_stream`` needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def edit_stream(log: DataFrame) -> DataFrame:
    """(paper_id, seq, kind, key, ord, text): after each batch, the whole state of every paper that it touched; of a paper's states the one with the greatest seq holds. For output mode update.

    ``log(paper_id, seq, op, key, text, other)`` as in ``operators.edits.fold``, to which the last states are equal. Rows of a batch are folded in the order of seq; rows at or
    before the last one folded are repeats of a log that is read again and change nothing, so seq has to rise from batch to batch. An operation touches one anchor's
    state, a prune those of its paper. Call ``use_store`` first. Odd rows: as in ``operators.edits.operations``.
    """
    ops = edits.operations(log)
    spec = f"paper_id {ops.schema['paper_id'].dataType.simpleString()}, seq long, kind string, key string, ord int, text string"
    return ops.groupBy("paper_id").transformWithStateInPandas(EditFold(), outputStructType=spec, outputMode="Update", timeMode="None")
