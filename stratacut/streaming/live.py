"""Edit events: bursts, and the state that they lead to; pictures as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType


def bursts(edits: DataFrame, gap: str = "400 milliseconds") -> DataFrame:
    """One row for each burst of a session's edits: gaps under ``gap``; start, last event's time, count and last value.

    Works on tables and streams. A stream needs its watermark set before: an edit that is late by more than it is dropped, one that
    is late by less joins its burst; a burst comes out once the watermark has passed its end.
    """
    last = F.struct("ts", "event_id")
    return edits.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"), F.max_by("value", last).alias("last_value")).drop("w")


def folded(edits: DataFrame) -> DataFrame:
    """(session_id, layer_id, toggles, threshold, color): state after the session's last reset.

    Last value of thresholds and colours, and 1 for a hidden layer (an odd number of toggles).
    """
    live = _after_reset(edits).where(F.col("setting").isin("toggle", "threshold", "color", "blur"))
    of = lambda s: F.when(F.col("setting") == s, F.struct("ts", "event_id"))
    return live.groupBy("session_id", "layer_id").agg((F.count_if(F.col("setting") == "toggle") % 2).alias("hidden"), F.max_by("value", of("threshold")).alias("threshold"), F.max_by("value", of("color")).alias("color"))


DEFAULT_LAYERS = 4


def settings(edits: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """(session_id, mode, n_layers) after the session's last reset: realistic and 4 by default; a layer count sets the number, and so
    does switching to cartoon (value 1), to the session's estimate (session_id, n_colors) if there is one. The last of them counts."""
    every = edits.select("session_id").distinct()
    if estimates is None:
        estimates = every.select("session_id", F.lit(None).cast("int").alias("n_colors"))
    live = _after_reset(edits).join(estimates, "session_id", "left")
    counts = (F.col("setting") == "layers") | (F.col("setting") == "mode") & (F.col("value") == 1) & F.col("n_colors").isNotNull()
    order = F.struct("ts", "event_id")
    found = live.groupBy("session_id").agg(
        F.max_by("value", F.when(F.col("setting") == "mode", order)).alias("mode"),
        F.max_by(F.when(F.col("setting") == "layers", F.col("value")).otherwise(F.col("n_colors")), F.when(counts, order)).alias("n"),
    )
    mode = F.when(F.col("mode") == 1, "cartoon").otherwise("realistic")
    return every.join(found, "session_id", "left").select("session_id", mode.alias("mode"), F.coalesce("n", F.lit(DEFAULT_LAYERS)).cast("int").alias("n_layers"))


def layer_state(edits: DataFrame, presets: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """(session_id, layer_id, n_layers, upper, color, hidden): every layer of every session's state.

    Limits and colours are those of ``presets`` (n_layers, layer_id, upper, color) for the session's number of layers, and the last
    edits of them since the last layer count or reset; limits are held between 1 and 254, and layers 0 and 1 share theirs.
    """
    own = settings(edits, estimates)
    order = F.struct("ts", "event_id")
    live = _after_reset(edits)
    since = live.where("setting = 'layers'").groupBy("session_id").agg(F.max(order).alias("s"))
    edited = live.where(F.col("setting").isin("threshold", "color")).join(since, "session_id", "left").where(F.col("s").isNull() | (order > F.col("s")))
    limit = edited.where("setting = 'threshold'").withColumn("layer_id", F.explode(F.when(F.col("layer_id") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("layer_id"))))
    limit = limit.groupBy("session_id", "layer_id").agg(F.max_by(F.least(F.lit(254), F.greatest(F.lit(1), F.col("value"))), order).alias("limit"))
    shade = edited.where("setting = 'color'").groupBy("session_id", "layer_id").agg(F.max_by("value", order).alias("shade"))
    toggles = live.where("setting = 'toggle'").groupBy("session_id", "layer_id").agg((F.count("*") % 2).alias("hidden"))
    every = own.join(F.broadcast(presets), "n_layers")
    for more in (limit, shade, toggles):
        every = every.join(more, ["session_id", "layer_id"], "left")
    return every.select("session_id", "layer_id", "n_layers", "mode", F.coalesce("limit", "upper").cast("int").alias("upper"), F.coalesce(F.concat(F.lit("#"), F.lpad(F.hex("shade"), 6, "0")), "color").alias("color"), F.coalesce("hidden", F.lit(0)).cast("long").alias("hidden"))


def _after_reset(edits: DataFrame) -> DataFrame:
    resets = edits.where("setting = 'reset'").groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("r"))
    return edits.where("setting <> 'reset'").join(resets, "session_id", "left").where(F.col("r").isNull() | (F.struct("ts", "event_id") > F.col("r"))).drop("r")


STATE = "session_id long, layer_id int, hidden long, threshold int, color int"


class _Session(StatefulProcessor):
    """A session's outcome: last reset, last value a layer and setting, parity of toggles a layer, and the toggles the watermark hasn't passed.

    Nothing older than the watermark arrives, so a toggle that it has passed can only be undone by a later reset, with all others of its
    layer: it is folded into the parity. What is kept grows with layers and with the edits of the time that may be late, not with
    the session.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reset = handle.getValueState("reset", "at long, event_id long")
        self.last = handle.getMapState("last", "layer_id int, setting string", "at long, event_id long, value int")
        self.parity = handle.getMapState("parity", "layer_id int", "odd int, at long, event_id long")
        self.open = handle.getMapState("open", "at long, event_id long", "layer_id int")

    def _fold(self, watermark: int) -> None:
        for (at, event), (layer,) in sorted(self.open.iterator()):
            if at < watermark:
                odd = self.parity.getValue((layer,))[0] if self.parity.containsKey((layer,)) else 0
                self.parity.updateValue((layer,), (1 - odd, at, event))
                self.open.removeKey((at, event))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        left = [at for (at, _), _ in self.open.iterator()]
        if left:  # again once the watermark has passed the first of them
            self.handle.registerTimer(min(left) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        touched = set()
        reset = self.reset.get() if self.reset.exists() else (-(1 << 62), -1)
        edits = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for ts, event, setting, layer, value in edits[["ts", "event_id", "setting", "layer_id", "value"]].itertuples(index=False, name=None):
            at = (ts.value // 1000, int(event))
            if at <= tuple(reset):
                continue
            if setting == "reset":
                reset = at
                self.reset.update(reset)
                for kept in (self.last, self.parity):
                    for k in [k for k, v in kept.iterator() if tuple(v[:2] if kept is self.last else v[1:]) < reset]:
                        kept.removeKey(k)
                for k in [k for k, _ in self.open.iterator() if tuple(k) < reset]:
                    self.open.removeKey(k)
                continue
            touched.add(int(layer))
            if setting == "toggle":
                self.open.updateValue(at, (int(layer),))
            elif not self.last.containsKey((int(layer), setting)) or tuple(self.last.getValue((int(layer), setting))[:2]) < at:
                self.last.updateValue((int(layer), setting), (*at, int(value)))
        self._fold(watermark)
        opened = [layer for _, (layer,) in self.open.iterator()]
        known = {k: v[2] for k, v in self.last.iterator()}
        odd = {k[0]: v[0] for k, v in self.parity.iterator()}
        held = {k[0] for k in known} | set(odd) | set(opened)
        out = [(key[0], k, (odd.get(k, 0) + opened.count(k)) % 2, known.get((k, "threshold")), known.get((k, "color"))) for k in sorted(touched & held)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")]).astype({"session_id": "int64", "layer_id": "int32", "hidden": "int64", "threshold": "Int32", "color": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._fold(timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def streamed_state_with_resets(edits: DataFrame, late: str = "1 day"):
    """The state of each session as a stream, resets and all: rows of the layers that a batch's edits have touched.

    Edits late by more than ``late`` are dropped; others find their place in time. The stream needs RocksDB as its state store.
    """
    typed = edits.select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "setting", F.col("layer_id").cast("int").alias("layer_id"), F.col("value").cast("int").alias("value"))
    return typed.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(_Session(), STATE, "Update", "EventTime")


def streamed_state(edits: DataFrame) -> DataFrame:
    """The same as a stream without resets: one aggregate by session and layer, for complete or update mode."""
    of = lambda s: F.when(F.col("setting") == s, F.struct("ts", "event_id"))
    return edits.groupBy("session_id", "layer_id").agg((F.sum(F.when(F.col("setting") == "toggle", 1).otherwise(0)) % 2).alias("hidden"), F.max_by("value", of("threshold")).alias("threshold"), F.max_by("value", of("color")).alias("color"))


def arriving(pixels: DataFrame, work: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Run ``work`` on each batch of arriving pictures (whole pictures in a batch); its rows are the partition ``batch`` of ``table``.

    A batch that is run again after a failure overwrites its own partition, so that it counts once.
    """
    return pixels.writeStream.foreachBatch(batch_writer(work, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(work: Callable[[DataFrame], DataFrame], table: str) -> Callable[[DataFrame, int], None]:
    """Writes the outcome of a batch to the partition of its number alone, with an empty one if there is none."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return batch


def judged(edits: DataFrame, late: str, table: str, checkpoint: str):
    """Replay edits, and write each with ``accepted``: whether it is no later than ``late`` behind the latest edit of the batches before its own.

    The watermark that a batch is judged by is read from what earlier batches have written, so a repeated batch is judged the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        mark = None
        if number:
            before = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("accepted", BooleanType()), StructField("batch", IntegerType())])).option("basePath", table).parquet(*[f"{table}/batch={k}" for k in range(number)])
            mark = before.agg((F.max("ts") - F.expr(f"interval {late}")).alias("mark")).first().mark
        accepted = F.lit(True) if mark is None else F.col("ts") >= F.lit(mark)
        rows.withColumn("accepted", accepted).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
