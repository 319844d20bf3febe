"""Per-device state over streams in event-time order, late rows as dead letters, and tables kept by
micro-batches.

Rows wait in their device's state until the watermark, ``late_s`` behind the newest row of all devices,
has passed them; an event-time timer then takes them in order of time and sequence number. So rows out
of order within ``late_s`` change nothing: the outcome is that of the batch operator over the same rows.
A row behind the watermark when its micro-batch begins can't be put in order any more; it isn't dropped
but comes back at once, marked, and ``late_writer`` puts such rows aside. For that the column of the
watermark is not handed to the stateful operator, which would drop these rows itself.

A device's state is what waits, at most its rows of ``late_s``, and what the step keeps; a device
without rows for the time that the step remembers is forgotten. The state store must be RocksDB
(``session.build_session`` sets it).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from roomgraph.streaming.flow import latest_only
from roomgraph.streaming.gate import FRESH, STATE, GatePolicy, gate_step


def _plain(row) -> tuple:
    return tuple(None if v is None or v != v else v for v in row)


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them and hands them on in order.

    ``step(state, rows) -> (state, values)`` gets rows in order, all those of one time together, and
    returns a list of values for each row.
    """

    def __init__(self, step: Callable, key: str, rows: StructType, values: list[str], state: str,
                 fresh: tuple, keep_s: float):
        self.step, self.key, self.rows, self.values = step, key, rows, values
        self.state, self.fresh, self.keep_ms = state, fresh, math.ceil(keep_s * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.kept = handle.getValueState("kept", self.state)
        self.due = handle.getValueState("due", "at_ms long")

    def _wake(self, at_ms: int) -> None:
        """Only the next timer is set; an earlier one takes its place."""
        if not self.due.exists() or at_ms < self.due.get()[0]:
            self.handle.registerTimer(at_ms)
            self.due.update((at_ms,))

    def _told(self, key, rows: list, values: list, late: bool) -> pd.DataFrame:
        names = ["epoch_s", "seq", *self.values]
        columns = {n: pd.Series([v[i] for v in values], dtype=object) for i, n in enumerate(names)}
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(rows), dtype=object), "seq": columns.pop("seq"),
                             "epoch_s": columns.pop("epoch_s"), **columns, "late": pd.Series([late] * len(rows), dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late, early = [], []
        for part in rows:
            for row in part[self.rows.names].itertuples(index=False):
                (late if row.epoch_s * 1000 < passed else early).append(_plain(row))
        if early:
            self.waiting.appendList(early)
            self._wake(int(min(row[0] for row in early) * 1000) + 1)
        if late:
            yield self._told(key, late, [row[:2] + (None,) * len(self.values) for row in late], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or expiredTimerInfo.getExpiryTimeInMs() != self.due.get()[0]:
            return  # an earlier timer took its place
        self.due.clear()
        held = [_plain(row) for row in self.waiting.get()] if self.waiting.exists() else []
        held.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        cut = next((i for i, row in enumerate(held) if int(row[0] * 1000) >= passed), len(held))
        if cut:
            frame = pd.DataFrame(held[:cut], columns=self.rows.names)
            now = _plain(self.kept.get())[1:] if self.kept.exists() else self.fresh
            now, values = self.step(now, frame)
            self.kept.update((held[cut - 1][0], *now))
            if cut < len(held):
                self.waiting.put(held[cut:])
            else:
                self.waiting.clear()
            yield self._told(key, held[:cut], [row[:2] + tuple(v) for row, v in zip(held, values, strict=False)], False)
        if cut < len(held):
            self._wake(int(held[cut][0] * 1000) + 1)
        elif self.kept.exists():
            forget = int(self.kept.get()[0] * 1000) + self.keep_ms + 1
            if forget <= passed:
                self.kept.clear()
            else:
                self._wake(forget)


def keyed_stream(frames: DataFrame, step: Callable, values: str, state: str, fresh: tuple,
                 late_s: float, keep_s: float, key: str = "device_id") -> DataFrame:
    """``key``, seq, epoch_s, the ``values`` of ``step`` for rows in order, and ``late``. A key without
    rows for ``keep_s`` is forgotten. Rows without time or key have no place in an order: they are late."""
    names = [v.split()[0] for v in values.split(",")]
    rest = [c for c in frames.columns if c not in (key, "epoch_s", "seq")]
    rows = frames.select("epoch_s", "seq", *rest).schema
    at = F.timestamp_millis((F.col("epoch_s") * 1000).cast("long"))
    moved = frames.withColumn("_at", at).withWatermark("_at", f"{int(late_s * 1000)} milliseconds").select(
        key, F.coalesce(F.nanvl("epoch_s", F.lit(None)), F.lit(float("-inf"))).alias("epoch_s"), "seq", *rest)
    kind = frames.schema[key].dataType.simpleString()
    told = moved.groupBy(key).transformWithStateInPandas(
        InOrder(step, key, rows, names, f"last_s double, {state}", fresh, keep_s),
        f"{key} {kind}, seq long, epoch_s double, {values}, late boolean", "Append", "eventTime")
    return told.withColumn("epoch_s", F.nullif("epoch_s", F.lit(float("-inf"))))


def gate_stream(frames: DataFrame, policy: GatePolicy, late_s: float) -> DataFrame:
    """Gate decisions (as ``gate.replay``) with late rows marked."""
    def step(state, rows):
        out = []
        for row in rows.itertuples(index=False):
            state, reason, distance, since = gate_step(policy, state, *_plain((row.epoch_s, row.trigger, row.phash)))
            out.append((reason, distance, since))
        return state, out

    return keyed_stream(frames.select("device_id", "seq", "epoch_s", "trigger", "phash"), step,
                        "reject_reason string, hash_distance int, since_last_call_s double", STATE, FRESH,
                        late_s, policy.forgetting_gap_s)


def context_stream(frames: DataFrame, ttl_s: float, late_s: float) -> DataFrame:
    """Latest earlier knowledge ``hits`` of the device that are less than ``ttl_s`` old (as
    ``flow.context_asof``)."""
    def step(state, rows):
        hits, at = state
        out = []
        for now, own in zip(rows["epoch_s"], rows["hits"], strict=True):
            out.append((hits if hits is not None and now - at < ttl_s else None,))
            if isinstance(own, str) and own:
                hits, at = own, now
        return (hits, at), out

    return keyed_stream(frames.select("device_id", "seq", "epoch_s", "hits"), step, "kb_context string",
                        "hits string, at double", (None, None), late_s, ttl_s)


def rate_stream(requests: DataFrame, window_s: int, limit: int, late_s: float, key: str = "device_id") -> DataFrame:
    """Requests of the device in the last ``window_s`` seconds, and whether that is too many (as
    ``flow.request_rates``: requests at the very same time count each other)."""
    def step(state, rows):
        now = rows["epoch_s"].to_numpy(float)
        times = np.concatenate([np.array(state[0] or [], float), now])
        n = np.searchsorted(times, now, "right") - np.searchsorted(times, now - window_s, "left")
        return (times[times >= now[-1] - window_s].tolist(),), [(int(x), bool(x > limit)) for x in n]

    return keyed_stream(requests.select(key, "seq", "epoch_s"), step, "n_recent long, limited boolean",
                        "times array<double>", (None,), late_s, window_s, key)


def liveness_stream(signals: DataFrame, ttl_s: float) -> DataFrame:
    """(device_id, seen_s, online): ``online`` with each batch that has a sign of life of the
    device, ``offline`` once none has come for ``ttl_s``."""
    def run(key, batches, held):
        if held.hasTimedOut:
            seen, online = held.get[0], False
            held.remove()
        else:
            signs = [float(b["epoch_s"].max()) for b in batches]
            seen, online = max([*signs, held.get[0]] if held.exists else signs), True
            held.update((seen,))
            held.setTimeoutDuration(int(ttl_s * 1000))
        yield pd.DataFrame({"device_id": [key[0]], "seen_s": [seen], "online": [online]})

    return signals.groupBy("device_id").applyInPandasWithState(
        run, "device_id long, seen_s double, online boolean", "seen double", "append",
        GroupStateTimeout.ProcessingTimeTimeout)


# ---- writers for foreachBatch: a batch that runs again replaces its own files -------------------


def late_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Rows in time to ``folder``/kept, late ones to ``folder``/dead_letter."""
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, part in (("kept", batch.filter("not late")), ("dead_letter", batch.filter("late"))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return write


def newest_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Of each micro-batch the newest frame of each device, and how many it displaced."""
    def write(batch: DataFrame, number: int) -> None:
        latest_only(batch, F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


_MANIFEST = "bucket long, batch long, buckets long"


def _manifest(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Which micro-batch wrote each bucket of the table's version ``number``."""
    if number < 0:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/version={number}")


def _read_buckets(spark: SparkSession, folder: str, places: list) -> DataFrame:
    return spark.read.parquet(*[f"{folder}/data/batch={r.batch}/bucket={r.bucket}" for r in places])


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert_writer(
    folder: str, keys: list[str], merge: Callable[[DataFrame, DataFrame | None], DataFrame], buckets: int = 256
) -> Callable[[DataFrame, int], None]:
    """Keeps a table by hash buckets of ``keys``: only the buckets that a micro-batch touches are
    merged, ``merge(rows of the batch, the table's rows of these buckets or None)``, and written.

    ``merge`` must treat each key by itself; rows with null keys are rows like others. A batch writes
    its own folder and then the manifest of its version, which names the writer of each bucket; so a
    batch that runs again starts from the version before and replaces its own files, and readers see
    whole versions. Files that neither the last version nor the one before it names are removed. The
    driver holds one line a bucket. The number of buckets is kept with the table; another one is
    an error.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", bucket).persist()  # read for its buckets and by the merge
        touched = {r["_bucket"] for r in rows.select("_bucket").distinct().collect()}
        before = _manifest(spark, folder, number - 1).collect()
        if any(r.buckets != buckets for r in before):
            raise ValueError(f"the table has {before[0].buckets} buckets, not {buckets}")
        old = [r for r in before if r.bucket in touched]
        if touched:
            merged = merge(rows.drop("_bucket"), _read_buckets(spark, folder, old) if old else None)
            merged.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").mode(
                "overwrite").parquet(f"{folder}/data/batch={number}")
        now = [(r.bucket, r.batch, buckets) for r in before if r.bucket not in touched]
        now += [(b, number, buckets) for b in touched]
        spark.createDataFrame(now, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/manifest/version={number}")
        rows.unpersist()
        if number >= 2:  # a batch that runs again needs the version before it
            needed = {(r.bucket, r.batch) for r in before}
            stale = f"{folder}/manifest/version={number - 2}"
            try:
                unused = [r for r in _manifest(spark, folder, number - 2).collect() if (r.bucket, r.batch) not in needed]
            except AnalysisException:  # removed when this batch ran before
                return
            _remove(spark, [*[f"{folder}/data/batch={r.batch}/bucket={r.bucket}" for r in unused], stale])

    return write


def version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The table after micro-batch ``number``; the last two are kept. Without any row it has no columns yet,
    which is an error."""
    places = _manifest(spark, folder, number).collect()
    if not places:
        raise ValueError("no batch has brought rows yet")
    return _read_buckets(spark, folder, places)
