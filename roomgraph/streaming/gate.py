"""Admission gate per device: token buckets, duplicate and scene-change rules.

One step function serves the batch replay and the stream (``keyed.gate_stream``). The replay splits a device at
pauses after which every bucket is full again and the last frame has expired, so a busy
device is spread over its active stretches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.operators.scaling import sessionize


@dataclass(frozen=True)
class GatePolicy:
    rate_per_s: float = 1.0
    dup_distance: int = 8
    min_interval_s: float = 3.0
    force_distance: int = 16
    read_per_min: float = 6.0
    read_burst: float = 3.0

    @property
    def burst(self) -> float:
        return max(1.0, math.ceil(self.rate_per_s))

    @property
    def expiry_s(self) -> float:
        return max(60.0, 10 * self.min_interval_s)

    @property
    def forgetting_gap_s(self) -> float:
        """After such a pause nothing of the past matters any more."""
        read_burst = max(1.0, self.read_burst)
        return max(self.expiry_s, self.burst / self.rate_per_s, read_burst * 60.0 / self.read_per_min)


# tokens, tokens_at, read tokens, read tokens_at, last hash, last admitted at
FRESH = (None, None, None, None, None, None)
STATE = "tokens double, tokens_at double, reads double, reads_at double, last_hash string, last_at double"


def _take(tokens, at, now, rate, burst):
    tokens = burst if tokens is None else min(burst, tokens + max(0.0, now - at) * rate)
    return (True, tokens - 1.0) if tokens >= 1.0 else (False, tokens)


def _distance(a: str, b: str | None) -> int:
    if not a or not b:
        return 64
    try:
        return (int(a, 16) ^ int(b, 16)).bit_count()
    except ValueError:
        return 64


def gate_step(policy: GatePolicy, state, now: float, trigger: str, phash: str):
    """New state, reject reason (or None), distance and seconds since the last admitted frame."""
    tokens, t_at, reads, r_at, last, last_at = state
    if trigger == "read":
        ok, reads = _take(reads, r_at, now, policy.read_per_min / 60.0, max(1.0, policy.read_burst))
        r_at = now
        if not ok:
            return (tokens, t_at, reads, r_at, last, last_at), "read_rate_limit", None, None
    else:
        ok, tokens = _take(tokens, t_at, now, policy.rate_per_s, policy.burst)
        t_at = now
        if not ok:
            return (tokens, t_at, reads, r_at, last, last_at), "rate_limit", None, None
    if last_at is not None and now - last_at >= policy.expiry_s:
        last, last_at = None, None
    distance = 64 if last_at is None else _distance(phash, last)
    since = None if last_at is None else now - last_at
    if trigger not in ("manual", "read") and last_at is not None:
        reason = None
        if distance < policy.dup_distance:
            reason = "duplicate"
        elif since < policy.min_interval_s and distance < policy.force_distance:
            reason = "no_scene_change"
        if reason:
            return (tokens, t_at, reads, r_at, last, last_at), reason, distance, since
    return (tokens, t_at, reads, r_at, phash, now), None, distance, since


_OUT = (
    "device_id long, seq long, epoch_s double, trigger string, phash string, "
    "reject_reason string, hash_distance int, since_last_call_s double"
)


def _judge(policy: GatePolicy, state, frames: pd.DataFrame):
    rows, stretch = [], None
    for f in frames.itertuples(index=False):
        if getattr(f, "stretch", stretch) != stretch:
            state, stretch = FRESH, f.stretch
        state, reason, distance, since = gate_step(policy, state, f.epoch_s, f.trigger, f.phash)
        rows.append((f.device_id, f.seq, f.epoch_s, f.trigger, f.phash, reason, distance, since))
    out = pd.DataFrame(
        rows,
        columns=["device_id", "seq", "epoch_s", "trigger", "phash", "reject_reason",
                 "hash_distance", "since_last_call_s"],
    )
    return state, out.astype({"hash_distance": "Int32"})


def replay(
    frames: DataFrame, policy: GatePolicy = GatePolicy(), bundle_rows: int = 50_000
) -> DataFrame:
    """Gate decisions over stored frames (device_id, seq, epoch_s, trigger, phash)."""
    gap = policy.forgetting_gap_s
    parts = sessionize(
        frames.select("device_id", "seq", "epoch_s", "trigger", "phash"),
        ["device_id"], "epoch_s", gap, max(3600.0, gap), ["seq"], "stretch",
    )
    sizes = frames.groupBy("device_id").agg(
        F.ceil(F.count(F.lit(1)) / bundle_rows).alias("_bundles")
    )
    parts = parts.join(sizes, "device_id").withColumn(
        "_bundle", F.pmod(F.xxhash64("stretch"), F.col("_bundles"))
    ).drop("_bundles")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["stretch", "epoch_s", "seq"], kind="stable")
        return _judge(policy, FRESH, ordered)[1]

    return parts.groupBy("device_id", "_bundle").applyInPandas(run, _OUT)

