"""Frame flow around the gate: context, recheck, routing, log split, liveness, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.functions import answers as a
from roomgraph.operators.reports import latency_histogram
from roomgraph.operators.scaling import BUCKET, CONTEXT, sessionize, with_halo


def context_asof(frames: DataFrame, hits: DataFrame, ttl_s: float = 60.0) -> DataFrame:
    """Latest non-empty knowledge hits of an earlier frame of the device, at most ``ttl_s`` old.

    ``frames`` carry device_id, seq, epoch_s; ``hits`` device_id, seq and ``hits`` (text).
    Windows run over time slices with the last ``ttl_s`` of the slice before as context.
    """
    linked = frames.join(hits.select("device_id", "seq", "hits"), ["device_id", "seq"], "left")
    found = F.when(F.coalesce("hits", F.lit("")) != "", F.struct("hits", "epoch_s"))
    width = max(3600.0, ttl_s)
    sliced = with_halo(linked.withColumn("_found", found), "epoch_s", width, ttl_s)
    before = Window.partitionBy("device_id", BUCKET).orderBy("epoch_s", "seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    last = F.last("_found", ignorenulls=True).over(before)
    fresh = F.col("epoch_s") - F.col("_last.epoch_s") < ttl_s
    return (
        sliced.withColumn("_last", last)
        .filter(~F.col(CONTEXT))
        .withColumn("kb_context", F.when(fresh, F.col("_last.hits")))
        .drop("_found", "_last", "hits", BUCKET, CONTEXT)
    )


def request_rates(requests: DataFrame, window_s: int = 60, limit: int = 10) -> DataFrame:
    """Requests of the session in the last ``window_s`` seconds, and whether that is too many.

    ``requests`` carry session_id and whole seconds ``t_s``.
    """
    width = max(3600, window_s)
    sliced = with_halo(requests, "t_s", width, window_s)
    recent = Window.partitionBy("session_id", BUCKET).orderBy("t_s").rangeBetween(-window_s, 0)
    return (
        sliced.withColumn("n_recent", F.count(F.lit(1)).over(recent))
        .filter(~F.col(CONTEXT))
        .withColumn("limited", F.col("n_recent") > limit)
        .drop(BUCKET, CONTEXT)
    )


def connections(frames: DataFrame, gap_s: float = 30.0) -> DataFrame:
    """``thread_id`` per connection: a silence of ``gap_s`` starts the next one."""
    numbered = sessionize(frames, ["device_id"], "epoch_s", gap_s, max(3600.0, gap_s), ["seq"])
    thread = F.concat(F.col("device_id").cast("string"), F.lit(":"), F.col("session").cast("string"))
    return numbered.withColumn("thread_id", thread)


def latest_only(frames: DataFrame, slot: Column) -> DataFrame:
    """Newest frame per device and slot (a micro-batch or a time slice), and how many it displaced."""
    return frames.groupBy("device_id", slot.alias("slot")).agg(
        F.max("seq").alias("seq"), (F.count(F.lit(1)) - 1).alias("dropped")
    )


def liveness(signals: DataFrame, now_s: Column, ttl_s: float = 30.0) -> DataFrame:
    """Last sign of life of each device and whether it is still online."""
    return signals.groupBy("device_id").agg(F.max("epoch_s").alias("last_seen_s")).withColumn(
        "online", F.col("last_seen_s") > now_s - ttl_s
    )


def with_recheck(first: DataFrame, second: DataFrame) -> DataFrame:
    """Replace risky answers without context by their second answer, where there is one.

    Both carry seq, device_id, result, degraded, prompt_tokens, completion_tokens and
    latency_ms; ``first`` also kb_context and trigger; ``second`` holds successful second calls
    made with knowledge hits. Tokens and latencies add up. Reading frames are never asked again.
    """
    keys = ["device_id", "seq"]
    values = ["result", "degraded", "prompt_tokens", "completion_tokens", "latency_ms"]
    other = second.select(*keys, F.struct(*values).alias("_s"))
    asks = (
        (F.col("result.risk_level") == "high") & (F.coalesce("trigger", F.lit("")) != "read")
        & (F.coalesce("kb_context", F.lit("")) == "")
        & (F.size("result.keywords") > 0)
    )
    joined = first.join(other, keys, "left").withColumn(
        "second_call", asks & F.col("_s").isNotNull()
    )
    again = F.col("second_call")
    return joined.withColumns(
        {
            "result": F.when(again, F.col("_s.result")).otherwise(F.col("result")),
            "degraded": F.when(again, F.col("degraded") | F.col("_s.degraded")).otherwise(F.col("degraded")),
            **{
                c: F.when(again, F.col(c) + F.col(f"_s.{c}")).otherwise(F.col(c))
                for c in values[2:]
            },
        }
    ).drop("_s")


def finish_frames(frames: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """Redact free texts, apply banned words, and shape the reply of every frame.

    ``frames`` carry trigger, rejected_by, reject_reason, error and ``result``.
    """
    cleaned = frames
    for name in ("scene", "ocr_text", "advice"):
        cleaned = a.redact(cleaned.withColumn(f"_{name}", F.col(f"result.{name}")), f"_{name}")
        cleaned = cleaned.drop(*[f"n_{p}" for p, _ in a.REDACT_PATTERNS])
    result = F.col("result").withField("scene", F.col("_scene"))
    result = result.withField("ocr_text", F.col("_ocr_text")).withField("advice", F.col("_advice"))
    word = a.banned_word([F.col("_ocr_text"), F.col("_advice"), F.col("_scene")], banned or [])
    open_ = F.col("rejected_by").isNull() & F.col("error").isNull()
    blocked = open_ & F.col("_hit").isNotNull()
    return (
        cleaned.withColumn("result", result)
        .withColumn("_hit", word)
        .withColumn("reject_reason", F.when(blocked, "banned_word").otherwise(F.col("reject_reason")))
        .withColumn("rejected_by", F.when(blocked, "post_rules").otherwise(F.col("rejected_by")))
        .withColumn(
            "reply",
            a.final_reply(F.col("rejected_by"), F.col("reject_reason"), F.col("error"),
                          F.col("trigger"), a.reply(F.col("result"))),
        )
        .withColumn("outcome", a.outcome(F.col("rejected_by"), F.col("error")))
        .drop("_scene", "_ocr_text", "_advice", "_hit")
    )


def split_logs(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inference_log, reject_log). Only gate rejects keep the time since the last call; frames
    over the rate are refused before they are hashed, so they have no hash."""
    rejected = frames.filter(F.col("rejected_by").isNotNull()).withColumn(
        "since_last_call_s",
        F.when(F.col("rejected_by") == "gate", F.col("since_last_call_s")),
    )
    rejects = rejected.select(
        "device_id", "thread_id", F.col("rejected_by").alias("node"),
        F.coalesce("reject_reason", F.lit("")).alias("reason"),
        F.when(F.col("reject_reason").isin("rate_limit", "read_rate_limit"), "").otherwise(F.col("phash")).alias("phash"),
        "hash_distance",
        "since_last_call_s", "created_at",
    )
    return frames.filter(F.col("rejected_by").isNull()), rejects


def log_writer(folder: str):
    """``foreachBatch`` function that appends a batch to both logs, split by day.

    The batch number is part of the path, so a batch that is run again after a failure
    replaces its own files.
    """
    def write(batch: DataFrame, number: int) -> None:
        inference, rejects = split_logs(batch)
        for name, part in (("inference_log", inference), ("reject_log", rejects)):
            (
                part.withColumn("day", F.to_date("created_at"))
                .write.mode("overwrite")
                .partitionBy("day")
                .parquet(f"{folder}/{name}/batch={number}")
            )

    return write


def windowed_counts(frames: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Frames by outcome per time window, for streams and tables (column ``ts``)."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", every), "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms")
    )


def windowed_latency(frames: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Latency histogram (cumulative counts per bound) of each time window, for streams and tables
    (columns ``ts``, ``latency_ms``). A window's state is its counts, which merge."""
    windows = frames.withWatermark("ts", late).withColumn("window", F.window("ts", every))
    return latency_histogram(windows, ["window"], F.col("latency_ms") / 1000.0)
