"""Frame fingerprints, picture quality and static admission rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH, _HEIGHT = 9, 8


def dhash(luma: Column) -> Column:
    """16 hex digits from 72 brightness values (8 rows of 9): bit set where left is brighter."""
    spots = F.sequence(F.lit(0), F.lit((_WIDTH - 1) * _HEIGHT - 1))

    def bit(i: Column) -> Column:
        at = F.floor(i / (_WIDTH - 1)) * _WIDTH + i % (_WIDTH - 1)
        left, right = F.get(luma, at.cast("int")), F.get(luma, (at + 1).cast("int"))
        return F.when(left > right, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint")
        )

    bits = F.aggregate(spots, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(i)))
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints; 64 when one is missing or not a number."""
    def half(h: Column, start: int) -> Column:
        padded = F.lpad(h, 16, "0")
        return F.conv(F.substring(padded, start, 8), 16, 10).cast("bigint")

    hexes = r"^[0-9a-fA-F]{1,16}$"
    usable = a.rlike(hexes) & b.rlike(hexes)
    differing = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(
        half(a, 9).bitwiseXOR(half(b, 9))
    )
    return F.when(F.coalesce(usable, F.lit(False)), differing).otherwise(F.lit(64))


def quality(luma: Column, width: Column, height: Column, step: int = 4) -> Column:
    """Mean, dark and bright share and Laplacian variance of sampled pixels.

    ``luma`` is an array of rows; every ``step``-th inner pixel is looked at.
    """
    def pixel(y: Column, x: Column) -> Column:
        return F.get(F.get(luma, y.cast("int")), x.cast("int")).cast("double")

    rows = F.sequence(F.lit(step), height - step - 1, F.lit(step))
    cols = F.sequence(F.lit(step), width - step - 1, F.lit(step))

    def sample(y: Column, x: Column) -> Column:
        c = pixel(y, x)
        lap = 4.0 * c - pixel(y - step, x) - pixel(y + step, x) - pixel(y, x - step) - pixel(y, x + step)
        return F.struct(c.alias("c"), lap.alias("lap"))

    samples = F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: sample(y, x))))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "c", "dark", "bright", "l", "ll")])
    one = F.lit(1.0)

    def add(acc: Column, s: Column) -> Column:
        return F.struct(
            (acc["n"] + 1.0).alias("n"), (acc["c"] + s["c"]).alias("c"),
            (acc["dark"] + F.when(s["c"] <= 12, one).otherwise(0.0)).alias("dark"),
            (acc["bright"] + F.when(s["c"] >= 245, one).otherwise(0.0)).alias("bright"),
            (acc["l"] + s["lap"]).alias("l"), (acc["ll"] + s["lap"] * s["lap"]).alias("ll"),
        )

    def finish(acc: Column) -> Column:
        n, mean = acc["n"], acc["l"] / acc["n"]
        return F.struct(
            (acc["c"] / n).alias("mean_luma"), (acc["dark"] / n).alias("dark_ratio"),
            (acc["bright"] / n).alias("bright_ratio"), (acc["ll"] / n - mean * mean).alias("blur_variance"),
        )

    return F.aggregate(samples, zero, add, finish)


def quality_reasons(width, height, mean_luma, dark_ratio, bright_ratio, blur_variance) -> Column:
    """Why a picture is not good enough; an empty list means it is."""
    tests = [
        ("resolution_too_small", (F.least(width, height) < 320) | (F.greatest(width, height) < 480)),
        ("too_dark", mean_luma < 35.0),
        ("over_exposed", bright_ratio > 0.35),
        ("occluded", dark_ratio > 0.85),
        ("blurry", blur_variance < 65.0),
    ]
    flags = F.array(*[F.when(test, F.lit(name)) for name, test in tests])
    return F.filter(flags, lambda r: r.isNotNull())


def static_reject(n_bytes, decode_ok, width, height, edge_var, face_count=None, trigger=None) -> Column:
    """First failing admission rule, cheapest first; null lets the frame through."""
    reason = (
        F.when(n_bytes < 512, "too_small")
        .when(n_bytes > 4 * 1024 * 1024, "too_large")
        .when(~decode_ok, "decode_failed")
        .when(F.least(width, height) < 64, "too_low_resolution")
        .when(edge_var < 60.0, "too_blurry")
    )
    if face_count is not None:
        reason = reason.when((face_count > 0) & (trigger != "read"), "face_detected")
    return reason
