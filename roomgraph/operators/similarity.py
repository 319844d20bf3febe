"""Best matches between feature vectors, block against block.

Both sides of a key are split into blocks of bounded size. Every pair of blocks is one
matrix product in a task, which passes on only its own best rows per query; the final
choice is a top-k over those.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgraph.operators.scaling import top_k

#: Each row is moved once for every block of the other side. So a block may be large, and a key has few of
#: them: about ``_SIDE`` where that is enough, for tasks enough, and more only once blocks are full.
_FULL, _SIDE, _LEAST = 65_536, 8, 2048
#: Similarities of a pair of blocks that are held at a time.
_CELLS = 1 << 22
_FLOOR = 1e-9


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two short vectors inside one row."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(_FLOOR))


def _blocks() -> Column:
    n = F.count(F.lit(1))
    return F.greatest(F.ceil(n / _FULL), F.least(F.lit(_SIDE), F.ceil(n / _LEAST)))


def _in_blocks(df: DataFrame, keys: list[str], ident: str, own: str, other: str, theirs: DataFrame):
    """Rows of one side with their block, once for each block of the other side."""
    mine = df.groupBy(*keys).agg(_blocks().alias("_mine"))
    facing = theirs.groupBy(*keys).agg(_blocks().alias("_theirs"))
    return (
        df.join(mine.join(facing, keys), keys)
        .withColumn(own, F.pmod(F.xxhash64(ident), F.col("_mine")))
        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_theirs") - 1)))
        .drop("_mine", "_theirs")
    )


def _score_blocks(keys: Sequence[str], k: int, min_sim: float, strict: bool, digits: int | None):
    n = len(keys)

    def score(key, queries: pd.DataFrame, gallery: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "query_id", "match_id", "match_ord", "similarity"]
        if queries.empty or gallery.empty:
            return pd.DataFrame(columns=columns)
        q = np.stack(queries["feature"].to_numpy()).astype(float)
        m = np.stack(gallery["feature"].to_numpy()).astype(float)
        q_norm, m_norm = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
        labels = pd.concat([queries["conflict"], gallery["conflict"]]).fillna("")
        codes, names = pd.factorize(labels)
        blank = np.array([name == "" for name in names])[codes]
        a, b = codes[: len(q)], codes[len(q):]
        rank_ord = gallery["match_ord"].to_numpy()
        rows, cols, sims = [], [], []
        step = max(1, _CELLS // len(m))
        for low in range(0, len(q), step):
            part = slice(low, low + step)
            sim = q[part] @ m.T / np.maximum(q_norm[part, None] * m_norm[None, :], _FLOOR)
            if digits is not None:
                sim = np.round(sim, digits)
            ok = sim > min_sim if strict else sim >= min_sim
            ok &= (
                (a[part, None] == b[None, :]) | blank[: len(q)][part, None] | blank[len(q):][None, :]
            )
            for i in range(len(sim)):
                hit = np.flatnonzero(ok[i])
                if len(hit) > k:
                    hit = hit[np.lexsort((rank_ord[hit], -sim[i, hit]))[:k]]
                rows.extend([low + i] * len(hit))
                cols.extend(hit)
                sims.extend(sim[i, hit])
        out = {name: [value] * len(rows) for name, value in zip(keys, key[:n])}
        out["query_id"] = queries["query_id"].to_numpy()[rows] if rows else []
        out["match_id"] = gallery["match_id"].to_numpy()[cols] if rows else []
        out["match_ord"] = rank_ord[cols] if rows else []
        out["similarity"] = sims
        return pd.DataFrame(out, columns=columns)

    return score


def best_matches(
    queries: DataFrame,
    gallery: DataFrame,
    keys: Sequence[str],
    k: int,
    min_sim: float,
    strict: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Top ``k`` gallery rows per query with cosine at least ``min_sim`` (above it if strict).

    ``queries`` carry the keys, query_id, feature and conflict; ``gallery`` the keys,
    match_id, match_ord, feature and conflict. Two different non-empty conflict words rule
    a pair out. Ties go to the lower match_ord.
    """
    keys = list(keys)
    q = queries.select(*keys, "query_id", "feature", "conflict")
    m = gallery.select(*keys, "match_id", "match_ord", "feature", "conflict")
    left = _in_blocks(q, keys, "query_id", "_qb", "_gb", m)
    right = _in_blocks(m, keys, "match_id", "_gb", "_qb", q)
    on = [*keys, "_qb", "_gb"]
    fields = [f"{c} {q.schema[c].dataType.simpleString()}" for c in [*keys, "query_id"]]
    fields += [f"{c} {m.schema[c].dataType.simpleString()}" for c in ("match_id", "match_ord")]
    schema = ", ".join([*fields, "similarity double"])
    found = (
        left.groupBy(*on)
        .cogroup(right.groupBy(*on))
        .applyInPandas(_score_blocks(keys, k, min_sim, strict, digits), schema)
    )
    return top_k(
        found, [*keys, "query_id"], [F.desc("similarity"), F.asc("match_ord")], k, "rank"
    )
