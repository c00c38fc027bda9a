"""Shared parts of the trained operators: folds, bounded samples and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; such rows never train. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """All rows, or about `limit` of them where there are more, chosen by hash of the key."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(limit / n * (1 << 30)))


def labelled(docs: DataFrame, labels: DataFrame, mark: str, limit: int, limit_bytes: int) -> DataFrame:
    """(doc_id, text, mark) of labelled documents that aren't held out, about `limit` of either class at most, chosen by hash.

    Beyond `limit_bytes` of text in all, fewer are chosen. Nulls and values other than 0 and 1 are no labels.
    """
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col(mark).isin(0, 1)).select("doc_id", F.col(mark).cast("int").alias(mark))
    rows = [bounded_sample(marked.filter(F.col(mark) == k), F.col("doc_id"), limit) for k in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows[0].unionByName(rows[1]).dropDuplicates(["doc_id"])), "doc_id")  # the sample is bounded
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > limit_bytes:
        chosen = chosen.filter(F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(1 << 30)) < int(limit_bytes / size * (1 << 30)))
    return chosen


def sample_by(rows: DataFrame, key: Column, group: str, limit: int) -> tuple[DataFrame, list]:
    """All rows, or about `limit` of them where there are more, and the sorted groups of all rows.

    Groups share the limit evenly; what a small one leaves goes to the larger ones, so that it is taken whole. Rows
    are chosen by hash of the key.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    room, chosen = limit, rows
    bars: list[Column] = []
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        share = max(1, room // (len(counts) - k))
        room -= min(n, share)
        if n > share:
            bars += [F.lit(name), F.lit(int(share / n * (1 << 30)))]
    if bars:
        bar = F.coalesce(F.try_element_at(F.create_map(*bars), F.col(group)), F.lit(1 << 30))
        chosen = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < bar)
    return chosen, sorted(counts)


def platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps with smoothed targets."""
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum((p - target) * margins) + 1e-6 * a, np.sum(p - target)])
        h = np.array([[np.sum(w * margins * margins) + 1e-6, np.sum(w * margins)], [np.sum(w * margins), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def logistic(margin: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    """Probabilities on a platt() curve."""
    return 1 / (1 + np.exp(-np.clip(curve[0] * margin + curve[1], -30, 30)))
