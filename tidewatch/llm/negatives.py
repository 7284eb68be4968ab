"""Hard negatives by slot-decomposed selection.

An anchor's positives give windows of scores, and each window ends at an upper limit of its own. Those limits cut the scores
into disjoint slots. A task keeps the best ``k`` rows of each slot (a combiner), tasks' lists merge into one list a slot,
and a window's answer is the best ``k`` of its own slot and all below it: a merge of descending suffixes, cut at the lower limit.
So one pass over the vectors serves all overlapping windows, and no pair of rows is ever written.

Anchors are a stated query set and go against all rows in blocks of ``ANCHORS``; each block is one broadcast of bounded size and
two passes over the vectors. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import new_path, store

ANCHORS = 16_384
"""Anchors of a block: a task holds their vectors and, for each, ``positives`` lists of ``negatives`` rows."""
SCALE = 256
_PAIRS = 1 << 20
_NONE = np.iinfo(np.int64).min


def integer_matrix(vectors: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of each component as rows of ``width`` doubles, and which rows are whole.

    A row that is null or has a null or non-finite component is not whole. Shorter vectors end in zeros and longer ones are
    cut, which is what an inner product with a vector of ``width`` components sees. Components beyond what keeps a product
    within 64 bits count as that bound.
    """
    n = len(vectors)
    known = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)
    bad = ~np.isfinite(values)                    # a null component reads as not a number
    whole = known & (np.bincount(row[bad], minlength=n) == 0)
    most = float(2 ** ((62 - max(width, 1).bit_length()) // 2))
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = (at < width) & ~bad
    out = np.zeros((n, width))
    out[row[inside], at[inside]] = np.clip(np.floor(scale * values[inside]), -most, most)
    return out, whole


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, rows x anchors; as doubles where these are exact, else in 64-bit integers."""
    largest = np.abs(rows).max(initial=0.0) * np.abs(anchors).max(initial=0.0) * max(rows.shape[1], 1)
    if largest < 2.0 ** 53:
        return (rows @ anchors.T).astype(np.int64)
    return rows.astype(np.int64) @ anchors.astype(np.int64).T


class BestRows:
    """The best ``k`` (score, id) of each group: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), _NONE, dtype=np.int64)
        self.id = np.full((groups, k), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.score[group, -1], self.id[group, -1]
        good = (score > last) | ((score == last) & (ids < last_id))
        group, score, ids = group[good], score[good], ids[good]
        if not len(group):
            return
        touched = np.unique(group)
        group = np.concatenate([np.repeat(touched, self.k), group])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -np.maximum(score, -np.iinfo(np.int64).max), group))
        first = np.searchsorted(group[order], touched)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[touched], self.id[touched] = score[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups, scores and ids of all that was kept."""
        group, place = np.nonzero(self.score != _NONE)
        return group, self.score[group, place], self.id[group, place]


def _pass(vectors: DataFrame, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, groups: int, k: int, scale: int,
          pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], schema: str) -> DataFrame:
    """One pass over ``vectors``: ``pick(scores, same_label)`` names (row, anchor, group) of what the combiner is offered."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, labels, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = sent.value
        best = BestRows(groups, k)
        step = max(1, _PAIRS // max(len(ids), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values, whole = integer_matrix(part.column("vector"), matrix.shape[1], scale)
                own, tag = part.column("id").to_numpy()[whole], part.column("label").to_numpy()[whole]
                found = scores(values[whole], matrix)
                row, anchor, group = pick(found, tag[:, None] == labels[None, :])
                other = own[row] != ids[anchor]
                best.offer(group[other], found[row[other], anchor[other]], own[row[other]])
        group, score, kept = best.rows()
        for at in range(0, len(group), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[part].astype(np.int32)), pa.array(score[part]), pa.array(kept[part])], ["group", "score", "id"])

    return vectors.mapInArrow(run, schema)


def _first(df: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The best ``k`` rows of each group, numbered from 1; Spark drops the others before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def _block(vectors: DataFrame, got: list, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """Answers for the anchors in ``got`` (rows ``id``, ``label``, ``vector``)."""
    spark = vectors.sparkSession
    width = max((len(r["vector"]) for r in got), default=0)
    matrix, _ = integer_matrix(pa.array([r["vector"] for r in got], pa.list_(pa.float64())), width, scale)
    ids, labels = np.array([r["id"] for r in got], dtype=np.int64), np.array([r["label"] for r in got], dtype=np.int64)
    schema = "group int, score long, id long"

    def same(found: np.ndarray, equal: np.ndarray):
        row, anchor = np.nonzero(equal)
        return row, anchor, anchor

    near = _first(_pass(vectors, ids, labels, matrix, len(ids), positives, scale, same, schema), ["group"], positives, "ordinal")
    near = near.collect()                          # at most `positives` rows for each anchor of the block
    window = [(r["group"], r["ordinal"], r["id"], r["score"], -(-low * r["score"] // 100), high * r["score"] // 100) for r in near]
    window = [w for w in window if w[4] <= w[5]]
    limits = np.full((len(ids), positives), np.iinfo(np.int64).max, dtype=np.int64)
    lowest = np.full(len(ids), np.iinfo(np.int64).max, dtype=np.int64)
    count = np.zeros(len(ids), dtype=np.int64)
    by_anchor: dict[int, list] = {}
    for w in window:
        by_anchor.setdefault(w[0], []).append(w)
    slots = []
    for anchor, own in by_anchor.items():
        ends = sorted({w[5] for w in own})
        limits[anchor, :len(ends)], count[anchor], lowest[anchor] = ends, len(ends), min(w[4] for w in own)
        slots += [(anchor, int(ids[anchor]), w[1], w[2], w[3], w[4], ends.index(w[5])) for w in own]
    top = np.where(count > 0, limits[np.arange(len(ids)), np.maximum(count - 1, 0)], _NONE)

    def slot(found: np.ndarray, equal: np.ndarray):
        row, anchor = np.nonzero(~equal & (found >= lowest) & (found <= top))
        value = found[row, anchor]
        at = np.zeros(len(value), dtype=np.int64)
        for j in range(positives):
            at += value > limits[anchor, j]
        return row, anchor, anchor * positives + at

    kept = _pass(vectors, ids, labels, matrix, len(ids) * positives, negatives, scale, slot, schema)
    kept = _first(kept, ["group"], negatives, "place").select(
        F.floor(F.col("group") / positives).cast("int").alias("anchor"), (F.col("group") % positives).alias("slot"), "score", "id")
    wanted = spark.createDataFrame(slots, "anchor int, anchor_id long, ordinal int, positive_id long, positive_score long, low long, last int")
    merged = kept.join(wanted, "anchor").where((F.col("slot") <= F.col("last")) & (F.col("score") >= F.col("low")))
    return _first(merged, ["anchor", "ordinal"], negatives, "rank").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def mine(rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, block: int = ANCHORS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` per cent of the positive's. Higher scores come first, ties by smaller id. Rows with a
    null id, label or vector, or any null or non-finite component, take no part; an empty vector scores zero. Rows that repeat
    count each as a positive or negative, though none with the anchor's own id; of rows that repeat an anchor's id, the one with the
    least label, then the least vector, is the anchor. Extra columns aren't looked at; no rows give no rows.
    """
    tag = F.col(label) if isinstance(label, str) else label
    named = rows.select(
        F.col(id_column).cast("long").alias("id"), tag.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"),
        is_anchor.alias("anchor"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = named.where(F.col("anchor") & finite).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v"))
    asked = store(asked.select("id", "v.label", "v.vector"), "anchors")
    vectors = named.select("id", "label", "vector")
    blocks = -(-asked.count() // block)
    path = new_path(rows.sparkSession, "hard-negatives")
    for b in range(max(blocks, 1)):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1))) == b).collect()
        _block(vectors, got, positives, negatives, low, high, scale).write.parquet(f"{path}/block={b}")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return rows.sparkSession.read.schema(f"{schema}, block int").parquet(path).drop("block")
