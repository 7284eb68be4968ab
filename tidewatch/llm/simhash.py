"""SimHash near duplicates by the generalised pigeonhole principle.

Documents with one fingerprint form a class, and only classes are compared. The 64 bits are grouped into partitions so that
correlated bits share one. Each partition gets a threshold of its own, and the thresholds add up to ``distance - partitions
+ 1``: then two fingerprints within ``distance`` agree within the threshold of at least one partition. A dynamic programme
picks the thresholds with the fewest expected candidates; a threshold of -1 leaves a partition out. Fingerprints are stored
under their value in each partition, probed with all values within the threshold, and candidates verified.

A bucket of more than ``DENSE`` classes would give pairs in the square of its size. All classes that meet such a bucket get
an exact way of their own: two fingerprints within two bits share a value that differs from either in one bit at most, so
each is filed under its 65 such values and linked to the least class of each. At most 65 fingerprints share a value.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, fresh, store, text_key

DISTANCE = 2
PARTITIONS = 3
DENSE = 65
"""From here on the 65 values of a class are fewer than its candidates in a bucket."""


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned SimHash of the lower-cased word shingles of one UTF-8 text; 0 without words."""
    import xxhash

    words = text.lower().split()                 # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    digest = xxhash.xxh64_intdigest
    if width == 3:
        hashes = [digest(a + b" " + b + b" " + c, 42) for a, b, c in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i:i + width]), 42) for i in range(len(words) - width + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):    # bounded memory for texts of any length
        block = np.array(hashes[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``id``, ``key`` (hash of the text) and ``fp`` (signed 64 bits) of every row; a null text counts as empty."""
    rows = docs.select(F.col(id_column).alias("id"), text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(found.view(np.int64))], ["id", "key", "fp"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, key long, fp long")


def agreement(classes: DataFrame) -> np.ndarray:
    """How often each two bits are set together: counted over all classes, one small matrix a task, summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            fps = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(fps), 1 << 16):
                bits = np.unpackbits(fps[at:at + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                bits = np.hstack([bits, np.ones((len(bits), 1), dtype=np.float32)])
                total += bits.T @ bits
        at = np.arange(65 * 65)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel())], ["cell", "n"])

    cells = classes.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(65 * 65)
    for row in cells:                            # 4,225 rows at any size
        out[row["cell"]] = row["n"]
    return out.reshape(65, 65)


def group_bits(together: np.ndarray, partitions: int = PARTITIONS) -> list[list[int]]:
    """Partitions of near equal width; each starts at the free bit with the strongest tie and takes the bits most correlated with it."""
    n = max(together[64, 64], 1.0)
    mean = together[64, :64] / n
    cov = together[:64, :64] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(tie, 0.0)
    free, groups = set(range(64)), []
    for p in range(partitions):
        width = (64 - sum(map(len, groups))) // (partitions - p)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (tie[b, rest].max() if len(rest) > 1 else 0, -b))]
        while len(group) < width:
            group.append(max((b for b in rest if b not in group), key=lambda b: (tie[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], distance: int = DISTANCE) -> list[int]:
    """Thresholds, one per partition, that add up to ``distance - partitions + 1`` at the least total cost.

    ``costs[p][t]`` is the expected number of candidates of partition ``p`` at threshold ``t``; -1 leaves it out.
    """
    want = distance - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for table in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (total, (cost, chosen)), (t, extra) in itertools.product(best.items(), table.items()):
            one = (cost + extra, [*chosen, t])
            if total + t not in step or one < step[total + t]:
                step[total + t] = one
        best = step
    return best[want][1]


def expected(group: list[int], together: np.ndarray, equal_pairs: float, distance: int = DISTANCE) -> dict[int, float]:
    """Candidates at each threshold: pairs equal in all bits are counted, those at more bits follow from how often single bits differ."""
    n = max(together[64, 64], 1.0)
    ones = together[64, group] / n
    differ = 2 * ones * (1 - ones)
    at = np.zeros(distance + 1)
    at[0] = 1.0
    for d in differ:
        at = at * (1 - d) + np.concatenate([[0.0], at[:-1] * d])
    chance = np.cumsum(at)
    pairs = n * (n - 1) / 2
    out = {-1: 0.0}
    for t in range(distance + 1):
        probes = n * sum(math.comb(len(group), k) for k in range(t + 1))
        out[t] = equal_pairs + pairs * (chance[t] - chance[0]) + probes
    return out


def _take(fp: Column, bits: list[int]) -> Column:
    """The value of ``fp`` in one partition, the other bits zero."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(value: Column, bits: list[int], radius: int) -> Column:
    """``value`` and all values that differ from it in at most ``radius`` of ``bits``."""
    masks = [sum(1 << b for b in flip) for k in range(radius + 1) for flip in itertools.combinations(bits, k)]
    return F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: value.bitwiseXOR(m))


def links(classes: DataFrame, distance: int = DISTANCE, partitions: int = PARTITIONS, dense: int = DENSE) -> DataFrame:
    """Pairs ``(a, b)``, a > b, of fingerprints within ``distance`` bits that connect all that are linked.

    ``classes`` has one row per fingerprint ``fp``. Pairs from small buckets are all there; classes in dense buckets are
    linked through the least one around each value, which joins the same groups.
    """
    if distance != 2:
        raise ValueError("the exact way for dense buckets is made for two bits")
    together = agreement(classes)
    groups = group_bits(together, partitions)
    fp = F.col("fp")
    filed = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), _take(fp, bits).alias("value")) for p, bits in enumerate(groups)])).alias("k")).select("fp", "k.*")
    sizes = store(filed.groupBy("p", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    equal = {r["p"]: r["pairs"] for r in sizes.groupBy("p").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    chosen = allocate([expected(g, together, float(equal.get(p, 0.0)), distance) for p, g in enumerate(groups)], distance)

    def values(p: int) -> Column:
        near = _near(_take(fp, groups[p]), groups[p], chosen[p])
        return F.transform(near, lambda v: F.struct(F.lit(p).alias("p"), v.alias("value")))

    used = [p for p, t in enumerate(chosen) if t >= 0]
    shared = filed.where(F.col("p").isin(used))
    if max(chosen) == 0:                         # probes equal what is filed: buckets of one class have no candidates
        shared = store(shared.join(sizes, ["p", "value"]), "shared-buckets")
        probed = shared
    else:
        probes = classes.select("fp", F.explode(F.concat(*map(values, used))).alias("k")).select("fp", "k.*")
        full = filed.groupBy("p", "value").agg(F.count(F.lit(1)).alias("n"))
        shared = store(shared.join(full, ["p", "value"]), "shared-buckets")
        probed = store(probes.join(full, ["p", "value"]), "probes")
    small = shared.where(F.col("n") <= dense)
    other = probed.where(F.col("n") <= dense).select(F.col("fp").alias("b"), "p", "value")
    found = (
        small.select(F.col("fp").alias("a"), "p", "value").join(other, ["p", "value"])
        .where(F.col("a") != F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    crowd = shared.where(F.col("n") > dense).select("fp").unionByName(probed.where(F.col("n") > dense).select("fp")).distinct()
    around = crowd.select("fp", F.explode(_near(fp, list(range(64)), 1)).alias("value"))
    least = (
        around.groupBy("value").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        .select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where(F.col("a") != F.col("b")))
    return found.unionByName(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, root)`` for every node with an edge: ``root`` is the least node that it is connected with.

    Large-star and small-star steps: each node hands its larger, then its smaller neighbours to its least one, until
    every node hangs on its root. Each step is a partial aggregation and a join that AQE may split; every round is
    written, so lineage stays short.
    """
    edges = store(edges.select("a", "b"), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).where(F.col("a") != F.col("b"))
        after = store(small.unionByName(least.select("a", F.col("root").alias("b"))).distinct(), "edges")
        mark = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = after
        if mark == before:
            return edges.withColumnRenamed("b", "root")
        before = mark


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, partitions: int = PARTITIONS, id_column: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``id``, ``key``, ``fp``, ``root`` (least fingerprint of the group) and ``component_id`` of every row of ``docs``.

    ``component_id`` is the least id that can be reached over links, null only if all ids there are null. Empty and null
    texts have fingerprint zero and are linked like others. Repeated rows stay; extra columns are not looked at.
    """
    prints = store(fingerprints(docs, id_column, text), "fingerprints")
    classes = store(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    roots = components(links(classes, distance, partitions)).withColumnRenamed("a", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    table = store(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id"), "class-components")
    return prints.join(table, "fp").select("id", "key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: the one with the least id (of rows that share it, one with the least text hash); columns stay."""
    (row,) = fresh(docs, "_row")
    found = near_duplicates(docs, id_column=id_column, text=text)
    keep = (
        found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id").agg(F.min("key").alias("key"))
        .select(F.struct("id", "key").alias(row)))
    rows = docs.withColumn(row, F.struct(F.col(id_column).alias("id"), text_key(text).alias("key")))
    return rows.join(store(keep, "kept-rows"), row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
