"""Near copies by exact Jaccard similarity of word shingles, over all pairs that can reach it.

Texts with one set of shingles form a class, and only classes are compared. The generalised pigeonhole of ``simhash`` comes first: classes
whose fingerprints differ in two bits at most are its candidates. Fingerprints miss most pairs at the lower end of the similarity, so a
prefix filter adds candidates for the rest. All candidates are verified by their exact sets.
A pair of similarity ``t`` shares one of the first ``n - ceil(t n) + 1`` shingles of both sets in any fixed order (prefix filter), so no similar pair is missed. The order
puts shingles that many texts have last; the counts behind it are rough, which changes the work but not the result.

A bucket of more than ``DENSE`` classes would give pairs in the square of its size. Its classes are first compared with
three leaders of the bucket; after that only pairs of different components are still open. Those are compared by their bitmaps,
block of the bucket against block, and only the pairs that may be similar are ever written.

Nearly all shingles stand in one text only, so the prefixes are counted by shingle first, and only those of shingles that are met
again go on. Candidate pairs are first compared by parity bitmaps of about one bit a shingle: two sets differ in at least as many
shingles as their bitmaps do in bits, so what that rules out can't be similar. Only the sets of the others are brought together.
Tables are deleted after their last reader.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, fresh, store, text_key
from tidewatch.llm.simhash import components, fingerprint
from tidewatch.llm.simhash import links as print_pairs

WIDTH = 5
SIMILARITY = 0.8
DENSE = 16
COMMON = 200_000
"""Most shingles of the list of common ones. It only orders; any length gives the same pairs."""
_BLOCK = 1 << 20
_KEPT_WORDS = 1 << 18
_SIDE = 1024
"""Rows of a dense bucket that are compared with as many others at a time."""
_FACTOR = 0x9E3779B97F4A7C15
_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those of frequent ones are kept in a dictionary of bounded size."""
    import xxhash

    if len(_words) > _KEPT_WORDS:
        _words.clear()
    known, digest = _words, xxhash.xxh64_intdigest

    def one(w: bytes) -> int:
        h = known[w] = digest(w, 42)
        return h

    return np.fromiter((known[w] if w in known else one(w) for w in words), dtype=np.uint64, count=len(words))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles; a text with fewer words has one, without words none.

    A shingle's hash mixes a polynomial of its words' hashes, so a text costs one hash a word.
    """
    words = _word_hashes(text.lower().split())
    if not len(words):
        return words
    n = min(width, len(words))
    found = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        found = found * np.uint64(_FACTOR) + words[i:len(words) - n + 1 + i]
    found = (found ^ found >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(found ^ found >> np.uint64(29))


def parity(found: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parities, packed in 64-bit words: bit i is set if an odd number of shingles have a hash of i modulo ``bits``."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def classes_and_counts(rows: DataFrame, width: int) -> DataFrame:
    """Per row ``id``, ``key``, ``cls``, ``fp`` (the fingerprint of ``simhash``), ``size``, ``level`` and two parity bitmaps, ``full`` of 2^level bits and ``half`` of half as many; 2^level is
    the size or up to twice as much, 128 at least. In rows without a class, rough counts ``n`` of ``shingle``: those met three times or more in a
    block of a task."""
    kind = dict(rows.dtypes)["id"]
    words = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rough(parts: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            keep = n > 2
            count = int(keep.sum())
            none = [pa.nulls(count, k) for k in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), words, words)]
            return pa.RecordBatch.from_arrays([*none, pa.array(values[keep].view(np.int64)), pa.array(n[keep])], names)

        names = ["id", "key", "cls", "fp", "size", "level", "full", "half", "shingle", "n"]
        parts, held, seen = [], 0, set()
        for batch in batches:
            found, prints, sizes, levels, full, half = [], [], [], [], [], []
            for t in batch.column("text"):
                own = shingles(t.as_py(), width)
                level = max(7, len(own).bit_length())
                found.append(class_of(own)), prints.append(fingerprint(t.as_py())), sizes.append(len(own)), levels.append(level)
                full.append(parity(own, 1 << level)), half.append(parity(own, 1 << level - 1))
                if found[-1] not in seen:          # copies of a text that the task has met count once
                    seen.add(found[-1])
                    parts.append(own)
                    held += len(own)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("key"), *[pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (found, prints)],
                pa.array(sizes, pa.int32()), pa.array(levels, pa.int32()), pa.array(full, words), pa.array(half, words), none, none], names)
            if held > 4 * _BLOCK:
                yield rough(parts, batch.column("id").type)
                parts, held, seen = [], 0, set()
        if parts:
            yield rough(parts, batch.column("id").type)

    return rows.mapInArrow(run, f"id {kind}, key long, cls long, fp long, size int, level int, full array<long>, half array<long>, shingle long, n long")


def common_shingles(counted: DataFrame, dense: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than ``dense`` texts have and their rough counts, at most ``most`` of them, in the order of their hashes."""
    total = counted.where("cls IS NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > dense)
    got = total.orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    values = got["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    at = np.argsort(values)
    return values[at], got["n"].to_numpy(dtype=np.int64)[at]


def prefixes(texts: DataFrame, width: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``cls``, ``size`` and ``shingle`` for the first shingles of each text in the order of rough count, then hash.

    A task gives a class once, so copies cost at most a row of classes for each task.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value

        def first(found: np.ndarray) -> np.ndarray:
            p = prefix_length(len(found), similarity)
            if not len(known):
                return found[:p]
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            weight = np.where(known[at] == found, counts[at], 0)
            return found[np.lexsort((found, weight))[:p]]

        def block(ids: list[int], sizes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            n = [len(p) for p in parts]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), n)),
                pa.array(np.concatenate(parts).view(np.int64))], ["cls", "size", "shingle"])

        ids, sizes, parts, held, seen = [], [], [], 0, set()
        for batch in batches:
            for t in batch.column("text"):
                found = shingles(t.as_py(), width)
                c = np.uint64(class_of(found)).view(np.int64)
                if c in seen:
                    continue
                seen.add(c)
                ids.append(c), sizes.append(len(found)), parts.append(first(found))
                held += len(parts[-1])
                if held > _BLOCK:
                    yield block(ids, sizes, parts)
                    ids, sizes, parts, held = [], [], [], 0
        if parts:
            yield block(ids, sizes, parts)

    return texts.select("text").mapInArrow(run, "cls long, size int, shingle long")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """``cls``, ``size`` and ``items``, all its shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(p) for p in parts], pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["cls", "size", "items"])

        for batch in batches:
            ids, parts, held = [], [], 0
            for c, t in zip(batch.column("cls"), batch.column("text")):
                ids.append(c.as_py()), parts.append(shingles(t.as_py(), width).view(np.int64))
                held += len(parts[-1])
                if held > _BLOCK:
                    yield rows(ids, parts)
                    ids, parts, held = [], [], 0
            if ids:
                yield rows(ids, parts)

    return texts.select("cls", "text").mapInArrow(run, "cls long, size int, items array<long>")


def _sizes_fit(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - F.lit(1e-9)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


class Texts:
    """The rows of a table and their classes; gives one text for each of some classes without keeping a copy of all."""

    def __init__(self, rows: DataFrame, named: DataFrame):
        self.rows, self.named = rows, named

    def bitmaps(self, classes: DataFrame) -> DataFrame:
        return self.named.join(classes, "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "size", "level", "full", "half")

    def of(self, classes: DataFrame) -> DataFrame:
        """``cls``, ``text`` of one row for each of ``classes``; copies of the row may give it again. The chosen rows' keys are stored, so that Spark knows their size."""
        one = self.named.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "key")).alias("row"))
        one = store(one, "class-rows")
        return self.rows.select(F.struct("id", "key").alias("row"), "text").join(one, "row").select("cls", "text")


def _classes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of both classes as ``<column>_a`` and ``<column>_b``."""
    for end in "ab":
        pairs = pairs.join(table.select(F.col("cls").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def _possible(pairs: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose bitmaps leave room for the similarity: at most (1 - t) / (1 + t) of both sizes may differ."""
    both = _with_both(pairs, bitmaps, ["size", "level", "full", "half"])
    one, two = (F.when(F.col(f"level_{x}") > F.col(f"level_{y}"), F.col(f"half_{x}")).otherwise(F.col(f"full_{x}")) for x, y in ("ab", "ba"))
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    fits = (F.abs(F.col("level_a") - F.col("level_b")) <= 1) if similarity >= 0.5 else F.lit(True)
    return both.where(fits & (F.when(F.abs(F.col("level_a") - F.col("level_b")) <= 1, apart).otherwise(0) <= most)).select("a", "b")


def verified(pairs: DataFrame, texts: Texts, width: int, similarity: float, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets of shingles are as similar as asked."""
    pairs = store(pairs, f"{name}-candidates")
    bitmaps = store(texts.bitmaps(_classes(pairs)), f"{name}-bitmaps")
    possible = store(_possible(pairs, bitmaps, similarity), f"{name}-possible")
    discard(pairs), discard(bitmaps)
    sets = store(sets_of(texts.of(_classes(possible)), width).dropDuplicates(["cls"]), f"{name}-sets")
    both = _with_both(possible, sets, ["size", "items"])
    shared = both.select("a", "b", F.size(F.array_intersect("items_a", "items_b")).alias("n"), (F.col("size_a") + F.col("size_b")).alias("total"))
    found = store(shared.where(F.col("n") / (F.col("total") - F.col("n")) >= similarity).select("a", "b"), f"{name}-links")
    discard(possible), discard(sets)
    return found


def _may_match(left: pa.Table, right: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a left and a right row with different roots whose bitmaps leave room for the similarity."""
    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    share = (1 - similarity) / (1 + similarity)
    for one in np.unique(column(left, "level")):
        at = np.flatnonzero(column(left, "level") == one)
        for two in (one - 1, one, one + 1):
            to = np.flatnonzero(column(right, "level") == two)
            if not len(to):
                continue
            bits = [np.stack(t.column("half" if own > other else "full").take(pa.array(rows)).to_numpy()).view(np.uint64)
                    for t, rows, own, other in ((left, at, one, two), (right, to, two, one))]
            size, root = ([column(t, n)[rows] for t, rows in ((left, at), (right, to))] for n in ("size", "root"))
            step = max(1, (1 << 21) // (len(to) * bits[0].shape[1]))
            for k in range(0, len(at), step):
                part = slice(k, k + step)
                apart = np.bitwise_count(bits[0][part, None, :] ^ bits[1][None, :, :]).sum(axis=2)
                near = (apart <= (size[0][part, None] + size[1][None, :]) * share + 1e-6) & (root[0][part, None] != root[1][None, :])
                i, j = np.nonzero(near)
                if len(i):
                    yield at[part][i], to[j]


def _crowd_pairs(rows: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of different roots that share a dense shingle and may be similar.

    ``rows``: ``shingle``, ``cls``, ``root`` and ``largest``, the root with most of the bucket's rows. All others of a bucket are compared with
    all of it, cut into blocks, so a bucket of any size goes to many tasks of bounded size. A pair comes once, from the least of the
    buckets that both are in.
    """
    lists = rows.groupBy("cls").agg(F.array_sort(F.collect_list("shingle")).alias("buckets"))     # at most a prefix each
    apart = F.col("root") != F.col("largest")
    counts = rows.groupBy("shingle").agg(F.sum(apart.cast("long")).alias("nl"), F.count(F.lit(1)).alias("nr"))
    blocks = lambda n: F.ceil(F.col(n) / _SIDE).cast("int")
    full = rows.join(bitmaps.join(lists, "cls"), "cls").withColumn("apart", apart).join(counts.where("nl > 0"), "shingle").withColumns({"bl": blocks("nl"), "br": blocks("nr")})
    own = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["shingle", "cls", "root", "apart", "size", "level", "full", "half", "buckets"]
    left = full.where("apart").select(*keep, F.lit(0).alias("side"), own("bl").alias("i"), every("br").alias("j"))
    right = full.select(*keep, F.lit(1).alias("side"), own("br").alias("j"), every("bl").alias("i"))
    key = ["shingle", "i", "j"]
    dealt = left.unionByName(right).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            names = np.column_stack([table.column(k).to_numpy() for k in key])
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), table.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]) if last else zip(cuts[:-2], cuts[1:-1]):
                part = table.slice(a, b - a).combine_chunks()
                side = part.column("side").to_numpy()
                one, two = part.filter(pa.array(side == 0)), part.filter(pa.array(side == 1))
                cls, other = one.column("cls").to_numpy(), two.column("cls").to_numpy()
                both = two.column("apart").to_numpy()          # such pairs are met from either side
                lists = [t.column("buckets").to_numpy() for t in (one, two)] if len(one) and len(two) else []
                for x, y in _may_match(one, two, similarity):
                    turn = ~both[y] | (cls[x] > other[y])
                    pairs = [(p, q) for p, q in zip(x[turn], y[turn])
                             if np.intersect1d(lists[0][p], lists[1][q], assume_unique=True)[0] == names[a][0]]
                    if pairs:
                        u, v = (np.array(c) for c in zip(*pairs))
                        u, v = cls[u], other[v]
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["a", "b"])
            held[:] = [] if last else table.slice(cuts[-2]).to_batches()

        for batch in batches:
            if batch.num_rows:
                yield from groups(pa.Table.from_batches([*held, batch]), False)
        if held:
            yield from groups(pa.Table.from_batches(held), True)

    return dealt.mapInArrow(run, "a long, b long")


def pigeonhole_pairs(texts: Texts) -> DataFrame:
    """Candidate pairs ``(a, b)`` of classes with linked fingerprints, stored.

    Classes of one fingerprint are paired with the least of them, and linked fingerprints by their least classes.
    """
    prints = store(texts.named.select("fp", "cls").distinct(), "class-prints")
    least = store(prints.groupBy("fp").agg(F.min("cls").alias("least")), "least-classes")
    within = prints.join(least, "fp").select(F.col("cls").alias("a"), F.col("least").alias("b"))
    between = print_pairs(least.select("fp"))
    for end in "ab":
        between = between.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"least_{end}")), end)
    between = between.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    pairs = store(within.unionByName(between).where("a <> b"), "pigeonhole-pairs")
    discard(prints), discard(least)
    return pairs


def links(texts: Texts, common: tuple[np.ndarray, np.ndarray], width: int = WIDTH, similarity: float = SIMILARITY, dense: int = DENSE) -> DataFrame:
    """Pairs ``(a, b)``, a > b, of similar classes that connect all that are linked."""
    first = pigeonhole_pairs(texts)
    heads = store(prefixes(texts.rows, width, similarity, common), "prefixes")
    again = store(heads.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"), "shared-shingles")
    shared = store(heads.join(again, "shingle", "left_semi").distinct(), "shared-prefixes")
    discard(heads), discard(again)
    counts = shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    sized = store(shared.join(counts.where("n > 1"), "shingle"), "bucketed-prefixes")
    discard(shared)
    small = sized.where(F.col("n") <= dense).drop("n")
    other = small.select("shingle", F.col("cls").alias("b"), F.col("size").alias("sb"))
    pairs = small.withColumnRenamed("cls", "a").join(other, "shingle").where((F.col("a") > F.col("b")) & _sizes_fit(F.col("size"), F.col("sb"), similarity))
    crowd = sized.where(F.col("n") > dense).drop("n")
    leaders = crowd.groupBy("shingle").agg(*[F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "size")).alias(f"l{k}") for k in range(3)])
    leaders = store(leaders.select("shingle", F.explode(F.array("l0", "l1", "l2")).alias("l")).select(
        "shingle", F.col("l.cls").alias("b"), F.col("l.size").alias("sb")).distinct(), "leaders")
    star = (
        crowd.withColumnRenamed("cls", "a").join(leaders, "shingle").where(F.col("a") != F.col("b"))
        .where(_sizes_fit(F.col("size"), F.col("sb"), similarity)))
    found = verified(_ordered(first.unionByName(pairs.select("a", "b")).unionByName(star.select("a", "b"))), texts, width, similarity, "near")
    discard(first)

    # in dense buckets, pairs that are still in different components
    roots = components(found).withColumnRenamed("a", "cls")
    named = store(crowd.select("shingle", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "crowd")
    per = named.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = store(named.join(most.select("shingle", F.col("most.root").alias("largest")), "shingle"), "open-crowd")
    discard(sized), discard(named), discard(leaders)
    bitmaps = store(texts.bitmaps(open_.select("cls").distinct()), "crowd-bitmaps")
    rest = verified(_crowd_pairs(open_, bitmaps, similarity), texts, width, similarity, "crowd")
    discard(open_), discard(bitmaps)
    return found.unionByName(rest)


def drop_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, dense: int = DENSE, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row of each group of linked near copies: the one with the least id (of rows that share it, one with the least text hash).

    Texts are linked if the Jaccard similarity of their word shingles is ``similarity`` or more; a group is what links
    connect. Texts without words are equal to each other. All columns stay; an id that is null counts only if all are.
    """
    (row,) = fresh(docs, "_row")
    counted = store(classes_and_counts(_rows(docs, id_column, text), width), "shingle-classes")
    named = counted.where("cls IS NOT NULL").drop("shingle", "n")
    texts = Texts(_rows(docs, id_column, text), named)
    roots = components(links(texts, common_shingles(counted, dense), width, similarity, dense)).withColumnRenamed("a", "cls")
    rooted = named.select("id", "key", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    keep = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("m"))
    keep = store(keep.select(F.struct("m.id", "m.key").alias(row)), "kept-rows")
    discard(counted)
    rows = docs.withColumn(row, F.struct(F.col(id_column).alias("id"), text_key(text).alias("key")))
    return rows.join(keep, row, "left_semi").dropDuplicates([row]).select(*docs.columns)
