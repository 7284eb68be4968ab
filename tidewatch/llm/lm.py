"""Deleted-interpolation language model: n-gram frequencies mixed by how often the context was seen.

The corpus is cut into segments of bounded size. A segment is stored as the hashes of its distinct words and the word number
of every token. To count, each segment sends its distinct n-grams with their own counts, packed by hash range; a range adds
them up and answers each segment with the totals in the order asked. A frequent n-gram is thus one entry a segment however
often it stands there. Words are known by 64-bit hashes, longer n-grams by 56 bits.

The mixture weights are learned by expectation-maximisation on documents kept out of the counts they are judged by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, release, store

ORDER = 2
SEGMENT_BYTES = 4 << 20
RANGES_PER_PARTITION = 2
TOKENS_PER_RANGE = 1 << 22
"""A range holds at most the distinct n-grams of about this many tokens, so a task's memory doesn't follow the corpus."""
HELD_OUT, DEVELOPMENT, FOLDS = 2, 5, 7
CONTEXT_EDGES = (1, 2, 3, 5, 9, 17, 33, 65, 257, 1025, 16385)
"""Contexts are grouped by frequency at these limits; an unseen context is a group of its own."""

_LOWER_BLANK = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order and the number of words of each."""
    joined = np.frombuffer(b"\n".join(texts).translate(_LOWER_BLANK) + b" ", dtype=np.uint8)
    inside = joined != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside].tobytes())])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed: the upper ones are mostly zero."""
    import zstandard

    turned = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(turned.data)


def _from_planes(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(ordered: np.ndarray) -> bytes:
    return _planes(np.diff(ordered, prepend=np.uint64(0)))


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, "<u8"), dtype=np.uint64)


def segments(docs: DataFrame, id_column: str, text: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per segment: documents (``ids``, ``parts``, ``firsts``), ``hashes`` of distinct words, and ``codes`` of its tokens."""
    part = F.when(F.col(id_column).isNull(), F.lit(HELD_OUT)).otherwise(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS)))
    rows = docs.select(F.col(id_column).alias("id"), part.cast("int").alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def one(ids: pa.Array, parts: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        import uuid

        import xxhash

        words, counts = _words(texts)
        coded = words.dictionary_encode()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
        hashes = np.append(hashes, _END)
        firsts = np.concatenate([[0], np.cumsum(counts + 1)])
        codes = np.full(int(firsts[-1]), len(hashes) - 1, dtype=np.int32)
        inside = np.ones(len(codes), dtype=bool)
        inside[firsts[1:] - 1] = False
        codes[inside] = coded.indices.to_numpy()
        use, codes = np.unique(codes, return_inverse=True)
        order = np.argsort(hashes[use])
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        many = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([
            pa.array([uuid.uuid4().hex]), many(ids), many(parts), many(pa.array(firsts.astype(np.int32))),
            pa.array([_pack(hashes[use][order])]), pa.array([_planes(rank[codes].astype("<i4"))])],
            ["segment", "ids", "parts", "firsts", "hashes", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + segment_bytes, side="right")))
                cut = batch.slice(at, end - at)
                yield one(cut.column("id"), cut.column("part"), cut.column("text").to_pylist())
                at = end

    kind = dict(rows.dtypes)["id"]
    return store(rows.mapInArrow(run, (
        f"segment string, ids array<{kind}>, parts array<int>, firsts array<int>, hashes binary, codes binary")), "lm-segments")


def _grams(hashes: np.ndarray, codes: np.ndarray, firsts: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each token; places before a document's start count as a start sign."""
    own = hashes[codes]
    if order == 1:
        return own
    at = np.arange(len(codes))
    begin = np.repeat(firsts[:-1], np.diff(firsts))
    out = own.copy()
    for back in range(1, order):
        before = np.where(at - back >= begin, own[np.maximum(at - back, 0)], _START)
        out = _scramble(out + before * np.uint64(2 * back + 1) + np.uint64(back))
    return out >> np.uint64(8)


def _distinct(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-gram hashes of a segment, the place of each token's in them, and counts in training and development documents."""
    firsts = np.array(row["firsts"], dtype=np.int64)
    grams, inverse = np.unique(_grams(_unpack(row["hashes"]), _from_planes(row["codes"], "<i4"), firsts, order), return_inverse=True)
    part = np.repeat(np.array(row["parts"]), np.diff(firsts))
    train = np.bincount(inverse[part != HELD_OUT], minlength=len(grams))
    dev = np.bincount(inverse[part == DEVELOPMENT], minlength=len(grams))
    return grams, inverse, train, dev


def _cuts(grams: np.ndarray, order: int, ranges: int) -> np.ndarray:
    """Where each hash range begins in sorted n-grams."""
    top = 2.0 ** (64 if order == 1 else 56)
    limits = np.array([int(top * r / ranges) for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, limits), [len(grams)]])


def total_counts(cut: DataFrame, order: int, ranges: int) -> DataFrame:
    """``segment``, ``n``, ``range``, ``train``, ``dev``: totals of a segment's n-grams; ``fresh``: distinct training n-grams of the range."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n in range(1, order + 1):
                    grams, _, train, dev = _distinct(row, n)
                    limits = _cuts(grams, n, ranges)
                    for r, (a, b) in enumerate(zip(limits, limits[1:])):
                        if b > a:
                            yield pa.RecordBatch.from_arrays([
                                pa.array([n], pa.int32()), pa.array([r], pa.int32()), pa.array([row["segment"]]),
                                pa.array([_pack(grams[a:b])]), pa.array([_planes(train[a:b].astype("<i4"))]),
                                pa.array([_planes(dev[a:b].astype("<i4"))])], ["n", "range", "segment", "grams", "train", "dev"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [_unpack(x) for x in table.column("grams").to_pylist()]
        grams, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = {}
        for name in ("train", "dev"):
            own = np.concatenate([_from_planes(x, "<i4") for x in table.column(name).to_pylist()])
            total[name] = np.bincount(inverse, weights=own, minlength=len(grams)).astype("<i8")
        limits = np.cumsum([0, *map(len, asked)])
        spans = [inverse[a:b] for a, b in zip(limits, limits[1:])]
        fresh = [int((total["train"] > 0).sum()), *[0] * (len(asked) - 1)]
        return pa.table({
            "segment": table.column("segment"), "n": table.column("n"), "range": table.column("range"),
            "train": pa.array([_planes(total["train"][s]) for s in spans]), "dev": pa.array([_planes(total["dev"][s]) for s in spans]),
            "fresh": pa.array(fresh, pa.int64())})

    asked = cut.mapInArrow(ask, "n int, range int, segment string, grams binary, train binary, dev binary")
    return store(asked.groupBy("n", "range").applyInArrow(
        answer, "segment string, n int, range int, train binary, dev binary, fresh long"), "lm-totals")


def token_counts(cut: DataFrame, totals: DataFrame, order: int) -> DataFrame:
    """Per segment the counts behind each token: ``train`` and ``dev``, one list per n-gram length."""
    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        answers = sorted(right.select(["n", "range", "train", "dev"]).to_pylist(), key=lambda r: (r["n"], r["range"]))
        train, dev = [], []
        inside = np.repeat(np.array(row["parts"]), np.diff(np.array(row["firsts"]))) == DEVELOPMENT
        for n in range(1, order + 1):
            _, inverse, _, _ = _distinct(row, n)
            own = [a for a in answers if a["n"] == n]
            for name, out in (("train", train), ("dev", dev)):
                counts = np.concatenate([_from_planes(a[name], "<i8") for a in own])[inverse]
                out.append(_planes(counts if name == "train" else np.where(inside, counts, 0)))
        return pa.table({
            "ids": left.column("ids"), "parts": left.column("parts"), "firsts": left.column("firsts"),
            "train": pa.array([train], pa.list_(pa.binary())), "dev": pa.array([dev], pa.list_(pa.binary()))})

    kind = dict(cut.dtypes)["ids"]
    return store(cut.groupBy("segment").cogroup(totals.groupBy("segment")).applyInArrow(
        look, f"ids {kind}, parts array<int>, firsts array<int>, train array<binary>, dev array<binary>"), "lm-counts")


def _ratios(counts: list[np.ndarray], starts: np.ndarray, n_tokens: float, n_docs: float, vocabulary: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of each order (uniform first) and the group of each token's longest context."""
    out = [np.full(len(counts[0]), 1.0 / (vocabulary + 1)), counts[0] / max(n_tokens, 1.0)]
    context = np.full(len(counts[0]), n_tokens)
    for n in range(1, len(counts)):
        context = np.concatenate([[n_docs], counts[n - 1][:-1]]).astype(float)
        context[starts] = n_docs
        out.append(np.where(context > 0, counts[n] / np.maximum(context, 1.0), 0.0))
    return np.stack(out), np.searchsorted(CONTEXT_EDGES, context, side="right")


def fit_weights(counts: DataFrame, order: int, stats: dict, rounds: int = 30, tolerance: float = 1e-4) -> np.ndarray:
    """Mixture weights per context group by expectation-maximisation over all development tokens.

    A development token is judged by the counts of the other training documents. Each round is one pass over the stored
    counts that returns one small table of expectations a task.
    """
    groups = len(CONTEXT_EDGES) + 1
    weights = np.full((groups, order + 1), 1.0 / (order + 1))
    last = -math.inf

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts, firsts = np.array(row["parts"]), np.array(row["firsts"], dtype=np.int64)
                kept = [np.maximum(_from_planes(t, "<i8") - _from_planes(d, "<i8"), 0) for t, d in zip(row["train"], row["dev"])]
                inside = np.repeat(parts, np.diff(firsts)) == DEVELOPMENT
                p, group = _ratios(kept, firsts[:-1], stats["kept_tokens"], stats["kept_docs"], stats["vocabulary"])
                key = np.concatenate([group[None, inside].astype(float), p[:, inside]])
                cells, n = np.unique(key, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([_planes(np.ascontiguousarray(cells.ravel()))]), pa.array([_planes(n.astype("<i8"))])], ["cells", "n"])

    table = store(counts.select("parts", "firsts", "train", "dev").mapInArrow(ratios, "cells binary, n binary"), "lm-development")
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total, gain = np.zeros((groups, order + 1)), 0.0
            for batch in batches:
                for row in batch.to_pylist():
                    cells = _from_planes(row["cells"], "<f8").reshape(order + 2, -1)
                    n, group = _from_planes(row["n"], "<i8"), cells[0].astype(int)
                    parts = weights[group].T * cells[1:]
                    mixed = parts.sum(axis=0)
                    gain += float((n * np.log(mixed)).sum())
                    for k in range(order + 1):
                        total[:, k] += np.bincount(group, weights=n * parts[k] / mixed, minlength=groups)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size + 1), pa.int32()), pa.array([*total.ravel(), gain])], ["cell", "v"])

        sums = {r["cell"]: r["v"] for r in table.mapInArrow(expect, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
        total = np.array([sums.get(i, 0.0) for i in range(groups * (order + 1))]).reshape(groups, order + 1)
        seen = total.sum(axis=1) > 0
        weights = weights.copy()
        weights[seen] = total[seen] / total[seen].sum(axis=1, keepdims=True)
        gain = sums.get(groups * (order + 1), 0.0)
        if gain - last <= tolerance * max(total.sum(), 1.0):
            break
        last = gain
    discard(table)
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(axis=1, keepdims=True)


def score(docs: DataFrame, order: int = ORDER, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities).

    A null or empty text is one end token. A row without an id is held out. Repeated rows count as often as they stand
    there. Without training documents all counts are zero and every token has the uniform probability. Texts are read whole; extra
    columns aren't looked at.
    """
    cut = segments(docs, id_column, text)
    spark = docs.sparkSession
    sizes = cut.select(F.explode(F.arrays_zip("parts", F.slice("firsts", F.lit(2), F.size("parts")).alias("last"),
                                              F.slice("firsts", F.lit(1), F.size("parts")).alias("first"))).alias("d"))
    n = F.col("d.last") - F.col("d.first")
    train, kept = F.col("d.parts") != HELD_OUT, ~F.col("d.parts").isin(HELD_OUT, DEVELOPMENT)
    whole = sizes.agg(
        F.sum(F.when(train, n)).alias("tokens"), F.count(F.when(train, 1)).alias("docs"),
        F.sum(F.when(kept, n)).alias("kept_tokens"), F.count(F.when(kept, 1)).alias("kept_docs")).first()
    stats = {k: float(v or 0) for k, v in whole.asDict().items()}
    ranges = max(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(stats["tokens"] / TOKENS_PER_RANGE))
    totals = total_counts(cut, order, ranges)
    stats["vocabulary"] = float(totals.where("n = 1").agg(F.sum("fresh")).first()[0] or 0)
    release(spark)
    counts = token_counts(cut, totals, order)
    discard(cut)
    discard(totals)
    release(spark)
    weights = fit_weights(counts, order, stats)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for at, row in enumerate(batch.select(["parts", "firsts", "train"]).to_pylist()):
                parts, firsts = np.array(row["parts"]), np.array(row["firsts"], dtype=np.int64)
                own = [_from_planes(t, "<i8") for t in row["train"]]
                p, group = _ratios(own, firsts[:-1], stats["tokens"], stats["docs"], stats["vocabulary"])
                mixed = np.log10((weights[group].T * p).sum(axis=0))
                base = np.log10((own[0] + 1.0) / (stats["tokens"] + stats["vocabulary"] + 1.0))
                add = lambda v: np.add.reduceat(v, firsts[:-1])
                yield pa.RecordBatch.from_arrays([
                    ids[at].values, pa.array(parts == HELD_OUT), pa.array(np.diff(firsts)), pa.array(add((own[0] > 0).astype(np.int64))),
                    pa.array(np.full(len(parts), int(stats["tokens"]), dtype=np.int64)), pa.array(add(base)), pa.array(add(mixed))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(counts.dtypes)["ids"][len("array<"):-1]
    return counts.select("ids", "parts", "firsts", "train").mapInArrow(
        judge, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
