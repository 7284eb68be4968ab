"""Benchmark decontamination with a distributed positional inverted index.

The index is a table: documents are gathered into segments of a bounded size, and each segment stores, per term, the places
where it stands. A phrase lies within one document and so within one segment, so nothing is shuffled to build the index and
each segment is searched by itself. Places count on through a segment with a gap after each document.

A search joins the terms of the test items with the index and counts them. Where the rarest term of a phrase stands, it brings the
lists of the segment together and intersects them, shifted by the term's offset, the shortest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, store, text_key

WINDOW = 10
SEGMENT_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20
"""Test items are searched in blocks of about this much text; only a block's windows go to the tasks."""

_TO_WORDS = bytes(b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.translate(_TO_WORDS).split()


def _segment(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and the number of words of each text; without a Python step per word."""
    joined = np.frombuffer(b"\n".join(texts).translate(_TO_WORDS) + b" ", dtype=np.uint8)
    inside = joined != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside].tobytes())])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


def _postings(segment: str, ids: pa.Array, keys: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of one segment: a null term with the documents and their first places, then the terms with their places."""
    words, counts = _segment(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = (np.arange(len(words)) + doc).astype(np.int32)      # a gap of one after each document
    firsts = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)
    names = ["segment", "term", "places", "ids", "keys"]
    yield pa.RecordBatch.from_arrays([
        pa.array([segment]), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(firsts)], pa.int32()), pa.array(firsts)),
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)], names)
    if not len(words):
        return
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    limits = np.concatenate([[0], np.cumsum(np.bincount(codes))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(place[order]))
    step = 50_000
    for at in range(0, len(lists), step):
        part = lists.slice(at, step)
        n = len(part)
        yield pa.RecordBatch.from_arrays([
            pa.array([segment] * n), coded.dictionary.slice(at, step), part,
            pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(keys.type))], names)


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Positional postings of whole texts: ``segment``, ``term``, ``places``, and on the row without a term ``ids`` and ``keys``.

    Every row gets a place in a segment, also one without words or id. A segment holds at most ``segment_bytes`` of text or
    one longer document. The table is stored; a search reads it and no text.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + segment_bytes, side="right")))
                part = batch.slice(at, end - at)
                yield from _postings(uuid.uuid4().hex, part.column("id"), part.column("key"), part.column("text").to_pylist())
                at = end

    kind = dict(rows.dtypes)["id"]
    schema = f"segment string, term binary, places array<int>, ids array<{kind}>, keys array<long>"
    return store(rows.mapInArrow(run, schema), "postings")


def windows(texts: list[str], width: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """Every ``width`` consecutive words of a text, or its only words if there are fewer, with the numbers of the texts that have them."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for number, text in enumerate(texts):
        words = words_of(text.encode())
        if words:
            for phrase in {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}:
                out.setdefault(phrase, []).append(number)
    return out


def phrase_starts(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...]) -> np.ndarray:
    """Places where ``phrase`` begins: the lists shifted by the offset, the shortest first, each narrowing the last."""
    at = sorted(range(len(phrase)), key=lambda i: len(lists.get(phrase[i], ())))
    found = None
    for i in at:
        own = lists.get(phrase[i])
        if own is None:
            return np.empty(0, dtype=np.int64)
        if found is None:
            found = own.astype(np.int64) - i
        else:
            spot = np.searchsorted(own, found + i)
            found = found[(spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] == found + i)]
        if not len(found):
            break
    return found


def near_spans(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], span: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the shortest stretches of a document, of ``span`` places at most, that hold all words of ``phrase``.

    ``firsts`` are the documents' first places. Each stretch begins with one of the words and has each of them; one for each such
    begin. A stretch has the rarest word, so only places around that one's are looked at.
    """
    terms = sorted(set(phrase), key=lambda t: len(lists.get(t, ())))
    none = np.empty(0, dtype=np.int64)
    if any(t not in lists for t in terms):
        return none, none
    rare = lists[terms[0]].astype(np.int64)
    starts = []
    for t in terms:                               # begins: places of any word at most ``span`` before a place of the rarest one
        own = lists[t].astype(np.int64)
        next_rare = np.searchsorted(rare, own)
        near = (next_rare < len(rare)) & (rare[np.minimum(next_rare, len(rare) - 1)] < own + span)
        starts.append(own[near])
    starts = np.unique(np.concatenate(starts))
    end = starts.copy()
    for t in terms:
        own = lists[t].astype(np.int64)
        at = np.searchsorted(own, starts)
        end = np.where(at < len(own), np.maximum(end, own[np.minimum(at, len(own) - 1)]), np.iinfo(np.int64).max)
        starts, end = starts[end < starts + span], end[end < starts + span]
    same = np.searchsorted(firsts, starts, side="right") == np.searchsorted(firsts, end, side="right")
    return starts[same], (end - starts + 1)[same]


def _block_matches(index: DataFrame, texts: list, width: int, slack: int | None) -> DataFrame:
    """``segment``, ``doc``, ``start``, ``length`` and ``text`` (number in ``texts``) of what is found."""
    spark = index.sparkSession
    phrases = windows(texts, width)
    vocabulary = sorted({w for p in phrases for w in p})
    # stored, so that Spark knows its size and needn't shuffle the index if the block's vocabulary is small
    terms = store(spark.createDataFrame([(None,), *[(bytearray(t),) for t in vocabulary]], "term binary").coalesce(1), "test-terms")
    rows = index.join(terms, index["term"].eqNullSafe(terms["term"]), "left_semi").select("segment", "term", "places")
    counts = {bytes(r["term"]): r["n"] for r in rows.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("places")).alias("n")).collect()}
    # a phrase is looked for only where its rarest term over the whole index stands; one with a term that is nowhere, not at all
    by_rarest: dict[bytes, list[tuple[bytes, ...]]] = {}
    for phrase in phrases:
        if all(t in counts for t in phrase):
            by_rarest.setdefault(min(phrase, key=lambda t: (counts[t], t)), []).append(phrase)

    def search(table: pa.Table) -> pa.Table:
        lists, firsts = {}, None
        for term, places in zip(table.column("term").to_pylist(), (x.values for x in table.column("places"))):
            if term is None:
                firsts = places.to_numpy()
            else:
                lists[term] = places.to_numpy()
        doc, start, length, item = [], [], [], []
        for term in lists.keys() & by_rarest.keys():
            for phrase in by_rarest[term]:
                if slack is None:
                    found = phrase_starts(lists, phrase)
                    size = np.full(len(found), len(phrase))
                else:
                    found, size = near_spans(lists, phrase, len(phrase) + slack, firsts)
                if len(found):
                    where = np.searchsorted(firsts, found, side="right") - 1
                    for number in phrases[phrase]:
                        doc.append(where), start.append(found - firsts[where]), length.append(size)
                        item.append(np.full(len(found), number))
        join = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
        doc, start, length, item = join(doc), join(start), join(length), join(item)
        return pa.table({
            "segment": pa.array([table.column("segment")[0].as_py()] * len(doc), pa.string()), "doc": pa.array(doc, pa.int32()),
            "start": pa.array(start, pa.int32()), "length": pa.array(length, pa.int32()), "text": pa.array(item, pa.int32())})

    return rows.groupBy("segment").applyInArrow(search, "segment string, doc int, start int, length int, text int")


def matches(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW,
            slack: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of the windows of ``items``: ``segment``, ``doc`` (number in it), ``start``, ``length``, ``item_id``.

    ``slack=None`` finds exact phrases. With a number, it finds the stretches of one document that hold all words of a window, in
    any order, within ``slack`` places more than the window has: for each begin the shortest. Distinct texts of items go to the tasks
    in blocks of about ``block_bytes``, dealt by a hash; items join the result by their text, so texts that many items share count once.
    """
    rows = items.select(F.col(item_id).alias("item_id"), F.md5(text).alias("digest"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = store(rows.select("digest", "text").dropDuplicates(["digest"]), "test-texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = None
    for b in range(blocks):
        got = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        numbered = items.sparkSession.createDataFrame([(i, r["digest"]) for i, r in enumerate(got)], "number int, digest string")
        one = _block_matches(index, [r["text"] for r in got], width, slack)
        one = one.join(numbered, one["text"] == numbered["number"]).select("segment", "doc", "start", "length", "digest")
        out = one if out is None else out.unionByName(one)
    return out.join(rows.select("item_id", "digest").distinct(), "digest").select("segment", "doc", "start", "length", "item_id")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_column: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id``, ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted, comma-joined), ``contaminated``.

    A word inside any occurrence of a window counts once. Null and empty texts have no words and no hits; items without
    words are never found; repeated rows and repeated items are taken as they come, an item id counts once.
    """
    index = build_index(docs, id_column, text)
    found = store(matches(index, items, item_id, item_text, width), "benchmark-matches")
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    hit = found.select("segment", "doc", place.alias("place")).distinct().groupBy("segment", "doc").agg(F.count(F.lit(1)).alias("n_hit"))
    which = (
        found.select("segment", "doc", F.col("item_id").cast("string").alias("item")).distinct().groupBy("segment", "doc")
        .agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")))
    marks = hit.join(which, ["segment", "doc"])
    table = index.where(F.col("term").isNull())
    every = table.select("segment", "places", F.posexplode(F.arrays_zip("ids", "keys")).alias("doc", "d")).select(
        "segment", "doc", "d.ids", "d.keys",
        (F.get("places", F.col("doc") + 1) - F.get("places", F.col("doc")) - 1).cast("long").alias("n_words"))
    return every.join(marks, ["segment", "doc"], "left").select(
        F.col("ids").alias("id"), F.col("keys").alias("key"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window; all columns stay."""
    (row,) = fresh(docs, "_row")
    bad = contamination(docs, items, id_column=id_column, text=text).where("contaminated")
    bad = store(bad.select(F.struct("id", "key").alias(row)).distinct(), "contaminated")
    rows = docs.withColumn(row, F.struct(F.col(id_column).alias("id"), text_key(text).alias("key")))
    return rows.join(bad, row, "left_anti").select(*docs.columns)
