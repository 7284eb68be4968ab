"""WARC archives of pages, and their capture index by an external merge of sorted runs.

Writing. A record is one text and ends with two line breaks, so Spark's text writer with that line end writes whole archives to any
store, and its commit protocol keeps them right when executors are lost. Files are gzip streams of one member. Of records with equal
payloads the one with the least id keeps the payload (``response``), the others name it (``revisit``).

Reading. A gzip file goes to one task, which parses it as a stream by content lengths; payloads may contain line breaks of any kind.

Index. Tasks sort up to ``RUN`` captures at a time by (URL key, time, id): the runs. Every ``BLOCK``-th capture of a run is a sample, and
samples give range limits that all runs are cut at, also inside a URL with many captures. A range's pieces are merged with a loser tree,
so the index is in order within and across ranges, and numbers each URL's captures.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import let, new_path, store

LEAST_BYTES = 0
"""Payloads of fewer bytes are never revisits."""
RUN = 50_000
BLOCK = 500
RANGE_CAPTURES = 200_000
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-capture:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or text: four characters from each five hex digits."""
    def four(v: Column) -> Column:
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return let(F.sha1(payload), lambda h: F.concat(*[
        let(F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int"), four) for i in range(8)]))


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then the rest of the URL: ``org,example,www)/path?query``, A-Z lower-cased."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, r"^[^:/?#]*://([^/?#]*)", 1)
    rest = F.regexp_replace(low, r"^[^:/?#]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _field(url: Column) -> Column:
    """A URL as a header value: blanks and line breaks percent-encoded, other control characters left out."""
    for c in " \t\r\n":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "")


def capture_rows(pages: DataFrame, captured: Column, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(id_column).cast("long").alias("id"), _field(F.coalesce(F.col(url), F.lit(""))).alias("url"),
        F.date_format(F.coalesce(captured, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"))


def _record(revisit: Column) -> Column:
    """The text of a record: header, empty line, block. The line end of the writer closes it."""
    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    first = F.concat(
        F.lit("WARC-Refers-To: "), name(F.col("first.id")), F.lit(f"{line}WARC-Refers-To-Target-URI: "), F.col("first.url"),
        F.lit(f"{line}WARC-Refers-To-Date: "), F.col("first.time"), F.lit(f"{line}WARC-Profile: {PROFILE}{line}"))
    return let(block, lambda b: F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: "), name(F.col("id")), F.lit(f"{line}WARC-Date: "), F.col("time"),
        F.lit(f"{line}WARC-Target-URI: "), F.col("url"), F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(line),
        F.when(revisit, first).otherwise(F.lit("")), F.lit(f"Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(b).cast("string"), F.lit(END), b))


def write_archives(pages: DataFrame, path: str, captured: Column, id_column: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row of ``pages`` to gzip archives below ``path``, those of a task in order of (URL key, time, id).

    Payloads of ``least_bytes`` or more that are equal have one response, the row with the least id; rows that repeat that id are
    responses too. A null payload is empty; a null id counts as the greatest, and rows with one are responses if all ids of the payload
    are null. A null URL is empty, a null time is that of 1970. Extra columns aren't looked at.
    """
    rows = capture_rows(pages, captured, id_column, url, html)
    big = rows.where(F.col("bytes") >= least_bytes)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "time", "url")
    first = big.groupBy("digest", "bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = store(first, "first-captures")        # only payloads that repeat: Spark broadcasts this by its known size, or splits a hot payload
    joined = rows.join(first, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id")) & (F.col("bytes") >= least_bytes)
    sorted_ = joined.sortWithinPartitions(url_key(F.col("url")), "time", "id")
    sorted_.select(_record(revisit).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


_CAPTURE = "id long, key string, time string, url string, type string, digest string, bytes long, refers_to long, file string, offset long, length long"


class _Parser:
    """Records of one archive from its stream, fed piece by piece."""

    def __init__(self, file: str):
        self.file, self.offset, self.need = file, 0, 0
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
        """``(header, block, offset, length)`` of each record that the piece completes."""
        self.held += piece
        while len(self.held) > self.need:
            at = self.held.find(b"\r\n\r\n")
            if at < 0:
                return
            head = dict(line.split(": ", 1) if ": " in line else (line, "") for line in self.held[:at].decode().split("\r\n"))
            size = at + 4 + int(head["Content-Length"])
            if len(self.held) < size + 4:
                self.need = size + 3
                return
            yield head, bytes(self.held[at + 4:size]), self.offset, size
            del self.held[:size + 4]
            self.offset, self.need = self.offset + size + 4, 0

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{self.file} ends inside a record that starts at {self.offset}")


def _number(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(_URN)
    return None if text == "null" else int(text)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The captures of all archives below ``path``: id, URL key, time, URL, type, digest and bytes of the full payload, the id it refers
    to, and file, offset and length of the record in it. With ``payload``, a column of that name has what a response holds.

    A response's payload must have the digest and the length its header states.
    """
    schema = _CAPTURE + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    end = END.encode()

    def capture(file: str, head: dict[str, str], block: bytes, offset: int, length: int) -> tuple:
        at = block.index(end) + 4
        http = block[:at].decode()
        size = int(http.split("Content-Length: ", 1)[1].split("\r\n", 1)[0])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        body = block[at:]
        if head["WARC-Type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
            raise ValueError(f"{file}: the payload of the record at {offset} isn't the one its header describes")
        refers = _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
        own = (_number(head["WARC-Record-ID"]), head["WARC-Date"], head.get("WARC-Target-URI", ""), head["WARC-Type"], digest, size, refers, file, offset, length)
        return (*own, body if head["WARC-Type"] == "response" else None) if payload else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, found, held = _Parser(""), [], 0
        short = pa.schema([f for f in fields if f.name != "key"])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), short)], schema=short)

        for batch in batches:
            for file, value in zip(batch.column("file"), batch.column("value")):
                file = file.as_py()
                if file != parser.file:
                    parser.close()
                    parser = _Parser(file)
                for head, block, offset, length in parser.feed(value.as_py() + end):
                    found.append(capture(file, head, block, offset, length))
                    held += len(block) if payload else 0
                    if len(found) == 4096 or held > 1 << 23:
                        yield batch_of(found)
                        found, held = [], 0
        parser.close()
        if found:
            yield batch_of(found)

    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("file"))
    plain = ", ".join(c for c in schema.split(", ") if not c.startswith("key "))
    return pieces.mapInArrow(run, plain).withColumn("key", url_key(F.col("url"))).select(*names)


class LoserTree:
    """Merges sorted lists: each inner place holds the loser of its match, so the next winner costs one match a level."""

    def __init__(self, lists: list[list], order):
        self.lists, self.order, self.size = lists, order, len(lists)
        self.at = [0] * self.size
        self.heads = [order(own[0]) if own else None for own in lists]     # None: used up, loses to all
        self.losers = [-1] * self.size
        self.winner = self._build(1) if self.size > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _build(self, place: int) -> int:
        """Winner below ``place``; leaves are the places from ``size`` on. Children come before parents, without recursion."""
        won = {}
        for p in range(2 * self.size - 1, 0, -1):
            if p >= self.size:
                won[p] = p - self.size
                continue
            a, b = won.pop(2 * p), won.pop(2 * p + 1)
            won[p], self.losers[p] = (a, b) if self._beats(a, b) else (b, a)
        return won[place]

    def __iter__(self) -> Iterator:
        while self.size and self.heads[self.winner] is not None:
            own = self.winner
            yield self.lists[own][self.at[own]]
            self.at[own] += 1
            self.heads[own] = self.order(self.lists[own][self.at[own]]) if self.at[own] < len(self.lists[own]) else None
            place = (own + self.size) // 2
            while place:
                if self._beats(self.losers[place], own):
                    own, self.losers[place] = self.losers[place], own
                place //= 2
            self.winner = own


def _order(row: dict) -> tuple:
    return row["key"], row["time"], row["id"] is None, row["id"] or 0


def sorted_runs(captures: DataFrame, run_rows: int = RUN, block: int = BLOCK) -> DataFrame:
    """Rows of ``captures`` in sorted runs of at most ``run_rows``: ``run``, ``block`` (number in the run) and the captures of a block."""
    kind = captures.schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def blocks(rows: list[dict]) -> pa.RecordBatch:
            rows.sort(key=_order)
            starts = range(0, len(rows), block)
            name = uuid.uuid5(uuid.NAMESPACE_URL, repr((rows[0], rows[-1]))).hex
            lists = pa.array([rows[i:i + block] for i in starts], pa.list_(pa.struct(batch.schema)))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(lists)), pa.array(range(len(lists)), pa.int32()), lists], ["run", "block", "captures"])

        held = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= run_rows:
                yield blocks(held[:run_rows])
                held = held[run_rows:]
        if held:
            yield blocks(held)

    return captures.mapInArrow(run, f"run string, block int, captures array<{kind}>")


def merged_index(captures: DataFrame, run_rows: int = RUN, block: int = BLOCK, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures, with ``range`` and ``place`` in it, which give the order of (key, time, id), and ``seq``, the number in the URL's history.

    The stored index has its files in that order. Equal captures stay next to each other. A range has about ``range_captures`` captures,
    whatever the number of captures of a URL or host.
    """
    spark = captures.sparkSession
    runs = store(sorted_runs(captures, run_rows, block), "capture-runs")
    total = runs.agg(F.coalesce(F.sum(F.size("captures")), F.lit(0))).first()[0]
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_captures))
    head = F.get("captures", F.lit(0))
    sample = runs.select(head["key"].alias("key"), head["time"].alias("time"), head["id"].isNull().alias("last"), F.coalesce(head["id"], F.lit(0)).alias("id"))
    dealt = sample.repartitionByRange(width, "key", "time", "last", "id").groupBy(F.spark_partition_id().alias("p")).agg(
        F.min(F.struct("key", "time", "last", "id")).alias("m"))
    limits = sorted(tuple(r["m"]) for r in dealt.collect())[1:]       # one a range
    sent = spark.sparkContext.broadcast(limits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = sent.value
        for batch in batches:
            where, names, numbers, lists = [], [], [], []
            for name, number, rows in zip(batch.column("run").to_pylist(), batch.column("block").to_pylist(), batch.column("captures")):
                rows = rows.as_py()
                at = 0
                while at < len(rows):
                    place = bisect.bisect_right(limits, _order(rows[at]))
                    end = len(rows) if place == len(limits) else bisect.bisect_left(rows, limits[place], lo=at, key=_order)
                    where.append(place), names.append(name), numbers.append(number), lists.append(rows[at:end])
                    at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(lists, batch.column("captures").type)],
                ["range", "run", "block", "captures"])

    kind = captures.schema
    pieces = runs.mapInArrow(cut, f"range int, run string, block int, captures array<{kind.simpleString()}>")
    dealt = store(pieces, "capture-pieces").repartitionByRange(width, "range").sortWithinPartitions("range", "run", "block")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, lists, last = None, [], None

        def merged(inner: pa.DataType) -> Iterator[pa.RecordBatch]:
            seq, before, out = 0, None, []
            for place, row in enumerate(LoserTree(lists, _order)):
                seq = seq + 1 if row["key"] == before else 1
                before = row["key"]
                out.append(row | {"range": open_, "place": place, "seq": seq})
                if len(out) == 8192:
                    yield pa.RecordBatch.from_pylist(out, shape(inner))
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, shape(inner))

        def shape(inner: pa.DataType) -> pa.Schema:
            return pa.schema([*inner, ("range", pa.int32()), ("place", pa.int32()), ("seq", pa.int64())])

        for batch in batches:
            inner = batch.column("captures").type.value_type
            for place, name, rows in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), batch.column("captures")):
                if place != open_:
                    if lists:
                        yield from merged(inner)
                    open_, lists, last = place, [], None
                if name != last:
                    lists.append([])
                    last = name
                lists[-1] += rows.as_py()
        if lists:
            yield from merged(inner)

    found = store(dealt.mapInArrow(merge, f"{columns}, range int, place int, seq long"), "capture-index")
    # a URL that goes on from one range to the next keeps counting; only the keys that start a range can
    starts = found.where("place = 0").select("key").distinct()
    spans = found.join(starts, "key", "left_semi").groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = store(spans.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("key", "range", "before"), "history-shifts")
    return found.join(shift, ["key", "range"], "left").withColumn("seq", F.col("seq") + F.coalesce("before", F.lit(0))).select(
        *kind.names, "range", "place", "seq")


def archive(pages: DataFrame, captured: Column, id_column: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back and give their merged index; ``path`` is where the archives go."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, captured, id_column, url, html, least_bytes)
    return merged_index(store(read_archives(spark, path), "captures"))
