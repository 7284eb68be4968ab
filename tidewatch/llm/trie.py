"""Prefix trie of conversations, its subtree totals by the Euler-tour technique.

A conversation's first ``d`` turns are named by a running sum of hashes of (turn, depth), so names of all prefixes come from
prefix sums, and a node is a group of equal names. Every node has an enter and an exit arc; the successor of each arc (first
child, own exit, next sibling, parent's exit) makes the tour a linked list. The list is ranked in three steps: nodes are numbered
in the order of (conversation, depth), and each range of numbers contracts the runs of the tour that stay inside it; what is left
is halved again and again by joins (an arc whose coin shows tails joins a predecessor that shows heads) until it fits one task of
``ONE_TASK`` runs; then places flow back. A node's leaves and savings are differences of prefix sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import store

STEP = 20
"""Conversation c starts with turns of conversation c - c % STEP."""
LENT = 4
"""It starts with crc32(c) % LENT of them."""
RANGE_NODES = 500_000
ONE_TASK = 1 << 16
CHUNK = 1024
NAME = ["k0", "k1", "k2", "k3"]
_BEFORE = ["p0", "p1", "p2", "p3"]


def _width(df: DataFrame, rows: int) -> int:
    """Number of ranges for ``rows`` nodes: that of a shuffle, or more if a range would get too many."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_NODES))


def turn_table(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``part``, ``rank`` (from 1), ``digest``, ``words`` of every turn.

    Turns go by ``turn`` (null first), then by the digest of role and text. Long conversations are split: ranks are counted
    inside a range of rows and shifted by the rows of the conversation in earlier ranges.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    narrow = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"))
    narrow = store(narrow, "turns")               # read twice: to choose the ranges, then to deal them
    order = ["turn", "digest", "tie"]             # equal turns differ by their tie alone, so they can be split too
    ranged = store(narrow.repartitionByRange(_width(rows, 1), "conv", *order).withColumn("part", F.spark_partition_id()), "turn-ranges")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)).cast("long")
    counts = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("conv", "part", "before")
    placed = ranged.withColumn("rank", place).join(shift, ["conv", "part"], "left")
    return store(placed.select("conv", "part", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "digest", "words"), "ranked-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (``conv``, ``part``, ``depth``, ``digest``, ``words``), all conversations, those of many parts."""
    lent = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(LENT))
    parts = turns.groupBy("conv", "part").agg(F.lit(1).alias("one"))
    heads = turns.where((F.col("conv") % STEP == 0) & (F.col("rank") < LENT)).select(
        F.col("conv").alias("base"), F.col("rank").alias("depth"), "digest", "words")
    heads = store(heads, "lent-turns")
    offered = heads.groupBy("base").agg(F.count(F.lit(1)).alias("offered"))
    convs = parts.groupBy("conv").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("parts")).withColumn("lent", lent)
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % STEP).join(offered, "base", "left")
    convs = store(convs.withColumn("got", F.least("lent", F.coalesce("offered", F.lit(0)))), "conversations")
    short = convs.where("got < lent").select("conv", "got")
    own = turns.withColumn("lent", lent).where(F.col("rank") > F.col("lent")).join(short, "conv", "left").select(
        "conv", "part", (F.col("rank") - F.col("lent") + F.coalesce("got", "lent")).alias("depth"), "digest", "words")
    first = convs.where("got > 0").join(heads, "base").where(F.col("depth") <= F.col("got")).select("conv", "part", "depth", "digest", "words")
    return own.unionByName(first), convs.select("conv"), convs.where("parts > 1").select("conv")


def prefixes(turns: DataFrame, many: DataFrame) -> DataFrame:
    """Adds ``k0`` to ``k3``, the name of the conversation up to this turn, and ``p0`` to ``p3``, up to the one before.

    Each is a sum of 32-bit halves of two 64-bit hashes of (turn, depth); 128 bits in all, so equal names mean equal turns.
    """
    one, two = F.xxhash64("digest", "depth"), F.xxhash64("depth", "digest", F.lit(5))
    halves = [half for h in (one, two) for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    rows = turns.select("*", *[v.alias(f"v{i}") for i, v in enumerate(halves)])
    inside = Window.partitionBy("conv", "part").orderBy("depth")
    spread = rows.join(many, "conv", "left_semi").groupBy("conv", "part").agg(*[F.sum(f"v{i}").alias(f"s{i}") for i in range(4)])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = spread.select("conv", "part", *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in range(4)])
    found = rows.select("conv", "part", "depth", "words", *[f"v{i}" for i in range(4)], *[F.sum(f"v{i}").over(inside).alias(n) for i, n in enumerate(NAME)])
    found = found.join(shift, ["conv", "part"], "left")
    upto = [(F.col(n) + F.coalesce(f"b{i}", F.lit(0))).alias(n) for i, n in enumerate(NAME)]
    before = [(F.col(n) + F.coalesce(f"b{i}", F.lit(0)) - F.col(f"v{i}")).alias(p) for i, (n, p) in enumerate(zip(NAME, _BEFORE))]
    return store(found.select("conv", "depth", "words", *upto, *before), "prefixes")


def node_table(named: DataFrame, convs: DataFrame) -> DataFrame:
    """``node`` (numbered in the order of ``conv``, its least member, then ``depth``), names, ``n_convs``, ``words`` of the last text."""
    nodes = named.groupBy("depth", *NAME).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *[F.min(p).alias(p) for p in _BEFORE])
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(k) for k in NAME])
    nodes = store(nodes.unionByName(root, allowMissingColumns=True), "nodes")
    ordered = nodes.repartitionByRange(_width(nodes, nodes.count()), "conv", "depth").sortWithinPartitions("conv", "depth")
    return store(ordered.withColumn("node", F.monotonically_increasing_id()), "numbered-nodes")


def _range_of(node: str) -> Column:
    return F.shiftright(F.col(node), 33)


def tour(nodes: DataFrame) -> DataFrame:
    """Per node ``first_child``, ``next_sibling``, ``parent``, ``parent_conv`` and ``n_children``: what the arcs' successors follow from.

    Siblings are linked inside a range of numbers; the last one of a range goes on with the first of the parent's next range.
    """
    up = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(NAME, _BEFORE)],
                      F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    kids = nodes.where("depth > 0").select("node", "depth", *_BEFORE).join(up, ["depth", *_BEFORE])
    kids = store(kids.select("node", "parent", "parent_conv", _range_of("node").alias("range")), "children")
    firsts = store(kids.groupBy("parent", "range").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "first-children")
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("parent").orderBy("range"))).where("after IS NOT NULL")
    beside = F.lead("node").over(Window.partitionBy("parent", "range").orderBy("node"))
    linked = kids.withColumn("beside", beside).join(after.select("parent", "range", "after"), ["parent", "range"], "left").select(
        "node", "parent", "parent_conv", F.coalesce("beside", "after").alias("next_sibling"))
    below = firsts.groupBy("parent").agg(F.min("first").alias("first_child"), F.sum("n").alias("n_children")).withColumnRenamed("parent", "node")
    table = nodes.join(linked, "node", "left").join(below, "node", "left")
    return store(table.select(
        "node", "conv", "depth", *NAME, "n_convs", "parent", "parent_conv", "first_child", "next_sibling",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saving")), "tour")


def ranked_runs(succ: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked lists given by ``succ`` (-1: the list ends), each element's head and the weights of all before it, by pointer doubling."""
    head = np.arange(len(succ))
    linked = np.flatnonzero(succ >= 0)
    head[succ[linked]] = linked
    before = np.where((head != np.arange(len(succ)))[:, None], weights[head], 0)
    while True:
        further = head[head]
        if np.array_equal(further, head):
            return head, before
        before = before + np.where((further != head)[:, None], before[head], 0)
        head = further


_LOCAL = ("node long, head long, place long, leaves long, savings long, "
          "exit_head long, exit_place long, exit_leaves long, exit_savings long")


def _contract(table: pa.Table) -> pa.Table:
    """Runs of the tour inside one range of nodes.

    Rows with a node give, for both arcs, the head of their run and what lies before them in it. Rows without are the runs:
    ``head``, the arc that follows in ``exit_head`` and the run's length, leaves and savings.
    """
    def column(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    order = np.argsort(column("node"))
    node, child, sibling, parent, leaf, saving = (column(c)[order] for c in ("node", "first_child", "next_sibling", "parent", "leaf", "saving"))
    arc, succ = np.empty(2 * len(node), dtype=np.int64), np.empty(2 * len(node), dtype=np.int64)
    arc[0::2], arc[1::2] = 2 * node, 2 * node + 1
    succ[0::2] = np.where(child >= 0, 2 * child, 2 * node + 1)
    succ[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
    weights = np.zeros((len(arc), 3), dtype=np.int64)
    weights[:, 0], weights[0::2, 1], weights[0::2, 2] = 1, leaf, saving
    spot = np.minimum(np.searchsorted(arc, succ), len(arc) - 1)
    local = np.where(arc[spot] == succ, spot, -1)
    head, before = ranked_runs(local, weights)
    last = np.flatnonzero(local < 0)
    total = before[last] + weights[last]
    m, r = len(node), len(last)
    cells = [np.concatenate(pair) for pair in (
        (node, np.full(r, -1)), (arc[head[0::2]], arc[head[last]]), (before[0::2, 0], total[:, 0]), (before[0::2, 1], total[:, 1]),
        (before[0::2, 2], total[:, 2]), (arc[head[1::2]], succ[last]))]
    rest = [np.concatenate([before[1::2, i], np.zeros(r, dtype=np.int64)]) for i in range(3)]
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    empty = np.concatenate([np.zeros(m, dtype=bool), np.ones(r, dtype=bool)])
    arrays = [pa.array(cells[0], mask=empty), *[pa.array(c) for c in cells[1:5]], pa.array(cells[5], mask=cells[5] < 0), *map(pa.array, rest)]
    return pa.table(arrays, names=names)


_RUN = ["place", "leaves", "savings"]


def _rank_in_task(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    succ = table.column("succ").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)[order]
    weights = np.column_stack([table.column(c).to_numpy()[order] for c in _RUN])
    spot = np.minimum(np.searchsorted(ids, succ), len(ids) - 1)
    _, before = ranked_runs(np.where(ids[spot] == succ, spot, -1), weights)
    return pa.table([pa.array(ids), *[pa.array(before[:, i]) for i in range(3)]], names=["id", *_RUN])


def rank_list(runs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``id`` and what lies before it in the list (``place``, ``leaves``, ``savings``), for rows ``id``, ``succ`` and their own weights.

    While there are more than ``one_task`` rows, each whose coin shows tails goes into its predecessor if that shows heads: a quarter
    of them a round, so all rounds together move about four times the rows. Every round is stored.
    """
    current, gone = store(runs, "runs"), []
    while current.count() > one_task:
        coin = F.pmod(F.xxhash64("id", F.lit(len(gone))), F.lit(2))
        tails = current.where(coin == 0)
        into = tails.select(*[F.col(c).alias(f"t_{c}") for c in ("id", "succ", *_RUN)])
        joined = store(current.where(coin == 1).join(into, F.col("succ") == F.col("t_id"), "left"), "run-pairs")
        taken = joined.where("t_id IS NOT NULL")
        absorbed = store(taken.select(F.col("t_id").alias("id"), F.col("id").alias("head"), *_RUN), "absorbed-runs")
        merged = joined.select("id", F.when(F.col("t_id").isNull(), F.col("succ")).otherwise(F.col("t_succ")).alias("succ"), *[
            (F.col(c) + F.coalesce(f"t_{c}", F.lit(0))).alias(c) for c in _RUN])
        current = store(merged.unionByName(tails.join(absorbed, "id", "left_anti")), "runs")
        gone.append(absorbed)
    found = store(current.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_rank_in_task, "id long, place long, leaves long, savings long"), "run-places")
    for absorbed in reversed(gone):
        base = found.select(F.col("id").alias("head"), *[F.col(c).alias(f"h_{c}") for c in _RUN])
        back = absorbed.join(base, "head").select("id", *[(F.col(c) + F.col(f"h_{c}")).alias(c) for c in _RUN])
        found = store(found.unionByName(back), "run-places")
    return found


def subtree_totals(table: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Per node of ``tour``: ``enter`` and ``exit`` (places of its arcs), ``n_leaves`` and ``saved`` of its subtree."""
    arcs = table.select("node", "first_child", "next_sibling", "parent", "leaf", "saving", _range_of("node").alias("range"))
    local = store(arcs.groupBy("range").applyInArrow(_contract, _LOCAL), "local-runs")
    runs = local.where("node IS NULL").select(F.col("head").alias("id"), F.col("exit_head").alias("succ"), *_RUN)
    places = rank_list(runs, one_task)
    start = places.select(F.col("id").alias("head"), *[F.col(c).alias(f"s_{c}") for c in _RUN])
    end = places.select(F.col("id").alias("exit_head"), *[F.col(c).alias(f"e_{c}") for c in _RUN])
    both = local.where("node IS NOT NULL").join(start, "head").join(end, "exit_head")
    at = {c: (F.col(c) + F.col(f"s_{c}"), F.col(f"exit_{c}") + F.col(f"e_{c}")) for c in _RUN}
    return both.select(
        "node", at["place"][0].alias("enter"), at["place"][1].alias("exit"), (at["leaves"][1] - at["leaves"][0]).alias("n_leaves"),
        (at["savings"][1] - at["savings"][0]).alias("saved"))


def end_digests(named: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids, in ascending order, of the conversations that end at a node; by the node's name.

    Ids are sorted by ranges of (node, id), so a node that many end at is packed by many tasks into texts of ``CHUNK`` ids. The hash
    itself is sequential: one task reads a node's texts as a stream and holds one at a time.
    """
    key = ["depth", *NAME]
    last = named.groupBy("conv").agg(F.max(F.struct(*key)).alias("last"))
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"last.{k}"), F.lit(0)).alias(k) for k in key])
    ends = store(ends.select(*key, "conv"), "ends")
    schema = "depth long, k0 long, k1 long, k2 long, k3 long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.column_stack([batch.column(k).to_numpy() for k in key])
            conv = batch.column("conv").to_pylist()
            new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])) if len(conv) else np.zeros(0, dtype=np.int64)
            cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(new, [*new[1:], len(conv)])] or [np.zeros(0, dtype=np.int64)])
            ids = [",".join(map(str, conv[a:b])) for a, b in zip(cuts, [*cuts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(names[cuts, i]) for i in range(5)], pa.array([conv[a] for a in cuts], pa.int64()), pa.array(ids, pa.string())], [*key, "first", "ids"])

    packed = ends.repartitionByRange(_width(ends, 1), *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(pack, f"{schema}, first long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(zip(*(batch.column(k).to_pylist() for k in key)), batch.column("ids")):
                if name != open_:
                    if open_ is not None:
                        done.append((*open_, state.hexdigest()))
                    open_, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*done))[:5]], pa.array([d[5] for d in done])], [*key, "sha256"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in open_], pa.array([state.hexdigest()])], [*key, "sha256"])

    return packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{schema}, sha256 string")


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", one_task: int = ONE_TASK) -> DataFrame:
    """One row per node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``, and the places ``enter`` and ``exit`` of its arcs in the tour, from 0.

    Children are visited in the order of their least member. Rows with a null conversation id are left out; null roles and texts are
    empty ones, null turns come first, equal turns go by the MD5 of role and text, repeated rows are turns of their own. Texts are
    hashed whole, whatever their length. Extra columns aren't looked at. Without conversations there is no node.
    """
    turns, convs, many = rebuilt(turn_table(rows, conv, turn, role, text))
    named = prefixes(turns, many)
    table = tour(node_table(named, convs))
    totals = store(subtree_totals(table, one_task), "subtree-totals")
    ends = end_digests(named, convs)
    none = F.lit(hashlib.sha256().hexdigest())
    return table.join(totals, "node").join(ends, ["depth", *NAME], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("sha256", none).alias("ends_sha256"), "enter", "exit")
