"""The prefix trie of conversations, by a sweep over sorted turn arrays.

A conversation is an array of tokens, 128 bits of a turn's hash and the length of its text, as one binary value; so values in
order are arrays in order, and what two neighbours share in front is their longest common prefix. The arrays are
range-partitioned and sorted over the whole cluster. Each partition is swept once with a stack of the open prefixes: a
neighbour that shares less closes the nodes below. Nodes on the path of a partition's first or last array may go on in other
partitions; these open stacks, a path or two for each partition, are stitched in a second sweep. A third, from the top down,
gives each node its parent's number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, ids, longs

#: Bytes of a token: 16 of the turn's hash, 4 of its text's length in code points.
TOKEN = 20
EMPTY = hashlib.sha256().hexdigest()
#: Ids of a split run that go into one row.
RUN = 4096
SWEPT = "part int, number long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, points long, ends_sha256 string, node binary, run array<long>"
STITCHED = "node binary, part int, number long, conv_id long, n_convs long, n_children long, n_leaves long, saved long"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _tokens(convs: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, what it is ordered by, and its token."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(text, 256)
    token = F.concat(F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, sha), 256)), 1, TOKEN - 4), F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(sha).alias("sha"), token.alias("token"))


def _join_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array for each conversation of turns in order."""
    conv, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        of, data = longs(batch.column("conv_id")), b"".join(batch.column("token").to_pylist())
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        out: list[tuple[int, bytes]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if conv is not None and of[a] != conv:
                out.append((conv, b"".join(parts)))
                parts = []
            conv = of[a]
            parts.append(data[a * TOKEN : b * TOKEN])
        if out:
            yield _arrays(out)
    if conv is not None:
        yield _arrays([(conv, b"".join(parts))])


def _arrays(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids(np.array([c for c, _ in rows], np.int64)), pa.array([t for _, t in rows], pa.binary())], names=["conv_id", "turns"])


def turn_arrays(convs: DataFrame) -> DataFrame:
    """conv_id and ``turns``, the tokens of its turns in order: by turn, null first, then by role and the SHA-256 of the text."""
    bound_batches(convs.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "sha"]
    return _tokens(convs).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "token").mapInArrow(_join_turns, "conv_id long, turns binary")


def grafted(arrays: DataFrame) -> DataFrame:
    """``arrays`` in which each conversation c begins with the first h turns of c - c % 100, h being crc32 of c in decimal, modulo 6, in place of its own.

    Where that conversation has fewer turns all are taken, where there is none, none. A conversation without an id stays as it is.
    """
    arrays = cut(arrays)
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    heads = arrays.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.substring("turns", 1, 5 * TOKEN).alias("head"))
    own = arrays.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": F.coalesce(h, F.lit(0)) * TOKEN})
    both = own.join(heads, "base", "left")
    rest = F.expr("substring(turns, h + 1, greatest(octet_length(turns) - h, 0))")
    return both.select("conv_id", F.concat(F.coalesce(F.expr("substring(head, 1, h)"), F.lit(b"")), rest).alias("turns"))


class _Node:
    """A prefix that is open: what is known of its members so far."""

    __slots__ = ("conv", "convs", "children", "leaves", "saved", "points", "number", "sha")

    def __init__(self, number: int, points: int):
        self.conv, self.convs, self.children, self.leaves, self.saved, self.points, self.number, self.sha = None, 0, 0, 0, 0, points, number, None

    def close(self) -> None:
        """What holds of a node once all its members and children are known."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.convs - 1) * self.points

    def add(self, conv: int | None, convs: int) -> None:
        self.convs += convs
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def take(self, child: _Node) -> None:
        self.add(child.conv, child.convs)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def _shared(a: bytes, b: bytes) -> int:
    """Tokens that both have in front."""
    low, high = 0, min(len(a), len(b)) // TOKEN + 1  # the first low tokens agree, the first high ones don't, or aren't there
    step = 1
    while low + step < high and a[low * TOKEN : (low + step) * TOKEN] == b[low * TOKEN : (low + step) * TOKEN]:
        low, step = low + step, step * 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * TOKEN : mid * TOKEN] == b[low * TOKEN : mid * TOKEN] else (low, mid)
    return low


class _Sweep:
    """The sweep over one partition. Rows go out with the number that a node got when it was opened, so parents have smaller ones."""

    def __init__(self, part: int):
        self.part, self.numbers, self.stack, self.turns, self.first = part, 0, [], None, None
        self.first_path: set[int] = set()
        self.out: list[tuple] = []
        self.run: list[np.ndarray] = []
        self.sha, self.run_convs, self.run_first = hashlib.sha256(), 0, True

    def _open(self, points: int) -> None:
        self.stack.append(_Node(self.numbers, points))
        self.numbers += 1

    def _emit(self, node: _Node, depth: int, key: bytes | None, run: list[int] | None = None) -> None:
        self.out.append((self.part, node.number, depth, node.conv, node.convs, node.children, node.leaves, node.saved, node.points, node.sha, key, run))

    def _end_run(self, split: bool) -> None:
        """The run of equal arrays is over; ``split``: others of it may be in the partitions beside this one."""
        node, depth = self.stack[-1], len(self.stack) - 1
        if not split:
            node.sha = self.sha.hexdigest()
            return
        key, convs = _key(self.turns), np.concatenate(self.run)
        for a in range(0, len(convs), RUN):
            piece = convs[a : a + RUN]
            self.out.append((self.part, None, depth, int(piece[0]), 0, 0, 0, 0, 0, None, key, piece.tolist()))

    def _close(self, depth: int) -> None:
        """Closes all nodes below ``depth``; those of the first path stay open elsewhere, so they go out as they are."""
        while len(self.stack) - 1 > depth:
            node, at = self.stack[-1], len(self.stack) - 1
            if node.number in self.first_path:
                self._emit(node, at, _key(self.turns[: at * TOKEN]))
            else:
                node.close()
                self._emit(node, at, None)
                self.stack[-2].take(node)
            self.stack.pop()

    def rows(self, convs: np.ndarray, turns: bytes) -> None:
        """Conversations of equal arrays; the next call may bring more of them."""
        if turns != self.turns:
            if self.turns is None:
                self._open(0)
                shared = 0
            else:
                self._end_run(self.run_first)
                self.run_first = False
                shared = _shared(self.turns, turns)
                self._close(shared)
            for k in range(shared, len(turns) // TOKEN):
                self._open(int.from_bytes(turns[(k + 1) * TOKEN - 4 : (k + 1) * TOKEN], "big"))
            if self.turns is None:
                self.first_path = {n.number for n in self.stack}
            self.turns, self.run, self.run_convs, self.sha = turns, [], 0, hashlib.sha256()
        self.stack[-1].add(int(convs.min()), len(convs))
        self.sha.update((b"," * bool(self.run_convs)) + _decimals(convs))
        self.run.append(convs)
        self.run_convs += len(convs)

    def end(self) -> None:
        if self.turns is not None:
            self._end_run(True)
            for depth in range(len(self.stack) - 1, -1, -1):
                self._emit(self.stack[depth], depth, _key(self.turns[: depth * TOKEN]))

    def taken(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        columns, self.out = list(zip(*self.out, strict=True)), []
        kinds = [pa.int32(), *[pa.int64()] * 8, pa.string(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SWEPT.split(", ")])


def _decimals(convs: np.ndarray) -> bytes:
    return ",".join("" if c == np.iinfo(np.int64).min else str(c) for c in convs.tolist()).encode()


def _key(turns: bytes) -> bytes:
    return hashlib.sha256(turns).digest()


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(TaskContext.get().partitionId())
    for batch in batches:
        if not batch.num_rows:
            continue
        convs, turns = longs(batch.column("conv_id")), batch.column("turns").to_pylist()
        a = 0
        for b in range(1, len(turns) + 1):
            if b == len(turns) or turns[b] != turns[a]:
                sweep.rows(convs[a:b], turns[a])
                a = b
        if out := sweep.taken():
            yield out
    sweep.end()
    if out := sweep.taken():
        yield out


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open nodes of all partitions in order of partition and number, so each path follows the one it goes on from."""
    stack: list[tuple[bytes, int, _Node]] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            key, part, node = stack.pop()
            node.close()
            out.append((key, part, node.number, node.conv, node.convs, node.children, node.leaves, node.saved))
            if stack:
                stack[-1][2].take(node)

    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            if depth >= len(stack) or stack[depth][0] != r["node"]:
                close(depth)
                stack.append((r["node"], r["part"], _Node(r["number"], r["points"])))
            node = stack[depth][2]
            node.add(r["conv_id"], r["n_convs"])
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved"]
        if out:
            yield _closed(out)
            out = []
    close(0)
    if out:
        yield _closed(out)


def _closed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.binary(), pa.int32(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in STITCHED.split(", ")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each split run, whose pieces come in order."""
    node, sha, n = None, None, 0
    for batch in batches:
        done = []
        for key, run in zip(batch.column("node").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha, n = key, hashlib.sha256(), 0
            sha.update((b"," * bool(n)) + _decimals(np.array(run, np.int64)))
            n += len(run)
        if done:
            yield pa.RecordBatch.from_pydict({"node": pa.array([k for k, _ in done], pa.binary()), "split_sha256": pa.array([s for _, s in done])})
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "split_sha256": pa.array([sha.hexdigest()])})


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition by number, parents first: the last node one level up is the parent. Only ``shown`` ones go out."""
    path: list[int] = []
    for batch in batches:
        conv, depth = batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist()
        parents = []
        for c, d in zip(conv, depth, strict=True):
            del path[d:]
            parents.append(path[-1] if d else None)
            path.append(c)
        shown = batch.column("shown")
        columns = [_ids(batch.column("conv_id")), batch.column("depth"), _ids(pa.array(parents, pa.int64())), *(batch.column(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "ends_sha256"))]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in NODES.split(", ")]).filter(shown)


def _ids(column: pa.Array) -> pa.Array:
    return ids(longs(column))


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the turn arrays, the empty one included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``arrays`` has conv_id and turns, as turn_arrays() makes them; arrays without turns are members of the root. conv_id is the
    smallest member, of which a null one is the smallest. n_leaves counts the nodes without children at or below a node, and
    saved_tokens sums there (n_convs - 1) times the code points of the node's last text. ends_sha256 is of the ids of the arrays
    that end there, in order, joined by commas, a null one as nothing. Equal rows count once each. An empty table gives an empty
    result.

    Turns are told apart by 128 bits of a hash and their texts' lengths. The ids of a run of equal arrays that goes over several
    partitions are hashed by one task as a stream, as SHA-256 is sequential; the open stacks are stitched by one task, which gets
    a path or two for each partition.
    """
    bound_batches(arrays.sparkSession)
    ordered = arrays.select("conv_id", "turns").repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    swept = cut(ordered.mapInArrow(_swept, SWEPT))
    opened = swept.filter("node is not null and number is not null")
    pieces = swept.filter("number is null").select("node", "conv_id", "part", "run")
    hashes = pieces.repartition("node").sortWithinPartitions("node", "part", "conv_id").select("node", "run").mapInArrow(_hashed, "node binary, split_sha256 string")
    stitched = cut(opened.repartition(1).sortWithinPartitions("part", "number").mapInArrow(_stitched, STITCHED))
    own_sha = opened.groupBy("node").agg(F.max("ends_sha256").alias("own_sha256"))
    whole = stitched.withColumnsRenamed({"part": "first_part", "number": "first_number"}).join(hashes, "node", "left").join(own_sha, "node")
    found = opened.select("node", "part", "number", "depth").join(whole, "node")
    resolved = found.select(
        "part", "number", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("split_sha256", "own_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        ((F.col("part") == F.col("first_part")) & (F.col("number") == F.col("first_number"))).alias("shown"),
    )
    closed = swept.filter("node is null").select("part", "number", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), F.lit(True).alias("shown"))
    return closed.unionByName(resolved).repartition("part").sortWithinPartitions("part", "number").mapInArrow(_parents, NODES)
