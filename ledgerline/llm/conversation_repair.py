"""Conversation structure repair by a dynamic programme over a trie of role and fault signatures.

A conversation becomes a signature: one sign for each row, of the role's initial and the row's fault. Distinct signatures are
range-partitioned and sorted, so signatures that share a prefix stand next to each other; a partition is streamed with the
path of the trie as its stack, and each node's layer of costs is computed once for all signatures below it. At a terminal
node the cheapest edits are read off the layers of its path. Texts take no part in that: they are shuffled once, to meet their
conversation's edits, and streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, bound_batches, cut, ids, longs, spread_join

SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"
AUDITED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
INF = 1 << 40
#: What has been put out so far: nothing, a system turn, a user turn that waits for its answer, an answered one.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after a user turn or an assistant's, where one may stand.
NEXT = {NOTHING: ASKED, SYSTEM: ASKED, ANSWERED: ASKED, ASKED: ANSWERED}


def damage(convs: DataFrame) -> DataFrame:
    """``convs`` with a fifth of its rows damaged, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the
    user's. A null counts as one space in every column but ``conv_id`` and ``turn`` of the result.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("kind != 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _rows(convs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))


def _order(*first: str) -> list:
    return [*first, F.col("turn").asc_nulls_first(), "role", "sha"]


def _signs(convs: DataFrame) -> DataFrame:
    """The rows without their texts: the sign of each, its role's class and the fault that counts."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    narrow = _rows(convs).select("conv_id", "turn", "role", "sha", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("class"), (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "sha").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), "b").when(F.col("seen"), "d").when(F.col("truncated"), "t").otherwise("-")
    judged = narrow.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault)
    sign = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("class")).otherwise(F.col("class"))
    return judged.sortWithinPartitions(*_order("conv_id"), "seen").select("conv_id", "turn", "class", "fault", sign.alias("sign"))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; a row adds one character to what is held."""
    held: list = []

    def row(conv, first, last, n_turns, faults, classes, signs):
        classes, faults = "".join(classes), "".join(faults)
        legal = sum(classes.count(x) for x in ("su", "ua", "au"))
        gaps = last - first + 1 - n_turns if n_turns else 0
        return conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), max(len(classes) - 1, 0) - legal, "".join(signs)

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = longs(batch.column("conv_id"))
        known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        turn = batch.column("turn").fill_null(0).to_numpy()
        classes, faults, signs = ("".join(batch.column(c).to_pylist()) for c in ("class", "fault", "sign"))
        cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1), len(conv)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            turns = np.unique(turn[a:b][known[a:b]])
            if held and held[0] == conv[a]:
                if len(turns):
                    held[3] += len(turns) - int(bool(held[3]) and held[2] == turns[0])
                    held[1], held[2] = held[1] if held[1] is not None else int(turns[0]), int(turns[-1])
            else:
                if held:
                    out.append(row(*held))
                held = [conv[a], int(turns[0]) if len(turns) else None, int(turns[-1]) if len(turns) else None, len(turns), [], [], []]
            held[4].append(faults[a:b])
            held[5].append(classes[a:b])
            held[6].append(signs[a:b])
        if out:
            yield _signed(out)
    if held:
        yield _signed([row(*held)])


def _signed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([ids(np.array(columns[0], np.int64)), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.string())], names=["conv_id", *COUNTS, "signature"])


# A layer holds the least cost of each state after some rows and any inserted turns, less the least of them all, and what that
# least one is. Layers are few, as states that can't be on a cheapest way any more are struck out; steps between them are kept.


def _kept(f):
    """``f`` with its results kept, in a dict that goes to Python workers with it."""
    known: dict = {}

    def look(*x):
        if x not in known:
            known[x] = f(*x)
        return known[x]

    return look


@_kept
def _edges(sign: str) -> tuple[tuple[str, int, int, int], ...]:
    """What may be done with a row: the edit, the states before and after, the cost."""
    out = [("D", s, s, DELETE) for s in NEXT]
    if sign == "d":
        return tuple(out)
    extra, role = TRUNCATED * sign.isupper(), sign.lower()
    stays = {"s": {NOTHING: SYSTEM}, "u": {s: t for s, t in NEXT.items() if t == ASKED}, "a": {ASKED: ANSWERED}, "x": {}}[role]
    out += [("K", s, t, extra) for s, t in stays.items()]
    return tuple(out + [("R", s, t, REROLE + extra) for s, t in NEXT.items()])


def _layer(costs: list[int]) -> tuple[tuple[int, ...], int]:
    for _ in range(2):
        for s, t in NEXT.items():
            costs[t] = min(costs[t], costs[s] + INSERT)
    # From an answered turn all goes on as from nothing or a system turn, but that a system turn there must be deleted.
    if costs[NOTHING] > costs[ANSWERED] + DELETE:
        costs[NOTHING] = INF
    if costs[SYSTEM] > costs[ANSWERED]:
        costs[SYSTEM] = INF
    least = min(costs)
    return tuple(INF if c >= INF else c - least for c in costs), least


FIRST = _layer([0, INF, INF, INF])[0]


@_kept
def _step(layer: tuple[int, ...], sign: str) -> tuple[tuple[int, ...], int]:
    """The next layer, and what it adds to the cost."""
    costs = [INF] * 4
    for _, s, t, cost in _edges(sign):
        costs[t] = min(costs[t], layer[s] + cost)
    return _layer(costs)


def _tight(layer: tuple[int, ...], s: int, t: int) -> bool:
    """Whether a turn inserted between the two states is on a cheapest way to the second."""
    return layer[s] + INSERT == layer[t] < INF


@_kept
def _before(layer: tuple[int, ...], sign: str, after: frozenset[int]) -> frozenset[int]:
    """The states of ``layer`` from which a cheapest way leads through the row to one of ``after``."""
    following, added = _step(layer, sign)
    found = {s for _, s, t, cost in _edges(sign) if t in after and layer[s] + cost == added + following[t]}
    return _with_inserts(layer, frozenset(found))


@_kept
def _with_inserts(layer: tuple[int, ...], found: frozenset[int]) -> frozenset[int]:
    for _ in range(2):
        found |= {s for s, t in NEXT.items() if t in found and _tight(layer, s, t)}
    return found


@_kept
def _edits(layer: tuple[int, ...], sign: str, state: int, here: frozenset[int], after: frozenset[int]) -> tuple[str, int]:
    """The least edits by letter from ``state`` through the row, and the state after them. D, I, K and R are in that order."""
    following, added = _step(layer, sign)
    edits = ""
    while True:
        ways = {e: t for e, s, t, cost in _edges(sign) if s == state and t in after and layer[s] + cost == added + following[t]}
        if "D" not in ways and NEXT[state] in here and _tight(layer, state, NEXT[state]):
            edits, state = edits + "I", NEXT[state]
            continue
        edit = min(ways)
        return edits + edit, ways[edit]


def _answer(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """What the cheapest way costs beyond the last layer's least, and its edits."""
    last = layers[-1]
    least = min(last[NOTHING], last[ANSWERED])
    ends = frozenset(s for s in (NOTHING, ANSWERED) if last[s] == least)
    reach = [_with_inserts(last, ends)]
    for k in range(len(signature) - 1, -1, -1):
        reach.append(_before(layers[k], signature[k], reach[-1]))
    reach.reverse()
    state, edits = NOTHING, []
    for k, sign in enumerate(signature):
        made, state = _edits(layers[k], sign, state, reach[k], reach[k + 1])
        edits.append(made)
    while state not in ends:
        state = NEXT[state]
        edits.append("I")
    return least, "".join(edits)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of sorted signatures: the stack is the path of the last one, a layer for each prefix."""
    before, layers, bases = "", [FIRST], [0]
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("signature").to_pylist():
            shared = _common(before, signature)
            del layers[shared + 1 :], bases[shared + 1 :]
            for sign in signature[shared:]:
                layer, added = _step(layers[-1], sign)
                layers.append(layer)
                bases.append(bases[-1] + added)
            more, audit = _answer(signature, layers)
            costs.append(bases[-1] + more)
            audits.append(audit)
            before = signature
        yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("n_convs"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "n_convs", "cost", "audit"])


def audits(convs: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Rows stand by turn, null first; rows of one turn by role and then by the SHA-256 of the text, so repeated rows are
    neighbours. A null role or text counts as one space. A row is blank if it holds white space alone, else a duplicate if the
    conversation has had its role and text before, else truncated if it doesn't end in a full stop, an exclamation or a question
    mark. ``gaps`` counts the turns that are missing between the smallest and the largest, nulls apart; ``illegal`` counts
    neighbours other than system and user, user and assistant, assistant and user. ``audit`` are the cheapest edits that give
    turns of the form (s?(ua)+)?: D deletes (2; blank rows and duplicates must go), K keeps, R makes a row the user's or the
    assistant's (1), I inserts an empty turn of theirs (5); a truncated row that stays costs 5 more. Of several cheapest edits the
    first by letters is taken. Rows with a null conv_id are one conversation; an empty table gives an empty result; other columns
    are ignored.

    Signature and audit are strings of one character a row, which is what one task holds of a conversation.
    """
    bound_batches(convs.sparkSession)
    signed = cut(_signs(convs).mapInArrow(_signatures, SIGNED))
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n_convs"))
    answers = cut(distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_trie, "signature string, n_convs long, cost long, audit string"))
    return spread_join(signed, answers, ["signature"], "n_convs").drop("signature", "n_convs")


class _Mending:
    """One conversation whose rows come by in order."""

    def __init__(self, conv: int, audit: str):
        self.conv, self.audit, self.at, self.state, self.place = conv, audit, 0, NOTHING, 0

    def _turn(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == ASKED else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._turn(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": ASKED, "a": ANSWERED}[role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._turn(), text


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Mending, dict | None, list[tuple[str, str, str]] | None, bool]]:
    """The turns of each conversation as they come, first of all its verdict, and a sign that it has ended at last."""
    one, verdict = None, None
    for batch in batches:
        verdicts = batch.column("verdict").to_pylist()
        for conv, role, text, found in zip(longs(batch.column("conv_id")).tolist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), verdicts, strict=True):
            if found is None:
                yield one, verdict, list(one.row(role, text)), False
                continue
            if one:
                yield one, verdict, list(one.inserted()), True
            one, verdict = _Mending(conv, found["audit"]), found
        yield None, None, None, False  # the batch has ended
    if one:
        yield one, verdict, list(one.inserted()), True
        yield None, None, None, False


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for one, _, turns, _ in _mend(batches):
        if one is not None:
            for edit, role, text in turns:
                rows.append((one.conv, one.place, edit, role, text))
                one.place += 1
        elif rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids(np.array(columns[0], np.int64)), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], names=["conv_id", "place", "edit", "role", "text"])
            rows = []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    sums: dict[int, hashlib._Hash] = {}
    for one, verdict, turns, ended in _mend(batches):
        if one is not None:
            digest = sums.setdefault(one.conv, hashlib.sha256())
            for _, role, text in turns:
                digest.update(("\n" * (one.place > 0) + f"{role}:{text}").encode())
                one.place += 1
            if ended:
                rows.append((one.conv, *(verdict[c] for c in (*COUNTS, "cost", "audit")), sums.pop(one.conv).hexdigest()))
        elif rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids(np.array(columns[0], np.int64)), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names=["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"])
            rows = []


def _met(convs: DataFrame) -> DataFrame:
    """The rows of each conversation behind its verdict, in order."""
    found = audits(convs)
    verdicts = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("sha"), F.struct(*COUNTS, "cost", "audit").alias("verdict"))
    rows = _rows(convs).withColumn("verdict", F.lit(None).cast(verdicts.schema["verdict"].dataType))
    both = verdicts.unionByName(rows).withColumn("later", F.col("verdict").isNull())
    return both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "later")).select("conv_id", "role", "text", "verdict")


def repair(convs: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role and text; order, faults, nulls and empty tables are as in audits().

    A conversation's rows are streamed in order, none is held. A conversation of which nothing stays has no rows.
    """
    return _met(convs).mapInArrow(_turns, REPAIRED)


def repair_digests(convs: DataFrame) -> DataFrame:
    """audits() with repaired_sha256, the lowercase hex of the SHA-256 of repair()'s ``role:text`` joined by newlines.

    SHA-256 is sequential, so a conversation's texts go through one task, as a stream.
    """
    return _met(convs).mapInArrow(_digests, f"{AUDITED}, repaired_sha256 string")
