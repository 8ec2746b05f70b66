"""Conversations repaired and put into a trie, against brute force: every edit tried, every prefix listed."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import conversation_repair as repair
from ledgerline.llm import conversation_trie as trie

CONVS = "conv_id long, turn long, role string, text string, signature string, node string, part int"
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant"]
STATES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def conversations(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No!", "So?  \n", "open", "é…", f"{rng.random()}.", f"{rng.random()}"])
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(ROLES), text()) for c in [None, -7, *range(60), *range(200, 240)] for _ in range(rng.randint(1, 5))]
    rows += [(300 + k, t, ("user", "assistant")[t % 2], f"Copy {t}.") for k in range(150) for t in range(4)]
    return rows + rows[:20]


def by_conv(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return lambda null: {c: sorted(((t, null if r is None else r, null if x is None else x) for t, r, x in v), key=order) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, audit, turns) of all edits, with up to two turns inserted at each place."""
    marks, best = faults(rows), None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            state, cost, audit, turns = 0, 0, "", []

            def put(role, text):
                nonlocal state
                state = STATES.get((state, role[:1]))
                turns.append(f"{role}:{text}")

            for k in range(len(rows) + 1):
                for _ in range(inserts[k]):
                    cost, audit = cost + 5, audit + "I"
                    put("assistant" if state == 2 else "user", "")
                if k == len(rows) or state is None:
                    break
                audit += edits[k]
                if edits[k] == "D":
                    cost += 2
                    continue
                if marks[k] in ("blank", "duplicate"):
                    state = None
                    break
                cost += 5 * (marks[k] == "truncated") + (edits[k] == "R")
                put(rows[k][1] if edits[k] == "K" else "assistant" if state == 2 else "user", rows[k][2])
            if state in (0, 3) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def test_repair_takes_the_cheapest_edits_of_all(spark):
    rng = random.Random(3)
    rows = [r for r in conversations(1) if r[0] is None or r[0] < 300]
    rows += [(900, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(3000)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONVS).repartition(3)
    found = {r.conv_id: r for r in repair.repair_digests(docs).collect()}
    turns = defaultdict(list)
    for r in repair.repair(docs).collect():
        turns[r.conv_id].append((r.place, r.edit, r.role, r.text))
    assert len(found) == len({r[0] for r in rows})
    for conv, own in by_conv(rows)(" ").items():
        got, marks = found[conv], Counter(faults(own))
        numbers = [t for t, _, _ in own if t is not None]
        pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        assert (got.blank, got.duplicate, got.truncated, got.illegal) == (marks["blank"], marks["duplicate"], marks["truncated"], pairs)
        assert got.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        mine = sorted(turns[conv])
        assert [p for p, *_ in mine] == list(range(len(mine))) and "".join(e for _, e, *_ in mine) == got.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in mine).encode()).hexdigest() == got.repaired_sha256
        if len(own) <= 4:
            cost, audit, out = cheapest(own)
            assert (got.cost, got.audit) == (cost, audit), own
            assert out == [f"{r}:{t}" for _, _, r, t in mine]
    assert len(found[900].audit) >= 3000 and re.fullmatch("(ua)*", "".join(r[0] for _, _, r, _ in sorted(turns[900])))


def test_damage_follows_the_checksum_of_each_row(spark):
    rows = conversations(2)
    damaged = repair.damage(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONVS)).collect()
    want = Counter()
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[conv, turn, "user" if kind == 4 else role, text] += {0: 0, 3: 2}.get(kind, 1)
    assert Counter(map(tuple, damaged)) == +want


def nodes(arrays):
    """Each prefix of each array by brute force."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    low = lambda c: (c is not None, c or 0)
    for conv, turns in arrays:
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        for d in range(len(turns)):
            children[turns[:d]].add(turns[: d + 1])
        ends[turns].append(conv)
    saved = {p: (len(c) - 1) * len(p[-1][1]) if p else 0 for p, c in members.items()}
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        text = ",".join("" if c is None else str(c) for c in sorted(ends[p], key=low))
        parent = min(members[p[:-1]], key=low) if p else None
        out.append((min(convs, key=low), len(p), parent, len(convs), len(children[p]), sum(not children[q] for q in below), sum(saved[q] for q in below), hashlib.sha256(text.encode()).hexdigest()))
    return out


def grafted(rows):
    own = {c: tuple((r, x) for _, r, x in v) for c, v in by_conv(rows)("").items()}
    out = []
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else c - (c % 100 if c >= 0 else -(-c % 100))
        out.append((c, own.get(base, ())[:h] + turns[h:]))
    return out


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_trie_has_each_prefix_whatever_the_partitions(spark, partitions):
    rows = conversations(4)
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONVS)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = trie.prefix_trie(trie.grafted(trie.turn_arrays(docs))).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert Counter(map(tuple, found)) == Counter(nodes(grafted(rows)))


def test_trie_of_equal_and_of_long_arrays(spark):
    rows = [(c, t, "user", "x" * (t % 7)) for c in (5, 3, 9) for t in range(400)] + [(c, 0, "user", "same") for c in range(100, 400)]
    found = trie.prefix_trie(trie.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    own = [(c, tuple((r, x) for _, r, x in v)) for c, v in by_conv(rows)("").items()]
    assert len(found) == 402 and Counter(map(tuple, found)) == Counter(nodes(own))


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONVS)
    assert repair.repair(none).count() == repair.repair_digests(none).count() == repair.damage(none).count() == 0
    assert trie.prefix_trie(trie.grafted(trie.turn_arrays(none))).count() == 0
