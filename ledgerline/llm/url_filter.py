"""URL filters by a bit-parallel wildcard automaton.

Rules are globs over the canonical url, the host and path with a dot before the host. All globs are packed into one
Shift-And automaton of as many 64-bit words as it takes: a state bit stands before each pattern character, and a wildcard
keeps a bit alive on every character it allows. A batch of urls is run together, one character of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound_batches


@dataclass(frozen=True)
class Rule:
    """``host``/``path`` fits the host and its subdomains where the url's path starts with path."""

    name: str
    verdict: str

    def glob(self) -> str:
        return f"^.{self.name}*"


@dataclass(frozen=True)
class Glob:
    """``*`` is any run of characters; anchored at both ends of ".host/path"."""

    name: str
    verdict: str

    def glob(self) -> str:
        return self.name


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
#: The method's own verdicts, for urls that no rule fits: paths and hosts that hold no prose.
GLOBS = (Glob("*/login*", "block"), Glob("*/signup*", "block"), Glob("*/cart/*", "block"), Glob("*.ads.*", "block"), Glob("*.jpg", "block"), Glob("*.png", "block"), Glob("*.zip", "block"))


class Automaton:
    """Shift-And over bytes for globs; ``^`` at the start stands for any run of characters but ``/``."""

    def __init__(self, globs: list[str]):
        step, loop = [set()], [set()]  # by state: the bytes that enter it from the state before, and those that keep it
        first, last = [], []
        everything, host = set(range(256)), set(range(256)) - {ord("/")}
        for glob in globs:
            first.append(len(step))
            step.append(set())
            loop.append(set())
            for c in glob.encode():
                if c in b"*^":
                    loop[-1] |= everything if c == ord("*") else host
                else:
                    step.append({c})
                    loop.append(set())
            last.append(len(step) - 1)
        self.words = -(-len(step) // 64)
        self.step, self.loop = (self._table(x) for x in (step, loop))
        self.start, self.final = self._bits(first), [self._bits([s]) for s in last]

    def _bits(self, states) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for s in states:
            out[s >> 6] |= np.uint64(1 << (s & 63))
        return out

    def _table(self, sets) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for s, allowed in enumerate(sets):
            for c in allowed:
                out[c, s >> 6] |= np.uint64(1 << (s & 63))
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """texts by globs: whether each fits."""
        n = len(texts)
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        begin = np.append(0, np.cumsum(length[order]))[:-1]
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        live = np.tile(self.start, (n, 1))
        left = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        for at, m in enumerate(left):
            c = data[begin[:m] + at]
            now = live[:m]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            live[:m] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.zeros((n, len(self.final)), bool)
        for k, bits in enumerate(self.final):
            out[order, k] = (live & bits).any(axis=1)
        return out


def host_and_path(url):
    """Host: from after the first ``://`` to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; path: on to ``?``, ``#`` or the end."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    whole = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(whole, "/", 1)
    return ascii_lower(host), F.substring(whole, F.length(host) + 1, F.length(whole))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block) and pattern (the glob).

    The longest rule that fits gives the verdict (of equal ones, the first); else the first glob that fits, which is
    returned too; else the url is allowed. Null urls and urls without ``://`` have empty host and path and are allowed.
    Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(url)
    ranked = sorted(rules, key=lambda r: -len(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob() for r in (*ranked, *globs)])
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            fits = automaton.run([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            rule, glob, verdict = [], [], []
            for row in fits:
                k = int(row.argmax()) if row.any() else -1
                rule.append(ranked[k].name if 0 <= k < len(ranked) else None)
                glob.append(globs[k - len(ranked)].name if k >= len(ranked) else None)
                verdict.append("allow" if k < 0 else ranked[k].verdict if k < len(ranked) else globs[k - len(ranked)].verdict)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(glob, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")
