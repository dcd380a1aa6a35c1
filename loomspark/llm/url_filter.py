"""URL filters by a bit-parallel wildcard automaton.

A rule (host, path, verdict) becomes a glob over the canonical URL ``.host`` boundary ``path``: any characters, a dot,
the rule's host, the boundary, the rule's path, any characters. All globs are packed into one Shift-And mask of as
many 64-bit words as needed: bit i of the state says that the characters of a glob up to its i-th have been seen, the
shift carries between words, a ``*`` keeps its bit set on every character, and one table gives each character's mask.
URLs of similar length are simulated together, one step for each character position, in tables of at most ``CELLS``
characters; one of more than ``LONG`` characters alone. So the cost is the length of the URLs times the number of words,
whatever the number of rules in a word, and the memory does not depend on the longest URL of a batch.

The rule with the longest host and path wins; without one the verdict is ``default``. Defined cases: a very long url is judged whole; a null url or one
without ``://`` has empty host and path and takes the default; equal urls get equal rows; an empty table gives an empty
result; other columns are ignored by the query.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
BOUNDARY, ANY = 256, -1
HOST_END, PATH_END = re.compile("[/?#]"), re.compile("[?#]")
#: A table of characters by URLs has at most so many cells; longer URLs are simulated one by one.
CELLS, LONG = 1 << 20, 4096
UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host after the first ``://``, A-Z lower-cased, and the path that follows it, up to ``?`` or ``#``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = found.start() if (found := HOST_END.search(rest)) else len(rest)
    end = found.start() if (found := PATH_END.search(rest, at)) else len(rest)
    return rest[:at].translate(UPPER_TO_LOWER), rest[at:end]


class Automaton:
    """``globs``: lists of character codes 0 to 255, BOUNDARY and ANY (any run of characters, also none)."""

    def __init__(self, globs: list[list[int]]):
        plain, loops, starts, ends, at = [], [], [], [], 0
        for glob in globs:
            # One bit for the start of each glob, then one for each plain character; ANY loops on the bit before it.
            bits = [at]
            looping = set()
            for code in glob:
                if code == ANY:
                    looping.add(bits[-1])
                else:
                    bits.append(at + len(bits))
                    plain.append((bits[-1], code))
            starts.append(bits[0])
            ends.append(bits[-1])
            loops += looping
            at += len(bits)
        self.words = max(1, -(-at // 64))
        self.mask = np.zeros((257, self.words), np.uint64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for bit, code in plain:
            self.mask[code, bit // 64] |= np.uint64(1 << bit % 64)
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)
        for bit in loops:
            self.loop[bit // 64] |= np.uint64(1 << bit % 64)
        self.ends = [(bit // 64, np.uint64(bit % 64)) for bit in ends]

    def matches(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, globs) of bool: which globs match which whole texts of character codes."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = int((lengths > LONG).sum())
        for i in order[:at]:
            out[i] = self.match_long(texts[i])
        while at < len(order):
            own = order[at : at + max(1, CELLS // max(1, int(lengths[order[at]])))]
            out[own] = self.match_table([texts[i] for i in own])
            at += len(own)
        return out

    def match_long(self, text: np.ndarray) -> np.ndarray:
        """The same automaton for one text, all words of a state in one integer."""
        whole = lambda words: sum(int(w) << 64 * k for k, w in enumerate(words))
        masks, loop, state = [whole(m) for m in self.mask], whole(self.loop), whole(self.start)
        for at in range(0, len(text), LONG):
            for code in text[at : at + LONG].tolist():
                state = state << 1 & masks[code] | state & loop
        return np.array([state >> 64 * word + int(bit) & 1 for word, bit in self.ends], bool)

    def match_table(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts by descending length, one step for each position."""
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.zeros((int(lengths.max(initial=0)), len(texts)), np.int16)
        for column, t in enumerate(texts):
            codes[: lengths[column], column] = t
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        alive = np.searchsorted(-lengths, -np.arange(1, len(codes) + 1), side="right")
        for t, n in enumerate(alive):  # texts of more than t characters come first
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.mask[codes[t, :n]]) | (now & self.loop)
        return np.stack([(state[:, word] >> bit) & np.uint64(1) for word, bit in self.ends], axis=1).astype(bool) if self.ends else np.zeros((len(texts), 0), bool)


def canonical(host: str, path: str) -> np.ndarray:
    a, b = (np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16) for x in ("." + host, path))
    return np.concatenate([a, np.array([BOUNDARY], np.int16), b])


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of the column ``url``."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    globs = [[ANY, *canonical(host, path).tolist(), ANY] for host, path, _ in ordered]

    def run(urls):
        automaton = Automaton(globs)
        parts = [host_and_path(u.as_py()) for u in urls]
        hit = automaton.matches([canonical(*p) for p in parts])
        first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if globs else np.full(len(parts), -1)
        names = [None if i < 0 else ordered[i][0] + ordered[i][1] for i in first]
        return [[p[0] for p in parts], [p[1] for p in parts], names, [default if i < 0 else ordered[i][2] for i in first]]

    return common.append(pages, [url], run, "host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


#: The same rules by plain string comparison.
SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), cuts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts
), named AS (
  SELECT page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM cuts
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT n.page_id, n.host, n.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.page_id, n.host, n.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules r ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
