"""Secret scans: three base patterns, and zstandard novelty primed with an identifier dictionary.

A candidate of the novelty measure is a string of at least ``LEAST`` letters, digits and ``+/_=-`` that mixes letters and
digits and starts at most ``WINDOW`` characters behind a sensitive word or a span already reported, also on the lines
below; every such string in the window is measured. Its marginal cost is the compressed size of its surrounding text with
it less the size without it, both with a zstandard dictionary of common code identifiers; other copies of the candidate
are taken out of the surrounding text first, so a secret that repeats costs what a single one does. A candidate that
costs at least ``NOVEL`` bytes for each of its own is incompressible there, and is reported with kind ``novel`` unless it
overlaps a base span, which always stays.

Limits, by choice: strings of letters only or digits only are never candidates, as zstandard stores a short unknown word
as it stores a key, and every long word would be one; shorter strings and those far from a sensitive word neither.

Defined cases: a very long text is scanned whole; a null text counts as empty (no spans, the digest of nothing); offsets are code points, ends are
exclusive; rows are independent, so ties, repeats, order and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect

import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

#: The base kinds in their order, each with its pattern and what it needs in length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so this drops just the shorter ones
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|credential|bearer|private[ _]?key|signature|auth", re.IGNORECASE | re.ASCII)
LEAST, WINDOW, CONTEXT, NOVEL = 16, 64, 160, 0.62
STRING = re.compile(rf"\b[A-Za-z0-9+/_=-]{{{LEAST},}}", re.ASCII)
#: A piece of a copy of so many characters counts as one.
COPY = 4
#: Identifiers and code that a candidate is expected to look like.
DICTIONARY = (
    "import from return def class function const let var public private static final void string int bool null none true false "
    "self this new for while if else try except catch finally with async await yield lambda export default require module "
    "password passwd secret token api_key apikey access_key secret_key client_id client_secret credential authorization bearer "
    "config settings environment os.environ getenv process.env username user email host port database connection url http https "
    "request response headers content-type application/json session cookie value key name id uuid version index length size "
    "logger.info print console.log System.out.println assert test example placeholder changeme your_token_here xxxxxxxxxxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 1234567890 00000000 11111111 "
)


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """``CONTEXT`` characters at most before and after a candidate, without its other copies, whole or cut by the limit."""
    candidate, most = text[start:end], CONTEXT + end - start
    before = text[max(0, start - most) : start].replace(candidate, "")[-CONTEXT:]
    after = text[end : end + most].replace(candidate, "")[:CONTEXT]
    part = next((n for n in range(min(len(candidate) - 1, len(before)), COPY - 1, -1) if before.startswith(candidate[-n:])), 0)
    before = before[part:]
    part = next((n for n in range(min(len(candidate) - 1, len(after)), COPY - 1, -1) if after.endswith(candidate[:n])), 0)
    return before, after[: len(after) - part]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted; the digits and capitals that a kind needs are looked for first."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Novelty:
    def __init__(self, dictionary: str = DICTIONARY, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def marginal(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds to its surroundings, for each of its characters."""
        without, full = (before + " " + after).encode("utf-8", "replace"), (before + candidate + after).encode("utf-8", "replace")
        return (len(self.compress(full)) - len(self.compress(without))) / len(candidate)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, free, known = [], 0, united(base)  # no string starts again before ``free``
        for word in SENSITIVE.finditer(text):
            at, limit = max(free, word.end()), word.end() + WINDOW
            while at <= limit and (m := STRING.search(text, at, limit + LEAST)):
                start, end = STRING.match(text, m.start()).span()  # whole, beyond the window too
                at = free = end
                candidate = text[start:end]
                place = bisect(known, (end,)) - 1
                if place >= 0 and known[place][1] > start:
                    limit = max(limit, end + WINDOW)
                elif not candidate.isalpha() and not candidate.isdigit() and self.marginal(*beside(text, start, end)) >= NOVEL:
                    out.append((start, 3, end))
                    limit = max(limit, end + WINDOW)
        return out


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, end) that cover the sorted ``spans`` and do not overlap."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def beside(text: str, start: int, end: int) -> tuple[str, str, str]:
    before, after = surroundings(text, start, end)
    return before, text[start:end], after


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with the numbers of spans by base kind, the digest of the base spans, and all spans."""

    def run(texts):
        novelty = Novelty()
        counts: list[list[int]] = [[], [], []]
        shas, lists = [], []
        for x in texts:
            text = x.as_py() or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            lists.append(written(sorted(base + novelty.spans(text, base))))
        return [*counts, shas, lists]

    return common.append(docs, ["text"], run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; texts without one stay as they are."""

    def run(texts):
        novelty, out = Novelty(), []
        for x in texts:
            text = x.as_py()
            if text:
                base = base_spans(text)
                parts, at = [], 0
                for start, _, end in sorted(base + novelty.spans(text, base)):
                    if end > at:
                        if start >= at:
                            parts += [text[at:start], mark]
                        at = end
                if parts:
                    text = "".join([*parts, text[at:]])
            out.append(text)
        return [out]

    return common.unpacked(common.append(common.packed(docs, "text"), ["text"], run, "_clean string"), docs, "_clean")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
