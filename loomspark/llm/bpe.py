"""BPE encoding and decoding with a public byte-level vocabulary.

Encoding keeps the symbols of a pre-token in a doubly linked list and the possible merges in a priority queue by
rank; an entry whose symbols have changed meanwhile is stale and skipped. A merge costs one queue operation for each
new neighbour, so a pre-token of n bytes takes O(n log n). Decoding concatenates the vocabulary's byte strings.

Pre-tokens repeat, so each Python worker keeps the results of the last ones in a table of bounded size. The
vocabulary (a few MB, fixed) is read on the driver from the given path and broadcast.

Defined cases: a null text is encoded as the empty text (0 tokens, the digest of nothing); the special tokens of the
file are found in the text as such; a very long text is encoded whole; an empty table gives an empty result; rows are
independent, so order, ties, repeats and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import gc
import json
import re
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same with the faster standard library, for texts without the characters that its classes take otherwise.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: The ASCII characters among them.
CONTROLS = frozenset("\x1c\x1d\x1e\x1f")


@cache
def otherwise() -> frozenset[str]:
    """The characters that the classes of the two libraries tell apart, such as numbers that are not decimal digits and
    letters that only one of them knows; found by asking both, once in a worker that meets texts beyond ASCII."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out: set[str] = set()
    for one, other in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        out |= set(regex.findall(one, every)) ^ set(re.findall(other, every))
    return frozenset(out)


#: Entries of the two tables of pre-tokens, and the longest pre-token that enters them.
KEPT, WAITING, LONGEST = 200_000, 200_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable bytes stand for themselves,
    the others take the letters from U+0100 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def split(text: str) -> list[str]:
    plain = not any(c in text for c in CONTROLS) if text.isascii() else otherwise().isdisjoint(set(text))
    return (PLAIN if plain else PATTERN).findall(text)


class Remembered(dict):
    """pre-token -> (ids, ids as text). What is seen once waits in ``young``; what is seen there again is kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.young = encode, {}

    def __missing__(self, word: str):
        if (found := self.young.get(word)) is not None:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
            return found
        ids = self.encode(word.encode("utf-8", "surrogatepass"))
        found = ids, ",".join(map(str, ids))
        if len(word) <= LONGEST:
            if len(self.young) >= WAITING:
                self.young.clear()
            self.young[word] = found
        return found


class Vocabulary:
    def __init__(self, text: str):
        spec, letters = json.loads(text), byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [i for _, i in sorted((b, vocab[c]) for c, b in letters.items())]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: x.encode() for x, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words = Remembered(self.encode_word)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        ids = list(map(self.byte_ids.__getitem__, word))
        n, rank_of, merged = len(ids), self.ranks.get, self.merged
        width = n.bit_length()
        low = (1 << width) - 1
        rank_at = list(map(rank_of, zip(ids, ids[1:], strict=False)))  # of the pair that starts at each symbol
        queue = [r << width | i for i, r in enumerate(rank_at) if r is not None]
        if not queue:
            return tuple(ids)
        heapify(queue)
        rank_at.append(None)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> width, entry & low
            if rank_at[i] != rank:
                continue  # stale
            j = following[i]
            ids[i] = new = merged[rank]
            ids[j], rank_at[j], rank_at[i] = -1, None, None
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                rank_at[i] = r = rank_of((new, ids[k]))
                if r is not None:
                    heappush(queue, r << width | i)
            if (h := before[i]) >= 0:
                rank_at[h] = r = rank_of((ids[h], new))
                if r is not None:
                    heappush(queue, r << width | h)
        return tuple([x for x in ids if x >= 0])

    def pieces(self, text: str) -> list[tuple]:
        """(ids, ids as text) of each pre-token and special token of the text."""
        words, special = self.words, self.special
        if self.split_special is None or not any(s in text for s in special):
            return [words[w] for w in split(text)]
        out = []
        for part in self.split_special(text):
            if part in special:
                out.append(((special[part],), str(special[part])))
            else:
                out += [words[w] for w in split(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x[0] for x in self.pieces(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The worker's own, built once for each broadcast; the last one only, as it takes some 50 MB."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(shared.value)
    return _LOADED[key]


def _forget() -> None:
    for vocabulary in _LOADED.values():
        vocabulary.words = Remembered(vocabulary.encode_word)
    gc.enable()


def _working(shared) -> Vocabulary:
    """The vocabulary for one batch. The collector of cycles rests until the end of the task (``_forget``): nothing here
    makes cycles, and it would walk through the tables again and again."""
    gc.disable()
    return _vocabulary(shared)


def shared_vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of the column ``text``."""
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(texts):
        vocabulary = _working(shared)
        return [pa.array([vocabulary.encode(x.as_py() or "") for x in texts], pa.list_(pa.int32()))]

    return common.append(docs, [text], run, f"`{ids}` array<int>", _forget)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the column ``ids``."""
    shared = shared_vocabulary(encoded.sparkSession, path)

    def run(lists):
        vocabulary = _working(shared)
        return [pa.array([vocabulary.decode(x.as_py() or ()) for x in lists], pa.string())]

    return common.append(encoded, [ids], run, f"`{text}` string", _forget)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens, token_ids, and whether these decode to the text, in one pass over it."""
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(texts):
        lists, same = [], []
        vocabulary = _working(shared)
        for x in texts:
            text = x.as_py() or ""
            ids = vocabulary.encode(text)
            same.append(vocabulary.decode(ids) == text)
            lists.append(pa.array(ids, pa.int32()))
        sizes = [len(x) for x in lists]
        offsets = pa.array([0, *accumulate(sizes)], pa.int32())
        return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())), same]

    return common.append(docs, ["text"], run, "n_tokens long, token_ids array<int>, round_trip boolean", _forget)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens and the digests of the ids and of the text that is decoded from them."""
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(texts):
        numbers, of_ids, of_text = [], [], []
        vocabulary = _working(shared)
        for x in texts:
            pieces = vocabulary.pieces(x.as_py() or "")
            ids = list(chain.from_iterable([p[0] for p in pieces]))
            numbers.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
            of_text.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
        return [numbers, of_ids, of_text]

    return common.append(docs, ["text"], run, "n_tokens long, ids_sha256 string, decoded_sha256 string", _forget)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()).drop("text")
