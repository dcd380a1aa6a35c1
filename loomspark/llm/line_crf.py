"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good (0) or bad (1), given features of itself and of its neighbours and the label of the line before.
Forward-backward gives each line's marginal; their sum, weighted by the length of the lines, is the bad text, and a
logistic function of its share and size is the document's score.

Training: labels are known for documents only. Lines first take the label of their document; after a fit, lines of bad
documents that the model finds good become good (the worst line of each stays bad), and the model is fitted again. The
logistic function is fitted on the documents' labels last. Only a bounded sample is fitted: ``SAMPLE`` labelled rows by
hash of the doc_id, one text of each, of ``SAMPLE_BYTES`` at most; rows with crc32(doc_id) mod 3 = 1 are held out.
Features come from the text alone.

Scale: scoring is one pass without a shuffle; what the driver gets is the features of the sample. A document's features
are made and used for ``PIECE`` bytes at a time; of a line, 150 bytes are held while its document is scored.

Defined cases: a null, empty or blank text has one empty line; its score is that of such a line. A very long text, or one
of very many lines, is scored whole. Rows that repeat a doc_id are scored each, and one of them is in the sample; a
doc_id with several labels counts as bad if one of them is; null labels are left out; without
labels of both kinds every score is the smoothed share of good ones. A null doc_id is not held out. Other columns pass.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, ROUNDS, STEPS, RATE, PENALTY = 4000, 3, 150, 0.08, 2e-4
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, SIGNS, MARKS = b"0123456789", b"#$%&*@^~<>{}[]\\_=+`", b".,;:'\"()-"
OWN, REPEATED = 14, 12
#: Labelled texts of more bytes are not fitted on. Bytes of text whose features are held at once, lines that are scored at
#: once, and lines from which on a document is walked by blocks.
SAMPLE_BYTES, PIECE, CELLS, LONG = 1 << 15, 1 << 18, 1 << 17, 2048


def blocks_of(data: bytes, most: int):
    """``data`` in pieces of about ``most`` bytes that end before a line break; a longer line is a piece of its own."""
    at = 0
    while (end := data.find(b"\n", at + most)) >= 0:
        yield data[at:end]
        at = end + 1
    yield data[at:]


def block_features(lines: list[bytes], seen: set[bytes]) -> np.ndarray:
    """(lines, OWN) features. ``seen`` are digests of the text's lines so far; equal lines are looked at once."""
    out, known = np.empty((len(lines), OWN), np.float32), {}
    for i, line in enumerate(lines):
        if (row := known.get(line)) is None:
            n, words = len(line), line.split()
            count = lambda kind: n - len(line.translate(None, kind))
            m, upper, lower = len(words), count(UPPER), count(LOWER)
            same = sum(map(bytes.__eq__, words[1:], words)) if m > 1 else 0
            one, size, most = 1 / max(1, n), 1 / max(1, m), max(1, m)
            row = (
                1.0, math.log1p(n) / 8, upper / max(1, upper + lower), count(DIGITS) * one, min(1.0, count(SIGNS) * size), min(1.0, line.count(b"|") * size), min(1.0, line.count(b"!") * size),
                min(1.0, count(MARKS) * size), same * size, len(set(words)) / most, min(2.0, n / most / 8), (n - upper - lower) * one, 0.0, float(n == 0),
            )
            known[line] = row
            mark = line if n <= 16 else hashlib.blake2b(line, digest_size=16).digest()
            again = mark in seen
            seen.add(mark)
        else:
            again = True
        out[i] = row
        if again and line:
            out[i, REPEATED] = 1.0
    return out


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features and the lines' weights (bytes and one for the break)."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    return block_features(lines, set()), np.array([len(x) + 1 for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's features, and those of the line before and after; zeros beyond the ends."""
    none = np.zeros((1, own.shape[1]), own.dtype)
    return np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])], axis=1)


def line_scores(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores of the text's lines (label 1 over 0) and their weights. Features live for ``PIECE`` bytes of text at a
    time: what is kept of a line are its score's three parts, for itself and as a neighbour, and its length."""
    parts, lengths, seen = [], [], set()
    each = weights.reshape(3, OWN).T
    for piece in blocks_of((text or "").encode("utf-8", "replace"), PIECE):
        lines = piece.split(b"\n")
        parts.append(block_features(lines, seen) @ each)
        lengths.append(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    own, before, after = np.concatenate(parts).T
    scores = own.copy()
    scores[1:] += before[:-1]
    scores[:-1] += after[1:]
    return scores, np.concatenate(lengths)


def long_marginals(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of label 1 for one document of very many lines, by blocks that are walked side by side.

    A line is a 2 x 2 matrix from the label before to its own; the product of a block's matrices carries a message over
    the block, so that first the blocks' products are made, then the messages at the blocks' ends, and then all blocks
    are walked from their own messages. This takes 3 sqrt(lines) steps over sqrt(lines) blocks."""
    n = len(scores)
    step = np.exp(moves - moves.max())
    wide = math.isqrt(n) + 1
    many = -(-n // wide)
    unary = np.zeros((many * wide, 2))
    unary[:n, 1] = scores
    unary -= unary.max(axis=1, keepdims=True)
    matrices = np.zeros((many * wide, 2, 2))
    matrices[:n] = step * np.exp(unary[:n])[:, None, :]
    matrices[n:] = np.eye(2)
    matrices[0] = np.exp(unary[0])[None, :]  # the first line has none before it
    matrices = matrices.reshape(many, wide, 2, 2)
    product = np.broadcast_to(np.eye(2), (many, 2, 2)).copy()
    for t in range(wide):
        product = product @ matrices[:, t]
        product /= product.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.ones((many, 2)) / 2, np.ones((many, 2)) / 2
    for k in range(1, many):
        x = ahead[k - 1] @ product[k - 1]
        ahead[k] = x / x.sum()
    for k in range(many - 2, -1, -1):
        x = product[k + 1] @ behind[k + 1]
        behind[k] = x / x.sum()
    forward = np.empty((many, wide, 2))
    for t in range(wide):
        x = (ahead[:, None, :] @ matrices[:, t])[:, 0]
        forward[:, t] = ahead = x / x.sum(axis=1, keepdims=True)
    for t in range(wide - 1, -1, -1):
        both = forward[:, t] * behind
        forward[:, t, 1] = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
        x = (matrices[:, t] @ behind[:, :, None])[:, :, 0]
        behind = x / x.sum(axis=1, keepdims=True)
    return forward[:, :, 1].reshape(-1)[:n]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for (documents, lines) ``scores`` (of label 1 over 0), and the expected moves (2, 2).

    Documents come longest first, so those that have a line t are the first ones."""
    docs, longest = scores.shape
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    unary = np.zeros((docs, longest, 2))
    unary[:, :, 1] = scores
    unary -= unary.max(axis=2, keepdims=True)
    factor, step = np.exp(unary), np.exp(moves - moves.max())
    forward, backward = np.zeros_like(factor), np.ones_like(factor)
    forward[:, 0] = factor[:, 0] / factor[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        n = alive[t]
        x = (forward[:n, t - 1] @ step) * factor[:n, t]
        forward[:n, t] = x / x.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        right = factor[:n, t + 1] * backward[:n, t + 1]
        pair = forward[:n, t, :, None] * step * right[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = right @ step.T
        backward[:n, t] = x / x.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, :, 1] / np.maximum(both.sum(axis=2), 1e-300), expected


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lengths, padded array): rows in order of descending length, zeros behind them."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    lengths = np.array([len(rows[i]) for i in order])
    out = np.zeros((len(rows), lengths[0], *rows[0].shape[1:]), np.float64)
    for place, i in enumerate(order):
        out[place, : lengths[place]] = rows[i]
    return order, lengths, out


def similar(docs: list) -> list[list[int]]:
    """The documents' numbers in groups of similar numbers of lines, so that padding stays small, and of ``CELLS`` lines
    at most, or one document."""
    by_length, groups = sorted(range(len(docs)), key=lambda i: len(docs[i][0])), []
    for i in by_length:
        n = len(docs[i][0])
        if not groups or n > max(8, 2 * len(docs[groups[-1][0]][0])) or n * (len(groups[-1]) + 1) > CELLS:
            groups.append([])
        groups[-1].append(i)
    return groups


class Model:
    """``logistic``: bias, and the weights of the three sums of the marginals that ``sums`` gives."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, logistic: np.ndarray):
        self.weights, self.moves, self.logistic = weights, moves, logistic

    def sums(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each (line scores, line weights): the share of bad text, and the bytes (as a logarithm) and the share of
        the text in lines that are rather bad than good."""
        out = np.zeros((len(docs), 3))

        def put(i, p):
            w = docs[i][1]
            sure = np.where(p >= 0.5, p, 0.0)
            out[i] = p @ w / w.sum(), math.log1p(sure @ w) / 8, sure @ w / w.sum()

        for own in similar(docs):
            if len(docs[own[0]][0]) > LONG:
                for i in own:
                    put(i, long_marginals(docs[i][0], self.moves))
                continue
            order, lengths, scores = padded([docs[i][0] for i in own])
            bad, _ = forward_backward(scores, lengths, self.moves)
            for place, i in enumerate(order):
                put(own[i], bad[place, : lengths[place]])
        return out

    def of_sums(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + x @ self.logistic[1:], -50, 50)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Texts are scored ``CELLS`` lines at a time."""
        out, waiting, lines = [np.zeros(0)], [], 0
        for t in texts:
            waiting.append(line_scores(t, self.weights))
            lines += len(waiting[-1][0])
            if lines >= CELLS:
                out.append(self.of_sums(self.sums(waiting)))
                waiting, lines = [], 0
        if waiting:
            out.append(self.of_sums(self.sums(waiting)))
        return np.concatenate(out)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and weights of a ridge logistic regression, by damped Newton steps."""
    design, found = np.concatenate([np.ones((len(x), 1)), x], axis=1), np.zeros(x.shape[1] + 1)
    keep = ridge * np.array([1e-3, *[1.0] * x.shape[1]])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(design @ found, -50, 50)))
        move = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + np.diag(keep) + 1e-9 * np.eye(len(found)), design.T @ (q - y) + keep * found)
        found -= np.clip(move, -4, 4)
    return found


def fit(docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> Model:
    """A model for documents (features, line weights) and their labels (1 good, 0 bad)."""
    prior = (good.sum() + 1) / (len(good) + 2)
    model = Model(np.zeros(3 * OWN), np.zeros((2, 2)), np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0]))
    if len(set(good.tolist())) < 2:
        return model
    weights, moves = model.weights.copy(), np.array([[1.0, -1.0], [-1.0, 1.0]])
    parts, total = [], sum(len(f) for f, _ in docs)
    half = [0.5 * len(good) / max(1, (good == k).sum()) for k in (0, 1)]  # both kinds of documents weigh the same
    for own in similar(docs):
        order, lengths, x = padded([with_neighbours(docs[i][0]) for i in own])
        inside, truth = np.arange(x.shape[1])[None] < lengths[:, None], good[own][order]
        parts.append([x, lengths, inside, truth, np.where(truth == 1, half[1], half[0]), inside & (truth == 0)[:, None]])
    for _ in range(ROUNDS):
        seen = np.array([[sum(((bad[:, :-1] == a) & (bad[:, 1:] == b) & inside[:, 1:]).sum() for _, _, inside, _, _, bad in parts) for b in (0, 1)] for a in (0, 1)], float)
        m1, v1, m2, v2 = np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))
        for step in range(1, STEPS + 1):
            g1, g2 = PENALTY * weights, PENALTY * moves - seen / total
            for x, lengths, inside, _, weigh, bad in parts:
                p, expected = forward_backward(x @ weights, lengths, moves)
                g1 = g1 + np.tensordot(np.where(inside, p - bad, 0.0) * weigh[:, None], x, axes=([0, 1], [0, 1])) / total
                g2 = g2 + expected / total
            for value, g, m, v in ((weights, g1, m1, v1), (moves, g2, m2, v2)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        for part in parts:
            x, lengths, inside, truth, _, _ = part
            p = np.where(inside, forward_backward(x @ weights, lengths, moves)[0], -1.0)
            part[5] = inside & (truth == 0)[:, None] & ((p >= 0.5) | (p == p.max(axis=1, keepdims=True)))
    model.weights, model.moves = weights, moves
    model.logistic = logistic(model.sums([(with_neighbours(f).astype(np.float64) @ weights, w) for f, w in docs]), good)
    return model


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of the sample that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    known = known.where(remainder() != 1).select(F.col("doc_id").alias("_doc"), F.col("_good").cast("int").alias("_good"))
    chosen = known.orderBy(F.xxhash64("_doc"), "_doc").limit(SAMPLE)
    fits = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    texts = fits.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc")).groupBy("doc_id", "_good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(column):
        found = [line_features(x.as_py()) for x in column]
        return [pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())]

    rows = common.append(texts, ["text"], run, "_features binary, _weights binary").select("doc_id", "_good", "_features", "_weights").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["_features"])))
    return fit([(np.frombuffer(r["_features"], np.float32).reshape(-1, OWN), np.frombuffer(r["_weights"], np.float64)) for r in rows], np.array([r["_good"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the score of each text and the label predicted."""

    def run(texts):
        scores = model.scores([x.as_py() for x in texts])
        return [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]

    return common.append(docs, ["text"], run, "score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that a model of ``labels`` predicts to be bad."""
    model = train(docs, labels)

    def run(texts):
        return [pa.array(model.scores([x.as_py() for x in texts]) >= 0.5, pa.bool_())]

    return common.unpacked(common.append(common.packed(docs, "text"), ["text"], run, "_good boolean").where("_good"), docs)


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
