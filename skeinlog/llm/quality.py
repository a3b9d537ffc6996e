"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are shape measures of the line and of its two neighbours; two weights per pair of labels link
adjacent lines. The forward-backward pass gives each line's marginal; their mean, weighted by line length, is the document's
quality. Training treats the label of a document as the label of its lines.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

# kinds of characters: the counts of each within a line are its shape
OTHER, LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, SHOUT, BREAK = range(9)
KINDS = 9
SHAPE = 13
FEATURES = 3 * SHAPE + 1
TRAIN_DOCUMENTS = 6000
TRAIN_LINES = 400
STEPS = 250


def char_kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isupper():
            kinds[c] = UPPER
        elif s.isalpha():
            kinds[c] = LOWER
        elif s.isdigit():
            kinds[c] = DIGIT
        elif s.isspace():
            kinds[c] = SPACE
    for s, kind in ((".,;:'\"()-", STOP), ("#$%&*|@<>{}[]\\^_~=+/", SYMBOL), ("!?", SHOUT), ("\n", BREAK)):
        kinds[[ord(x) for x in s]] = kind
    return kinds


def line_features(text: str, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, line lengths); an empty text is one empty line."""
    k = kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    breaks = k == BREAK
    lines = np.cumsum(breaks) - breaks
    n = int(breaks.sum()) + 1
    counts = np.bincount(lines * KINDS + k, minlength=n * KINDS).reshape(n, KINDS).astype(np.float32)
    counts[:, BREAK] = 0
    length = counts.sum(1)
    size = np.maximum(length, 1)
    words = counts[:, SPACE] + (length > 0)
    split = [x.split() for x in text.split("\n")]
    distinct = np.array([len(set(x)) for x in split], np.float32)
    repeated = np.array([sum(map(eq, x, x[1:])) for x in split], np.float32)
    shape = np.empty((n, SHAPE), np.float32)
    shape[:, :8] = counts[:, :8] / size[:, None]
    shape[:, 8] = np.log1p(length) / 8
    shape[:, 9] = np.minimum(length / np.maximum(words, 1), 40) / 20
    shape[:, 10] = distinct / np.maximum(words, 1)
    shape[:, 11] = (counts[:, SYMBOL] + counts[:, SHOUT]) / np.maximum(words, 1)
    shape[:, 12] = repeated / np.maximum(words, 1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :SHAPE] = shape
    out[1:, SHAPE : 2 * SHAPE] = shape[:-1]
    out[:-1, 2 * SHAPE : 3 * SHAPE] = shape[1:]
    out[:, -1] = 1
    return out, length


def forward_backward(emit: np.ndarray, pair: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (docs x lines x 2) and summed pair marginals (2 x 2) of padded chains; ``mask`` marks real lines."""
    docs, lines, _ = emit.shape
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    alpha[:, 0] = emit[:, 0]
    for t in range(1, lines):
        step = log_sum(alpha[:, t - 1, :, None] + pair, 1) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(lines - 2, -1, -1):
        step = log_sum(pair + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
    total = log_sum(alpha[:, -1], 1)
    marginals = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    pairs = np.zeros((2, 2))
    for t in range(1, lines):
        p = np.exp(alpha[:, t - 1, :, None] + pair + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
        pairs += (p * mask[:, t, None, None]).sum(0)
    return marginals, pairs


def fit(chains: list[np.ndarray], labels: list[int], steps: int = STEPS, rate: float = 0.05, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights FEATURES x 2, pair 2 x 2) by gradient ascent on the likelihood, documents of each class weighing alike in shape."""
    weights, pair = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    order = np.argsort([len(c) for c in chains], kind="stable")
    batches = []
    for a in range(0, len(order), 256):
        own = order[a : a + 256]
        longest = max(len(chains[i]) for i in own)
        x, mask = np.zeros((len(own), longest, FEATURES), np.float32), np.zeros((len(own), longest), bool)
        for row, i in enumerate(own):
            x[row, : len(chains[i])], mask[row, : len(chains[i])] = chains[i], True
        y = np.array([labels[i] for i in own])
        gold = mask[:, :, None] * np.eye(2)[y][:, None, :]
        moves = np.zeros((2, 2))
        for label in (0, 1):
            moves[label, label] = (mask.sum(1) - 1)[y == label].sum()
        batches.append((x, mask, gold, moves))
    n = sum(len(c) for c in chains) or 1
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        grad_w, grad_p = -shrink * n * weights, -shrink * n * pair
        for x, mask, gold, moves in batches:
            marginals, pairs = forward_backward(x @ weights, pair, mask)
            grad_w = grad_w + np.einsum("dlf,dlk->fk", x, gold - marginals, optimize=True)
            grad_p = grad_p + moves - pairs
        for at, (value, grad) in enumerate(((weights, grad_w / n), (pair, grad_p / n))):
            m, v = state[2 * at], state[2 * at + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, pair


def document_score(text: str, kinds: np.ndarray, weights: np.ndarray, pair: np.ndarray) -> tuple[float, int]:
    """(length-weighted mean marginal of "good", number of lines); an empty text has its one empty line's marginal."""
    x, length = line_features(text, kinds)
    emit = x @ weights
    marginals, _ = forward_backward(emit[None], pair, np.ones((1, len(x)), bool)) if len(x) <= 64 else (_long_chain(emit, pair)[None], None)
    good = marginals[0, :, 1]
    share = length if length.sum() else np.ones(len(length))
    return float(min(1.0, max(0.0, (good * share).sum() / share.sum()))), len(x)


def _long_chain(emit: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marginals of one chain, with scaled probabilities in plain numbers; quick for thousands of lines."""
    e = np.exp(emit - emit.max(1, keepdims=True)).tolist()
    (a, b), (c, d) = np.exp(pair - pair.max()).tolist()
    forward, x, y = [], *e[0]
    s = x + y
    x, y = x / s, y / s
    forward.append((x, y))
    for g, h in e[1:]:
        x, y = (x * a + y * c) * g, (x * b + y * d) * h
        s = x + y
        x, y = x / s, y / s
        forward.append((x, y))
    out = np.empty((len(e), 2))
    u = v = 1.0
    for t in range(len(e) - 1, -1, -1):
        x, y = forward[t]
        p, q = x * u, y * v
        out[t] = p / (p + q), q / (p + q)
        g, h = e[t][0] * u, e[t][1] * v
        u, v = a * g + b * h, c * g + d * h
        s = u + v
        u, v = u / s, v / s
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = TRAIN_DOCUMENTS, max_lines: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample: the labels of ``max_documents`` ids, chosen by a hash of the id, and their texts of up to ``max_lines`` lines.

    Rows with a null id or label are ignored, null texts are empty. With no row the model is neutral: it scores 0.5. The sampled labels
    go to the texts, so that no text is shuffled.
    """
    lines = F.size(F.split(F.coalesce(text_col, F.lit("")), "\n"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_documents)
    rows = docs.where(lines <= max_lines).select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(chosen), "_id")

    def start():
        kinds = char_kinds()

        def features(batch: pa.RecordBatch) -> dict:
            return {"label": batch.column("label"), "x": [line_features(t, kinds)[0].astype("<f4").tobytes() for t in texts_of(batch, "text")]}

        return features

    found = sorted(map_batches(sample.select("text", "label"), "label int, x binary", start).collect(), key=lambda r: (bytes(r.x), r.label))
    return fit([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in found], [int(r.label > 0) for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_lines) for every row; score is the chance of label 1.

    Null texts are empty, one empty line. Equal texts get equal scores; rows with equal or null ids stay separate rows; other columns
    are not read. An empty table gives an empty result.
    """
    weights, pair = model

    def start():
        kinds = char_kinds()

        def scored(batch: pa.RecordBatch) -> dict:
            found = [document_score(t, kinds, weights, pair) for t in texts_of(batch, text_col)]
            return {"_id": batch.column(id_col), "score": [s for s, _ in found], "predicted": [int(s >= 0.5) for s, _ in found], "n_lines": [n for _, n in found]}

        return scored

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"_id {kind}, score double, predicted int, n_lines long", start).withColumnRenamed("_id", id_col)
