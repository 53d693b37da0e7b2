"""Quality of documents from a linear-chain conditional random field over their lines.

Every line gets a label, good or bad.  A line's evidence is a sum of weights
over binned features of the line itself, of the line before and of the line
after it (symbols, capitals, bars, digits, word lengths, repeated words, lines
met before); learnt transition weights tie neighbouring labels.  Forward-backward
gives the marginal probability that each line is good; their mean, weighted by
line length, is the document's quality, brought to the scale of the labels by
a logistic curve.

Lines have no labels of their own, so training takes each line of a labelled
document to be what the document is, on at most ``sample`` documents of each
label (the bound of the sample).  Both the weights and the transitions follow
the gradient of the likelihood, in which each document counts the same; as all
lines of a training document have one label, the transitions would grow without
end, so they are drawn towards zero.  Every whole text is then scored, all
lines of it.

Defined results: null text, and text without a line that has a word, has
quality 0 before the logistic curve; a null doc_id counts as held out; repeated
rows are scored each, and of rows that share a sampled doc_id one is learnt
from; without labels that may be learnt from all scores are
0.5; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample_ids, sampled_texts
from .textcols import SPACE_BYTES, byte_table, column_chunks, hash_spans, spans

BINS = 8
_SEP, _VALUES = byte_table(SPACE_BYTES, seed=6)
_CLASSES = {"symbols": b"#*$%&|<>", "bars": b"|", "shouts": b"!", "digits": b"0123456789", "stops": b".,;:", "capitals": bytes(range(65, 91))}


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, line lengths, row pointer) of the lines that have a word."""
    starts, ends, rows = spans(data != 10, offsets)
    if not len(starts):
        return np.zeros((0, len(_CLASSES) + 7)), np.zeros(0), np.zeros(len(offsets), np.int64)
    word_start, word_end, word_ptr = spans(~_SEP[data], np.append(starts, len(data)))
    # runs are cut at lines' starts and line feeds, so every word is in one line
    n_words = np.diff(word_ptr)
    kept = n_words > 0
    rows = np.append(0, np.cumsum(kept))[rows]
    line_of = np.repeat(np.arange(len(starts)), n_words)

    def per_line(hit: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(hit))
        return (total[ends] - total[starts])[kept]

    length = (ends - starts)[kept].astype(float)
    words = n_words[kept].astype(float)
    spaces = per_line(_SEP[data])
    inner = np.maximum(1.0, length - spaces)
    features = []
    for members in _CLASSES.values():
        mask = np.zeros(256, bool)
        mask[list(members)] = True
        features.append(per_line(mask[data]) / inner)
    latin = np.zeros(len(data), bool)  # capitals of the Latin-1 letters
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    features[-1] = features[-1] + per_line(latin) / inner
    features.append(np.log1p(words))
    features.append(inner / words)
    size = word_end - word_start
    features.append(np.bincount(line_of, size <= 3, len(starts))[kept] / words)
    keys = hash_spans(data, word_start, word_end, _VALUES)
    order = np.lexsort((keys, line_of))
    again = np.append(False, (keys[order][1:] == keys[order][:-1]) & (line_of[order][1:] == line_of[order][:-1]))
    features.append(np.bincount(line_of[order], again, len(starts))[kept] / words)
    follows = np.append(False, (keys[1:] == keys[:-1]) & (line_of[1:] == line_of[:-1]))
    features.append(np.bincount(line_of, follows, len(starts))[kept] / words)
    whole = hash_spans(data, starts[kept], ends[kept], np.where(np.arange(256) == 10, np.uint64(0), _VALUES + np.uint64(2)))
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((whole, row_of))
    seen = np.zeros(len(whole))
    seen[order] = np.append(False, (whole[order][1:] == whole[order][:-1]) & (row_of[order][1:] == row_of[order][:-1]))
    features.append(seen)
    capital_first = np.zeros(len(data), bool)
    capital_first[word_start] = (data[word_start] >= 65) & (data[word_start] <= 90)
    features.append(per_line(capital_first) / words)
    return np.stack(features, 1), inner, rows


def binned(features: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Columns of the weights that each line has: own, previous and next line's bins; the last column of a kind: no such line."""
    n, k = features.shape
    own = np.zeros((n, k), np.int32)
    for j in range(k):
        own[:, j] = np.searchsorted(edges[j], features[:, j], "right") + j * (BINS + 1)
    none = np.arange(k, dtype=np.int32) * (BINS + 1) + BINS
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    if n:
        full = rows[:-1] < rows[1:]
        before[rows[:-1][full]] = none
        after[rows[1:][full] - 1] = none
    step = k * (BINS + 1)
    return np.concatenate([own, before + step, after + 2 * step], 1)


#: Documents of more lines are run through by products of transitions in doubling spans instead of line by line.
LONG_CHAIN = 256


def _scan(m: np.ndarray) -> np.ndarray:
    """Running products m[0] .. m[t] of 2 x 2 matrices, each brought to the sum 1."""
    out, step = m.copy(), 1
    while step < len(out):
        a, b = out[:-step], out[step:]
        out[step:] = a[:, :, :1] * b[:, :1, :] + a[:, :, 1:] * b[:, 1:, :]
        out /= out.sum((1, 2), keepdims=True)
        step *= 2
    return out


def _long_chain(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta) of one chain, each line's to the sum 1."""
    steps = move[None, :, :] * emit[1:, None, :]
    alpha = np.concatenate([emit[:1], (emit[0][None, :, None] * _scan(steps)).sum(1)])
    # the transposed steps from the end
    beta = np.concatenate([_scan(np.ascontiguousarray(steps[::-1].transpose(0, 2, 1))).sum(1)[::-1], np.ones((1, 2))])
    return alpha / alpha.sum(1, keepdims=True), beta / beta.sum(1, keepdims=True)


def marginals(scores: np.ndarray, tie: np.ndarray, rows: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, expected transitions) by forward-backward over all rows at once.

    scores: evidence for good; tie: 2 x 2 log-weights of (label, next label), bad
    first; share: what a transition of each row counts, 1 if not given.
    """
    share = np.ones(len(rows) - 1) if share is None else share
    n = len(scores)
    up = np.exp(np.clip(scores, -30, 30))
    emit = np.stack([1 / (1 + up), up / (1 + up)], 1)
    move = np.exp(tie - tie.max())
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    sizes = np.diff(rows)
    long = sizes > LONG_CHAIN
    for a, b in zip(rows[:-1][long].tolist(), rows[1:][long].tolist(), strict=True):
        alpha[a:b], beta[a:b] = _long_chain(emit[a:b], move)
    # the others together, the t-th lines of all at once
    order = np.argsort(-sizes[~long], kind="stable")
    first, short = rows[:-1][~long][order], sizes[~long][order]
    longest = int(short[0]) if len(short) else 0
    active = np.searchsorted(-short, -np.arange(longest), "left")  # rows with more than t lines
    for t in range(longest):
        at = first[: active[t]] + t
        a = emit[at] if not t else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (emit[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    good = alpha * beta
    # a transition from each line that has a next one
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(row[1:] == row[:-1])
    both = alpha[at][:, :, None] * move * (emit[at + 1] * beta[at + 1])[:, None, :]
    pairs = (share[row[at], None, None] * both / both.sum((1, 2), keepdims=True)).sum(0)
    return good[:, 1] / good.sum(1), pairs


class LineModel:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, tie: np.ndarray, curve: tuple[float, float]):
        self.edges, self.weights, self.tie, self.curve = edges, weights, tie, curve

    def raw(self, features: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length-weighted mean of the marginals by row, marginals by line)."""
        scores = self.weights[binned(features, self.edges, rows)].sum(1) if len(features) else np.zeros(0)
        good, _ = marginals(scores, self.tie, rows)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        return np.bincount(row, good * lengths, len(rows) - 1) / np.maximum(1e-9, np.bincount(row, lengths, len(rows) - 1)), good

    def quality(self, mean: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * (mean - shift), -30, 30)))


def fit_crf(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], marks: np.ndarray, steps: int = 60, rate: float = 0.1, decay: float = 1e-3, tie_decay: float = 0.05) -> LineModel:
    """parts: (features, lengths, row pointer) of documents; marks: their labels in the same order."""
    k = len(_CLASSES) + 7
    if not parts or not len(marks):
        return LineModel(np.zeros((k, BINS - 1)), np.zeros(3 * k * (BINS + 1)), np.zeros((2, 2)), (0.0, 0.0))
    features, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    rows = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
    shares = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.stack([np.quantile(f, shares) if len(f) else np.zeros(BINS - 1) for f in features.T]) + 1e-9
    columns = binned(features, edges, rows)
    label = np.repeat(marks, np.diff(rows)).astype(float)
    # each label's documents weigh half, each document the same however many lines it has
    n_good, n_bad = max(1, int((marks == 1).sum())), max(1, int((marks == 0).sum()))
    share = np.where(marks == 1, 0.5 / n_good, 0.5 / n_bad) / np.maximum(1, np.diff(rows)) * len(marks)
    weight = np.repeat(share, np.diff(rows))
    # the transitions of the labels, all of which stay what they are within a document
    moves = np.maximum(0, np.diff(rows) - 1) * share
    counted = np.array([[moves[marks == 0].sum(), 0.0], [0.0, moves[marks == 1].sum()]])
    # weights of the features, then the four transitions
    w, at = np.zeros(3 * k * (BINS + 1) + 4), 3 * k * (BINS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat = columns.ravel()
    for t in range(1, steps + 1):
        good, pairs = marginals(w[columns].sum(1), w[at:].reshape(2, 2), rows, share)
        grad = np.bincount(flat, np.repeat((good - label) * weight, columns.shape[1]), len(w)) / len(marks) + decay * w / len(marks)
        grad[at:] = (pairs - counted).ravel() / len(marks) + tie_decay * w[at:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w, tie = w[:at], w[at:].reshape(2, 2)
    model = LineModel(edges, w, tie, (1.0, 0.5))
    mean, _ = model.raw(features, lengths, rows)
    model.curve = _curve(mean, marks)
    return model


def _curve(mean: np.ndarray, marks: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve whose value is 0.7 where the labels are told apart best."""
    order = np.argsort(mean, kind="stable")
    sorted_marks = marks[order]
    n_good, n_bad = max(1, int(marks.sum())), max(1, int((1 - marks).sum()))
    missed = np.append(0, np.cumsum(sorted_marks)) / n_good + 1 - np.append(0, np.cumsum(1 - sorted_marks)) / n_bad
    x = np.concatenate([[0.0], mean[order], [1.0]])
    middle = (x[:-1] + x[1:]) / 2
    best = np.flatnonzero(missed <= missed.min() + 1e-12)
    cut = float(middle[best[np.argmax((x[1:] - x[:-1])[best])]])
    slope = 8.0
    return slope, cut - float(np.log(0.7 / 0.3)) / slope


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, text) to (mark, features and lengths of the lines)."""
    for batch in batches:
        out = []
        for _, _, data, offsets in column_chunks(batch.column(1)):
            features, lengths, rows = line_features(data, offsets)
            both = np.column_stack([features, lengths]).astype("<f4")
            out += [both[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["mark", "lines"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 2500) -> LineModel:
    """A model from at most ``sample`` labelled documents of each label that may be learnt from."""
    labels = labels.where(F.col("quality").isNotNull())
    marks = [sample_ids(labels.where(F.col("quality") == k), sample).select("doc_id", F.lit(k).alias("mark")) for k in (0, 1)]
    marks = marks[0].unionByName(marks[1])  # at most 2 * sample rows
    found = sampled_texts(docs, marks).mapInArrow(_features, "mark int, lines binary").collect()
    k = len(_CLASSES) + 8
    parts = [np.frombuffer(bytes(r["lines"]), "<f4").reshape(-1, k).astype(float) for r in found]
    return fit_crf([(p[:, :-1], p[:, -1], np.array([0, len(p)])) for p in parts], np.array([r["mark"] for r in found], np.int64))


def score_texts(docs: DataFrame, model: LineModel, with_lines: bool = False) -> DataFrame:
    """(doc_id, score[, lines]) of every row; lines: probability that each line with a word is good."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines = np.zeros(batch.num_rows), []
            for a, b, data, offsets in column_chunks(batch.column(1)):
                features, lengths, rows = line_features(data, offsets)
                out[a:b], good = model.raw(features, lengths, rows)
                lines += [good[i:j] for i, j in zip(rows[:-1], rows[1:], strict=True)] if with_lines else []
            more = [pa.array(lines, pa.list_(pa.float64()))] if with_lines else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.quality(out)), *more], names=["doc_id", "score", "lines"][: 2 + with_lines])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double" + ", lines array<double>" * with_lines)


def reject_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold."""
    model, at = learn(docs, labels, **bounds), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean = [model.raw(*line_features(data, offsets))[0] for _, _, data, offsets in column_chunks(batch.column(at))]
            yield batch.filter(pa.array(model.quality(np.concatenate(mean)) >= threshold)) if mean else batch

    return docs.mapInArrow(kept, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scores = score_texts(docs, learn(docs, labels, **bounds))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_line_crf(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
