"""Toxicity by non-negative positive-unlabelled learning.

The positives are texts that labels confirm as toxic; all other text is taken
as unlabelled, a mixture with the class prior pi of toxic text.  The risk of a
classifier g is ``pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])``: the risk
on negatives is what is left of the unlabelled risk after the share of the
positives, and it isn't let below zero, else a flexible classifier would fit
the difference.  While it is below zero the step goes the other way.  The
prior is the share of toxic texts among the labelled ones that may be learnt
from.

Features are the lower-cased words of letters and their first 4 and 6 bytes,
hashed to 2^18 buckets; a text has a bucket or hasn't.  Training picks the
``features`` buckets that stand out most in positives against unlabelled texts
(by more than ``least_z`` standard errors) and fits a logistic model on them
with numpy, from at most ``positives``
and ``unlabelled`` rows (the bounds of the sample); every whole text is then
scored.

Defined results: null or empty text has the score of a text without features;
a null doc_id counts as held out; repeated rows are scored each, and of rows
that share a sampled doc_id one is learnt from; without any
confirmed row the prior is 0.5 of one row and all scores are alike; an empty
table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample_ids, sampled_texts
from .textcols import byte_table, column_chunks, hash_spans, spans

BITS = 18
#: Losses are flat beyond this logit, which bounds what one text adds to a risk.
LIMIT = 5.0
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_SEP, _VALUES = byte_table(bytes(b for b in range(256) if b not in LETTERS), fold_case=True, seed=5)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all word and prefix features, with repetitions."""
    starts, ends, rows = spans(~_SEP[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    words = hash_spans(data, starts, ends, _VALUES)
    padded = _FOLD[np.append(data, np.zeros(8, np.uint8))]
    first = padded[starts[:, None] + np.arange(8)].reshape(-1, 8).view("<u8")[:, 0] if len(starts) else np.zeros(0, np.uint64)
    size = ends - starts
    shift = np.uint64(64 - BITS)
    out_rows, out = [row], [words >> shift]
    with np.errstate(over="ignore"):
        for n in (4, 6):
            long = size >= n
            prefix = (first[long] & np.uint64((1 << 8 * n) - 1)) + np.uint64(n)
            out_rows.append(row[long])
            out.append((prefix * np.uint64(0x9E3779B97F4A7C15) ^ prefix >> np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93) >> shift)
    return np.concatenate(out_rows), np.concatenate(out).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, text) to (mark, the text's distinct buckets)."""
    for batch in batches:
        out = []
        for a, b, data, offsets in column_chunks(batch.column(1)):
            rows, buckets = token_buckets(data, offsets)
            keys = np.unique(rows << BITS | buckets)
            cut = np.searchsorted(keys, np.arange(b - a + 1) << BITS)
            keys = (keys & ((1 << BITS) - 1)).astype("<u4")
            out += [keys[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["mark", "buckets"])


def nnpu_risk(g: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk on positives, risk on negatives before it is held at zero) of the logits g: pi E_p[l(g)] and
    E_u[l(-g)] - pi E_p[l(-g)] with the logistic loss l(g) = log(1 + exp(-g)), flat beyond LIMIT."""
    g = np.clip(g, -LIMIT, LIMIT)
    plus, minus = np.logaddexp(0, -g), np.logaddexp(0, g)
    return prior * plus[is_p].mean(), minus[~is_p].mean() - prior * minus[is_p].mean()


def nnpu_slopes(g: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """The step's slope by each logit: that of the whole risk, or, while the risk on negatives is below zero, away from it."""
    inside, n_p, n_u = np.abs(g) < LIMIT, is_p.sum(), (~is_p).sum()
    s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # the slope of l(-g); that of l(g) is s - 1
    negative = np.where(is_p, -prior * s / n_p, s / n_u) * inside
    if nnpu_risk(g, is_p, prior)[1] < 0:
        return -negative
    return negative + np.where(is_p, prior * (s - 1) / n_p, 0) * inside


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = 4096, least_z: float = 3.0, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from lists of distinct buckets."""
    size = 1 << BITS

    def share(rows: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(rows), minlength=size).astype(float) if rows else np.zeros(size)

    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    p, u = (share(positive) + 0.1) / (n_p + 0.2), (share(unlabelled) + 0.1) / (n_u + 0.2)
    contrast = (p - u) / np.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    chosen = np.argsort(-contrast, kind="stable")[:features]
    chosen = np.sort(chosen[contrast[chosen] > least_z])
    if not positive or not unlabelled:
        return chosen, np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    rows = np.repeat(np.arange(len(positive) + len(unlabelled)), [len(x) for x in (*positive, *unlabelled)])
    columns = column[np.concatenate([*positive, *unlabelled])]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    n, is_p = len(positive) + len(unlabelled), np.arange(len(positive) + len(unlabelled)) < len(positive)
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = np.bincount(rows, w[columns], n) + b
        d = nnpu_slopes(g, is_p, prior)
        grad = np.append(np.bincount(columns, d[rows], len(w)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return chosen, w, b


def learn(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from the labelled rows that may be learnt from; the bounds limit the sample of each kind."""
    open_ = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    n, n_toxic = open_.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    prior = (n_toxic + 0.5) / (n + 1)
    confirmed = sample_ids(open_.where("toxic = 1"), positives).select("doc_id", F.lit(1).alias("mark"))
    mixture = sample_ids(docs.select("doc_id"), unlabelled).select("doc_id", F.lit(0).alias("mark"))
    marks = confirmed.unionByName(mixture)  # at most positives + unlabelled rows
    found = sampled_texts(docs, marks).mapInArrow(_buckets, "mark int, buckets binary").collect()
    rows = [(r["mark"], np.frombuffer(bytes(r["buckets"]), "<u4").astype(np.int64)) for r in found]
    return fit_nnpu([x for k, x in rows if k], [x for k, x in rows if not k], prior)


def _score_column(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(column), bias)
    for a, b, data, offsets in column_chunks(column):
        rows, buckets = token_buckets(data, offsets)
        told = table[buckets] != 0
        keys = np.unique(rows[told] << BITS | buckets[told])
        out[a:b] += np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _weights(model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model[0]] = model[1]
    return table


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _weights(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score_column(batch.column(1), table, model[2]))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """The rows of docs, all their columns, whose score is below the threshold."""
    model, at = learn(docs, labels, **bounds), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _weights(model)
        for batch in batches:
            yield batch.filter(pa.array(_score_column(batch.column(at), table, model[2]) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scores = score_texts(docs, learn(docs, labels, **bounds))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
