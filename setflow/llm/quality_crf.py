"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Method. Every line has measures (length, words, symbols, digits, case, repetition within the line and of earlier
lines, ...), each cut into bins; a line's features are its own bins and those of the lines before and after. The field
labels every line good or bad; forward-backward marginals, weighted by line length, add up to a document's
share of good text, which one logistic curve turns into its score.

Training. Lines take the label of their document. At most SAMPLE labelled documents of at most SAMPLE_BYTES bytes and SAMPLE_LINES
lines, the first by a hash of their keys outside the held-out fold, teach bins, weights and curve; the fit runs on the driver
over their bins alone, at most SAMPLE * SAMPLE_LINES rows of 72 bytes. The model is a few thousand numbers. Every text is scored whole.

Defined cases: null and empty texts have one empty line and get its score; a text of any length is scored whole, in one task; equal texts
have equal scores, and documents of equal hashes teach in the order of their keys; lines end at \\n; a repeated label row counts
again; null labels and labels of missing documents teach nothing; without two classes in the sample every score is the share
of label 1 (0.5 without labels); an empty table gives an empty result; input columns named like an output column
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C
from setflow.llm.language_id import crc_fold

FOLDS, HELD_OUT = 4, 2
SAMPLE, SAMPLE_BYTES, SAMPLE_LINES = 4000, 64 << 10, 500
THRESHOLD = 0.7
BINS = 8
OUT = ("score", "predicted")

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:'\"()-?/"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]^~=_\\+@`"]] = True
_CLASSES = {
    "symbol": _SYMBOL,
    "punct": _PUNCT,
    "bang": np.arange(256) == ord("!"),
    "bar": np.arange(256) == ord("|"),
    "digit": (np.arange(256) >= 48) & (np.arange(256) < 58),
    "upper": (np.arange(256) >= 65) & (np.arange(256) < 91),
    "high": np.arange(256) >= 128,
}
N_MEASURES = 18


def measures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(one row of measures for each line, length of each line)."""
    lines = text.split(b"\n")
    out = np.zeros((len(lines), N_MEASURES), np.float32)
    data = np.frombuffer(text, np.uint8)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    some = np.maximum(lengths, 1)
    for k, table in enumerate(_CLASSES.values()):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        out[:, k] = (sums[np.minimum(at[1:] - 1, len(data))] - sums[np.minimum(at[:-1], len(data))]) / some
    seen: set[bytes] = set()
    grams: set[int] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        row = out[k]
        row[7] = np.log1p(lengths[k])
        row[8] = np.log1p(n)
        row[9] = lengths[k] / max(1, n)
        if n:
            row[10] = len(set(words)) / n
            row[11] = line in seen
            row[12] = sum(a == b for a, b in zip(words, words[1:])) / n
            three = [hash(w) for w in zip(words, words[1:], words[2:])]
            row[13] = sum(h in grams for h in three) / max(1, len(three))
            grams.update(three)
            row[14] = len(set(three)) / max(1, len(three))
            row[15] = line.rstrip()[-1:] in (b".", b"!", b"?", b":")
            row[16] = sum(len(w) <= 3 for w in words) / n
            row[17] = max(map(len, words))
            seen.add(line)
    return out, lengths


@dataclass
class Field:
    edges: np.ndarray  # [measure, bin edge]
    weights: np.ndarray  # [neighbour (before, own, after), measure, bin]: of good against bad
    change: np.ndarray  # [from, to]
    ends: np.ndarray  # of a first, and of a last line: good against bad
    curve: tuple[float, float]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, values.T)], axis=1)

    def unary(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How much each line looks good; bins of several documents one after another."""
        m = np.arange(bins.shape[1])
        out = self.weights[1][m, bins].sum(axis=1)
        before, after = self.weights[0][m, bins].sum(axis=1), self.weights[2][m, bins].sum(axis=1)
        out[1:] += np.where(first[1:], 0.0, before[:-1])
        out[:-1] += np.where(last[:-1], 0.0, after[1:])
        return out + first * self.ends[0] + last * self.ends[1]


def forward_backward(unary: np.ndarray, change: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of good for each line, expected changes [from, to], sum of log partition functions).

    counts: lines of each document. Documents run side by side, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    lengths = counts[order]
    top = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(top), side="left")  # documents of more than t lines
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    for t in range(top):
        at = start[: active[t]] + t
        if t:
            x = alpha[at - 1][:, :, None] + change[None]
            alpha[at] = np.logaddexp(x[:, 0], x[:, 1]) + score[at]
        else:
            alpha[at] = score[at]
    for t in range(top - 2, -1, -1):
        at = start[: active[t + 1]] + t
        x = change[None] + (score[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    ends = start + lengths - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.empty(len(unary))
    owner = np.repeat(np.arange(len(counts)), counts)
    back = np.empty(len(counts))
    back[order] = log_z
    z = back[owner]
    marginal = np.exp(alpha[:, 1] + beta[:, 1] - z)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(unary) > 1 else np.zeros(0, int)
    pair = np.exp(alpha[inner][:, :, None] + change[None] + (score[inner + 1] + beta[inner + 1])[:, None, :] - z[inner][:, None, None])
    return marginal, pair.sum(axis=0), float(log_z.sum())


def share_of_good(marginal: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marginals weighted by length, for each document; an empty line weighs 1."""
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    weight = lengths + 1.0
    return np.add.reduceat(marginal * weight, at) / np.add.reduceat(weight, at)


def logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit_field(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 2.0) -> Field:
    """Penalised conditional likelihood, by gradient steps of adaptive size."""
    edges = np.stack([np.resize(e := np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])), BINS - 1) if len(np.unique(v)) else np.zeros(BINS - 1) for v in values.T])
    edges.sort(axis=1)
    field = Field(edges, np.zeros((3, N_MEASURES, BINS)), np.zeros((2, 2)), np.zeros(2), (0.0, 1.0))
    bins = field.bins(values)
    line_label = np.repeat(label, counts).astype(float)
    first, last = np.zeros(len(values), bool), np.zeros(len(values), bool)
    at = np.concatenate([[0], np.cumsum(counts)])
    first[at[:-1]], last[at[1:] - 1] = True, True
    owner = np.repeat(np.arange(len(counts)), counts)
    # a long document counts no more than a short one, a rare class as much as a frequent one
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_label[inner].astype(int), line_label[inner + 1].astype(int)), 1.0)
    flat = (np.arange(N_MEASURES) * BINS + bins).ravel()

    def sums(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, N_MEASURES), N_MEASURES * BINS).reshape(N_MEASURES, BINS)

    theta = np.zeros(3 * N_MEASURES * BINS + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        field.weights = theta[:-6].reshape(3, N_MEASURES, BINS)
        field.change, field.ends = theta[-6:-2].reshape(2, 2), theta[-2:]
        marginal, pairs, _ = forward_backward(field.unary(bins, first, last), field.change, counts)
        rest = line_label - marginal
        before, after = np.zeros_like(rest), np.zeros_like(rest)
        before[:-1] = np.where(first[1:], 0.0, rest[1:])
        after[1:] = np.where(last[:-1], 0.0, rest[:-1])
        grad = np.concatenate([sums(before).ravel(), sums(rest).ravel(), sums(after).ravel(), (seen - pairs).ravel(), [rest[first].sum(), rest[last].sum()]])
        grad -= ridge * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weights, field.change, field.ends = theta[:-6].reshape(3, N_MEASURES, BINS), theta[-6:-2].reshape(2, 2), theta[-2:]
    marginal, _, _ = forward_backward(field.unary(bins, first, last), field.change, counts)
    x = logit(share_of_good(marginal, lengths, counts))
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton steps of a logistic curve
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = p * (1 - p) + 1e-6
        h = np.array([[w.sum() + 1.0, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1.0]])
        g = np.array([(label - p).sum() - a, ((label - p) * x).sum() - (b - 1.0)])
        d = np.linalg.solve(h, g)
        a, b = a + d[0], b + d[1]
        if abs(d).max() < 1e-6:
            break
    field.curve = (float(a), float(max(b, 1e-3)))
    return field


def score_texts(field: Field | float, texts: C.Texts) -> np.ndarray:
    if isinstance(field, float):
        return np.full(texts.n, field)
    out = np.empty(texts.n)
    for a, b in texts.groups():
        found = [measures(texts[k]) for k in range(a, b)]
        counts = np.array([len(x) for _, x in found])
        first, last = np.zeros(counts.sum(), bool), np.zeros(counts.sum(), bool)
        at = np.concatenate([[0], np.cumsum(counts)])
        first[at[:-1]], last[at[1:] - 1] = True, True
        unary = field.unary(field.bins(np.concatenate([x for x, _ in found])), first, last)
        marginal, _, _ = forward_backward(unary, field.change, counts)
        x = logit(share_of_good(marginal, np.concatenate([x for _, x in found]), counts))
        out[a:b] = 1 / (1 + np.exp(-(field.curve[0] + field.curve[1] * x)))
    return out


def measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = C.Texts(batch["text"])
        found = [measures(texts[k]) for k in range(texts.n)]
        yield pa.RecordBatch.from_arrays([batch["quality"], pa.array([v.tobytes() for v, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["quality", "measures", "lengths"])


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, most_lines: int = SAMPLE_LINES) -> Field | float:
    """A field from labelled rows outside the held-out fold; a number where one class is missing."""
    C.bounded_batches(df.sparkSession)
    known = labels.where(F.col(label).isNotNull() & (crc_fold(F.col(key), FOLDS) != HELD_OUT)).select(F.col(key).alias("__sf_key"), F.col(label).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("__sf_key"), "__sf_key", "quality").limit(sample)
    own = F.col(f"`{text}`").cast("string")
    rows = df.where((F.octet_length(own) <= most_bytes) & (F.regexp_count(own, F.lit("\n")) < most_lines)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = rows.join(F.broadcast(chosen), F.col("key") == F.col("__sf_key"))  # at most `sample` rows
    found = joined.select("key", "quality", "text").mapInArrow(measurer, "quality int, measures binary, lengths binary").toArrow()
    label_values = found["quality"].to_numpy().astype(float) if found.num_rows else np.empty(0)
    if len(np.unique(label_values)) < 2:
        return float(label_values.mean()) if len(label_values) else 0.5
    order = np.argsort([hash_of(x) for x in zip(found["measures"].to_pylist(), label_values.tolist())], kind="stable")  # rows arrive in any order
    values = [np.frombuffer(x, np.float32).reshape(-1, N_MEASURES) for x in found["measures"].to_pylist()]
    lengths = [np.frombuffer(x, np.int64) for x in found["lengths"].to_pylist()]
    return fit_field(np.concatenate([values[k] for k in order]), np.concatenate([lengths[k] for k in order]), np.array([len(lengths[k]) for k in order]), label_values[order])


def hash_of(x: tuple[bytes, float]) -> int:
    import zlib

    return zlib.crc32(x[0]) * 2 + int(x[1])


def scorer(shared, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + [pa.array(score_texts(shared.value, C.Texts(batch[text])))], names=[*names, "score"])

    return run


def classify(df: DataFrame, field: Field | float, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of df with score and predicted."""
    C.bounded_batches(df.sparkSession)
    names = [n for n in (keep if keep is not None else df.columns) if n.lower() not in OUT]
    own = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias("__sf_text"))
    shared = df.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    scored = own.mapInArrow(scorer(shared, names, "__sf_text"), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = classify(docs, field, keep=["doc_id"])
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality_crf": op5_quality_crf}
ORACLE: dict[str, str] = {}
