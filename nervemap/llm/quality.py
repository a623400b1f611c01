"""Quality classifier: random-indexing word vectors, pooled per text, into a small network with calibrated probabilities.

Every word bucket has a fixed sparse random index vector; a word's vector is the sum of the index vectors of the words around it (and of
their shapes: case, digits and marks), over the whole corpus. Buckets bound the table, however many words there are.
A text is the mean of its words' vectors and of its words' shape vectors, with its length. A two-layer numpy network is
fitted on a bounded sample of labelled rows, and its temperature on rows kept out of that fit.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from xxhash import xxh32_intdigest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.runtime import trimmed

#: Word buckets, shape buckets, and components of a vector.
WORDS, SHAPES, SIZE = 1 << 14, 1 << 10, 32
#: Words to either side whose index vectors make a word's vector.
WINDOW = 2
#: Words looked at together.
STEP = 200_000
FEATURES = 2 * SIZE + 2

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Small and non-ASCII letters as x, capitals as X, digits as 0; other bytes stay.
_SHAPE = bytes(120 if 97 <= c <= 122 or c > 127 else 88 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def index_vectors(seed: int = 0) -> np.ndarray:
    """Ternary vectors of the word buckets and, after them, the shape buckets; a quarter of the components isn't zero."""
    draw = np.random.default_rng(seed)
    return draw.choice(np.array([-1, 0, 0, 0, 0, 0, 0, 1], dtype=np.float32), (WORDS + SHAPES, SIZE))


def _buckets(word: bytes) -> tuple[int, int]:
    tail = word[len(word.rstrip(_MARKS)) :]
    shape = word[:2].translate(_SHAPE) + b" " + tail[:3]
    return xxh32_intdigest(word.lower().strip(_MARKS), 1) % WORDS, WORDS + xxh32_intdigest(shape, 2) % SHAPES


def _numbers(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts: which, how many words each, and the words' two buckets. Long texts come in pieces."""
    table: defaultdict[bytes, int] = defaultdict(count().__next__)
    bare, shape = array("q"), array("q")

    def number(words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        for w in reversed(list(islice(reversed(table), len(table) - len(bare)))):
            a, b = _buckets(w)
            bare.append(a)
            shape.append(b)
        return out

    which: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def group() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate(parts)
        return which, np.array([len(p) for p in parts]), np.array(bare, dtype=np.int64)[at], np.array(shape, dtype=np.int64)[at]

    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        for lo in range(0, max(1, len(words)), STEP):
            parts.append(number(words[lo : lo + STEP]))
            which.append(i)
            size += len(parts[-1])
            if size >= STEP:
                yield group()
                which, parts, size = [], [], 0
                if len(table) > 500_000:
                    table, bare, shape = defaultdict(count().__next__), array("q"), array("q")
    if parts:
        yield group()


def _contexts(index: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, SIZE), dtype=np.float64)
        for batch in batches:
            for _, sizes, words, shapes in _numbers(batch["text"].to_pylist()):
                # WINDOW empty places between texts, so that none sees another
                place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)) * WINDOW, sizes) + WINDOW
                own = np.zeros((len(words) + (len(sizes) + 2) * WINDOW, SIZE), dtype=np.float32)
                own[place] = index[words] + index[shapes]
                near = sum(own[place + d] for d in range(-WINDOW, WINDOW + 1) if d)
                if not len(words):
                    continue
                order = np.argsort(words, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(words[order]) != 0)))
                total[words[order][first]] += np.add.reduceat(near[order], first, axis=0)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, d].astype(np.int64)) for d in range(SIZE))], ["bucket", *(f"v{d}" for d in range(SIZE))])

    return run


def word_vectors(docs: DataFrame, text_col: str = "text", seed: int = 0) -> np.ndarray:
    """Unit vectors of the word buckets, from all texts. The sums are of whole numbers, so their order doesn't matter."""
    names = [f"v{d}" for d in range(SIZE)]
    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    sums = slim.mapInArrow(trimmed(_contexts(index_vectors(seed))), "bucket long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((WORDS, SIZE))
    for r in sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toLocalIterator():
        out[r[0]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1.0)).astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row a text: mean word vector, mean shape vector, logarithm of the words, share of words that are their bucket's first."""
    sums, n, kinds = np.zeros((len(texts), 2 * SIZE)), np.zeros(len(texts)), np.zeros(len(texts))
    for which, sizes, words, shapes in _numbers(texts):
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        starts = (np.cumsum(sizes) - sizes)[full]
        at = np.array(which)[full]
        np.add.at(sums[:, :SIZE], at, np.add.reduceat(vectors[words], starts, axis=0))
        np.add.at(sums[:, SIZE:], at, np.add.reduceat(index[shapes], starts, axis=0))
        np.add.at(n, at, sizes[full])
        doc = np.repeat(np.array(which), sizes)
        own = np.unique(doc * WORDS + words) // WORDS
        np.add.at(kinds, own, 1)
    some = np.maximum(n, 1)
    return np.column_stack([sums / some[:, None], np.log1p(n), kinds / some])


@dataclass
class Network:
    """Two layers; probabilities are the logistic of the output over the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Network:
        """Adam on three quarters of the rows, temperature on the others. Without rows of both labels the output is the share of label 1, or a half."""
        draw = np.random.default_rng(seed)
        mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        if len(np.unique(y)) < 2:
            sure = 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
            return Network(mean, scale, np.zeros((x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), sure)
        order = draw.permutation(len(x))
        cut = max(1, 3 * len(x) // 4)
        own, kept = order[:cut], order[cut:]
        net = Network(mean, scale, draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 0.3, hidden), 0.0)
        z = (x - mean) / scale
        first = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
        second = [np.zeros_like(p) for p in first]
        turn = 0
        for _ in range(epochs):
            own = draw.permutation(own)
            for lo in range(0, len(own), 128):
                at = own[lo : lo + 128]
                h = np.tanh(z[at] @ net.w1 + net.b1)
                d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -60, 60))) - y[at]) / len(at)
                back = d[:, None] * net.w2[None, :] * (1 - h * h)
                grads = [z[at].T @ back + decay * net.w1, back.sum(axis=0), h.T @ d + decay * net.w2, np.array([d.sum()])]
                turn += 1
                steps = []
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    steps.append(rate * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8))
                net.w1, net.b1, net.w2, net.b2 = net.w1 - steps[0], net.b1 - steps[1], net.w2 - steps[2], net.b2 - float(steps[3][0])
        if len(kept):
            out, truth = net.logit(x[kept]), y[kept]
            loss = lambda t: float(np.mean(np.logaddexp(0, out / t) - truth * out / t))
            net.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss)
        return net


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """Whether a row's label may not be learnt from: crc32(id as text) mod ``folds`` is ``fold`` (a null id: of an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _rows_of(vectors: np.ndarray, index: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch["text"].to_pylist(), vectors, index)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield batch.drop_columns(["text"]).append_column("x", flat)

    return run


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network
    seed: int = 0

    def scores(self, texts: list[str | None], index: np.ndarray) -> np.ndarray:
        return self.network.probability(features(texts, self.vectors, index)) if texts else np.zeros(0)


def fit(
    docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 20_000, folds: int = 5, fold: int = 0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> QualityModel:
    """Word vectors from all texts, and a network from at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Rows with a null label are no labels; of several labels of an id the smallest counts.
    """
    vectors = word_vectors(docs, text_col, seed)
    usable = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold)).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(target).cast("int")).alias("y"))
    chosen = usable.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(trimmed(_rows_of(vectors, index_vectors(seed))), f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>")
    # at most ``sample`` ids; of rows that share an id one is learnt from
    got = sorted(rows.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect(), key=lambda r: str(r["id"]))
    x, y = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got], dtype=np.float64)
    return QualityModel(vectors, Network.fit(x, y, seed=seed), seed)


def with_score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the probability of label 1 and whether it reaches ``threshold``; only the text is read for it.

    Null and empty texts have a score like any others; all rows and other columns stay, but columns of the two names are replaced.
    """
    kept = docs.drop(score_col, predicted_col)
    vectors, network, seed = model.vectors, model.network, model.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(seed)
        own = QualityModel(vectors, network, seed)
        for batch in batches:
            s = own.scores(batch[text_col].cast(pa.string()).to_pylist(), index)
            yield batch.append_column(score_col, pa.array(s)).append_column(predicted_col, pa.array((s >= threshold).astype(np.int32)))

    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    return kept.mapInArrow(trimmed(run), schema)
