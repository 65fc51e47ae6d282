"""Quality scores by nearest-neighbour voting in a latent-semantic space.

The terms of a text are of two kinds: its words, hashed, and how they are written: each character turns into one of
sixteen classes (lower case, upper case, digit, space, full stop, other signs), whose trigrams are terms, with the
immediate repetitions of words as one more. Term rates are weighted by inverse document frequency, both kinds to the
same length; a singular value decomposition of a bounded sample of labelled texts gives the latent axes, by power
iterations on a random subspace. The labelled vectors are sent to the executors, every document's cosines with all
of them are computed in blocks of exact products, and the nearest ones vote for their labels with their similarities
as weights.
"""

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cut, raw
from .substring import hashed_words

SAMPLE, RANK, NEIGHBOURS, THRESHOLD = 4096, 48, 25, 0.3
CLASSES = 16
STYLE_TERMS = CLASSES**3 + 1
WORDS_LOG2 = 12
TERMS = STYLE_TERMS + (1 << WORDS_LOG2)
#: The share of the words in the squared length of a text's vector.
WORD_SHARE = 0.5
BLOCK = 512
ITERATIONS, SPARE, SEED = 6, 16, 5


def _classes() -> np.ndarray:
    out = np.full(256, 15, dtype=np.uint8)
    for k, signs in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",", b"!?", b"|", b"#$%&*@^~", b"\"'`", b"()[]{}<>", b"-_", b":;", b"/\\+="]):
        out[list(signs)] = k
    out[128:192] = 255  # the later bytes of a character
    out[192:] = 0
    return out


CLASS_OF = _classes()
#: Letters in lower case and bytes beyond ASCII make words here, all else separates them.
WORD_SIGNS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()


def term_rates(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text and log(1 + occurrences in a thousand characters)."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    c = CLASS_OF[np.frombuffer(text, np.uint8)]
    c = c[c != 255].astype(np.int64)
    counts = np.zeros(TERMS, np.int64)
    if len(c) >= 3:
        counts[: STYLE_TERMS - 1] = np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=STYLE_TERMS - 1)
    words = text.split()
    counts[STYLE_TERMS - 1] = sum(map(eq, words, words[1:]))
    hashed, _ = hashed_words([text.translate(WORD_SIGNS)])
    counts[STYLE_TERMS:] = np.bincount((hashed >> np.uint64(64 - WORDS_LOG2)).astype(np.int64), minlength=1 << WORDS_LOG2)
    terms = np.flatnonzero(counts)
    return terms, np.log1p(counts[terms] * (1000.0 / max(len(c), 1))).astype(np.float32)


class Model:
    """Latent axes, labelled vectors and their labels; at most ``SAMPLE`` of each."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int, neighbours: int):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.neighbours, self.labels = neighbours, labels.astype(np.float32)
        seen = np.zeros(TERMS, np.int64)
        for terms, _ in texts:
            seen[terms] += 1
        least = 1 if len(texts) < 200 else 3
        self.idf = np.where(seen >= least, np.log((1 + len(texts)) / (1 + seen)) + 0.05, 0).astype(np.float32)
        self.axes = np.zeros((TERMS, 1), np.float32)
        if len(texts):
            x = self.weighted(texts)
            self.axes = principal_axes(x, min(rank, len(texts)))
            del x
        self.vectors = self.latent(texts)

    def weighted(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of tf-idf, both kinds of terms to their share of the length."""
        x = np.zeros((len(texts), TERMS), np.float32)
        for i, (terms, rates) in enumerate(texts):
            x[i, terms] = rates * self.idf[terms]
        for part, share in ((x[:, :STYLE_TERMS], 1 - WORD_SHARE), (x[:, STYLE_TERMS:], WORD_SHARE)):
            part *= (np.sqrt(share) / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9))[:, None].astype(np.float32)
        return x

    def latent(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors in the latent space."""
        parts = [self.weighted(texts[at : at + BLOCK]) @ self.axes for at in range(0, len(texts), BLOCK)]
        return unit(np.concatenate([np.zeros((0, self.axes.shape[1]), np.float32), *parts]))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors; the prior where none is similar."""
        out = np.full(len(texts), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        cosines = self.latent(texts) @ self.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64)
        total = weights.sum(axis=1)
        return np.where(total > 1e-6, (weights * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-6), out)


def principal_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of ``x`` as columns."""
    basis = np.random.default_rng(SEED).standard_normal((x.shape[1], rank + SPARE), dtype=np.float32)
    for _ in range(ITERATIONS):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :rank], dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on ``sample`` labelled documents at most, chosen by a hash of their id. The rows of ``labels`` decide what may be learned from.

    Rows with a null id or label are skipped; of repeated ids the larger label counts, of texts with the same id all
    up to twice ``sample``; null texts have no terms. No rows give a model that scores one half.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("id", F.lit(7)), "id")
        .limit(sample)
    )
    chosen = cut(chosen)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def describe(batches):
        for batch in batches:
            found = [term_rates(t) for t in raw(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.astype(np.int32).tobytes() for t, _ in found], pa.binary()), pa.array([r.tobytes() for _, r in found], pa.binary())],
                names=["id", "label", "terms", "rates"],
            )

    kind = dict(rows.dtypes)["id"]
    found = rows.select("id", "label", "text").mapInArrow(describe, f"id {kind}, label double, terms binary, rates binary").limit(2 * sample).collect()
    found.sort(key=lambda r: (r["id"], bytes(r["terms"])))
    texts = [(np.frombuffer(r["terms"], np.int32).astype(np.int64), np.frombuffer(r["rates"], np.float32)) for r in found]
    return Model(texts, np.array([r["label"] for r in found], np.float64), rank, neighbours)


def quality(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each text, 0 to 1. Null, empty and unlike texts get the share of label 1 among the labelled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), BLOCK):
            out.append(sent.value.scores([term_rates(t) for t in raw(texts.slice(at, BLOCK))]))
        return pa.array(np.clip(np.concatenate(out), 0, 1) if out else [], pa.float64())

    return score(F.col(text_col))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, their columns as they were.

    Null and empty texts have the score that ``quality`` gives them; repeated rows stay or go together; an empty table
    stays empty; no column but the text decides.
    """
    model = fit(docs, labels, "quality")
    return docs.where(quality(docs, model) >= threshold)
