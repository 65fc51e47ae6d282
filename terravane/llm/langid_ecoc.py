"""Language identification by error-correcting output codes.

Each language has a codeword, a row of a Hadamard matrix, so that any two codewords differ in about half of their
bits. For each bit a binary classifier over character trigrams says how likely the text comes from the languages
with that bit set. Loss-weighted decoding sums the logistic losses of the bits for each codeword, a bit's loss
weighted by how often its classifier is right on learned texts of that codeword's language; the smallest sum wins,
and a second one close to it flags the text as ambiguous.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

BUCKETS_LOG2, SAMPLE_PER_LANGUAGE, SMOOTHING, MARGIN, AMBIGUOUS = 15, 1500, 0.5, 4.0, 1.0
BUCKETS = 1 << BUCKETS_LOG2
LETTER = r"\p{L}"
UNKNOWN = "und"
CHUNK = 1 << 18
#: Letters stay, in lower case; everything else in ASCII becomes a space.
FOLD = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower()], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """The hashed trigrams of UTF-8 bytes, those of spaces only left out."""
    b = FOLD[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]
    codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    codes = codes[codes != 0x202020]
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: rows of Sylvester's matrix without constant columns."""
    size = 2
    while size < n + 1:
        size *= 2
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    rows = h[1 : n + 1]
    return rows[:, (rows != rows[0]).any(axis=0)] if n > 1 else np.zeros((1, 0))


class Model:
    """The languages, their codewords, and for each trigram bucket its weight in every bit's classifier."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.codes = languages, codewords(len(languages)) if languages else np.zeros((0, 0))
        p = counts + SMOOTHING
        p = p / p.sum(axis=1, keepdims=True)
        self.weights = np.zeros((BUCKETS, self.codes.shape[1]), np.float32)
        for bit in range(self.codes.shape[1]):
            up = self.codes[:, bit] > 0
            w = np.log(p[up].mean(axis=0)) - np.log(p[~up].mean(axis=0))
            typical = np.abs(p @ w).mean()
            self.weights[:, bit] = w * (MARGIN / max(typical, 1e-9))
        self.trust = np.ones(self.codes.shape)

    def margins(self, text: str) -> np.ndarray:
        """What the classifier of each bit says: above zero for languages with that bit set."""
        found = grams(text)
        out = np.zeros(self.codes.shape[1])
        for at in range(0, len(found), CHUNK):
            out += self.weights[found[at : at + CHUNK]].sum(axis=0, dtype=np.float64)
        return out / (len(found) + 20)

    def weigh(self, right: np.ndarray, seen: np.ndarray) -> None:
        """Weights of a language's bits from how many of its ``seen`` texts each bit has ``right``; their mean is one."""
        rates = (right + 1) / (seen[:, None] + 2)
        self.trust = rates / rates.mean(axis=1, keepdims=True) if rates.size else np.ones(self.codes.shape)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), and whether another codeword is nearly as close."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        losses = (self.trust * np.logaddexp(0, -self.codes * self.margins(text))).sum(axis=1)
        likely = np.exp(losses.min() - losses)
        best, order = int(losses.argmin()), np.sort(losses)
        return self.languages[best], float(likely[best] / likely.sum()), bool(len(order) > 1 and order[1] - order[0] < AMBIGUOUS)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language, chosen by a hash of their id.

    The rows given are those that may be learned from. Rows with a null language, or a text that is null or has no
    letter, are skipped, and only languages that other rows are left of can be predicted; no rows give a model that
    finds none. Repeated rows count each. A first pass counts trigrams, a second one how often each bit is right.
    What reaches the driver is one count for each language and trigram bucket, whatever the number of documents.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    chosen = rows.where(drawn).select("lang", "text")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    found[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    summed = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(summed["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    place = {k: i for i, k in enumerate(languages)}
    counts[[place[k] for k in summed["lang"].to_pylist()], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    model = Model(languages, counts)
    sent = docs.sparkSession.sparkContext.broadcast((model, place))

    def check(batches):
        model, place = sent.value
        seen, right = np.zeros(len(place), np.int64), np.zeros(model.codes.shape, np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in place and has_letter(text):
                    seen[place[lang]] += 1
                    right[place[lang]] += model.codes[place[lang]] * model.margins(text) > 0
        yield pa.RecordBatch.from_arrays([pa.array(range(len(place)), pa.int32()), pa.array(seen), pa.array(right.tolist(), pa.list_(pa.int64()))], names=["lang", "seen", "right"])

    parts = chosen.mapInArrow(check, "lang int, seen long, right array<long>")
    bits = [F.sum(F.col("right")[b]).alias(f"b{b}") for b in range(model.codes.shape[1])]
    found = parts.groupBy("lang").agg(F.sum("seen").alias("seen"), *bits).collect() if languages else []
    seen, right = np.zeros(len(languages)), np.zeros(model.codes.shape)
    for r in found:
        seen[r["lang"]], right[r["lang"]] = r["seen"], [r[f"b{b}"] for b in range(right.shape[1])]
    model.weigh(right, seen)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct of lang_pred, score and ambiguous. Null texts and texts without a letter are ``und`` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])

    @F.arrow_udf(kind)
    def decode(texts: pa.Array) -> pa.Array:
        found = [sent.value.decode(t) for t in texts.to_pylist()]
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=["lang_pred", "score", "ambiguous"])

    return decode(F.col(text_col))
