"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits, far apart from all others.  For each bit a
binary classifier (logistic regression on hashed n-grams) says which side of the bit
a text is on.  Decoding sums a loss over the bits, weighted by how well each classifier
separates its sides, and chooses the nearest codeword; a text whose two nearest
codewords are about equally near is flagged as ambiguous.

The classifiers are fitted on a bounded sample of the labelled rows: about
``train_texts`` distinct texts, of each language as many and at least one, chosen by hash.  Texts
of up to ``TRAIN_BYTES`` are learnt from; a language that has only longer ones is learnt
from as much of some of them.  Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import shingles
from foldwise.llm.common import materialise, table, text_of
from foldwise.llm.registry import query

TRAIN_TEXTS = 2400  # about this many distinct texts are learnt from
TRAIN_BYTES = 1 << 15
BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
MIN_BITS = 15
AMBIGUOUS = 0.15  # gap of the two least losses, as a share of the largest possible
_U = np.uint64


def codewords(n: int, bits: int | None = None, tries: int = 300, seed: int = 3) -> np.ndarray:
    """``n`` rows of +1 and -1 whose least distance is large; the best of many random codes, the same each time."""
    bits = bits or max(MIN_BITS, 4 * int(np.ceil(np.log2(max(n, 2)))))
    rng, best, at = np.random.default_rng(seed), None, -1
    for _ in range(tries):
        code = rng.integers(0, 2, (n, bits)) * 2 - 1
        if n > 1:
            same = np.abs(code.sum(axis=0)) == n
            code[rng.integers(0, n, same.sum()), np.flatnonzero(same)] *= -1  # every bit parts the languages
        apart = (code @ code.T - 2 * bits * np.eye(n)).max() if n > 1 else 0
        if best is None or apart < at:
            best, at = code, apart
    return best.astype(np.float32)


def _letters(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters and all bytes of other scripts; any other run of bytes is one space."""
    plain = _CLASS[data]
    gap = plain == 32
    return plain[~(gap & np.concatenate(([False], gap[:-1])))]


_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def gram_indices(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed indices of all n-grams of a text's letters."""
    letters = _letters(np.frombuffer(b" " + text + b" ", dtype=np.uint8)).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(letters) >= n:
            h = np.full(len(letters) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = h * _U(257) + letters[k : len(letters) - n + 1 + k]
            out.append((h * _U(0x9E3779B97F4A7C15) >> _U(64 - int(np.log2(buckets)))).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, texts: Sequence[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(self.bias)), dtype=np.float32)
        for i, t in enumerate(texts):
            counts = sum(np.bincount(gram_indices(t[a : a + (1 << 21)]), minlength=len(self.weights)) for a in range(0, max(len(t), 1), 1 << 21))
            used = np.flatnonzero(counts)
            x = _scaled(counts[used])
            out[i] = x @ self.weights[used] + self.bias
        return out

    def predict(self, texts: Sequence[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        margin = np.clip(self.margins(texts), -30, 30)
        # Logistic loss of every codeword: languages along the last axis.
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = 1.0 / near.sum(axis=1)
        if len(self.languages) > 1:
            two = np.take_along_axis(loss, order[:, :2], axis=1)
            vague = two[:, 1] - two[:, 0] < AMBIGUOUS * self.trust.sum()
        else:
            vague = np.zeros(len(texts), dtype=bool)
        return [self.languages[k] for k in order[:, 0]], score, vague


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts).astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def fit(texts: Sequence[bytes], labels: Sequence[str], rounds: int = 50, decay: float = 1e-4) -> Model:
    """Classifiers of all bits at once, by accelerated gradient descent."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    at = np.array([languages.index(label) for label in labels])
    y, bits = code[at], code.shape[1]
    x = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, t in enumerate(texts):
        used, counts = np.unique(gram_indices(t), return_counts=True)
        x[i, used] = _scaled(counts)
    share = (1 / (len(languages) * np.bincount(at)))[at].astype(np.float32)[:, None]  # languages count alike
    w, b = np.zeros((BUCKETS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    ahead, t_now, step = w, 1.0, 8.0
    for _ in range(rounds):
        pull = -y * share / (1 + np.exp(np.clip(y * (x @ ahead + b), -30, 30)))
        new = ahead - step * (x.T @ pull + decay * ahead)
        b = b - step * pull.sum(axis=0)
        t_next = (1 + np.sqrt(1 + 4 * t_now * t_now)) / 2
        ahead = new + np.float32((t_now - 1) / t_next) * (new - w)
        w, t_now = new, t_next
    m = x @ w + b
    right = np.clip((share * (np.sign(m) == y)).sum(axis=0), 0.5, 1 - 1e-3)  # each bit's balanced accuracy
    trust = np.maximum(np.log(right / (1 - right)), 1e-6)
    sharp = np.float32(3.0 / max(float(np.median(np.abs(m))), 1e-6) if len(languages) > 1 else 1.0)
    return Model(languages, code, w * sharp, b * sharp, (trust / trust.mean()).astype(np.float64))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", train_texts: int = TRAIN_TEXTS) -> Model | None:
    """Fit on about ``train_texts`` distinct texts, of each language as many, those of the least hashes; None without any."""
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"))
    known = known.withColumns({"short": F.octet_length("text") <= TRAIN_BYTES, "at": F.pmod(F.xxhash64("text"), F.lit(1 << 30))})
    sizes = known.groupBy("label").agg(
        F.bool_or("short").alias("short"), *[F.approx_count_distinct(F.when(F.col("short") == kind, F.xxhash64("text")), 0.02).alias(f"n_{kind}") for kind in (True, False)],
        *[F.min(F.when(F.col("short") == kind, F.col("at"))).alias(f"first_{kind}") for kind in (True, False)]).collect()  # one row for each language
    if not sizes:
        return None
    cuts = []
    for r in sizes:
        kind = r["short"]
        cut = int((1 << 30) * min(1.0, train_texts / len(sizes) / max(r[f"n_{kind}"], 1)))
        cuts.append((r["label"], kind, max(cut, r[f"first_{kind}"] + 1)))
    wanted = F.element_at(F.create_map(*[F.lit(x) for name, kind, cut in cuts for x in (name, F.struct(F.lit(kind).alias("short"), F.lit(cut).alias("cut")))]), F.col("label"))
    sample = known.withColumn("wanted", wanted).where((F.col("short") == F.col("wanted.short")) & (F.col("at") < F.col("wanted.cut")))
    sample = sample.select(F.when(F.col("short"), F.col("text")).otherwise(F.substring("text", 1, TRAIN_BYTES // 4)).alias("text"), "label").distinct().toArrow()
    texts, labels = sample.column(0).cast(pa.binary()).to_pylist(), sample.column(1).to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    return fit([texts[i] for i in order], [labels[i] for i in order])


def identified(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``row, lang_pred, score, ambiguous`` for every row.

    Defined cases: a null text or one without a letter is ``und`` with score 0 and not
    ambiguous, as is every text without a model; repeated rows are judged each time;
    extra columns stay inside ``row``; an empty table gives an empty result.
    """
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text]).alias("row"), text_of(text).alias("__text"))
    letter = F.col("__text").rlike(r"\p{L}")
    packed = packed.withColumn("__any", letter)
    schema = packed.select("row").limit(0).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(False)}).schema
    sent = documents.sparkSession.sparkContext.broadcast(model)  # languages x bits and buckets x bits: a few megabytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            some = batch.column(2).to_pylist()
            for a, b in shingles.batches(texts):
                lang, score, vague = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a, dtype=bool)
                real = [i for i in range(b - a) if some[a + i]] if m else []
                if real:
                    found = m.predict([texts[a + i] for i in real])
                    for i, name in zip(real, found[0], strict=True):
                        lang[i] = name
                    score[real], vague[real] = found[1], found[2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lang), pa.array(score), pa.array(vague)], names=["row", "lang_pred", "score", "ambiguous"])

    return packed.select("row", "__text", "__any").mapInArrow(run, schema)


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from those whose crc32 of the id leaves 0 or 2 modulo 3."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    model = train(documents.where(~held_out))
    found = identified(documents.select("doc_id", "text"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "ambiguous").withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", F.col("score").cast("double").alias("score"), "ambiguous")
