"""Toxicity of texts by gradient-boosted trees over a few dense features, with calibrated scores.

The features of a text: how dense words of a lexicon are in it and how strong they are, how many
of them stand near a second person, shares of capitals and of punctuation, and rates of obfuscation
(symbols and digits inside words, and lexicon words that show once such characters are read as letters).

The lexicon is learnt: whole words, and beginnings of words for inflected ones, that the texts
labelled toxic have far more often than the others.  Everything is fitted on a bounded sample of the
labelled rows, about ``train_rows`` texts chosen by hash of the id, half of either label where there
are enough.  The sample's texts stay on the executors; the driver gets counts of at most ``LEXICON``
lexicon entries and one row of features for each text.  Lexicon and trees are cross-fitted over
``FOLDS`` folds, so that isotonic calibration sees only scores of texts that they were not learnt from.
Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import shingles
from foldwise.llm.common import materialise, table, text_of
from foldwise.llm.registry import query
from foldwise.session import bounded

TRAIN_ROWS = 12_000
LEXICON = 4096  # entries at most, those of the clearest difference
LEAST_TEXTS = 3  # toxic texts that have an entry, at least
CLEAR = 3.5  # standard errors between the two rates of an entry, at least
FOLDS = 3
STEMS = (4, 5, 6)  # bytes of the beginnings of words
NEAR_WORDS = 5
TREES, DEPTH, STEP, BINS = 100, 3, 0.15, 48
TOXIC_FROM = 0.3
PIECE_BYTES = 1 << 20
_U = np.uint64

# Words for the second person.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer eure tu te toi ton tes vous votre vos tú ti usted ustedes vosotros vuestro"
).split()

NAMES = (
    "log_words", "hit_density", "weight_density", "log_hits", "log_weight", "greatest_weight", "log_strong", "log_unmasked", "second_person",
    "near_share", "log_near", "capitals", "shouted_words", "marks", "mark_runs", "punctuation", "masked", "elongated", "digits", "word_length")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MASK = np.zeros(256, dtype=bool)  # what may stand for a letter, or between two
_MASK[list(b"013457@$*!_.-+#")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_READ = _LOWER.copy()  # digits and symbols as the letters that they look like
_READ[list(b"013457@$!")] = list(b"oieastasi")
_MAYBE_BITS = 20


def _words(data: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of runs of letters, their hashes, and the hashes of their beginnings (0 where a word is shorter)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    spaces = np.where(letter, data, np.uint8(32))
    whole = shingles.word_hashes([spaces.tobytes()])[0]
    low = np.concatenate((_LOWER[spaces], np.zeros(8, np.uint8))).astype(np.uint64)
    stems, packed = [], np.zeros(len(starts), dtype=np.uint64)
    for k in range(max(STEMS)):
        packed = packed * _U(256) + low[starts + k]
        if k + 1 in STEMS:
            stems.append(np.where(ends - starts > k + 1, shingles.mix(packed + (_U(k + 1) << _U(56))), _U(0)))
    return starts, ends, whole, stems


_SECOND = np.sort(shingles.word_hashes([" ".join(SECOND_PERSON).encode()])[0])


@dataclass
class Lexicon:
    """Hashes of words and beginnings of words with their weights."""

    keys: np.ndarray
    weights: np.ndarray
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        self.maybe = np.zeros(1 << _MAYBE_BITS, dtype=bool)
        self.maybe[(self.keys >> _U(64 - _MAYBE_BITS)).astype(np.int64)] = True

    def weigh(self, whole: np.ndarray, stems: Sequence[np.ndarray]) -> np.ndarray:
        """The greatest weight of each word and its beginnings, 0 where none is listed."""
        out = np.zeros(len(whole))
        if len(self.keys):
            for h in (whole, *stems):
                at = np.flatnonzero(self.maybe[(h >> _U(64 - _MAYBE_BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
                out[at] = np.maximum(out[at], np.where(self.keys[place] == h[at], self.weights[place], 0.0))
        return out


def _cut(texts: Sequence[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about a megabyte; a longer text in pieces, cut at spaces where it has any."""
    owner: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = min(at + PIECE_BYTES, len(t))
            if end < len(t):
                end = max(t.rfind(b" ", at + 1, end), t.rfind(b"\n", at + 1, end)) + 1 or end
            owner.append(i)
            held.append(t[at:end])
            size += end - at
            if size >= PIECE_BYTES:
                yield owner, held
                owner, held, size = [], [], 0
            at = end
            if at >= len(t):
                break
    if held:
        yield owner, held


def tokens(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """The distinct hashes of words and of beginnings of words of each text, as they would stand in a lexicon."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for owner, held in _cut(texts):
        for i, piece in zip(owner, held, strict=True):
            data = np.frombuffer(piece, dtype=np.uint8)
            _, _, whole, stems = _words(data, _LETTER[data])
            found[i].append(np.unique(np.concatenate((whole, *stems))))
    for parts in found:
        keys = np.unique(np.concatenate(parts))
        yield keys[keys != 0]


def _masked(letter: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One or two masking characters between letters."""
    def at(kind: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(kind), dtype=bool)
        out[max(0, -by) : len(kind) - max(0, by)] = kind[max(0, by) : len(kind) + min(0, by)]
        return out

    first, last = at(letter, -1), at(letter, 1)
    return mask & ((first & last) | (first & at(mask, 1) & at(letter, 2)) | (last & at(mask, -1) & at(letter, -2)))


def features(texts: Sequence[bytes], lexicon: Lexicon) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    n = len(texts)
    sums = {k: np.zeros(n) for k in ("words", "hits", "weight", "greatest", "strong", "extra", "second", "near", "letters", "upper", "shouted", "marks", "mark_runs", "punctuation", "masked", "long", "digits", "chars")}
    for owner, held in _cut(texts):
        who = np.array(owner)
        data = np.frombuffer(b" ".join(held) + b" ", dtype=np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in held])))

        def add(name: str, places: np.ndarray, weights: np.ndarray | None = None, who: np.ndarray = who, begins: np.ndarray = begins) -> None:
            at = np.searchsorted(begins, places, side="right") - 1
            sums[name] += np.bincount(who[at], weights=weights, minlength=n)

        def share(name: str, kind: np.ndarray, who: np.ndarray = who, begins: np.ndarray = begins) -> None:
            total = np.concatenate(([0], np.cumsum(kind, dtype=np.int64)))
            sums[name] += np.bincount(who, weights=total[begins[1:]] - total[begins[:-1]], minlength=n)

        letter = _LETTER[data]
        upper, mark = _UPPER[data], _MARK[data]
        share("letters", letter)
        share("upper", upper)
        share("marks", mark)
        share("punctuation", _PUNCTUATION[data])
        share("digits", _DIGIT[data])
        share("chars", data > 32)
        add("mark_runs", np.flatnonzero(mark[1:] & mark[:-1]))
        inside = np.flatnonzero(_masked(letter, _MASK[data]))
        add("masked", inside)
        low = _LOWER[data]
        add("long", np.flatnonzero(letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])))
        starts, ends, whole, stems = _words(data, letter)
        add("words", starts)
        raised = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
        add("shouted", starts[(raised[ends] - raised[starts] == ends - starts) & (ends - starts > 1)])
        weight = lexicon.weigh(whole, stems)
        hit = np.flatnonzero(weight > 0)
        add("hits", starts[hit])
        add("weight", starts[hit], weight[hit])
        add("strong", starts[hit][weight[hit] >= 3])
        piece = np.searchsorted(begins, starts, side="right") - 1
        np.maximum.at(sums["greatest"], who[piece[hit]], weight[hit])
        second = np.flatnonzero(np.isin(whole, _SECOND))
        add("second", starts[second])
        if len(second) and len(hit):
            place = np.searchsorted(second, hit)
            before, after = second[np.maximum(place - 1, 0)], second[np.minimum(place, len(second) - 1)]
            near = ((np.abs(hit - before) <= NEAR_WORDS) & (piece[before] == piece[hit])) | ((np.abs(after - hit) <= NEAR_WORDS) & (piece[after] == piece[hit]))
            add("near", starts[hit[near]])
        if len(inside):  # symbols next to letters read as letters, or left out
            read = _READ[data]
            dropped = np.zeros(len(data), dtype=bool)
            dropped[inside] = ~_LETTER[read[inside]]
            kept = np.flatnonzero(~dropped)
            again, _, whole, stems = _words(read[kept], _LETTER[read[kept]])
            found = np.flatnonzero(lexicon.weigh(whole, stems) > 0)
            add("extra", kept[again[found]])
    words = np.maximum(sums["words"], 1)
    hits, letters, chars = sums["hits"], np.maximum(sums["letters"], 1), np.maximum(sums["chars"], 1)
    extra = np.maximum(sums["extra"] - np.where(sums["masked"] > 0, hits, sums["extra"]), 0)
    return np.column_stack([
        np.log1p(sums["words"]), hits / words, sums["weight"] / words, np.log1p(hits), np.log1p(sums["weight"]), sums["greatest"], np.log1p(sums["strong"]),
        np.log1p(extra), sums["second"] / words, sums["near"] / np.maximum(hits, 1), np.log1p(sums["near"]), sums["upper"] / letters, sums["shouted"] / words,
        sums["marks"] / chars, sums["mark_runs"] / words, sums["punctuation"] / chars, sums["masked"] / words, sums["long"] / words, sums["digits"] / chars, sums["letters"] / words])


@dataclass
class Trees:
    """Boosted trees of equal depth; node k has the children 2 k + 1 and 2 k + 2, and values at the leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, step: float = STEP, ridge: float = 1.0) -> Trees:
    """Trees for the logistic loss, grown level by level over histograms of quantile bins."""
    w = w / w.mean()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = float(np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    inner = (1 << DEPTH) - 1
    score = np.full(len(x), base)
    all_f, all_c, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h = w * (y - p), w * p * (1 - p)
        if h.sum() < 1e-3:
            break
        node = np.zeros(len(x), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            here = node - first
            best = np.full(count, 1e-6)
            for j in range(x.shape[1]):
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                cell = here * size + binned[:, j]
                gs = np.bincount(cell, weights=g, minlength=count * size).reshape(count, size)
                hs = np.bincount(cell, weights=h, minlength=count * size).reshape(count, size)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                g_all, h_all = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (g_all - gl) ** 2 / (h_all - hl + ridge) - g_all**2 / (h_all + ridge)
                gain[(hl < 1e-2) | (h_all - hl < 1e-2)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better], cut[first + better] = j, edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        value = step * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        score = score + value[leaf]
        all_f.append(feature), all_c.append(cut), all_v.append(value)
    empty = np.zeros((0, inner))
    return Trees(base, np.array(all_f) if all_f else empty.astype(np.int64), np.array(all_c) if all_c else empty, np.array(all_v) if all_v else np.zeros((0, inner + 1)))


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores and the non-descending shares that fit ``y`` best there, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    at, first = np.unique(raw[order], return_index=True)
    weight = np.add.reduceat(w[order], first)
    mean = np.add.reduceat((w * y)[order], first) / weight
    blocks: list[list[float]] = []  # mean, weight, first and last score
    for x, m, k in zip(at.tolist(), mean.tolist(), weight.tolist(), strict=True):
        blocks.append([m, k, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, k2, _, last = blocks.pop()
            m1, k1, low, _ = blocks.pop()
            blocks.append([(m1 * k1 + m2 * k2) / (k1 + k2), k1 + k2, low, last])
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    share: np.ndarray

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(features(texts, self.lexicon)), self.at, self.share), 0.0, 1.0)


def lexicon_of(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Lexicon:
    """Entries that toxic texts have clearly more often, weighted by the logarithm of how much."""
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    clear = weight >= CLEAR * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    use = clear & (toxic >= min(LEAST_TEXTS, max(1, n_toxic // 4))) & (weight >= 1)
    return Lexicon(keys[use], np.minimum(weight[use], 8.0))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, fold, toxic, clean``: texts that have each token, added up within the task."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (fold, toxic), found in held.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            zero = np.zeros(len(keys), dtype=np.int64)
            yield pa.record_batch({
                "key": keys.view(np.int64), "fold": np.full(len(keys), fold, dtype=np.int32),
                "toxic": n.astype(np.int64) if toxic else zero, "clean": zero if toxic else n.astype(np.int64)})
        held.clear()

    size = 0
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        labels, folds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in shingles.batches(texts):
            for i, keys in enumerate(tokens(texts[a:b]), a):
                held.setdefault((folds[i], labels[i]), []).append(keys)
                size += len(keys)
            if size >= 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model | float:
    """Fit on a sample of the labelled documents; with one label only, its share (0 without any).

    ``labels`` has the id and an integer label; a document is toxic if one of its labels says so,
    and a text if one of its documents is.
    """
    spark = documents.sparkSession
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(id_column).agg((F.max(label) > 0).cast("int").alias("toxic"))
    known = materialise(known)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    rate = {k: min(1.0, train_rows / 2 / n) for k, n in sizes.items()}
    cut = F.when(F.col("toxic") == 1, int((1 << 30) * rate[1])).otherwise(int((1 << 30) * rate[0]))
    ids = bounded(known.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < cut).withColumnRenamed(id_column, "__id"))
    texts = documents.select(F.col(id_column).alias("__of"), text_of(text).alias("text"))
    sample = texts.join(ids, F.col("__of") == F.col("__id")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = materialise(sample.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))
    have = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}  # two rows a fold
    n = np.array([[have.get((f, t), 0) for t in (1, 0)] for f in range(FOLDS)])
    if not n.sum(axis=0).all():
        return float(n[:, 0].sum() > 0)

    found = sample.mapInArrow(_counting, "key long, fold int, toxic long, clean long").groupBy("key").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"),
        *[F.sum(F.when(F.col("fold") == f, F.col(k)).otherwise(0)).alias(f"{k}{f}") for f in range(FOLDS) for k in ("toxic", "clean")])
    n_toxic, n_clean = (int(v) for v in n.sum(axis=0))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    clear = weight / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    top = found.where((F.col("t") >= min(LEAST_TEXTS, max(1, n_toxic // 4))) & (weight >= 1)).orderBy(clear.desc(), "key").limit(LEXICON).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    t, c = top.column("t").to_numpy(), top.column("c").to_numpy()
    others = [lexicon_of(keys, t - top.column(f"toxic{f}").to_numpy(), c - top.column(f"clean{f}").to_numpy(), n_toxic - int(n[f, 0]), n_clean - int(n[f, 1])) for f in range(FOLDS)]
    sent = spark.sparkContext.broadcast(others)  # at most LEXICON entries each

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column(0).cast(pa.binary()).to_pylist(), np.array(batch.column(2).to_pylist())
            for f in range(FOLDS):
                at = np.flatnonzero(folds == f)
                for a, b in shingles.batches([texts[i] for i in at]):
                    rows = features([texts[i] for i in at[a:b]], sent.value[f])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array(at[a:b])), pa.array(np.full(b - a, f, dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    rows = sample.mapInArrow(measure, "toxic int, fold int, x array<double>").toArrow()  # about train_rows rows of numbers
    y, fold = rows.column("toxic").to_numpy().astype(float), rows.column("fold").to_numpy()
    x = rows.column("x").combine_chunks().values.to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T, y, fold))  # the same fit whatever order rows come in
    x, y, fold = x[order], y[order], fold[order]
    w = np.where(y == 1, 1 / rate[1], 1 / rate[0])  # the labels' own shares
    raw = np.full(len(y), np.nan)
    for f in range(FOLDS):
        learn = fold != f
        if 0 < y[learn].sum() < learn.sum():
            raw[~learn] = boost(x[learn], y[learn], w[learn]).raw(x[~learn])
    trees = boost(x, y, w)
    seen = ~np.isnan(raw)
    if not seen.any():
        raw, seen = trees.raw(x), np.ones(len(y), dtype=bool)
    at, share = isotonic(raw[seen], y[seen], w[seen])
    return Model(lexicon_of(keys, t, c, n_toxic, n_clean), trees, at, share)


def scored(documents: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """``row, score`` (the chance that the text is toxic) for every row.

    Defined cases: a null text is an empty one, and has the score of a text without words; where
    labels of one kind only were learnt, every row has their share; repeated rows are scored
    each time; extra columns stay inside ``row``; an empty table gives an empty result.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text])
    packed = documents.select(own.alias("row"), text_of(text).alias("__text"))
    schema = packed.select("row").limit(0).withColumn("score", F.lit(0.0)).schema
    sent = documents.sparkSession.sparkContext.broadcast(model)  # lexicon and trees: below a megabyte but for a bit map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in shingles.batches(texts):
                score = np.full(b - a, m) if isinstance(m, float) else m.scores(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64())], names=["row", "score"])

    return packed.mapInArrow(run, schema)


@query()
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that each document is toxic; learnt from those whose crc32 of the id does not leave 2 modulo 4."""
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = train(documents.where(~held_out), labels.where(~held_out))
    found = scored(documents, model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
