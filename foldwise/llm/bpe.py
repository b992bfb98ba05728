"""Byte-pair encoding with word ends, and decoding, over whole texts.

A short word is one contiguous array of parts beside an array of ranks, where
``ranks[i]`` is the merge rank of parts i and i+1.  Encoding scans the ranks for
the least (leftmost first), joins the two parts, deletes the boundary and looks up
only the two neighbouring ranks again.  The few words of very many parts keep the
same ranks in a heap over a linked list instead, as scans would take quadratic time;
both give the same parts.

The vocabulary file is read on the driver and sent to the tasks once; every task
process keeps a bounded table of what it has already encoded.

Letters and digits that Unicode added in version 16 or later may be classed otherwise
than by other encoders of the same file; the result still decodes to itself.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table, text_of
from foldwise.llm.registry import query

SCAN_PARTS = 256  # above this many parts a word is merged by heap
CACHED_WORDS = 400_000
BATCH_BYTES = 2 << 20

# Fixed by the vocabulary file's own description: its word pattern and word end.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_SPACES = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = token
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.word = regex.compile(WORD)
        # Longer special tokens first, so that none is taken for the start of another.
        named = sorted(self.special, key=len, reverse=True)
        self.parting = regex.compile("(" + "|".join(regex.escape(s) for s in named) + ")") if named else None
        self.known: dict[str, bytes] = {}

    def _scan(self, parts: list[int]) -> list[int]:
        merge, none = self.merge, (_NEVER, 0)
        found = [merge.get(pair, none) for pair in zip(parts, parts[1:])]  # noqa: B905
        ranks = [f[0] for f in found]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            parts[i] = merge[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merge.get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = merge.get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        merge, n = self.merge, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := merge.get((parts[i], parts[j]))):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = joined, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        data = word.encode()
        inner = self.inner
        parts = [inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        parts = self._scan(parts) if len(parts) <= SCAN_PARTS else self._heap(parts)
        return np.array(parts, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; words never reach beyond one."""
        ids = b"".join([self.encode_word(w) for w in self.word.findall(chunk)])
        if len(chunk) < 64:
            self.known[chunk] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower-casing is by character: a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, text = self.known, text.lower()
        # str.split also parts at four control characters that are not white space here.
        chunks = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        if len(known) > CACHED_WORDS:
            known.clear()
        return b"".join([known[c] if c in known else self._chunk(c) for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; a special token's string is that token."""
        if self.parting is None or not self.parting.search(text):
            return self._plain(text)
        parts = self.parting.split(text)
        return b"".join(
            np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The tokens in order, parted by one space, special ones included."""
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_loaded: dict[int, WordBpe] = {}


class _Sent:
    """A vocabulary file on its way to the tasks; each task process builds it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = spark.sparkContext.broadcast(f.read())

    def get(self) -> WordBpe:
        key = hash(self.source.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = WordBpe(self.source.value)
        return _loaded[key]


def _map(df: DataFrame, path: str, column: str, made: dict[str, str], work: Callable[[WordBpe, object], tuple]) -> DataFrame:
    """Add the columns ``made`` (name to type), which ``work`` gives for each value of ``column``, a few megabytes at a time."""
    sent = _Sent(df.sparkSession, path)
    schema = df.limit(0).withColumns({name: F.lit(None).cast(kind) for name, kind in made.items()}).schema
    kinds = [pa.binary() if kind == "binary" else pa.string() for kind in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.get()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            lengths = pc.binary_length(values).to_numpy(zero_copy_only=False)
            cuts = np.unique(np.cumsum(lengths) // BATCH_BYTES, return_index=True)[1].tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                rows = [work(bpe, v) for v in values.slice(a, b - a).to_pylist()]
                new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *made])

    return df.mapInArrow(run, schema)


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the tokens of every whole text as little-endian 32-bit integers in one binary.

    ``path`` is a vocabulary file that the driver can read.  A null text counts as
    empty and has no tokens.  Repeated rows, empty tables and any other columns pass
    through; an existing column named ``ids`` is replaced.
    """
    filled = df.drop(ids).withColumn(text, text_of(text))
    return _map(filled, path, text, {ids: "binary"}, lambda bpe, t: (bpe.encode(t),))


def decode_documents(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, the text of the tokens in ``ids``; null ids count as none."""
    filled = df.drop(decoded).withColumn(ids, F.coalesce(ids, F.lit(b"")))
    return _map(filled, path, ids, {decoded: "string"}, lambda bpe, i: (bpe.decode(i),))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Encode every whole text and decode its tokens again, in one pass over the rows."""

    def both(bpe: WordBpe, t: str) -> tuple:
        made = bpe.encode(t)
        return made, bpe.decode(made)

    filled = df.drop(ids, decoded).withColumn(text, text_of(text))
    return _map(filled, path, text, {ids: "binary", decoded: "string"}, both)


def n_tokens(ids: str = "ids") -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def vocabulary_path() -> str:
    """The vocabulary the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of the text decoded from them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(documents, vocabulary_path()).select(
        "doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
