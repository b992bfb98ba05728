"""Similarity join of documents on their sets of word shingles, by prefix trees.

Two sets link when their Jaccard similarity is at least 4/5.  Steps, each on
what the one before left over:

1. One pass turns texts into shingle sets.  Equal sets are one set from here on.
2. A set that links with another shares with it the first of their common
   shingles in hash order, which lie in the first two fifths of either set.  The
   shingles of that part are counted over all sets, packed in blocks by hash range;
   a set stays if as many of them occur elsewhere as a link would need.  Those that
   stay are counted in the same way by all their shingles.
3. For the sets that still stay, shingles are counted exactly and ordered globally from
   rare to frequent.  Two sets that link share a shingle of their prefixes in that
   order; connecting sets over such shingles gives groups that no link leaves.
4. Each group becomes a prefix tree: sets are paths of shingles in global order,
   equal beginnings are stored once.  A set walks the tree before it is added, adds
   up overlaps on the way, and leaves a subtree when even all remaining shingles
   would be too few, or when the whole subtree is already connected with it.
   Groups too large for one task are cut into blocks that meet pairwise, except
   blocks that earlier links have already made one component.
5. Links are joined to components.

No step has a cap: groups, prefixes and candidates are complete at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import shingles
from foldwise.llm.common import materialise, table, text_of
from foldwise.llm.components import components
from foldwise.llm.registry import query
from foldwise.operators.ordering import ranked
from foldwise.session import bounded

FLUSH_SHINGLES = 1_000_000  # shingles a task holds before it sends its blocks, at least
PART_SHINGLES = 2_000_000  # shingles one counting task takes
BLOCK_SHINGLES = 32  # shingles that a task holds for each hash range before it sends its blocks, at least
BLOCK_SETS = 2_000  # sets one tree holds
SPARE_BITS = 12  # a counted shingle has this many bits more than all of them together need

_BLOCK = "part int, nodes binary, lens binary, tokens binary, everywhere binary, sure binary, credits binary"


def _need(n: int) -> int:
    """Overlap with any set that links with one of ``n`` shingles, at least."""
    return -(-4 * n // 5)


def _lead(n: int) -> int:
    """How many of the first common shingles step 2 looks for."""
    return max(1, n // 5)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


class _Blocks:
    """Shingles of a task's sets by hash range, as short as the corpus allows.

    A shingle found in two sets here is known to be shared: its sets get their credit at
    once and it travels alone, so a shingle costs one entry for each task at most, however
    many sets have it.
    """

    def __init__(self, parts: int, width: int):
        self.parts, self.width = parts, width
        # Blocks hold many shingles however many hash ranges there are, so their number is in proportion to the shingles.
        self.full = max(FLUSH_SHINGLES, BLOCK_SHINGLES * parts)
        self._empty()

    def _empty(self) -> None:
        self.nodes: dict[int, None] = {}
        self.heads: list[np.ndarray] = []
        self.held = 0

    def add(self, node: int, head: np.ndarray) -> None:
        if node not in self.nodes:
            self.nodes[node] = None
            self.heads.append(head)
            self.held += len(head)

    def _short(self, token: np.ndarray) -> bytes:
        """The lower ``width`` bytes of each."""
        return np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.heads:
            return
        nodes = np.fromiter(self.nodes, dtype=np.int64, count=len(self.nodes))
        token = shingles.mix(np.concatenate(self.heads))
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), [len(h) for h in self.heads])
        self._empty()
        order = np.argsort(token)
        placed = token[order]
        same = placed[1:] == placed[:-1]
        many = np.zeros(len(token), dtype=bool)
        many[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        credit = np.bincount(owner[many], minlength=len(nodes))
        shared = np.unique(token[many])
        once, of = token[~many], owner[~many]
        part, shared_part = self._part(once), self._part(shared)
        by = np.argsort(part, kind="stable")
        once, of, part = once[by], of[by], part[by]
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        home = int(nodes[0] % self.parts)  # the block that takes the credits along
        held = np.bincount(shared_part, minlength=self.parts)
        rows = []
        for p in range(self.parts):
            a, b = cuts[p], cuts[p + 1]
            who, lens = np.unique(of[a:b], return_counts=True)
            sure = np.flatnonzero(credit) if p == home else np.zeros(0, dtype=np.int64)
            if a == b and not len(sure) and not held[p]:
                continue
            rows.append((
                p, nodes[who].tobytes(), lens.astype(np.int32).tobytes(), self._short(once[a:b]), self._short(shared[shared_part == p]),
                nodes[sure].tobytes(), credit[sure].astype(np.int32).tobytes()))
        names = ["part", "nodes", "lens", "tokens", "everywhere", "sure", "credits"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    def _part(self, token: np.ndarray) -> np.ndarray:
        return ((token >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int32)


def _documents(kind: pa.DataType):
    """Of every document: what names it, its number of shingles and the signature of their set."""
    doc = pa.struct([("absent", pa.bool_()), ("id", kind), ("key", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in shingles.batches(texts):
                found = [(len(s), _signature(s) if len(s) else None) for s in shingles.shingle_sets(texts[a:b])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).cast(doc), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary()),
                    pa.array([None if x is None else _node(x) for _, x in found], pa.int64())], names=["doc", "n", "sig", "node"])

    return run


def _text_blocks(parts: int, width: int):
    """Blocks of the leading shingles of texts."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(parts, width)
        for batch in incoming:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in shingles.batches(texts):
                for s in shingles.shingle_sets(texts[a:b]):
                    if len(s):
                        blocks.add(_node(_signature(s)), s[: len(s) - _need(len(s)) + _lead(len(s))])
                if blocks.held >= blocks.full:
                    yield from blocks.flush()
        yield from blocks.flush()

    return run


def _set_blocks(parts: int, width: int):
    """Blocks of all shingles of sets (node, tokens)."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(parts, width)
        for batch in incoming:
            tokens = batch.column(1)
            ends, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
            for node, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                blocks.add(node, flat[a:b])
                if blocks.held >= blocks.full:
                    yield from blocks.flush()
        yield from blocks.flush()

    return run


def _counting(width: int):
    def long(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // width, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
        return wide.view(np.uint64).ravel()

    def count(blocks: pa.Table) -> pa.Table:
        """Of one hash range: for each set, how many of its shingles some other set has too."""
        join = lambda name: b"".join(blocks.column(name).to_pylist())
        tokens, everywhere = long(join("tokens")), np.unique(long(join("everywhere")))
        owner = np.repeat(np.frombuffer(join("nodes"), np.int64), np.frombuffer(join("lens"), np.int32))
        order = np.argsort(tokens)
        placed = tokens[order]
        same = placed[1:] == placed[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) | np.isin(placed, everywhere) if len(tokens) else np.zeros(0, bool)
        node, n = np.unique(owner[order[shared]], return_counts=True)
        sure, credits = np.frombuffer(join("sure"), np.int64), np.frombuffer(join("credits"), np.int32)
        return pa.table({"node": np.concatenate((node, sure)), "n": np.concatenate((n, credits)).astype(np.int64)})

    return count


def _credits(rows: DataFrame, work, total: int) -> DataFrame:
    """``node, credit``: shingles of each set that others have, over the about ``total`` shingles that ``work`` cuts from rows."""
    parts = 12 + total // PART_SHINGLES
    width = min(8, (max(total, 2).bit_length() + SPARE_BITS + 7) // 8)
    found = rows.mapInArrow(work(parts, width), _BLOCK).groupBy("part").applyInArrow(_counting(width), "node long, n long")
    return found.groupBy("node").agg(F.sum("n").alias("credit"))


def _sets(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for a, b in shingles.batches(texts):
            sets = list(shingles.shingle_sets(texts[a:b]))
            yield pa.record_batch({
                "sig": pa.array([_signature(s) for s in sets], pa.binary()),
                "tokens": pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))})


class _Branch:
    """A run of shingles shared by all sets below it."""

    __slots__ = ("ends", "kids", "least_n", "mixed", "run", "some", "tail")

    def __init__(self, run: np.ndarray, tail: int, n: int, some: int):
        self.run, self.tail, self.least_n, self.some = run, tail, n, some
        self.kids: dict[int, _Branch] = {}
        self.ends: list[int] = []
        self.mixed = False


class PrefixTree:
    """Sets as paths of ascending integers; finds one link to each component a new set links with."""

    def __init__(self, universe: int, sizes: np.ndarray, roots: np.ndarray | None = None):
        self.sizes = sizes
        self.up = list(range(len(sizes)))
        if roots is not None:  # components known before
            first: dict[int, int] = {}
            self.up = [first.setdefault(r, i) for i, r in enumerate(roots.tolist())]
        self.has = np.zeros(universe, dtype=bool)
        self.top = _Branch(np.zeros(0, np.int64), 0, 1 << 62, -1)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, i: int, path: np.ndarray) -> None:
        self._link(i, path)
        self._store(i, path)

    def _link(self, i: int, path: np.ndarray) -> None:
        n, has, sizes = int(self.sizes[i]), self.has, self.sizes
        has[path] = True
        stack = [(self.top, 0)]
        while stack:
            branch, overlap = stack.pop()
            if branch.some >= 0 and not branch.mixed and self.find(branch.some) == self.find(i):
                continue
            run = branch.run
            left = len(path)
            if len(run):
                overlap += int(np.count_nonzero(has[run]))
                left -= int(np.searchsorted(path, run[-1], side="right"))
            if 9 * (overlap + min(left, branch.tail)) < 4 * (n + branch.least_n):
                continue
            for j in branch.ends:
                if 9 * overlap >= 4 * (n + int(sizes[j])) and self.find(j) != self.find(i):
                    self.links.append((i, j))
                    self.up[self.find(i)] = self.find(j)
            stack.extend((kid, overlap) for kid in branch.kids.values())
        has[path] = False

    def _store(self, i: int, path: np.ndarray) -> None:
        n, at, branch = int(self.sizes[i]), 0, self.top
        while True:
            branch.least_n = min(branch.least_n, n)
            branch.tail = max(branch.tail, len(path) - at)
            if branch.some < 0:
                branch.some = i
            elif not branch.mixed and self.find(branch.some) != self.find(i):
                branch.mixed = True
            if at == len(path):
                branch.ends.append(i)
                return
            kid = branch.kids.get(int(path[at]))
            if kid is None:
                new = _Branch(path[at:], 0, n, i)
                new.ends.append(i)
                branch.kids[int(path[at])] = new
                return
            m = min(len(kid.run), len(path) - at)
            differ = np.flatnonzero(kid.run[:m] != path[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.run):  # part the run where the paths do
                upper = _Branch(kid.run[:same], kid.tail + len(kid.run) - same, kid.least_n, kid.some)
                upper.mixed = kid.mixed
                kid.run = kid.run[same:]
                upper.kids[int(kid.run[0])] = kid
                branch.kids[int(path[at])] = upper
                kid = upper
            at += same
            branch = kid


def _name(id_column: str, text: str) -> Column:
    """What names a row and orders rows: the id, nulls last, then a hash of the text."""
    return F.struct(F.col(id_column).isNull().alias("absent"), F.col(id_column).alias("id"), F.xxhash64(text_of(text)).alias("key"))


def _tree_links(group: pa.Table) -> pa.Table:
    """Links that connect the sets of a group: a forest, not all pairs."""
    nodes = group.column("node").to_numpy()
    counts = group.column("shared").combine_chunks()
    ends = counts.offsets.to_numpy()
    flat = counts.values
    token, seen = flat.field("t").to_numpy(), flat.field("c").to_numpy()
    known, which = np.unique(token, return_inverse=True)
    frequency = np.zeros(len(known), dtype=np.int64)
    frequency[which] = seen
    rank = np.empty(len(known), dtype=np.int64)
    rank[np.lexsort((known, frequency))] = np.arange(len(known))
    paths = rank[which]
    tree = PrefixTree(len(known), group.column("n").to_numpy(), group.column("root").to_numpy())
    for i in range(len(nodes)):
        tree.add(i, np.sort(paths[ends[i] : ends[i + 1]]))
    a, b = (np.array(x, dtype=np.int64) for x in (zip(*tree.links, strict=True) if tree.links else ((), ())))
    return pa.table({"a": nodes[a], "b": nodes[b]})


def _join(groups: DataFrame, *by: str) -> DataFrame:
    return groups.select(*by, "node", "n", "root", "shared").groupBy(*by).applyInArrow(_tree_links, "a long, b long")


def _relabel(sets: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return sets.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _large_groups(sets: DataFrame, sizes: DataFrame, block_sets: int) -> DataFrame:
    """Links of groups too large for one tree: blocks first, then blocks in pairs unless both are of one component."""
    sets = sets.join(sizes, "grp")
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("n_sets") / block_sets)).alias("block")
    links = materialise(_join(sets.select("*", cut), "grp", "block"))
    heads = _relabel(sets, links).where("node = root").drop("n_sets")
    heads = heads.join(heads.groupBy("grp").agg(F.count(F.lit(1)).alias("n_sets")), "grp")
    links = materialise(links.unionByName(_join(heads.select("*", cut), "grp", "block")))
    sets = _relabel(sets, links)
    order = ranked(materialise(sets.select("grp", "root", "node")), ["grp"], [F.col("root"), F.col("node")], "at")
    order = order.select("grp", "node", F.floor((F.col("at") - 1) / block_sets).alias("block"))
    sets = materialise(sets.join(order, ["grp", "node"]))
    blocks = sets.groupBy("grp", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    right = blocks.select("grp", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = blocks.join(right, "grp").where("block <= other AND NOT (low = high AND low = low2 AND low2 = high2)").select("grp", "block", "other")
    meet = materialise(meet)
    once = meet.select("grp", "block", F.struct("block", "other").alias("pair"))
    again = meet.where("block < other").select("grp", F.col("other").alias("block"), F.struct("block", "other").alias("pair"))
    return links.unionByName(_join(sets.join(once.unionByName(again), ["grp", "block"]), "grp", "pair"))


def classes(documents: DataFrame, id_column: str, text: str, block_sets: int) -> DataFrame:
    """``doc, n, head`` for every row: what names the row, its number of shingles, and the least row of its component."""
    kind = documents.schema[id_column].dataType.simpleString()
    arrow = documents.select(id_column).limit(0).toArrow().schema.field(0).type
    keyed = documents.select(_name(id_column, text).alias("doc"), text_of(text).alias("text"))
    rows = materialise(keyed.mapInArrow(_documents(arrow), f"doc struct<absent:boolean,id:{kind},key:bigint>, n long, sig binary, node long"))
    sets = materialise(rows.where("n > 0").groupBy("sig").agg(
        F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("node").alias("node"), F.count(F.lit(1)).alias("n_rows")))

    total = rows.agg(F.sum(F.col("n") * 2 / 5 + 1).cast("long")).first()[0] or 0
    leads = _credits(documents.select(text_of(text).alias("text")), _text_blocks, total)
    # A set that links with one of n shingles has at least 4/5 n of them, so looks for at least this many.
    least = F.greatest(F.floor(F.ceil(F.col("n") * 4 / 5) / 5), F.lit(1))
    alive = materialise(sets.join(leads, "node").where(F.col("credit") >= least).select("sig", "node", "n", "doc"))

    wanted = bounded(alive.select(F.col("doc.id").alias("__id"), F.col("doc.key").alias("__key")))
    named = keyed.select(F.col("doc.id").alias("__id2"), F.col("doc.key").alias("__key2"), "text")
    texts = named.join(wanted, (F.col("__key2") == F.col("__key")) & F.col("__id2").eqNullSafe(F.col("__id")), "left_semi")
    whole = texts.select("text").mapInArrow(_sets, "sig binary, tokens array<long>").dropDuplicates(["sig"])
    whole = materialise(whole.join(alive.select("sig", "node", "n"), "sig").select("node", "n", "tokens"))
    total = whole.agg(F.sum("n")).first()[0] or 0
    shares = _credits(whole.select("node", "tokens"), _set_blocks, total)
    whole = materialise(whole.join(shares, "node").where(F.col("credit") >= F.ceil(F.col("n") * 4 / 5)).drop("credit"))

    tokens = whole.select("node", "n", F.explode("tokens").alias("t"))
    seen = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tokens.join(seen, "t").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.size("shared"))
    ordered = shared.withColumn("prefix", prefix.cast("int")).where("prefix > 0")
    ordered = materialise(ordered.select("node", "n", "shared", "prefix"))

    leads = ordered.select("node", F.explode(F.slice("shared.t", F.lit(1), F.col("prefix"))).alias("t"))
    stars = leads.groupBy("t").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m <> x").select(F.col("t").alias("t2"), "m")
    edges = leads.join(stars, F.col("t") == F.col("t2")).select(F.col("node").alias("a"), F.col("m").alias("b"))
    groups = components(edges).select("node", F.col("root").alias("grp"))

    grouped = materialise(ordered.join(groups, "node").select("grp", "node", "n", F.col("node").alias("root"), "shared"))
    sizes = materialise(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n_sets")))
    large = sizes.where(F.col("n_sets") > block_sets)
    links = _join(grouped.join(large, "grp", "left_anti"), "grp")
    if large.count():
        links = links.unionByName(_large_groups(grouped, large, block_sets))
    linked = components(links)

    several = sets.join(linked, "node", "left").where("n_rows > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    several = several.join(several.groupBy("root").agg(F.min("doc").alias("head")), "root").select("sig", "head")
    return rows.select("doc", "n", "sig").join(several, "sig", "left").select("doc", "n", F.coalesce("head", "doc").alias("head"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """``id, n_shingles, component_id`` for every row.

    The component id is the least id among all rows that links reach, the row's
    own included.  Defined cases: a null or empty text has no shingles and links
    with nothing; equal texts are always one component; a null id is null in the
    result unless links reach a row with an id; repeated rows come out repeated;
    columns other than the two named ones are ignored.
    """
    found = classes(documents, id_column, text, block_sets)
    return found.select(F.col("doc.id").alias("id"), F.col("n").cast("long").alias("n_shingles"), F.col("head.id").alias("component_id"))


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row of each component, that of the least id, with all its columns.

    Defined cases: a null or empty text, or one without words, links with nothing, so all such rows stay, repeated
    ones too; of rows with the same id and text one stays; a null id comes after all others; extra columns
    come back as they were; an empty table gives an empty result.
    """
    own = documents.columns
    found = classes(documents, id_column, text, block_sets)
    heads = found.where("doc = head OR n = 0").groupBy("doc").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    heads = materialise(heads.select(F.col("doc.id").alias("id"), F.col("doc.key").alias("key"), "times", "n"))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_column).alias("id2"), F.xxhash64(text_of(text)).alias("key2"))

    def of(some: DataFrame) -> DataFrame:
        return packed.join(some, (F.col("key2") == F.col("key")) & F.col("id2").eqNullSafe(F.col("id")), "left_semi")

    repeated = F.expr("times > 1 AND n > 0")
    kept = of(heads.where(~repeated)).select("row.*")
    if heads.where(repeated).limit(1).count():  # one row of those with the same id and text
        kept = kept.unionByName(of(heads.where(repeated)).dropDuplicates(["id2", "key2"]).select("row.*"))
    return kept


@query()
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 5-word shingle sets with similarity 4/5 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")
