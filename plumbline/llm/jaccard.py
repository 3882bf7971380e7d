"""N-gram Jaccard join: token-combination prefixes.

A document is the set of its five-word shingles. Under one global order (rare shingles
first) two sets that reach the threshold share, within prefixes just long enough, one rare
shingle or k = 2 frequent ones of one class: were fewer shared in each class, more of a
prefix would be missing from the other set than the threshold allows. So rare shingles
are indexed alone, frequent ones in pairs of a class, and the prefix is extended by one
shingle for each class that it enters. Classes are as many as suit the size of a set;
sets near the border of two size tiers are indexed in both. Frequency comes from a sketch
of fixed size over all shingles of all documents: its errors cost selectivity, no link.

Copies are one node. First each index entry compares its members with one pivot, a linear
number of pairs, and what links is joined into components. Then only members of one entry
in different components are compared: the members of a short entry in pairs, and those of
long entries in blocks. Long entries with one commonest component are a group; who is
outside that component meets all of the group, a block of outsiders and a block of members
in a task. A task keeps a union-find over the components it holds and returns a link only
where it joins two of them, so its output is smaller than its blocks however many links it
sees. The pairs compared in a group grow with outsiders times members, in blocks that grow
with the group up to BLOCKS. No list of members is held in a task beyond SHORT rows or a
block, and no link that could join components is lost.

Sets are made anew from the texts in each pass that needs them: a table of all sets is
larger than the texts, and only a few nodes' sets are ever compared.

Null texts and texts without words have the empty set: n_shingles 0, and they are their
own component. With fewer than five words the whole sequence is the one shingle. Rows
that repeat are copies; ties in frequency are ordered by hash. An empty table gives an
empty result. Columns besides doc_id and text play no part, whatever their names. Set
identity and overlap are judged by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import LOWER, gram_hashes, mix, span_hashes, to_arrow, word_bounds
from plumbline.operators.graph import components
from plumbline.operators.keyed import SMALL, if_small, spread_join
from plumbline.session import cut, importable, shuffles_removed

WORDS = 5
#: Two sets link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
SKETCH_BITS = 20
LEAST_FREQUENT = 64
FIRST_TIER, TIER_GROWTH, TIER_CLASSES = 64, 4, 12
SHORT = 32
#: Least and most members of a block, and blocks of a group between them.
BLOCKS, PARTS = (128, 512), 16
KEPT_NODES = 50_000
FILTER_BITS = 24
MEMBERS = "doc_id long, n long, node long, chunk long, counts binary"
ENTRIES = "sig long, node long, n long, plain boolean"
SETS = "node long, n long, hashes binary"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word 5-grams, A-Z lower-cased."""
    raw = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    words = span_hashes(raw, *word_bounds(raw))
    return np.unique(gram_hashes(words, min(WORDS, len(words)))) if len(words) else words


def node_of(found: np.ndarray) -> int:
    """A set's identity as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def members(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, node) for each document, and after them the partition's sketch in chunks."""
    arrow, chunk = to_arrow(docs, MEMBERS), 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                np.add.at(sketch, bucket(found), 1)
            empty = [None] * len(sizes)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": sizes, "node": nodes, "chunk": empty, "counts": empty}, schema=arrow)
        parts = [(k, sketch[k * chunk : (k + 1) * chunk]) for k in range(len(sketch) // chunk)]
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in parts if p.any()]
        empty = [None] * len(parts)
        yield pa.RecordBatch.from_pydict({"doc_id": empty, "n": empty, "node": empty, "chunk": [k for k, _ in parts], "counts": [p for _, p in parts]}, schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, MEMBERS)


def add_sketches(table: DataFrame) -> np.ndarray:
    """The partitions' sketches summed, a chunk of fixed size at a time."""
    chunk = 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(k, np.zeros(chunk, np.uint64))
                own += np.frombuffer(zlib.decompress(raw), np.uint32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int64()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    total = np.zeros(1 << SKETCH_BITS, np.uint64)
    chunks = table.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition("chunk")
    for r in chunks.mapInArrow(run, "chunk long, counts binary").collect():
        total[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] += np.frombuffer(r["counts"], np.uint64)
    return total


@dataclass
class Frequency:
    """The sketch: a count for each bucket, and the count from which its shingles are called frequent."""

    counts: np.ndarray
    limit: float

    def of(self, found: np.ndarray) -> np.ndarray:
        return self.counts[bucket(found)].astype(np.int64)


def frequencies(sketch: np.ndarray) -> Frequency:
    """Frequent is what stands far out of the sketch's noise."""
    mean = float(sketch.mean())
    return Frequency(sketch.astype(np.uint64), mean + max(LEAST_FREQUENT, 8 * mean**0.5))


def tiers(n: int) -> list[int]:
    """The size tiers of a set: -1 for the smallest, whose shingles are all indexed alone."""
    out, j, low = [], 0, FIRST_TIER
    if n * THRESHOLD <= low * 100:
        out.append(-1)
    while low <= n:
        if n * THRESHOLD <= low * TIER_GROWTH * 100:
            out.append(j)
        j, low = j + 1, low * TIER_GROWTH
    return out


def prefix_length(n: int) -> int:
    """Shingles of which a linked set must have one, whichever they are."""
    return n - -(-THRESHOLD * n // 100) + 1


def is_plain(found: np.ndarray, frequency: Frequency) -> bool:
    """Does the prefix hold rare shingles only?"""
    return int((frequency.of(found) <= frequency.limit).sum()) >= prefix_length(len(found))


def possible(common: str, n: str, m: str, plain: str) -> F.Column:
    """Can two sets of sizes n and m link when `common` of their index keys agree?

    Where both prefixes are plain, every shared shingle of the prefix that ends first is a
    shared key, and beyond it at most the rest of that set can be shared.
    """
    most = F.ceil(F.greatest(n, m) * THRESHOLD / 100) - 1
    least = F.ceil((F.col(n) + F.col(m)) * THRESHOLD / (100 + THRESHOLD))
    return ~F.col(plain) | (F.col(common) + most >= least)


def signatures(found: np.ndarray, frequency: Frequency) -> np.ndarray:
    """The index keys of one set."""
    n = len(found)
    needed = prefix_length(n)
    counts = frequency.of(found)
    order = np.lexsort((found, counts))  # the global order: by the sketch's count, then by hash
    rare = int((counts <= frequency.limit).sum())
    keys = [found[order[: min(rare, needed)]]]
    missing = needed - rare
    if missing > 0:
        often = found[order[rare:]]
        for tier in tiers(n):
            if tier < 0:
                keys.append(often[:missing])
                continue
            classes = np.uint64(TIER_CLASSES * TIER_GROWTH**tier)
            own = (mix(often) % classes).astype(np.int64)
            first = np.zeros(len(often), bool)
            first[np.unique(own, return_index=True)[1]] = True
            gained = np.cumsum(~first)
            length = int(np.searchsorted(gained, missing)) + 1
            order = np.argsort(own[:length], kind="stable")
            token, kind = often[:length][order], own[:length][order]
            salt = np.uint64(tier + 1)
            for gap in range(1, length):
                same = kind[gap:] == kind[:-gap]
                if not same.any():
                    break
                low, high = np.minimum(token[gap:][same], token[:-gap][same]), np.maximum(token[gap:][same], token[:-gap][same])
                keys.append(mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high + salt)))
    return np.unique(np.concatenate(keys)).view(np.int64)


def entries(docs: DataFrame, frequency: Frequency) -> DataFrame:
    """Index entries (sig, node, n); copies met again in a task are left out."""
    arrow = to_arrow(docs, ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys, nodes, sizes, plain = [], [], [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                if not len(found) or (node := node_of(found)) in done:
                    continue
                if len(done) < KEPT_NODES:
                    done.add(node)
                keys.append(signatures(found, frequency))
                nodes.append(np.full(len(keys[-1]), node))
                sizes.append(np.full(len(keys[-1]), len(found)))
                plain.append(np.full(len(keys[-1]), is_plain(found, frequency)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, sizes, plain)], schema=arrow)

    return docs.select("text").mapInArrow(run, ENTRIES)


def shared(index: DataFrame) -> DataFrame:
    """Entries that two nodes or more share, each with its pivot; a run of equal keys streams by, none is held.

    Within a key, nodes come by size, and a step in size that no linked pair can bridge starts
    a new run: sets on its two sides are further apart than the threshold allows.
    """
    schema = "sig long, pivot long, pivot_n long, pivot_plain boolean, node long, n long, plain boolean"
    arrow = to_arrow(index, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (sig, n, node, the run's pivot, its n and plainness) of the row before
        for batch in batches:
            sig, node, n, plain = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(sig):
                continue
            before = [np.concatenate((c[:1] if last is None else [last[k]], c[:-1])) for k, c in enumerate((sig, n, node))]
            new = (sig != before[0]) | (before[1] * 100 < n * THRESHOLD)
            fresh = new | (node != before[2])
            if last is None:
                new[0] = fresh[0] = True
            head = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            first = [c[head] if last is None else np.where(head < 0, last[3 + k], c[head]) for k, c in enumerate((node, n, plain))]
            last = sig[-1], n[-1], node[-1], *(c[-1] for c in first)
            pivot = first[0]
            keep = fresh & (node != pivot)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (sig, *first, node, n, plain)], schema=arrow)

    return index.repartition("sig").sortWithinPartitions("sig", "n", "node").mapInArrow(run, schema)


def close_in_size(a: str, b: str) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def unpack_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bit map of fixed size that knows each of `nodes`; what else it lets through costs time only."""
    chunk = 1 << 12
    arrow = to_arrow(nodes, "chunk long, counts binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[slot(batch.column(0).to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(bits)
        parts = [(k, packed[k : k + chunk]) for k in range(0, len(packed), chunk)]
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_pydict({"chunk": [k for k, _ in parts], "counts": [p for _, p in parts]}, schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(k, np.zeros(chunk, np.uint8))
                own |= np.frombuffer(zlib.decompress(raw), np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": list(sums), "counts": [v.tobytes() for v in sums.values()]}, schema=arrow)

    packed = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in nodes.mapInArrow(gather, "chunk long, counts binary").repartition("chunk").mapInArrow(fold, "chunk long, counts binary").collect():
        packed[r["chunk"] : r["chunk"] + chunk] |= np.frombuffer(r["counts"], np.uint8)
    return packed


def slot(nodes: np.ndarray) -> np.ndarray:
    return (nodes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def known_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, hashes) of the sets of `nodes`, one row each."""
    wanted = cut(nodes.distinct())
    packed = node_filter(wanted)
    arrow = to_arrow(docs, SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = np.unpackbits(packed).astype(bool), set()
        for batch in batches:
            nodes, sizes, packs = [], [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                if not len(found) or (node := node_of(found)) in done or not bits[slot(np.array([node]))[0]]:
                    continue
                if len(done) < KEPT_NODES:
                    done.add(node)
                nodes.append(node)
                sizes.append(len(found))
                packs.append(found.astype("<u8").tobytes())
            if nodes:
                yield pa.RecordBatch.from_pydict({"node": nodes, "n": sizes, "hashes": packs}, schema=arrow)

    found = docs.select("text").mapInArrow(run, SETS)
    return cut(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def links(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= THRESHOLD * (n + m - overlap)


def looked_up(rows: DataFrame, names: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` with the row of `names` for `key`, which many rows may share: `names` is broadcast if it is small, else the key is salted."""
    stored = cut(names)
    return rows.join(F.broadcast(stored), key, how) if stored.limit(SMALL + 1).count() <= SMALL else spread_join(rows, stored, key, salts(rows), how)


def salts(rows: DataFrame) -> int:
    return math.isqrt(rows.count()) + 1


def verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; a pivot with many pairs is `a`, and its set goes to salted groups of them."""
    salted = pairs.select("a", "b").withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(salts(pairs))))
    right = known.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    left = salted.select("a", "_salt").distinct().join(known.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    both = salted.join(right, "b").join(left, ["a", "_salt"])
    arrow = to_arrow(pairs, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            out = []
            for a, b, raw_left, raw_right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if a != last:
                    last, left = a, unpack_set(raw_left)
                right = unpack_set(raw_right)
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                if links(int((left[at] == right).sum()), len(left), len(right)):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=arrow)

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def short_pairs(rows: DataFrame) -> DataFrame:
    """From (sig, pivot, node, n, plain, root) sorted by sig and pivot: pairs of short runs (pivot null), and members of long ones."""
    schema = "a long, b long, n long, m long, plain boolean, pivot long"
    arrow, most = to_arrow(rows, schema), SHORT

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out, long = None, [], [], False

        def close() -> None:
            if long or len({h[3] for h in held}) < 2:
                return
            for i, (a, n, plain, root) in enumerate(held):
                for b, m, other_plain, other in held[:i]:
                    if root != other and min(n, m) * 100 >= max(n, m) * THRESHOLD:
                        out.append((a, b, n, m, plain and other_plain, None) if a < b else (b, a, m, n, plain and other_plain, None))

        for batch in batches:
            for sig, pivot, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (sig, pivot) != last:
                    close()
                    last, held, long = (sig, pivot), [], False
                if long:
                    out.append((row[0], None, None, None, None, pivot))
                    continue
                held.append(row)
                if len(held) > most:
                    long = True
                    out.extend((h[0], None, None, None, None, pivot) for h in held)
                    held = []
            if len(out) > 10_000:
                yield record(out)
                out.clear()
        close()
        if out:
            yield record(out)

    return rows.mapInArrow(run, schema)


class Forest:
    """Which components a task has joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != top:
            self.up[x], x = top, above
        return top

    def join(self, a: int, b: int) -> bool:
        """Join two components; False if they were one."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Block:
    """Sets of one block under an inverted index."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]) -> None:
        self.held = held
        self.sizes = np.array([len(h[2]) for h in held])
        hashes, owner = np.concatenate([h[2] for h in held]), np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def links(self, node: int, root: int, found: np.ndarray, forest: Forest, out: list[tuple[int, int]]) -> None:
        """Append a link of `node` for each component of the block that it joins."""
        low, high = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, "right")
        width = high - low
        total = int(width.sum())
        if not total:
            return
        at = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(total)
        overlap = np.bincount(self.owner[at], minlength=len(self.held))
        for k in np.flatnonzero(100 * overlap >= THRESHOLD * (self.sizes + len(found) - overlap)):
            other, other_root, _ = self.held[k]
            if forest.join(other_root, root):
                out.append((other, node))


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) from rows (main, block, part, turn, node, root, hashes).

    In each (main, block, part), rows of turn 0 are held and those of turn 1 meet them.
    """
    keys = ("main", "block", "part")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "turn", "node").select(*keys, "turn", "node", "root", "hashes")
    arrow = to_arrow(rows, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, forest = None, [], None, Forest()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for main, number, part, turn, node, root, raw in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if key != (main, number, part):
                    key, held, block, forest = (main, number, part), [], None, Forest()
                if turn == 0:
                    held.append((node, root, unpack_set(raw)))
                elif held:
                    block = block or Block(held)
                    block.links(node, root, unpack_set(raw), forest, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, "a long, b long")


def grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(main, node, root) of rows (pivot, node): main is the commonest component among a pivot's rows, and pivots with one main are one group."""
    placed = cut(rooted(rows, roots))
    common = placed.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("_n")).groupBy("pivot").agg(F.min(F.struct((-F.col("_n")).alias("_n"), "root")).alias("_m"))
    return cut(looked_up(placed, common.select("pivot", F.col("_m.root").alias("main")), "pivot").select("main", "node", "root").distinct())


def sized(groups: DataFrame) -> DataFrame:
    """Groups (main, node, root) that somebody is outside of, with the numbers of blocks for all members and for outsiders."""
    counts = groups.groupBy("main").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("root") != F.col("main")).alias("_out")).where("_out > 0")
    size = F.least(F.lit(BLOCKS[1]), F.greatest(F.lit(BLOCKS[0]), F.col("_all") / PARTS))
    blocks = counts.select("main", F.ceil(F.col("_all") / size).cast("long").alias("_alls"), F.ceil(F.col("_out") / size).cast("long").alias("_outs"))
    return looked_up(groups, blocks, "main").withColumn("_hash", F.xxhash64("node"))


def block_links(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Links of the outsiders of each group with all of it: each block of outsiders meets each block of the group, in a task that holds one block."""
    placed = sized(groups)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = placed.where("root != main").select("main", F.pmod("_hash", "_outs").alias("block"), every("_alls").alias("part"), F.lit(0).alias("turn"), "node", "root")
    rest = placed.select("main", every("_outs").alias("block"), F.pmod("_hash", "_alls").alias("part"), F.lit(1).alias("turn"), "node", "root")
    return compared(own.unionByName(rest).join(known.select("node", "hashes"), "node"))


def rooted(rows: DataFrame, roots: DataFrame, column: str = "node", name: str = "root") -> DataFrame:
    """`rows` with the component of `column`; a node without links is its own."""
    named = if_small(roots).select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(named, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b)."""
    found = cut(links)
    upper = components(rooted(rooted(found, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = looked_up(roots, upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    alone = upper.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return cut(moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(alone))


def node_components(docs: DataFrame, frequency: Frequency) -> DataFrame:
    """(node, root) over all links between the sets of `docs`."""
    index = cut(shared(entries(docs, frequency)))
    # Pivots first, where what they share with a member lets them link at all.
    met = index.where(close_in_size("pivot_n", "n")).groupBy("pivot", "node", "pivot_n", "n", (F.col("plain") & F.col("pivot_plain")).alias("plain")).agg(F.count(F.lit(1)).alias("common"))
    low, high = F.least("pivot", "node").alias("low"), F.greatest("pivot", "node").alias("high")
    once = met.where(possible("common", "n", "pivot_n", "plain")).groupBy(low, high).agg(F.min("pivot").alias("a"))
    stars = cut(once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    roots = components(verify(stars, known_sets(docs, ends(stars))))

    # What pivots left open: runs, pivot included, whose members lie in more than one component.
    heads = index.select("sig", "pivot", F.col("pivot").alias("node"), F.col("pivot_n").alias("n"), F.col("pivot_plain").alias("plain")).distinct()
    everyone = rooted(index.select("sig", "pivot", "node", "n", "plain").unionByName(heads), roots)
    rows = everyone.repartition("sig", "pivot").sortWithinPartitions("sig", "pivot", "node").select("sig", "pivot", "node", "n", "plain", "root")
    rest = cut(short_pairs(rows))
    # A pair that shares a long run is compared there; of any other, these are all the keys it shares.
    counted = rest.where("b IS NOT NULL").groupBy("a", "b", "n", "m", "plain").agg(F.count(F.lit(1)).alias("common"))
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(counted.where(possible("common", "n", "m", "plain")).select("a", "b").join(seen, ["a", "b"], "left_anti"))
    groups = grouped(rest.where("b IS NULL").select("pivot", F.col("a").alias("node")).distinct(), roots)
    known = known_sets(docs, ends(pairs).unionByName(groups.select("node")))
    return merged(roots, verify(pairs, known).unionByName(block_links(groups, known)))


def placed_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of each row of `docs` (doc_id, text).

    Each step is written before the next one begins, so its shuffle files go at once: together they are larger than the texts.
    """
    with shuffles_removed(docs.sparkSession):
        table = cut(members(docs))
        frequency = frequencies(add_sketches(table))
        placed = table.where(F.col("chunk").isNull()).select("doc_id", F.col("n").alias("n_shingles"), "node")
        worded = placed.where(F.col("node").isNotNull())
        nodes = cut(rooted(worded.groupBy("node").agg(F.min("doc_id").alias("_least")), node_components(docs, frequency)))
        least = nodes.groupBy("root").agg(F.min("_least").alias("component_id"))
        named = looked_up(nodes.select("node", "root"), least, "root").select("node", "component_id")
        found = looked_up(worded, named, "node").select("doc_id", "n_shingles", "component_id", "node")
        return found.unionByName(placed.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node"))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the size of its set and the smallest doc_id of its component."""
    return placed_components(docs).drop("node")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of `docs`, that with the smallest doc_id; all columns unchanged.

    Texts without words are each their own component and stay. Of rows that repeat both
    doc_id and text one stays. Where a doc_id has different texts each is judged by its own component, and of
    several in one component that whose set has the smallest hash stays, then the smallest text. Rows without
    doc_id stay only if their component has none.
    """
    c = F.col
    placed = cut(placed_components(docs))
    own = placed.where(c("doc_id").eqNullSafe(c("component_id")))
    same = lambda a, b, *names: [c(f"{a}.{n}").eqNullSafe(c(f"{b}.{n}")) for n in names]
    kept = docs.alias("_docs").join(own.select("doc_id").distinct().alias("_kept"), same("_docs", "_kept", "doc_id"), "left_semi")
    again = cut(placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    least = own.groupBy("doc_id", c("node").isNull().alias("_empty")).agg(F.min("node").alias("node")).select("doc_id", "node")
    once = kept.alias("_docs").join(again.alias("_again"), same("_docs", "_again", "doc_id"), "left_anti")
    odd = with_nodes(kept.alias("_docs").join(again.alias("_again"), same("_docs", "_again", "doc_id"), "left_semi"))
    chosen = odd.select("_row", c("_row.doc_id").alias("doc_id"), c("_node").alias("node")).alias("_odd").join(least.alias("_least"), same("_odd", "_least", "doc_id", "node"), "left_semi")
    one = chosen.groupBy("doc_id", "node", F.when(c("node").isNull(), c("_row.text")).alias("_t")).agg(F.min_by("_row", F.struct("_row.text")).alias("_row"))
    return once.unionByName(one.select("_row.*"))


def with_nodes(docs: DataFrame) -> DataFrame:
    """(_row, _node): each row of `docs` as a struct, and the node of its text."""
    kind = T.StructType([T.StructField("_row", docs.schema), T.StructField("_node", T.LongType())])
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"_row": batch.column(0), "_node": pa.array([node_of(f) if len(f) else None for f in found], pa.int64())})

    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), "text").mapInArrow(run, kind)
