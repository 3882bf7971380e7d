"""Best-fit packing: Martello-Toth dominance reduction, then best fit.

Every document is tokenised, ended with an id 0, and cut into pieces of at most CAPACITY
tokens; only its first piece may be shorter. What has to be packed is then a histogram of
at most CAPACITY sizes, whatever the number of documents. On it the reduction fixes sets
that dominate every alternative: a partner that fills the bin exactly, the largest
partner where only one more piece fits, and the largest partner that is at least as large
as any two that fit. Best fit decreasing, on runs of equal sizes, packs the remainder.
The plan is a list of patterns with multiplicities. Pieces of one size are numbered
through salted groups, so a size that a third of the pieces share is spread over tasks,
and each piece reads its place off its number.

Null and empty texts are one piece of one token. Repeated rows and equal sizes are
interchangeable pieces, ordered by doc_id, piece and checksum. Very long texts are
tokenised whole. An empty table packs to nothing. Columns besides doc_id and text play no
part, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows
from plumbline.session import cut

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
RANKS, END_ID, SPECIAL = "byte_bpe_50k.tiktoken", 0, {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
ROWS_A_GROUP = 50_000


@functools.cache
def fast_encoder(ranks: str):  # noqa: ANN201
    """The vocabulary in tiktoken, which gives the ids of tokenizers several times faster."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)


@functools.cache
def exact_encoder(vocabulary: str):  # noqa: ANN201
    """The vocabulary in tokenizers, loaded where it is needed only."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def encode(text: str, vocabulary: str, ranks: str) -> list[int]:
    try:
        return fast_encoder(ranks).encode(text, allowed_special="all")
    except BaseException as e:  # its regex engine gives up on some very long runs, by version with an error or a panic, which is no Exception
        if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
            raise
        return exact_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document with the checksum of their ids (little-endian unsigned 32 bits)."""
    import public_tokenizers

    vocabulary, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = np.array([*encode(text or "", vocabulary, ranks), END_ID], "<u4")
            first = len(ids) % capacity or capacity
            starts = [0, *range(first, len(ids), capacity)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                for column, value in zip(out.values(), (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                    column.append(value)
        return out

    return map_rows(docs.select("doc_id", "text"), run, PIECES)


@dataclass
class Plan:
    """Where the r-th piece of a size goes: runs of ranks with their first sequence, offset and pieces a sequence."""

    ranks: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    sequence: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    offset: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    each: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    sequences: int = 0
    fixed: int = 0

    def add(self, pattern: list[tuple[int, int]], times: int) -> None:
        """`times` sequences that each hold the (size, count) runs of `pattern`."""
        offset = 0
        for size, count in pattern:
            self.ranks[size].append(self.used[size])
            self.sequence[size].append(self.sequences)
            self.offset[size].append(offset)
            self.each[size].append(count)
            self.used[size] += times * count
            offset += size * count
        self.sequences += times

    def place(self, size: int, rank: int) -> tuple[int, int]:
        k = bisect_right(self.ranks[size], rank) - 1
        copy, inside = divmod(rank - self.ranks[size][k], self.each[size][k])
        return self.sequence[size][k] + copy, self.offset[size][k] + inside * size


def reduce_dominated(left: dict[int, int], plan: Plan, capacity: int) -> None:
    """Fix dominating sets for the largest pieces on, and take them out of `left` (size -> count)."""
    sizes = sorted(s for s, n in left.items() if n)

    def largest(most: int, taken: int) -> int:
        """The largest size of at most `most` that is left when one piece of size `taken` is used."""
        for k in range(bisect_right(sizes, most) - 1, -1, -1):
            if left[sizes[k]] - (sizes[k] == taken) > 0:
                return sizes[k]
        return 0

    def smallest_two(taken: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(2, left[s] - (s == taken))
            if len(out) >= 2:
                break
        return out[:2]

    def best_pair(room: int, taken: int) -> int:
        have = [s for s in sizes if s <= room and left[s] - (s == taken) > 0]
        best, lo, hi = 0, 0, len(have) - 1
        while lo <= hi:
            total = have[lo] + have[hi]
            if total <= room and (lo < hi or left[have[lo]] - (have[lo] == taken) > 1):
                best = max(best, total)
            if total <= room:
                lo += 1
            else:
                hi -= 1
        return best

    def fix(pattern: list[tuple[int, int]], times: int) -> None:
        plan.add(pattern, times)
        plan.fixed += times
        for s, n in pattern:
            left[s] -= times * n

    for j in sizes[::-1]:
        while left[j]:
            room = capacity - j
            two = smallest_two(j)
            if not two or two[0] > room:
                fix([(j, 1)], left[j])
                continue
            i = largest(room, j)
            single = len(two) == 1 or sum(two) > room  # only one more piece fits
            if i == room or single or (third_fits(two, room, sizes, left, j) is False and i >= best_pair(room, j)):
                if i == j:
                    fix([(j, 2)], left[j] // 2)
                else:
                    fix([(j, 1), (i, 1)], min(left[j], left[i]))
                continue
            break


def third_fits(two: list[int], room: int, sizes: list[int], left: dict[int, int], taken: int) -> bool:
    """Do three more pieces fit beside the one taken?"""
    total, seen = 0, 0
    for s in sizes:
        n = min(3 - seen, left[s] - (s == taken))
        total, seen = total + n * s, seen + n
        if seen == 3:
            return total <= room
    return False


def best_fit(left: dict[int, int], plan: Plan, capacity: int) -> None:
    """Best fit decreasing on runs of equal sizes; bins of one residual are kept as groups."""
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    residuals: list[int] = []

    def put(residual: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if not bins[residual]:
            insort(residuals, residual)
        bins[residual].append((count, pattern))

    for s in sorted((s for s, n in left.items() if n), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(residuals, s)
            if k < len(residuals):
                residual = residuals[k]
                count, pattern = bins[residual].pop()
                if not bins[residual]:
                    residuals.pop(k)
            else:
                residual, count, pattern = capacity, n, []
            fit = residual // s
            whole = min(count, n // fit)
            rest = n % fit if whole < count and n // fit == whole else 0
            spare = count - whole - (rest > 0)
            if whole:
                put(residual - fit * s, whole, [*pattern, (s, fit)])
            if rest:
                put(residual - rest * s, 1, [*pattern, (s, rest)])
            if spare and pattern:
                put(residual, spare, pattern)
            n -= whole * fit + rest
    for groups in bins.values():
        for count, pattern in groups:
            plan.add(pattern, count)


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan, left = Plan(), dict(histogram)
    reduce_dominated(left, plan, capacity)
    best_fit(left, plan, capacity)
    return plan


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of `docs` (doc_id, text) with its sequence and its offset there."""
    cuts = cut(pieces(docs, capacity))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, capacity)
    groups = max(16, math.ceil(sum(histogram.values()) / ROWS_A_GROUP))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece") + F.spark_partition_id(), F.lit(groups)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("length", "salt", before.alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(first, ["length", "salt"])
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def run(batch: dict[str, list]) -> dict[str, list]:
        places = [plan.place(s, r) for s, r in zip(batch["length"], batch["rank"], strict=True)]
        return {c: batch[c] for c in columns} | {"sequence_id": [p[0] for p in places], "offset": [p[1] for p in places]}

    return map_rows(ranked.select(*columns, (F.col("first") + F.col("rank")).alias("rank")), run, PLACED)
