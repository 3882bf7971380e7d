"""Token counts: a prefix table by dynamic programming.

A piece of the vocabulary holds white space only at its front, so a text falls apart
into chunks (spaces, then other characters) that are encoded independently. Inside a
chunk the program stores, for every prefix, its exact token count: the encoding of a
prefix ends in the one piece t for which the shorter prefix's last piece and t stay
apart when the two are merged on their own, so count[k] = count[k - len(t)] + 1.
Summed over the chunks this gives the count at every code-point prefix of the text, and
truncation or budget questions are lookups instead of new encodings.

Null and empty texts have 0 tokens. Long texts, and long runs without a space, are
handled whole; repeated rows, and texts with equal counts, are counted one by one. An empty
table gives an empty result. Columns besides doc_id and text play no part, whatever their
names. Tables are kept a chunk at most
KEPT_CHUNKS to a worker; a full cache is emptied, which costs time only.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from plumbline.llm.common import map_rows

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
KEPT_CHUNKS = 500_000
KEPT_PAIRS = 200_000
KEPT_HEADS = 40_000
HEAD = 6  # chunks that begin alike share the table of their first code points
#: A chunk: spaces and what follows. A line feed is in no piece, so it ends a chunk too.
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Token counts at every prefix for one sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.scores))
        self.totals: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[list[int], list[str]]] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string: the best adjacent pair is joined until none is left."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Do two pieces stay as they are when they stand side by side?"""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def chunk_counts(self, chunk: str) -> list[int]:
        """The exact token count of chunk[:k] for k = 0 .. len(chunk)."""
        head = self.heads.get(chunk[:HEAD])
        counts, last = (head[0][:], head[1][:]) if head else ([0], [""])
        scores, longest, apart, known = self.scores, self.longest, self.apart, self.pairs.get
        if len(counts) > len(chunk) + 1:
            return counts[: len(chunk) + 1]
        for k in range(len(counts), len(chunk) + 1):
            if k == HEAD + 1 and not head:
                if len(self.heads) >= KEPT_HEADS:
                    self.heads.clear()
                self.heads[chunk[:HEAD]] = counts[:], last[:]
            for start in range(max(0, k - longest), k):
                piece = chunk[start:k]
                if (piece in scores or k - start == 1) and ((ok := known((last[start], piece))) or ok is None and apart(last[start], piece)):
                    cost = 1 if piece in scores else len(piece.encode("utf-8", "surrogatepass"))
                    counts.append(counts[start] + cost)
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no encoding of a prefix of {chunk[:40]!r}")
        return counts

    def total(self, chunk: str) -> int:
        found = self.totals.get(chunk)
        if found is None:
            if len(self.totals) >= KEPT_CHUNKS:
                self.totals.clear()
            found = self.chunk_counts(chunk)[-1]
            if len(chunk) <= 64:
                self.totals[chunk] = found
        return found

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def table(self, text: str) -> PrefixTable:
        parts = self.chunks(text)
        get = self.totals.get
        sizes = [t if (t := get(c)) is not None else self.total(c) for c in parts]
        return PrefixTable(self, parts, sizes)


class PrefixTable:
    """Counts at every prefix of one text: sums at chunk ends, and each chunk's own table below."""

    def __init__(self, counter: PrefixCounter, parts: list[str], sizes: list[int]) -> None:
        self.counter, self.parts, self.sums = counter, parts, list(accumulate(sizes))

    @property
    def total(self) -> int:
        return self.sums[-1] if self.sums else 0

    @functools.cached_property
    def ends(self) -> list[int]:
        """Code points up to each chunk's end, the leading space that the model adds included."""
        return list(accumulate(map(len, self.parts)))

    def count(self, chars: int) -> int:
        """Tokens of the first `chars` code points."""
        if chars <= 0 or not self.parts:
            return 0
        at = bisect_right(self.ends, chars)  # of the text with its added space, chars + 1 are read
        at = at if at == 0 or self.ends[at - 1] < chars + 1 else at - 1
        if at >= len(self.parts):
            return self.total
        before = self.ends[at - 1] if at else 0
        return (self.sums[at - 1] if at else 0) + self.counter.chunk_counts(self.parts[at])[min(chars + 1 - before, len(self.parts[at]))]

    def counts(self) -> list[int]:
        """The count at every prefix, from the empty one to the whole text."""
        out, base = [0], 0
        for part, total in zip(self.parts, self.sums, strict=True):
            out += [base + c for c in self.counter.chunk_counts(part)[1:]]
            base = total
        del out[1:2]  # the added space alone is no prefix of the text
        return out

    def longest_within(self, limit: int) -> int:
        """Code points of the longest prefix of at most `limit` tokens."""
        at = bisect_right(self.sums, limit)
        if at == len(self.parts):
            return max(0, (self.ends[-1] if self.parts else 0) - 1)
        base, before = (self.sums[at - 1], self.ends[at - 1]) if at else (0, 0)
        inside = self.counter.chunk_counts(self.parts[at])
        return max(0, before + max(k for k, c in enumerate(inside) if base + c <= limit) - 1)


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): bytes, tokens, and the longest prefix within the limit."""
    path = path or model_path()

    def run(batch: dict[str, list]) -> dict[str, list]:
        own = counter(path)
        found = []
        for text in batch["text"]:  # one table at a time: they are far larger than their texts
            table = own.table(text or "")
            found.append((table.total, table.longest_within(limit)))
        return {
            "doc_id": batch["doc_id"], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]],
            "n_tokens": [f[0] for f in found], "over_limit": [f[0] > limit for f in found], "limit_chars": [f[1] for f in found],
        }

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, counts): the stored table itself, one count for every prefix."""
    path = path or model_path()

    def run(batch: dict[str, list]) -> dict[str, list]:
        own = counter(path)
        return {"doc_id": batch["doc_id"], "counts": [own.table(t or "").counts() for t in batch["text"]]}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, counts array<int>")
