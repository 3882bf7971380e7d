"""SentencePiece encoding and decoding by vectorised merge rounds.

All words of a block lie in one flat array of symbols. A round finds each word's best
pair rank by a segmented minimum, merges its leftmost occurrences in all words at once
and compacts the arrays; a word without a pair leaves them, and the rounds end when none is
left. Merging several occurrences in one round gives what merging them one after another
does unless a new pair beside one of them would come before the next (runs of spaces); a word
where that is found leaves the rounds and ends with a queue.

A piece of the vocabulary holds white space only at its front, so a text falls apart into
words (spaces, then other characters) whose merges don't meet; equal words are merged once
in a block and kept, at most KEPT_WORDS to a worker; a full cache is emptied, which costs
time only. Blocks are cut where a word begins, so memory follows the block, or the longest word.

Decoding looks up each id's bytes, turns the space mark into a space, drops the one that
encoding puts in front, and reads what is no valid UTF-8 as U+FFFD, a byte at a time.

Null and empty texts have no ids. Texts are never cut; repeated rows are encoded alike;
pairs of equal rank go to the left. An empty table gives an empty result. Columns besides
doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import sys
from collections.abc import Iterator, Sequence
from itertools import chain, groupby, islice

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import map_rows
from plumbline.llm.tokens import CHUNK, MODEL, SPACE, model_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEPT_WORDS, LONG_WORD = 400_000, 64
BLOCK_CHARS = 1 << 20
NONE = np.iinfo(np.int32).max  # the rank of a pair that doesn't merge
codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def begun(flags: np.ndarray) -> np.ndarray:
    """For each set flag, its offset from the first of its unbroken run."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at
    new = np.concatenate(([True], at[1:] != at[:-1] + 1))
    return at - at[new][np.cumsum(new) - 1]


class MergeRounds:
    """Encoder and decoder of one sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        kinds = [(sp.is_control(i) or sp.is_unknown(i), sp.is_byte(i), sp.is_unused(i)) for i in range(size)]
        names = [sp.id_to_piece(i) for i in range(size)]
        if any(unused for _, _, unused in kinds):
            raise ValueError("a model with unused pieces isn't supported")
        pieces = {names[i]: i for i, kind in enumerate(kinds) if not any(kind)}
        self.byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
        self.size = size
        #: A symbol is a piece's id, or from `size` on a character that is no piece but part of one; `other` is any other character.
        spare = sorted({ch for p in pieces for ch in p} - pieces.keys())
        self.symbols = pieces | {ch: size + k for k, ch in enumerate(spare)}
        self.other = size + len(spare)
        self.of_char = np.full(sys.maxunicode + 1, self.other, np.int32)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        scores = sorted({sp.get_score(i) for i in pieces.values()}, reverse=True)
        level = {s: k for k, s in enumerate(scores)}
        self.width = self.other + 1
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (i, level[sp.get_score(i)])
        self.pairs = pairs
        keys = sorted(pairs)
        self.keys = np.array(keys, np.int64)
        self.merged = np.array([pairs[k][0] for k in keys], np.int32)
        self.ranks = np.array([pairs[k][1] for k in keys], np.int32)
        spoken = [bytes([self.byte_ids.index(i)]) if kinds[i][1] else (b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else names[i].replace(SPACE, " ").encode()) for i in range(size)]
        self.spoken_lengths = np.array(list(map(len, spoken)), np.int64)
        self.spoken_starts = np.cumsum(self.spoken_lengths) - self.spoken_lengths
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.silent = [sp.is_control(i) for i in range(size)]
        self.marked = [name.startswith(SPACE) for name in names]
        self.decimals = list(map(str, range(size)))
        self.kept: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, rank NONE where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word (none of them empty) as 32-bit integers, all words in the same rounds."""
        if not words:
            return []
        letters = "".join(words)
        symbol = self.of_char[np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(letters))  # where each symbol begins in `letters`
        word = np.repeat(np.arange(len(words)), sizes)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self.ranked(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(word)))
            least = np.repeat(best, lengths)
            over = least == NONE
            if over.any():  # words that are finished leave
                ended.append((place[over], symbol[over]))
                on = ~over
                symbol, place, word, rank, made, least = symbol[on], place[on], word[on], rank[on], made[on], least[on]
                if not len(symbol):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)[begun(hit) % 2 == 0]  # of overlapping occurrences every second one
            early = self.early(symbol, word, made, least, at)
            if len(early):
                out = np.isin(word, early)
                ended += [self.queued(place[word == w], symbol[word == w]) for w in early]
                on = ~out
                at = (np.cumsum(on) - 1)[at[on[at]]]
                symbol, place, word, rank, made = symbol[on], place[on], word[on], rank[on], made[on]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            now = (np.cumsum(keep) - 1)[at]
            symbol, place, word, rank, made = symbol[keep], place[keep], word[keep], rank[keep], made[keep]
            beside = np.zeros(len(symbol) + 1, bool)  # only pairs beside a merged symbol change
            beside[now] = beside[now - 1] = True
            self.rerank(symbol, word, rank, made, np.flatnonzero(beside[:-1]))
        return self.spelled(ended, letters, firsts, sizes)

    def ranked(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pair that begins at each symbol."""
        rank, made = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)
        self.rerank(symbol, word, rank, made, np.arange(len(symbol)))
        return rank, made

    def rerank(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        rank[at] = NONE
        at = at[at + 1 < len(symbol)]
        at = at[word[at] == word[at + 1]]
        rank[at], made[at] = self.pair(symbol[at], symbol[at + 1])

    def early(self, symbol: np.ndarray, word: np.ndarray, made: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words in which a merge at one of `at` makes a pair that comes before the next of them."""
        lone = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
        some = at[~lone | np.append(~lone[1:], False)]
        if not len(some):
            return some
        now = symbol.copy()
        now[some + 1] = made[some]  # seen from the right, a merged symbol ends there
        worst = np.full(len(some), NONE, np.int32)
        ok = (some > 0) & (word[some - 1] == word[some])
        worst[ok] = self.pair(now[some[ok] - 1], made[some[ok]])[0]
        ok = some + 2 < len(symbol)
        ok[ok] = word[some[ok] + 2] == word[some[ok]]
        worst[ok] = np.minimum(worst[ok], self.pair(made[some[ok]], symbol[some[ok] + 2])[0])
        return np.unique(word[some[worst <= least[some]]])

    def queued(self, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word's merges one after another, by a queue of (rank, place)."""
        symbols, n = symbol.tolist(), len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        queue = [(found[1], k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (found := pairs.get(symbols[k] * self.width + symbols[k + 1]))]
        heapq.heapify(queue)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            nxt = after[k]
            if symbols[k] != left or nxt >= n or symbols[nxt] != right:
                continue
            symbols[k], symbols[nxt] = pairs[left * self.width + right][0], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (found := pairs.get(symbols[a] * self.width + symbols[b])):
                    heapq.heappush(queue, (found[1], a, symbols[a], symbols[b]))
        left_over = np.array(symbols, np.int32)
        return place[left_over >= 0], left_over[left_over >= 0]

    def spelled(self, ended: list[tuple[np.ndarray, np.ndarray]], letters: str, firsts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The symbols in order as ids, characters that are no pieces as the ids of their bytes."""
        place = np.concatenate([p for p, _ in ended]) if ended else np.empty(0, np.int64)
        symbol = np.concatenate([s for _, s in ended]) if ended else np.empty(0, np.int32)
        order = np.argsort(place)
        place, ids = place[order], symbol[order]
        cuts = np.searchsorted(place, np.append(firsts, firsts[-1] + sizes[-1]))
        strange = np.flatnonzero(ids >= self.size)
        if len(strange):
            raw = [letters[p].encode("utf-8", "surrogatepass") for p in place[strange].tolist()]
            counts = np.ones(len(ids) + 1, np.int64)
            counts[strange] = list(map(len, raw))
            moved = np.cumsum(counts) - counts
            ids, cuts = np.repeat(ids, counts[:-1]), moved[cuts]
            for at, spelt in zip(moved[strange].tolist(), raw, strict=True):
                ids[at : at + len(spelt)] = [self.byte_ids[x] for x in spelt]
        flat, ends = ids.astype(np.int32).tobytes(), (cuts * 4).tolist()
        return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time; a block ends where a word begins."""
        start, marked = 0, SPACE + text.replace(" ", SPACE)
        while start < len(marked):
            end = min(start + BLOCK_CHARS, len(marked))
            while end < len(marked):
                end = marked.find(SPACE, end)
                end = len(marked) if end < 0 else end
                if end == len(marked) or marked[end - 1] != SPACE:
                    break
                end += 1
            yield CHUNK.findall(marked[start:end])
            start = end

    def word_ids(self, words: list[str]) -> list[bytes]:
        kept = self.kept
        new = list(set(words).difference(kept))
        if new and len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = list(set(words))
        kept.update(zip(new, self.merge(new), strict=True))
        found = [kept[w] for w in words]
        for w in new:
            if len(w) > LONG_WORD:
                del kept[w]
        return found

    def encoded(self, texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids), in order: one or more for each text that isn't empty. Words of many texts share the rounds."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for words in self.blocks(text) if text else ():
                held.append((k, words))
                size += sum(map(len, words))
                if size >= BLOCK_CHARS:
                    yield from self.flushed(held)
                    held, size = [], 0
        yield from self.flushed(held)

    def flushed(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        ids = iter(self.word_ids(list(chain.from_iterable(words for _, words in held))))
        for k, words in held:
            yield k, np.frombuffer(b"".join(islice(ids, len(words))), np.int32)

    def encode(self, texts: Sequence[str | None]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for k, ids in self.encoded(texts):
            out[k] += ids.tolist()
        return out

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """What some ids spell, the space in front included."""
        lengths = self.spoken_lengths[ids]
        shift = self.spoken_starts[ids] - (np.cumsum(lengths) - lengths)
        return self.spoken[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of some ids; control ids are silent and end a run of bytes, and the space in front is dropped."""
        runs = [list(run) for silent, run in groupby(ids, key=self.silent.__getitem__) if not silent]
        said = "".join(self.bytes_of(np.array(run)).decode("utf-8", "each byte") for run in runs)
        return said[1:] if runs and self.marked[runs[0][0]] else said

    def digests(self, texts: Sequence[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, and the hex digests of the ids and of the text they decode to."""
        count, names, said = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for k, ids in self.encoded(texts):
            whole = self.bytes_of(ids).decode("utf-8", "each byte")  # a block ends between words, so between characters
            said[k].update((whole if count[k] else whole[1:]).encode())  # the first id has the space that encoding puts in front
            names[k].update((("," if count[k] else "") + ",".join(map(self.decimals.__getitem__, ids.tolist()))).encode())
            count[k] += len(ids)
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(count, names, said, strict=True)]


@functools.cache
def rounds(path: str) -> MergeRounds:
    return MergeRounds(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    path = path or model_path()
    return map_rows(docs.select("doc_id", "text"), lambda b: {"doc_id": b["doc_id"], "ids": rounds(path).encode(b["text"])}, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the text of each list of ids; null is an empty one."""
    path = path or model_path()
    return map_rows(encoded.select("doc_id", "ids"), lambda b: {"doc_id": b["doc_id"], "text": [rounds(path).decode(i or []) for i in b["ids"]]}, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): number of ids, digests of the ids and of the text they decode to."""
    path = path or model_path()

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = rounds(path).digests(batch["text"])
        return {"doc_id": batch["doc_id"], "n_tokens": [f[0] for f in found], "ids_sha256": [f[1] for f in found], "decoded_sha256": [f[2] for f in found]}

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA)
