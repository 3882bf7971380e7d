"""Quality rules: repetition coverage.

Words, lines and n-grams of a text become 64-bit rolling hashes in numpy. The verdict reads
how many characters lie inside what occurs more than once: word n-grams of several lengths,
lines, and three-character n-grams of punctuation and white space ("###" after every word,
" | " between words), of which the punctuation counts. Nothing else enters it but the base
rule.

Null and empty texts have no words: every count is 0 and the base rule rejects them.
Ties and repeated rows are judged one by one and alike; a share that equals its bound is
kept. Texts are never cut. An empty table gives an empty result. Columns besides doc_id and
text play no part; `keep` returns all columns unchanged, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import SPACE, filter_rows, gram_hashes, map_rows, span_hashes, word_bounds

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_gram_chars array<long>, dup_mark_chars long, reason string"
)
#: n-gram lengths, and the share of word characters inside repeated ones from which a text is rejected.
GRAMS = {5: 0.35, 8: 0.30, 10: 0.28, 20: 0.25}
MAX_DUP_LINE_SHARE = 0.25
#: Length of punctuation n-grams, and the share of word characters inside repeated ones.
MARKS, MAX_DUP_MARK_SHARE = 3, 0.06
BASE_WINDOW = 8
MIN_WORDS = 20
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MARK = np.zeros(256, bool)
_MARK[[k for k in range(0x21, 0x7F) if not chr(k).isalnum()]] = True


def repeated(grams: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those positions of `among` whose n-gram occurs there twice or more."""
    found = grams[among]
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    again = np.zeros(len(found), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return among[again]


def covered(hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-gram that starts at one of `hit`."""
    step = np.bincount(hit, minlength=words + 1) - np.bincount(hit + n, minlength=words + 1)
    return np.cumsum(step)[:words] > 0


def repeated_marks(raw: np.ndarray) -> int:
    """ASCII punctuation inside n-grams of punctuation and white space that occur twice or more."""
    plain = np.concatenate(([0], np.cumsum(~(_MARK | SPACE)[raw])))
    marks = np.concatenate(([0], np.cumsum(_MARK[raw])))
    starts = np.flatnonzero((plain[MARKS:] == plain[:-MARKS]) & (marks[MARKS:] > marks[:-MARKS]))
    if not len(starts):
        return 0
    grams = np.zeros(len(starts), np.int64)
    for k in range(MARKS):
        grams = grams * 256 + raw[starts + k]
    inside = covered(starts[repeated(grams, np.arange(len(grams)))], MARKS, len(raw))
    return int((inside & _MARK[raw]).sum())


def profile(text: str | None) -> tuple:
    """The counts of one whole text: base counts first, then the method's."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_bounds(raw)
    words = len(starts)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    chars = heads[ends] - heads[starts]
    hashes = span_hashes(raw, starts, ends)
    lines: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip("\x20\t\n\x0b\x0c\r"):
            if line in lines:
                dup_lines += 1
                dup_line_chars += len(line)
            lines.add(line)
    inside, repeat, hit = [], 0, np.arange(words)
    for n in GRAMS:  # ascending: an n-gram that repeats starts with shorter ones that do
        if len(hit := hit[hit <= words - n]):
            hit = repeated(gram_hashes(hashes, n), hit)
        inside.append(int(chars[mask := covered(hit, n, words)].sum()) if len(hit) else 0)
        if n == BASE_WINDOW and len(hit):
            repeat = int(mask.sum())
    return words, int(chars.sum()), len(_SYMBOLS.findall(text)), dup_lines, repeat, dup_line_chars, inside, repeated_marks(raw)


def verdict(p: tuple) -> tuple[bool, bool, str | None]:
    """Base failure, kept, and the first rule that rejects."""
    words, chars, _, _, repeat, dup_line_chars, inside, marks = p
    if words < MIN_WORDS:
        return True, False, "few words"
    if 100 * repeat > 30 * words:
        return True, False, "repeated windows"
    if dup_line_chars > MAX_DUP_LINE_SHARE * chars:
        return False, False, "repeated lines"
    for (n, most), got in zip(GRAMS.items(), inside, strict=True):
        if got > most * chars:
            return False, False, f"repeated {n}-grams"
    if marks > MAX_DUP_MARK_SHARE * chars:
        return False, False, "repeated marks"
    return False, True, None


def score(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts, base failure, verdict and its reason."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [profile(t) for t in batch["text"]]
        judged = [verdict(p) for p in found]
        return {
            "doc_id": batch["doc_id"], "n_words": [p[0] for p in found], "word_chars": [p[1] for p in found],
            "n_symbols": [p[2] for p in found], "n_dup_lines": [p[3] for p in found], "n_repeat_words": [p[4] for p in found],
            "base_failed": [v[0] for v in judged], "kept": [v[1] for v in judged], "dup_line_chars": [p[5] for p in found],
            "dup_gram_chars": [p[6] for p in found], "dup_mark_chars": [p[7] for p in found], "reason": [v[2] for v in judged],
        }

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, all columns unchanged."""
    return filter_rows(docs, "text", lambda texts: [verdict(profile(t))[1] for t in texts])
