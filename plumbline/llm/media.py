"""Media columns: signature sniffing.

An Aho-Corasick automaton finds magic bytes anywhere in a binary value, a validator for
each format confirms structure and lengths at the place, and what is confirmed at the
start corrects the declared type; what is confirmed elsewhere is carved out as embedded
media. A text's bytes are stored losslessly as 8-bit mono PCM samples in a WAV file, and
features are computed on the samples read back from it.

Null and empty texts give the minimum payload of padding. A signature whose structure
does not hold is no media. Values are handled whole, and what validators look for from
many places (end marks, chains of blocks) is looked up once in a value, not once a
signature. Equal values, repeated rows among them, give equal rows; of media that begin at
one place the automaton's first wins (ties). An empty table gives an empty result; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import map_rows

BLOCK, PAD = 576, 255
RATE = 8000
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, declared_type string, media_type string, embedded array<struct<type:string,start:long,length:long>>"
)
SNIFFED = "declared_type string, media_type string, corrected boolean, embedded array<struct<type:string,start:long,length:long>>"

# Magic bytes of public formats.
MAGIC: dict[bytes, str] = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "audio/wav",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
}


class Value:
    """A binary value and what its validators have found out about it."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.ends: dict[tuple, int] = {}

    def find(self, mark: bytes, at: int) -> int:
        """The first place of `mark` from `at` on, -1 if there is none; all places are listed at the first question."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        k = bisect_left(self.marks[mark], at)
        return self.marks[mark][k] if k < len(self.marks[mark]) else -1

    def follow(self, start: tuple, step: Callable[[tuple], tuple | int]) -> int:
        """The end that `step` leads to from `start`, state by state; a state is walked once however many starts reach it."""
        path = []
        while start not in self.ends:
            path.append(start)
            got = step(start)
            if isinstance(got, int):
                self.ends[start] = got
                break
            start = got
        end = self.ends[start]
        for state in path:
            self.ends[state] = end
        return end


def png_length(value: Value, at: int) -> int:
    """Bytes of the PNG at `at`, 0 if its chunks or their checksums don't hold."""
    data = value.data

    def step(state: tuple) -> tuple | int:
        pos, first = state[1:]
        if pos + 12 > len(data):
            return 0
        size, kind = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + size > len(data) or first != (kind == b"IHDR"):
            return 0
        if zlib.crc32(memoryview(data)[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", data, pos + 8 + size)[0]:
            return 0
        return pos + 12 + size if kind == b"IEND" else ("png", pos + 12 + size, False)

    return max(0, value.follow(("png", at + 8, True), step) - at)


def wav_length(value: Value, at: int) -> int:
    data = value.data
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0

    def step(state: tuple) -> tuple | int:
        """Chunks up to `end`; which of the two needed kinds have been seen is part of the state."""
        _, pos, _, seen = state
        if pos + 8 > end:
            return end if seen == 3 else 0
        kind, size = struct.unpack_from("<4sI", data, pos)
        if pos + 8 + size > end:
            return 0
        return "wav", pos + 8 + size + size % 2, end, seen | {b"fmt ": 1, b"data": 2}.get(kind, 0)

    return max(0, value.follow(("wav", at + 12, end, 0), step) - at)


def gif_length(value: Value, at: int) -> int:
    data = value.data
    if at + 13 > len(data):
        return 0
    flags = data[at + 10]

    def step(state: tuple) -> tuple | int:
        """From a block's start ("gif") or inside its data ("gif data")."""
        kind, pos = state
        if pos >= len(data):
            return 0
        if kind == "gif data":
            return ("gif data", pos + data[pos] + 1) if data[pos] else ("gif", pos + 1)
        if data[pos] == 0x3B:
            return pos + 1
        if data[pos] == 0x21:
            return "gif data", pos + 2
        if data[pos] == 0x2C and pos + 10 < len(data):
            local = data[pos + 9]
            return "gif data", pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
        return 0

    return max(0, value.follow(("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)), step) - at)


def jpeg_length(value: Value, at: int) -> int:
    data = value.data

    def step(state: tuple) -> tuple | int:
        """From a segment's start; after a scan up to a marker that is neither stuffing nor a restart."""
        kind, pos, scanned = state
        if kind == "jpeg scan":
            pos = value.find(b"\xff", pos)
            if pos < 0 or pos + 1 >= len(data):
                return 0
            if not data[pos + 1] or 0xD0 <= data[pos + 1] <= 0xD7:
                return "jpeg scan", pos + 2, True
        if pos + 2 > len(data) or data[pos] != 0xFF:
            return 0
        if data[pos + 1] == 0xD9:
            return pos + 2 if scanned else 0
        if pos + 4 > len(data):
            return 0
        size = struct.unpack_from(">H", data, pos + 2)[0]
        if size < 2:
            return 0
        return ("jpeg scan", pos + 2 + size, True) if data[pos + 1] == 0xDA else ("jpeg", pos + 2 + size, scanned)

    return max(0, value.follow(("jpeg", at + 2, False), step) - at)


def bmp_length(value: Value, at: int) -> int:
    data = value.data
    if at + 30 > len(data):
        return 0
    size, _, start, header, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    ok = planes == 1 and bits in (1, 4, 8, 16, 24, 32) and header in (40, 52, 56, 64, 108, 124) and 14 + header <= start < size
    return size if ok and at + size <= len(data) else 0


def pdf_length(value: Value, at: int) -> int:
    end, table = value.find(b"%%EOF", at), value.find(b"startxref", at)
    return end + 5 - at if end >= 0 and value.data[at + 5 : at + 6].isdigit() and 0 <= table < end else 0


def zip_length(value: Value, at: int) -> int:
    data, end = value.data, value.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(data) else 0


VALIDATORS: dict[str, Callable[[Value, int], int]] = {
    "image/png": png_length,
    "image/gif": gif_length,
    "image/jpeg": jpeg_length,
    "image/bmp": bmp_length,
    "audio/wav": wav_length,
    "application/pdf": pdf_length,
    "application/zip": zip_length,
}


def scanner() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, length) of confirmed media; what lies within an earlier one is left out unless the outer starts at 0."""
    out, end, size, value = [], -1, len(data), Value(data)
    for last, (width, kind) in automaton.iter(data.decode("latin-1")):
        at = last - width + 1
        if at < end or not (length := VALIDATORS[kind](value, at)):
            continue
        out.append((kind, at, length))
        # Inside a file that fills the value, embedded media are still looked for.
        end = at + length if at or length < size else at + 1
    return out


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def wav_samples(media: bytes) -> np.ndarray:
    """The samples of a stored file, found through its chunk lengths."""
    pos = 12
    while True:
        kind, size = struct.unpack_from("<4sI", media, pos)
        if kind == b"data":
            return np.frombuffer(media, np.uint8, size, pos + 8)
        pos += 8 + size + size % 2


def features(samples: np.ndarray) -> str:
    """Level, spread, entropy and zero crossings of the samples."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = float(samples.mean())
    crossings = int(np.count_nonzero((samples[1:] > 127) != (samples[:-1] > 127)))
    return f"n={len(samples)};mean={mean:.4f};std={float(samples.std()):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};crossings={crossings}"


def store(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """One row per row of `docs` (doc_id, text): the stored form, its confirmed type and what is embedded."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        automaton = scanner()
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            padding = -len(raw) % BLOCK if raw else BLOCK
            media = wav(raw + bytes([PAD]) * padding)
            confirmed = sniff(media, automaton)
            kind = next((k for k, at, length in confirmed if at == 0 and length == len(media)), declared)
            samples = wav_samples(media)
            values = (doc, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), declared, kind, [dict(type=k, start=a, length=n) for k, a, n in confirmed if a])
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return out

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA)


def correct(table: DataFrame, data: str = "data", declared: str = "declared_type") -> DataFrame:
    """Confirmed type and embedded media of a binary column, beside what was declared; rows keep their order."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        automaton = scanner()
        found = [sniff(v or b"", automaton) for v in batch[data]]
        kinds = [next((k for k, at, _ in f if at == 0), d) for f, d in zip(found, batch[declared], strict=True)]
        return {
            "declared_type": batch[declared], "media_type": kinds, "corrected": [k != d for k, d in zip(kinds, batch[declared], strict=True)],
            "embedded": [[dict(type=k, start=a, length=n) for k, a, n in f if a] for f in found],
        }

    return map_rows(table.select(data, declared), run, SNIFFED)
