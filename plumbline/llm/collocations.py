"""Phrase collocation mining: Apriori passes, level by level.

Pass k reads the texts and finds the hashes of the k-grams of a window of them in numpy; a
k-gram counts only if both (k-1)-grams that overlap in it are frequent. Hashes and counts
are packed by ranges of hashes into binary rows, so that few rows are shuffled, and a task
adds up one range at a time in a table of counters of fixed size. What is broadcast of the
frequent ones is a bit table, of BITS bits however many there are. The last pass emits the
grams themselves, packed likewise: those whose hash is frequent at their level. Their counts
are exact, by word numbers inside a window and by text across windows: hashes that meet by
chance, in a counter or in the table, cost rows, never a phrase. This table of all levels is
written to the shared folder once; all cuts are scored from it by plain joins, whose hot
keys adaptive execution splits, in decimals, as products may pass 64 bits.

Words and pieces are those of the contract: A-Z lower-cased, pieces end at `.,;:!?` and
line ends, words at spaces and tabs. Null and empty texts have no words; a null language
is `und`. Long texts are read whole, in blocks; repeated rows count again. Of equal scores
within a phrase the first cut counts; equal phrases can't occur twice in a language; equal
scores among phrases are ranked by frequency, then by the phrase's bytes. An empty table
gives an empty result. Columns besides text and lang play no part, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import _BASE, LOWER, mix, span_hashes, to_arrow
from plumbline.session import dealt, scratch, shuffles_removed

LENGTH, LEAST, MASKED, TOP = 3, 10, 50, 2000
BITS = 1 << 26
WINDOW_BYTES, WINDOW_KINDS, BLOCK, LONG_WORD = 1 << 23, 1 << 18, 1 << 22, 1 << 20
#: Spots of the bit table in a range of hashes (as a power of 2), counters of a spot (likewise), and kinds that a task holds before it packs them.
RANGE, SHARES, HELD = 17, 4, 1 << 21
#: Ranges of hashes that grams are dealt by, at least, and bytes of one that a task holds before it adds them up.
LEAST_RANGES, HELD_BYTES = 1 << 9, 1 << 25
RANKED_ROWS, RANKED_PARTS = 100_000, 32
ROWS = 100_000
LEVELS = "lang string, gram string, k int, n long"
END = b"."  # stands for every mark that ends a piece
TABLE = LOWER.copy()
TABLE[[*b",;:!?", *range(0x0A, 0x0E)]] = END[0]
TABLE[0x09] = 0x20
TO_WORDS = TABLE.tobytes()


class TextWindow:
    """Some texts, and the counts of their k-grams by language."""

    def __init__(self) -> None:
        self.languages: dict[str, int] = defaultdict()
        self.languages.default_factory = self.languages.__len__
        self.texts: list[bytes] = []
        self.spoken: list[int] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        raw, start = text.encode("utf-8", "surrogatepass").translate(TO_WORDS) + END, 0  # no phrase reaches into the next text
        while start < len(raw):
            end = raw.find(b" ", start + BLOCK)
            end = len(raw) if end < 0 else end
            self.texts.append(raw[start:end])
            self.spoken.append(self.languages[lang])
            start = end
        self.size += len(raw)

    def full(self) -> bool:
        return self.size >= WINDOW_BYTES

    def blocks(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Words and ends of pieces of some texts in a row, and how many of them each text has."""
        first = 0
        while first < len(self.texts):
            size, last = 0, first
            while last < len(self.texts) and (last == first or size + len(self.texts[last]) <= BLOCK):
                size, last = size + len(self.texts[last]), last + 1
            some = self.texts[first:last]
            raw = np.frombuffer(b"".join(some), np.uint8)
            inside, ends = raw != 0x20, raw == END[0]
            starts = inside.copy()
            starts[1:] &= ends[1:] | ends[:-1] | ~inside[:-1]
            upto = np.searchsorted(np.flatnonzero(starts), np.cumsum(list(map(len, some))))
            letters = raw[inside]
            offsets = np.append(np.flatnonzero(starts[inside]), len(letters))
            yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), np.diff(upto, prepend=0)
            first = last

    def numbered(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The different words, the number of the word at each place, its language, and the places that are no ends of pieces."""
        blocks, many = zip(*self.blocks(), strict=True)
        coded = pa.chunked_array(blocks, pa.large_binary()).dictionary_encode()
        words = coded.chunk(0).dictionary
        numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        end = words.index(pa.scalar(END, pa.large_binary())).as_py()
        return words, numbers, np.repeat(np.array(self.spoken, np.int64), np.concatenate(many)), np.flatnonzero(numbers != end)

    def places(self, words: pa.Array, numbers: np.ndarray, lang: np.ndarray, at: np.ndarray, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where the grams of each level begin, and their hashes; only those whose hash is frequent where there is a table for the level."""
        import xxhash

        tongues = np.array([xxhash.xxh64_intdigest(t.encode()) for t in self.languages], np.uint64)
        own = mix(word_hashes(words)[numbers] + tongues[lang])
        hashes, k = own[at], 1
        while True:
            if k <= len(tables):
                fine = in_table(tables[k - 1], hashes)
                at, hashes = at[fine], hashes[fine]
            yield at, hashes
            both = np.flatnonzero(at[1:] == at[:-1] + 1)
            at = at[both]
            hashes = mix(hashes[both] * _BASE + own[at + k])
            k += 1

    def hashes(self, k: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and count of the k-grams both of whose (k-1)-grams are frequent."""
        for _, (_, hashes) in zip(range(k), self.places(*self.numbered(), tables), strict=False):
            pass
        return np.unique(hashes, return_counts=True)

    def spelled(self, length: int, tables: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """Level, languages' numbers, hashes, grams and counts of each level; at level 0 each language's number of words, as gram ''."""
        words, numbers, lang, at = self.numbered()
        here, size = lang, len(self.languages)  # what begins at each place: first its language, then the gram of the level before
        spoken, grams = np.arange(size), pa.array([b""] * size, pa.large_binary())
        yield 0, spoken, np.zeros(size, np.uint64), grams, np.bincount(lang[at], minlength=size)
        for k, (at, found) in zip(range(1, length + 1), self.places(words, numbers, lang, at, tables), strict=False):
            kinds, which, n = counted(here[at] * len(words) + numbers[at + k - 1], size * len(words))
            left, last = kinds // len(words), words.take(pa.array(kinds % len(words)))
            spoken, grams = spoken[left], last if k == 1 else joined(grams.take(pa.array(left)), last, b" ")
            here, size, hashes = np.zeros(len(numbers), np.int64), len(n), np.zeros(len(n), np.uint64)
            here[at], hashes[which] = which, found
            yield k, spoken, hashes, grams, n

    def grams(self, length: int, tables: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
        """Level, languages, grams and counts of each level."""
        tongues = self.tongues()
        for k, spoken, _, grams, n in self.spelled(length, tables):
            yield k, tongues.take(pa.array(spoken)), grams, n

    def tongues(self) -> pa.Array:
        return pa.array(list(self.languages), pa.string())


def joined(left: pa.Array, right: pa.Array, mark: bytes) -> pa.Array:
    return pc.binary_join_element_wise(left, right, pa.scalar(mark, pa.large_binary()))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, some of them at a time."""
    import xxhash

    ends, letters = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
    out, a = np.empty(len(words), np.uint64), 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + LONG_WORD, "right")) - 1)
        raw = letters[ends[a] : ends[b]]
        out[a:b] = span_hashes(raw, ends[a:b] - ends[a], ends[a + 1 : b + 1] - ends[a]) if len(raw) <= LONG_WORD else xxhash.xxh64_intdigest(raw)
        a = b
    return out


def counted(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, each key's place among them, and their counts; keys are below `bound`."""
    if bound > 4 * len(keys) + WINDOW_KINDS:
        return np.unique(keys, return_inverse=True, return_counts=True)
    n = np.bincount(keys, minlength=bound)
    return np.flatnonzero(n), (np.cumsum(n > 0) - 1)[keys], n[n > 0]


def short(hashes: np.ndarray) -> np.ndarray:
    """40 bits of each hash, which is what is shuffled."""
    return hashes >> np.uint64(24)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in a bit table."""
    bits = short(hashes) & np.uint64(64 * len(table) - 1)
    return (table[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """Some short hashes as a table of `bits` bits; that size bounds what the driver gets."""
    spots = hashes.selectExpr(f"hash & {bits - 1}L AS spot").selectExpr("shiftright(spot, 6) AS word", "shiftleft(1L, CAST(spot & 63 AS INT)) AS bit")
    words = spots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[TextWindow]:
    """(lang, text) by windows."""
    window = TextWindow()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            window.add(lang, text.as_py())
            if window.full():
                yield window
                window = TextWindow()
    if window.size:
        yield window


def packed(kinds: list[np.ndarray], enough: int, low: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, counters and counts) of kinds, each a counter's number and a count of at most 255 in the lowest byte. A range has `low` bits of that."""
    some = np.sort(np.concatenate(kinds))
    counter = some >> np.uint64(8)
    first = np.flatnonzero(np.concatenate(([True], counter[1:] != counter[:-1])))
    some = counter[first] << np.uint64(8) | np.minimum(np.add.reduceat(some & np.uint64(255), first), np.uint64(enough))
    ranges = some >> np.uint64(low)
    cuts = np.flatnonzero(ranges[1:] != ranges[:-1]) + 1
    small = (some & np.uint64((1 << low) - 1)).astype(np.uint32)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(some)], strict=True):
        yield int(ranges[a]), small[a:b]


def frequent_hashes(texts: DataFrame, k: int, tables: list, least: int, bits: int) -> DataFrame:
    """(hash): at least the short ones of the k-grams that occur `least` times or more, as far as a table of `bits` bits tells them apart.

    A spot of the table has several counters, each of which stops at `least`, or 255.
    """
    enough, wide = min(least, 255), min(RANGE, bits.bit_length() - 1)
    low = wide + SHARES + 8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for window in windows(batches):
            hashes, n = window.hashes(k, [t.value for t in tables])
            spot, share = short(hashes) & np.uint64(bits - 1), short(hashes) >> np.uint64(bits.bit_length() - 1) & np.uint64((1 << SHARES) - 1)
            held.append((spot << np.uint64(SHARES) | share) << np.uint64(8) | np.minimum(n, enough).astype(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield from rows(held)
                held = []
        if sum(map(len, held)):
            yield from rows(held)

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ranges, counts = zip(*packed(held, enough, low), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], schema=ranged)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counters = -1, np.zeros(0, np.uint8)
        for batch in batches:
            for which, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if which != at:
                    yield from found(at, counters)
                    at, counters = which, np.zeros(1 << wide + SHARES, np.uint8)
                some = np.frombuffer(counts.as_buffer(), np.uint32)
                spot = some >> np.uint32(8)
                counters[spot] = np.minimum(counters[spot] + (some & np.uint32(255)), enough)
        yield from found(at, counters)

    def found(at: int, counters: np.ndarray) -> Iterator[pa.RecordBatch]:
        spots = np.unique(np.flatnonzero(counters >= enough) >> SHARES) + (at << wide)
        for a in range(0, len(spots), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(spots[a : a + ROWS], pa.int64())], schema=hashed)

    ranged, hashed = to_arrow(texts, "range int, counts binary"), to_arrow(texts, "hash long")
    return dealt(texts.mapInArrow(pack, "range int, counts binary"), "range").sortWithinPartitions("range").mapInArrow(add, "hash long")


def merged(keys: list[pa.Array], n: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Different keys and the sum of each one's counts."""
    coded = pa.chunked_array(keys, pa.large_binary()).combine_chunks().dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate(n), len(coded.dictionary)).astype(np.int64)


def level_table(texts: DataFrame, length: int, tables: list, least: int) -> DataFrame:
    """(lang, gram, k, n): the grams that occur `least` times or more, and at k = 0 the number of all words.

    Grams go in binary rows by ranges of their hashes too, as many as the bit tables have spots for: what a task holds at
    once doesn't grow with the input. A key is the gram, which has no two spaces in a row, two spaces, and the language.
    """
    ranges = max(LEAST_RANGES, sum(int(np.bitwise_count(t.value).sum()) for t in tables) >> 16)
    schema = "range int, keys binary, lengths binary, n binary"
    ranged, summed = to_arrow(texts, schema), to_arrow(texts, "key string, n long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in windows(batches):
            tongues = window.tongues().cast(pa.binary()).cast(pa.large_binary())
            levels = [(joined(grams, tongues.take(pa.array(spoken)), b"  "), (short(hashes) % np.uint64(ranges)).astype(np.int32), n) for _, spoken, hashes, grams, n in window.spelled(length, [t.value for t in tables])]
            yield from rows(*zip(*levels, strict=True))

    def rows(grams: tuple[pa.Array, ...], of: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        own, n = np.concatenate(of), np.concatenate(counts)
        order = np.argsort(own)
        own, n, keys = own[order], n[order], pa.chunked_array(grams, pa.large_binary()).combine_chunks().take(pa.array(order))
        ends, letters = np.frombuffer(keys.buffers()[1], np.int64)[: len(n) + 1], np.frombuffer(keys.buffers()[2] or b"", np.uint8)
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(n)]
        lengths = np.diff(ends).astype(np.int32)
        parts = [(int(own[a]), letters[ends[a] : ends[b]].tobytes(), lengths[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        for a in range(0, len(parts), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*parts[a : a + 64], strict=True), ranged, strict=True)], schema=ranged)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, n, size, kept = -1, [], [], 0, 0
        for batch in batches:
            for which, letters, lengths, some in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if which != at:
                    yield from found(keys, n)
                    at, keys, n, size, kept = which, [], [], 0, 0
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(lengths.as_buffer(), np.int32), dtype=np.int64)))
                keys.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), letters.as_buffer()]))
                n.append(np.frombuffer(some.as_buffer(), np.int64))
                size += keys[-1].nbytes
                if size >= HELD_BYTES + 2 * kept:
                    one, total = merged(keys, n)
                    keys, n, size, kept = [one], [total], one.nbytes, one.nbytes
        yield from found(keys, n)

    def found(keys: list[pa.Array], n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        some, total = merged(keys, n)
        fine = np.flatnonzero((total >= least) | pc.starts_with(some, pattern="  ").to_numpy(zero_copy_only=False))
        some, total = some.take(pa.array(fine)), total[fine]
        for a in range(0, len(total), ROWS):
            yield pa.RecordBatch.from_arrays([some[a : a + ROWS].cast(pa.binary()).cast(pa.string()), pa.array(total[a : a + ROWS], pa.int64())], schema=summed)

    keys = dealt(texts.mapInArrow(pack, schema), "range").sortWithinPartitions("range").mapInArrow(add, "key string, n long")
    grams = keys.withColumn("gram", F.substring_index("key", "  ", 1))
    k = F.when(F.col("gram") == "", 0).otherwise(F.length("gram") - F.length(F.replace("gram", F.lit(" "), F.lit(""))) + 1)
    return grams.select(F.expr("substring(key, length(gram) + 3)").alias("lang"), "gram", k.alias("k"), "n")


def mine(docs: DataFrame, length: int = LENGTH, least: int = LEAST, masked: int = MASKED, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    folder, tables = scratch(spark, "phrases"), []
    with shuffles_removed(spark):
        for k in range(1, length + 1):
            tables.append(spark.sparkContext.broadcast(bit_table(frequent_hashes(texts, k, tables, least, bits), bits)))
        level_table(texts, length, tables, least).write.parquet(folder)
    return best(spark.read.schema(LEVELS).parquet(folder), masked, top)


def best(levels: DataFrame, masked: int, top: int) -> DataFrame:
    """Cuts scored from the level tables (lang, gram, n, k), masked phrases left out, the first `top` of each language."""
    phrases = levels.where("k > 1").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "k")
    known = levels.where("k > 0").select("lang", "gram", "n")
    parts = phrases.withColumn("_w", F.split("phrase", " ")).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = parts.select("lang", "a", "cut", F.expr("array_join(slice(_w, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(_w, cut + 1, k - cut), ' ')").alias("right"))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("gram").alias(part), F.col("n").alias(name)), ["lang", part])
    cuts = cuts.withColumn("phrase", F.concat_ws(" ", "left", "right"))
    wide = {x: F.col(x).cast("decimal(38,0)") for x in "alr"}
    scored = cuts.withColumn("_up", F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"]).withColumn("_down", wide["l"] * wide["r"]).withColumn("score", F.expr("_up div _down"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
    inner = phrases.where("k > 2").withColumn("_w", F.split("phrase", " ")).withColumn("_m", F.explode(F.expr("sequence(2, k - 1)")))
    inner = inner.withColumn("_s", F.explode(F.expr("sequence(1, k - _m + 1)"))).groupBy("lang", F.expr("array_join(slice(_w, _s, _m), ' ')").alias("phrase")).agg(F.max("a").alias("_longer"))
    open_ = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < masked * F.col("a"))).drop("_longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = max(RANKED_PARTS, -(-phrases.count() // RANKED_ROWS))
    salted = open_.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(share)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = levels.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(length: int = LENGTH, least: int = LEAST, masked: int = MASKED, top: int = TOP) -> str:
    """The same phrases as DuckDB SQL."""
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, {length + 1}) t(k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS MATERIALIZED (SELECT lang, k, g, n AS a, string_split(g, ' ') AS s FROM f WHERE k > 1),
j AS MATERIALIZED (SELECT lang, g, a, j, array_to_string(s[1:j], ' ') AS x, array_to_string(s[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
b AS (SELECT j.lang, j.g, a, min({{'score': (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n), 'j': j, 'l': l.n, 'r': r.n}}) AS m FROM j JOIN f l ON l.lang = j.lang AND l.g = j.x JOIN f r ON r.lang = j.lang AND r.g = j.y GROUP BY ALL),
i AS (SELECT lang, array_to_string(s[z:z + m - 1], ' ') AS g, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS z FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY m.score DESC, a DESC, b.g) AS rank, b.g AS phrase, a, m.l AS l, m.r AS r, n.n, m.score::BIGINT AS score
FROM b LEFT JOIN i USING (lang, g) JOIN n ON n.lang = b.lang WHERE longer IS NULL OR 100 * longer < {masked} * a QUALIFY rank <= {top}"""
