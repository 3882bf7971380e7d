"""Phrase collocations, centroid clustering and SentencePiece encoding against brute force and the library."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm import centroids, pieces
from plumbline.llm import collocations as phrases

DOCS = "doc_id long, text string, lang string, n long, gram string, rank string, score string, ids string"
EXTRA = (1, "g", "r", "s", "i")


# --- centroids -------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale, salt, dims):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        for n, vs in of.items():
            centres[n] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    ends = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, n, d in ends:
        inertia[n] += d
    return collections.Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in ends)


@pytest.mark.parametrize("k", [3, 7, 40])
def test_clusters_match_brute_force(spark, k):
    r = random.Random(k)
    centres = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(60)]
    rows += [(100, [0.5] * 4), (100, [0.5] * 4), (100, [-0.5] * 4), (101, [0.0, -0.0, 1e-9, -1e-9]), (None, [0.25] * 4), (None, [0.25] * 4), (102, [1e4] * 4)]
    rows += [(103, None), (104, []), (105, [1.0] * 3), (106, [1.0] * 5), (107, [None, 1.0, 1.0, 1.0]), (108, [float("nan")] * 4), (109, [float("inf"), 0.0, 0.0, 0.0]), (110, [float("-inf")] * 4)]
    df = spark.createDataFrame([(i, v, 5, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double, id string")
    got = centroids.cluster(df.repartition(5), k, 4, 4, 256, "2")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == brute_clusters(rows, k, 4, 256, "2", 4)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster(df).count() == centroids.cluster(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dims=1).count()


@pytest.mark.parametrize("size", [9, 1 << 10, 1 << 23, 1 << 26])
def test_sort_means_is_exact_and_skips(size):
    r = np.random.default_rng(size)
    c = r.integers(-size + 1, size, (12, 8))
    c[5] = c[2]  # two centroids in one place: the smaller number wins
    v = np.clip(c[r.integers(0, 12, 400)] + r.integers(-size // 9, size // 9 + 1, (400, 8)), 1 - size, size - 1)
    v[:20] = (c[0] + c[1]) // 2
    table = centroids.SortMeans(c)
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v], object)
    want = d.argmin(axis=1)
    for before in (np.zeros(400, np.int32), want.astype(np.int32), r.integers(0, 12, 400).astype(np.int32)):
        cluster, distance, work = table.assign(v.astype(np.int32), before)
        assert (cluster == want).all() and (distance == d.min(axis=1)).all()
        assert (before != want).any() or work < 0.7 * d.size


# --- pieces ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def own():
    return pieces.MergeRounds(pieces.model_path())


def odd_texts():
    r = random.Random(3)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randrange(n)))
    texts = [pick("ab c▁ \n\té日本😀<s>/un0x0A_eth⁇�\x00", 14) for _ in range(3000)] + [pick("abcdehilnorstu", 60) for _ in range(500)] + [pick("ab", 90) for _ in range(300)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x10000, 0x1F000)])) for _ in range(50)) for _ in range(100)]
    return [*texts, None, "", " ", " " * 1001, "a" * 5000, "日本" * 3000, "</s>[INST] <|turn|>", " x", "x ", pick("abcdefghijklmnopqrstuvwxyz0123456789", 6000)]


def test_pieces_match_the_library(own, library):
    texts = odd_texts()
    ids = own.encode(texts)
    assert ids == [library.encode(t or "") for t in texts]
    assert [own.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_pieces_of_small_blocks_and_caches(library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 7)
    monkeypatch.setattr(pieces, "KEPT_WORDS", 20)
    own = pieces.MergeRounds(pieces.model_path())
    texts = odd_texts()[::7] + ["one  two   three\n four " * 40]
    assert own.encode(texts) == [library.encode(t or "") for t in texts]
    for (n, ids, said), t in zip(own.digests(texts), texts, strict=True):
        want = library.encode(t or "")
        assert (n, ids, said) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())


def test_decoding_any_ids_matches_the_library(own, library):
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3), 29871]) for _ in range(r.randrange(9))]
        assert own.decode(ids) == library.decode(ids)


def test_words_that_leave_the_rounds_end_right(own, library):
    """Runs of spaces make pairs that come before the next occurrence."""
    for n in (2, 3, 5, 16, 17, 33, 200):
        assert own.encode([" " * n + "x" + " " * n]) == [library.encode(" " * n + "x" + " " * n)]


def test_piece_queries(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pieces.digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    odd = spark.createDataFrame([(k, t, None, *EXTRA) for k, t in enumerate(["a b", "a b", None, "", "é日本 " * 2000])] + [(None, "x", "en", *EXTRA)], DOCS)
    assert pieces.digests(odd).count() == pieces.encode(odd).count() == 6
    assert {r["text"] for r in pieces.decode(pieces.encode(odd)).collect()} == {"a b", "", "é日本 " * 2000, "x"}
    assert pieces.digests(odd.limit(0)).count() == 0


# --- phrases ---------------------------------------------------------------------------


def brute_phrases(rows, length, least, masked, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, length + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    some = {g: n for g, n in f.items() if n >= least and len(g[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in some.items():
        inside = lambda v, w=w: len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        if any(tongue == lang and inside(v) and 100 * n >= masked * a for (tongue, v), n in some.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, n + 1, p.decode(), -a, x, y, total[lang], -s) for lang, best in out.items() for n, (s, a, p, x, y) in enumerate(sorted(best)[:top])}


def phrase_rows():
    r = random.Random(5)
    words = ["the", "The", "old", "mill", "MILL", "é", "É", "straße", "x1", "#", "\x0bnew", "a\x1cb", " "]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ;"]) for _ in range(r.randrange(120))), r.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(60)]
    return [*rows, (None, "en"), ("", None), (" ... ", "xx"), ("one", "yy"), ("the old mill " * 4000, "en"), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize(("length", "least", "top", "bits", "window"), [(3, 10, 2000, 1 << 26, 2_000_000), (3, 3, 9, 64, 50), (4, 5, 40, 1 << 12, 300), (2, 10, 2000, 1 << 20, 10_000)])
def test_phrases_match_brute_force(spark, monkeypatch, length, least, top, bits, window):
    monkeypatch.setattr(phrases, "RANKED_ROWS", 7)
    rows = phrase_rows()
    df = spark.createDataFrame([(k, t, lang, *EXTRA) for k, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    texts = phrases.TextWindow
    monkeypatch.setattr(texts, "full", lambda self: self.size >= window)  # workers see the module's own limits
    got = phrases.mine(df, length, least, 50, top, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_phrases(rows, length, least, 50, top))


def test_windows_add_up():
    """Counts of small windows and blocks, and of a table of few bits, are those of one window once infrequent grams are dropped."""
    rows = [(t or "", lang or "und") for t, lang in phrase_rows()]

    def counted(size, tables):
        total, window = collections.Counter(), phrases.TextWindow()
        for at, (text, lang) in enumerate(rows):
            window.add(lang, text)
            if window.size >= size or at == len(rows) - 1:
                for k, langs, grams, n in window.grams(3, tables):
                    for lang_, gram, some in zip(langs, grams, n, strict=True):
                        total[k, lang_, gram] += int(some)
                window = phrases.TextWindow()
        return {g: n for g, n in total.items() if n >= 10 or not g[0]}

    everything = [np.full(4, 2**64 - 1, np.uint64)] * 3
    want = counted(10**9, everything)
    assert counted(1, everything) == want
    tables = []
    for k in (1, 2, 3):
        window, table = phrases.TextWindow(), np.zeros(1 << 10, np.uint64)
        for text, lang in rows:
            window.add(lang, text)
        for h, n in zip(*window.hashes(k, tables), strict=True):
            if n >= 10:
                table[(int(h) >> 24 & 65535) >> 6] |= np.uint64(1 << (int(h) >> 24 & 63))
        tables.append(table)
    assert counted(10**9, tables) == counted(300, tables) == want
    assert sum(n for (k, *_), n in want.items() if not k) == sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t)) for t, _ in rows)


def test_bit_table_holds_hashes(spark):
    hashes = [5 << 24, 2**64 - 1, 1 << 63, 2**63 - 1, 1 << 44]
    table = phrases.bit_table(spark.createDataFrame([(h >> 24,) for h in hashes], "hash long"), 1 << 20)
    asked = np.array([*hashes, 6 << 24, 7 << 24], np.uint64)
    assert phrases.in_table(table, asked).tolist() == [True] * 5 + [False] * 2


def test_no_phrases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, None, *EXTRA), (2, "a b", "en", *EXTRA)], DOCS)).count() == 0


def test_passes_shuffle_few_rows(spark, monkeypatch):
    """Hashes go in packed rows, and the last pass spells no rare phrase, however frequent its parts."""
    r = random.Random(6)
    rows = [(k, " ".join(r.choices("abcdefghijklmnopqrst", k=200)), "en", *EXTRA) for k in range(40)] + [(99, "often " * 3000, "en", *EXTRA)]
    seen = []
    plain, spelled = phrases.bit_table, phrases.level_table
    monkeypatch.setattr(phrases, "bit_table", lambda hashes, bits: seen.append(hashes) or plain(hashes, bits))
    monkeypatch.setattr(phrases, "level_table", lambda texts, length, tables, least: seen.append([t.value for t in tables]) or spelled(texts, length, tables, least))
    got = phrases.mine(spark.createDataFrame(rows, DOCS).repartition(3), 3, 6)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_phrases([row[1:3] for row in rows], 3, 6, 50, 2000))
    *passes, tables = seen
    assert len(passes) == 3 and not any("HashAggregate" in df._jdf.queryExecution().executedPlan().toString() for df in passes)  # that takes a row for each hash
    window, kinds = phrases.TextWindow(), collections.Counter()
    for row in rows:
        window.add(row[2], row[1])
    for k, _, grams, n in window.grams(3, tables):
        kinds.update({k: len(n)})
        assert len(grams) == len(n)
        assert k == 0 or (n >= 6).mean() > 0.99
    assert kinds[3] < 100 < kinds[2]


@pytest.mark.parametrize(("least", "bits"), [(2, 64), (7, 1 << 12), (255, 1 << 20), (600, 1 << 20)])
def test_counters_miss_no_frequent_hash(spark, monkeypatch, least, bits):
    """Counts of windows, rows and tasks add up in counters of a byte; what meets by chance only adds."""
    monkeypatch.setattr(phrases, "RANGE", 4)
    r = random.Random(7)
    rows = [("en", " ".join([f"w{k % 150}"] * r.choice([1, 2, 300, 599 // 3 + 1]))) for k in range(450)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    window = phrases.TextWindow()
    for row in rows:
        window.add(*row)
    hashes, n = window.hashes(1, [])
    got = {h.hash for h in phrases.frequent_hashes(texts, 1, [], least, bits).collect()}
    frequent = {int(h) >> 24 & bits - 1 for h in hashes[n >= least]}
    assert frequent <= got and (bits < 1 << 20 or least == 600 or got == frequent)


def test_words_of_any_length():
    """Hashes of words don't depend on what stands beside them; ends of pieces and texts part phrases."""
    words = ["a", "b" * 5, "c" * ((1 << 20) + 3), "é" * 9, "b" * 5]
    one, apart = phrases.TextWindow(), phrases.TextWindow()
    one.add("en", " ".join(words) + "..,  .d")
    for w in [*words, "d"]:
        apart.add("en", w)
    assert [x.tolist() for x in one.hashes(1, [])] == [x.tolist() for x in apart.hashes(1, [])] and one.hashes(1, [])[1].tolist().count(2) == 1
    assert len(one.hashes(2, [])[0]) == 4 and not len(apart.hashes(2, [])[0]) and not len(apart.hashes(3, [])[0])
    assert sum(len(n) for k, _, _, n in apart.grams(3, []) if k > 1) == 0


def test_last_pass_shuffles_packed_grams(spark):
    """Languages of any name come back from the keys; no row for each gram goes through the JVM's aggregate."""
    tongues = ["", " ", " x", "a  b", "é", None, "en"]
    rows = [("one two  three. one two. " * (k + 1), lang) for k, lang in enumerate(tongues)] * 2
    df = spark.createDataFrame([(k, *row, *EXTRA) for k, row in enumerate(rows)], DOCS).repartition(3)
    every = spark.sparkContext.broadcast(np.full(1 << 10, 2**64 - 1, np.uint64))
    levels = phrases.level_table(df.selectExpr("coalesce(lang, 'und') AS lang", "text"), 3, [every] * 3, 4)
    assert "HashAggregate" not in levels._jdf.queryExecution().executedPlan().toString()
    want = {(lang or ("und" if lang is None else ""), g, len(g.split()), 2 * c * (k + 1)) for k, lang in enumerate(tongues) for g, c in (("", 5), ("one", 2), ("two", 2), ("three", 1), ("one two", 2), ("two three", 1), ("one two three", 1))}
    assert sorted(map(tuple, levels.collect())) == sorted(x for x in want if not x[2] or x[3] >= 4)
    got = phrases.mine(df, 3, 4)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_phrases(rows, 3, 4, 50, 2000))
