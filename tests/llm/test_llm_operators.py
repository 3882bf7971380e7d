"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from plumbline.llm import chat, extract, jaccard, media, mixing, packing, quality, tokens, toxicity, urls

DOCS = "doc_id long, text string, lang string, n_words string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated, very long and tied texts, a null id, and clashing extra columns."""
    rows = [
        (1, None, "en", "x", "y"), (2, "", "en", "x", "y"), (3, " \t\n", "en", "x", "y"), (4, "one two three", "en", "x", "y"),
        (5, "the same text of nine words is here twice", "en", "x", "y"), (5, "the same text of nine words is here twice", "en", "x", "y"),
        (6, "the same text of nine words is here twice", "en", "x", "y"), (None, "no id but some words in it", None, "x", "y"),
        (7, "a" * 5000, "en", "x", "y"), (8, " ".join(f"w{k}" for k in range(30_000)), "en", "x", "y"), (9, "é日本 😀 </s>[INST] <|turn|> \\", "fr", "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# --- quality ---------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = collections.Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), base


def brute_coverage(text):
    """Characters inside repeated word n-grams by length, and inside repeated punctuation n-grams."""
    text, out = text or "", []
    words = WORD.findall(text)
    for n in quality.GRAMS:
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        counts = collections.Counter(grams)
        inside = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(n)}
        out.append(sum(len(words[k]) for k in inside))
    mark = re.compile(r"(?=([!-/:-@\[-`{-~\x20\x09-\x0D]{3}))")
    found = [(m.start(), m[1]) for m in mark.finditer(text) if not re.fullmatch(r"[\x20\x09-\x0D]+", m[1])]
    counts = collections.Counter(g for _, g in found)
    return out, len({k + j for k, g in found if counts[g] > 1 for j in range(3) if not re.match(r"[\x20\x09-\x0D]", text[k + j])})


def test_coverage_matches_brute_force(small):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += [None, "", "###", "a### b### c%%%", "#### ####", "!!! ??? !!!", "é### 日###", "a b c d e a b c d e", "x " * 500]
    for t in texts:
        p = quality.profile(t)
        assert (p[6], p[7]) == brute_coverage(t)
    assert quality.verdict(quality.profile(" ".join(f"word{k}###" for k in range(40))))[2] == "repeated marks"


def test_quality_matches_brute_force(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd.select("doc_id", "text"))
    texts = [r["text"] for r in docs.orderBy("doc_id", "text").collect()]
    rows = quality.score(docs).collect()
    assert collections.Counter(map(brute_quality, texts)) == collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert all(not r.kept for r in rows if r.base_failed)


def test_quality_verdict_follows_labels(spark, small):
    docs = spark.read.parquet(f"{small.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{small.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    rows = quality.score(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_keep_leaves_columns(odd, none):
    assert quality.keep(odd).columns == odd.columns
    assert {r["doc_id"] for r in quality.keep(odd).collect()} == {8}
    assert quality.keep(none).count() == quality.score(none).count() == 0


# --- toxicity --------------------------------------------------------------------------


def made_toxic(n, seed, words=("blorgs", "snarfen")):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ke") for b in ("lu", "sa", "ni", "po", "go") for c in ("", "do", "vek", "lin", "tam", "ur")]
    texts, labels = [], []
    for k in range(n):
        body = [rng.choice(vocabulary) for _ in range(60)]
        if k % 4 == 0:
            for w in words:
                body.insert(rng.randrange(60), w)
        texts.append(" ".join(body) + ".")
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_learns_and_scores_clauses():
    grammar = toxicity.fit(*made_toxic(600, 1))
    automaton = toxicity.lexer(grammar.stems)
    texts, labels = made_toxic(300, 2)
    got = [toxicity.judge(t, grammar, automaton)[0] >= toxicity.THRESHOLD for t in texts]
    assert np.mean([g == bool(y) for g, y in zip(got, labels, strict=True)]) > 0.98
    plain = toxicity.judge("you blorgs and snarfen", grammar, automaton)
    negated = toxicity.judge("you are not blorgs", grammar, automaton)
    reported = toxicity.judge("he said: blorgs", grammar, automaton)
    assert plain[2] == 2 and plain[3][1] > 0 and negated[2] == 1 and negated[3][2] > 0 and reported[2] == 1 and reported[3][3] > 0
    assert plain[0] > negated[0] and plain[0] > reported[0]


def paths(fst, state, symbols):
    """All accepted paths of one machine, arc by arc: (weight, outputs)."""
    if not symbols:
        return [(0.0, ())] if state in fst.final else []
    return [(w + v, (written, *rest)) for written, w, to in fst.arcs[state].get(symbols[0], ()) for v, rest in paths(fst, to, symbols[1:])]


def test_best_path_equals_all_paths_through_the_five_machines():
    rng = random.Random(6)
    machines = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.threat(), toxicity.insult()]
    for _ in range(400):
        symbols = tuple(rng.choices(range(7), (6, 3, 2, 2, 1, 2, 2), k=rng.randint(1, 7)))
        found = [(0.0, symbols)]
        for m in machines:
            found = [(w + v, out) for w, given in found for v, out in paths(m, 0, given)]
        total, path = toxicity.best_path(toxicity.grammar_machine(), [[(s, 0.0)] for s in symbols])
        best = max(found, key=lambda f: f[0])[0]
        kinds = {tuple(s for s in out if s in toxicity.KIND_OF) for w, out in found if w == best}
        assert total == best and tuple(k for k, _ in path) in kinds
        spread = [[(toxicity.OTHER, 0.0)]] * rng.randint(0, 9) + [[(s, 0.0)] for s in symbols] + [[(toxicity.OTHER, 0.0)]] * rng.randint(5, 20) + [[(symbols[0], 0.0)]]
        assert toxicity.best_path(toxicity.grammar_machine(), spread) == toxicity.best_path(toxicity.grammar_machine(), toxicity.squeezed(spread))


@pytest.mark.parametrize(
    "text,kind",
    [
        ("what a blorg of a day", 0), ("you are a blorg", 1), ("a blorg is he", 1), ("that is not a blorg at all", 2), ("it is said blorg is here", 3),
        ("he said to every one of the people who were standing right there that day: blorg", 3), ("we will at last destroy it", 4), ("never will hurt any", 5),
        ("blorg", None), ("hurt", None), ("the hunt went on", None), ("blorgy and unblorg", None),
    ],
)
def test_clauses_by_kind(text, kind):
    grammar = toxicity.Grammar({"blorg": 5.0}, frozenset({"blorg"}), (1.0,) * 6, -2.0)
    weights = toxicity.judge(text, grammar, toxicity.lexer(grammar.stems))[3]
    assert [k for k, w in enumerate(weights) if w] == ([] if kind is None else [kind])


def test_one_bound_at_every_number_of_labelled_rows():
    for toxic in (199, 201):
        assert toxicity.choose([("blorg", True, 20, 0, 20)], toxic, 2000)[0] and not toxicity.choose([("blorg", True, 20, 9, 20)], toxic, 400)[0]
    assert not toxicity.choose([("blorg", True, 20, 0, 2)], 200, 2000)[0]  # copies of two texts


def test_learning_by_spark_equals_learning_in_memory(spark):
    texts, labels = made_toxic(400, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    keep = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    want, got = toxicity.fit([texts[k] for k in keep], [labels[k] for k in keep]), toxicity.train(docs, marks)
    assert got.stems == want.stems and got.stems and got.whole == want.whole
    assert np.allclose(got.weights, want.weights) and np.isclose(got.bias, want.bias)
    scored = {r.doc_id: r for r in toxicity.score(docs, got).collect()}
    automaton = toxicity.lexer(got.stems)
    assert all(np.isclose(scored[k].score, toxicity.judge(t, got, automaton)[0]) for k, t in enumerate(texts))


def test_long_clauses_and_clashing_columns(odd):
    grammar = toxicity.Grammar({"blorg": 5.0}, frozenset({"blorg"}), (1.0,) * 6, -2.0)
    for text, clauses in (("blorg " * 200_000, 1), ("word " * 400_000 + "blorg", 1), (": blorg" * 200_000, 0), (": a blorg" * 100_000, 100_000)):
        began = time.perf_counter()
        assert toxicity.judge(text, grammar, toxicity.lexer(grammar.stems))[1] == clauses
        assert time.perf_counter() - began < 20
    clash = odd.withColumnsRenamed({"n_words": "held_out", "score": "label", "lang": "predicted"})
    assert toxicity.keep(clash, grammar).columns == clash.columns and toxicity.keep(clash, grammar).count() == clash.count()


def test_toxicity_held_out_rows_and_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
    held = {d for d in (4, 5, 7) if zlib.crc32(str(d).encode()) % 3 == 1}
    assert toxicity.training_rows(odd, labels).count() == sum(1 + (d == 5) for d in (4, 5, 7) if d not in held)
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0
    assert toxicity.keep(odd, toxicity.fit([], [])).count() == odd.count()


# --- tokens ----------------------------------------------------------------------------


def test_prefix_table_is_exact(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    own = tokens.PrefixCounter(tokens.model_path())
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()]
    texts += ["", " ", "  \n a", "<s> </s>", "▁x ▁", "日本 😀\t\u3000ﬁ", "a" * 300, "12345 x=1  # y", " " * 40]
    for t in texts:
        assert own.table(t).total == len(sp.encode(t))
        t = t[:120]
        table, want = own.table(t), [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert table.counts() == want
        assert [table.count(k) for k in (0, 1, len(t) // 2, len(t))] == [want[k] for k in (0, min(1, len(t)), len(t) // 2, len(t))]
        for limit in (0, 1, 5, 1000):
            assert table.longest_within(limit) == max(k for k, c in enumerate(want) if c <= limit)


def test_token_counts_edges(odd, none):
    rows = by_id(tokens.count(odd))
    assert rows[1][0].n_tokens == rows[2][0].n_tokens == 0 and rows[1][0].n_bytes == 0
    assert rows[8][0].over_limit and not rows[4][0].over_limit and len(rows[5]) == 2
    assert tokens.count(none).count() == 0
    assert [r.counts[-1] for r in tokens.prefix_counts(odd.where("doc_id = 4")).collect()] == [rows[4][0].n_tokens]


# --- extraction ------------------------------------------------------------------------


def test_extraction_on_made_and_given_pages(spark, small):
    model = extract.default_model()
    maker = extract.Maker(123)
    for _ in range(60):
        page = maker.page()
        got = "".join(extract.extract_many([page], model)[0])
        assert got.count(maker.KEEP) == page.count(maker.KEEP) and maker.DROP not in got
    import html as h

    for r in extract.extract(spark.read.parquet(f"{small}/pages.parquet"), model).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_decoding_never_contradicts():
    page = extract.parse("<body><div><p>a</p><div><p>b</p></div></div><p>c</p></body>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = extract.decode(page, rng.random(len(page.nodes)))
        assert all(kept[n.parent] for k, n in enumerate(page.nodes) if k and kept[k])


def test_extraction_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", "<p>a<p>b &amp c &#65; <script>x<"), (4, "u", "<div <p"), (5, "u", "<p>" * 3000 + "deep")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and got[0].text == got[1].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_extraction_ignores_other_columns_and_counts_deep_links(spark):
    html = "<html><body><article><h1>Title of it</h1>" + "<p>Some words of the main text, and some more of them here.</p>" * 6 + "</article><footer>end</footer></body></html>"
    rows = [(k, "u", html, "x", "y") for k in range(3)]
    plain = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, a string, b string").drop("a", "b")).collect()
    clash = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert clash == plain and plain[0].text.count("main text") == 6
    page = extract.parse("<div><a href=x><b><i><u><em><span>deep link</span></em></u></i></b></a> plain</div>")
    assert sum(n.linked for n in page.nodes) == len("deep link")
    page = extract.parse("<p><a href=x>one <a href=y>two</p><p>three</p>")
    assert sum(n.linked for n in page.nodes) == len("one two")


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "</section>" * 60_000, "<i><div>" + "<b>" * 90_000 + "</i>" * 90_000, "<a '>'" * 90_000, "<script>" + "</script " * 100_000, "<ul>" + "<li><b>x" * 60_000, "<table>" + "<tr><td>" * 60_000])
def test_parsing_is_linear(source):
    began = time.perf_counter()
    extract.parse(source)
    once = time.perf_counter() - began
    assert once < 8


def test_foreign_elements_end_where_they_close():
    texts = lambda source: [t for _, t in extract.parse(source).runs]
    for tag in ("svg", "math", "SVG"):
        assert texts(f'<p>one</p><{tag} class="a" /><p>two</p>') == ["one", "two"]
        assert texts(f"<p>one</p><{tag}/><p>two</p><{tag}><g>in</g></{tag}><p>three</p>") == ["one", "two", "three"]
        assert texts(f"<p>one</p><{tag}><{tag} x='>'>in</{tag}><{tag}/>out</{tag}><p>two</p>") == ["one", "two"]
        assert texts(f"<p>one</p><{tag}><p>two</p>") == ["one", "two"]
    maker = extract.Maker(7)
    page = maker.page()
    got = "".join(extract.extract_many([re.sub("<p", "<svg/><p", page)], extract.default_model())[0])
    assert got.count(maker.KEEP) == page.count(maker.KEEP) > 0


# --- packing ---------------------------------------------------------------------------


def check_packing(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_plans_are_gapless_and_close_to_the_bound():
    for seed in range(40):
        rng = random.Random(seed)
        capacity = rng.choice([10, 60, 2048])
        sizes = collections.Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 6))]) for _ in range(rng.choice([0, 1, 7, 2000])))
        plan = packing.make_plan(dict(sizes), capacity)
        bins = collections.defaultdict(list)
        for s, n in sizes.items():
            assert plan.used[s] == n
            for r in range(n):
                q, o = plan.place(s, r)
                bins[q].append((o, s))
        assert len(bins) == plan.sequences
        for b in bins.values():
            at = 0
            for o, s in sorted(b):
                assert o == at
                at += s
            assert at <= capacity
        least = -(-sum(s * n for s, n in sizes.items()) // capacity)
        assert plan.sequences <= 11 / 9 * max(least, 1) + capacity / 9


def test_reduction_fixes_exact_partners():
    plan, left = packing.Plan(), {7: 3, 3: 2, 5: 1, 1: 9}
    packing.reduce_dominated(left, plan, 10)
    assert plan.fixed >= 2 and left[3] == 0


def test_packing_query(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.pack(odd, 512).collect()
    check_packing(rows, 512)
    want = []
    for r in odd.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids), 512), len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert collections.Counter(want) == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert packing.pack(none).count() == 0


def test_runs_too_long_for_the_fast_library():
    import public_tokenizers

    paths = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)
    for text in (" " * 1_000_000, "a" * 200_000):
        assert packing.encode(text, *paths) == packing.exact_encoder(paths[0]).encode(text, add_special_tokens=False).ids


def test_fast_ids_equal_the_library(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    paths = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ["x <|endoftext|> y", "½ ٣ 😀\u3000 \n\n", " " * 3000, "ab" * 20_000]
    for t in texts:
        assert packing.encode(t, *paths) == library.encode(t, add_special_tokens=False).ids


# --- urls ------------------------------------------------------------------------------


def test_rules_and_parts():
    assert urls.split("HTTP://A.Example.COM/En/x?q#f") == ("a.example.com", "/En/x")
    assert urls.split(None) == urls.split("no scheme") == ("", "")
    assert urls.split("http://h?x/y") == ("h", "") and urls.split("a://b://c/d") == ("b:", "//c/d")
    index = urls.Rules(urls.RULES)

    def fit(u):
        found = index.of(*urls.split(u))
        return found and "".join(found)

    assert fit("http://www.example.com/en/1") == "www.example.com/en/"
    assert fit("http://a.www.example.com/en/1") == "www.example.com/en/"
    assert fit("http://x.example.com/en/") == "example.com/en/" and fit("http://x.example.com/fr/") == "com/"
    assert fit("http://x.net/fr/2") == "net/fr/" and fit("http://x.net/de/") is None and fit("http://xcom/") is None


def test_rules_over_a_table_equal_a_walk_over_all_rules(spark, small):
    def walk(url):
        _, mark, rest = (url or "").partition("://")
        host = re.split("[/?#]", rest, maxsplit=1)[0] if mark else ""
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0] if mark else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [h + p for h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=len, default=None)

    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    extra = ["HTTP://WWW.Example.COM/en/", "http://x.net/es", "http://net/fr/", "ftp://a.b.net/es/?q", None, "://", "no"]
    pages = pages.unionByName(spark.createDataFrame([(-k, u) for k, u in enumerate(extra)], pages.schema))
    assert collections.Counter((r.page_id, *walk(r.url)) for r in pages.collect()) == collections.Counter((r.page_id, r.host, r.path, r.rule) for r in urls.judge(pages).collect())
    rng = random.Random(8)
    rules = {(".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))): "block" for _ in range(60)}
    index = urls.Rules(rules)
    for _ in range(2000):
        host, path = ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        assert index.of(host, path) == max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    many = urls.Rules({(f"h{k}.com", f"/p{k}/"): "block" for k in range(20_000)})
    began = time.perf_counter()
    assert all(many.of(f"a.h{k}.com", f"/p{k}/x") for k in range(20_000)) and many.of("a." * 2_000_000 + "com", "/") is None
    assert time.perf_counter() - began < 5


def test_trees_on_held_out_urls():
    x, y = urls.seed_urls(800, seed=99)
    got = urls.default_filter().scores(x) >= 0.5
    assert np.mean(got == np.array(y, bool)) > 0.93


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "http://x.org/" + "a" * 20_000), (3, "http://x.org/" + "a" * 20_000), (4, "://")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 5 and {r.verdict for r in got} <= {"allow", "block"} and got[2] == got[3]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, host string")).count() == 0
    rows = [(k, f"http://a{k}.example.com/en/{k}", "h", "r") for k in range(5)]
    clash = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    assert urls.judge(clash).collect() == urls.judge(clash.drop("host", "rule")).collect()
    labelled = spark.createDataFrame([(u, y) for u, y in zip(*urls.seed_urls(200), strict=True)], "url string, label int")
    assert urls.labelled(labelled).scores(["http://thre.example.com/en/1"])[0] < 0.5


# --- media -----------------------------------------------------------------------------


def png(payload=b"abc"):
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(payload)) + chunk(b"IEND", b"")


def test_media_round_trip(odd, none):
    for r in media.store(odd).join(odd.dropDuplicates().select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(payload) + 44)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest() and r.media_type == "audio/wav"
        assert media.wav_samples(media.wav(payload)).tobytes() == payload
    assert media.store(none).count() == 0


def test_sniffing_corrects_and_carves(spark):
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c" + bytes(8) + b"\x00\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xda\x00\x02\x11\xff\x00\x22\xff\xd9"
    blobs = [png(), gif, jpeg, media.wav(b"12345678"), b"xx" + png() + b"yy" + jpeg, png()[:-3], b"GIF89a but not really", None, b"", b"BM" + bytes(40)]
    rows = media.correct(spark.createDataFrame([(b, "text/plain") for b in blobs], "data binary, declared_type string").coalesce(1)).collect()
    assert [r.media_type for r in rows[:4]] == ["image/png", "image/gif", "image/jpeg", "audio/wav"]
    assert [(e.type, e.start, e.length) for e in rows[4].embedded] == [("image/png", 2, len(png())), ("image/jpeg", 4 + len(png()), len(jpeg))]
    assert all(r.media_type == "text/plain" and not r.embedded for r in rows[5:])
    none = spark.createDataFrame([], "data binary, declared_type string, media_type string, embedded string")
    assert media.correct(none).count() == 0


@pytest.mark.parametrize("part", [b"%PDF-1", b"PK\x03\x04", b"GIF89a!!!!!!!!,,,,", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02abc", b"RIFF\x00\x00\x10\x00WAVE"])
def test_sniffing_is_linear(part):
    began = time.perf_counter()
    media.sniff(part * (3_000_000 // len(part)), media.scanner())
    assert time.perf_counter() - began < 8


# --- jaccard ---------------------------------------------------------------------------


def brute_components(rows):
    """Smallest doc_id reachable by links, from all pairs of sets."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(table))
        sets.append((doc, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        overlap = collections.Counter(o for g in s for o in index[g])
        for o, c in overlap.items():
            if 100 * c >= 75 * (len(s) + len(sets[o][1]) - c):
                parent[find(k)] = find(o)
        for g in s:
            index[g].append(k)
    least = {}
    for k, (doc, _) in enumerate(sets):
        r = find(k)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return collections.Counter((doc, len(s), least.get(find(k))) for k, (doc, s) in enumerate(sets))


def near_copies(seed):
    """Large groups of near copies with outliers, shared passages and short texts."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, doc = [], 0
    for size, copies, edits in ((150, 90, (0, 14)), (40, 40, (0, 5)), (600, 25, (0, 50)), (12, 30, (0, 2)), (4, 10, (0, 1))):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(copies):
            text = base[:]
            for _ in range(rng.randint(*edits)):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((doc, " ".join(text)))
            doc += 1
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        rows.append((doc, " ".join(own + passage)))
        doc += 1
    rows += [(doc + k, rows[k][1].upper() if k % 2 else rows[k][1]) for k in range(20)]
    return rows


@pytest.mark.parametrize("least,short,block", [(64, 32, 256), (2, 4, 8)])
def test_jaccard_components(spark, monkeypatch, least, short, block):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", least)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCKS", (block, 2 * block))
    rows = near_copies(least)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows)


def test_token_combinations_lose_no_link():
    rng = np.random.default_rng(3)
    universe = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    counts = np.zeros(1 << jaccard.SKETCH_BITS, np.uint64)
    counts[jaccard.bucket(universe)] = 1 + rng.integers(0, 50, len(universe))
    frequency = jaccard.Frequency(counts, 0 if rng.random() < 0.5 else 20)
    for _ in range(300):
        n = int(rng.integers(5, 1500))
        a = rng.choice(universe, n, replace=False)
        lost, gained = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 7 + 1))
        b = np.concatenate([a[lost:], rng.integers(0, 2**63, gained, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if jaccard.links(len(np.intersect1d(a, b)), len(a), len(b)):
            assert len(np.intersect1d(jaccard.signatures(a, frequency), jaccard.signatures(b, frequency)))


def test_jaccard_edges(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = jaccard.join(odd).collect()
    want = brute_components(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    clash = odd.withColumnsRenamed({"n_words": "_first", "score": "component_id", "lang": "_salt"})
    assert jaccard.keep_first(clash).columns == clash.columns and jaccard.keep_first(clash).count() == kept.count()
    assert jaccard.keep_first(none).columns == none.columns and jaccard.keep_first(none).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Each text of a repeated doc_id is judged by its own component; the trainers leave out what is labelled both ways."""
    a, b, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abd")
    rows = [(0, b, "x"), (1, a, "x"), (1, f"{b} more", "x"), (2, d, "x"), (2, d.upper(), "x"), (2, d, "y"), (3, f"{d} e", "x"), (4, None, "x"), (4, "", "x"), (4, None, "y"), (None, f"{a} z", "x"), (None, "alone in its five words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(0, b), (1, a), (2, d.upper()), (4, None), (4, ""), (None, "alone in its five words")], key=str)
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    taught = {(r.label, r.text) for r in toxicity.training_rows(docs, labels).collect()}
    assert taught <= {(1, a), (1, f"{b} more"), (0, f"{d} e")} and taught
    domains = spark.createDataFrame([(0, "en"), (0, "fr"), (1, "en"), (2, "fr"), (3, "fr")], "doc_id long, domain string")
    weights = [mixing.train(x, y, ["en", "fr"]).weights for x, y in ((docs, domains), (docs.repartition(5), domains.repartition(3)))]
    assert (weights[0] == weights[1]).all() and weights[0].any()


def test_tasks_return_forests():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    held = [(k, k, np.unique(np.concatenate([base, rng.integers(0, 2**63, 4, dtype=np.uint64)]))) for k in range(50)]
    block, forest, out = jaccard.Block(held), jaccard.Forest(), []
    for h in held:
        block.links(*h, forest, out)
    assert len(out) == 49 and len({forest.find(k) for k in range(50)}) == 1


def test_star_contraction(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == r for n, r in got.items()) and all(x in got or find(x) == x for x in parent)


# --- mixing ----------------------------------------------------------------------------


def test_mixing_meets_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    targets = {"de": 0.3, "en": 0.3, "es": 0.2, "fr": 0.2}
    rows = mixing.mix(docs, mixing.language_labels(docs, labels), targets, 200_000).collect()
    p = np.array([r.posteriors for r in rows])
    t = np.array([r.n_tokens for r in rows], float)
    x = np.array([r.rate for r in rows])
    assert (x >= 0).all() and np.allclose((x * t) @ p / 200_000, [0.3, 0.3, 0.2, 0.2], atol=1e-3)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([sorted(targets)[k] == truth[r.doc_id] for k, r in zip(p.argmax(1), rows, strict=True)]) > 0.95
    assert all(abs(r.copies - r.rate) <= 1 for r in rows)


def test_rates_equal_a_plain_solver():
    """The fold over residuals is projected gradient on stored rates."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), 50)
    rates = mixing.Rates(1.0, 0.5, 4.0)
    x = y = np.ones(50)
    t = 1.0
    for _ in range(6):
        assert np.allclose(rates.of(p, ahead=True), y)
        r = y @ p / 50 - np.array([0.6, 0.3, 0.1])
        rates.residuals.append(r)
        new = np.clip(y - 0.5 * (p @ r), 0, 4)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    assert np.allclose(rates.of(p), x)


def hot_members(spark, tokens, sharp=0.97):
    """Near-one-hot rows of five tokens each, `tokens` rows a domain."""
    size = len(tokens)
    rows = [(k, 5, [sharp if d == k else (1 - sharp) / (size - 1) for d in range(size)]) for k, n in enumerate(tokens) for _ in range(n)]
    return spark.createDataFrame(rows, mixing.MEMBERS), np.array([r[2] for r in rows])


@pytest.mark.parametrize("tokens", [(10, 970, 10, 10), (2, 93, 3, 2), (1, 1, 1, 997)])
def test_rates_meet_targets_of_rare_domains(spark, tokens):
    members, p = hot_members(spark, tokens)
    rates = mixing.fit_rates(members, mixing.TARGETS)
    got = rates.of(p) @ p / sum(tokens)
    assert rates.met and (rates.of(p) >= 0).all() and np.allclose(got, [0.15, 0.55, 0.12, 0.18], atol=2e-6)
    assert np.allclose(list(rates.shares.values()), got)


def test_rates_tell_of_targets_out_of_reach(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FIRST_LOOK", 10)
    members, p = hot_members(spark, (50, 40, 10, 0))
    with pytest.warns(UserWarning, match="not met"):
        rates = mixing.fit_rates(members, mixing.TARGETS)
    assert not rates.met and rates.of(p).max() < 50
    assert np.allclose(list(rates.shares.values()), rates.of(p) @ p / 100)
    members, p = hot_members(spark, (10, 970, 10, 10))
    with pytest.warns(UserWarning, match="not met"):
        assert mixing.fit_rates(members, mixing.TARGETS, cap=8.0).of(p).max() <= 8


def test_repeated_rows_come_in_bounded_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "le chat noir dort" if k == 0 else f"the dog number {k} barks", None, None, None) for k in range(200)], DOCS)
    labelled = docs.selectExpr("doc_id", "if(doc_id = 0, 'fr', 'en') AS domain").where("doc_id < 20")
    targets = {"en": 0.5, "fr": 0.5}
    monkeypatch.setattr(mixing, "PIECE", 50)
    want = {r.doc_id: r.copies for r in mixing.mix(docs, labelled, targets).collect()}
    assert want[0] > 8
    assert collections.Counter(r.doc_id for r in mixing.resample(docs, labelled, targets).collect()) == +collections.Counter(want)


def test_mixing_edges(odd, none):
    labelled = odd.selectExpr("doc_id", "lang AS domain")
    rows = mixing.mix(odd, labelled, {"en": 0.5, "fr": 0.5}).collect()
    assert len(rows) == odd.count() and all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-6 for r in rows)
    again = mixing.resample(odd, labelled, {"en": 0.5, "fr": 0.5})
    assert again.columns == odd.columns
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert collections.Counter(r["doc_id"] for r in again.collect()) == +want
    assert mixing.mix(none, labelled.limit(0)).count() == mixing.resample(none, labelled.limit(0)).count() == 0


# --- chat ------------------------------------------------------------------------------


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    parts = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "<<SYS>>", "<|end|>", "a", "<", "[", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
        role = rng.choice(["user", "assistant", "", "a\nb", "<|end|>"])
        assert list(chat.read_back(chat.render(role, text)[0])) == [(role, text)]


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 5, "edit", None, "hi!"), (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "wro"), (1, 2, 4, "delta", None, "ng"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "right"), (1, 3, 8, "message", "user", "gone"), (1, 3, 9, "retract", None, None),
        (2, 1, 1, "delta", "user", "opened"), (None, None, None, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = collections.defaultdict(list)
    for r in chat.messages(events).orderBy("position").collect():
        got[r.conv_id] += list(chat.read_back(r.formatted))
    assert got == {1: [("user", "hi!"), ("assistant", "right")], 2: [("user", "opened")], None: [("", "")]}


def test_chat_digest(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said), (-8, 0, "assistant", None), (-8, 0, "assistant", None)], rows.schema))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = chat.digest(chat.as_events(rows)).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(*t)[0]) for t in turns)
    assert chat.digest(chat.as_events(rows.limit(0))).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "</s> \\ word " * 200_000), (1, 1, "assistant", "[INST]" * 100_000)], rows.schema)
    clash = long.selectExpr("*", "1 AS seq", "'edit' AS kind", "'x' AS n_turns")
    assert chat.digest(chat.as_events(clash)).collect() == chat.digest(chat.as_events(long)).collect()
    assert chat.digest(chat.as_events(long)).first().loss_chars == 600_000


def test_logged_messages_fold_to_the_same(spark, small):
    """Deltas, edits and regenerations made of whole messages end in those messages, repeated turns and nulls among them."""
    rows = [(1, 0, "user", "é日本 😀 a"), (1, 0, "assistant", "x"), (1, 0, "user", "é日本 😀 a"), (1, 1, None, None), (1, None, "user", "no turn"), (None, 3, "user", "no id"), (2, 0, "user", ""), (2, 1, "assistant", "a"), (2, 2, "user", "odd " * 999)]
    rows += [(9, k, "assistant", f"</s>[INST] {k} \\ <|end|>") for k in range(40)]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    for df in (odd, real, odd.limit(0)):
        log = chat.as_log(df)
        assert sorted(map(tuple, chat.digest(log.repartition(3)).collect()), key=str) == sorted(map(tuple, chat.digest(chat.as_events(df)).collect()), key=str)
    assert {r.kind for r in chat.as_log(odd).collect()} == {"message", "delta", "edit", "regenerate"}
