"""Each stage of the corpus pipeline against a plain version on its own input."""

import collections

import numpy as np
import pytest
from test_llm_operators import DOCS, brute_components, brute_coverage, brute_quality, check_packing

import corpus_pipeline
from plumbline.llm import jaccard, mixing, packing, quality, queries, toxicity


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def plain_quality(docs):
    def keeps(text):
        *_, base = brute_quality(text)
        n_words, chars = brute_quality(text)[:2]
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if line.strip("\x20\t\n\x0b\x0c\r"):
                dup += len(line) if line in seen else 0
                seen.add(line)
        inside, marks = brute_coverage(text)
        fine = dup <= quality.MAX_DUP_LINE_SHARE * chars and marks <= quality.MAX_DUP_MARK_SHARE * chars
        return not base and fine and all(got <= most * chars for got, most in zip(inside, quality.GRAMS.values(), strict=True))

    return collections.Counter(tuple(r) for r in docs.collect() if keeps(r["text"]))


def plain_toxicity(spark, docs, folder):
    """The grammar learned in memory from the corpus's labelled rows, and each document judged by itself."""
    corpus, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learned = toxicity.training_rows(corpus, labels).collect()
    grammar = toxicity.fit([r["text"] for r in learned], [r["label"] for r in learned])
    return collections.Counter(tuple(r) for r in docs.collect() if toxicity.judge(r["text"], grammar, toxicity.lexer(grammar.stems))[0] < toxicity.THRESHOLD)


def plain_near_duplicates(docs):
    rows = docs.collect()
    least = {}
    for doc, _, component in brute_components([(r["doc_id"], r["text"]) for r in rows]):
        least.setdefault(doc, set()).add(component)
    return collections.Counter(tuple(r) for r in rows if r["doc_id"] in least[r["doc_id"]])


def check_mixing(spark, docs, folder, after):
    """Each document as often as its rate rounds to, and rates that meet the targets with no lower squared distance to one near."""
    labels = mixing.language_labels(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = mixing.mix(docs, labels).collect()
    p, t, x = np.array([r.posteriors for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    assert np.allclose(x @ (p * t[:, None]) / t.sum(), [mixing.TARGETS[d] for d in sorted(mixing.TARGETS)], atol=1e-5) and (x >= 0).all()
    # Among all rates that meet the targets these are, where none is at its bound, the nearest to one in the tokens' weights.
    if (x > 0).all():
        gap, *_ = np.linalg.lstsq(p, x - 1.0, rcond=None)
        assert np.allclose(p @ gap, x - 1.0, atol=1e-6)
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.copies
        assert abs(r.copies - r.rate) < 1
    assert collections.Counter(r["doc_id"] for r in after.select("doc_id").collect()) == +want
    assert set(rows_of(after)) <= set(rows_of(docs))


def check_packed(docs, after):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = after.collect()
    want = collections.Counter((r["doc_id"], len(exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r["length"])
    assert {d: sum(v) for d, v in pieces.items()} == {d: sum(n * k for (e, n), k in want.items() if e == d) for d in {e for e, _ in want}}
    bins, tokens = check_packing(rows, packing.CAPACITY), sum(r["length"] for r in rows)
    assert bins <= 1.05 * -(-tokens // packing.CAPACITY) + 1


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns
        if name == "quality rules":
            assert rows_of(after) == plain_quality(docs)
        elif name == "toxicity":
            assert rows_of(after) == plain_toxicity(spark, docs, small)
        elif name == "near duplicates":
            assert rows_of(after) == plain_near_duplicates(docs)
        elif name == "mixing to targets":
            check_mixing(spark, docs, small, after)
        else:
            check_packed(docs, after)
        docs = after


@pytest.fixture(scope="module")
def strange(spark):
    """Null, empty, blank, repeated and long texts, a null id, and columns that operators use as names of their own."""
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None, "en", "x", "y"), (2, "", "en", "x", "y"), (3, " \n", "en", "x", "y"), (4, words, "en", "x", "y"), (4, words, "en", "x", "y"), (5, words, "fr", "x", "y"), (None, words + " z", None, "x", "y"), (6, " ".join(f"v{k}" for k in range(12_000)), "de", "x", "y")]
    return spark.createDataFrame(rows, DOCS).withColumnsRenamed({"n_words": "component_id", "score": "held_out"})


@pytest.mark.parametrize("k", range(5))
def test_stages_on_strange_and_empty_tables(spark, small, strange, k):
    name, stage = corpus_pipeline.STAGES[k]
    got, none = stage(spark, strange, small), stage(spark, strange.limit(0), small)
    assert none.count() == 0 and none.columns == got.columns
    if k < 4:
        assert got.columns == strange.columns and set(rows_of(got)) <= set(rows_of(strange))
    if name == "toxicity":
        assert rows_of(got) == rows_of(strange)
    if name == "near duplicates":
        assert sorted(r["doc_id"] for r in got.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6]
        assert jaccard.keep_first(strange.limit(0)).count() == 0
    if name == "best-fit packing":
        assert got.where("doc_id = 4").count() == 2


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(names)
