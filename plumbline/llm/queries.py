"""The registered queries of the training-data operators, one opN_<name> each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import centroids, collocations
from plumbline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import mixing

    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.language_labels(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import tokens

    return tokens.count(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import extract

    return extract.extract(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import media

    return media.store(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import quality

    return quality.score(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import chat

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.as_log(rows))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import pieces

    return pieces.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_MARKS = ["'<|'", "'</s>'", "'<s>'", "'<<'", "'<SYS>'", "'</SYS>'", "'[INST]'", "'[/INST]'", "chr(92)"]

#: Where SQL can't express an operator it has no entry here and a brute-force test in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1""",
    "op10_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text) + {" + ".join(f"(length(text) - length(replace(text, {m}, ''))) // length({m})" for m in _MARKS)})::BIGINT AS formatted_chars
FROM t GROUP BY 1""",
    "op11_phrase_collocations": collocations.oracle(),
    "op12_centroid_clustering": centroids.oracle(),
}
