"""The registered queries of this subpackage, thin over its operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.llm.common import remainder, table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.webp import media_features, store_texts

    return media_features(store_texts(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.vector_graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.line_dedup import line_report

    found = line_report(table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL), decode=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.impact_index import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelode.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


#: Prefix filtering by the exact document frequency of words; all pairs of classes are verified on their words.
_LINES_SQL = r"""WITH docs AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM docs WHERE text IS NOT NULL),
c AS (SELECT line, min((doc_id, k)) AS first, list_distinct(list_filter(string_split_regex(line, '[ \t\v\f\r]+'), lambda x: x <> '')) AS words FROM l GROUP BY line),
s AS (SELECT line, first, words, len(words) AS n FROM c WHERE len(words) > 0),
w AS (SELECT first, n, unnest(words) AS word FROM s),
f AS (SELECT word, count(*) AS df FROM w GROUP BY word),
p AS (SELECT first, n, word, row_number() OVER (PARTITION BY first ORDER BY df, word) AS pos FROM w JOIN f USING (word)),
q AS (SELECT first, n, word FROM p WHERE pos <= n - ceil(n * 0.8) + 1),
pairs AS (SELECT DISTINCT a.first AS a, b.first AS b FROM q a JOIN q b ON a.word = b.word AND a.first < b.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT b AS first FROM pairs JOIN s x ON x.first = a JOIN s y ON y.first = b WHERE 9 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n)),
g AS (SELECT doc_id, k FROM l JOIN s USING (line) LEFT JOIN m ON m.first = s.first WHERE (doc_id, k) <> s.first OR m.first IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n_removed, string_agg(k::VARCHAR, ',' ORDER BY k) AS removed_lines FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM docs LEFT JOIN r USING (doc_id)"""


_SHARE = "1 + ((coalesce({n}, 0) + 5)::HUGEINT * 1000000000) // ({total} + 5 * V)"

#: Every group with every kept term of its language, absent ones too.
_DIVERGENCE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS df FROM w GROUP BY ALL), v AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
l AS (SELECT lang, count(*) AS V, sum(n) AS total FROM v GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, v.term, c.n AS n, v.n AS all_n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(coalesce(n, 0)) AS total FROM m GROUP BY 1, 2),
p AS (SELECT m.lang, m.source, m.term, m.n, {_SHARE.format(n="m.n", total="t.total")} AS p, {_SHARE.format(n="m.all_n", total="l.total")} AS q FROM m JOIN t USING (lang, source) JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

_TOP_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": _LINES_SQL, "op11_source_divergence": _DIVERGENCE_SQL, "op12_exact_top_k": _TOP_SQL}
