"""The queries of this folder's operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import ann, bpe, jaccard, packing, pii, quality, secrets, toxicity, unigram, winnowing
from lumenfold.llm.common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_neighbours, op2_winnowing, op3_quality, op4_toxicity, op5_token_counts, op6_jaccard, op7_secrets, op8_packing, op9_bpe, op10_pii)
    return {f.__name__: f for f in made}


def _secrets_sql() -> str:
    """Each rule by DuckDB's own regexes: what lies between matches gives their places."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT rid, {i} AS k, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS q FROM d WHERE regexp_matches(t, '{p}')))
            WHERE length(q[i]) >= {r.least}"""
        )
    base = ", ".join(str(i) for i, r in enumerate(secrets.RULES) if r.base)
    counts = ", ".join(f"count(k) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.RULES) if r.base)
    item = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), spans AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY s, k) FILTER (k IN ({base})), '')) AS base_sha256, "
        f"coalesce(string_agg({item}, ',' ORDER BY s, k), '') AS spans FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"
    )


#: Links by an inverted index over shingles, classes by a recursive walk along links. For small tables.
_JACCARD_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
copies AS (SELECT array_to_string(w, ' ') AS c, any_value(w) AS w, min(doc_id) AS id, count(*) AS size FROM words GROUP BY 1),
shingles AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN c ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM copies WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT a.id AS u, b.id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id GROUP BY a.id, b.id, x.n, y.n HAVING count(*) * 5 >= (x.n + y.n - count(*)) * 4),
reach AS (SELECT id AS u, id AS v FROM copies UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
class AS (SELECT u AS id, min(v) AS class_id FROM reach GROUP BY 1),
totals AS (SELECT class_id, sum(size)::BIGINT AS class_size FROM class JOIN copies USING (id) GROUP BY 1),
degree AS (SELECT u AS id, count(*) AS texts, sum(size)::BIGINT AS docs FROM links JOIN copies ON v = id GROUP BY 1)
SELECT doc_id, class_id, class_size, size - 1 + coalesce(docs, 0) AS n_links, coalesce(texts, 0) AS n_text_links
FROM words JOIN copies ON array_to_string(words.w, ' ') = c JOIN class USING (id) JOIN totals USING (class_id) LEFT JOIN degree USING (id)"""


def oracle_sql() -> dict[str, str]:
    """For those that SQL can express: the others hold models, approximate searches, hashes or tokenizers."""
    return {"op6_jaccard": _JACCARD_SQL, "op7_secrets": _secrets_sql()}
