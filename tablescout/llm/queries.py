"""The operators over their whole tables with production parameters, as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import (
    byte_bpe,
    decontaminate,
    filter_audit,
    grid_join,
    line_dedup,
    logbilinear,
    secrets,
    sharding,
    simhash,
    source_audit,
    token_counts,
    toxicity,
    url_rules,
)
from tablescout.llm.audit_sql import OP11_SQL, OP12_SQL, OP13_SQL
from tablescout.llm.common import in_fold, small_batches

#: Rules over URLs: verdict, and host with path.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

TOXIC_FROM = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.learn_toxicity(documents, labels.select("doc_id", "toxic"), ~in_fold("doc_id", 3, 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    judged = table(spark, sf_dir, "documents").select("doc_id", toxicity.toxicity_column(F.col("text"), model).alias("t"))
    return judged.select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "t.score",
        (F.col("t.score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("t.passages").alias("n_passages"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", *byte_bpe_digests())


def byte_bpe_digests() -> list:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = logbilinear.language_scores(table(spark, sf_dir, "documents"), ~in_fold("doc_id", 5, 1))
    return scored.select(
        "doc_id", in_fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.filter_orders(filter_audit.mask_counts(table(spark, sf_dir, "documents"), labels))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = secrets.KINDS[:3]
    return found.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(secrets.span_list(*base), 256).alias("base_sha256"), secrets.span_list(*secrets.KINDS).alias("spans"),
    )


#: Rules over URLs as rows of the SQL form, longest first.
_RULE_ROWS = ", ".join(
    f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in URL_RULES
)

OP4_SQL = f"""
WITH parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), rules(verdict, rule, rule_host, rule_path) AS (VALUES {_RULE_ROWS}
), judged AS (
    SELECT page_id, host, path, rule, verdict FROM split LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged
"""

OP8_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT doc_id, pos, line, coalesce(doc_id < last, FALSE) AS goes FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
    SELECT vec_id, label, v FROM vectors
    WHERE label IS NOT NULL AND v IS NOT NULL AND list_count(v) = len(v)
      AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(node, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT node, w FROM reach JOIN links ON other = u
), named AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
), counted AS (
    SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN named ON vec_id = node LEFT JOIN counted ON vec_id = u
"""

OP10_SQL = r"""
WITH docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), item_shingles AS (
    SELECT DISTINCT item_id, least(5, len(w)) AS size, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS shingle
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), doc_shingles AS (
    SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS shingle
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM docs, (SELECT DISTINCT size FROM item_shingles) WHERE len(w) >= size)
), sizes AS (
    SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
)
SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared,
       count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM item_shingles JOIN doc_shingles USING (size, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * any_value(n) - 1e-9)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": OP4_SQL, "op8_line_dedup": OP8_SQL, "op9_near_vectors": OP9_SQL, "op10_decontamination": OP10_SQL,
        "op11_filter_audit": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_secrets": OP13_SQL,
    }


def queries() -> dict:
    own = [
        op1_toxicity, op2_token_counts, op3_sharding, op4_url_filter, op5_simhash, op6_byte_bpe, op7_lm_scores,
        op8_line_dedup, op9_near_vectors, op10_decontamination, op11_filter_audit, op12_source_audit, op13_secrets,
    ]
    return {query.__name__: query for query in own}
