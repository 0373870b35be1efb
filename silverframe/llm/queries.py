"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, seq_len=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.token_codes import read_codes, write_codes

    path = write_codes(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return read_codes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.simhash import near_duplicates

    groups = near_duplicates(table(spark, sf_dir, "documents"), bits=3, shingle=3, seed=42)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP7_SQL = """
WITH n AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
     v AS (SELECT r, vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY embedding, r) AS query_copy, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM n
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.r, q.vec_id AS query_id, q.query_copy, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
           FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score, query_copy
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), width=200)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.warc import build_derivatives

    h = F.col("headers")
    return build_derivatives(table(spark, sf_dir, "pages"), blocks=False).select(
        F.col("source_row").alias("page_id"),
        h["WARC-Type"].alias("record_type"),
        h["WARC-Record-ID"].alias("record_id"),
        h["WARC-Refers-To"].alias("refers_to"),
        h["WARC-Target-URI"].alias("target_uri"),
        h["Content-Type"].alias("content_type"),
        h["WARC-Block-Digest"].alias("block_digest"),
        F.coalesce(h["WARC-Payload-Digest"], h["WARC-Source-Payload-Digest"]).alias("payload_digest"),
        "n_bytes",
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.alignment import token_alignment

    return token_alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), groups=False)


def op12_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.filter_audit import filter_orders

    return filter_orders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# cells by failed filters first, then every order of the five letters and every step
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM t),
     l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad FROM labels GROUP BY doc_id),
     m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
           FROM w LEFT JOIN l USING (doc_id)),
     c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
     f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
     o AS (SELECT concat(a.x, b.x, d.x, e.x, g.x) AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
           FROM f a JOIN f b ON b.x <> a.x JOIN f d ON d.x NOT IN (a.x, b.x) JOIN f e ON e.x NOT IN (a.x, b.x, d.x) JOIN f g ON g.x NOT IN (a.x, b.x, d.x, e.x)),
     s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before
           FROM (SELECT *, unnest(range(1, 6)) AS i FROM o)),
     r AS (SELECT part, filter_order, step, bit,
                  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
                  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN bad ELSE 0 END) AS toxic_lost
           FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silverframe.llm.neighbour_graph import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


WORDS_SQL = """
    SELECT {id} AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM {table}
"""

# an item of fewer than five words is one shingle of its own length k
OP8_SQL = f"""
WITH bw AS (SELECT id, w, least(len(w), 5) AS k FROM ({WORDS_SQL.format(id="item_id", table="benchmark")}) WHERE len(w) > 0),
     dw AS ({WORDS_SQL.format(id="doc_id", table="documents")}),
     b AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
     d AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s
           FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
     n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / any_value(n.n) AS containment
FROM d JOIN b USING (k, s) JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_toxicity": op2_toxicity,
        "op3_pii": op3_pii,
        "op4_quality": op4_quality,
        "op5_token_codes": op5_token_codes,
        "op6_simhash": op6_simhash,
        "op7_topk": op7_topk,
        "op8_decontamination": op8_decontamination,
        "op9_repeats": op9_repeats,
        "op10_warc": op10_warc,
        "op11_alignment": op11_alignment,
        "op12_filter_orders": op12_filter_orders,
        "op13_nearest": op13_nearest,
    }


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables, for the queries that it can express."""
    return {
        "op7_topk": OP7_SQL,
        "op8_decontamination": OP8_SQL,
        "op12_filter_orders": OP12_SQL,
    }
