"""The queries op1 to op13: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Found in the public tokenizers' folder of the machine that reads it.
TOKENIZER = "word_bpe_49k.json"


def op1_media_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    got = media.fingerprint(media.store_wav(table(spark, sf_dir, "documents")))
    return got.withColumn("feature", media.feature_text(F.col("landmarks"))).drop("landmarks")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_components

    return near_components(table(spark, sf_dir, "documents")).drop("text_hash", "group")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.classify(docs, langid.fit(docs, ~langid.held_out(F.col("doc_id"))))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), TOKENIZER))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    docs = table(spark, sf_dir, "documents")
    return periodic.run_report(periodic.find_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.page_report(spark, warc.archive_pages(table(spark, sf_dir, "pages")))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_fingerprint, op2_exact_dedup, op3_ngram_jaccard, op4_bpe, op5_language_id, op6_license_scan, op7_best_fit_packing, op8_token_files, op9_lm_score, op10_suffix_dedup, op11_periodic_runs, op12_warc, op13_centroid_clusters)}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END))) AS i FROM w),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.c + b.c - k)),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x)
        SELECT r.doc_id, coalesce(any_value(n.c), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
    """,
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN strlen(h) >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 1000 AND page_id < keep THEN keep END AS refers_to
        FROM k
    """,
    "op13_centroid_clusters": """
        WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        x AS (SELECT vec_id, unnest(generate_series(1, 64)) AS d, unnest(v) AS x FROM kept),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 16),
        """
    + ",\n        ".join(
        f"""a{r} AS (SELECT vec_id, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (SELECT x.vec_id, m.c, sum((x.x - m.x) * (x.x - m.x)) AS dist FROM x JOIN m{r} m USING (d) GROUP BY ALL) GROUP BY vec_id),
        m{r + 1} AS (SELECT m.c, m.d, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN (SELECT a.c, x.d, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM x JOIN a{r} a USING (vec_id) GROUP BY ALL) n USING (c, d))"""
        if r
        else "m1 AS (SELECT s.c, x.d, x.x FROM s JOIN x USING (vec_id))"
        for r in range(5)
    )
    + """,
        t AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m4 GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a4 JOIN t USING (c)
    """,
}
