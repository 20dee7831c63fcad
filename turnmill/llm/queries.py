"""Queries of this subpackage's operators with their production parameters, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import licence_scan, lm_score, toxicity
from turnmill.llm.bpe import encode_digests
from turnmill.llm.exact_dedup import exact_dedup
from turnmill.llm.knn import top_products
from turnmill.llm.mixing import mix
from turnmill.llm.near_dedup import Near, near_duplicates
from turnmill.llm.phrases import mine_phrases
from turnmill.llm.sharding import assign_shards
from turnmill.llm.spelling import spelling_groups
from turnmill.llm.token_counts import count_tokens
from turnmill.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


def op2_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op3_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 24)


def op5_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(spark, table(spark, sf_dir, "documents"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op12_pcy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_parity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash": op1_hyperminhash,
    "op2_licence_sentences": op2_licence_sentences,
    "op3_ngram_logistic": op3_ngram_logistic,
    "op4_hash_tree_shards": op4_hash_tree_shards,
    "op5_min_cost_flow": op5_min_cost_flow,
    "op6_voronoi_join": op6_voronoi_join,
    "op7_toxicity_crf": op7_toxicity_crf,
    "op8_subword_lattice": op8_subword_lattice,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_chunk_recipes": op10_chunk_recipes,
    "op11_token_counts": op11_token_counts,
    "op12_pcy_phrases": op12_pcy_phrases,
    "op13_parity_bands": op13_parity_bands,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hyperminhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
            FROM w
        ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        link AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS c USING (doc_id)
    """,
    "op2_licence_sentences": licence_scan.oracle_sql(),
    "op6_voronoi_join": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v AS q JOIN v AS d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op10_chunk_recipes": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
    "op12_pcy_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)
        ), f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY lang, phrase, m),
        c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
        s AS (
            SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
            FROM cuts
            JOIN f AS l ON l.lang = cuts.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ')
            JOIN f AS r ON r.lang = cuts.lang AND r.phrase = array_to_string(list_slice(w, k + 1, cuts.m), ' ')
        ), lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, a AS f, unnest(list_transform(range(1, m - j + 2), lambda i: array_to_string(list_slice(w, i, i + j - 1), ' '))) AS phrase
            FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < m
        ), holders AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase),
        kept AS (SELECT lowest.* FROM lowest LEFT JOIN holders USING (lang, phrase) WHERE holders.f IS NULL OR 100 * holders.f < 80 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
    """,
    "op13_parity_bands": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
        ), d AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
            FROM documents
        ), e AS (SELECT w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM d GROUP BY doc_id, w),
        h AS (
            SELECT w, n, hex(encode(s)) AS x FROM e
        ), i AS (
            SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda k: CAST(('0x' || substr(x, k, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM h, crc
        ), s AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, n FROM i
        ), v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
        c AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS k FROM v),
        r AS (SELECT w, n, k, left(w, k - 1) || substr(w, k + 1) AS x FROM c),
        p AS (
            SELECT a.w AS a, b.w AS b, b.n FROM r AS a JOIN r AS b ON a.x = b.x AND a.k = b.k AND a.w <> b.w
            UNION SELECT r.w, v.w, v.n FROM r JOIN v ON r.x = v.w
            UNION SELECT v.w, r.w, r.n FROM r JOIN v ON r.x = v.w
        ), near AS (SELECT a, count(*) AS n_near FROM p GROUP BY a),
        top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
        f AS (
            SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * v.n THEN top.b END AS form, CASE WHEN top.n >= 2 * v.n THEN top.n END AS form_n
            FROM v LEFT JOIN near ON near.a = v.w LEFT JOIN top ON top.a = v.w
        ), roots(word, root) AS (
            SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, roots.root FROM f JOIN roots ON f.form = roots.word
        )
        SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
    """,
}
