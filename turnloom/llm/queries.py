"""The registered queries of the operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import (
    bk_tree, decision_list, hash_tree, html_diff, impact_index, lines, mask_search, ngram_trie, pieces, secret_forms,
    span_crf, systematic, threshold_means,
)
from turnloom.llm.common import SPACE, table

#: A model file with the vocabulary; read on the driver only.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = hash_tree.uniform_tree(5, 2, 4)


def op1_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = hash_tree.place(docs, SHARDS, "doc_id", "text", hash_tree.grown(SHARDS))
    return placed.withColumn("law", F.lit("key"))


def op3_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, pieces.load_vocabulary(VOCABULARY))
    return encoded.select("doc_id", "n_tokens", "ids", "score", "round_trip")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_trie.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=3)


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).drop("text")


def op8_span_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return span_crf.personal_data(docs, span_crf.fit(docs))


def op9_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bk_tree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", bk_tree.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = systematic.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op11_secret_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forms.secrets(table(spark, sf_dir, "documents"))


def op12_threshold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_means.clusters(table(spark, sf_dir, "embeddings"))


def op13_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_diff, op2_hash_tree, op3_impact_index, op4_sentencepiece, op5_line_dedup,
        op6_ngram_trie, op7_decision_list, op8_span_crf, op9_bk_tree, op10_systematic,
        op11_secret_forms, op12_threshold_means, op13_mask_search,
    )
    return {f.__name__: f for f in found}


# --- oracles ---------------------------------------------------------------------

_TRIMMED = " || ".join(f"chr({ord(c)})" for c in SPACE)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5"""

_OP5 = f"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, translate(trim(line, {_TRIMMED}), '{_UPPER}', '{_LOWER}') AS key FROM l),
    shared AS (
        SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (
        SELECT k.*, last IS NOT NULL AND doc_id <> last AS lost FROM k LEFT JOIN shared USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""

_OP10 = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, text,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
        FROM d GROUP BY source),
    t AS (
        SELECT 0 AS round, source, source_size, weight, false AS capped FROM s
        UNION ALL
        SELECT round + 1, source, source_size, weight,
               capped OR weight * ((sum(source_size) OVER ()
                                    - coalesce(sum(3.0::DOUBLE * source_size) FILTER (capped) OVER (), 0))
                                   / sum(weight) FILTER (NOT capped) OVER ()) > 3.0::DOUBLE * source_size
        FROM t WHERE round <= (SELECT count(*) FROM s)),
    w AS (
        SELECT source, source_size, weight, capped,
               (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) FILTER (capped) OVER (), 0))
               / sum(weight) FILTER (NOT capped) OVER () AS level
        FROM t WHERE round = (SELECT max(round) FROM t)),
    targets AS (
        SELECT source, source_size, least(weight * level, 3.0::DOUBLE * source_size) AS target,
               ('0x' || substr(md5('42|' || coalesce(source, 'null|')), 1, 5))::BIGINT * pow(2.0, -20) AS shift
        FROM w),
    o AS (
        SELECT doc_id, size, source_size, target, shift,
               CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
               row_number() OVER (PARTITION BY d.source ORDER BY size, draw, doc_id, text) - 1 AS place
        FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source)
    SELECT doc_id, size, source_size, target,
           ((floor(shift + step * (place + 1)) - floor(shift + step * place))::BIGINT * size)::BIGINT AS taken
    FROM o"""



def _op12(rounds: int) -> str:
    """One pair of tables a round: the assignment, and the centroids that it moves."""
    nearest = """
        a{r} AS MATERIALIZED (
            SELECT nr, vec_id, v.x, arg_min(c, distance * 8 + c) AS c, min(distance) AS distance FROM (
                SELECT nr, vec_id, v.x, c, list_sum(list_transform(
                    generate_series(1, 64), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i])))::BIGINT AS distance
                FROM v, m{r} m) v GROUP BY nr, vec_id, v.x)"""
    moved = """
        s{r} AS (SELECT c, i, sum(y) AS s, count(*) AS n FROM (
            SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i),
        m{next} AS MATERIALIZED (
            SELECT m.c, coalesce(f.x, m.x) AS x FROM m{r} m LEFT JOIN (
                SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c) f USING (c))"""
    steps = ",".join(nearest.format(r=r) + "," + moved.format(r=r, next=r + 1) for r in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        m0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v
            ORDER BY sha256('3:' || vec_id), x LIMIT 8),
        {steps},{nearest.format(r=rounds)}
    SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
           sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN m{rounds} m USING (c)"""


_TERMS = (r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), "
          f"lambda t: translate(t, '{_UPPER}', '{_LOWER}'))")  # fmt: skip

_OP13 = f"""
    WITH d AS (SELECT row_number() OVER () AS nr, doc_id, {_TERMS} AS terms FROM documents),
    totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
    i AS (SELECT DISTINCT row, item_id, unnest(terms) AS term
          FROM (SELECT row_number() OVER () AS row, item_id, {_TERMS} AS terms FROM benchmark)),
    p AS (SELECT nr, doc_id, term, count(*) AS tf, 50 + (50 * any_value(n) * any_value(n_docs)) // any_value(n_terms) AS m
          FROM (SELECT nr, doc_id, len(terms) AS n, unnest(terms) AS term FROM d), totals
          WHERE term IN (SELECT term FROM i) GROUP BY nr, doc_id, term),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
          FROM p, totals GROUP BY term),
    s AS (SELECT row, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
          FROM i JOIN p USING (term) JOIN w USING (term) GROUP BY row, item_id, nr, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
          FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """The other operators have hashes, models or parsers that DuckDB lacks; brute force tests them."""
    return {
        "op3_impact_index": _OP3, "op5_line_dedup": _OP5, "op10_systematic": _OP10, "op12_threshold_means": _op12(10),
        "op13_mask_search": _OP13,
    }
