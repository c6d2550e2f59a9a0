"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import byte_bpe, decontamination, html_text, lexical, line_dedup, lm_scoring, resampling, secrets, simhash, tensored, token_counts, topk, toxicity
from recollect.llm.common import table


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_nth(topk.whole_vectors(table(spark, sf_dir, "embeddings")), 50, 5)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(docs, secrets.train(docs)))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_before"))
    return line_dedup.dedup_lines(docs).select("doc_id", "text", (F.col("n_before") - F.length("text")).cast("long").alias("n_removed"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_secrets": op2_secrets,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_topk": op10_topk,
    "op11_lexical": op11_lexical,
    "op12_resampling": op12_resampling,
    "op13_minhash": op13_minhash,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op10_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        s AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
        wins AS (SELECT DISTINCT item_id, size, list_slice(w, p, p + size - 1) AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM s)),
        places AS (SELECT doc_id, size, p, list_slice(w, p, p + size - 1) AS win
                   FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM wins))),
        hits AS (SELECT doc_id, p, size, item_id FROM places JOIN wins USING (size, win)),
        n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM hits) GROUP BY doc_id),
        f AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
    """,
    "op11_lexical": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        docs AS (SELECT doc_id, r, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
        total AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM docs),
        q AS (SELECT DISTINCT item, item_id, unnest({_WORDS}) AS t FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
        tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        w AS (SELECT t, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_all),
        p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_all) // l_all)))) AS s FROM tf JOIN w USING (t), total),
        s AS (SELECT item, item_id, r, doc_id, sum(s)::BIGINT AS score FROM q JOIN p USING (t) GROUP BY ALL HAVING sum(s) > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 50
    """,
    "op12_resampling": f"""
        WITH d AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        both_sides AS (SELECT side, r, w FROM d UNION ALL SELECT 't', 0, coalesce({_WORDS}, []) FROM benchmark),
        f AS (SELECT side, r, array_to_string(list_slice(w, p, p + n - 1), ' ') AS f
              FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM both_sides, (SELECT unnest([1, 2, 3]) AS n))),
        of_side AS (SELECT side, r, f, count(*)::BIGINT AS n FROM f GROUP BY ALL),
        bits AS (SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)),
        crc AS (SELECT list(v ORDER BY b) AS v FROM bits),
        hashed AS (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT),
                                             lambda c, x: xor(c >> 8, v[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
                   FROM (SELECT DISTINCT f FROM of_side), crc),
        n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t FROM of_side JOIN hashed USING (f) GROUP BY bucket),
        total AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM n),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, total),
        of_doc AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM of_side JOIN hashed USING (f) JOIN g USING (bucket) WHERE side = 's' GROUP BY r),
        scored AS (SELECT doc_id, len(w) >= 20 AS long_enough, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                          (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
                   FROM d LEFT JOIN of_doc USING (r)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS LAST) AS p, count(*) OVER (PARTITION BY long_enough) AS n_all FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND p <= 5 * n_all // 100 THEN p::BIGINT END AS rank FROM placed
    """,
    "op13_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT r, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda p: array_to_string(list_slice(w, p, p + 3), ' '))) AS s FROM d WHERE len(w) > 0),
        sizes AS (SELECT d.r, doc_id, coalesce(len(s), 0)::BIGINT AS n FROM d LEFT JOIN s USING (r)),
        each AS (SELECT r, unnest(s) AS x FROM s),
        common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM each a JOIN each b USING (x) WHERE a.r <> b.r GROUP BY a.r, b.r),
        links AS (SELECT a, b FROM common c JOIN sizes x ON x.r = c.a JOIN sizes y ON y.r = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
        reach AS (SELECT a AS r, a AS other FROM (SELECT DISTINCT a FROM links) UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a),
        named AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN sizes ON sizes.r = reach.other GROUP BY reach.r)
        SELECT doc_id, n AS n_shingles, CASE WHEN named.r IS NULL THEN doc_id ELSE component_id END AS component_id,
               doc_id IS NOT DISTINCT FROM CASE WHEN named.r IS NULL THEN doc_id ELSE component_id END AS kept
        FROM sizes LEFT JOIN named USING (r)
    """,
}
