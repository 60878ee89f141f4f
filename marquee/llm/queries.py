"""The registered queries of this folder, and the DuckDB texts of those SQL can express."""

import public_tokenizers

import corpus_pipeline
from marquee.llm import bpe, covertree, decontaminate, hardneg, linejoin, merkle, minhash, pfor, pii, quality, simhash, toxicity, warc
from marquee.llm.common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_token_blocks(spark, sf_dir):
    return pfor.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_quality(spark, sf_dir):
    return quality.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op6_line_dedup(spark, sf_dir):
    return linejoin.line_report(table(spark, sf_dir, "documents"))


def op7_dual_tree(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_minhash(spark, sf_dir):
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "embedding")
    return hardneg.mine(vectors, vectors.where("vec_id % 100 = 0"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.verified_rows(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_blocks, op3_warc, op4_quality, op5_byte_bpe, op6_line_dedup, op7_dual_tree, op8_toxicity,
                                   op9_decontamination, op10_personal_data, op11_minhash, op12_hard_negatives, op13_merkle_manifest)} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op11_minhash": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
        e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met, any_value(x.n + y.n) AS total
                  FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * met >= 85 * (total - met)),
        reach AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM links)
                  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
               doc_id = coalesce(component_id, doc_id) AS kept
        FROM s LEFT JOIN least USING (doc_id)""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS p FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.p::DOUBLE[], c.p::DOUBLE[])::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        far AS (SELECT n.*, s.vec_id AS negative_id, s.score AS negative_score,
                       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
                FROM near n JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 10""",
    "op13_merkle_manifest": """
        WITH RECURSIVE
        d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
                     list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                                 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc
              FROM documents),
        leaves AS (
            SELECT doc_id, lang, place, n, xor(crc, 4294967295) % 7 = 0 AS touched,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS count, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
                   coalesce(strlen(text) || ':' || text, '-') AS body
            FROM d),
        hashed AS (SELECT doc_id, lang, place, n, sha256(head || count || body) AS leaf,
                          sha256(head || CASE WHEN touched THEN more ELSE count END || body) AS given FROM leaves),
        node AS (
            SELECT lang, 0 AS level, place, n, leaf AS h FROM hashed
            UNION ALL
            SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM node WHERE n > 1
            GROUP BY lang, level + 1, place // 2, (n + 1) // 2),
        subs AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1),
        upper AS (
            SELECT 0 AS level, place, n, subroot AS h FROM subs
            UNION ALL
            SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM upper WHERE n > 1
            GROUP BY level + 1, place // 2, (n + 1) // 2),
        steps AS (
            SELECT doc_id, s.lang, height, t.step, CASE WHEN t.step < height THEN hashed.place >> t.step ELSE s.place >> (t.step - height) END AS place
            FROM hashed JOIN subs s ON hashed.lang IS NOT DISTINCT FROM s.lang, (SELECT max(level) AS more FROM upper) u, unnest(range(height + more)) t(step)),
        path AS (
            SELECT doc_id, step, steps.place % 2 AS slot, coalesce(node.h, upper.h, '') AS h FROM steps
            LEFT JOIN node ON step < height AND node.lang IS NOT DISTINCT FROM steps.lang AND node.level = step AND node.place = xor(steps.place, 1)
            LEFT JOIN upper ON step >= height AND upper.level = step - height AND upper.place = xor(steps.place, 1)),
        proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY step)) AS proof_sha256, count(*) AS length FROM path GROUP BY doc_id),
        fold AS (
            SELECT doc_id, 0 AS step, given AS h FROM hashed
            UNION ALL
            SELECT fold.doc_id, fold.step + 1, sha256(CASE WHEN slot = 1 THEN path.h || fold.h ELSE fold.h || path.h END)
            FROM fold JOIN path ON path.doc_id = fold.doc_id AND path.step = fold.step)
        SELECT hashed.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
        FROM hashed JOIN subs ON hashed.lang IS NOT DISTINCT FROM subs.lang, (SELECT h AS root FROM upper WHERE n = 1) r,
             fold LEFT JOIN proofs ON proofs.doc_id = fold.doc_id
        WHERE fold.doc_id = hashed.doc_id AND fold.step = coalesce(length, 0)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1),
        m AS (SELECT d.*, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest))
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
               (SELECT url FROM pages q WHERE q.page_id = m.page_id) AS requested,
               (17 + length(payload_bytes::VARCHAR))::BIGINT AS metadata_bytes
        FROM m""",
    "op7_dual_tree": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.p::DOUBLE[], c.p::DOUBLE[])::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
