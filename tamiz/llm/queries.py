"""The operators as queries over the shared tables, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.llm import (
    collocations, exact_dedup, langid, maxscore, mixing, packing, quality_rules, simhash, substring_dedup, token_counts, warc,
    weak_quality, whitening,
)
from tamiz.llm.base import query, read


@query("op1_weak_quality")
def op1_weak_quality(spark, sf_dir):
    return weak_quality.score_quality(read(spark, sf_dir, "documents"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packing_digest(packing.pack(read(spark, sf_dir, "documents")))


def packing_digest(pieces):
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    return langid.learned_languages(read(spark, sf_dir, "documents"))


@query(
    "op4_exact_dedup",
    """WITH t AS (
         SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
       SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
       FROM t WINDOW w AS (PARTITION BY body)""",
)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    stored = token_counts.token_prefixes(read(spark, sf_dir, "documents"))
    total = token_counts.total_tokens()
    return stored.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > token_counts.LIMIT_TOKENS).alias("over_limit"))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    return quality_rules.judged(read(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    found = simhash.near_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op9_warc",
    """WITH p AS (
         SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
       f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
       SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest,
              CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
       FROM f""",
)
def op9_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op10_mixing")
def op10_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op11_maxscore",
    """WITH v AS (
         SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
       scored AS (
         SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
         FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
       SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5""",
)
def op11_maxscore(spark, sf_dir):
    return maxscore.top_products(read(spark, sf_dir, "embeddings"))


_PARTS = ", ".join(f"lead(w, {k}) OVER piece AS w{k}" for k in (1, 2, 3))
_PHRASES = " UNION ALL ".join(
    f"SELECT lang, {n} AS size, {' || chr(32) || '.join(['w', 'w1', 'w2', 'w3'][:n])} AS phrase FROM g WHERE {['w', 'w1', 'w2', 'w3'][n - 1]} IS NOT NULL"
    for n in (1, 2, 3, 4)
)


@query(
    "op12_collocations",
    f"""WITH t AS (
         SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
       p AS (SELECT r, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM t),
       s AS (SELECT r, lang, pos, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
       w AS (SELECT r, lang, pos, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s),
       g AS (SELECT lang, w, {_PARTS} FROM w WINDOW piece AS (PARTITION BY r, pos ORDER BY i)),
       f AS (SELECT lang, size, phrase, count(*) AS a FROM ({_PHRASES}) GROUP BY ALL),
       totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
       c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 30),
       cuts AS (
         SELECT c.*, k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS score
         FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c) c
         JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(ws[1:k], ' ')
         JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(ws[k + 1:], ' ')),
       least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
       inner_parts AS (
         SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS a
         FROM (SELECT *, unnest(generate_series(2, size - 1)) AS m FROM c), generate_series(1, 4) AS o(i)
         WHERE i + m - 1 <= size GROUP BY ALL),
       left_over AS (
         SELECT x.* FROM least x LEFT JOIN inner_parts y ON x.lang = y.lang AND x.phrase = y.phrase
         WHERE y.a IS NULL OR 100 * y.a < 80 * x.a),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
       SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
)
def op12_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.by_component(whitening.whiten(read(spark, sf_dir, "embeddings")))
