"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import exact_search, filter_audit, host_rules, html_content, language_id, line_dedup, merkle, ngram_join, packing, quality, sentencepiece_scan, substring_dedup, url_filter
from ragloom.session import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sentencepiece_scan.decoded(sentencepiece_scan.encoded(_read(spark, sf_dir, "documents")))
    digest = (F.char_length("text").cast("bigint").alias("n_chars"), F.xxhash64("text").alias("text_hash"))
    return texts.select(F.col("id").alias("doc_id"), "part", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), *digest)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extracted(_read(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_read(spark, sf_dir, "documents"), shingle=3, similarity=(9, 10))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_texts(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs, learn_from=_fold(3) != 1)
    return language_id.languages(docs.select("doc_id", "text"), model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judged(_read(spark, sf_dir, "documents"))
    return out.select(*(F.round(c, 6).alias(c) if c.startswith("rate_") else c for c in out.columns))


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_search.integer_vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_search.top_k(vectors, vectors.filter(F.col("id") % 100 == 0), k=10)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), learn_from=_fold(5) != 0)
    scored = quality.scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"), merkle.without_line_breaks(F.col("text"), F.col("doc_id")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("_kept")).alias("n_removed"), F.size("_spans").cast("bigint").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_sentencepiece, op3_html_extraction, op4_ngram_join, op5_packing, op6_language_id, op7_line_dedup, op8_host_rules, op9_exact_search,
        op10_quality_classifier, op11_filter_audit, op12_merkle_manifest, op13_suffix_dedup,
    )
}

# Words of a text as a list, in order; A-Z lower-cased or as they are.
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x != '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The low bit of a decimal id's crc32: bytes and then bits are worked off from the left.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
_EVEN_CRC = f"{_CRC} % 2 = 1"
_LEAF = " || ".join(f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}"))
_UP = "list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], '')))"
_STEP = "array_to_string(nodes[3 * (p // 3) + 1:p], '') || '|' || array_to_string(nodes[p + 2:3 * (p // 3) + 3], '')"

ORACLES: dict[str, str] = {
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, COALESCE({_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        met AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
        links AS (SELECT a, b FROM met WHERE 100 * c >= 90 * (total - c)), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id FROM sets
    """,
    # lines as sets of words; candidate classes share one of the rarest words that each must share
    "op7_line_dedup": f"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), nth AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM d),
        l AS (SELECT doc_id, doc_id * 10000000 + i AS place, parts[i] AS line, list_sort(list_distinct({_WORDS.format(_LOWER.format('parts[i]'))})) AS s FROM nth),
        c AS (SELECT s, len(s) AS n, min(place) AS p FROM l WHERE len(s) > 0 GROUP BY s), t AS (SELECT p, n, unnest(s) AS w FROM c), f AS (SELECT w, count(*) AS k FROM t GROUP BY w),
        r AS (SELECT p, n, w, row_number() OVER (PARTITION BY p ORDER BY k, w) AS pos FROM t JOIN f USING (w)), x AS (SELECT p, n, w FROM r WHERE pos <= n - (8 * n + 9) // 10 + 1),
        pairs AS (SELECT DISTINCT a.p AS a, b.p AS b FROM x a JOIN x b ON a.w = b.w AND a.p < b.p AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
        both_sets AS (SELECT b, ca.n + cb.n AS total, len(list_intersect(ca.s, cb.s)) AS c FROM pairs JOIN c ca ON ca.p = a JOIN c cb ON cb.p = b),
        gone AS (SELECT l.place FROM l JOIN c ON l.s = c.s WHERE l.place > c.p OR c.p IN (SELECT b FROM both_sets WHERE 10 * c >= 8 * (total - c))),
        kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.place IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL) AS text FROM l LEFT JOIN gone g ON l.place = g.place GROUP BY doc_id)
        SELECT d.doc_id, CAST(COALESCE(n_lines, 0) AS INTEGER) AS n_lines, CAST(COALESCE(n_removed, 0) AS INTEGER) AS n_removed, CASE WHEN d.text IS NOT NULL THEN COALESCE(kept.text, '') END AS text FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_host_rules": f"""
        WITH d AS (SELECT doc_id, source AS host, COALESCE(text, '') AS text FROM documents), w AS (SELECT *, {_WORDS.format('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
        win AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w), named AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win),
        again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM named WHERE c > 1) GROUP BY doc_id),
        m AS (SELECT doc_id, host, len(w) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, COALESCE(again.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN again USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        tried AS (SELECT host, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, 10 * n_symbols > word_chars, 10 * n_dup_lines > 3 * n_lines]) AS bad FROM b),
        h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (bad) AS f FROM tried GROUP BY host, rule),
        g AS (SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS per_doc FROM h GROUP BY rule), v AS (SELECT rule, m, q - m * m - m * (1 - m) * per_doc AS spread FROM g),
        prior AS (SELECT rule, m, greatest(0.2, least(3 * m, (1 + m) / 2)) AS most, CASE WHEN spread > 0 THEN greatest(1, least(1e6, m * (1 - m) / spread - 1)) ELSE 1e6 END AS s FROM v),
        rates AS (SELECT host, rule, most, (f + m * s) / (n + s) AS rate FROM h JOIN prior USING (rule)),
        hosts AS (SELECT host, bool_or(rate > most) AS host_failed, max(rate) FILTER (rule = 'base') AS rate_base, max(rate) FILTER (rule = 'symbols') AS rate_symbols,
            max(rate) FILTER (rule = 'lines') AS rate_lines FROM rates GROUP BY host)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND NOT host_failed AS kept, host_failed,
            round(rate_base, 6) AS rate_base, round(rate_symbols, 6) AS rate_symbols, round(rate_lines, 6) AS rate_lines
        FROM b JOIN hosts ON b.host IS NOT DISTINCT FROM hosts.host
    """,
    "op9_exact_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_filter_audit": f"""
        WITH d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text FROM documents), w AS (SELECT *, {_WORDS.format('text')} AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        m AS (SELECT w.doc_id, part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
        r AS (SELECT part, filter_order, step, filter_order[step] AS f, n, good, toxic, fails, contains(fails, filter_order[step]) AS hit, step > 1 AND len(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS gone FROM s, h),
        t AS (SELECT part, filter_order, step, f, COALESCE(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, COALESCE(sum(n) FILTER (hit AND NOT gone), 0) AS removed, COALESCE(sum(n) FILTER (hit AND gone), 0) AS redundant,
            COALESCE(sum(n) FILTER (fails = f), 0) AS unique_fails, COALESCE(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, COALESCE(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM t
    """,
    # crc32 bit by bit; the trees as a list of digests a level, halted where one is left
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT *, CASE WHEN {_EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
        a AS (SELECT doc_id, source, sha256({_LEAF.format('text')}) AS leaf, sha256({_LEAF.format('other')}) AS tampered FROM d),
        b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM a),
        up AS (SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM b GROUP BY source UNION ALL SELECT source, level + 1, {_UP} FROM up WHERE len(nodes) > 1),
        sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM up WHERE len(nodes) = 1),
        top AS (SELECT 0 AS level, list(subroot ORDER BY j) AS nodes FROM sub UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1),
        low AS (SELECT source, i, level, nodes, CAST(floor(i / pow(3, level)) AS BIGINT) AS p FROM b JOIN up USING (source) WHERE len(nodes) > 1 UNION ALL SELECT b.source, i, level, nodes, CAST(floor(i / pow(3, level)) AS BIGINT) FROM b JOIN up ON b.source IS NULL AND up.source IS NULL WHERE len(nodes) > 1),
        high AS (SELECT source, level, nodes, CAST(floor(j / pow(3, level)) AS BIGINT) AS p FROM sub, top WHERE len(nodes) > 1),
        low_steps AS (SELECT source, i, list({_STEP} ORDER BY level) AS steps FROM low GROUP BY source, i), high_steps AS (SELECT source, list({_STEP} ORDER BY level) AS steps FROM high GROUP BY source),
        ways AS (SELECT b.*, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, list_concat(COALESCE(l.steps, []), COALESCE(h.steps, [])) AS steps FROM b
            JOIN sub ON b.source IS NOT DISTINCT FROM sub.source LEFT JOIN low_steps l ON b.source IS NOT DISTINCT FROM l.source AND b.i = l.i LEFT JOIN high_steps h ON b.source IS NOT DISTINCT FROM h.source),
        walked AS (SELECT *, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, list_reduce(list_prepend(tampered, steps), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM ways)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM walked
    """,
    # every string of 200 bytes by itself; removed runs are islands of their starts
    "op13_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(COALESCE(text, '')) AS b FROM documents),
        g AS (SELECT r, i, b[i:i + 199] AS s FROM (SELECT r, b, unnest(range(1, CAST(octet_length(b) AS BIGINT) - 198)) AS i FROM d)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1),
        turns AS (SELECT r, i, CASE WHEN i > 200 + lag(i, 1, -200) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS turn FROM again),
        spans AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT r, i, sum(turn) OVER (PARTITION BY r ORDER BY i) AS k FROM turns) GROUP BY r, k),
        gaps AS (SELECT r, lag(hi, 1, 1) OVER (PARTITION BY r ORDER BY lo) AS a, lo AS z FROM spans UNION ALL SELECT d.r, COALESCE(max(hi), 1), octet_length(any_value(b)) + 1 FROM d LEFT JOIN spans USING (r) GROUP BY d.r),
        kept AS (SELECT r, string_agg(hex(b[a:z - 1]), '' ORDER BY a) AS h FROM gaps JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(COALESCE(s.n, 0) AS BIGINT) AS n_removed, COALESCE(s.k, 0) AS n_spans, sha256(unhex(COALESCE(h, ''))) AS kept_sha256
        FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, sum(hi - lo) AS n, count(*) AS k FROM spans GROUP BY r) s USING (r)
    """,
}
