"""The queries of this subpackage and their SQL, by the names they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import embedding_dedup, filter_audit, fingerprints, importance, line_dedup, ngram_join, packing, personal_data, piece_encoding, suffix_dedup, token_files, toxicity, url_filters
from quillspan.llm.tokens import vocabulary_path

#: The rules that op1 judges by.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


#: Bytes of a batch of rows that Python workers get.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; rows are handed to Python in batches of so many bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Tokens of a packed sequence.
SEQUENCE = 2048


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary_path(), SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.digest_documents(table(spark, sf_dir, "documents"), piece_encoding.model_path())


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path()))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(toxicity.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    counts = [of(kind).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10000, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_piece_encoding": op5_piece_encoding,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_personal_data": op11_personal_data,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best AS (
            SELECT host, path, arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) AS b
            FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best USING (host, path)
    """,
    "op9_line_dedup": r"""
        WITH raw AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, i - 1 AS line_no, trim(lower(parts[i]), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
            FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM raw)),
        worded AS (SELECT * FROM lines WHERE bare <> ''),
        firsts AS (SELECT bare, min({'d': doc_id, 'l': line_no}) AS pos FROM worded GROUP BY bare),
        words AS (SELECT pos, string_split_regex(bare, '[\x20\x09-\x0D]+') AS w FROM firsts),
        sets AS (
            SELECT pos, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words),
        tokens AS (SELECT pos, len(s) AS n, unnest(s) AS t FROM sets),
        later AS (
            SELECT DISTINCT y.pos AS pos
            FROM (SELECT x.pos AS xa, y.pos AS ya, any_value(x.n) AS xn, any_value(y.n) AS yn, count(*) AS c
                  FROM tokens x JOIN tokens y ON x.t = y.t AND x.pos < y.pos GROUP BY 1, 2) p
            JOIN (SELECT pos FROM sets) y ON y.pos = p.ya
            WHERE 100 * c >= 80 * (xn + yn - c)),
        gone AS (
            SELECT doc_id, line_no FROM worded JOIN firsts USING (bare)
            WHERE {'d': doc_id, 'l': line_no} <> pos OR pos IN (SELECT pos FROM later)),
        gone_by AS (SELECT doc_id, list(line_no) AS g FROM gone GROUP BY doc_id)
        SELECT doc_id, len(parts) AS n_lines, coalesce(len(g), 0) AS n_removed,
               sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(coalesce(g, []), i - 1)), lambda i: parts[i]), chr(10)), '')) AS kept_sha256
        FROM raw LEFT JOIN gone_by USING (doc_id)
    """,
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
            FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least_of ON doc_id = a
    """,
    "op6_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM v LEFT JOIN least_of ON vec_id = least_of.a LEFT JOIN counts ON vec_id = counts.a
    """,
    "op12_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        worded AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
        firsts AS (SELECT t, min(doc_id) AS least_id FROM texts GROUP BY t),
        failing AS (
            SELECT part,
                   CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN doc_id > least_id THEN 16 ELSE 0 END AS bad,
                   CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
                   CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic
            FROM worded JOIN firsts USING (t)),
        cells AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, bad),
        letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (ascii(substr(filter_order, step, 1)) - 65))::BIGINT AS own,
                   coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::BIGINT AS earlier
            FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
        counted AS (
            SELECT part, filter_order, step, letter,
                   sum(CASE WHEN bad & (own + earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN bad & earlier = 0 AND bad & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN bad & earlier > 0 AND bad & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN bad = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN bad & earlier = 0 AND bad & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN bad & earlier = 0 AND bad & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM counted
    """,
    "op13_importance_resampling": r"""
        WITH bytes AS (
            SELECT list(list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS steps
            FROM (SELECT unnest(range(256)) AS b)),
        words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        target AS (
            SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        features AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM words) GROUP BY doc_id, word),
        hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM features UNION SELECT word FROM target)),
        spelled AS (SELECT word, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
        codes AS (
            SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, k: xor(steps[xor(c & 255, k) + 1], c >> 8)), 4294967295) % 10000 AS bucket
            FROM spelled, bytes),
        raw AS (SELECT bucket, sum(n) AS s FROM features JOIN codes USING (word) GROUP BY bucket),
        aim AS (SELECT bucket, count(*) AS t FROM target JOIN codes USING (word) GROUP BY bucket),
        sums AS (SELECT (SELECT sum(s) FROM raw)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM aim), 0)::DOUBLE AS all_t),
        gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS gain
            FROM raw LEFT JOIN aim USING (bucket), sums),
        weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM features JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
            FROM words LEFT JOIN weights USING (doc_id)),
        fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN fit USING (doc_id)
    """,
}
