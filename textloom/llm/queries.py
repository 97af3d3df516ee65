"""One query for each operator, over its whole table, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, collocations, decontamination, fm_dedup, licenses, lm, media, minhash, mixing, negatives, quality, suffix_dedup
from textloom.llm.common import written


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("*",))


def op1_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), k=3, threshold=(85, 100))


def op3_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    out = quality.quality_scores(docs, weights)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op4_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.avi_digests(documents(spark, sf_dir, "doc_id", "text"))


def op5_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.substring_dedup(documents(spark, sf_dir, "doc_id", "text")).drop("digest", "kept")


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir, "doc_id", "text")).drop("digest", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir, "doc_id", "text")).drop("blocks")


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return bpe.bpe_digests(documents(spark, sf_dir, "doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    sized = written(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"), mixing.quality_weight(docs["text"]).alias("weight")), "mixing")
    out = mixing.mixed(sized, size=sized["size"], weight=sized["weight"])
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_times") * F.col("size")).alias("taken"))


def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir, "doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op11_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


QUERIES = {
    "op1_one_bit_neighbours": op1_one_bit_neighbours,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_byte_network": op3_byte_network,
    "op4_avi_clips": op4_avi_clips,
    "op5_fm_index_dedup": op5_fm_index_dedup,
    "op6_prefix_free_parsing": op6_prefix_free_parsing,
    "op7_license_scan": op7_license_scan,
    "op8_bpe_roundtrip": op8_bpe_roundtrip,
    "op9_source_mix": op9_source_mix,
    "op10_ppm_scores": op10_ppm_scores,
    "op11_suffix_automaton": op11_suffix_automaton,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op1_one_bit_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op2_hyperminhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
        ), e AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) + any_value(b.n) AS n
            FROM (SELECT * FROM e) a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)
        ), r(x, y) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.x, z.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) z ON r.y = z.a
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
    """,
    "op5_fm_index_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)
        ), g AS (
            SELECT DISTINCT p.doc_id, unnest(range(p.i, p.i + 50)) AS i FROM p JOIN (SELECT h, min(doc_id) AS d FROM p GROUP BY h) m USING (h) WHERE m.d < p.doc_id
        ), u AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w
        ), k AS (
            SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY 1
        )
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
    """,
    "op9_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                -ln((CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
                    / greatest(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}\p{M} ]+', '', 'g')) / length(text) ELSE 0 END, 0.05) AS k
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1] AS w FROM d GROUP BY 1
        ), l AS (
            SELECT *, row_number() OVER o AS place,
                (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM s WINDOW o AS (ORDER BY cap / w, source IS NULL, source)
        ), t AS (
            SELECT source, source_size, least(cap, w * (SELECT arg_min(level, place) FROM l WHERE level * w <= cap)) AS target FROM l
        ), e AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
        ), b AS (
            SELECT d.doc_id, d.size, d.k, e.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
        )
        SELECT doc_id, size, source_size, target,
            CAST(size * (epochs + CASE WHEN bool_or(before + size / 2 > target - epochs * source_size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) THEN 0 ELSE 1 END) AS BIGINT) AS taken
        FROM b
    """,
    "op11_suffix_automaton": r"""
        WITH i AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), v AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM i WHERE len(w) > 0)
        ), p AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)
        ), h AS (
            SELECT p.doc_id, p.i, n, v.item_id FROM p JOIN v USING (n, s)
        ), k AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1
        ), c AS (
            SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
    """,
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
        ), g AS (
            SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 6) r(n) WHERE len(w) >= n)
        ), f AS (
            SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY ALL
        ), t AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS total FROM f WHERE n = 1 GROUP BY 1
        ), c AS (
            SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n >= 2 AND f >= 100
        ), k AS (
            SELECT lang, phrase, a, w, unnest(range(1, n)) AS k FROM c
            WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.n > c.n AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
        ), s AS (
            SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, total AS n, CAST((1000::HUGEINT * k.a * total) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
            FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k.k + 1:], ' ') JOIN t ON t.lang = k.lang
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
    """,
}
