"""The numbered queries: each applies its operator to its whole table and derives the digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exponion, jaccard_join, license_scan, near_vectors, packing, pii, prefix_trie, quality_rules, secret_scan, source_mix, substring_dedup, url_filter
from .common import documents, prepare


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), decoded=True)
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad when the document of the same id is labelled toxic or of low quality."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("long").alias("bad"))
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), bad)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality_rules.measure(documents(spark, sf_dir))
    return m.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.report(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_bpe_chunk_reuse, op2_pii_spans, op3_license_scan, op4_sum_of_squares_packing, op5_url_reputation,
    op6_vector_near_dups, op7_quality_rules, op8_jaccard_join, op9_secret_ledger, op10_substring_dedup,
    op11_exponion, op12_source_mix, op13_prefix_trie,
)}

_SPLIT = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op8_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) g FROM w),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x)
 SELECT doc_id, coalesce(n, 0) n_shingles, min(z) component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2""",
    "op10_substring_dedup": f"""WITH w AS (SELECT doc_id, {_SPLIT.format("text")} ws FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) i, unnest(list_transform(range(1, len(ws) - 48), lambda i: sha256(array_to_string(ws[i:i + 49], ' ')))) h FROM w),
 f AS (SELECT h, min(doc_id) lo FROM g GROUP BY 1),
 x AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (h), range(50) t(k) WHERE lo < doc_id),
 a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) p, unnest(ws) AS word FROM w),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) kept, count(*) n FROM a ANTI JOIN x USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, len(ws) n_words, len(ws) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}


def _kmeans_sql(rounds: int = 3) -> str:
    """Assignments and means, written out round by round."""
    near = "SELECT r, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), k := k)) m FROM e, {} c GROUP BY r"
    out = [
        "WITH e AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 k, v FROM (SELECT sha256('1:' || vec_id) h, v FROM e ORDER BY h, v LIMIT 16))",
    ]
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({near.format(f'c{i}')})")
        out.append(f"u{i} AS (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY p) v FROM (SELECT m.k k, p, sum(v[p]) s, count(*) n FROM a{i} JOIN e USING (r), range(1, 65) t(p) GROUP BY 1, 2) GROUP BY 1)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(u{i}.v, c{i}.v) v FROM c{i} LEFT JOIN u{i} USING (k))")
    out.append(f"a AS MATERIALIZED ({near.format(f'c{rounds}')})")
    return ", ".join(out) + f" SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) inertia, sha256(array_to_string(c.v, ',')) centroid_sha256 FROM a JOIN e USING (r) JOIN c{rounds} c ON c.k = m.k"


_BLOCK, _BEFORE = source_mix.BLOCK, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c) + 1), lambda i: CAST(ascii(c[i]) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295)"

ORACLES |= {
    "op11_exponion": _kmeans_sql(),
    "op12_source_mix": f"""WITH d AS (SELECT row_number() OVER () r, doc_id, source, CAST(len({_SPLIT.format("text")}) AS BIGINT) AS size FROM documents),
 s0 AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY 1),
 s1 AS (SELECT *, 2 * source_size most, [5, 2, 1][rank % 3 + 1] weight FROM s0),
 s2 AS (SELECT *, 150 * sum(source_size) OVER () - 100 * coalesce(sum(most) OVER w, 0) AS hundredths, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest FROM s1 WINDOW w AS (ORDER BY most * (10 // weight), rank {_BEFORE})),
 s3 AS (SELECT *, hundredths * weight >= most * 100 * rest AS full_up FROM s2),
 s4 AS (SELECT * FROM s3 WHERE NOT full_up ORDER BY most * (10 // weight), rank LIMIT 1),
 s5 AS (SELECT s3.source, s3.rank, s3.source_size, CASE WHEN s3.full_up THEN CAST(s3.most AS DOUBLE) ELSE CAST(s4.hundredths * s3.weight AS DOUBLE) / CAST(100 * s4.rest AS DOUBLE) END AS target FROM s3 LEFT JOIN s4 ON true),
 s6 AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CAST(round(target) AS BIGINT) // {_BLOCK} + CASE WHEN CAST(round(target) AS BIGINT) % {_BLOCK} > 0 THEN 1 ELSE 0 END AS blocks FROM s5),
 s AS MATERIALIZED (SELECT *, CAST(coalesce(sum(blocks) OVER (ORDER BY rank {_BEFORE}), 0) AS BIGINT) AS first, CAST(sum(blocks) OVER () AS BIGINT) AS total FROM s6),
 l AS (SELECT rank, blocks, slot, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS k FROM (SELECT CAST(slot AS BIGINT) AS slot FROM (SELECT unnest(range((SELECT max(total) FROM s))) AS slot)) x JOIN s ON (slot % {source_mix.POINTS} * {source_mix.STEP} % {source_mix.POINTS}) * total // {source_mix.POINTS} >= first AND (slot % {source_mix.POINTS} * {source_mix.STEP} % {source_mix.POINTS}) * total // {source_mix.POINTS} < first + blocks),
 o AS (SELECT d.r, doc_id, size, source_size, target, rank, words, first, total, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY CAST('0x' || left(md5('{source_mix.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 15) AS BIGINT), doc_id, size {_BEFORE}), 0) AS pos FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
 g AS (SELECT *, CAST(pos + e * source_size AS BIGINT) AS a, CAST(least(pos + e * source_size + size, words) AS BIGINT) AS b FROM o, range(2) t(e)),
 p AS (SELECT *, unnest(range(a // {_BLOCK}, (b - 1) // {_BLOCK} + 1)) AS k FROM g WHERE b > a),
 q AS (SELECT p.r, CAST(sum(least(b, (k + 1) * {_BLOCK}) - greatest(a, k * {_BLOCK})) AS BIGINT) AS taken, min(coalesce(slot, total + first + k)) AS first_slot FROM p LEFT JOIN (SELECT * FROM l WHERE k < blocks) l USING (rank, k) GROUP BY 1)
 SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM o LEFT JOIN q USING (r)""",
    "op13_prefix_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') r, coalesce(text, '') x, turn FROM conversations WHERE conv_id IS NOT NULL),
 o AS MATERIALIZED (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, r, x) l FROM t GROUP BY 1),
 h AS (SELECT conv_id, l, conv_id - conv_id % 100 base, {_CRC} % 6 h FROM (SELECT *, CAST(conv_id AS VARCHAR) c FROM o)),
 f AS (SELECT h.conv_id, coalesce(b.l[1:h], []) || h.l[h + 1:] f FROM h LEFT JOIN o b ON b.conv_id = base),
 p AS (SELECT conv_id, f, unnest(range(0, len(f) + 1)) AS depth FROM f),
 n AS MATERIALIZED (SELECT f[1:depth] pre, depth, CASE WHEN depth > 0 THEN length(any_value(f[depth].x)) ELSE 0 END size, min(conv_id) conv_id, count(*) n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(f)), '')) ends FROM p GROUP BY 1, 2),
 k AS (SELECT pre[1:depth - 1] pre, count(*) n_children FROM n WHERE depth > 0 GROUP BY 1),
 m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) n_children FROM n LEFT JOIN k USING (pre)),
 s AS (SELECT pre[1:j] pre, CAST(sum((n - 1) * size) AS BIGINT) saved, count(*) FILTER (n_children = 0) leaves FROM (SELECT *, unnest(range(0, depth + 1)) j FROM m) GROUP BY 1)
 SELECT m.conv_id, m.depth, u.conv_id parent_conv_id, m.n n_convs, m.n_children, leaves n_leaves, saved saved_tokens, m.ends ends_sha256 FROM m JOIN s USING (pre) LEFT JOIN n u ON m.depth > 0 AND u.pre = m.pre[1:m.depth - 1]""",
}
