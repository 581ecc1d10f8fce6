"""The registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, compaction, embeddings, fingerprint, jaccard, mixing, neighbours, quality, repair, secrets, suffix, tokencount
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.documents_digest(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_text=False)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.shard_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.col("source"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).drop("set_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep_groups=False)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_secret_scan, op3_bpe, op4_fingerprints, op5_sharding, op6_quality, op7_mixing, op8_jaccard_join, op9_token_counts, op10_suffix_dedup, op11_alignment, op12_repair, op13_neighbours)}
#: SQL of the operators whose whole result it can say: all pairs compared, and links followed.
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM rows_ WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.r AS x, b.r AS y, b.vec_id FROM fit a JOIN fit b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT r AS x, r AS y FROM fit UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
head AS (SELECT reach.x AS r, min(fit.vec_id) AS component_id FROM reach JOIN fit ON fit.r = reach.y GROUP BY 1),
n AS (SELECT x AS r, count(*) AS n_links FROM link GROUP BY 1)
SELECT rows_.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(head.component_id, rows_.vec_id) AS component_id, coalesce(rows_.vec_id = coalesce(head.component_id, rows_.vec_id), false) AS kept FROM rows_ LEFT JOIN n ON n.r = rows_.r LEFT JOIN head ON head.r = rows_.r""",
    "op8_jaccard_join": """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '\\s+') if x <> ''] AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE c >= 0.8 * (a.n + b.n - c)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
head AS (SELECT reach.x AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.y GROUP BY 1),
k AS (SELECT x AS r, count(*) AS n_links FROM link GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_links, 0) AS n_links, head.class_id, d.doc_id IS NOT DISTINCT FROM head.class_id AS kept FROM d JOIN head ON head.r = d.r LEFT JOIN k ON k.r = d.r""",
}
