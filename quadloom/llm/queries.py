"""The thin queries over the operators of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import ann, licenses, line_dedup, mixing, near_dup, pieces, quality, secrets, token_counts, toxicity
from quadloom.llm.workspace import materialize, new_path

#: Names of vocabulary files; each executor looks up where its own copy lies.
PIECE_MODEL, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def tokenizer_file(name: str) -> Callable[[], str]:
    def where() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return where


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.LanguageModel(toxicity.letter_counts(docs))
    sample = F.broadcast(materialize(toxicity.sample_labels(labels), "labels"))  # toxicity.SAMPLE rows at most
    learnt = toxicity.fit(docs.join(sample, "doc_id").select("text", "toxic"), model)
    scored = toxicity.score(docs, model, learnt)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = lambda x: x["kind"] != "novel"
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, secrets.KINDS), F.sha2(joined(F.filter("secrets", base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(pieces.encode(docs, tokenizer_file(PIECE_MODEL), end=True, decoded=True))


def piece_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("id % 100 = 0"), k=10)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents, those revised that repeat a line, copies deleted, and the first again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    import public_tokenizers

    counters = {"piece_bpe_32k": token_counts.piece_counter(tokenizer_file(PIECE_MODEL)), "byte_bpe_50k": token_counts.rank_counter(tokenizer_file(RANKS), public_tokenizers.PATTERN)}
    ledger = token_counts.TokenLedger(spark, new_path(spark, "ledger"), counters)
    ledger.commit("documents", docs)
    ledger.commit("revisions", revisions(docs))
    ledger.commit("copies", copies(docs))
    ledger.commit("documents", docs)  # a replay
    return ledger.totals()


def revisions(docs: DataFrame) -> DataFrame:
    """Documents that repeat a line, without its repetitions."""
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    return docs.withColumn("once", once).where("once <> text").select("doc_id", F.col("once").alias("text"), "source", "lang", F.lit("revise").alias("op"))


def copies(docs: DataFrame) -> DataFrame:
    """Deletes of documents whose text a smaller doc_id has."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5("text").alias("mark"))
    # the first by mark is an aggregate, so a text of many copies is summed up before it is shuffled
    firsts = rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    later = rows.join(firsts, ["mark", "doc_id"], "left_anti").select("doc_id").distinct()
    null = F.lit(None).cast("string")
    return later.select("doc_id", null.alias("text"), null.alias("source"), null.alias("lang"), F.lit("delete").alias("op"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_rows(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "n_tokens", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dup": op2_near_dup,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_secrets": op5_secrets,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_nearest": op8_nearest,
    "op9_token_counts": op9_token_counts,
    "op10_source_mixing": op10_source_mixing,
}

_SPACE = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
          FROM documents),
        keyed AS (
          SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM lines),
        common AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        judged AS (
          SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS dropped FROM keyed LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op10_source_mixing": rf"""
        WITH RECURSIVE rows AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                 CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
          FROM documents),
        sources AS (SELECT source, sum(n_tokens) AS total FROM rows GROUP BY source),
        held AS (SELECT total, total / (SELECT sum(total) FROM sources)::DOUBLE AS p FROM sources WHERE total > 0),
        target AS (SELECT {mixing.ENTROPY_SHARE} * ln(count(*)) AS h FROM held),
        steps AS (
          SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
          UNION ALL
          SELECT i + 1, CASE WHEN e >= t THEN mid ELSE lo END, CASE WHEN e >= t THEN hi ELSE mid END
          FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2)) AS e, any_value(h) AS t
                FROM steps, held, target WHERE i < {mixing.STEPS} GROUP BY i, lo, hi)),
        chosen AS (
          SELECT round(CASE WHEN (SELECT -sum(p * ln(p)) FROM held) >= (SELECT h FROM target) OR (SELECT count(*) FROM held) < 2 THEN 1.0 ELSE lo END, {mixing.DECIMALS}) AS a
          FROM steps WHERE i = {mixing.STEPS}),
        quotas AS (
          SELECT source, total, CASE WHEN total > 0 THEN CAST(round((SELECT max(total / total::DOUBLE ** a) FROM sources WHERE total > 0) * total::DOUBLE ** a) AS BIGINT) END AS quota
          FROM sources, chosen),
        placed AS (
          SELECT r.*, q.total, q.quota,
                 coalesce(sum(n_tokens) OVER (PARTITION BY r.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM rows r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, source, n_tokens,
               CAST(CASE WHEN total > 0 THEN quota // total + CAST(before < quota % total AS BIGINT) ELSE 1 END AS BIGINT) AS copies
        FROM placed""",
}
