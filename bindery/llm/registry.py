"""The operators of this folder over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import (
    exact,
    filteraudit,
    language,
    lines,
    packing,
    prefixbpe,
    quality,
    secretscan,
    sharding,
    simhash,
    tokenfiles,
    vptrees,
    whitening,
)
from bindery.llm.common import documents, hex_sha256
from bindery.scratch import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), WORDS)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir), digest=True)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(documents(spark, sf_dir), path, WORDS)
    rows = tokenfiles.read_token_files(spark, path)
    rows = rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return tokenfiles.with_starts(spark, path, rows).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefixbpe.encode_documents(documents(spark, sf_dir), BYTES)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(documents(spark, sf_dir))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vptrees.near_duplicates(documents(spark, sf_dir))
    return rows.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_languages(docs.where(~language.held_out()))
    rows = language.predict_languages(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts = ("n_lines", "n_equal", "n_near")
    rows = lines.drop_repeated_lines(docs, counts=counts)
    digest = hex_sha256(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", *counts, digest.alias("text_sha256"))


def _digest(spans: str):
    """`kind:start:stop` of each span, joined by commas."""
    return F.expr(
        f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secretscan.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = "filter(spans, s -> s.kind != 'entropy')"
    return rows.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
            for kind in secretscan.KINDS
        ),
        hex_sha256(_digest(base)).alias("base_sha256"),
        _digest("spans").alias("spans"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.stratified_shards(documents(spark, sf_dir))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _labels(spark, sf_dir).where("quality = 1")
    return quality.quality_rules(documents(spark, sf_dir), trusted)


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filteraudit.failure_counts(documents(spark, sf_dir), _labels(spark, sf_dir))
    return filteraudit.filter_steps(counts, filteraudit.FILTERS)


QUERIES = {
    "op1_packing": packed,
    "op2_exact_dedup": exact_dedup,
    "op3_bpe": bpe_round_trip,
    "op4_fingerprints": document_fingerprints,
    "op5_simhash_dedup": near_dedup,
    "op6_language_id": language_id,
    "op7_token_files": token_files,
    "op8_line_dedup": line_dedup,
    "op9_secret_scan": secret_scan,
    "op10_sharding": shards,
    "op11_whitening": whitened,
    "op12_quality_rules": quality_verdicts,
    "op13_filter_audit": filter_interactions,
}

ORACLES = {
    "op2_exact_dedup": r"""
        with d as (
          select doc_id,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
          from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, text_sha256,
          doc_id = min(doc_id) over w as kept
        from d window w as (partition by text_sha256)
    """,
    "op13_filter_audit": r"""
        with d as (
          select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
            min(doc_id) over (partition by coalesce(text, '')) as first_id
          from documents
        ),
        known as (
          select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
        ),
        masks as (
          select part,
            case when len(words) < 200 then 'A' else '' end
            || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
            || case when 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 2 * length(body) then 'C' else '' end
            || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end
            || case when doc_id > first_id then 'E' else '' end as mask,
            count(*) as n, coalesce(sum(known.good), 0) as good, coalesce(sum(known.toxic), 0) as toxic
          from d left join known using (doc_id) group by all
        ),
        letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (
          select a.x || b.x || c.x || d.x || e.x as filter_order
          from letter a, letter b, letter c, letter d, letter e
          where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ),
        met as (
          select part, mask, n, good, toxic, filter_order,
            case when mask = '' then 6 else
              list_min(list_transform(string_split(mask, ''), lambda f: instr(filter_order, f))) end as first_met
          from masks, orders
        ),
        steps as (
          select part, filter_order, step, substr(filter_order, step, 1) as filter,
            sum(case when first_met > step then n else 0 end)::bigint as kept,
            sum(case when first_met = step then n else 0 end)::bigint as removed,
            sum(case when first_met < step and contains(mask, substr(filter_order, step, 1)) then n else 0 end)::bigint
              as redundant,
            sum(case when mask = substr(filter_order, step, 1) then n else 0 end)::bigint as unique_fails,
            sum(case when first_met = step then good else 0 end)::bigint as good_lost,
            sum(case when first_met = step then toxic else 0 end)::bigint as toxic_lost
          from met, (select unnest([1, 2, 3, 4, 5]) as step) group by all
        )
        select * exclude (filter), (sum(removed) over (partition by part, filter))::bigint as shapley from steps
    """,
}
