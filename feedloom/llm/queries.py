"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import tokenized

    out = tokenized(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_pairs

    return edited_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import formatted, read_back

    # the digests are of whole conversations, so each is gathered into a row here; the operator's rows are windows
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(formatted(rows)).select("conv_id", F.struct("window", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("said"), "loss_text", F.char_length("formatted").alias("n")).alias("w"))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    loss = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    turns = F.flatten(F.transform("w", lambda x: x["said"]))
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("formatted_chars"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    # the text itself is not carried along
    rows = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated

    rows = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


#: A text is rejected as toxic from this score on.
TOXIC = 0.7


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Fitted on the labelled documents that are not held out."""
    from .common import remainder
    from .toxicity import fitted

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where((remainder(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    return fitted(docs, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .toxicity import score

    docs = read(spark, sf_dir, "documents")
    scored = docs.select("doc_id", score(F.col("text"), toxicity_model(spark, sf_dir)).alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .kneser_ney import scored_by

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    out, model = scored_by(docs, ~F.col("held_out"), keep_text=False)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import joined

    return joined(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, spans

    found = spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda which: F.array_join(F.transform(which, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named("spans").alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import payload_of, round_trip

    got = round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html")).where("kind = 'record'")
    h = lambda name: F.element_at("headers", name)
    answer = F.col("type") == "response"
    here = answer & F.col("file").isNull()
    return got.select(
        h("feedloom-key").cast("long").alias("page_id"),
        F.when(answer, F.col("size") - F.col("body")).otherwise(h("feedloom-payload-length").cast("long")).alias("payload_bytes"),
        # the reader has checked the digest of a block that is too large for a row
        F.when(here, F.sha2(payload_of(), 256)).otherwise(F.substring_index(h("warc-payload-digest"), ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        h("feedloom-refers-to-key").cast("long").alias("refers_to"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_fingerprints": op5_fingerprints,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op1_chat_format": op1_chat_format,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_sentencepiece": op8_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
        with b as (
            select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
        ), win as (
            select item, len(w) as n, array_to_string(w[i : i + 12], ' ') as phrase, least(13, len(w)) as size
            from b, unnest(range(1, greatest(1, len(w) - 12) + 1)) as t(i) where len(w) > 0
        ), d as (
            select row_number() over () as doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
        ), sizes as (select distinct size from win), cut as (
            select doc, size, i, array_to_string(w[i : i + size - 1], ' ') as phrase from d, sizes, unnest(range(1, len(w) - size + 2)) as t(i)
        ), found as (
            select doc, item, i, cut.size from cut join win on cut.phrase = win.phrase and cut.size = win.size
        ), hit as (
            select doc, count(distinct j) as n from found, unnest(range(i, i + size)) as t(j) group by doc
        ), its as (
            select doc, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc, item from found) group by doc
        )
        select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(its.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
        from d left join hit using (doc) left join its using (doc)
    """,
    "op10_warc": """
        with p as (
            select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
        ), f as (
            select d, min(page_id) as first from p where n >= 100 group by d
        )
        select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
               case when f.first < page_id then 'revisit' else 'response' end as record_type,
               case when f.first < page_id then f.first end as refers_to
        from p left join f using (d)
    """,
}
