"""Registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from ..sources.tables import table
from . import bpe, collocations, decontaminate, html_text, licenses, line_dedup, merkle, mixing, quality, secrets, sharding, simhash, warc
from .frames import lower_ascii, saved


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontaminate.contamination(docs, benchmark, keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one stored ledger: about half of the rows, dealt by a hash, have been there before and were scanned by the
    base rules; now all rows are scanned by all rules, but for the pairs seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = shared_dir(spark, "secrets-ledger")
    secrets.advance(docs.where(F.xxhash64("doc_id") < 0), "text", ledger, secrets.RULES[:3])
    found = secrets.findings(secrets.advance(docs, "text", ledger))
    out = secrets.report(docs, "text", found, keep=["doc_id"])

    def spans(found):
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def n(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter("found", lambda x: x["rule"] < 3)
    return out.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                      F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))


HOT = "http://Hot.example/?utm_source="  # one page after canonicalisation


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from ``pages``: each page is fetched in full, by every third also a second time with another body, and asked
    for again by other spellings of its URL: between the two (every 5th before both), and after both (of the twice fetched every 4th with
    the first one's ETag, every 7th with one of neither).  Two more records for each page are of one hot URL: a full response of every 50th
    page, else revisits by Last-Modified (every 13th with an older one, every 11th without validators)."""
    i, url = F.col("page_id"), F.regexp_replace("url", r"^https?://", "http://WWW.")
    html = F.coalesce("html", F.lit(""))
    tag, tag2 = (F.concat(F.lit('"'), F.md5(x), F.lit('"')) for x in (html, F.concat(html, F.lit("2"))))
    body2 = F.concat(html, F.lit("<!-- 2 -->"))
    day, start, twice, answers = 86_400, i * 60 + 1_700_000_000, i % 3 == 0, i % 50 == 0
    block = F.floor(i / 50)

    def headers(*pairs):
        return F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])

    def visit(number, spelled, at, status, body, given):
        return F.struct(F.lit(number).alias("visit"), spelled.alias("url"), F.timestamp_seconds(at).alias("ts"),
                        F.lit(status).alias("status"), body.alias("body"), given.alias("headers"))

    def full(number, at, body, etag):
        return visit(number, F.col("url"), at, 200, body, headers(
            ("Content-Type", F.lit("text/html")), ("ETag", etag), ("Content-Length", F.length(body)), ("Cache-Control", F.lit("max-age=60"))))

    none, hot = F.lit(None).cast("string"), F.concat(F.lit(HOT), i)
    visits = F.array(
        full(0, start, F.col("html"), tag),
        visit(1, F.concat(url, F.lit("#again")), start + F.when(i % 5 == 0, -day).otherwise(day), 304, none, headers(
            ("etag", F.concat(F.lit("W/"), tag)), ("Content-Length", F.lit(0)), ("cache-control", F.lit("max-age=600")))),
        visit(2, F.col("url"), start + 2 * day, 304, none, headers(
            ("ETag", F.when(i % 7 == 0, '"other"').when(twice & (i % 4 != 0), tag2).otherwise(tag)), ("Age", F.lit(1)))),
        F.when(twice, full(3, start + day + day // 2 + 30, body2, tag2)),
        F.when(answers, visit(4, hot, start, 200, F.concat(F.lit("<p>"), i, F.lit("</p>")), headers(("Content-Type", F.lit("text/html")), ("Last-Modified", block))))
         .otherwise(visit(4, hot, start, 304, none, F.when(i % 11 == 0, headers(("Age", F.lit(1))))
                          .otherwise(headers(("Last-Modified", F.when(i % 13 == 0, block - 1).otherwise(block)))))),
        visit(5, hot, start + 20, 304, none, headers(("last-modified", block), ("Set-Cookie", F.lit("k=1")))))
    return pages.select("page_id", F.explode(F.filter(visits, lambda v: v.isNotNull())).alias("v")) \
        .select("page_id", "v.*").withColumn("record_id", i * 6 + F.col("visit"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(captures(table(spark, sf_dir, "pages")))
    shown = F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"]))
    return out.select("record_id", "page_id", "url", F.unix_timestamp("ts").alias("ts"), "status", "outcome", "refers_to",
                      F.array_join(shown, "\n").alias("headers"), F.length("body").cast("bigint").alias("n_chars"),
                      F.sha2("body", 256).alias("body_sha256"))


def op8_place_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, docs["doc_id"], sharding.shard_names(sharding.SHARDS), sharding.SLOTS)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeats(docs, min_words=line_dedup.PASSAGE_WORDS, sentences=True).select("doc_id", "text", "kept", "removed", "n_removed")


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeats(docs, sentences=True).select("doc_id", "text", "kept", "removed", "n_removed")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = saved(quality.measures(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    out = quality.judged(measured, quality.posteriors(measured))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "quality")


def op11_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, keep=["doc_id"])
    out = bpe.decode(ids, vocabulary)
    return out.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "lang", merkle.leaf(*rest, F.col("text")).alias("leaf"), merkle.leaf(*rest, tampered).alias("claimed"))
    out = merkle.climb(merkle.build(leaves, "lang", ["doc_id"], "leaf", ["doc_id", "claimed"]), "claimed", keep=["doc_id"])
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
                      F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_mix_sources, op3_simhash, op4_main_text, op5_licenses, op6_secrets, op7_revisits, op8_place_shards, op9_line_dedup, op9_passage_dedup,
    op10_quality, op11_bpe, op12_merkle, op13_collocations)}
