"""The subpackage's queries over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, language, licenses, linededup, neardup, packing, quality, rules, secrets, spelling, substrings, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(number: int, column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(number))


def _places(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    found = secrets.secret_scan(documents, secrets.learn(documents))
    base = F.filter("spans", lambda s: s["kind"] != secrets.LEARNT)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(_places(base), 256).alias("base_sha256"), _places(F.col("spans")).alias("spans"), count(secrets.LEARNT).alias("n_learnt"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality.train(quality.training_rows(documents, labels, _fold(4, "id") != 2))
    scored = quality.score_documents(documents, model)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), shingle=4)


def op4_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.quality_rules(_table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language.train(language.training_texts(documents, _fold(3, "id") != 1), language.Pieces.load())
    found = language.identify(documents, model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_linededup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    done = linededup.drop_repeated_lines(documents, linededup.repeated_lines(documents))
    return done.select("doc_id", "n_lines", "n_removed", "text")


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, folder, "documents"))
    labels = F.array_join(F.array_sort(F.array_union("base_labels", "template_labels")), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), "score")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log made from pages: each page's full response and, a day later, a not-modified revisit.

    A page is fetched at page_id * 7919 mod 2,592,000 seconds after 2024-01-01.  Every third revisit carries a
    changed entity tag, every seventh none (Last-Modified only), every eleventh neither.
    """
    pages = pages.select("page_id", "url", F.md5("html").alias("digest"))
    fetched = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(2_592_000)))
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    modified = F.concat(F.lit("day-"), F.pmod("page_id", F.lit(9)).cast("string"))
    full = F.array(item("ETag", quoted(F.col("digest"))), item("Last-Modified", modified), item("Cache-Control", F.lit("max-age=60")), item("Content-Type", F.lit("text/html")))
    tag = F.when(F.col("page_id") % 3 == 0, quoted(F.concat(F.lit("new-"), "digest"))).otherwise(F.concat(F.lit("W/"), quoted(F.col("digest"))))
    plain = F.array(item("Cache-Control", F.lit("max-age=900")), item("Set-Cookie", F.lit("a=b")))
    update = F.when(F.col("page_id") % 11 == 0, plain).when(F.col("page_id") % 7 == 0, F.concat(plain, F.array(item("Last-Modified", modified)))).otherwise(F.concat(plain, F.array(item("ETag", tag))))
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", fetched.alias("warc_date"), F.lit("response").alias("warc_type"), F.lit(200).alias("status"), full.alias("headers"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (fetched + F.expr("interval 1 day")).alias("warc_date"), F.lit("revisit").alias("warc_type"), F.lit(304).alias("status"), update.alias("headers"))
    return response.unionByName(revisit)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_records(_table(spark, folder, "pages")))
    listed = F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ";")
    merged = F.when(F.col("refers_to").isNotNull(), listed)
    return found.select(((F.col("record_id") - 1) / 2).cast("bigint").alias("page_id"), "url_key", "outcome", (F.col("refers_to") / 2).cast("bigint").alias("refers_to"), merged.alias("headers"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(_table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_substrings(spark: SparkSession, folder: str) -> DataFrame:
    done = substrings.drop_repeats(_table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_neardup, op4_rules, op5_decontamination, op6_language, op7_linededup, op8_licenses, op9_warc, op10_packing, op11_collocations, op12_spelling, op13_substrings)}
