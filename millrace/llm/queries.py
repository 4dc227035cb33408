"""The ``opN_<name>`` queries and the pipeline: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, decontaminate, embeddings, langid, licenses, long_repeats, mixing, ngram_join, runs, sharding, tokens, url_filters, warc

#: Public vocabulary files; a parameter of the operators that use one.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a seventh of them in their source's folder, the others one folder below."""
    part = F.col("doc_id") % 7
    path = F.concat("source", F.when(part == 0, F.lit("/")).otherwise(F.concat(F.lit("/p"), part, F.lit("/"))), "doc_id", F.lit(".txt"))
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(*warc.write_warc(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=400, texts_too=False).drop("kept")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_files(spark, *tokens.write_token_files(_table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE)))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the order before them; copies of a click that differ count as one of their least time and client."""
    number = lambda c: F.crc32(c.cast("string").cast("binary"))
    used = lambda t, odd: F.when(F.coalesce(odd, F.lit(False)), t - F.pmod(t, F.lit(asof.HOUR))).otherwise(t)
    clicks = _table(spark, sf_dir, "clicks")
    once = clicks.groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min(asof.micros(clicks, "ts")).alias("t"))
    once = once.select("click_id", "client_id", used(F.col("t"), number(F.col("click_id")) % 2 == 1).alias("ts_us"))
    sales = _table(spark, sf_dir, "sales")
    h = number(F.col("sale_id"))
    orders = sales.select(
        "client_id", used(asof.micros(sales, "sold_at"), h % 2 == 1).alias("ts_us"), F.floor(F.col("total") * 100 + 0.5).alias("total_cents"),
        F.explode(F.array(F.struct("sale_id", F.col("priority").cast("long").alias("priority")), F.when(h % 3 != 0, F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).cast("long").alias("priority"))))).alias("o"),
    ).where("o IS NOT NULL").select("client_id", "ts_us", "total_cents", "o.sale_id", "o.priority")
    orders = asof.collapse_ties(orders, "client_id", "ts_us", ["priority"], ["sale_id"], ["sale_id", "total_cents"])
    found = asof.asof_join(once, orders, "client_id", "ts_us", ["sale_id", "total_cents", "n_tied"], 240 * asof.HOUR)
    return found.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("matched_at")).alias("lag_us"), "total_cents", F.coalesce("n_tied", F.lit(0)).alias("n_tied"))


#: Host, path and verdict of the rules that op12 judges by.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a list has no verdict of its own on a url that isn't there: such urls are allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), rules, keep=("page_id",))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.repeated_runs(_table(spark, sf_dir, "documents"), change=runs.planted)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return dict(ORACLE)
