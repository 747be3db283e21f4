"""The queries of this subpackage: name to (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catchment.llm.bpe import token_digests
from catchment.llm.centroids import SQL as CLUSTER_SQL
from catchment.llm.centroids import cluster
from catchment.llm.common import short_batches, spread
from catchment.llm.decontaminate import leaks
from catchment.llm.html import extract
from catchment.llm.langid import fit, held_out, identify
from catchment.llm.license import scan
from catchment.llm.neardup_vectors import near_vectors
from catchment.llm.pii import personal_data
from catchment.llm.resample import SQL as RESAMPLE_SQL
from catchment.llm.resample import resample
from catchment.llm.simhash import hex_fingerprint, simhash_groups
from catchment.llm.urlfilter import SQL as URL_SQL
from catchment.llm.urlfilter import filter_pages
from catchment.llm.warc import SQL as WARC_SQL
from catchment.llm.warc import archive_pages
from catchment.llm.wavelet import token_files

#: The tokenizer file of the queries; the operators take the path of any file of its kind.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence statements of every document."""
    short_batches(spark)
    return scan(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, for every document."""
    short_batches(spark)
    return token_digests(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path())


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the wrapper of its host."""
    short_batches(spark)
    return extract(spread(_table(spark, sf_dir, "pages")))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, count and checksum of every document's ids, read back from the shards."""
    short_batches(spark)
    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture against the list entries active when it was fetched."""
    return filter_pages(spark, _table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document leaks; documents that leak none have no row."""
    short_batches(spark)
    return leaks(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to ZIP-packaged archives and read back by ranges."""
    short_batches(spark)
    return archive_pages(_table(spark, sf_dir, "pages")).drop("url")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    short_batches(spark)
    groups = simhash_groups(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return groups.select("doc_id", hex_fingerprint(groups.fp).alias("fingerprint"), "component_id")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document by a network trained on documents not held out."""
    short_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    found = identify(spread(docs.select("doc_id", "text")), fit(docs))
    return found.select("doc_id", held_out(found.doc_id).alias("held_out"), "lang_pred", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and what contexts add."""
    return personal_data(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds from 40 centroids."""
    short_batches(spark, 10_000)
    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark and its place in the draw of 5 %."""
    return resample(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_license": (op1_license, None),
    "op2_bpe": (op2_bpe, None),
    "op3_html": (op3_html, None),
    "op4_wavelet": (op4_wavelet, None),
    "op5_vectors": (op5_vectors, None),
    "op6_urls": (op6_urls, URL_SQL),
    "op7_decontaminate": (op7_decontaminate, None),
    "op8_warc": (op8_warc, WARC_SQL),
    "op9_simhash": (op9_simhash, None),
    "op10_langid": (op10_langid, None),
    "op11_pii": (op11_pii, None),
    "op12_centroids": (op12_centroids, CLUSTER_SQL),
    "op13_resample": (op13_resample, RESAMPLE_SQL),
}
