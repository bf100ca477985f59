"""Registered queries of the numbered operators and their SQL, over the tables of a folder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.llm import backoff, decontaminate, embeddings, html, packing, pii, quality, runs, setsketch, token_store, urls, warc, whitening
from cellpath.llm.url_labels import labelled_urls
from cellpath.session import scratch_path
from cellpath.ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.with_spans(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, payloads=False)
    # What was written comes back whole, or the query ends.
    holds = F.when(F.coalesce("digest_holds", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    return found.select("page_id", "payload_bytes", holds.alias("payload_digest"), "record_type", "refers_to")


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op8_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-store")
    files = token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_store.read_digests(files)


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return backoff.score_texts(table(spark, sf_dir, "documents"), held)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_text(doc_id: int | None, text: str | None) -> str | None:
    """The text itself, but of a tenth of the documents the words from one on, chosen by id, are a period's words again and again."""
    if doc_id is None or text is None:
        return text
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    words, g = _WORD.findall(text), h // 10
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[:a] + [words[a + k % p] for k in range(n - a)])


def with_repeated_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of the registered run query: documents, of which some repeat by construction."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([repeated_text(i, t) for i, t in zip(ids, texts)], pa.string())], names=["doc_id", "text"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(with_repeated_texts(table(spark, sf_dir, "documents"))))


#: Rules of the registered url filter (fixed values).
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, urls.fit(labelled_urls(spark)))


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_pii": op2_pii,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_html": op5_html,
        "op6_warc": op6_warc,
        "op7_setsketch": op7_setsketch,
        "op8_int8_tiles": op8_int8_tiles,
        "op9_token_store": op9_token_store,
        "op10_backoff_automaton": op10_backoff_automaton,
        "op11_whitening": op11_whitening,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_url_filter": op13_url_filter,
    }


OP6_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), q AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), r AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL}
