"""Token ids of documents as Parquet files in document order, with selective reads.

Ids are a list column with dictionary pages, document ids and counts are delta encoded, row groups hold about
``GROUP_TOKENS`` ids, and every column has a page index, so a reader can skip to single documents
and read counts without touching ids. The files are ordinary Parquet: ``spark.read.parquet`` reads them too.

Null text is empty: its only id is the end id. An empty table gives an empty store. A null id sorts
first; rows with equal ids are kept, in order of their text. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellpath.llm.files import each, locate, partition_index, whole_file
from cellpath.llm.tokens import encoder, with_end
from cellpath.llm.words import slices
from cellpath.session import checkpoint, shuffle_partitions

GROUP_TOKENS = 2_000_000
PAGE_BYTES = 256 << 10

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.uint16()))])
_WIDE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def _writer(out, schema: pa.Schema) -> pq.ParquetWriter:
    return pq.ParquetWriter(
        out,
        schema,
        compression="zstd",
        compression_level=1,
        use_dictionary=["ids.list.element"],
        column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"},
        data_page_size=PAGE_BYTES,
        write_page_index=True,
    )


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", wide: bool = False
) -> DataFrame:
    """Encode and write; returns the files: part (in document order), path, n_docs, n_tokens.

    Documents move once, dealt out by ranges of their ids. ``wide`` stores 32-bit ids; without, an id beyond 16 bits is an error.
    """
    schema = _WIDE if wide else _SCHEMA

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_docs, n_tokens = partition_index(), 0, 0
        name = f"part-{part:06d}.parquet"
        encode = encoder(tokenizer, True).encode
        with whole_file(folder, name) as out, _writer(out, schema) as writer:
            waiting, held = [], 0
            for batch in batches:
                for piece in slices(batch, "text"):
                    ids, at = with_end(*encode(piece["text"]), end_id)
                    if not wide and len(ids) and int(ids.max()) > 0xFFFF:
                        raise OverflowError(f"token id {int(ids.max())} does not fit 16 bits: write with wide=True")
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(schema.field("ids").type.value_type.to_pandas_dtype())))
                    waiting.append(pa.record_batch([piece["doc_id"], pa.array(np.diff(at)), lists], schema=schema))
                    held, n_docs, n_tokens = held + len(ids), n_docs + piece.num_rows, n_tokens + len(ids)
                    if held >= GROUP_TOKENS:
                        writer.write_table(pa.Table.from_batches(waiting))
                        waiting, held = [], 0
            if waiting:
                writer.write_table(pa.Table.from_batches(waiting))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(write, "part long, path string, n_docs long, n_tokens long")
    return checkpoint(files)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a store: doc_id, n_tokens, ids; filters and column choice reach the files."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)


def read_digests(files: DataFrame) -> DataFrame:
    """Every document of the files read back: doc_id, start, n_tokens, ids_crc32."""

    def read(row: dict) -> Iterator[pa.RecordBatch]:
        store, path = locate(row["path"])
        with store.open_input_file(path) as source:
            before = 0
            for batch in pq.ParquetFile(source).iter_batches(4096):
                ids = batch["ids"]
                at = ids.offsets.to_numpy()
                flat = np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4")
                sizes = np.diff(at).astype(np.int64)
                start = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(sizes), row["part"]), pa.int64()),
                    "doc_id": batch["doc_id"],
                    "within": pa.array(start, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                })

    found = files.mapInArrow(
        lambda batches: each(batches, read), "part long, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = files.select(F.col("part").alias("of"), F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("base"))
    return found.join(offsets, F.col("part") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
