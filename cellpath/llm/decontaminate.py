"""Find benchmark passages in documents by a prefix-filtered set join.

An item's windows are its runs of ``window`` words; an item with fewer words is one window. A window is a set of
shingles of ``SHINGLE`` words (of all its words where it has fewer), and a document that holds the window holds
all of them, so one necessary shingle, the rarest in the documents, is enough to find it by.

1. One pass over the documents keeps runs of positions whose shingles occur in any window (a bitmap of
   bounded size may let others through). A window lies within one such run. Equal runs are handled once.
2. Shingles are counted over the documents; each window is joined by its rarest one.
3. Length and position bounds place the window in the run, and its words are compared.

Null or empty texts have no words and no hits; items without words have no windows. Repeated rows, of documents
or items, are handled each. Ties in rarity go to the earlier shingle. Empty tables give no hits or no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.llm.bitmaps import bitmap, holds
from cellpath.llm.files import partition_index
from cellpath.llm.staged import keep, stage
from cellpath.llm.words import ALNUM, Words, grams, slices

WINDOW = 10
SHINGLE = 5
#: Windows that begin in one piece of a long run.
PIECE = 128

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _words_text(words: Words, raw: bytes, first: int, last: int) -> str:
    """Words ``first .. last - 1``, lower case, joined by one space."""
    s, e = words.starts, words.ends
    return b" ".join(raw[s[k] : e[k]] for k in range(first, last)).translate(_LOWER).decode("utf-8", "replace")


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of the items: item_id (string), size (words), n (words a shingle), words, shingles (hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"], ALNUM, lower=True)
                raw = words.data.tobytes()
                hashes = {n: grams(words.hashes, n) for n in range(1, SHINGLE + 1)}
                out = {k: [] for k in ("item_id", "size", "n", "words", "shingles")}
                for item, low, high in zip(part["item_id"].to_pylist(), words.rows[:-1], words.rows[1:]):
                    size = int(min(window, high - low))
                    n = min(SHINGLE, size)
                    for at in range(low, high - size + 1) if size else ():
                        out["item_id"].append(item)
                        out["size"].append(size)
                        out["n"].append(n)
                        out["words"].append(_words_text(words, raw, at, at + size))
                        out["shingles"].append(hashes[n][at : at + size - n + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["item_id"], pa.string()),
                        pa.array(out["size"], pa.int32()),
                        pa.array(out["n"], pa.int32()),
                        pa.array(out["words"], pa.string()),
                        pa.array(out["shingles"], pa.list_(pa.int64())),
                    ],
                    names=list(out),
                )

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item_id string, size int, n int, words string, shingles array<long>")


def _runs(docs: DataFrame, known: Broadcast, least: dict[int, int], window: int) -> DataFrame:
    """Per document: row, doc_id, n_words, runs (n, at, words, shingles), long ones in pieces that overlap by a window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = partition_index() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"], ALNUM, lower=True)
                ends, owner = np.repeat(words.rows[1:], words.counts()), words.row_of_word()
                found = []
                for n, shortest in least.items():
                    g = grams(words.hashes, n)
                    at = np.flatnonzero(holds(known.value, g))
                    at = at[at + n <= ends[at]]
                    if not len(at):
                        continue
                    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) > 0)) + 1
                    first = at[np.concatenate([[0], breaks])]
                    last = at[np.concatenate([breaks - 1, [len(at) - 1]])]
                    for a, b in zip(first, last):
                        for low in range(a, b + 1, PIECE) if b - a + 1 >= shortest else ():
                            high = min(b + 1, low + PIECE + window - n)
                            found.append((int(owner[a]), n, int(low), int(high) - 1 + n, g[low:high].view(np.int64)))
                found.sort(key=lambda x: (x[0], x[1], x[2]))
                raw = words.data.tobytes() if found else b""
                runs = pa.StructArray.from_arrays(
                    [
                        pa.array([x[1] for x in found], pa.int32()),
                        pa.array([x[2] - int(words.rows[x[0]]) for x in found], pa.int64()),
                        pa.array([_words_text(words, raw, x[2], x[3]) for x in found], pa.string()),
                        pa.array([x[4] for x in found], pa.list_(pa.int64())),
                    ],
                    names=["n", "at", "words", "shingles"],
                )
                at = np.searchsorted([x[0] for x in found], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(part.num_rows)),
                        part["doc_id"],
                        pa.array(words.counts(), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs),
                    ],
                    names=["row", "doc_id", "n_words", "runs"],
                )
                row += part.num_rows

    return docs.mapInArrow(
        find,
        "row long, doc_id long, n_words long, runs array<struct<n: int, at: long, words: string, shingles: array<long>>>",
    )


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """Per document row: row, doc_id, n_words, hits (start and size in words, merged at use), items (ids as strings)."""
    spark = docs.sparkSession
    cut = stage(windows(items, window, item_col), "windows")
    sizes = {r["n"]: r["least"] - r["n"] + 1 for r in cut.groupBy("n").agg(F.min("size").alias("least")).collect()}  # <= 5 rows
    shingles = spark.sparkContext.broadcast(bitmap(cut.select(F.explode("shingles").alias("h"))))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stage(_runs(plain, shingles, sizes, window), "runs")
    runs = found.select("row", F.inline("runs"))

    distinct = keep(
        runs.groupBy("n", "words").agg(F.count("*").alias("copies"), F.first("shingles").alias("shingles")))
    counts = distinct.select("n", "copies", F.explode("shingles").alias("h")).groupBy("n", "h").agg(F.sum("copies").alias("count"))
    unique = cut.select("size", "n", "words", "shingles").dropDuplicates(["size", "words"])
    rarest = (
        unique.select("size", "n", "words", F.posexplode("shingles").alias("place", "h"))
        .join(counts.hint("merge"), ["n", "h"], "left")  # a window with a shingle that no document has cannot occur
        .groupBy("size", "n", F.col("words").alias("window"))
        .agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "h")).alias("rare"),
        )
        .where("rare.count > 0")
        .select("size", "n", "window", "rare.place", "rare.h")
    )
    start = F.col("i") - F.col("place")
    hits = (
        distinct.select("n", "words", F.size("shingles").alias("positions"), F.posexplode("shingles").alias("i", "h"))
        .join(rarest.hint("merge"), ["n", "h"])
        .where((start >= 0) & (start + F.col("size") <= F.col("positions") + F.col("n") - 1))
        .where(F.array_join(F.slice(F.split("words", " "), start + 1, F.col("size")), " ") == F.col("window"))
        .select("n", "words", "window", start.cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    )
    hits = keep(hits)
    spans = hits.groupBy("n", "words").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    owners = cut.select(F.col("words").alias("window"), "item_id").distinct()
    named = hits.select("n", "words", "window").distinct().join(owners.hint("merge"), "window")
    ids = named.groupBy("n", "words").agg(F.collect_set("item_id").alias("ids"))
    known = keep(spans.join(ids.hint("merge"), ["n", "words"]))
    per_row = (
        runs.select("row", "n", "at", "words")
        .join(known.hint("merge"), ["n", "words"])  # its size as shuffled says little: equal passages compress well
        .select("row", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["size"].alias("size"))).alias("spans"), "ids")
        .groupBy("row")
        .agg(F.flatten(F.collect_list("spans")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("items"))
    )
    none = F.array().cast("array<struct<start: bigint, size: bigint>>")
    return found.select("row", "doc_id", "n_words").join(per_row.hint("merge"), "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("hits", none).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(hits) -> F.Column:
    """Words inside any of the spans."""
    return F.aggregate(
        F.sort_array(hits),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
