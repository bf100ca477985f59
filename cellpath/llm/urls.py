"""URL filter: rules for hosts and paths, and a logistic regression on hashed character n-grams for the rest.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes on from there up to
``?``, ``#`` or the end. A rule names a host, which stands for its subdomains too, and how the path begins; of several that fit the longest decides
(ties: the first in the list). What no rule fits is judged by the model: every n-gram of 3 to 5 bytes of the host and of the
path, both with marks for begin and end if not empty and A-Z as a-z, adds the weight of its bucket, divided by the root of the number of
n-grams of its part.

The model is fitted in one task to a small table of labelled urls: at most about ``MOST_LABELS`` rows of each label, by hash where there
are more. It is ``2 ** BITS`` weights, whatever it was fitted to, which bounds what is broadcast.

Null urls, and those without ``://``, have an empty host and an empty path; without n-grams there is no evidence: they are allowed, with a null score. Urls of any length take
time in proportion. Repeated rows are judged alike and each returned. Labelled rows without a url or a label are left out; with
labels of one kind only, or none, nothing is blocked by the model. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpath.llm.words import byte_values, grams, mix, ragged, slices, text_bytes

MOST_LABELS = 20_000
BITS = 16
LENGTHS = (3, 4, 5)
#: Weight of all blocked urls together in the fit, the others having the rest.
SHARE = 0.35
RIDGE = 2e-5
ROUNDS = 400

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column, never null."""
    rest = F.coalesce(F.expr(f"if(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')"), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """Text of the longest rule that fits, or null."""

    def fits(rule: Rule) -> Column:
        same = (F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)
        return F.when(same & F.col(path).startswith(rule.path), F.lit(rule.text()))

    longest = sorted(rules, key=lambda r: -len(r.text()))
    return F.coalesce(*map(fits, longest), F.lit(None).cast("string"))


def _buckets(column: pa.Array, kind: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every n-gram of a text column."""
    mark = lambda c: pa.scalar(c, pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.if_else(pc.equal(column, mark("")), column, pc.binary_join_element_wise(mark("\x02"), column, mark("\x03"), mark("")))
    data, at = text_bytes(column)
    size = np.diff(at)
    values = byte_values(True)[data]
    rows, found = [], []
    for n in LENGTHS:
        each = np.maximum(size - n + 1, 0)
        rows.append(np.repeat(np.arange(len(size)), each))
        found.append(grams(values, n)[ragged(at[:-1], each)])
    row = np.concatenate(rows)
    bucket = (mix(np.concatenate(found) + kind) >> np.uint64(64 - BITS)).astype(np.int64)
    number = np.bincount(row, minlength=len(size))
    return row, bucket, 1 / np.sqrt(number[row])


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every n-gram of the hosts and the paths of all rows."""
    parts = zip(_buckets(host, _HOST), _buckets(path, _PATH))
    row, bucket, value = (np.concatenate(p) for p in parts)
    return row, bucket, value


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Log-odds of a block for each row."""
        row, bucket, value = features(host, path)
        return self.bias + np.bincount(row, self.weights[bucket] * value, len(host))


def _descend(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> Model:
    """Ridge logistic regression by accelerated gradient descent."""
    share = np.where(wanted > 0, SHARE / max(wanted.sum(), 1), (1 - SHARE) / max((1 - wanted).sum(), 1))
    weights = ahead = np.zeros(1 << BITS)
    bias = bias_ahead = 0.0
    # Each row has unit squares in its host and in its path, besides the bias: the curvature is at most 3 / 4.
    step = 1 / (0.75 + RIDGE)
    for k in range(ROUNDS):
        odds = bias_ahead + np.bincount(row, ahead[bucket] * value, len(wanted))
        gap = share * (1 / (1 + np.exp(-odds)) - wanted)
        slope = np.bincount(bucket, gap[row] * value, 1 << BITS) + RIDGE * ahead
        moved, bias_moved = ahead - step * slope, bias_ahead - step * gap.sum()
        push = k / (k + 3)
        ahead, bias_ahead = moved + push * (moved - weights), bias_moved + push * (bias_moved - bias)
        weights, bias = moved, bias_moved
    return Model(weights, float(bias))


def _same_value(value: np.ndarray, row: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of equal buckets of a row added up, and rows scaled so that none is longer than the root of two."""
    key, place = np.unique(row * (1 << BITS) + bucket, return_inverse=True)
    total = np.bincount(place, value)
    row, bucket = key >> BITS, key & ((1 << BITS) - 1)
    return row, bucket, total


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = MOST_LABELS) -> Model:
    """Model of labelled urls; ``label_col`` is true, or 1, for what is to be blocked."""
    host, path = host_and_path("url")
    rows = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("boolean").alias("blocked"))
    rows = rows.where("url is not null and blocked is not null").distinct()
    sizes = {r.blocked: r["count"] for r in rows.groupBy("blocked").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / (1 << 30)
    few = reduce(Column.__or__, ((F.col("blocked") == F.lit(b)) & (place < most / n) for b, n in sizes.items()))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("blocked", "ascending"), ("url", "ascending")])
        row, bucket, value = features(table["host"].combine_chunks(), table["path"].combine_chunks())
        row, bucket, value = _same_value(value, row, bucket, table.num_rows)
        length = np.sqrt(np.bincount(row, value * value, table.num_rows))
        value = value / np.maximum(length / np.sqrt(2), 1)[row]
        wanted = table["blocked"].combine_chunks().cast(pa.int8()).to_numpy(zero_copy_only=False).astype(np.float64)
        model = _descend(row, bucket, value, wanted)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    # One task: its rows are bounded by ``most``.
    found = rows.where(few).select("url", "blocked", host.alias("host"), path.alias("path")).coalesce(1)
    weights, bias = found.mapInArrow(train, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(weights)), bias)


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (log-odds of a block by the model, null where it is not asked)."""
    host, path = host_and_path("_url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("rule", rule_of(rules))
    verdicts = {r.text(): r.verdict for r in reversed(list(rules))}
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["page_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "path"):
                some = pc.or_(pc.not_equal(part["host"], ""), pc.not_equal(part["path"], ""))
                free = pc.and_(pc.is_null(part["rule"]), some)
                odds = np.full(part.num_rows, np.nan)
                at = np.flatnonzero(free.to_numpy(zero_copy_only=False))
                if len(at):
                    odds[at] = shared.value.score(part["host"].filter(free), part["path"].filter(free))
                said = [verdicts.get(r) for r in part["rule"].to_pylist()]
                verdict = [v or ("block" if x > 0 else "allow") for v, x in zip(said, odds)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(verdict, pa.string()), pa.array(odds, mask=np.isnan(odds))],
                    names=["page_id", "host", "path", "rule", "verdict", "score"],
                )

    return ruled.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
