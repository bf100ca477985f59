"""Language-model scores of whole texts by a weighted backoff automaton learnt from the corpus.

The model is a word trigram, smoothed by Dirichlet priors: ``p(w | u v) = (c(u v w) + PRIOR * p(w | v)) / (c(u v) + PRIOR)`` where the pair
``u v`` came ``LEAST_HISTORY`` times or more in training, else ``p(w | v) = (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR)``, and
``p(w) = (c(w) + 1) / (N + V + 1)``, where one of the V + 1 types stands for all unknown words. As an automaton: the root, a state for every
training word (and the start of a text) and one for every such pair. A state has an arc for each word seen after it, and a failure arc of
weight ``PRIOR / (c + PRIOR)`` to the state of its last word, or the root. A text is read once from left to right: a token takes an arc
of the state that the tokens before it led to, or follows failure arcs, whose weights add up, until a state has one. The token leads to the state of
the pair that it ends, or its word, or the root.

Counts cover all training documents and stay distributed. Documents are held in blocks of about ``BLOCK`` bytes, a file each in the shared
folder. A block sends each of its distinct words and pairs once, with its count there, to the shard that the n-gram's hash names; shards
add up and answer in the same order; then the same for its triples whose first pair is a state. So a block gets the part
of the automaton that its texts can reach, and is never moved. A word that is in every text costs one entry per block, and no task holds
more than a block or a shard. Keys travel as differences of sorted hashes, counts as numbers of few bytes.

Null text is empty and scores its end token. Repeated rows count and score each. A null id is not held out. Empty tables give
empty results. Ties do not arise. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.llm.exchange import gather, pack, pack_keys, read_block, shard_bounds, store_block, unpack, unpack_keys
from cellpath.llm.files import partition_index
from cellpath.llm.staged import stage
from cellpath.llm.words import NOT_SPACE, Words, mix
from cellpath.session import scratch_path, shuffle_partitions

BLOCK = 16 << 20
PRIOR = 100.0
#: Pairs of words that came less often in training are no states.
LEAST_HISTORY = 2
#: Hashes of the end of a text and, as history, of its start.
END = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIR = np.uint64(0xA0761D6478BD642F)
_TRIPLE = np.uint64(0xE7037ED1A0B428DB)


class Block:
    """Documents of a block as tokens (places in sorted word hashes) with what came before them, and the distinct pairs."""

    def __init__(self, ids: pa.Array, held: np.ndarray, counts: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.ids, self.held, self.counts, self.words, self.tokens = ids, held, counts, words, tokens
        self.first = np.cumsum(counts) - counts
        end = len(words) - 1  # the end's hash is the largest; as history it is the start
        self.before = np.concatenate([[end], tokens[:-1]]).astype(np.int32)
        self.before[self.first] = end
        pair = mix(words[self.before] * _PAIR + words[tokens])
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.trained = np.repeat(~held, counts)

    @classmethod
    def of_texts(cls, table: pa.Table) -> Block:
        words = Words(table["text"], NOT_SPACE, lower=True)
        counts = words.counts() + 1
        at = np.cumsum(counts)
        hashes = np.full(int(at[-1]), END, np.uint64)
        inner = np.ones(len(hashes), np.bool_)
        inner[at - 1] = False
        hashes[inner] = words.hashes
        unique, tokens = np.unique(hashes, return_inverse=True)
        held = table["held"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.bool_)
        return cls(table["doc_id"].combine_chunks(), held, counts, unique, tokens.astype(np.int32))

    def write(self, folder: str, place: tuple[int, int]) -> int:
        columns = {"held": self.held, "counts": self.counts, "words": self.words, "tokens": self.tokens}
        return store_block(folder, place, {"ids": self.ids} | {name: pa.array(x) for name, x in columns.items()})

    @classmethod
    def read(cls, folder: str, name: int) -> Block:
        found = read_block(folder, name)
        return cls(found.pop("ids"), *(found[c].to_numpy(zero_copy_only=False) for c in ("held", "counts", "words", "tokens")))

    def training_counts(self) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.bincount(self.tokens[self.trained], minlength=len(self.words)),
            np.bincount(self.pair_of[self.trained], minlength=len(self.pairs)),
        )

    def triples(self, pair_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after a pair that is a state, the distinct triples' keys, and the triple that each of those tokens ends."""
        history = np.concatenate([[0], self.pair_of[:-1]])
        open_ = pair_counts[history] >= LEAST_HISTORY
        open_[self.first] = False
        at = np.flatnonzero(open_)
        keys, triple_of = np.unique(mix(self.pairs[history[at]] * _TRIPLE + self.words[self.tokens[at]]), return_inverse=True)
        return at, keys, triple_of


_REQUESTS = "shard long, block long, n_words long, words binary, word_counts binary, grams binary, gram_counts binary"


def _requests(name: int, shards: int, words: np.ndarray, word_counts: np.ndarray, grams: np.ndarray, gram_counts: np.ndarray) -> pa.RecordBatch:
    """What a block sends to every shard: sorted keys with training counts."""
    w, g = shard_bounds(words, shards), shard_bounds(grams, shards)
    rows = [
        (s, name, b - a, pack_keys(words[a:b]), pack(word_counts[a:b]), pack_keys(grams[c:d]), pack(gram_counts[c:d]))
        for s, (a, b, c, d) in enumerate(zip(w[:-1], w[1:], g[:-1], g[1:]))
        if b > a or d > c
    ]
    names = [c.split()[0] for c in _REQUESTS.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


_ANSWERS = "block long, shard long, tokens long, types long, words binary, grams binary"


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of a shard's keys for every block that asked, and the shard's own sums of words under block -1."""
    blocks, shard = table["block"].to_pylist(), table["shard"][0].as_py()

    def totals(keys: str, counts: str) -> tuple[list[bytes], np.ndarray]:
        own = [unpack_keys(x) for x in table[keys].to_pylist()]
        add = [unpack(x).astype(np.float64) for x in table[counts].to_pylist()]
        unique, place = np.unique(np.concatenate(own), return_inverse=True)
        sums = np.bincount(place, np.concatenate(add), len(unique)).astype(np.int64)
        ends = np.cumsum([len(k) for k in own])
        return [pack(part) for part in np.split(sums[place], ends[:-1])], sums

    words, sums = totals("words", "word_counts")
    grams, _ = totals("grams", "gram_counts")
    n = len(blocks)
    return pa.table({
        "block": pa.array([*blocks, -1], pa.int64()),
        "shard": pa.array([shard] * (n + 1), pa.int64()),
        "tokens": pa.array([0] * n + [int(sums.sum())], pa.int64()),
        "types": pa.array([0] * n + [int((sums > 0).sum())], pa.int64()),
        "words": pa.array([*words, b""], pa.binary()),
        "grams": pa.array([*grams, b""], pa.binary()),
    })


def _answered(table: pa.Table, column: str) -> np.ndarray:
    """A block's counts, put together in order of shards."""
    order = np.argsort(table["shard"].to_numpy(), kind="stable")
    values = table[column].to_pylist()
    return np.concatenate([np.zeros(0, np.int64), *(unpack(values[i]).astype(np.int64) for i in order)])


@dataclass(frozen=True)
class Automaton:
    """The part of the automaton that a block's texts can reach: training counts of its words (the last one is the end, whose
    state is the start), pairs and triples, and of all."""

    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    tokens: int
    types: int
    prior: float

    def root(self) -> np.ndarray:
        """Probability of every word at the root."""
        return (self.words + 1) / (self.tokens + self.types + 1)

    def walk(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Weights in log10 that each token adds at the root alone, and on its way through the states."""
        root = self.root()[block.tokens]
        # From the state of the word before: an arc, or a failure arc to the root; of an unknown word it weighs nothing.
        seen, left = self.pairs[block.pair_of], self.words[block.before]
        two = (seen + self.prior * root) / (left + self.prior)
        failure = np.log10(self.prior / (left + self.prior))
        weight = np.where(seen > 0, np.log10(two), failure + np.log10(root))
        # From the state of the pair before, if it is one: an arc, or a failure arc to the state of its last word.
        at, _, triple_of = block.triples(self.pairs)
        seen, left = self.triples[triple_of], self.pairs[block.pair_of[at - 1]]
        arc = np.log10((seen + self.prior * two[at]) / (left + self.prior))
        weight[at] = np.where(seen > 0, arc, np.log10(self.prior / (left + self.prior)) + weight[at])
        return np.log10(root), weight


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held, *, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``held`` is not true and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams alone) and score.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text")
    )
    folder, shards = scratch_path(spark, "blocks"), shuffle_partitions(spark)
    none = np.zeros(0, np.uint64)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(gather(batches, "text", BLOCK)):
            block = Block.of_texts(part)
            name = block.write(folder, (partition_index(), number))
            words, pairs = block.training_counts()
            yield _requests(name, shards, block.words, words, block.pairs, pairs)

    def ask_triples(key: tuple, answers: pa.Table) -> pa.Table:
        block = Block.read(folder, key[0].as_py())
        at, keys, triple_of = block.triples(_answered(answers, "grams"))
        counts = np.bincount(triple_of[block.trained[at]], minlength=len(keys))
        return pa.Table.from_batches([_requests(key[0].as_py(), shards, none, none, keys, counts)])

    # Answers are written down, so that the requests behind them can go.
    pairs = stage(rows.mapInArrow(ask_pairs, _REQUESTS).groupBy("shard").applyInArrow(_add_up, _ANSWERS), "pair-answers")
    total = pairs.where("block = -1").agg(F.sum("tokens"), F.sum("types")).first()
    pairs = pairs.where("block <> -1")
    asked = pairs.select("block", "shard", "grams").groupBy("block").applyInArrow(ask_triples, _REQUESTS)
    triples = stage(asked.groupBy("shard").applyInArrow(_add_up, _ANSWERS), "triple-answers").where("block <> -1")

    def score(key: tuple, answers: pa.Table) -> pa.Table:
        block = Block.read(folder, key[0].as_py())
        longer = answers["longer"].to_numpy(zero_copy_only=False)
        two, three = (answers.filter(pa.array(longer == x)) for x in (False, True))
        words = _answered(two, "words")
        model = Automaton(words, _answered(two, "grams"), _answered(three, "grams"), total[0], total[1], prior)
        base, weight = model.walk(block)
        return pa.table({
            "doc_id": block.ids,
            "held_out": pa.array(block.held),
            "n_tokens": pa.array(block.counts),
            "n_known": pa.array(np.add.reduceat((words > 0)[block.tokens].astype(np.int64), block.first)),
            "train_tokens": pa.array(np.full(len(block.counts), total[0])),
            "base_score": pa.array(np.add.reduceat(base, block.first)),
            "score": pa.array(np.add.reduceat(weight, block.first)),
        })

    columns = ["block", "shard", "words", "grams"]
    both = pairs.select(*columns, F.lit(False).alias("longer")).union(triples.select(*columns, F.lit(True).alias("longer")))
    return both.groupBy("block").applyInArrow(score, _RESULT)
