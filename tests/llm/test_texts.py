"""Operators on documents against brute force: the given documents, and rows that are null, empty, long, repeated or tied."""

from __future__ import annotations

import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpath.llm import backoff, decontaminate, exchange, packing, pii, queries, setsketch, token_store
from cellpath.session import scratch_path

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a b"),
    (5, "A b"),
    (6, "a b c d e f g h"),
    (6, "a b c d e f g h"),
    (7, "a b c d e f g h i"),
    (8, "é x  y  　z <|endoftext|> don't 12345 'S"),
    (9, "word " * 30_000),
    (10, "x" * 200_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("node", "row", "spans", "n", "block", "length", "h")})


def test_near_duplicates(spark, sf_dir, documents, rows, odd):
    assert rows(queries.op7_setsketch(spark, sf_dir)) == brute.near_duplicates(documents)
    assert rows(setsketch.near_duplicates(odd)) == brute.near_duplicates(ODD)
    assert rows(setsketch.near_duplicates(odd.limit(0))) == []


def test_copies_of_copies(spark, rows):
    """A chain of edits and a family around one text: links beside those to the bucket's lead count."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"e{rng.random()}"
        docs.append((i, " ".join(text)))
    text = [f"c{i}" for i in range(120)]
    for i in range(100, 120):
        text[rng.randrange(len(text))] = f"e{rng.random()}"
        docs.append((i, " ".join(text)))
    assert rows(setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute.near_duplicates(docs)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 2**63, 900, np.uint64), rng.integers(1, 2**63, 300, np.uint64)
    both = np.concatenate([a, b])
    parts = setsketch.registers(np.concatenate([a, b, both]), np.array([0, 900, 1200, 2400]))
    assert (setsketch.merge(parts[0], parts[1]) == parts[2]).all()
    found, _ = setsketch.estimate(parts[:1], parts[2:], np.array([900.0]), np.array([1200.0]))
    assert abs(found[0] - 0.75) < 0.12


def test_contamination(spark, sf_dir, documents, rows, odd):
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    assert rows(queries.op3_decontamination(spark, sf_dir)) == brute.contamination(documents, items)
    items = [("1", "a b c d e f g h i"), ("2", None), ("3", "É X"), ("4", "word"), ("5", "A-b c d e f g h"), ("6", " ".join(["word"] * 12)), ("7", "")]
    table = spark.createDataFrame(items, "item_id string, text string")
    assert rows(decontaminate.digest(decontaminate.find_contamination(odd, table))) == brute.contamination(ODD, items)
    none = decontaminate.digest(decontaminate.find_contamination(odd, table.limit(0)))
    assert [r.contaminated for r in none.collect()] == [False] * len(ODD)
    assert rows(decontaminate.digest(decontaminate.find_contamination(odd.limit(0), table))) == []


def test_personal_data(spark, sf_dir, documents, rows):
    assert [r[:6] for r in rows(queries.op2_pii(spark, sf_dir))] == brute.personal_data(documents)
    rng = random.Random(5)
    parts = [
        "a@b.c_d@e.f", "x@y", "a.b@c-d.e.f.", " ", "1.2.3.4.5.6.7.8", "00255.1.1.1", "256.1.1.1", "4467-9202 1276 5298", "4467920212765298", "1 2 3",
        "+1 (663) 555-6869", "+1+234567890", "é", "😀", "DE89 3704 0044 0532 0130 00", "\n", "@@a@b.c", "1" * 40, "--", "a@b..c", "9",
    ]
    docs = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "a" * 50_000), (303, "1 " * 5_000), (304, "1.2.3.4 " * 700), (305, "a@" * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    assert [r[:6] for r in rows(pii.digest(pii.with_spans(df)))] == brute.personal_data(docs)
    assert rows(pii.digest(pii.with_spans(df.limit(0)))) == []


def test_checks_and_context_decide_on_further_kinds(spark):
    texts = {
        "iban GB82 WEST 1234 5698 7654 32": "iban:5:32",
        "iban GB82 WEST 1234 5698 7654 33": "",
        "order GB82WEST12345698765432": "",
        "amex card 378282246310005": "card15:10:25",
        "378282246310005": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.digest(pii.with_spans(df)).orderBy("doc_id").collect()] == list(texts.values())


def test_iban_ends_where_its_country_says(spark):
    iban, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = {
        f"IBAN {iban} BIC COBADEFFXXX": "iban:5:27",
        f"IBAN {spaced} BIC: X": "iban:5:32",
        f"{iban} 2024-01-01": "iban:0:22",
        f"{iban} I agree": "iban:0:22",
        f"{spaced} {iban} GB82WEST12345698765432 OK": "iban:0:27,iban:28:50,iban:51:73",
        f"REF AT61 1904 {spaced} EUR 100": "iban:14:41",
        f"{iban}BIC": "",
        "DE89370400440532013001 BIC": "",
        "NO93 8601 1117 947 KR 5": "iban:0:18",
        "MT84MALT011000012345MTLCAST001S 5": "iban:0:31",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.digest(pii.with_spans(df)).orderBy("doc_id").collect()] == list(texts.values())
    masked = pii.masked(df.where("doc_id in (0, 4)")).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["IBAN <IBAN> BIC COBADEFFXXX", "<IBAN> <IBAN> <IBAN> OK"]


def test_masking(spark):
    rows = [(1, "to a@b.c, 1.2.3.4.", 18), (2, None, None), (3, "nothing", 7), (4, "+1 234 567 8901", 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.masked(df).orderBy("doc_id").collect()] == [
        (1, "to <EMAIL>, <IP>.", 17),
        (2, None, None),
        (3, "nothing", 7),
        (4, "<PHONE>", 7),
    ]


def test_secrets_need_context_or_a_known_beginning(spark):
    key = "24be8f1d9c3a7705e6b2"
    texts = {
        f'token = "{key}" x': "secret:9:29",
        f"API_KEY={key}==": "secret:8:30",
        f"commit {key}": "",
        "password aaaaaaaaaaaaaaaaaaaaaaaa1": "",
        "token thisisonlyalongwordwithoutanydigit": "",
        "bearer ghp_16C7e42F292c6912E7710c838347Ae178B4a.": "secret:7:47",
        "x ghp_16C7e42F292c6912E7710c838347Ae178B4a.": "secret:2:42",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.spans for r in pii.digest(pii.with_spans(df)).orderBy("doc_id").collect()]
    assert found == list(texts.values())
    assert [r.text for r in pii.masked(df.where("doc_id = 1")).collect()] == ["API_KEY=<SECRET>"]


def test_masked_texts_are_those_of_their_spans(spark):
    """Against joining spans one by one; with blocks of text on both sides of spans, and spans that overlap."""
    rng = random.Random(9)
    parts = ["a@b.cd ", "1.2.3.4 ", "+1 663 555 6869 4467920212765298 ", "é" * 300, "😀x ", " ", "4467920212765298", "y" * 511, "+12345678 ", "DE89370400440532013000 "]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 700])))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans) for r in pii.with_spans(df).collect()}
    overlapped = 0
    for r in pii.masked(df).collect():
        text, joined = docs[r.doc_id][1], []
        for start, end, kind in spans[r.doc_id]:
            if joined and start < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
                overlapped += 1
            else:
                joined.append([start, end, kind])
        wanted, at = "", 0
        for start, end, kind in joined:
            wanted, at = wanted + text[at:start] + f"<{kind.upper()}>", end
        assert r.text == wanted + text[at:]
    assert overlapped > 20


def test_time_grows_with_the_matches(spark):
    """50,000 matches in one row."""
    text = "1.2.3.4 " * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for work in (lambda: pii.digest(pii.with_spans(df)).first().n_ip, lambda: pii.masked(df).first().text.count("<IP>")):
        work()
        start = time.perf_counter()
        assert work() == 50_000
        assert time.perf_counter() - start < 20


def test_no_python_on_the_path_to_spans(spark, sf_dir):
    plan = queries.op2_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer_file(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k")}


def test_token_store(spark, sf_dir, documents, rows, odd, tokenizers):
    for docs, df in ((documents, queries.table(spark, sf_dir, "documents")), (ODD, odd), ([], odd.limit(0))):
        folder = scratch_path(spark, "store")
        files = token_store.write_store(df, folder, queries.tokenizer_file("byte_bpe_50k.json"), 2)
        expected, start = [], 0
        for doc, ids in brute.token_rows(docs, tokenizers["byte_bpe_50k"], 2):
            expected.append((doc, start, len(ids), brute.crc(ids)))
            start += len(ids)
        assert rows(token_store.read_digests(files)) == sorted(expected)
    folder = scratch_path(spark, "store")
    token_store.write_store(odd, folder, queries.tokenizer_file("byte_bpe_50k.json"), 2)
    back = token_store.read_ids(spark, folder)
    assert back.where("doc_id = 4").first().ids == [*tokenizers["byte_bpe_50k"].encode("a b").ids, 2]
    assert "ids" not in back.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_packing(spark, sf_dir, documents, odd, tokenizers):
    path = queries.tokenizer_file("word_bpe_49k.json")
    for docs, df in ((documents, queries.table(spark, sf_dir, "documents")), (ODD, odd), ([], odd.limit(0))):
        found = packing.pack_documents(df, path).collect()
        expected = []
        for doc, ids in brute.token_rows(docs, tokenizers["word_bpe_49k"], 1):
            cuts = range(0, len(ids), 4096)
            expected += [(doc, k // 4096, k, len(ids[k : k + 4096]), brute.crc(ids[k : k + 4096])) for k in cuts]
        assert sorted(tuple(r)[:5] for r in found) == sorted(expected)
        bins = {}
        for r in found:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in bins.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 4096
        assert len(bins) <= 1 + 1.02 * sum(r.length for r in found) / 4096


def test_plan_holds_every_piece_once():
    rng = random.Random(2)
    for n in (0, 1, 7, 2000):
        counts = {}
        for _ in range(n):
            size = min(4096, int(rng.lognormvariate(6.5, 1)) + 1)
            counts[size] = counts.get(size, 0) + 1
        used = {}
        for combination, times in packing.plan(counts):
            assert sum(k * c for k, c in combination) <= 4096
            for k, c in combination:
                used[k] = used.get(k, 0) + c * times
        assert used == counts
    assert packing.fullest([3000, 2000, 1096, 1095], {3000: 1, 2000: 2, 1096: 1, 1095: 9}, 4096) == [(3000, 1), (1096, 1)]


def test_scores(spark, sf_dir, documents, rows, odd):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    for docs, df in ((documents, queries.table(spark, sf_dir, "documents")), (ODD, odd), ([], odd.limit(0))):
        found, expected = rows(backoff.score_texts(df, held)), brute.scores(docs, backoff.PRIOR)
        assert [r[:5] for r in found] == [r[:5] for r in expected]
        assert np.allclose([r[5:] for r in found], [r[5:] for r in expected])
    with_few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = rows(backoff.score_texts(odd, held))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_few)
    assert np.allclose([r[5:] for r in found], [r[5:] for r in brute.scores(ODD, backoff.PRIOR)])
    unseen = [r for r in brute.scores(documents, backoff.PRIOR) if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**32, 2**63, 2**64 - 1], np.uint64)
    assert exchange.unpack(exchange.pack(values)).tolist() == values.tolist()
    assert exchange.unpack_keys(exchange.pack_keys(values)).tolist() == values.tolist()
    assert exchange.pack(values[:0]) == b"" and len(exchange.unpack(b"")) == 0
