"""Text formats, tolerant parsing, the model store and the three jobs."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cellpath.operators.sampling import sample_sequences
from cellpath.plans import jobs
from cellpath.schema import USER_DAY
from cellpath.session import scratch_path, shared_dir
from cellpath.sources import pings as P
from cellpath.sources import model_store, text
from cellpath.sources.model_store import publish_model, read_model, versions, write_model
from helpers import MODEL, vectors

HEADER = "UserID,Year,Month,DayOfMonth,DayOfWeek,Hour,Minute,Area,AreaIndex"


def _lines(spark, lines):
    return spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, ord long")


def test_tolerant_parse(spark):
    good = ["21,2012,5,3,Thu,8,33,x,548", "a b,2012,+5,03,,0,0,,-1,more,fields"]
    bad = [
        HEADER, "21,2012,5,3,Thu,8,33,x", "21,2012, 5 ,3,Thu,8,33,x,548", "21,2012,5.7,3,Thu,8,33,x,548",
        "21,2012,5,3,Thu,8,33,x,99999999999", "", "21,2012,5,3,Thu,8,33,x,", ",,,,,,,,",
    ]
    late = ["21,2012,5,3,Thu,24,0,x,5", "21,2012,5,3,Thu,-1,0,x,5", "21,2012,5,3,Thu,2000000000,0,x,5"]
    lines = _lines(spark, good + bad + late)
    parsed = [tuple(r) for r in P.parse_pings(lines).collect()]
    assert parsed == [("21", 2012, 5, 3, 513, 548, 0), ("a b", 2012, 5, 3, 0, -1, 1)]
    rejected = {r.value: r.reason for r in P.rejected_lines(lines).collect()}
    assert rejected == {**dict.fromkeys(bad, "malformed"), **dict.fromkeys(late, "minute out of range")}


def test_ping_order_follows_the_file(spark, tmp_path):
    path = tmp_path / "pings.txt"
    path.write_text("".join(f"21,2012,5,3,Thu,8,33,x,{c}\n" for c in range(5000)))
    pings = P.parse_pings(P.read_ping_lines(spark, str(path)))
    assert [r.cell_id for r in pings.orderBy("ord").collect()] == list(range(5000))


def test_ping_order_is_the_same_however_files_are_cut(spark, tmp_path):
    """Pings of one minute over files of unequal size, cut small and packed in two ways."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    sizes = {"b": 900, "a": 40, "c d": 2500}
    for name, n in sizes.items():
        (folder / f"{name}.txt").write_text("".join(f"{name},2012,5,3,Thu,8,33,x,{c}\n" for c in range(n)))
    wanted = [(name, c) for name in sorted(sizes) for c in range(sizes[name])]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("700b", "9000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            pings = P.parse_pings(P.read_ping_lines(spark, str(folder)))
            assert [(r.user_id, r.cell_id) for r in pings.orderBy("ord").collect()] == wanted
            assert pings.select("ord").distinct().count() == len(wanted)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_scan_of_ping_text(spark, tmp_path):
    lines = _lines(spark, ["21,2012,5,3,Thu,8,33,x,548", "bad", "21,2012,5,3,Thu,24,0,x,5"])
    pings, rejects = P.sort_out(lines, str(tmp_path / "parsed"))
    assert sorted(pings.collect()) == sorted(P.parse_pings(lines).collect())
    assert sorted(rejects.collect()) == sorted(P.rejected_lines(lines).collect())
    for df in (pings, rejects):  # what follows reads the stored kinds
        assert "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()
    nothing = P.sort_out(lines.limit(0), str(tmp_path / "none"))
    assert [df.count() for df in nothing] == [0, 0]


def test_rejects_of_vectors_and_sequences(spark):
    bad = ["", "21|2012|5|3", "|2012|5|3|1,2", "21|2012|x|3|1,2", "21|2012|5|3|1,2|", "21|99999999999|5|3|1,2", "21| 2012|5|3|1,2"]
    cells = ["21|2012|5|3|1,,2", "21|2012|5|3|1,2.0", "21|2012|5|3|", "21|2012|5|3|1,99999999999"]
    lines = _lines(spark, [*bad, *cells, "21|2012|5|3|1,2", "21|2012|5|4|-1,+2,3"])
    assert [(r.user_id, r.day, r.cells) for r in text.parse_vectors(lines).collect()] == [("21", 3, [1, 2]), ("21", 4, [-1, 2, 3])]
    assert [r.day for r in text.parse_vectors(lines, 2).collect()] == [3]
    reasons = {**dict.fromkeys(bad, "malformed"), **dict.fromkeys(cells, "malformed cell")}
    assert {r.value: r.reason for r in text.rejected_vectors(lines).collect()} == reasons
    assert {r.reason for r in text.rejected_vectors(lines, 2).collect()} == {"malformed", "malformed cell", "wrong number of slots"}

    points = ["21|2012|5|3|", "21|2012|5|3|1,2!", "21|2012|5|3|1", "21|2012|5|3|1,2,3", "21|2012|5|3|x,2"]
    late = ["21|2012|5|3|1440,2", "21|2012|5|3|5,1!-1,2"]
    lines = _lines(spark, [*bad, *points, *late, "21|2012|5|3|0,2!1439,-1"])
    assert [[tuple(p) for p in r.points] for r in text.parse_sequences(lines).collect()] == [[(0, 2), (1439, -1)]]
    reasons = {**dict.fromkeys(bad, "malformed"), **dict.fromkeys(points, "malformed point"), **dict.fromkeys(late, "minute out of range")}
    assert {r.value: r.reason for r in text.rejected_sequences(lines).collect()} == reasons


def test_jobs_write_rejects(spark, tmp_path):
    days, sequences, model = (tmp_path / n for n in ("days", "sequences", "model"))
    days.mkdir()
    (days / "part-0").write_text("".join(f"21|2012|5|{d}|{','.join(['7'] * 24)}\n" for d in range(1, 9)) + "oops\n21|2012|5|9|7\n")
    jobs.train(spark, str(days), str(model), rejects_path=str(tmp_path / "bad-days"), iterations=2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "bad-days")).collect()) == ["21|2012|5|9|7", "oops"]
    sequences.mkdir()
    (sequences / "part-0").write_text("21|2012|5|3|5,7!100,7\n21|2012|5|3|5\n")
    hits = jobs.evaluate(spark, str(sequences), str(model), rejects_path=str(tmp_path / "bad-sequences"))
    assert hits.first().n_predictions == 1
    assert [r.value for r in spark.read.text(str(tmp_path / "bad-sequences")).collect()] == ["21|2012|5|3|5"]


def test_user_filter_reaches_the_scan(spark, sf_dir):
    plan = P.for_user(P.read_event_pings(spark, sf_dir), 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan
    assert "event_type" not in plan


def test_round_trips(spark):
    days = vectors(spark, [("21", 3, [548, -1, 1]), ("x", 31, [7, 7, 7])])
    assert {r.value for r in text.vector_lines(days).collect()} == {"21|2024|1|3|548,-1,1", "x|2024|1|31|7,7,7"}
    path = scratch_path(spark, "vectors")
    text.write_lines(text.vector_lines(days), path)
    assert sorted(text.read_vectors(spark, path).collect()) == sorted(days.collect())

    sequences = sample_sequences(days, previous_points=1, interval=480)
    path = scratch_path(spark, "sequences")
    text.write_lines(text.sequence_lines(sequences), path)
    back = text.read_sequences(spark, path)
    assert sorted(back.select(*USER_DAY, "points").collect()) == sorted(sequences.collect())
    assert back.select("sequence_id").distinct().count() == 2


def test_sequence_line_format(spark):
    line = "21|2012|5|3|513,548!626,548!769,587"
    df = text.parse_sequences(_lines(spark, [line]))
    assert [tuple(p) for p in df.first().points] == [(513, 548), (626, 548), (769, 587)]
    assert text.sequence_lines(df).first().value == line


def test_model_store(spark):
    rows = [(f"u{u}", c, s, 1, 7, 3, 1.0, 60) for u in range(30) for c in range(2) for s in range(3)]
    model = spark.createDataFrame(rows, MODEL)
    stored, published = scratch_path(spark, "model"), scratch_path(spark, "published")
    write_model(model, stored, buckets=8)
    publish_model(spark, stored, published)
    publish_model(spark, stored, published)
    assert sorted(read_model(spark, published).collect()) == sorted(model.collect())
    one = read_model(spark, published, "u7")
    assert one.count() == 6
    assert len({os.path.dirname(f) for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1


def test_readers_always_find_a_whole_model(spark, monkeypatch):
    """While a model is published, after that failed, and when a reader began before."""
    model = spark.createDataFrame([("u", 0, s, 1, 7, 3, 1.0, 60) for s in range(24)], MODEL)
    newer = model.withColumn("cell_id", F.lit(8))
    first, second, target = (scratch_path(spark, n) for n in ("first", "second", "target"))
    write_model(model, first, buckets=4)
    write_model(newer, second, buckets=2)
    with pytest.raises(FileNotFoundError):
        read_model(spark, target)
    publish_model(spark, first, target)
    early = read_model(spark, target)

    class Broken(Exception):
        pass

    def fail(*_):
        # The new version is written, its line in the log is not: what a reader sees in between.
        assert sorted(read_model(spark, target).collect()) == sorted(model.collect())
        raise Broken

    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None, *a, **k: fail() if schema == model_store._LOG else real(rows, schema, *a, **k))
    with pytest.raises(Broken):
        publish_model(spark, second, target)
    monkeypatch.undo()
    assert sorted(read_model(spark, target).collect()) == sorted(model.collect())
    publish_model(spark, second, target)
    assert {r.cell_id for r in read_model(spark, target, "u").collect()} == {8}
    assert sorted(early.collect()) == sorted(model.collect())
    assert len(versions(spark, target)) == 2


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_three_jobs_end_to_end(spark, tmp_path):
    """A commuter: nights in 10, days in 20, one lost-signal ping, every day the same."""
    lines = [HEADER]
    for day in range(1, 21):
        for hour, cell in ((0, 10), (8, 20), (12, 1), (13, 20), (18, 10)):
            lines.append(f"21,2012,5,{day},x,{hour},0,area,{cell}")
        lines.append(f"22,2012,5,{day},x,9,30,area,30")
    raw = tmp_path / "pings"
    raw.mkdir()
    (raw / "a.txt").write_text("\n".join(lines) + "\n")
    days, sequences, model = (str(tmp_path / n) for n in ("days", "sequences", "model"))

    jobs.prepare(spark, str(raw), days, sequences)
    vector = {(r.user_id, r.day): r.cells for r in text.read_vectors(spark, days).collect()}
    # The carried cell wins the hour of lost signal without a minute of its own.
    assert vector[("21", 5)] == [10] * 8 + [20] * 10 + [10] * 6
    assert vector[("22", 1)] == [-1] * 9 + [30] * 15 and vector[("22", 3)] == [30] * 24

    jobs.train(spark, days, model, user_id="21", iterations=3)
    hits = jobs.evaluate(spark, sequences, model, user_id="21").collect()
    assert [(r["rank"], r.hits, r.n_predictions) for r in hits] == [(1, 20, 20)]

    everyone = {r["rank"]: r for r in jobs.evaluate(spark, sequences, model).collect()}
    assert everyone[1].hits == 20 and everyone[1].n_predictions == 40


def test_repeated_sequences_are_counted(spark, tmp_path):
    rows = [("21", 0, s, 1, 7, 3, 1.0, 60) for s in range(24)]
    model = str(tmp_path / "model")
    write_model(spark.createDataFrame(rows, MODEL), model)
    path = tmp_path / "sequences"
    path.mkdir()
    (path / "part-0").write_text("21|2012|5|3|5,7!100,7\n" * 3)
    hits = jobs.evaluate(spark, str(path), model).first()
    assert (hits.hits, hits.n_predictions) == (3, 3)
