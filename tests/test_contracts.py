import json

import pytest
from pyspark.sql import functions as F

from wearstream.functions import calendar
from wearstream.models.training import frozen
from wearstream.sources import contracts as C
from wearstream.streaming import sinks

HEADER = "worker_id,timestamp,gas,noise,risk_level,extra\n"


def csv(tmp_path, name, lines, header=HEADER):
    path = tmp_path / name
    path.write_text(header + "".join(f"{x}\n" for x in lines))
    return str(path)


def test_training_table(spark, tmp_path):
    path = csv(tmp_path, "a.csv", ["W_1,7/21/2026 9:03,9.5,60,Safe,x", "W_1,12/1/2026 19:30,,61,Critical,y"])
    rows = C.training_table(spark, path, ["gas", "noise"]).orderBy("ts").collect()
    assert [(r.worker_id, str(r.ts), r.gas, r.noise, r.source_file) for r in rows] == [("W_1", "2026-07-21 09:03:00", 9.5, 60.0, "a.csv"), ("W_1", "2026-12-01 19:30:00", None, 61.0, "a.csv")]


@pytest.mark.parametrize("lines,header,message", [(["W_1,7/21/2026 9:03,9,60,UNCERTAIN,x"], HEADER, "UNCERTAIN"), (["W_1,7/21/2026 9:03,9,60,,x"], HEADER, "None"), (["W_1,Safe"], "worker_id,risk_level\n", "missing")])
def test_broken_tables_raise(spark, tmp_path, lines, header, message):
    with pytest.raises(C.ContractError, match=message):
        C.training_table(spark, csv(tmp_path, "b.csv", lines, header), ["gas", "noise"])


def test_held_out_workers_and_certificates(spark, tmp_path):
    a, b = csv(tmp_path, "a.csv", ["W_1,7/21/2026 9:03,9,60,Safe,x"]), csv(tmp_path, "b.csv", ["W_2,7/21/2026 9:03,9,60,Safe,x"])
    assert C.development_tables(spark, [a, a], ["gas"], "W_2").count() == 2
    with pytest.raises(C.ContractError):
        C.development_tables(spark, [a, b], ["gas"], "W_2")
    with pytest.raises(C.ContractError):
        C.training_table(spark, b, ["gas"], only_worker="W_1")
    with pytest.raises(C.ContractError):
        C.external_table(spark, b, ["gas"], {"model": "x"})
    assert C.external_table(spark, b, ["gas"], frozen({"model": "x"})).count() == 1


def test_features():
    C.check_features(["gas", "noise"], ["gas", "noise"])
    for bad in (["risk_level"], ["pressure"], ["baseline_hr"]):
        with pytest.raises(C.ContractError):
            C.check_features(bad, ["gas", "noise", "risk_level", "baseline_hr"])


def test_changed_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for n in "abc":
        (folder / n).write_text(n)
    before = spark.createDataFrame(C.file_hashes(spark, str(folder)).collect())
    (folder / "a").write_text("other")
    (folder / "b").unlink()
    (folder / "d").write_text("d")
    assert {(r.file, r.change) for r in C.changed_files(before, C.file_hashes(spark, str(folder))).collect()} == {("a", "changed"), ("b", "removed"), ("d", "added")}


def test_uploads(spark):
    sample = {"timestamp": "2026-10-09T03:30:00Z", "heartRate": 80, "bodyTemp": "36.7", "gas": -1, "uv": "high", "lat": 6.9, "lon": 79.8}
    packets = [{"helmetId": "H1", "samples": [sample, {**sample, "timestamp": None, "lat": 99}]}, {"helmetId": "H2", **sample}, {"helmetId": "H3", "samples": [sample] * 601}, {"helmetId": "H4", "samples": []}, {"samples": [sample]}, "{"]
    rows = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(packets)], "id long, value string")
    got = [(r.id, r.helmet, r.place, r.heart_rate, r.body_temperature, r.gas, r.uv_index, r.gps is not None, r.problem) for r in C.uploads(rows).orderBy("id", "place").collect()]
    values = (80.0, 36.7, None, None)
    assert got == [
        (0, "H1", 0, *values, True, None), (0, "H1", 1, *values, False, "NO_TIME"), (1, "H2", 0, *values, True, None), (2, "H3", None, None, None, None, None, False, "TOO_MANY_SAMPLES"),
        (3, "H4", None, None, None, None, None, False, "NO_SAMPLES"), (4, None, None, None, None, None, None, False, "NO_HELMET"), (5, None, None, None, None, None, None, False, "NO_HELMET"),
    ]


def test_sinks(spark, tmp_path):
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(1, 1, "late"), (3, 1, None)]):
        spark.createDataFrame(rows, "k long, n long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, n long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sinks.appended(stream, str(tmp_path / "rows"), str(tmp_path / "c1")).awaitTermination()
    sinks.appended(stream, str(tmp_path / "rows"), str(tmp_path / "c1")).awaitTermination()  # nothing new
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5
    assert sinks.current(spark, str(tmp_path / "state")) is None
    sinks.upserted(stream, "k", ["n"], str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination()
    assert {tuple(r) for r in sinks.current(spark, str(tmp_path / "state")).collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, None)}
    sinks.as_text(spark.createDataFrame([(1, None), (2, "x")], "a long, b string").orderBy("a"), str(tmp_path / "md"), "markdown")
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| a | b |", "|-|-|", "| 1 |  |", "| 2 | x |"]
    sinks.as_text(spark.range(3).select(F.col("id").alias("a")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        sinks.as_text(spark.range(3).toDF("a"), str(tmp_path / "no"), most=2)


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for folder, text in (("a", "1"), ("b", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(text)
    before = spark.createDataFrame(C.file_hashes(spark, str(tmp_path)).collect())
    assert sorted(r.file for r in before.collect()) == ["a/x.csv", "b/x.csv"] and C.changed_files(before, before).count() == 0
    (tmp_path / "b" / "x.csv").write_text("3")
    assert [(r.file, r.change) for r in C.changed_files(before, C.file_hashes(spark, str(tmp_path))).collect()] == [("b/x.csv", "changed")]


def test_features_may_not_tell_how_a_label_came_about():
    for name in ("hr_evidence", "rule_count", "artifact_share", "quality_score", "uncertain_minutes", "imputed_gas", "hot_flag"):
        with pytest.raises(C.ContractError):
            C.check_features([name], [name])


def test_times_do_not_depend_on_the_sessions_zone(spark):
    texts = ["2026-01-01T10:00:00Z", "2026-01-01T10:00:00+05:30", "2026-01-01T10:00:00", "2026-01-01 10:00", "2026-01-01T10:00:00.250-0330", "2026-01-01", "soon", "", None]
    df, zone, got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for z in ("UTC", "Asia/Colombo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got.append([r.p and (r.p.epoch, str(r.p.local_date), r.p.local_hour) for r in df.select("i", calendar.parsed_time(F.col("t")).alias("p")).orderBy("i").collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    noon = 1767261600.0
    assert got[0] == got[1] == got[2] == [(noon, "2026-01-01", 10), *[(noon - 19800, "2026-01-01", 10)] * 3, (noon + 12600.25, "2026-01-01", 10), None, None, None, None]
