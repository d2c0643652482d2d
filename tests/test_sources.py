import pytest
import numpy as np

from plethora.sources import files


def test_wfdb_annotations_and_signals(tmp_path, spark):
    raw = np.array([[100, -32768], [300, 5]], "<i2")
    (tmp_path / "s1_walk.dat").write_bytes(raw.tobytes())
    (tmp_path / "s1_walk.hea").write_text("s1_walk 2 500 2\ns1_walk.dat 16 200(0)/mV 16 0 0 0 0 ecg\ns1_walk.dat 16 2 16 0 1 0 0 pleth\n")
    words = [1 << 10 | 100, 1 << 10 | 200, 28 << 10 | 5, 0]
    (tmp_path / "s1_walk.atr").write_bytes(np.array(words, "<u2").tobytes())
    got = {(r.signal, r.i): r.value for r in files.wfdb(spark, str(tmp_path)).collect()}
    assert got == {("ecg", 0): 0.5, ("ecg", 1): 1.5, ("pleth", 0): None, ("pleth", 1): 2.5}
    assert [r.t for r in files.wfdb_beats(spark, str(tmp_path), 500.0).collect()] == [0.2, 0.6]
    assert files.wfdb_beats(spark, str(tmp_path), 500.0, codes=None).count() == 3


def test_npz_csv_json_manifest(tmp_path, spark):
    np.savez(tmp_path / "an0.npz", ir=np.array([1.0, np.nan, 3.0]))
    assert [r.value for r in files.npz(spark, str(tmp_path), "ir").orderBy("i").collect()] == [1.0, None, 3.0]
    df = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.csv(spark, str(tmp_path / "c"), "a int, b double").collect())) == [(1, 2.5), (2, None)]
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "RECORDS").write_text("s1_walk\ns2_sit\n")
    assert [r.name for r in files.manifest(spark, str(tmp_path / "RECORDS")).collect()] == ["s1_walk", "s2_sit"]
    assert files.metrics_table(df, ["a"]).count() == 2
    assert files.checksums(spark, str(tmp_path), "RECORDS").count() == 1


def test_assert_unique_fails_on_shared_keys(spark):
    import pytest

    from plethora.operators.cleaning import assert_unique

    d = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="rows share k"):
        assert_unique(d, "k").collect()


def _element(kind, body):
    import struct

    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _matrix(name, kind, shape, *parts):
    import struct

    head = _element(6, struct.pack("<II", kind, 0)) + _element(5, struct.pack("<ii", *shape)) + _element(1, name.encode())
    return _element(14, head + b"".join(parts))


def _numbers(name, values):
    return _matrix(name, 6, (1, len(values)), _element(9, np.array(values, "<f8").tobytes()))


def _struct(name, **fields):
    import struct

    names = b"".join(f.encode().ljust(8, b"\0") for f in fields)
    return _matrix(name, 2, (1, 1), struct.pack("<HHI", 5, 4, 8), _element(1, names), *fields.values())


def test_mat_files_with_nested_structs(tmp_path, spark):
    import zlib

    from plethora.sources import mat5

    ecg, ppg = (_struct("", v=_numbers("", v), fs=_numbers("", [128.0])) for v in ([1.0, 2.0, np.nan], [5.0, 6.0, 7.0]))
    inner = _struct("", ecg=ecg, ppg=ppg)
    top = _struct("data", sternum=inner, note=_matrix("", 4, (1, 2), _element(16, b"ok")), list=_matrix("", 1, (1, 2), _numbers("", [1]), _numbers("", [2, 3])))
    body = zlib.compress(top)
    import struct

    (tmp_path / "an0.mat").write_bytes(b" " * 124 + b"\x00\x01IM" + struct.pack("<II", 15, len(body)) + body)
    found = mat5.read((tmp_path / "an0.mat").read_bytes())["data"]
    assert found["note"] == "ok" and [x.ravel().tolist() for x in found["list"]] == [[1], [2, 3]]
    fields = {"ecg": ["data", "sternum", "ecg", "v"], "ppg": ["data", "sternum", "ppg", "v"]}
    rows = mat5.channels(spark, str(tmp_path), fields, ["fs"]).orderBy("channel", "i").collect()
    assert [(r.record, r.fs, r.channel, r.value) for r in rows] == [("an0", 128.0, "ecg", v) for v in (1.0, 2.0, None)] + [("an0", 128.0, "ppg", v) for v in (5.0, 6.0, 7.0)]
    mat5.extract(spark, str(tmp_path), str(tmp_path / "out"), fields, ["fs"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_display_protocol():
    from plethora.operators.gates import frozen_protocol

    assert frozen_protocol(0.6, 0.62, 0.3)["passed"] and not frozen_protocol(0.5, 0.62, 0.3)["passed"] and not frozen_protocol(0.6, 0.6, 0.2)["passed"]


def test_wfdb_source_and_sink(spark):
    """Records of several spans, gaps, one channel of two, and rows that are not in order."""
    from plethora.sources import recordings
    from plethora.sources.files import wfdb
    from plethora.sources.shared import fresh_path

    recordings.register(spark)
    rows = [(f"r{k}", i, None if i % 7 == 0 else i * 0.25 + k, float(-i)) for k in range(5) for i in range(30 * k + 1)]
    path = fresh_path(spark, "wfdb")
    df = spark.createDataFrame(rows, "record string, i long, light double, motion double").repartition(3, "record").sortWithinPartitions("record", "i")
    df.write.format("wfdb").mode("append").options(fs="64", gain="200").save(path)
    read = spark.read.format("wfdb").option("span", "40").load(path)
    assert read.rdd.getNumPartitions() > 20
    got = sorted((r["record"], r["i"], r["signal"], r["value"], r["fs"]) for r in read.collect())
    assert got == sorted([(a, i, "light", x, 64.0) for a, i, x, _ in rows] + [(a, i, "motion", y, 64.0) for a, i, _, y in rows])
    plain = sorted((r["record"], r["i"], r["signal"], r["value"], r["fs"]) for r in wfdb(spark, path).collect())
    assert plain == got
    one = spark.read.format("wfdb").option("signals", "motion").load(path)
    assert {r["signal"] for r in one.collect()} == {"motion"} and one.count() == len(rows)
    for bad, said in (([("x", 1, 0.0, 0.0)], "no sample 0"), ([("x", 0, 1e6, 0.0)], "beyond 16 bits")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame(bad, df.schema).write.format("wfdb").mode("append").save(fresh_path(spark, "wfdb"))
    spark.createDataFrame([], df.schema).write.format("wfdb").mode("append").save(empty := fresh_path(spark, "wfdb"))
    assert spark.read.format("wfdb").load(empty).count() == 0
