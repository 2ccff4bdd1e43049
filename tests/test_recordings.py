"""Recordings as data sources: files written here, read in several tasks; pieces written by Spark, read again."""

import pickle
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.sources import edf, files, matfile, recordings


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)


def matrix(value, name=""):
    """A level-5 array: numbers (doubles), text, a dict or a list of dicts, a list as cells."""
    array = lambda what, dims, *parts: element(14, element(6, struct.pack("<II", what, 0)) + element(5, struct.pack(f"<{len(dims)}i", *dims)) + element(1, name.encode()) + b"".join(parts))
    if isinstance(value, str):
        return array(4, (1, len(value)), element(4, value.encode("utf-16-le")))
    if isinstance(value, dict) or (isinstance(value, list) and value and isinstance(value[0], dict)):
        rows = [value] if isinstance(value, dict) else value
        fields = list(rows[0])
        return array(2, (1, len(rows)), struct.pack("<HHI", 5, 4, 32), element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields)), *(matrix(r[f]) for r in rows for f in fields))
    if isinstance(value, list):
        return array(1, (1, len(value)), *(matrix(x) for x in value))
    x = np.atleast_1d(np.asarray(value, float))
    return array(6, (1, len(x)), element(9, x.astype("<f8").tobytes()))


def mat(variables, packed=False):
    parts = [matrix(v, k) for k, v in variables.items()]
    if packed:
        parts = [struct.pack("<II", 15, len(z := zlib.compress(p))) + z for p in parts]
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts)


@pytest.mark.parametrize("packed", [False, True])
def test_matrix_files(packed):
    raw = mat({"a": np.array([1.5, 2.0]), "s": {"t": "text ü", "n": 3, "rows": [{"x": "p", "y": 1}, {"x": "longer text", "y": np.array([1, 2])}], "c": ["u", "vw"], "none": np.zeros(0)}}, packed)
    got = matfile.read(raw)
    assert got["a"].tolist() == [1.5, 2.0]
    s = got["s"]
    assert s["t"] == "text ü" and s["n"].tolist() == [3] and s["c"] == ["u", "vw"] and len(s["none"]) == 0
    assert [(r["x"], r["y"].tolist()) for r in s["rows"]] == [("p", [1]), ("longer text", [1, 2])]


def write_set(folder, n=1000, packed=False, **more):
    x = np.random.default_rng(1).normal(size=(n, 3)).astype("<f4")
    (folder / "rec.fdt").write_bytes(x.tobytes())
    eeg = {"trials": 1, "nbchan": 3, "pnts": n, "srate": 250, "data": "rec.fdt", "chanlocs": [{"labels": c} for c in ("C3", "Cz", "C4")], "event": [{"type": "S  1", "latency": 1}, {"type": "S  2", "latency": n}]} | more
    (folder / "rec.set").write_bytes(mat({"EEG": eeg}, packed))
    return x


@pytest.mark.parametrize("packed", [False, True])
def test_set(spark, tmp_path, packed):
    x = write_set(tmp_path, packed=packed)
    samples, markers = recordings.read(spark, str(tmp_path), 12 * 128)
    assert samples.rdd.getNumPartitions() == 8  # of one recording
    got = {(r.t, r.channel): r.value for r in samples.collect()}
    assert len(got) == 3000 and all(got[t, c] == x[t, k] for t in range(1000) for k, c in enumerate(("C3", "Cz", "C4")))
    assert sorted((r.t, r.seconds, r.marker) for r in markers.collect()) == [(0, 0.0, "S  1"), (999, 999 / 250, "S  2")]
    assert {r.stream for r in samples.select("stream").distinct().collect()} == {f"{tmp_path}/rec.set"}
    assert recordings.read(spark, f"file://{tmp_path}/rec.set")[0].count() == 3000


def test_set_that_is_not_a_stream(spark, tmp_path):
    write_set(tmp_path, trials=3)
    with pytest.raises(Exception, match="trials"):
        recordings.read(spark, str(tmp_path))[0].count()
    write_set(tmp_path, data=[1.0, 2.0])
    with pytest.raises(Exception, match="data file"):
        recordings.read(spark, str(tmp_path))[0].count()


def test_filters_are_taken_over(spark, tmp_path):
    x = write_set(tmp_path)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    try:
        for on in ("true", "false"):
            spark.conf.set(name, on)
            samples, _ = recordings.read(spark, str(tmp_path), 12 * 300)
            one = samples.filter("channel = 'Cz' AND t > 990")
            assert sorted(r.value for r in one.collect()) == sorted(map(float, x[991:, 1]))
            assert samples.filter(F.col("channel").isin("C3", "C4", "no")).count() == 2000 and samples.filter("stream = 'other'").count() == 0
            assert samples.filter("channel = 'C3' AND channel = 'C4'").count() == 0
    finally:
        spark.conf.set(name, before)
    reader = recordings.PushedSampleReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([recordings.EqualTo(("channel",), "Cz"), recordings.EqualTo(("t",), 3)]))
    assert [f.attribute for f in left] == [("t",)]
    parts = reader.partitions()
    assert {c for b in reader.read(parts[0]) for c in b.column("channel").to_pylist()} == {"Cz"}


def test_edf_in_ranges(spark, tmp_path):
    """Fifty records in several tasks, channels of two rates and annotations."""

    def field(x, width):
        return str(x).ljust(width).encode()

    rng, n = np.random.default_rng(2), 50
    size, names = [4, 2, 16], ["C3", "C4", edf.ANNOTATIONS]
    a, b = rng.integers(-1000, 1000, (n, 4)), rng.integers(0, 1000, (n, 2))
    values = {"label": names, "transducer": [""] * 3, "dimension": ["uV", "uV", ""], "physical_min": [-100, 0, -1], "physical_max": [100, 50, 1], "digital_min": [-1000, 0, -32768], "digital_max": [1000, 1000, 32767], "prefilter": [""] * 3, "samples": size, "reserved": [""] * 3}
    for records in (n, -1):  # -1: not known when the header was written
        head = field(0, 8) + field("", 80) + field("", 80) + field("01.01.20", 8) + field("00.00.00", 8) + field(256 * 4, 8) + field("EDF+C", 44) + field(records, 8) + field(1, 8) + field(3, 4) + b"".join(field(x, width) for name, width in edf.FIELDS for x in values[name])
        notes = [f"+{k}\x14\x14\x00" + (f"+{k}.25\x14S {k}\x14\x00" if k % 7 == 0 else "") for k in range(n)]
        (tmp_path / "r.edf").write_bytes(head + b"".join(a[k].astype("<i2").tobytes() + b[k].astype("<i2").tobytes() + notes[k].encode().ljust(32, b"\0") for k in range(n)))
        samples, markers = recordings.read(spark, str(tmp_path), 44 * 9)
        assert samples.rdd.getNumPartitions() == 6
        got = {(r.channel, r.t): r.value for r in samples.collect()}
        assert len(got) == 400 and [got["C3", t] for t in range(200)] == pytest.approx((a / 10).ravel()) and [got["C4", t] for t in range(200)] == pytest.approx(np.repeat(b.ravel() / 20, 2))
        assert sorted((r.t, r.seconds, r.marker) for r in markers.collect()) == [(4 * k + 1, k + 0.25, f"S {k}") for k in range(0, n, 7)]


def test_pieces_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    times = [*range(100), *range(105, 200), *range(50_000, 50_300)]  # a short gap, and one that begins a new piece
    rows = [(t, f"S {t}" if t % 10 == 0 else "R 1,2" if t == 7 else None, round(float(v), 1), round(float(w), 1)) for t, (v, w) in zip(times, rng.normal(size=(len(times), 2)) * 50)]
    df = spark.createDataFrame([*rows, (7, None, 999.0, 999.0)], "t long, marker string, `C 3` double, C4 double").repartition(5)
    path = f"{tmp_path}/out"
    recordings.write(df, path, 500.0, pieces=3)
    samples, markers = recordings.read(spark, path)
    assert samples.select("stream").distinct().count() >= 3
    got = {(r.t, r.channel): round(r.value, 6) for r in samples.collect()}
    want = {(t, c): x for t, _, *v in rows for c, x in zip(("C 3", "C4"), v)} | {(t, c): 0.0 for t in range(100, 105) for c in ("C 3", "C4")}
    assert got.keys() <= want.keys() and {k for k in want if k not in got} <= {(t, c) for t in range(100, 105) for c in ("C 3", "C4")}
    assert all(got[k] == want[k] for k in got)
    assert sorted((r.t, round(r.seconds, 6), r.marker) for r in markers.collect()) == sorted((t, round(t / 500, 6), m) for t, m, *_ in rows if m)
    one = sorted((tmp_path / "out").glob("*.vhdr"))[0]
    s, m, rate = files.brain_products(spark, str(one))  # the plain reader agrees
    assert rate == 500 and s.count() > 0 and s.select("channel").distinct().count() == 2
    recordings.write(df.filter("t < 0"), f"{tmp_path}/none", 500.0)
    assert recordings.read(spark, f"{tmp_path}/none")[0].count() == 0


def write_vhdr(folder, marks, samples=3000, more="", end="\n"):
    """A recording of two channels with a text of markers, in whose sections other keys stand as well."""
    (folder / "r.eeg").write_bytes(np.zeros((samples, 2), "<i2").tobytes())
    text = ["Brain Vision Data Exchange Marker File, Version 1.0", "; a comment", "[Common Infos]", "DataFile=r.eeg", "[Marker Infos]", "; Mk0=Stimulus,no,1,1,0", "Mk1=New Segment,,1,1,0,20200101", *(f"Mk{k + 2}=Stimulus,{m},{t + 1},1,0" for k, (t, m) in enumerate(marks)), more]
    (folder / "r.vmrk").write_bytes(end.join([*text, ""]).encode())
    (folder / "r.vhdr").write_text("Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=r.eeg\nMarkerFile=r.vmrk\nSamplingInterval=2000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=C3,,0.1,uV\nCh2=C4,,0.1,uV\n")


def test_tasks_get_no_markers(tmp_path):
    """What planning makes is as large as headers and tasks ask for, however many markers there are."""
    sizes = {}
    for count in (10, 20_000):
        own = tmp_path / str(count)
        own.mkdir()
        write_vhdr(own, [(k % 3000, f"S {k}") for k in range(count)])
        for reader in (recordings.SampleReader, recordings.MarkerReader):
            parts = reader({"path": str(own), "split": "2000"}).partitions()
            sizes[reader, count] = len(parts), max(len(pickle.dumps(p)) for p in parts)
    assert max(size for _, size in sizes.values()) < 1000
    assert sizes[recordings.SampleReader, 20_000][0] == sizes[recordings.SampleReader, 10][0] == 6 and sizes[recordings.MarkerReader, 20_000][0] > 100


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_texts_of_markers_in_ranges(tmp_path, end):
    """At any size of a range each marker comes once, and what stands in other sections doesn't come."""
    want = [(k * 3, f"S{k} ü, and  more" if k % 5 == 0 else f"S{k}") for k in range(60)]
    write_vhdr(tmp_path, [(t, m.replace(",", "\\1")) for t, m in want], more=end.join(["[Marker User Infos]", "Mk1=Stimulus,no,5,1,0", *["Prop=a,b,c"] * 40, "[Marker Infos]", "Mk99=Stimulus,last,400,1,0"]), end=end)
    want = [(t, t * 0.002, " ".join(m.split())) for t, m in [*want, (399, "last")]]
    for split in (*range(1, 80, 7), 500, 1 << 20):
        reader = recordings.MarkerReader({"path": str(tmp_path), "split": str(split)})
        got = [tuple(r.values())[1:] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == want
    (tmp_path / "r.vmrk").unlink()
    with pytest.raises(FileNotFoundError):
        reader.partitions()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(400).select(F.col("id").alias("t"), F.lit(None).cast("string").alias("marker"), F.when(F.col("id") < 390, 1.0).otherwise(F.raise_error(F.lit("no")).cast("double")).alias("C3"))
    with pytest.raises(Exception, match="no"):
        recordings.register(spark)
        df.repartition(1).sortWithinPartitions("t").write.format("recording_pieces").mode("append").options(rate=100.0).save(path)
    assert not [x for x in tmp_path.rglob("*") if x.is_file()]
    writer = recordings.PieceWriter(spark.createDataFrame([], "t long, marker string, C3 double").schema, {"path": path, "rate": "100"})
    import pyarrow as pa

    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array([None] * len(t), pa.string()), pa.array([1.0] * len(t))], names=["t", "marker", "C3"])
    written = writer.write(iter([batch([0, 1]), batch([2])]))
    assert recordings.found(path) == []  # not visible before the commit
    writer.abort([written, None])
    assert not [x for x in tmp_path.rglob("*") if x.is_file()]

    def broken():
        yield batch([0, 1])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not [x for x in tmp_path.rglob("*") if x.is_file()]


def test_traces(spark, tmp_path):
    for name in ("toy data_1_x", "toy data_10_y"):
        for run in range(2):
            for fold in (0, 12):
                folder = tmp_path / name / f"persistency_run{run}" / "features"
                folder.mkdir(parents=True, exist_ok=True)
                (folder / f"trace_sp{fold}.json").write_text("".join(f'{{"id": {k}, "score": {run}.{fold}}}\n' for k in range(3)))
                (folder / f"long_trace_sp{fold}.json").write_text('{"id": 9}\n')
    (tmp_path / "other.json").write_text('{"id": 1}\n')
    got = files.merge_traces(spark, str(tmp_path), "id long, score double", ["name", "complexity", "kind", "more"])
    assert got.rdd.getNumPartitions() <= 8  # of 17 files
    rows = got.collect()
    assert len(rows) == 24 and {(r["__name"], r["__complexity"], r["__kind"], r["__more"]) for r in rows} == {("toy data", "1", "x", None), ("toy data", "10", "y", None)}
    assert {(r["__run"], r["__fold"], r.score) for r in rows} == {(a, b, float(f"{a}.{b}")) for a in (0, 1) for b in (0, 12)}
