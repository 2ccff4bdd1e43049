"""Operators that SQL can't express, against numpy, and the edge cases of those it can."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmill.operators import ensemble, learners, metrics, selection, signal, tables, windowed, windower
from sigmill.sources import files
from sigmill.streaming import live


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (120, 4)) + [1, 0, 0.5, 0], rng.normal(0, 1, (80, 4)) @ np.diag([1, 2, 1, 0.5])])
    y = ["a"] * 120 + ["b"] * 80
    df = spark.createDataFrame([(i, l, [float(v) for v in r]) for i, (l, r) in enumerate(zip(y, x))], "id long, label string, x array<double>").repartition(5)
    return df, x, np.array(y)


def scores(df, model):
    return np.array([r.s for r in df.select("id", model.score("x").alias("s")).orderBy("id").collect()])


def test_moments(vectors):
    df, x, y = vectors
    m = learners.moments(df, "label", "x")
    for c in "ab":
        assert m.n[c] == (y == c).sum() and np.allclose(m.s[c], x[y == c].sum(0)) and np.allclose(m.q[c], x[y == c].T @ x[y == c])


def test_discriminants(vectors):
    df, x, y = vectors
    m = learners.moments(df, "label", "x")
    cov = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in "ab") / len(x)
    a, b = x[y == "a"].mean(0), x[y == "b"].mean(0)
    w = np.linalg.solve(cov, a - b)
    assert np.allclose(scores(df, learners.lda(m, "a", "b", 0.0)), x @ w - (a + b) @ w / 2 + np.log(120 / 80))

    def density(c):
        s, mu = np.cov(x[y == c].T, bias=True), x[y == c].mean(0)
        return -np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(s), x - mu) - np.linalg.slogdet(s)[1] + 2 * np.log((y == c).sum())

    assert np.allclose(scores(df, learners.qda(m, "a", "b", 0.0)), (density("a") - density("b")) / 2 * 1.0) or np.allclose(scores(df, learners.qda(m, "a", "b", 0.0)) * 2, density("a") - density("b"))
    design = np.hstack([x, np.ones((len(x), 1))])
    t = np.where(y == "a", 1.0, -1.0)
    ridge = np.linalg.solve(design.T @ design + np.diag([1, 1, 1, 1, 0]), design.T @ t)
    assert np.allclose(scores(df, learners.ridge_classifier(m, "a", "b")), design @ ridge)


def test_support_vectors(vectors):
    df, x, y = vectors
    got = learners.svm(df, "label", "x", "a", complexity=0.5)
    w, t, design = np.append(got.weights, got.bias), np.where(y == "a", 1.0, -1.0), np.hstack([x, np.ones((len(x), 1))])
    loss = lambda w: w @ w / 2 + 0.5 * (np.maximum(0, 1 - t * (design @ w)) ** 2).sum()
    rng = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + d) for d in rng.normal(0, 1e-2, (200, 5)))


def test_spatial_filters(vectors):
    df, x, y = vectors
    m = learners.moments(df, "label", "x")
    p = learners.pca(m, 2)
    assert np.allclose(abs(p.T @ np.cov(x.T, bias=True) @ p - np.diag(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])), 0, atol=1e-9)
    c = learners.csp(m, "a", 4)
    both = {k: c.T @ (x[y == k].T @ x[y == k] / (y == k).sum()) @ c for k in "ab"}
    for k in "ab":
        assert np.allclose(both[k], np.diag(np.diag(both[k])), atol=1e-9)
    assert np.diag(both["a"])[0] == max(np.diag(both["a"])) and np.diag(both["a"])[1] == min(np.diag(both["a"]))
    f = learners.fda(m, 1)[:, 0]
    w = np.linalg.solve(sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in "ab"), x[y == "a"].mean(0) - x[y == "b"].mean(0))
    assert abs(f @ w) / np.linalg.norm(f) / np.linalg.norm(w) == pytest.approx(1, abs=1e-4)
    assert learners.project(df, "x", p).select(F.size("projected")).distinct().collect() == [(2,)]


@pytest.mark.parametrize("most", [5_000, 7, 1])
def test_relief_takes_any_number_of_query_rows(vectors, most):
    df, x, y = vectors
    asked = [i for i in range(len(x)) if i % 9 == 0]
    want = np.zeros(4)
    for i in asked:
        near = [j for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable") if j != i]
        for sign, same in ((-1, True), (1, False)):
            want += sign * np.mean([abs(x[j] - x[i]) for j in near if (y[j] == y[i]) == same][:3], 0) / len(asked)
    got = selection.relief(df, "id", "label", "x", F.col("id") % 9 == 0, most=most).orderBy("f").collect()
    assert [r.f for r in got] == [0, 1, 2, 3] and np.allclose([r.weight for r in got], want)
    assert selection.relief(df, "id", "label", "x", F.lit(False), most=most).count() == 0


def test_platt_and_ridge(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(0, 2, 400)
    t = (rng.random(400) < 1 / (1 + np.exp(-1.5 * s - 0.3))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, t)], "score double, truth long")
    a, b = ensemble.platt(df, "truth", 1)
    assert a == pytest.approx(-1.5, abs=0.5) and b == pytest.approx(-0.3, abs=0.5)
    v = pd.DataFrame({"p": rng.choice([-1.0, 1.0], 50), "q": rng.choice([-1.0, 1.0], 50)})
    v["t"] = v.p
    w = ensemble.ridge_weights(spark.createDataFrame(v), ["p", "q"], "t", 0.5)
    x = v[["p", "q"]].to_numpy()
    assert np.allclose(w, np.linalg.solve(x.T @ x + 0.5 * np.eye(2), x.T @ v.t.to_numpy()))


def test_window_filters():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (3, 64))
    b, a = windowed.butterworth(3, 0.25)
    y = windowed.lfilter(b, a)(np.hstack([np.ones((1, 200)), np.zeros((1, 0))]))
    assert y[0, -1] == pytest.approx(1, abs=1e-6) and max(abs(np.roots(a))) < 1
    response = lambda f: abs(np.polyval(b, np.exp(1j * np.pi * f)) / np.polyval(a, np.exp(1j * np.pi * f)))
    assert response(0.25) == pytest.approx(np.sqrt(0.5), abs=1e-6) and response(0.9) < 0.01
    t = np.arange(64) / 64
    slow, fast = np.sin(2 * np.pi * 4 * t), np.sin(2 * np.pi * 20 * t)
    assert np.allclose(windowed.fft_bandpass(2, 8, 64)((slow + fast)[None]), slow, atol=1e-9)
    assert np.allclose(windowed.fft_resample(32)(slow[None]), slow[::2], atol=1e-9)
    assert np.allclose(windowed.fft_resample(128)(slow[None])[:, ::2], slow, atol=1e-9)
    d = windowed.detrend_linear(x + np.arange(64) * 3)
    assert np.allclose(d.mean(1), 0) and np.allclose(d @ np.arange(64), 0, atol=1e-6)
    z = windowed.dc_removal(0.9)(x)
    for k in range(1, 64):
        assert np.allclose(z[:, k], x[:, k] - x[:, k - 1] + 0.9 * z[:, k - 1])


def test_windows_of_length_one_and_empty_tables(spark):
    one = spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0)], "w long, k long, value double")
    arrays = windowed.as_arrays(one, ["w"], "k", "value")
    assert [r.x for r in windowed.each(arrays, windowed.dc_removal()).orderBy("w").collect()] == [[2.0], [3.0]]
    none = one.filter("false")
    assert windowed.each(windowed.as_arrays(none, ["w"], "k", "value"), windowed.dc_removal()).count() == 0
    assert signal.standardize(none, "value", ["w"]).count() == 0
    assert [r.value for r in signal.standardize(one, "value", ["w"]).collect()] == [0.0, 0.0]


def test_kernels():
    assert sum(signal.fir_lowpass(31, 0.3)) == pytest.approx(1) and sum(signal.fir_highpass(31, 0.3)) == pytest.approx(0, abs=1e-9)
    assert abs(np.polyval(signal.fir_bandpass(61, 0.2, 0.5), np.exp(1j * np.pi * 0.35))) == pytest.approx(1, abs=0.05)


def test_confusion_guards(spark):
    rows = spark.createDataFrame([("x", 1, 0)], "g string, t long, p long")
    r = metrics.from_counts(metrics.confusion(rows, ["g"], "t", "p", 1)).first()
    assert (r.True_positive_rate, r.True_negative_rate, r.False_positive_rate, r.Matthews, r.F_measure, r.Percent_incorrect) == (0, 0, 1, 0, 0, 100)
    assert metrics.auc(rows.withColumn("s", F.lit(0.5)), ["g"], "t", "s", 1).first().AUC == 1


def test_strip_of_unknown_column_is_empty(spark):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    assert tables.strip(df, {"z": [1]}).count() == 0
    with pytest.raises(ValueError):
        tables.add_key(df, "x", 3)
    gaps = tables.complete(df.select(F.col("x").alias("__x")), tables.expected_settings({"__x": [1, 2]}, spark), ["__x"], 2, {"m": 0.0})
    assert sorted(r["__x"] for r in gaps.collect()) == [1, 1, 2, 2]


def test_ranks_are_exact_over_ranges(spark):
    df = spark.range(5000).withColumn("c", F.col("id") % 3)
    r = selection.ranked(df, ["c"], "id").groupBy("c").agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.max("size").alias("s")).collect()
    assert all(x.n == x.s == x.b + 1 and x.a == 0 for x in r)
    folds = selection.cv_folds(df, "id", 4, ["c"]).groupBy("c", "fold").count().collect()
    assert len(folds) == 12 and max(x["count"] for x in folds) - min(x["count"] for x in folds) <= 1


def test_windows_stay_inside_their_stream(spark):
    s = spark.createDataFrame([(1, t, "m" if t in (0, 5, 9) else "o", float(t)) for t in range(10)], "u long, t long, marker string, value double")
    w = windower.marker_windows(s, [windower.WindowDef("w", "x", "m", -1, 1)], ["u"])
    assert {r.m for r in windower.extract(s, w, ["u"], "value").collect()} == {5}
    assert {r.m for r in windower.extract(s, w, ["u"], "value", whole=False).collect()} == {0, 5, 9}
    missing = windower.marker_windows(s, [windower.WindowDef("w", "x", "m", 0, 1, include=(windower.Near("none", 3, 3),))], ["u"])
    assert missing.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a, 1, 2.5\nb, 3,\n")
    got = files.csv_features(spark, str(tmp_path / "f.csv"), ["p", "q"]).orderBy("label").collect()
    assert [(r.label, r.features) for r in got] == [("a", [1.0, 2.5]), ("b", [3.0, None])]
    (tmp_path / "f.arff").write_text("% c\n@relation r\n@attribute 'size x' numeric\n@attribute kind {u,v}\n@data\n1.5, u\n?, 'v'\n")
    got = files.arff(spark, str(tmp_path / "f.arff")).collect()
    assert sorted((str(r["size x"]), r.kind) for r in got) == [("1.5", "u"), ("None", "v")]
    x = np.array([[1, -2], [3, 4], [5, 6]], "<i2")
    (tmp_path / "r.eeg").write_bytes(x.tobytes())
    (tmp_path / "r.vhdr").write_text("Brain\n[Common Infos]\nDataFile=r.eeg\nMarkerFile=r.vmrk\nSamplingInterval=1000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=C3,,0.5\nCh2=C4,,1\n")
    (tmp_path / "r.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S  8,2,1,0\n")
    s, m, fs = files.brain_products(spark, str(tmp_path / "r.vhdr"))
    assert fs == 1000 and [(r.t, r.marker) for r in m.collect()] == [(1, "S 8")]
    assert sorted((r.t, r.channel, r.value) for r in s.collect()) == [(0, "C3", 0.5), (0, "C4", -2.0), (1, "C3", 1.5), (1, "C4", 4.0), (2, "C3", 2.5), (2, "C4", 6.0)]
    df = spark.createDataFrame([(0.5, "x", None)], "metric double, __p string, note string")
    files.results(df, str(tmp_path / "out"))
    back = files.read_results(spark, str(tmp_path / "out"), ["metric"])
    assert back.columns[0] == "__p" and back.first().metric == 0.5


def _events(spark, folder):
    rows = [(k, u, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * k)).to_pydatetime(), float(k % 5)) for k in range(40) for u in (1, 2)]
    df = spark.createDataFrame(rows, "k long, u long, ts timestamp, x double")
    for part in range(4):
        df.filter((F.col("k") >= 10 * part) & (F.col("k") < 10 * part + 10)).coalesce(1).write.parquet(f"{folder}/in/part={part}")
    return rows, spark.readStream.schema("k long, u long, ts timestamp, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def _run(spark, stream, folder, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streaming(spark, tmp_path):
    rows, stream = _events(spark, tmp_path)
    means = _run(spark, live.window_means(stream, ["u"], "ts", "x", "1 hour"), tmp_path, "means", "complete")
    want = pd.DataFrame(rows, columns=["k", "u", "ts", "x"]).assign(h=lambda d: d.ts.dt.floor("h")).groupby(["u", "h"]).x.agg(["count", "mean"]).reset_index()
    assert sorted((r.u, r.n, round(r["mean"], 9)) for r in means.collect()) == sorted((int(r.u), int(r["count"]), round(r["mean"], 9)) for _, r in want.iterrows())
    found = _run(spark, live.sessions(stream, ["u"], "ts", "10 minutes", "0 minutes"), tmp_path, "trials", "append")
    assert found.count() == 0  # every event is within the gap of the next, so no session has closed
    dc = _run(spark, live.dc_removal(stream, "u", "k", "x", 0.9), tmp_path, "dc", "append").orderBy("u", "k").collect()
    x = np.array([k % 5 for k in range(40)], float)
    y = np.zeros(40)
    for k in range(40):
        y[k] = x[k] - (x[k - 1] if k else 0) + 0.9 * (y[k - 1] if k else 0)
    assert len(dc) == 80 and np.allclose([r.x for r in dc], np.tile(y, 2))
    q = live.predict(stream, lambda df: df.select("k", "u", (F.col("x") > 2).alias("label")), f"{tmp_path}/pred", f"{tmp_path}/pc")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/pred").filter("label").count() == 2 * sum(k % 5 > 2 for k in range(40))
    p = stream.select("u", F.col("ts").alias("p_time"), (F.col("x") > 2).alias("predicted"))
    r = stream.select("u", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("r_time"), (F.col("x") > 1).alias("truth"))
    matched = _run(spark, live.online_confusion(p, r, "u", "2 MINUTES"), tmp_path, "conf", "append")
    assert matched.count() == 80


def test_segments_change_nothing(spark):
    """Short segments with halos give what one window over the whole stream gives."""
    rng = np.random.default_rng(6)
    s = spark.createDataFrame([(u, t, rng.choice(["a", "b", "c"]), float(rng.normal())) for u, n in ((1, 57), (2, 1), (3, 16)) for t in range(n)], "u long, t long, marker string, value double")
    key, order = ["u"], ["t"]
    for f in (
        lambda n: signal.diff2(s, "value", key, order, length=n), lambda n: signal.diff5(s, "value", key, order, length=n), lambda n: signal.diff5(s, "value", key, order, True, length=n),
        lambda n: signal.tkeo(s, "value", key, order, length=n), lambda n: signal.moving_variance(s, "value", key, order, 9, length=n), lambda n: signal.fir(s, "value", key, order, [0.5, 0.3, 0.2], length=n),
        lambda n: signal.adaptive_threshold(s, "value", key, order, 5, 0.5, 3, length=n),
        lambda n: windower.marker_windows(s, [windower.WindowDef("w", "x", "a", -1, 2, exclude=(windower.Near("b", 1, 0),), include=(windower.Near("c", 6, 0),))], key, length=n),
    ):
        whole, cut = ([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(f(n).collect())] for n in (1 << 15, 4))
        assert whole == cut and whole
    from sigmill.operators import segments

    last = segments.last_where(s, key, "t", {"a": F.col("marker") == "a"}, 4).orderBy("u", "t").collect()
    seen: dict = {}
    for r in last:
        assert r.a == seen.get(r.u)
        if r.marker == "a":
            seen[r.u] = r.t
    n = segments.numbered(s.drop("t").withColumn("k", F.col("value")), key, F.floor("k"), ["k"], "p").groupBy("u").agg(F.count_distinct("p").alias("n"), F.max("p").alias("m")).collect()
    assert {(r.u, r.n, r.m) for r in n} == {(1, 57, 56), (2, 1, 0), (3, 16, 15)}
