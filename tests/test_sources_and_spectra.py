"""Scan files, hatches, series, spectra and synthetic melt pools."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltfield.operators import spectral
from meltfield.sources import synthetic
from meltfield.sources.hatch import ScanPathBuilder, ScanStrategy, create_path_vectors
from meltfield.sources.scan import read_scan_path
from meltfield.sources.series import as_series, kind_of, read_data


def test_scan_file_tab(spark, tmp_path):
    (tmp_path / "scan").write_text("Mode\tX(m)\tY(m)\tZ(m)\tPower(W)\ttParam\n1\t0\t0\t0\t200\t0\n0\t0.008\t0\t0\t200\t1.7\n")
    (v,) = read_scan_path(spark, str(tmp_path / "scan")).collect()
    assert (v["sx"], v["ex"], v["t0"]) == (0.0, 0.008, 0.0) and v["t1"] == pytest.approx(4.7058823529e-3)


def test_scan_file_with_delay_short_rows_and_more_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("Mode X Y Z Power tParam\n1 0 0 0 0 1e-5\n\n0 1 2\n0 .001 0 0 200 .8 extra\n0 .001 .0001 0 200 .8\n")
    b.write_text("Mode X Y Z Power tParam\n0 5 0 0 0 1\n0 6 0 0 0 0\n2 7 0 0 0 1\n0 8 0 0 1 2\n")
    rows = read_scan_path(spark, [str(a), str(b)]).orderBy("vector_id").collect()
    assert [(r["t0"], r["t1"]) for r in rows[:2]] == [(pytest.approx(1e-5), pytest.approx(1.26e-3)), (pytest.approx(1.26e-3), pytest.approx(1.385e-3))]
    # a leading raster row seeds the next start; other modes pass time but emit no vector; no speed takes no time
    assert [(r["sx"], r["ex"], r["t0"], r["t1"]) for r in rows[2:]] == [(5.0, 6.0, 0.0, 0.0), (7.0, 8.0, 1.0, 1.5)]


def test_scan_files_without_rows(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    (tmp_path / "header").write_text("Mode X Y Z Power tParam\n")
    assert read_scan_path(spark, [str(tmp_path / "empty"), str(tmp_path / "header")]).count() == 0
    assert read_scan_path(spark, []).count() == 0
    with pytest.raises(FileNotFoundError):
        read_scan_path(spark, str(tmp_path / "missing"))


def test_hatch_of_the_process_parameters(spark):
    box = [[0, 0, 0], [1, 1, 0.5]]
    s = ScanStrategy(box, 200, 1, 0.1, 0.05, 67, 0.1, 0)
    assert (s.lines, s.last_layer) == (13, 10)
    v = create_path_vectors(spark, box, 200, 1, 0.1, 0.05, 67, 0.1, 0).orderBy("vector_id").collect()
    assert len(v) == 143
    assert (v[0]["sx"], v[0]["sy"], v[0]["ex"], v[0]["ey"], v[0]["t0"], v[0]["t1"]) == pytest.approx((-0.1, -0.1, 1.1, -0.1, 0, 1.2))
    assert (v[-1]["t0"], v[-1]["t1"]) == pytest.approx((158.4, 159.6))
    assert sorted({round(r["sz"], 9) for r in v}) == pytest.approx([k * 0.05 for k in range(11)])
    # every layer is the base turned about the centre
    c, a = 0.5, math.radians(67 * 3)
    x, y = v[13 * 3]["sx"] - c, v[13 * 3]["sy"] - c
    assert (x, y) == pytest.approx((math.cos(a) * -0.6 + math.sin(a) * 0.6, -math.sin(a) * 0.6 - math.cos(a) * 0.6))


def test_hatch_of_the_large_example(spark):
    s = ScanStrategy([[0, 0, 0], [5e-4] * 3], 370, 1.7, 140e-6, 30e-6, 67, 500e-6, 0)
    v = s.vectors(spark).orderBy("vector_id").collect()
    assert (s.lines, s.last_layer, len(v)) == (11, 17, 198)
    assert v[0]["t1"] == pytest.approx(8.8235294e-4)
    assert (v[11]["t0"], v[11]["t1"]) == pytest.approx((8.8235294e-3, 9.7058824e-3))
    assert v[-1]["t1"] == pytest.approx(0.1597058824)


@pytest.mark.parametrize("mode, files", [("layers", 11), ("all", 1)])
def test_layers_written_and_read_back(spark, tmp_path, mode, files):
    b = ScanPathBuilder([[0, 0, 0], [1, 1, 0.5]], 200, 1, 0.1, 0.05, 67, 0.1, 0)
    b.generate_layers(spark)
    written = b.write_layers(str(tmp_path / "scan"), mode, spark)
    assert len(written) == files
    back = read_scan_path(spark, written).count()
    assert back == b.process_vectors(spark).count() == 143
    first = open(written[0]).read().split("\n")
    assert first[1:3] == ["1 -0.100000 -0.100000 0.000000 0.000000 0.000000", "0 1.100000 -0.100000 0.000000 200.000000 1.000000"]


def test_series_files(spark, tmp_path):
    f = tmp_path / "data.csv"
    f.write_text("# time, value\n0, 1.1\n0.5 ,2.2 # note\n\n1,3.3\n")
    data = read_data(spark, str(f))
    assert kind_of(data) == "series" and [tuple(r) for r in data.orderBy("n").select("c0", "c1").collect()] == [(0.0, 1.1), (0.5, 2.2), (1.0, 3.3)]
    assert read_data(spark, str(f), "float32").orderBy("n").first()["c1"] == float(np.float32(1.1))
    with pytest.raises(FileNotFoundError):
        read_data(spark, str(tmp_path / "no"))
    f.write_text("1,2,3,4\n")
    with pytest.raises(ValueError):
        kind_of(read_data(spark, str(f)))


def wave(spark, n=100):
    t = np.linspace(0, 1, n)
    return spark.createDataFrame([("w", i, float(a), float(1e-4 + 2e-5 * math.sin(10 * math.pi * a))) for i, a in enumerate(t)], "series_id string, n long, t double, value double")


@pytest.mark.parametrize("method", ["fft", "sql"])
def test_spectrum_goldens(spark, method):
    modes = spectral.compute_spectral_components(wave(spark), 3, method).orderBy("k").collect()
    assert [tuple(m)[2:] for m in modes] == [pytest.approx(x, rel=1e-6, abs=1e-14) for x in ((1e-4, 0, 0), (4.0876165465e-08, 0.99, -1.5393804003), (9.3202056060e-08, 1.98, -1.5079644737))]
    assert spectral.compute_spectral_components(wave(spark), 1, method).count() == 1
    with pytest.raises(Exception):
        spectral.compute_spectral_components(wave(spark, 5), 9, method).collect()


def test_melt_pool_pads_scales_and_keeps_spectra(spark):
    series = wave(spark).select("n", F.col("t").alias("c0"), F.col("value").alias("c1"))
    spectrum = spark.createDataFrame([(0, 1e-4, 0.0, 0.0), (1, 2e-5, 5.0, 0.0), (2, 1e-5, 10.0, math.pi / 2), (3, 1e-6, 1.0, 0.1)], "n long, c0 double, c1 double, c2 double")
    pool = spectral.create_melt_pool({"width": (series, 3, 2.0, 2.0), "depth": (spectrum, 2, 9.0, 1.0), "height": (series, 1, 1.0, 0.5)}, False)
    assert pool.n_modes == 4 and pool.mean("width") == pytest.approx(2e-4) and pool.modes["depth"][3] == (1e-6, 1.0, 0.1)
    assert pool.maximum("depth") == pytest.approx(1.31e-4) and pool.modes["height"][1:] == ((0.0, 0.0, 0.0),) * 3
    assert (pool.depth_shape, pool.height_shape) == (1.0, 0.5)
    with pytest.raises(ValueError):
        spectral.create_melt_pool({"width": (series, 3, 1, 2)}, False)


def test_as_series_numbers_rows(spark):
    data = spark.createDataFrame([(4, 0.0, 1.0), (9, 0.5, 2.0)], "n long, c0 double, c1 double")
    assert [(r["n"], r["t"]) for r in as_series(data, "x").orderBy("n").collect()] == [(0, 0.0), (1, 0.5)]


@pytest.mark.parametrize("low, high", [(0.1, 0.3), (0.0085, 0.0255), (0.3, 0.999)])
def test_butterworth_gain(low, high):
    s = synthetic.butterworth_band(4, low, high)
    assert len(s) == 4

    def gain(edge):
        z = np.exp(-1j * math.pi * edge)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in s]))

    assert gain(low) == pytest.approx(math.sqrt(0.5), rel=1e-6) and gain(high) == pytest.approx(math.sqrt(0.5), rel=1e-5)
    centre = 2 / math.pi * math.atan(math.sqrt(math.tan(math.pi * low / 2) * math.tan(math.pi * high / 2)))
    assert gain(centre) == pytest.approx(1.0, rel=1e-6) and gain(low / 20) < 1e-3


def test_synthetic_series(spark):
    f = synthetic.MeltPoolFilter(148e-6, 18e-6, 1.7, [250000, 0.02])
    f.add_effect("scale", [800e-6, None, 1])
    f.initialize(spark)
    assert f.physical_effects["scale"]["frequency_hz"] == pytest.approx(2125) and f.physical_effects["scale"]["sigma_contribution"] == pytest.approx(18e-6)
    values = np.array([r["c1"] for r in f.generate_fluctuations(1, spark).orderBy("n").collect()])
    assert len(values) == f.n_points and values.std() == pytest.approx(18e-6, rel=1e-2)
    assert np.array_equal(values, [r["c1"] for r in f.generate_fluctuations(1, spark).orderBy("n").collect()])
    f.add_effect("fast", [None, 2e5, 1])
    with pytest.raises(ValueError):
        f.initialize(spark)
    with pytest.raises(ValueError):
        f.add_effect("none", [None, None, 1])


def test_effects_share_the_variance(spark):
    effects = spark.createDataFrame([("a", 8e-4, None, 3.0), ("b", None, 500.0, 4.0)], synthetic.EFFECT)
    rows = {r["name"]: r for r in synthetic.normalised(effects, 10.0, 1.6).collect()}
    assert (rows["a"]["frequency_hz"], rows["a"]["sigma_contribution"]) == pytest.approx((2000, 6)) and (rows["b"]["frequency_hz"], rows["b"]["sigma_contribution"]) == pytest.approx((500, 8))
    assert synthetic.band(2125, 250000) == pytest.approx((0.0085, 0.0255)) and synthetic.band(1e5, 2.5e5)[1] == 0.999 and synthetic.band(1e-3, 2.5e5)[0] == 1e-4


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    """Files cut into many splits, one listed twice, names with spaces; the order is that of the text."""
    from meltfield.sources.lines import numbered_lines

    names = [str(tmp_path / n) for n in ("a b.txt", "c.txt", "e.txt")]
    texts = [[f"{n} line {i} " + "x" * (i % 50) for i in range(m)] for n, m in ((0, 900), (1, 3), (2, 0))]
    for name, lines in zip(names, texts):
        with open(name, "w") as f:
            f.write("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = numbered_lines(spark, [names[0], names[1], names[0], names[2]])
        assert rows.rdd.getNumPartitions() >= 1
        got = {}
        for r in rows.collect():
            got.setdefault(r["file_id"], {})[r["seq"]] = r["line"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {f"{k:06d}": dict(enumerate(texts[t])) for k, t in enumerate((0, 1, 0)) }
    assert got == want
