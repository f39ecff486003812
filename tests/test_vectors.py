"""Fits, draws and image features against NumPy and plain Python."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.functions.ranking import running
from auditloom.operators import curate as cu
from auditloom.operators import evaluate as ev
from auditloom.operators import vectors as ve


def fit(x, y, weight, penalty):
    """Bias and weights that minimise the weighted mean log loss plus the sum of penalty / 2 times squared weights."""
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([0.0, *np.broadcast_to(penalty, x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        gradient = x.T @ (weight * (p - y)) / weight.sum() + ridge @ b
        b = b - np.linalg.solve((x * (weight * p * (1 - p) / weight.sum())[:, None]).T @ x + ridge, gradient)
    return b


def area(positive, score):
    pairs = [(a > b) + 0.5 * (a == b) for a in score[positive] for b in score[~positive]]
    return np.mean(pairs)


def points(n=120, d=5, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.45
    x = rng.normal(size=(n, d)) + y[:, None] * np.array([1.0, 0.5, -0.7, 0, 0][:d])
    return x, y


def test_weighted_head(spark):
    x, y = points()
    grp = [i % 7 if i % 3 else 99 for i in range(len(x))]
    rows = [([float(v) for v in x[i]], "train" if i % 4 else "blind", "generated" if y[i] else "real", grp[i], bool(i % 4), False, "m", "b") for i in range(len(x))]
    schema = "vec array<double>, split string, kind string, grp int, reviewed boolean, label_present boolean, manifest string, backbone string"
    df = spark.createDataFrame(rows, schema)
    got = ve.weighted_head(df, "m", "b").first()
    on = np.array([i % 4 > 0 for i in range(len(x))])
    size = {g: sum(1 for i in range(len(x)) if on[i] and grp[i] == g) for g in set(grp)}
    want = fit(x[on], y[on].astype(float), np.array([1 / size[grp[i]] for i in range(len(x)) if on[i]]), 0.01)
    assert got["n"] == on.sum() and got["positives"] == y[on].sum()
    assert np.allclose([got["bias"], *got["weights"]], want, atol=1e-4)
    for bad, reason in ((df.withColumn("manifest", F.lit("x")), "manifest"), (df.withColumn("backbone", F.lit(None).cast("string")), "backbone"), (df.withColumn("reviewed", F.lit(None).cast("boolean")), "reviewed"), (df.filter("kind = 'real'"), "generated"), (df.limit(0), "real")):
        with pytest.raises(ValueError, match=reason):
            ve.weighted_head(bad, "m", "b")


def test_probe(spark):
    x, y = points()
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], bool(y[i])) for i in range(len(x))], "id long, vec array<double>, positive boolean")
    got = {r["fold"]: r for r in ve.linear_probe(df, folds=3, components=2).collect()}
    fold = np.array([r[0] for r in df.orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(3))).collect()])
    assert set(got) == {0, 1, 2}
    for f in got:
        on = fold != f
        z = (x - x[on].mean(0)) / x[on].std(0, ddof=1)
        _, vectors = np.linalg.eigh(np.cov(z[on].T))
        pcs = z @ vectors[:, ::-1][:, :2]
        b = fit(pcs[on], y[on].astype(float), np.ones(on.sum()), 0.1 * pcs[on].var(0, ddof=1))  # the penalty is on standardised weights
        score = 1 / (1 + np.exp(-(b[0] + pcs[~on] @ b[1:])))
        assert got[f]["n"] == (~on).sum() and abs(got[f]["accuracy"] - np.mean((score >= 0.5) == y[~on])) < 1e-9
        assert abs(got[f]["auc"] - area(y[~on], score)) < 0.01


def test_calibration(spark):
    x, y = points(200)
    missing = [[None if (i + j) % 11 == 0 else float(x[i, j]) for j in range(4)] for i in range(len(x))]
    df = spark.createDataFrame([(i, bool(y[i]), *missing[i]) for i in range(len(x))], "id long, positive boolean, f0 double, f1 double, f2 double, f3 double")
    got = {r["feature"]: r for r in ve.calibration(df, ["f0", "f1", "f2", "f3"]).collect()}
    half = np.array([r[0] for r in df.orderBy("id").select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 0).collect()])
    values = np.array(missing, float)
    areas = [area(y[half & ~np.isnan(values[:, j])], values[half & ~np.isnan(values[:, j]), j]) for j in range(4)]
    kept = [j for j in range(4) if abs(areas[j] - 0.5) >= 0.05]
    assert set(got) == {f"f{j}" for j in kept}
    middle = np.nanmedian(values[half], axis=0)
    z = np.where(np.isnan(values), middle, values)
    z = ((z - z[half].mean(0)) / z[half].std(0) * np.where(np.array(areas) >= 0.5, 1, -1))[:, kept]
    b = fit(z[half], y[half].astype(float), np.ones(half.sum()), 0.01 * z[half].var(0, ddof=1))
    score = 1 / (1 + np.exp(-(b[0] + z @ b[1:])))
    for k, j in enumerate(kept):
        r = got[f"f{j}"]
        assert r["polarity"] == (1 if areas[j] >= 0.5 else -1) and abs(r["auc"] - areas[j]) < 1e-9 and abs(r["middle"] - middle[j]) < 1e-9
        assert abs(r["weight"] - b[k + 1]) < 1e-3 and abs(r["bias"] - b[0]) < 1e-3
        assert abs(r["threshold"] - np.percentile(score[half & ~y], 90)) < 1e-3 and abs(r["test_auc"] - area(y[~half], score[~half])) < 0.01


@pytest.mark.parametrize("groups", [2, 9])
def test_bootstrap(spark, groups):
    means = {g: g * g / 100 for g in range(groups)}
    df = spark.createDataFrame(list(means.items()), "grp long, mean double")
    got = ev.bootstrap_interval(df, draws=200).first()
    hashes = spark.range(groups).withColumnRenamed("id", "grp").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(200)))).select("grp", "draw", F.xxhash64("grp", "draw", F.lit(17)).alias("h")).collect()
    below = list(itertools.accumulate(np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(8)))
    sums = {}
    for r in hashes:
        u = (r["h"] % (1 << 30) + 0.5) / (1 << 30)
        w = sum(u > b for b in below)
        s = sums.setdefault(r["draw"], [0, 0.0])
        s[0], s[1] = s[0] + w, s[1] + w * means[r["grp"]]
    draws = [s / w for w, s in sums.values() if w]
    assert got["n"] == groups and np.allclose([got["mean"], got["low"], got["high"]], [np.mean(list(means.values())), *np.percentile(draws, [2.5, 97.5])])


def png(grid):
    """Bytes of an RGB PNG of a height x width x 3 array."""
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = grid.shape
    body = b"".join(b"\0" + grid[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def plain_features(g):
    """The features pixel by pixel."""
    h, w = g.shape
    power = np.abs(np.fft.fftshift(np.fft.fft2((g - g.mean()) * np.outer(np.hanning(h), np.hanning(w))))) ** 2
    limit = min(h, w) // 2
    rings, sectors = {}, {}
    for i in range(h):
        for j in range(w):
            y, x = i - h // 2, j - w // 2
            r = np.sqrt(y * y + x * x)
            rings.setdefault(int(min(r, limit)), []).append(power[i, j])
            if 0.6 * limit <= r <= limit:
                sectors.setdefault(min(71, int((np.arctan2(y, x) + np.pi) / (2 * np.pi) * 72)), []).append(power[i, j])
    mean = {k / limit: np.mean(v) for k, v in rings.items()}
    mid, high, every = (sum(v for u, v in mean.items() if lo <= u < hi) for lo, hi in ((0.1, 0.4), (0.62, 1.0), (0.02, 1.0)))
    tail = sorted(u for u in mean if 0.5 <= u <= 0.95)
    band = np.array([v for u, v in mean.items() if u >= 0.1])
    taps = [(k, np.exp(-k * k / 8)) for k in range(-8, 9)]
    total = sum(t for _, t in taps)
    wide = np.pad(g, 8, mode="symmetric")
    rest = np.array([[g[i, j] - sum(a * b * wide[i + 8 + k, j + 8 + m] for k, a in taps for m, b in taps) / total**2 for j in range(w)] for i in range(h)])
    return {
        "high_share": high / (mid + high), "high_over_all": high / every, "tail_slope": np.polyfit(tail, np.log10([mean[u] for u in tail]), 1)[0] if len(tail) > 8 else 0.0, "flatness": np.exp(np.log(band).mean()) / band.mean(),
        "direction": max(sum(v) for v in sectors.values()) / (sum(sum(v) for v in sectors.values()) / 72), "variance": rest.var(), "kurtosis": (rest**4).mean() / rest.var() ** 2 - 3,
    }


def test_images(spark, tmp_path):
    rng = np.random.default_rng(5)
    grids = {"a": rng.integers(0, 256, (40, 48, 3), np.uint8), "b": (np.add.outer(np.arange(37), np.arange(53))[..., None] % 90 + rng.integers(0, 9, (37, 53, 3))).astype(np.uint8), "flat": np.full((20, 20, 3), 7, np.uint8)}
    for name, g in grids.items():
        (tmp_path / f"{name}.png").write_bytes(png(g))
    gray = ve.gray_images(spark.read.format("image").load(str(tmp_path)))
    rows = gray.select(F.xxhash64("path").alias("id"), F.regexp_extract("path", r"(\w+)\.png", 1).alias("name"), "height", "width", "pixels")
    got = {r["name"]: r for r in ve.image_features(rows).join(rows.select("id", "name"), "id").collect()}
    for name in ("a", "b"):
        g = np.round(grids[name].astype(float) @ [0.299, 0.587, 0.114])
        for k, v in plain_features(g).items():
            assert abs(got[name][k] - v) <= 1e-4 + 1e-6 * abs(v), (name, k)
        h, w = g.shape
        big = np.repeat(np.repeat(g, 8, 0), 9, 1)  # cells of h x w pixels
        cells = big.reshape(8, h, 9, w).mean(axis=(1, 3))
        bits = "".join(str(int(cells[i, j] > cells[i, j + 1])) for i in range(8) for j in range(8))
        assert got[name]["fp"] % (1 << 64) == int(bits, 2)
    assert got["flat"]["fp"] == 0 and got["flat"]["kurtosis"] == got["flat"]["variance"] == 0 and got["flat"]["tail_slope"] == 0
    none = ve.image_features(spark.createDataFrame([(1, 0, 0, []), (2, 0, 0, None)], "id long, height int, width int, pixels array<double>")).collect()
    assert len(none) == 2 and all(v is None for r in none for k, v in r.asDict().items() if k != "id")


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    values = sorted({0.0, 1.0, -2.5, 0.5, *(0.5 + rng.random(40) / 1e4), *rng.normal(size=40)})
    df = spark.createDataFrame([(k, float(v), i + 1) for k in "ab" for i, v in enumerate(values)], "k string, v double, n long")
    got = {(r["k"], r["v"]): r["s"] for r in running(df, ["k"], "v", {"s": "n"}).collect()}
    assert got == {(k, v): (i + 1) * (i + 2) // 2 for k in "ab" for i, v in enumerate(values)}


def test_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = [int(v) for v in rng.integers(-(1 << 63), 1 << 63, 12)]
    prints = [(b, "train") for b in base] + [(None, "train"), (base[0], "blind"), (base[1], None)]
    for n, b in enumerate(base):
        flips = sum(1 << int(k) for k in rng.choice(64, n % 7, replace=False))
        prints.append(((b ^ (flips - (1 << 64) if flips >> 63 else flips)), "blind" if n % 3 else "train"))
    got = sorted(tuple(r) for r in cu.near_fingerprints(spark.createDataFrame(prints, "fp long, split string")).collect())
    want = set()
    for (a, s), (b, t) in itertools.product(prints, prints):
        if a is not None and b is not None and s and t and s != t and a <= b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
            want.add((a, b, ((a ^ b) & ((1 << 64) - 1)).bit_count()))
    assert got == sorted(want) and want
