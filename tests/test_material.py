"""Fonts, retried lines, comparisons and training against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.operators import material as M
from daftar.plans import reader
from daftar.plans import train as T
from daftar.vision import network as N


def test_coverage_is_a_division(spark):
    ten = [(1776 + i, f"s{i}") for i in range(10)]
    fonts = {
        "whole": ten, "copy": ten, "latin too": [*ten, (65, "a"), (66, "b")], "short": ten[:9], "shared": [*ten[:9], (1785, "s0")],
        "none": [(65, "a")], "no shape": [*ten[:9], (1785, None)], "twice": ten + ten, "odd": [*ten, (1776, "other")],
    }
    rows = [(k, c, s) for k, v in fonts.items() for c, s in v] + [(None, 1776, "s0")]
    got = {r.font: (r.codes, r.shapes, r.complete) for r in M.coverage(spark.createDataFrame(rows, "font string, code int, shape string"), "font").collect()}
    assert got == {
        "whole": (10, 10, True), "copy": (10, 10, True), "latin too": (10, 10, True), "short": (9, 9, False), "shared": (10, 9, False),
        "no shape": (9, 9, False), "twice": (10, 10, True), "odd": (10, 11, False), None: (1, 1, False),
    }
    fonts = M.coverage(spark.createDataFrame(rows, "font string, code int, shape string"), "font")
    assert [tuple(r) for r in M.usable(fonts, "font", ("COPY",)).collect()] == [("latin too", 3)]
    assert M.usable(fonts, "font", ("o", "i", "e")).count() == 0
    wide = spark.createDataFrame([("f", c, str(c)) for c in (1, 32768, 32769, 0x10FFFF)], "font string, code int, shape string")
    assert M.coverage(wide, "font", [1, 32768, 32769, 0x10FFFF]).first().complete


def test_first_good_draw(spark):
    rows = spark.range(400)
    draw = lambda s: F.struct((F.pmod(F.xxhash64(s), F.lit(10))).alias("v"), s.alias("seed"))
    got = {r.id: r for r in M.retried(rows, draw, lambda c: c["v"] < 3, F.col("id")).collect()}
    every = {r.seed: r.v for r in spark.range(2000).select(F.col("id").alias("seed"), draw(F.col("id"))["v"].alias("v")).collect()}
    blank = 0
    for i in range(400):
        good = [a for a in range(5) if every[i * 5 + a] < 3]
        assert got[i].attempt == (good[0] + 1 if good else None)
        assert (got[i].drawn.v if got[i].drawn else None) == (every[i * 5 + good[0]] if good else None)
        blank += not good
    assert 20 < blank < 120


def test_compare_of_missing_null_and_nan(spark):
    nan = float("nan")
    one = [(1, "a", 1.0, 1), (2, "a", nan, 2), (3, None, 5.0, None), (4, "a", None, 4), (5, "a", 1.0, 5), (8, "a", nan, 1), (9, "a", 2.0, 1)]
    two = [(1, "a", 1.004, 1), (2, "a", nan, 3), (3, None, 5.2, 3), (4, "a", None, 4), (6, "a", 1.0, 5), (8, "a", 1.0, 1), (9, "a", None, 1)]
    kind = "k long, s string, x double, n long"
    got = M.compare(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), ["k", "s"], ["x", "n"], 5e-3).collect()
    assert [(r.column, r.only_one, r.only_two, r.differing) for r in got] == [("x", 1, 1, 3), ("n", 1, 1, 2)]
    assert got[0].worst == pytest.approx(0.2) and got[1].worst == 1.0
    empty = M.compare(spark.createDataFrame([], kind), spark.createDataFrame([], kind), ["k"], ["x"], 1.0).collect()
    assert [tuple(r) for r in empty] == [("x", 0, 0, 0, None)]
    with pytest.raises(Exception, match="stands twice"):
        M.compare(spark.createDataFrame(one + one[:1], kind), spark.createDataFrame(two, kind), ["k", "s"], ["x"], 1.0).collect()


@pytest.mark.parametrize("parts", [1, 3, 23])
def test_sums_of_tasks_equal_plain_ridge(spark, monkeypatch, parts):
    monkeypatch.setattr(T, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(3, [0.01, 1, 5, 100, 0.5], (200, 5))
    y = np.column_stack([x @ [1, 2, 3, 0.1, -1] + rng.normal(0, 0.1, 200), rng.normal(0, 1, 200)])
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(parts)
    g = T.gram(rows, 5, 2)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(200)])
    want = np.linalg.solve(z.T @ z + 10 * np.eye(6), z.T @ y)
    assert g.n == 200 and np.abs(g.scaled(g.mean(), g.spread()).ridge(10) - want).max() < 1e-6
    assert T.gram(rows.limit(0), 5, 2).n == 0


def test_the_reader_is_the_plain_ridge_of_its_lines(spark):
    """The weight file made from sums against all lines at once on the driver."""
    n = 240
    lines = reader.drawn_lines(spark, n).toPandas()
    x, is_date = np.stack(lines.x.to_numpy()).astype(np.float64), lines.digits.notna().to_numpy()
    mean, spread = x.mean(0), np.maximum(x.std(0), reader.LEAST_SPREAD * x.std(0).max())
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    places = np.array([[int(c) for c in d] for d in lines.digits[is_date]])
    wanted = np.where(np.arange(10) == places[:, :, None], 0.9, -0.1).reshape(len(places), -1)
    ridge = lambda a, y: np.linalg.solve(a.T @ a + reader.RIDGE * np.eye(a.shape[1]), a.T @ y)
    head = np.column_stack([ridge(z[is_date], wanted), ridge(z, np.where(is_date, 1.0, -1.0))])
    weights = (head[:-1] / spread[:, None]).T
    made = N.load(reader.fit(spark, n)).weights["fc1"][: len(weights)]
    step = np.abs(weights).max(1, keepdims=True) / 127
    assert (np.abs(made - weights) <= 0.51 * step + 1e-6).all()


def test_steps_equal_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(0, 1, (3, 4))
    label = rng.integers(0, 3, 240)
    x = centre[label] + rng.normal(0, 0.7, (240, 4))
    rows = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(240)], "id long, x array<double>, label int")
    schedule = T.Schedule(3, 2, 1.5)
    train, held = rows.where("id % 4 != 0"), rows.where("id % 4 = 0")
    w, told = T.descend(train, held, 4, 3, schedule)
    order = {e: {r.id: r.step for r in train.select("id", T.place_in_epoch(F.col("id"), e, 2).alias("step")).collect()} for e in range(3)}
    assert order[0] != order[1] and set(order[0].values()) == {0, 1}
    plain, best, kept, accuracies = np.zeros((5, 3)), -1.0, None, []
    one = np.column_stack([x, np.ones(240)])
    for e in range(3):
        for s in range(2):
            some = np.array([i for i, step in order[e].items() if step == s])
            z = np.exp(one[some] @ plain)
            d = z / z.sum(1, keepdims=True) - np.eye(3)[label[some]]
            plain = plain - 0.75 * (1 + math.cos(math.pi * (e * 2 + s) / 6)) * one[some].T @ d / len(some)
        good = float(((one[::4] @ plain).argmax(1) == label[::4]).mean())
        accuracies.append(good)
        if good >= best:
            best, kept = good, plain
    assert np.abs(w - kept).max() < 1e-9
    assert [a for _, a, _ in told] == pytest.approx(accuracies) and best > 0.7
    assert schedule.at(0) == 1.5 and schedule.at(6) == pytest.approx(0)
    assert T.accuracy(rows.limit(0), w) == 0.0


def test_totals_of_every_set(spark):
    rows = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", None, None)], "k string, s string, p boolean")
    got = {(r.k, r.s, r.level): (r.n, r.n_positive, r.rate) for r in M.totals(rows, ["k", "s"], "p").collect()}
    assert got[(None, None, 3)] == (3, 1, 0.5) and got[("a", None, 1)] == (2, 1, 0.5)
    assert got[("b", None, 0)] == (1, None, None) and got[(None, None, 2)] == (1, None, None)  # a null is a value; the level tells it apart
