"""Operators whose groups may be of any size, against plain versions; sources, streams and reports on awkward input."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import boosting, drift, metrics, models, quantiles
from ledgerflow.operators import recommend as B
from ledgerflow.operators import splits
from ledgerflow.sources import files
from ledgerflow.streaming import tracker


@pytest.mark.parametrize("limit,parts", [(500_000, 64), (7, 4), (1, 2)])
def test_quantiles_equal_numpy(spark, monkeypatch, limit, parts):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rng = random.Random(1)
    groups = {"a": [rng.random() for _ in range(101)], "b": [rng.randint(0, 3) * 1.0 for _ in range(50)], None: [5.0], "d": [-1.0, 2.0], "e": [None]}
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("a", None, 2)]
    d = spark.createDataFrame(rows, "g string, v double, _k int")
    got = {r.g: (r.lo, r.mid, r.hi) for r in quantiles.quantiles(d, "v", {"lo": 0.1, "mid": 0.5, "hi": 1.0}, "g").collect()}
    want = {g: tuple(np.quantile(vs, [0.1, 0.5, 1.0])) for g, vs in groups.items() if g != "e"}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    whole = quantiles.quantiles(d, "v", {"mid": 0.5}).first()
    assert whole.mid == pytest.approx(np.median([v for _, v, _ in rows if v is not None]))
    assert quantiles.quantiles(d.limit(0), "v", {"mid": 0.5}, "g").collect() == []


@pytest.mark.parametrize("parts", [256, 3])
def test_lookup_and_cumulated(spark, parts):
    rng = random.Random(2)
    values = sorted({rng.randint(0, 60) / 4 for _ in range(40)})
    counts = {v: rng.randint(1, 5) for v in values}
    d = spark.createDataFrame([(v, n) for v, n in counts.items()], "v double, n long")
    index = quantiles.cumulated(d, "v", "n", parts=parts).orderBy("value").collect()
    total, upto, area = sum(counts.values()), 0, 0.0
    for i, r in enumerate(index):
        area += upto / total * (values[i] - values[i - 1]) if i else 0
        assert (r.value, r.below, r.total) == (values[i], upto, total) and r.area == pytest.approx(area)
        upto += counts[values[i]]
        assert r.upto == upto and r.next == (values[i + 1] if i + 1 < len(values) else None)
    asked = [-1.0, *[rng.random() * 16 for _ in range(50)], values[3], 99.0]
    q = spark.createDataFrame([(x,) for x in asked], "v double")
    got = {r.v: r.n for r in quantiles.lookup(q, d, "v", "n", parts=parts).collect()}
    assert got == {x: next((counts[v] for v in reversed(values) if v <= x), None) for x in asked}


def plain_drift(ref, cur, bins=10):
    lo, hi = min(ref + cur), max(ref + cur)
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    place = lambda v: sum(v >= lo + (hi - lo) * j / bins for j in range(1, bins))
    p, q = (np.bincount([place(v) for v in x], minlength=bins) / len(x) for x in (ref, cur))
    p, q = (np.where(x == 0, drift.EPS, x) for x in (p, q))
    points = sorted({*ref, *cur})
    f = lambda x, t: sum(v <= t for v in x) / len(x)
    w = sum(abs(f(ref, a) - f(cur, a)) * (b - a) for a, b in zip(points, points[1:]))
    return float(((q - p) * np.log(q / p)).sum()), w


def test_drift_equals_plain(spark):
    rng = random.Random(3)
    periods = {"1": [rng.gauss(10, 3) // 0.5 * 0.5 for _ in range(80)], "2": [rng.gauss(12, 3) // 0.5 * 0.5 for _ in range(60)], "3": [1000.0, 1000.0, 2000.0], "4": [-50.0], "5": [rng.gauss(10, 3) // 0.5 * 0.5 for _ in range(80)]}
    rows = [(p, v, rng.choice("xyz")) for p, vs in periods.items() for v in vs]
    d = spark.createDataFrame(rows, "p string, amount double, category string")
    got = {r.period: r for r in drift.drift_table(d, F.col("p")).collect()}
    assert set(got) == set("2345")
    for p in got:
        psi, w = plain_drift(periods["1"], periods[p])
        assert got[p].psi == pytest.approx(psi) and got[p].wasserstein == pytest.approx(w)
    same = spark.createDataFrame([("1", 4.0, "x"), ("2", 4.0, "x")], "p string, amount double, category string")
    r = drift.drift_table(same, F.col("p")).first()
    assert (r.psi, r.wasserstein, r.kl, r.status) == (0.0, 0.0, 0.0, "STABLE")


def test_bootstrap_keeps_rows_and_covers_the_mean(spark):
    rng = random.Random(4)
    rows = [("a", f"k{i}", rng.gauss(5, 2)) for i in range(400)] + [(None, "one", 7.0), ("b", "x", None), ("b", "y", 1.0), ("b", "z", 3.0)]
    d = spark.createDataFrame(rows, "g string, k string, v double")
    got = {r.g: r for r in metrics.bootstrap_ci(d, "k", "v", "g").collect()}
    a = [v for g, _, v in rows if g == "a"]
    error = np.std(a) / 20
    assert got["a"].low == pytest.approx(np.mean(a) - 1.96 * error, abs=0.5 * error) and got["a"].high == pytest.approx(np.mean(a) + 1.96 * error, abs=0.5 * error)
    assert (got[None].low, got[None].high, got[None].mean) == (7.0, 7.0, 7.0)
    assert 1.0 <= got["b"].low <= got["b"].high <= 3.0
    again = {r.g: r for r in metrics.bootstrap_ci(d.repartition(7), "k", "v", "g").collect()}
    assert all(again[g].low == pytest.approx(got[g].low) for g in got)


def test_json_of_every_shape(spark, tmp_path):
    row = lambda i: {"user_id": f"u{i}", "timestamp": "2024-01-01", "amount": str(i)}
    texts = {
        "lines.json": "\n".join(json.dumps(row(i)) for i in range(3)) + "\n\n",
        "broken_line.json": "\n".join([json.dumps(row(3)), '{"user_id": "u', json.dumps(row(4)), "12"]),
        "broken_first.json": "{oops\n" + json.dumps(row(5)) + "\n" + json.dumps({"transactions": [row(6), row(7)]}),
        "mostly_broken.json": "\n".join(["{a", "{b", "{c", json.dumps(row(8))]),
        "document.json": json.dumps([row(9), row(10)], indent=1),
        "object.json": json.dumps({"transactions": [row(11), {**row(12), "currency": "INR"}]}, indent=2),
        "one.json": json.dumps([row(13)]),
        "broken_document.json": json.dumps([row(14)], indent=1)[:-3],
        "nested/number.json": json.dumps({**row(15), "amount": 15, "merchant_raw": "Zürich"}),
        "empty.json": "",
    }
    (tmp_path / "nested").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = files.read_json(spark, str(tmp_path)).collect()
    assert sorted((int(r.user_id[1:]), r.amount) for r in got) == [(i, str(i)) for i in [*range(14), 15]]
    assert {r.user_id: (r.currency, r.merchant_raw) for r in got if r.currency or r.merchant_raw} == {"u12": ("INR", None), "u15": (None, "Zürich")}
    bad = {}
    for r in files.rejected_json(spark, str(tmp_path)).collect():
        bad.setdefault(r.file.rpartition("/")[2], []).append(r.record)
    assert {k: sorted(v) for k, v in bad.items() if k != "broken_document.json"} == {"broken_line.json": ["12", '{"user_id": "u'], "broken_first.json": ["{oops"], "mostly_broken.json": ["{a", "{b", "{c"]}
    assert "broken_document.json" in bad
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path / "empty.json"))


def events(*rows):
    return [(u, t, dt.datetime(2024, 1, day, hour), c, a) for u, t, day, hour, c, a in rows]


SCHEMA = "user_id string, transaction_id string, timestamp timestamp, category string, amount double"


def run(spark, tmp_path, batches, query, mode):
    """Adds one file after another and runs the stream to its end each time, from the checkpoint of the run before."""
    for rows in batches:
        spark.createDataFrame(events(*rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        put = lambda d, k: d.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
        query(stream).writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


BATCHES = [
    [("u", "t2", 4, 1, "groceries", 20.0), ("u", "t1", 3, 1, "groceries", 10.0), ("v", "t9", 6, 1, "unknown", 6.0)],
    [("u", "t1", 3, 1, "groceries", 10.0), ("u", "t3", 15, 1, "shopping", 30.0)],  # a repetition
    [("u", "t4", 14, 12, "groceries", 5.0), ("u", "t5", 2, 1, "groceries", 1000.0)],  # out of order; and far too late
]


def test_totals_survive_restarts_repeats_and_late_events(spark, tmp_path):
    got = tracker.latest(run(spark, tmp_path, BATCHES, tracker.category_totals, "update")).collect()
    assert {(r.user_id, r.category): (r.cents, r.max_day, r.events) for r in got} == {("u", "groceries"): (3500, 15, 4), ("u", "shopping"): (3000, 15, 4), ("v", "misc"): (600, 6, 1)}
    assert {(r.user_id, r.category): r.projected for r in got} == {("u", "groceries"): 70.0, ("u", "shopping"): 60.0, ("v", "misc"): 30.0}


def test_alerts_come_once_an_event(spark, tmp_path):
    base = spark.createDataFrame([("u", "groceries", 100.0, 10.0)], "user_id string, category string, mean double, std double")
    got = run(spark, tmp_path, BATCHES, lambda s: tracker.track(s, base), "append").collect()
    rows = sorted((r.transaction_id, round(r.projected, 6), bool(r.alert)) for r in got)
    assert rows == [("t1", 100.0, False), ("t2", 225.0, True), ("t3", 60.0, False), ("t4", 70.0, False), ("t9", 30.0, False)]


def test_calibrated_quantiles_by_hand(spark):
    fit = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (2.0, 2.0, 2.0, 3.0), (3.0, 3.0, 3.0, 2.0), (4.0, 4.0, 9.0, 8.0)], "p10 double, p50 double, p90 double, y double")
    new = spark.createDataFrame([(0.0, 2.5, 20.0), (4.0, 1.0, 1.0), (3.5, 3.5, 6.0)], "p10 double, p50 double, p90 double")
    got = sorted(tuple(r) for r in models.calibrated(fit, new, ("p10", "p50", "p90")).select("p10", "calibrated_p10", "calibrated_p50", "calibrated_p90").collect())
    # blocks of y: 1; 3 and 2 pooled to 2.5; 8. Between them lines, beyond them the ends; the second row's crossing values are put in order
    assert got == [(0.0, 1.0, 2.5, 8.0), (3.5, 5.25, 5.25, 5.25), (4.0, 1.0, 1.0, 8.0)]


def test_importance_finds_the_column_that_counts(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", "c", "m", float(a := rng.random()), rng.random(), 10 * a) for i in range(300)]
    d = spark.createDataFrame(rows, "user_id string, category string, month string, a double, b double, target double")
    model = models.regressor("linear").fit(models.assembled(d, ["a", "b"]))
    got = {r.feature: r.importance for r in models.permutation_importance(model, d, ["a", "b"], rows_a_block=100).collect()}
    assert got["a"] > 0.95 and got["a"] + got["b"] == pytest.approx(1)


def test_counterfactual(spark):
    d = spark.createDataFrame([("dining", 130.0, 100.0), ("travel", 5.0, 9.0)], "category string, now double, usual double")
    rows = {r.category: r for r in B.counterfactual(d, "now", "usual").collect()}
    assert (rows["dining"].overspend, rows["dining"].target, rows["dining"].per_day) == (30.0, 100.0, 1.0) and (rows["travel"].overspend, rows["travel"].target) == (0.0, 5.0)
    assert rows["dining"].statement == "If spend in 'dining' is reduced by INR 30.00 (approx. INR 1.00/day), overspend probability drops to 0% and savings target is preserved."


def test_a_hot_user_is_spread_over_blocks(spark):
    from ledgerflow.operators import rows as R

    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    data = [("hot" if rng.random() < 0.5 else f"u{rng.randint(0, 9)}", f"t{i}", start + dt.timedelta(seconds=rng.randint(0, 400) * 3600), rng.randint(1, 9999) / 100, rng.choice(["credit", "debit"])) for i in range(600)]
    d = spark.createDataFrame(data, "user_id string, transaction_id string, timestamp timestamp, amount double, direction string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    shown = lambda x: {r.transaction_id: [round(v, 6) if isinstance(v, float) else v for v in (r.cumulative_spend, r.rolling_tx_count, r.user_mean_amount, r.user_std_amount, r.days_since_previous, r.time_gap_hours, r.running_balance_proxy)] for r in x.collect()}
    plain = R.running(d)
    spread = R.running(d, hot_rows=30)
    assert shown(spread) == shown(plain) and spread.columns == plain.columns
    blocks = R.in_blocks(d.where("user_id = 'hot'").withColumn("_block", F.floor(F.unix_seconds("timestamp") / 86400)))
    assert shown(blocks) == {k: v for k, v in shown(plain).items() if k in {t[1] for t in data if t[0] == "hot"}}


def test_first_contained_equals_plain(spark):
    from ledgerflow.operators import canonical as C

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    rules = [(i, word(rng.randint(1, 7)), f"h{i}") for i in range(300)]
    rng.shuffle(rules)
    values = [word(rng.randint(0, 30)).upper() for _ in range(200)] + [None, "", "x", "ZOO"]
    plain = lambda v, rs: None if v is None else min(((r, h) for r, t, h in rs if t in v.lower()), default=(0, None))[1]
    d = spark.createDataFrame([(v, "k") for v in values], "v string, gram string")
    for rs in (rules, rules[:5], [*rules[:3], (1000, "", "any")]):
        for given in (rs, spark.createDataFrame(rs, "rank int, token string, hit string")):
            got = C.first_contained(d, "v", given, "out").collect()
            assert sorted(((r.v, r.out) for r in got), key=str) == sorted(((v, plain(v, rs)) for v in values), key=str)
            assert all(r.gram == "k" for r in got)


@pytest.mark.parametrize("limit,marks", [(200_000, 256), (5, 3), (1, 1)])
def test_time_cuts_in_crowded_days(spark, monkeypatch, limit, marks):
    monkeypatch.setattr(splits, "SORTED", limit)
    monkeypatch.setattr(splits, "MARKS", marks)
    day = dt.datetime(2024, 3, 5, 12)
    rows = [(day, f"t-{i * 7 % 40:03d}") for i in range(40)] + [(dt.datetime(2024, 3, 6), "t-100"), (dt.datetime(1960, 1, 1, 5), "a"), (None, "n"), (None, None)]
    d = spark.createDataFrame(rows, "timestamp timestamp, transaction_id string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or day, r[1] is not None, r[1] or ""))
    got = {(r.timestamp, r.transaction_id): r.split for r in splits.temporal_split(d, (0.03, 0.7)).collect()}
    assert [got[r] for r in order] == ["train"] * 1 + ["val"] * 29 + ["test"] * 14
    # repeated rows share a side; a table of one key, an empty table and extra columns
    same = spark.createDataFrame([(day, "x", 1, 2)] * 9 + [(day, "w", 1, 2)], "timestamp timestamp, transaction_id string, part int, day int")
    assert sorted((r.transaction_id, r.split, r.part, r.day) for r in splits.temporal_split(same).collect()) == [("w", "train", 1, 2)] + [("x", "test", 1, 2)] * 9
    assert splits.temporal_split(d.limit(0)).collect() == []


def plain_boosting(x, y, rounds, depth, rate, l2=1.0, leaf=20):
    """Trees over every distinct value, one row at a time, by the same gain; the scores of the rows."""
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        leaves = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in leaves:
                gap, best = (score - y)[rows], (0.0, None)
                for f in range(x.shape[1]):
                    for v in np.unique(x[rows, f])[:-1]:
                        left = x[rows, f] <= v
                        a, b = gap[left], gap[~left]
                        if min(len(a), len(b)) >= leaf:
                            gain = a.sum() ** 2 / (len(a) + l2) + b.sum() ** 2 / (len(b) + l2) - gap.sum() ** 2 / (len(gap) + l2)
                            best = max(best, (gain, f, -v), key=lambda z: z[0]) if best[1] is not None or gain > 0 else best
                if best[1] is None:
                    after.append(rows)
                else:
                    left = x[rows, best[1]] <= -best[2]
                    after += [rows[left], rows[~left]]
            leaves = after
        step = np.zeros(len(y))
        for rows in leaves:
            step[rows] = -rate * (score - y)[rows].sum() / (len(rows) + l2)
        score = score + (step if len(leaves) > 1 else 0)
    return score


def test_boosting_of_groups_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, n, scale in (("a", 150, 1.0), ("b", 90, 100.0), ("few", 30, 1.0)):
        x = rng.integers(0, 12, (n, 3)) / 4
        y = np.round(scale * (x[:, 0] * 3 + (x[:, 1] > 1) * x[:, 2]) + rng.normal(0, scale / 5, n), 3)
        score = plain_boosting(x, y, 5, 3, 0.3) if n >= 40 else np.full(n, y.mean())
        for i in range(n):
            rows.append((g, f"{g}{i}", *map(float, x[i]), float(y[i])))
            want[f"{g}{i}"] = score[i]
    rows += [("a", "null", 0.0, 0.0, 0.0, None), (None, "none", 1.0, None, float("nan"), 7.0)]
    d = spark.createDataFrame(rows, "grp string, id string, p double, q double, r double, target double")
    model = boosting.fit(d.repartition(3), ["p", "q", "r"], group="grp", rounds=5, depth=3, rate=0.3)
    got = {r.id: r.prediction for r in model.transform(d).collect()}
    assert model.rounds == 5 and max(abs(got[i] - want[i]) for i in want) < 0.05
    assert got["none"] == pytest.approx(7.0) and got["null"] is not None
    again = boosting.fit(d.repartition(5), ["p", "q", "r"], group="grp", rounds=5, depth=3, rate=0.3)
    assert {r.id: r.prediction for r in again.transform(d).collect()} == got  # whatever the partitions
    assert sum(v for _, v in model.importances()) == pytest.approx(1.0)
    unseen = spark.createDataFrame([("z", 1.0, 1.0, 1.0)], "grp string, p double, q double, r double")
    assert model.transform(unseen).first().prediction == 0.0
    empty = boosting.fit(d.limit(0), ["p", "q", "r"], group="grp")
    assert empty.rounds == 0 and empty.transform(unseen).first().prediction == 0.0


def test_boosting_stops_when_held_out_rows_gain_nothing(spark, monkeypatch):
    monkeypatch.setattr(boosting, "HELD_OUT", 100)
    monkeypatch.setattr(boosting, "PATIENCE", 2)
    d = spark.range(2000).select((F.col("id") % 10).cast("double").alias("p"), (F.rand(3) * 10).alias("target"))
    model = boosting.fit(d, ["p"], rounds=60, depth=2, rate=0.3)
    assert 0 < model.rounds < 60
