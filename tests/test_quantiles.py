import math
import random

import numpy as np
import pytest

from seqmill.operators import quantiles, report

SHARES = {"least": 0.0, "p05": 0.05, "p50": 0.5, "p90": 0.9, "most": 1.0}


def values(kind, rng):
    n = rng.randint(1, 400)
    return {
        "uniform": lambda: [rng.uniform(-5, 5) for _ in range(n)],
        "ties": lambda: [float(rng.randint(0, 3)) for _ in range(n)],
        "one": lambda: [7.25] * n,
        "wide": lambda: [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 307) for _ in range(n)],
        "close": lambda: [1.0 + rng.randint(0, 30) * 2.0**-52 for _ in range(n)],
        "hot": lambda: [0.0] * n + [rng.gauss(0, 1e-9) for _ in range(n)] + [1e12],
        "edges": lambda: [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0],
    }[kind]()


@pytest.mark.parametrize("cuts", [16, 4096])
def test_against_sorting(spark, monkeypatch, cuts):
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    rng = random.Random(cuts)
    kinds = ["ties", "one", "edges"] if cuts < 100 else ["uniform", "wide", "close", "hot", "edges"]
    groups = {(kind, k or None): values(kind, rng) for kind in kinds for k in range(2)}
    rows = [(a, b, v) for (a, b), vs in groups.items() for v in vs] + [(kinds[0], None, None), (kinds[1], None, math.nan), ("none", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, k int, v double").repartition(3)
    got = {(r.kind, r.k): r for r in quantiles.quantiles(df, ["kind", "k"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for key, vs in groups.items():
        ordered = np.sort(vs)
        for name, share in SHARES.items():
            at = (len(vs) - 1) * share
            low = int(at)
            want = ordered[low] + (ordered[min(low + 1, len(vs) - 1)] - ordered[low]) * (at - low)
            assert math.isclose(got[key][name], want, rel_tol=1e-12, abs_tol=1e-320), (key, name)


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (10,)], "low long")
    assert quantiles.quantiles(df, [], "low", {"m": 0.5}).first().m == 2.5
    assert quantiles.quantiles(df.limit(0), [], "low", {"m": 0.5}).count() == 0
    assert quantiles.quantiles(df.selectExpr("low", "1 AS g").limit(0), ["g"], "low", {"m": 0.5}).count() == 0


def test_loops_by_hand(spark):
    second = 44100
    rows = [(100 * second, 40 * second, 1), (60 * second, 5 * second, 1), (20 * second, 0, 0), (second, 0, None), (30 * second, second // 4, 1), (200 * second, 130 * second, 9), (None, None, 1)]
    got = {r.measure: r.value for r in report.loop_report(spark.createDataFrame(rows, "total_samples long, loop_samples long, loop long")).collect()}
    assert got["looping"] == 3 and got["plain"] == 1
    assert (got["total_median"], got["total_max"], got["body_mean"], got["intro_median"]) == (100.0, 200.0, 175 / 3, 60.0)
    assert (got["repeats_median"], got["wasted_max"], got["one_pass_mean"], got["tokens_mean"], got["fits"]) == (1.0, 0.0, 120.0, 72_000.0, 0.0)
    assert {k: v for k, v in got.items() if k.startswith("body ")} == {"body <10s": 1.0, "body <60s": 1.0, "body >120s": 1.0}
    none = {r.measure: r.value for r in report.loop_report(spark.createDataFrame([(20 * second, 0, 0)], "total_samples long, loop_samples long, loop long")).collect()}
    assert none["looping"] == 0 and none["plain"] == 1 and none["total_mean"] is None and "total_median" not in none
