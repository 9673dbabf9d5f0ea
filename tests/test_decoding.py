"""Decoding against all labellings, and learning against a serial perceptron."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.decoding import UNITS, Weights, decoded, fit

ROLES = ("A", "B", "C")
BASE = Weights(roles=ROLES, allowed={"seg": ROLES, "date": ("C",), "open": ("A", "B")}, needs={"B": "b"})


def weights(r):
    value = lambda: round(r.uniform(-2, 2), 3)
    return Weights(
        ROLES, BASE.allowed, BASE.needs, {x: value() for x in ROLES}, {(f, x): value() for f in "abcd" for x in ROLES}, {x: value() for x in ROLES}, {(x, y): value() for x in ROLES for y in ROLES}
    )


def random_units(r, n):
    return [{"kind": r.choice(["seg", "seg", "date", "open"]), "feats": {f: r.choice([1.0, 0.5, 0.0]) for f in r.sample("abcde", r.randint(0, 4))}} for _ in range(n)]


def emission(w, u, role):
    if role not in w.allowed.get(u["kind"], ()) or role in w.needs and not u["feats"].get(w.needs[role]):
        return -np.inf
    return w.bias.get(role, 0.0) + sum(w.emission.get((f, role), 0.0) * v for f, v in u["feats"].items())


def total(w, units, path):
    score = w.start.get(path[0], 0.0) + sum(emission(w, u, x) for u, x in zip(units, path))
    return score + sum(w.transition.get(x, 0.0) for x in zip(path, path[1:]))


def best(w, units, allowed=None, margin=0.0, gold=None):
    def score(path):
        if allowed and any(a and x not in a for a, x in zip(allowed, path)):
            return -np.inf
        return total(w, units, path) + margin * sum(bool(g) and x not in g for g, x in zip(gold or [None] * len(path), path))

    found = max(itertools.product(w.roles, repeat=len(units)), key=score)
    return found if np.isfinite(score(found)) else None


def test_decoding_is_the_best_of_all_labellings(spark):
    r = random.Random(4)
    w = weights(r)
    rows = [(i, random_units(r, r.randint(1, 6))) for i in range(60)] + [(100, []), (101, None), (102, [{"kind": "unknown", "feats": {}}]), (103, [{"kind": "seg", "feats": None}])]
    table = spark.createDataFrame(rows, f"decoded_ long, units {UNITS}").repartition(3)
    got = {x.decoded_: x.decoded for x in decoded(table, "decoded_", "units", w).collect()}
    assert len(got) == len(rows) and got[100] == got[101] == [] and [d.role for d in got[102]] == [None]
    for i, units in rows[:60]:
        want = best(w, units)
        mine = tuple(d.role for d in got[i])
        assert (mine == (None,) * len(units)) if want is None else total(w, units, mine) == pytest.approx(total(w, units, want))
        if want is None:
            continue
        for at, d in enumerate(got[i]):
            swap = lambda x: total(w, units, mine[:at] + (x,) + mine[at + 1 :])
            others = [swap(x) for x in ROLES if x != mine[at] and np.isfinite(emission(w, units[at], x))]
            if others:
                assert d.margin == pytest.approx(swap(mine[at]) - max(others))


def test_a_long_text_and_many_short_ones(spark):
    w = weights(random.Random(1))
    table = spark.createDataFrame([(0, random_units(random.Random(2), 5000))], f"k long, units {UNITS}")
    (one,) = decoded(table, "k", "units", w).collect()
    assert len(one.decoded) == 5000


def _serial(rows, w, epochs, margin, shrink, cap, orders):
    """One shard: the same perceptron, weight by weight."""
    features = sorted({f for _, units, _ in rows for u in units for f in u["feats"]} | {f for f, _ in w.emission})
    keys = w.keys(features)
    now = dict(zip(keys, w.vector(features)))
    first, sums, steps, touched = dict(now), dict.fromkeys(keys, 0.0), 0, {k: set() for k in keys}
    for order in orders:
        for k in keys:
            sums[k] += now[k]
        steps += 1
        for name in order:
            _, units, gold = next(x for x in rows if x[0] == name)
            at = w.with_vector(features, np.array([now[k] for k in keys]))
            guess = best(at, units, margin=margin, gold=gold)
            if guess is not None and any(g and x not in g for g, x in zip(gold, guess)):
                want = best(at, units, allowed=gold)
                change = dict.fromkeys(keys, 0.0)
                for path, sign in ((want, 1.0), (guess, -1.0)) if want else ():
                    change[("start", path[0])] += sign
                    for x in zip(path, path[1:]):
                        change[("step", *x)] += sign
                    for u, x in zip(units, path):
                        change[("bias", x)] += sign
                        for f, v in u["feats"].items():
                            change[("emit", f, x)] += sign * v
                for k, v in change.items():
                    now[k] += v
                    if v:
                        touched[k].add(name)
            for k in keys:
                sums[k] += now[k]
            steps += 1
    moved = [np.clip((sums[k] / steps - first[k]) * len(touched[k]) / (len(touched[k]) + shrink), -cap, cap) for k in keys]
    return w.with_vector(features, np.array([first[k] for k in keys]) + np.array(moved)), features


def test_learning_equals_the_serial_perceptron(spark):
    r = random.Random(9)
    truth = weights(r)
    rows = []
    for i in range(25):
        units = random_units(r, r.randint(2, 4))
        path = best(truth, units)
        if path:
            rows.append((f"t{i}", units, [[x] if r.random() < 0.8 else None for x in path]))
    table = spark.createDataFrame(rows, f"k string, units {UNITS}, gold array<array<string>>").repartition(3)
    start = Weights(ROLES, BASE.allowed, BASE.needs)
    got = fit(table, "k", "units", "gold", start, epochs=2, shards=1, seed=7)
    orders = [[x.k for x in table.orderBy(F.xxhash64("k", F.lit(7 + e)), "k").collect()] for e in range(2)]
    want, features = _serial(rows, start, 2, 1.0, 10.0, 3.0, orders)
    assert got.vector(features) == pytest.approx(want.vector(features))


def test_mixing_learns_and_does_not_depend_on_partitions(spark):
    r = random.Random(12)
    truth = weights(r)
    rows = [(i, u, [[x] for x in p]) for i in range(160) if (p := best(truth, u := random_units(r, 4)))]
    table = spark.createDataFrame(rows, f"k long, units {UNITS}, gold array<array<string>>")
    start = Weights(ROLES, BASE.allowed, BASE.needs)
    got = fit(table.filter("k % 4 <> 0").repartition(5), "k", "units", "gold", start, shards=3, cap=20.0, shrink=1.0)
    again = fit(table.filter("k % 4 <> 0").coalesce(1), "k", "units", "gold", start, shards=3, cap=20.0, shrink=1.0)
    assert got.vector(list("abcde")) == pytest.approx(again.vector(list("abcde")))
    held = decoded(table.filter("k % 4 = 0"), "k", "units", got).join(table, "k").collect()
    right = [d.role == g[0] for x in held for d, g in zip(x.decoded, x.gold)]
    assert sum(right) / len(right) > 0.85


def test_nothing_to_learn_from(spark):
    start = Weights(ROLES, BASE.allowed, BASE.needs, {"A": 1.0})
    table = spark.createDataFrame([], f"k long, units {UNITS}, gold array<array<string>>")
    assert fit(table, "k", "units", "gold", start, epochs=1, shards=2) == start
