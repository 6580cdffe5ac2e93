"""Lineups, combinations and round robins against listing all of them."""

from collections import defaultdict
from itertools import combinations
from math import prod

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selections, valuation

SLOTS = [
    [(("QB",), 1), (("RB",), 2), (("RB", "WR"), 1), (("QB", "RB", "WR", "TE"), 1)],
    [(("QB", "RB"), 1), (("RB", "WR"), 1), (("WR", "TE"), 1), (("QB", "TE"), 1)],
    [(("RB",), 1), (("RB", "WR", "TE"), 1), (("WR", "TE"), 2)],
]


def best(players: list[tuple], slots: list) -> float:
    """The largest sum over every choice of a player, or none, for each slot."""
    places = [eligible for eligible, n in slots for _ in range(n)]
    found = (-1, 0.0)

    def fill(i: int, used: frozenset, n: int, total: float) -> None:
        nonlocal found
        if i == len(places):
            found = max(found, (n, total))
            return
        fill(i + 1, used, n, total)
        for pid, position, points in players:
            if position in places[i] and pid not in used:
                fill(i + 1, used | {pid}, n + 1, total + points)

    fill(0, frozenset(), 0, 0.0)
    return found


@pytest.mark.parametrize("slots", SLOTS)
def test_lineups_are_optimal(spark, slots):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(14):
        for pid in range(int(rng.integers(1, 8))):
            rows.append((group, pid, ["QB", "RB", "WR", "TE", "K"][int(rng.integers(5))], float(rng.integers(-3, 30))))
    rows += [(20, 1, "K", 9.0), (21, 1, "RB", None), (21, 2, None, 5.0)]
    found = defaultdict(list)
    for r in valuation.lineups(spark.createDataFrame(rows, "g int, pid int, pos string, points double"), ["g"], "pos", "points", "pid", slots).collect():
        found[r["g"]].append(r["points"])
    for group in range(14):
        n, total = best([r[1:] for r in rows if r[0] == group and r[2] != "K"], slots)
        assert (len(found[group]), sum(found[group])) == (n, pytest.approx(total))
    assert not found[20] and not found[21]


@pytest.mark.parametrize("support", [1, 3])
def test_combinations_up_to_a_size(spark, support):
    rng = np.random.default_rng(4)
    hits = [(int(g), f"s{i}", int(t)) for g in range(3) for i in range(6) for t in rng.choice(64, 20)]
    found = {(r["g"], tuple(r["items"])): (r["size"], r["together"]) for r in selections.combinations(spark.createDataFrame([*hits, (0, None, 5)], "g int, item string, at int"), ["g"], "item", "at", 4, support).collect()}
    at = defaultdict(set)
    for g, item, t in hits:
        at[(g, item)].add(t)
    want = {}
    for g in range(3):
        for size in (2, 3, 4):
            for items in combinations([f"s{i}" for i in range(6)], size):
                together = len(set.intersection(*(at[(g, i)] for i in items)))
                if together >= support:
                    want[(g, items)] = (size, together)
    assert found == want
    none = selections.combinations(spark.createDataFrame([], "g int, item string, at int"), ["g"], "item", "at", 4, support)
    assert none.count() == 0


def test_round_robins_and_exposures(spark):
    rng = np.random.default_rng(5)
    states, rows = ["WON", "LOST", "PUSH", None], []
    for wager in range(30):
        for leg in range(int(rng.integers(1, 8))):
            rows.append((wager, leg, states[int(rng.choice(4, p=[0.6, 0.1, 0.2, 0.1]))], 1 + int(rng.integers(1, 50)) / 16))
    legs = spark.createDataFrame(rows, "wager int, leg int, state string, odds double")
    got = {(r["wager"], r["size"]): (r["parlays"], r["potential"], r["returned"]) for r in selections.round_robins(legs, "wager", "state", "odds", (1, 2, 4)).collect()}
    own = defaultdict(list)
    for w, leg, s, o in rows:
        own[w].append((leg, o, {"WON": o, "PUSH": 1.0}.get(s, 0.0)))
    want, exposed = {}, defaultdict(lambda: [set(), 0, 0.0])
    for w, mine in own.items():
        for size in (1, 2, 4):
            chosen = list(combinations(mine, size))
            if chosen:
                want[(w, size)] = (len(chosen), sum(prod(o for _, o, _ in c) for c in chosen), sum(prod(p for *_, p in c) for c in chosen))
        for c in combinations(mine, 3):
            for leg, *_ in c:
                exposed[leg][0].add(w)
                exposed[leg][1] += 1
                exposed[leg][2] += prod(o for _, o, _ in c)
    assert got == want
    assert {r["leg"]: [r["wagers"], r["parlays"], r["potential"]] for r in selections.exposures(legs, "wager", "leg", "odds", 3).collect()} == {k: [len(a), b, pytest.approx(c)] for k, (a, b, c) in exposed.items()}


def test_odds_ranges(spark):
    odds = [None, -500, 99, 100, 399, 400, 999, 1_000, 9_999, 10_000, 50_000, 100_000, 150_000, 250_000, 500_000, 1_000_000]
    named = [r[0] for r in spark.createDataFrame([(o,) for o in odds], "o int").select(selections.odds_range(F.col("o"))).collect()]
    assert named[:5] == ["under_100"] * 3 + ["range_100_400"] * 2 and named[-1] == "over_1000000" and len(set(named)) == 11
