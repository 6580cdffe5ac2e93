"""Playoff fields against a walk through the rules, stage by stage."""

import numpy as np
import pytest

from tidemark.operators.standings import PlayoffRules, playoff_field

SHAPE = "season int, team int, division int, wins int, losses int, ties int, ap_wins int, ap_losses int, ap_ties int, points_for double"
RULES = [
    PlayoffRules(6, 2), PlayoffRules(6, 2, "division_winners", "all_play", "points", True, 1), PlayoffRules(4, 0, at_large_by="all_play"), PlayoffRules(5, 1, "league", "all_play", "points", True, 0), PlayoffRules(20, 2, record_berths=3),
]


def walk(teams, rules):
    share = lambda t: (t[6] + t[8] / 2) / max(1, t[6] + t[7] + t[8])
    keys = {"record": lambda t: (-t[3], t[4], -t[5], -share(t), -t[9], t[1]), "all_play": lambda t: (-share(t), -t[9], t[1]), "points": lambda t: (-t[9], -share(t), t[1])}
    ladder = sorted(teams, key=keys["record"])
    winners = [t for i, t in enumerate(ladder) if t[2] not in {o[2] for o in ladder[:i]}]
    byes = sorted(winners if rules.bye_pool == "division_winners" else ladder, key=keys[rules.bye_by])[: rules.byes]
    berth = {t[1]: "bye" for t in byes}
    for name, pool, most in (("division", winners if rules.division_berths else [], rules.teams), ("record", ladder, rules.record_berths), ("at_large", sorted(teams, key=keys[rules.at_large_by]), rules.teams)):
        for t in [t for t in pool if t[1] not in berth][: min(most, rules.teams - len(berth))]:
            berth[t[1]] = name
    order = byes + [t for t in ladder if berth.get(t[1]) not in (None, "bye")] + [t for t in ladder if t[1] not in berth]
    return {t[1]: (t in winners, berth.get(t[1]), i + 1) for i, t in enumerate(order)}


@pytest.mark.parametrize("rules", RULES)
def test_playoff_fields(spark, rules):
    rng = np.random.default_rng(7)
    rows = [(s, t, t % 4, int(w := rng.integers(0, 6)), 5 - int(w), int(rng.integers(0, 2)), int(rng.integers(0, 20)), int(rng.integers(0, 20)), int(rng.integers(0, 3)), float(rng.integers(0, 6))) for s in range(4) for t in range(12)]
    rows.append((9, 1, 0, 0, 0, 0, 0, 0, 0, 0.0))
    got = playoff_field(spark.createDataFrame(rows, SHAPE), ["season"], "division", "team", rules).collect()
    for season in {r[0] for r in rows}:
        want = walk([r for r in rows if r[0] == season], rules)
        assert {r["team"]: (r["division_winner"], r["berth"], r["seed"]) for r in got if r["season"] == season} == want


def test_rules_that_do_not_fit():
    for bad in ({"teams": 0, "byes": 0}, {"teams": 4, "byes": 5}, {"teams": 4, "byes": 2, "record_berths": 3}, {"teams": 4, "byes": 1, "bye_pool": "none"}):
        with pytest.raises(ValueError):
            PlayoffRules(**bad)
