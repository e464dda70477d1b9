"""H1-H3: the sampler, its densities and its studies."""
import json

import numpy as np

from fraudlens.operators import search


def hill(p):
    return -(np.log10(p["learning_rate"]) + 1.2) ** 2 - ((p["max_depth"] - 7) / 4) ** 2 - (p["subsample"] - 0.8) ** 2


def study(n, seed, model=True):
    tried = []
    for i in range(n):
        p = search.next_params("gbt", tried, seed) if model else search.sample_params("gbt", n, seed)[i]
        tried.append((p, hill(p)))
    return tried


def test_sampler_is_seeded_starts_randomly_and_beats_random_draws():
    a, b = study(60, 1), study(60, 1)
    assert a == b
    assert [p for p, _ in a[:search.STARTUP]] == search.sample_params("gbt", search.STARTUP, 1)
    best = [[max(s for _, s in study(60, seed, model)) for seed in range(8)] for model in (True, False)]
    assert np.mean(best[0]) > np.mean(best[1]) and sum(x > y for x, y in zip(*best)) >= 6


def test_draws_stay_in_their_space_and_conditions_hold():
    for space in search.SPACES:
        tried = []
        for i in range(30):
            p = search.next_params(space, tried, 5)
            tried.append((p, float(np.sin(3 * i))))
        for p, _ in tried:
            for k, s in search.SPACES[space].items():
                if k in ("n_layers", "n_units"):
                    continue
                assert p[k] in s[1] if s[0] == "cat" else s[1] <= p[k] <= s[2]
            if space == "svm":
                assert ("coef0" in p) == (p["kernel"] == "poly")
            if space == "lr":
                assert ("solver" in p) == (p["penalty"] == "l2")
            if space == "mlp":
                assert 1 <= len(p["hidden"]) <= 3 and all(32 <= u <= 256 for u in p["hidden"])


def test_density_follows_what_was_seen():
    near = search._Parzen(("float", 0.0, 1.0), [0.2, 0.21, 0.22])
    assert near.log_density(0.21) > near.log_density(0.8)
    grid = np.linspace(0.0005, 0.9995, 1000)
    assert abs(np.exp([near.log_density(x) for x in grid]).mean() - 1.0) < 0.01
    cat = search._Parzen(("cat", [None, "a"]), ["a", "a"])
    assert cat.log_density("a") > cat.log_density(None)


def test_study_of_more_trials_than_the_start(spark):
    t = search.run_study(spark, "gbt", hill, 14, seed=2, parallelism=4).orderBy("trial").collect()
    assert [r.trial for r in t] == list(range(14)) and {r.status for r in t} == {"ok"}
    again = [(json.loads(r.params), r.score) for r in t]
    assert json.loads(t[12].params) == search.next_params("gbt", again[:12], 2)
