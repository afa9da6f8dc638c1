"""Which run continues which, by strips, against plain loops over all pairs of a page."""

import random

import numpy as np

from quirespark.operators import chains
from quirespark.operators import grouping as G


def plain(runs, among, page, banned):
    parent = {}
    for a in range(len(page)):
        could = [b for b in range(len(page)) if page[a] == page[b] and (runs["x0"][b], runs["seq"][b]) < (runs["x0"][a], runs["seq"][a]) and among(np.array([a]), np.array([b]))[0] and (a, runs["seq"][b]) not in banned]
        if could:
            parent[a] = min(could, key=lambda b: (abs(runs["y0"][a] - runs["y0"][b]), -runs["x1"][b], runs["seq"][b]))
    out = []
    for a in range(len(page)):
        while a in parent:
            a = parent[a]
        out.append(a)
    return out


def test_chains_are_those_of_all_pairs(monkeypatch):
    monkeypatch.setattr(chains, "PAIRS", 40)
    for seed in range(120):
        rnd = random.Random(seed)
        n = rnd.randint(1, 60)
        page = np.sort(np.array([rnd.randint(0, 2) for _ in range(n)]))
        page = np.unique(page, return_inverse=True)[1]
        x0 = np.array([rnd.randint(0, 40) * 5.0 for _ in range(n)])
        runs = {
            "seq": np.array(rnd.sample(range(200), n)), "x0": x0, "x1": x0 + [rnd.choice([0, 10, 30, 400]) for _ in range(n)], "y0": np.array([rnd.randint(-40, 40) * 1.5 for _ in range(n)]), "size": np.array([rnd.choice([4.0, 6.0, 10.0, 36.0]) for _ in range(n)]),
            "_rule": np.array([rnd.random() < 0.2 for _ in range(n)]), "_short": np.array([rnd.random() < 0.5 for _ in range(n)]),
        }
        banned = {(rnd.randrange(n), int(rnd.choice(runs["seq"]))) for _ in range(rnd.choice([0, 30]))}
        given = (np.array([a for a, _ in banned], np.int64), np.array([s for _, s in banned], np.int64)) if banned else None
        assert chains.heads(page, runs, G.continues(runs), G.RAISED_HIGH, G.JOIN_GAP, given).tolist() == plain(runs, G.continues(runs), page, banned), seed


def test_runs_are_dealt_once_and_not_to_tiles(spark):
    """What a run of a page is dealt by: an exchange by page, and no pairs of tiles."""
    runs = spark.createDataFrame([(1, 0, k, "ab", 10.0 * k, 0.0, 10.0 * k + 8, 10.0, 10.0) for k in range(50)], "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    found = G.chained(runs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    assert {r.line for r in found.collect()} == {0}
