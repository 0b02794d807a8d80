"""The numeric vote: against a plain version, and the work of one claim."""

import random

from tomelight.operators import consensus as C


def plain(claims, tolerance):
    clusters = []
    for w, p, v in sorted((-C.WEIGHTS[p], p, v) for p, v in claims):
        k = next((k for k in clusters if abs(k[0][2] - v) / max(abs(k[0][2]), abs(v), 1) <= tolerance), None)
        (k if k is not None else clusters.append([]) or clusters[-1]).append((w, p, v))
    best = min(clusters, key=lambda k: (round(sum(w for w, *_ in k), 9), -len(k), k[0][2]))
    return best[0][2], len(best)


def test_numeric_vote_against_a_plain_one(spark):
    r = random.Random(3)
    claims = [(e, r.choice(list(C.WEIGHTS)), float(r.randint(1, 50))) for e in range(40) for _ in range(r.randint(1, 30))]
    want = {e: plain([(p, v) for x, p, v in claims if x == e], 0.05) for e in {x for x, *_ in claims}}
    got = C.numeric_vote(spark.createDataFrame(claims, "entity int, provider string, value double"), 0.05).collect()
    assert {x.entity: (x.value, x.size) for x in got} == want


def test_a_claim_looks_for_its_cluster_once(spark):
    votes = C.numeric_vote(spark.createDataFrame([(1, "mal", 2.0)], "entity int, provider string, value double"), 0.05)
    assert votes._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1
