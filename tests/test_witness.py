import datetime as dt
import math

import numpy as np
import pytest

from varve.operators import flags, graph, report, verdict, witness

SCHEMA = "doc_id bigint, source_id string, operator string, kind string, observed_at timestamp, reliability double, forgeability double, field string, repo_created_at timestamp"


def at(year, month=1, day=1):
    return dt.datetime(year, month, day)


def rows(spark, *items):
    return spark.createDataFrame([(d, o, o, k, t, r, f, None, None) for d, o, k, t, r, f in items], SCHEMA)


def brute(items, alpha):
    items = [x for x in items if x[2] != "self_asserted"]
    for t in sorted({x[3] for x in items}):
        groups = {}
        for x in items:
            if x[3] <= t:
                groups.setdefault(x[1], []).append(x)
        p = 1.0
        for g in groups.values():
            f = min(x[5] for x in g)
            p *= min(1.0, f + (1 - f) * math.prod(max(1e-9, 1 - x[4]) for x in g))
        if p <= alpha * (1 + 1e-12):
            return t, -math.log(p), len(groups)
    return None


def test_one_capture_clears_the_default_budget(spark):
    b = witness.consensus(rows(spark, (1, "ia", "snapshot", at(2006), 0.995, 1e-3))).first()
    assert b.not_after == at(2006) and b.independent_operators == 1 and round(b.forgery_logodds, 2) == 5.12


def test_self_assertion_is_no_evidence(spark):
    b = witness.consensus(rows(spark, (1, "author", "self_asserted", at(1999), 0.9, 1e-9))).first()
    assert b.not_after is None and b.method == "no-independent-evidence" and b.forgery_logodds == 0


def test_weak_evidence_is_reported_as_such(spark):
    b = witness.consensus(rows(spark, (1, "git", "commit", at(2010), 0.9, 0.5), (1, "git", "commit", at(2012), 0.9, 0.5))).first()
    assert b.not_after == at(2012) and b.method == "best-effort-below-alpha"


def test_bounds_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(int(d), f"op{rng.integers(4)}", ("snapshot", "commit", "self_asserted")[rng.integers(3)], at(2000 + int(rng.integers(9))), float(0.5 + rng.integers(5) / 10), float(10.0 ** -rng.integers(1, 4))) for d in range(40) for _ in range(rng.integers(1, 9))]
    got = {r.doc_id: r for r in witness.consensus(rows(spark, *items)).collect()}
    for d in range(40):
        mine = [x for x in items if x[0] == d]
        want = brute(mine, 1e-2)
        if want:
            assert (got[d].not_after, got[d].independent_operators) == (want[0], want[2]) and abs(got[d].forgery_logodds - want[1]) < 1e-9
        else:
            assert got[d].method != "weighted-order-statistic"


def test_dedupe_keeps_the_first_of_a_day(spark):
    w = rows(spark, (1, "ia", "snapshot", dt.datetime(2010, 1, 1, 9), 0.9, 0.1), (1, "ia", "snapshot", dt.datetime(2010, 1, 1, 7), 0.8, 0.1), (1, "ia", "snapshot", at(2010, 1, 2), 0.9, 0.1))
    assert sorted(r.observed_at for r in witness.dedupe(w).collect()) == [dt.datetime(2010, 1, 1, 7), at(2010, 1, 2)]


def test_probabilities_outside_the_unit_interval_fail(spark):
    with pytest.raises(Exception, match="not a witness"):
        witness.validate(rows(spark, (1, "ia", "snapshot", at(2010), 1.5, 0.1))).collect()


def test_flags(spark):
    w = rows(spark, (1, "ia", "snapshot", at(2015), 0.995, 1e-3), (2, "ia", "snapshot", at(2010), 0.995, 1e-3), (2, "cc", "snapshot", at(2014), 0.99, 1e-3))
    t = spark.createDataFrame([(1, at(2010), {"a": 0.9}), (2, at(2012), {}), (3, at(2010), {"a": 0.9, "b": 0.01})], "doc_id bigint, claimed timestamp, coverage map<string,double>")
    got = flags.detect(t, w, witness.consensus(w), at(2026)).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(1, "backdate"), (1, "single_operator"), (2, "operator_disagreement"), (2, "postdate"), (2, "single_operator"), (3, "backdate")]
    late = next(r for r in got if (r.doc_id, r.kind) == (1, "backdate"))
    assert abs(late.log_lr - (-math.log(0.1) + min(1, 1826 / 3650))) < 1e-9 and list(late.sources) == ["a"]


def test_interval_golden_values():
    lo, hi = verdict.beta_interval(np.array([0.99333]), np.array([5.117]))
    assert abs(lo[0] - 0.8218) < 2e-3 and abs(hi[0] - 0.9958) < 2e-3


def test_no_evidence_is_the_base_rate_and_abstains(spark):
    empty = spark.createDataFrame([(9, None, 0.0, 0)], "doc_id bigint, not_after timestamp, forgery_logodds double, independent_operators int")
    v = verdict.verdicts(empty).first()
    assert abs(v.human_origin_p - 0.55) < 1e-9 and v.abstained and v.status == "abstained"


def test_an_older_ancestor_replaces_the_bound(spark):
    bound = spark.createDataFrame([(1, at(2024), 5.0, 1)], "doc_id bigint, not_after timestamp, forgery_logodds double, independent_operators int")
    old = spark.createDataFrame([(1, at(2015), 0.99)], "doc_id bigint, witness_time timestamp, confidence double")
    plain, with_old = verdict.verdicts(bound).first(), verdict.verdicts(bound, ancestors=old).first()
    assert with_old.human_origin_p > plain.human_origin_p and with_old.not_after == at(2015)


def scored(spark, ps):
    return spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "doc_id bigint, human_origin_p double")


def test_subset_is_of_maximum_size(spark):
    rng = np.random.default_rng(1)
    ps = [round(float(p), 2) for p in rng.uniform(0.7, 1, 50)]
    for x in (0.01, 0.05, 0.2):
        best = max((k for k in range(1, 51) if sum(1 - p - x for p in sorted(ps, reverse=True)[:k]) <= 1e-12), default=0)
        plan = report.subset_curve(scored(spark, ps), (x,)).first()
        assert plan.n_selected == best and report.subset(scored(spark, ps), x).count() == best


def test_propagation_on_a_chain_and_a_cycle(spark):
    s = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.9), (4, 0.95), (5, 0.95)], "doc_id bigint, p double")
    e = spark.createDataFrame([(1, 2, "derived", 1.0), (2, 3, "derived", 1.0), (4, 5, "cites", 1.0), (5, 4, "cites", 1.0), (9, 1, "derived", 1.0)], "src bigint, dst bigint, kind string, weight double")
    got = {r.doc_id: r.p for r in graph.propagate(s, e).collect()}
    assert abs(got[2] - (1 - 0.92 * 0.8)) < 1e-6 and abs(got[3] - (1 - 0.92**2 * 0.8)) < 1e-6 and got[4] == got[5] == 0.95 and abs(got[1] - 0.2) < 1e-12
