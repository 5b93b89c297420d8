"""Every registered query of the library against its SQL, and that the rest returns rows."""

from __future__ import annotations

import pytest

from strandline.plans import catalog

from .oracle import differences

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, sf_dir, name):
    assert differences(catalog.queries()[name](spark, sf_dir), SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", ["som_colors", "hmm_posteriors", "hmm_baum_welch", "train_sample"])
def test_returns_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["ali", "neff"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_repeat_penalty_whole_equals_brute_force(spark, sf_dir):
    import math

    from strandline.plans.inputs import PRIOR

    pp: dict = {}
    for r in catalog.queries()["ctx_posterior"](spark, sf_dir).collect():
        pp.setdefault(r.id, {}).setdefault(r.pos, {})[r.k] = r.pp
    want = {}
    for u, at in pp.items():
        for i, x in at.items():
            sums = [sum(p * y.get(k, 0.0) / PRIOR[k] for k, p in x.items() if p >= 0.02 and y.get(k, 0.0) >= 0.02) for j, y in at.items() if i != j and abs(i - j) <= 100]
            scores = [math.log2(s) for s in sums if s >= 1]
            if scores:
                want[u, i] = 2 ** (-0.1 * math.sqrt(sum(scores)))
    got = {(r.id, r.pos): r.scale for r in catalog.queries()["repeat_penalty_whole"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-4 for k, v in want.items())


@pytest.mark.parametrize("name", ["em_fit", "sgd_fit", "hmc_sample", "hmm_baum_welch"])
def test_fits_have_the_default_limits_and_other_rows_to_validate_on(spark, sf_dir, monkeypatch, name):
    import inspect

    from strandline.operators import hmm, learning

    owner, fit = (hmm, "baum_welch") if name == "hmm_baum_welch" else (learning, name.split("_")[0])
    shape, seen = inspect.signature(getattr(owner, fit)), {}

    class Seen(Exception):
        pass

    def spy(*args, **kwargs):
        seen.update(shape.bind(*args, **kwargs).arguments)
        raise Seen

    monkeypatch.setattr(owner, fit, spy)
    with pytest.raises(Seen):
        catalog.queries()[name](spark, sf_dir)
    assert not {"most", "tolerance"} & seen.keys()
    if name == "sgd_fit":
        assert seen["p"] == learning.SgdParams()
        users = [{r.id for r in seen[x].select("id").distinct().collect()} for x in ("train", "validate")]
        assert all(users) and not users[0] & users[1]
    elif name == "hmc_sample":
        assert seen["p"] == learning.HmcParams()


@pytest.mark.parametrize("name", ["kimura_distance", "kmer_distance", "repeat_penalty_whole"])
def test_only_results_leave_the_tasks_that_compare(spark, sf_dir, name):
    """Pairs of cells, k-mers or positions grow with the square of the input: none is shuffled."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("InArrow")[0]
    assert "InArrow" in plan and "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("name", ["kimura_distance", "kmer_distance", "repeat_penalty_whole"])
def test_blocks_and_stretches_miss_nothing(spark, sf_dir, monkeypatch, name):
    from strandline.operators import sequences

    monkeypatch.setattr(sequences, "SIDE", 4)
    monkeypatch.setattr(sequences, "BLOCKS", 3)
    monkeypatch.setattr(sequences, "STRETCH", 16)
    assert differences(catalog.queries()[name](spark, sf_dir), SQL[name], sf_dir) == []
