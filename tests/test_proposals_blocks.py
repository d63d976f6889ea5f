from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.operators import blocks as B
from gyrolake.operators import experiments as X
from gyrolake.operators import motions as M
from gyrolake.operators import particle_filter as P
from gyrolake.operators import proposals as N
from gyrolake.operators import training as T
from tests.test_experiments import known_of


def test_named_blocks():
    assert B.resolved("global", 5) == ((0, 1, 2, 3, 4),) and B.resolved("joint", 3) == ((0,), (1,), (2,))
    assert B.resolved("contiguous", 6) == B.resolved("auto", 6) == ((0, 1, 2, 3), (4, 5)) and B.resolved("auto", 23) == B.SMPL_BODY
    assert sorted(j for b in B.checked("smpl_body", 23) for j in b) == list(range(23))
    for wrong, joints, why in (("smpl_body", 21, "23 joints"), ("limb", 3, "unknown blocks"), (((0,), ()), 1, "block 1 is empty"), (((0, 3),), 2, "joint 3 is none"), (((0, 1), (1,)), 2, "in two blocks"), (((0,),), 2, "joint 1 is in no block")):
        with pytest.raises(ValueError, match=why):
            B.checked(wrong, joints)


def test_block_tables(spark):
    good = B.block_table(spark, B.SMPL_BODY, 23)
    assert good.count() == 23 and B.problems(good, 23).count() == 0
    assert {frozenset(b) for b in B.of_table(good.repartition(4), 23)} == {frozenset(b) for b in B.SMPL_BODY}
    bad = B.block_table(spark, ((0, 1), (), (1, 7)), 4)
    assert sorted(map(tuple, B.problems(bad, 4).collect()), key=str) == sorted([("empty block", 1, None), ("unknown joint", 2, 7), ("doubled joint", None, 1), ("uncovered joint", None, 2), ("uncovered joint", None, 3)], key=str)
    with pytest.raises(ValueError):
        B.of_table(bad, 4)


def test_order_of_blocks_and_joints_is_free():
    """The same partition written in another order weighs the same joints together."""
    rng = np.random.default_rng(3)
    seen, mask, c = K.exp(rng.normal(0, 0.5, (4, 3))), np.ones(4, bool), np.ones(4)
    o = P.Options(particles=30, blocks=((0, 2), (1, 3)))
    _, a, *_ = P.step(None, seen, mask, c, 0, 5, o)
    state, b, *_ = P.step(None, seen, mask, c, 0, 5, replace(o, blocks=((3, 1), (2, 0))))
    assert np.allclose(a, b) and state["lw"].shape == (2, 30)
    _, whole, *_ = P.step(None, seen, mask, c, 0, 5, replace(o, blocks="global"))
    assert not np.allclose(a, whole)


@pytest.fixture(scope="module")
def drawn(spark):
    poses = known_of(spark, n=6, frames=30, seed=4)
    train = X.drawn(poses.filter("seq < 4"), X.Grid((4.0, 15.0), (0.3,), (1, 2, 3, 4))).withColumn("sigma", F.radians("noise_deg")).withColumn("seq", F.col("key"))
    return poses, train.select("seq", "t", "joint", *[f"{p}{k}" for p in "ro" for k in range(9)], "mask", "confidence", "sigma").repartition(3).cache()


def test_examples_against_loops(drawn):
    model = M.Repeat(np.full((2, 3), 0.1))
    _, rows = drawn
    one = rows.filter("seq = 0").orderBy("t", "joint").toPandas()
    r, o = (one[[f"{p}{k}" for k in range(9)]].to_numpy().reshape(30, 2, 3, 3) for p in "ro")
    mask, sure, sigma = (one[c].to_numpy(float).reshape(30, 2) for c in ("mask", "confidence", "sigma"))
    want = []
    for t in range(1, 30):
        past = [r[None, k] for k in range(max(0, t - 3), t)]
        x = model.following(past)
        want.append((N.net_features(x, past, o[t], mask[t], sure[t], sigma[t], 2)[0], M.steps(x, r[None, t])[0].ravel()))
    got = N.net_examples(rows.filter("seq = 0"), model, 2).collect()
    assert len(got) == 29
    assert np.allclose(sorted(map(list, (g.x for g in got))), sorted(w[0].tolist() for w in want), atol=1e-9)
    assert np.allclose(sorted(map(list, (g.y for g in got))), sorted(w[1].tolist() for w in want), atol=1e-9)
    assert len(want[0][0]) == 6 + 6 + 2 + 2 + 2 + 2 * 6


def test_net_proposal_helps_on_other_sequences(drawn):
    """Held-out sequences that move, under particles that stand still without measurements' pull: with the net, errors at least halve."""
    poses, rows = drawn
    model = M.Motion(np.full((2, 3), 0.05))
    net, losses = N.fit_proposal(rows, model, 2, T.Training(hidden=24, rounds=150, rate=0.02), noise=0.5)
    assert losses[-1] < 0.5 * losses[0]
    base = P.Options(particles=48, gain=0.0, model=model)
    known = poses.filter("seq >= 4").withColumn("sigma", F.lit(0.15))
    told = P.run_variants(known, [base, replace(base, corrector=net)]).join(known.select("seq", "t", "joint", *[f"r{k}" for k in range(9)]), ["seq", "t", "joint"]).toPandas()
    e, r = (told[[f"{p}{k}" for k in range(9)]].to_numpy().reshape(-1, 3, 3) for p in "er")
    told["error"] = np.degrees(K.angle(e, r))
    alone, corrected = told.groupby("variant").error.mean()
    assert corrected < 0.5 * alone


def test_corrections_are_shortened():
    net = N.NetProposal(np.full((2, 3), 0.1), np.stack([np.zeros(18), np.ones(18)]), np.stack([np.full(6, 5.0), np.ones(6)]), np.zeros((18, 3)), np.zeros(3), np.zeros((3, 6)), np.zeros(6), 0, 1.0, 0.2)
    x = np.tile(np.eye(3), (7, 2, 1, 1))
    out = net.corrected(x, [x], x[0], np.ones(2, bool), np.ones(2), np.ones(2), np.random.default_rng(0))
    assert np.allclose(np.linalg.norm(K.log(out), axis=-1), 0.2)
