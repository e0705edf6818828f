from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.functions import attention as A
from corpusloom.functions import lanes
from corpusloom.functions import online as O
from corpusloom.functions.ppm import Ppm
from corpusloom.operators import online_models
from corpusloom.operators.online_models import user_bits


def test_history_table_is_closed_and_small():
    states, nexts = O.history_table()
    assert states[0] == (0, 0) and len(states) == len(nexts) < 600
    assert all(0 <= t < len(states) for row in nexts for t in row)
    s = 0
    for _ in range(100):
        s = nexts[s][1]
    assert states[s][1] == 40 and states[s][0] == 0
    s = nexts[s][0]
    assert states[s] == (1, 21)


def test_maps_learn_what_repeats():
    m, r, s = O.HistoryMap(), O.RunHistory(), O.StationaryMap()
    for _ in range(200):
        for ctx in (1, 2):
            m.learn(ctx, ctx - 1)
            s.learn(ctx, ctx - 1)
            r.learn(ctx, 7)
    assert m.predict(1) < 0.1 < 0.9 < m.predict(2) and s.predict(1) < 0.01 and s.predict(2) > 0.99
    assert r.predict(1)[0] == 7 and r.predict(1)[1] > 0.9 and r.predict(9) == (None, 0.0)


def test_mixer_gradient_and_shared_row():
    m = O.Mixer(3, most=2)
    x = np.array([1.0, -2.0, 0.5])
    w = m.row(5).copy()
    p = m.predict(x, 5)
    m.learn(x, 1, 5)
    assert np.allclose(m.row(5) - w, 0.02 * (1 - p) * x)
    assert m.row(6) is m.rows[0] and len(m.rows) == 2
    layered = O.Layered(2, 2)
    for k in range(800):
        bit = k % 2
        layered.predict(np.array([2.0 if bit else -2.0, 0.3]), [0, k % 3])
        layered.learn(bit)
    assert layered.predict(np.array([2.0, 0.3]), [0, 0]) > 0.9


def test_refiner_and_specialist():
    r = O.Refiner()
    assert abs(r.predict(0.3) - 0.3) < 0.01
    for _ in range(2000):
        r.learn(0.5, 1)
    assert r.predict(0.5) > 0.9 and abs(r.predict(0.01) - 0.01) < 0.02
    s = O.Specialist()
    for _ in range(5000):
        s.predict(0.5, 0.5, 3)
        s.learn(1, 0.5)
    assert O.stretch(s.predict(0.5, 0.5, 3)) <= 1.5 + 1e-9 and s.predict(0.5, 0.5, 3) > 0.8


def test_bytes_bits_and_vocabulary():
    p = np.zeros(256)
    p[[65, 66]] = 0.25, 0.75
    node, out = 1, 1.0
    for k in range(7, -1, -1):
        q = O.byte_to_bit(p, node & (1 << 7 - k) - 1, 7 - k)
        bit = 66 >> k & 1
        out *= q if bit else 1 - q
        node = node << 1 | bit
    assert abs(out - 0.75) < 1e-9
    assert O.within(p, np.arange(256) == 65)[65] == 1 and O.scattered(np.array([0.2, 0.8]), np.array([3, 9]))[9] == 0.8


def test_net_gradient_by_differences():
    net = O.Lstm(4, cells=3, horizon=100, seed=1)
    seq = [0, 2, 1, 3, 0, 1]

    def loss():
        net.h, net.c, net.past = np.zeros(3), np.zeros(3), []
        total = 0.0
        for a, b in zip(seq, seq[1:], strict=False):
            total -= np.log(net.predict(a)[b])
            net.learn(b)
        return total

    loss()
    grads = net.gradients(net.past)
    for name in ("gates", "out"):
        for at in [(0, 0), (1, 2), (2, 3)]:
            w = net.w[name]
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6
    net = O.Lstm(3, cells=8)
    bits = []
    for k in range(900):
        bits.append(-np.log2(net.predict(k % 3)[(k + 1) % 3]))
        net.learn((k + 1) % 3)
    assert np.mean(bits[-100:]) < 0.3


def test_user_bits_of_a_regular_user():
    types = ["a", "a", "b"] * 60
    bits = [0] + [int(x == y) for x, y in zip(types, types[1:], strict=False)]
    got = user_bits(types, bits)
    assert all(v < len(types) * 0.9 for v in got.values()) and got["corrected"] > 0
    assert user_bits([], []) == user_bits(["a"], [0]) == {"mixed": 0, "refined": 0, "corrected": 0, "net": 0}


def test_ppm_distributions_and_learning():
    rng = random.Random(3)
    m = Ppm(3, most=50)
    for _ in range(400):
        p = m.predict()
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
        m.learn(rng.choice(b"abc"))
        assert len(m.contexts) <= 50
    text = b"the cat sat on the mat. " * 30
    assert Ppm(4).bits(text) < 0.9 * len(text) < Ppm(0).bits(text)
    m = Ppm(1)
    for b in b"ababab":
        m.learn(b)
    assert m.predict().argmax() == ord("a")
    small = Ppm(2, limit=4)
    for _ in range(50):
        small.learn(7)
    assert max(small.contexts[b""].values()) <= 4


@pytest.mark.parametrize("n", [1, 5, 16, 40])
def test_delta_rule_in_chunks(n):
    rng = np.random.default_rng(n)
    q, k, v = rng.normal(size=(n, 4)), A.unit(rng.normal(size=(n, 4))), rng.normal(size=(n, 3))
    gate, beta = rng.uniform(0.7, 1, (n, 4)), rng.uniform(0, 1, n)
    assert np.allclose(A.delta_rule(q, k, v, gate, beta), A.delta_rule_in_chunks(q, k, v, gate, beta))


def test_attention_sees_its_window_only():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(9, 4)), [rng.normal(size=(4, 4)) for _ in range(3)]
    full = A.attention(x, *w, 3)
    y = x.copy()
    y[0] += 5
    assert np.allclose(A.attention(y, *w, 3)[3:], full[3:]) and not np.allclose(A.attention(y, *w, 3)[:3], full[:3])
    doc = np.array([0] * 4 + [1] * 5)
    assert np.allclose(A.attention(x, *w, 99, doc)[4], (x @ w[2])[4])
    assert np.allclose(np.linalg.norm(A.rotated(x), axis=1), np.linalg.norm(x, axis=1))
    taps = np.array([[0.0] * 4, [1.0] * 4])
    assert np.allclose(A.causal_convolution(x, taps), x / (1 + np.exp(-x)))
    b = {"q": w[0], "k": w[1], "v": w[2], "up": rng.normal(size=(4, 8)), "down": np.zeros((8, 4))}
    assert np.allclose(A.block(x, b, 3, 1.0, 1.0), x + A.attention(A.rms(x), *w, 3))


@pytest.mark.parametrize("options", [{}, {"most": 50}, {"order": 0}, {"order": 3, "limit": 5, "most": 40}])
def test_ppm_code_length_is_that_of_the_distributions(options):
    rng = random.Random(8)
    text = b"the cat sat on the mat. " * 8 + bytes(range(256)) + bytes(rng.choice(b"abc") for _ in range(300))
    fast, slow = Ppm(**options), Ppm(**options)
    fast.predict = None  # the whole distribution isn't asked for
    want = 0.0
    for b in text:
        want -= np.log2(slow.predict()[b])
        slow.learn(b)
    assert abs(fast.bits(text[:100]) + fast.bits(text[100:]) - want) < 1e-6
    assert (fast.contexts, fast.escape, fast.past) == (slow.contexts, slow.escape, slow.past)


def test_users_side_by_side_are_users_one_by_one(monkeypatch):
    rng = random.Random(5)
    lengths = [0, 1, 2, 3, 8, 9, 10, 17, 64, 65, 300, *(rng.randrange(20, 90) for _ in range(40))]
    types = [[rng.choice([None, "a", "b", "c", "d"][: 1 + k % 5]) for _ in range(n)] for k, n in enumerate(lengths)]
    types += [[t for t in x for _ in range(4)] for x in types[20:30]] + [[str(rng.randrange(90)) for _ in range(200)] for _ in range(3)]
    bits = [[int(k > 0 and t is not None and t == x[k - 1]) for k, t in enumerate(x)] for x in types]
    want = {k: (len(t), *(round(v, 4) for v in user_bits(t, b).values())) for k, (t, b) in enumerate(zip(types, bits, strict=True))}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(types)), pa.int64()), pa.array(types, pa.list_(pa.string())), pa.array(bits, pa.list_(pa.int32()))], names=["user_id", "types", "bits"])
    steps, one = [], lanes.LstmLanes.predict
    monkeypatch.setattr(lanes.LstmLanes, "predict", lambda net, symbol: steps.append(len(symbol)) or one(net, symbol))
    for waiting, at_once in ((1 << 21, 256), (500, 256), (1 << 21, 7)):
        monkeypatch.setattr(online_models, "WAITING", waiting)
        monkeypatch.setattr(lanes, "LANES", at_once)
        steps.clear()
        got = [r for b in online_models.users_side_by_side(iter([batch.slice(0, 30), batch.slice(30)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)
        assert sum(steps) == sum(max(0, len(t) - 1) for t in types)
        if (waiting, at_once) == (1 << 21, 256):  # a net's steps are those of its longest user, not of all events
            assert len(steps) < 0.3 * sum(steps)
    assert lanes.lanes_of(5) == 7 and lanes.lanes_of(1 << 20) == 1
