"""The toxicity classifier against slow restatements, and wrapper pages of odd size and number."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import toxicity, wrappers


def sample(seed, n=60):
    r = random.Random(seed)
    return [(int(r.random() < 0.4), np.array(sorted(r.sample(range(100, 112), r.randint(0, 5))) * r.randint(1, 2), "<u4").tobytes()) for _ in range(n)]


def risk(rows, prior, w, b):
    """prior * R_p(+), and the corrected negative risk R_u(-) - prior * R_p(-), with the sigmoid loss."""
    p = {1: [], 0: []}
    for y, xs in rows:
        p[y].append(1 / (1 + math.exp(-(b + sum(w.get(x, 0.0) for x in xs)))))
    mean = lambda v: sum(v) / len(v)
    return prior * mean([1 - x for x in p[1]]), mean(p[0]) - prior * mean(p[1])


def slow_fit(samples, prior, steps, rate=0.1, l2=2e-5):
    """Adam on gradients that are differences of the risk."""
    rows = [(y, set(np.frombuffer(x, "<u4").tolist())) for y, x in samples]
    names = sorted(set().union(*(x for _, x in rows)))
    w, b = dict.fromkeys(names, 0.0), math.log((prior + 1e-3) / (1 - prior + 1e-3))
    m, v, e = dict.fromkeys([*names, "b"], 0.0), dict.fromkeys([*names, "b"], 0.0), 1e-5
    turned = 0

    for step in range(1, steps + 1):
        negative = risk(rows, prior, w, b)[1]
        turned += negative < 0

        def target(w, b, negative=negative):
            pos, neg = risk(rows, prior, w, b)
            return pos + neg if negative >= 0 else -neg

        grads = {x: (target(w | {x: w[x] + e}, b) - target(w | {x: w[x] - e}, b)) / (2 * e) + l2 * w[x] for x in names}
        grads["b"] = (target(w, b + e) - target(w, b - e)) / (2 * e)
        for x, g in grads.items():
            m[x], v[x] = 0.9 * m[x] + 0.1 * g, 0.999 * v[x] + 0.001 * g * g
            move = rate * (m[x] / (1 - 0.9**step)) / (math.sqrt(v[x] / (1 - 0.999**step)) + 1e-8) * (1 - step / (steps + 1))
            if x == "b":
                b -= move
            else:
                w[x] -= move
    return b, w, turned


def test_gradient_is_the_risks():
    """One step's direction and size, of the risk and, where its corrected part is negative, of the turned one."""
    turned = []
    for seed, prior, steps, mark in ((0, 0.3, 12, False), (1, 0.1, 12, False), (2, 0.6, 40, True), (3, 0.8, 40, True)):
        own = [(y, x + (np.uint32(500 + (not y)).tobytes() if mark else b"")) for y, x in sample(seed, 30)]
        bias, weights = toxicity.fit(own, prior, steps=steps)
        slow_b, slow_w, n = slow_fit(own, prior, steps)
        turned.append(n)
        assert bias == pytest.approx(slow_b, abs=2e-3)
        assert all(weights.get(x, 0.0) == pytest.approx(value, abs=2e-3) for x, value in slow_w.items())
    assert min(turned) == 0 and max(turned) > 0


def test_one_class_is_the_prior():
    assert toxicity.fit([], 0.2)[1] == {} and toxicity.fit([(1, b"")], 0.2) == toxicity.fit([(0, b"")], 0.2)


def test_chosen_features_are_a_plain_count():
    r = random.Random(9)
    known, n_p, n_u, prior = np.arange(40, dtype=np.uint32), 50, 400, 0.2
    u, p = [r.randint(0, 60) for _ in known], [r.choice([0, 2, 3, r.randint(3, 50)]) for _ in known]
    want = []
    for k, a, b in zip(known.tolist(), u, p):
        of_p, of_u = b / n_p, a / n_u
        of_n = max((of_u - prior * of_p) / (1 - prior), 0.5 / n_u)
        stands_out = (of_p - of_n) / math.sqrt(of_p * (1 - of_p) / n_p + of_n / n_u + 1e-12)
        if b >= toxicity.LEAST and of_p >= 3 * of_n and stands_out > 2:
            want.append(k)
    got = toxicity.chosen(known, np.array([u, p], float), prior, n_p, n_u).tolist()
    assert got == want and 0 < len(want) < 40


def test_scores_are_a_plain_sum(spark):
    model = (-1.5, {h: 0.01 * (i - 3) for i, h in enumerate(toxicity.features("zonkhead") + toxicity.features("vile"))})
    texts = [None, "", "vile", "Vile zonkhead, VILE!", "nothing", "zonkheads zonk", "vile " * 50_000 + "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", toxicity.scorer(model)(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        z = model[0] + sum(model[1].get(h, 0.0) for w in toxicity.words(t) for h in toxicity.features(w))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_long_and_tied_pages(spark):
    """A very long page among short ones of its layout, and ids that several pages of one layout share."""
    page = lambda body: f"<div class='top'><p>Site name</p></div><div class='text'>{body}</div><div><p>All rights kept</p></div>"
    told = {i: f"Story {i} of ours {i * i}" for i in range(12)}
    rows = [(i // 3, f"http://a.example/{i}", page(f"<p>{t}</p>")) for i, t in told.items()]
    paras = [f"Part {i} of a very long story, number {i * 7}" for i in range(4000)]
    rows.append((99, "http://a.example/long", page("".join(f"<p>{p}</p>" for p in paras))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.url: r for r in wrappers.extract_text(df).collect()}
    assert len(got) == len(rows) and all(got[f"http://a.example/{i}"].text == t for i, t in told.items())
    assert got["http://a.example/long"].text == "\n".join(paras) and got["http://a.example/long"].page_id == 99
