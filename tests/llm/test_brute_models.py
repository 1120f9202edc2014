"""Models and differencing against plain versions: loops, enumeration and numeric gradients."""

import itertools
import random

import numpy as np
import pytest


def plain_difference(sizes, k):
    """Partial partitions as lists of (sum, items), the two of widest spread joined in opposite order."""
    nodes = [(i, [(0, ())] * (k - 1) + [(s, (i,))]) for i, s in enumerate(sizes)]
    made = len(nodes)
    while len(nodes) > 1:
        nodes.sort(key=lambda x: (-(x[1][-1][0] - x[1][0][0]), x[0]))
        (_, a), (_, b) = nodes[:2]
        both = sorted(((p + q, x + y) for (p, x), (q, y) in zip(a, reversed(b))), key=lambda x: x[0])
        nodes = [*nodes[2:], (made, [(s - both[0][0], x) for s, x in both])]
        made += 1
    out = [0] * len(sizes)
    for part, (_, items) in enumerate(nodes[0][1]):
        for i in items:
            out[i] = part
    return out


@pytest.mark.parametrize("k", [2, 3, 5])
def test_difference_against_plain_differencing(k):
    from genoflux.llm.kk_shards import difference

    rng = random.Random(k)
    for n in range(1, 40):
        sizes = sorted((rng.randint(1, 30 if n % 2 else 10**6) for _ in range(n)), reverse=True)
        assert difference(sizes, k) == plain_difference(sizes, k)


def test_pooled_responses_against_plain_convolution():
    from genoflux.llm import language_id as L

    rng = np.random.default_rng(4)
    w = {"embed": rng.normal(size=(256, L.DIM))} | {f"conv{k}": rng.normal(size=(k * L.DIM, L.FILTERS)) for k in L.WIDTHS}
    x = rng.integers(0, 256, (19, L.WINDOW)).astype(np.uint8)
    x[3], x[4, 5:] = 0, 0
    got = L.ByteNet(["a"], {k: v.astype(np.float32) for k, v in w.items()}).pooled(x)
    for i, row in enumerate(x):
        want = [max(float(w["embed"][row[t : t + k]].reshape(-1) @ w[f"conv{k}"][:, f]) for t in range(L.PLACES)) for k in L.WIDTHS for f in range(L.FILTERS)]
        assert np.allclose(got[i], want, atol=1e-3)


def labelling_score(chain, feats, y):
    return sum(chain.emit[f][:, v].sum() for f, v in zip(feats, y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))


def test_best_labelling_against_enumeration():
    from genoflux.llm.html_crf import DIM, Chain

    rng = np.random.default_rng(6)
    for n in range(1, 9):
        for scale in (1, 1000):  # small whole scores often tie
            chain = Chain(rng.integers(-scale, scale + 1, (DIM, 2)).astype(float), rng.integers(-scale, scale + 1, (2, 2)).astype(float))
            feats = [rng.integers(0, DIM, 3).tolist() for _ in range(n)]
            scores = {y: labelling_score(chain, feats, y) for y in itertools.product((0, 1), repeat=n)}
            assert scores[tuple(chain.best(feats))] == max(scores.values())


def test_steps_of_training_against_a_numeric_gradient(monkeypatch):
    """Each step of Adagrad gives its gradient back; the second one is taken at weights other than 0."""
    from genoflux.llm import html_crf as H

    rng = np.random.default_rng(8)
    feats, y = [sorted(set(rng.integers(0, 12, 4).tolist())) for _ in range(6)], [0, 1, 1, 0, 1, 1]
    chains = [H.Chain(np.zeros((H.DIM, 2)), np.zeros((2, 2)))]
    for epochs in (1, 2):
        monkeypatch.setattr(H, "EPOCHS", epochs)
        chains.append(H.train([(feats, y)]))

    def loss(chain):
        z = np.logaddexp.reduce([labelling_score(chain, feats, p) for p in itertools.product((0, 1), repeat=len(y))])
        return (z - labelling_score(chain, feats, y)) / len(y)

    def gradient(chain, part, at):
        h, out = 1e-5, []
        for d in (h, -h):
            c = H.Chain(chain.emit.copy(), chain.move.copy())
            getattr(c, part)[at] += d
            out.append(loss(c))
        return (out[0] - out[1]) / (2 * h) + H.DECAY * getattr(chain, part)[at]

    used = sorted({x for f in feats for x in f})
    for part, rate, places in (("emit", 10 * H.RATE, [(u, v) for u in used for v in (0, 1)]), ("move", H.RATE, list(itertools.product((0, 1), repeat=2)))):
        for at in places:
            square = 1e-6
            for before, after in zip(chains, chains[1:]):
                g = gradient(before, part, at)
                square += g * g
                step = getattr(after, part)[at] - getattr(before, part)[at]
                assert abs(step + rate * g / square**0.5) < 1e-4 * rate
    assert not np.delete(chains[-1].emit, used, 0).any()


def test_forest_scores_against_a_walk_by_row():
    from genoflux.llm import secret_scan as S

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 6)), 1)
    y = (x[:, 0] + x[:, 3] > 0.3).astype(float)
    forest = S.train(x, y)
    probe = np.round(rng.normal(size=(80, 6)), 1)

    def walk(tree, row, at=0):
        feature, cut, left, right, value = tree
        return value[at] if feature[at] < 0 else walk(tree, row, left[at] if row[feature[at]] <= cut[at] else right[at])

    want = [np.mean([walk(t, row) for t in forest.trees]) for row in probe]
    assert np.allclose(forest.scores(probe), want) and len(forest.trees) == S.TREES
    assert np.mean((forest.scores(probe) >= 0.5) == (probe[:, 0] + probe[:, 3] > 0.3)) > 0.85


def test_first_split_is_the_best_gini_cut():
    from genoflux.llm import secret_scan as S

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 5)), 1)
    y = (x[:, 1] > 0.2).astype(float) * (rng.random(60) < 0.9)
    feature, cut, left, right, value = S.train(x, y).trees[0]
    drawn = np.random.default_rng(S.SEED)
    rows = drawn.integers(0, len(y), len(y))
    tried = drawn.choice(x.shape[1], x.shape[1] // 2, replace=False)
    impure = lambda v: len(v) * v.mean() * (1 - v.mean())
    losses = {}
    for f in tried:
        for c in np.unique(x[rows, f]):
            low = x[rows, f] <= c
            if min(low.sum(), (~low).sum()) >= S.LEAF:
                losses[int(f), float(c)] = impure(y[rows][low]) + impure(y[rows][~low])
    assert abs(losses[int(feature[0]), float(cut[0])] - min(losses.values())) < 1e-9
    low = x[rows, feature[0]] <= cut[0]
    assert abs(value[0] - y[rows].mean()) < 1e-12 and abs(value[left[0]] - y[rows][low].mean()) < 1e-12 and abs(value[right[0]] - y[rows][~low].mean()) < 1e-12
