from __future__ import annotations

import math

import pytest

from lattica.plans.recipe import ClassificationHead, Connection, Hidden, Input, ManifoldInput, Recipe, RegressionHead


def test_chain_names_and_order():
    r = Recipe.chain(Input(), Hidden(K=4), ClassificationHead(), delta=0.5)
    assert [b.name for b in r.blocks] == ["input", "hidden1", "head"] == r.stable_order()
    assert [c.coupling for c in r.connections] == ["M", None]


def test_ratios():
    r = Recipe.chain(Input(), Hidden(K=4, epsilon_ratio=0.1), Hidden(K=3, epsilon=0.2), ClassificationHead(), delta=0.5, delta_ratio=2.0)
    _, hidden, _, links = r.as_chain()
    assert [c.delta for c in links] == [0.5, 1.0, 2.0]
    assert [h.epsilon for h in hidden] == [0.05, 0.2]


@pytest.mark.parametrize(
    "bad",
    [
        lambda: Input(K=0),
        lambda: Input(epsilon=math.inf),
        lambda: Hidden(epsilon=0.1, epsilon_ratio=0.1),
        lambda: RegressionHead(epsilon_M=0.1, W_M=(1.0,)),
        lambda: ClassificationHead(coupling="X"),
        lambda: Connection("a", "b", delta=1.0, delta_ratio=1.0),
        lambda: Recipe((Input(name="a"), ClassificationHead(name="a"))),
        lambda: Recipe((Input(name="a__b"), ClassificationHead(name="h"))),
        lambda: Recipe((Input(name="a"), ClassificationHead(name="c"), RegressionHead(name="r"))),
        lambda: Recipe((Input(name="a"), Hidden(name="b"), Hidden(name="c"), ClassificationHead(name="h")), (Connection("b", "c"), Connection("c", "b"))),
        lambda: Recipe((Input(name="a"), ClassificationHead(name="h")), (Connection("h", "a"),)),
        lambda: Recipe((Input(name="a"), ClassificationHead(name="h")), (Connection("a", "h", coupling="M"),)),
        lambda: Recipe((Input(name="a"), ManifoldInput(name="b"), ClassificationHead(name="h")), (Connection("a", "h"), Connection("b", "h"))).as_chain(),
    ],
)
def test_what_is_refused(bad):
    with pytest.raises(ValueError):
        bad()


def test_replace_and_json():
    r = Recipe.chain(Input(epsilon_T=0.5), RegressionHead(W_M=(1.0, 2.0)), delta=0.5)
    assert r.replace_block("input", K=9).blocks[0].K == 9
    assert r.replace_connection("input", "head", delta=2.0).connections[0].delta == 2.0
    assert Recipe.from_json(r.to_json()) == r
    with pytest.raises(ValueError):
        r.replace_block("nothing", K=2)
