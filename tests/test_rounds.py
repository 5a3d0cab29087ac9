"""Rules run to the fixpoint unless a caller bounds the rounds, and a bound that cuts is warned of."""

import inspect
import warnings

import pytest

from lodestar.plans.base import Base
from lodestar.plans.rules import Var, atom, rule


def test_only_a_bound_ends_rounds_and_is_warned_of(spark):
    x, y, z = Var("X"), Var("Y"), Var("Z")
    rules = [rule(atom("far", x, y), atom("next", x, y)), rule(atom("far", x, z), atom("far", x, y), atom("next", y, z))]
    base = Base(spark).insert("next", [(i, i + 1) for i in range(4)])
    for run in (Base.derive, Base.answers):
        assert inspect.signature(run).parameters["max_rounds"].default is None
    with pytest.warns(UserWarning, match="no fixpoint within 2 rounds"):
        base.answers(atom("far", "0", y), rules, 2)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert base.answers(atom("far", "0", y), rules).count() == 4
        base.prove(atom("far", "0", y), rules, 2)
