import inspect

from lexmill.llm import neardup as D


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    given = {k: v.default for k, v in inspect.signature(D.NearDuplicates).parameters.items()}
    agree, groups = given["least"] ** given["per_group"], given["groups"]
    assert (1 - agree) ** groups + groups * agree * (1 - agree) ** (groups - 1) < 0.01
