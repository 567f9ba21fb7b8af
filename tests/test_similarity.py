import random

import pytest

from tessera.functions import similarity as S


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert S.lcs(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize("a, b, want", [("martha", "marhta", 0.9611), ("abcdxxxx", "abcdyyyy", 0.6667), ("", "", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):
    assert S.jaro_winkler(a, b) == pytest.approx(want, abs=1e-4)


def test_token_ratios():
    assert S.ratio("", "") == 1
    assert S.ratio("abcd", "abxd") == pytest.approx(0.75)
    assert S.token_sort("b a", "a b") == 1
    assert S.token_set("a b c", "b a") == 1
    assert S.token_set("", "a") == 0
    assert S.weighted("", "a") == 0


def test_partial_against_all_windows():
    rng = random.Random(2)
    for _ in range(100):
        a, b = "".join(rng.choice("ab c") for _ in range(4)), "".join(rng.choice("ab c") for _ in range(9))
        want = max(S.ratio(a, b[max(0, e - 4) : min(9, e)]) for e in range(1, 13))
        assert S.partial(a, b) == pytest.approx(want)
