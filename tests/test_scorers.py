import random

import pytest

from kinlink.functions import scorers as S


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_matches_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(20))) for _ in "ab")
        assert S.lcs(a, b) == plain_lcs(a, b)


@pytest.mark.parametrize("name", list(S.SCORERS))
def test_symmetric_and_bounded(name):
    rng = random.Random(2)
    most = 1 if name == "jaro_winkler" else 100
    for _ in range(150):
        a, b = (" ".join(rng.choice(("ab", "abc", "x", "yz", "")) for _ in range(rng.randrange(5))).strip() for _ in "ab")
        x = S.SCORERS[name](a, b)
        assert 0 <= x <= most + 1e-9
        if name != "jaro_winkler":
            assert x == pytest.approx(S.SCORERS[name](b, a))


def test_known_values():
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert S.ratio("", "") == 100 and S.ratio("a", "") == 0
    assert S.partial_ratio("test", "this is a test!") == 100
    assert S.token_sort_ratio("fuzzy was a bear", "bear was a fuzzy") == 100
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.token_set_ratio("", "a") == 0 and S.partial_token_set_ratio("a b", "c a") == 100
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)


def test_columns(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x"), ("", ""), ("a b", "b a")], "a string, b string")
    got = [r[0] for r in df.select(S.score("token_sort_ratio", df.a, df.b)).collect()]
    assert got == [100, 0, 100, 100]
