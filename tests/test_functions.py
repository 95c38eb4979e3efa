import datetime
import decimal
import hashlib
import hmac

from pyspark.sql import functions as F

from caudal.functions import casts, digest, similarity, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_cleaned(spark):
    for raw, want in [(" No Definido ", None), ("N/A", None), ("   ", None), ("-", None), (None, None), (" Peña ", "Peña"), ("NAVE", "NAVE")]:
        assert one(spark, raw, text.cleaned) == want


def test_names(spark):
    assert one(spark, "Peña  S.A.S.", text.canonical_name) == "PENA"
    assert one(spark, "Ñandú LTDA EN LIQUIDACION", text.canonical_name) == "NANDU LTDA"
    assert one(spark, " áé  í ", text.normalised) == "AE I"
    assert one(spark, "  ", text.normalised) is None
    assert one(spark, "LA VEGA", text.title_case) == "La Vega"


def test_documents(spark):
    for raw, want in [("900.123.456-7", "9001234567"), ("12345", None), ("000000000", None), ("123456789", None), (None, None), ("abc", None)]:
        assert one(spark, raw, text.valid_document) == want


def test_casts(spark):
    assert one(spark, "2025-02-30", casts.to_date) is None
    assert one(spark, "2025", casts.to_date) is None
    assert one(spark, "2025-02-03T10:00:00", casts.to_date) == datetime.date(2025, 2, 3)
    assert one(spark, "20250203", casts.to_date8) == datetime.date(2025, 2, 3)
    assert one(spark, "99991231", casts.to_date8) is None
    assert one(spark, "$1,200.50", casts.to_decimal) == decimal.Decimal("1200.50")
    assert one(spark, "12.7", casts.to_long) == 13
    assert one(spark, "1e3", casts.to_long) == 1000
    assert one(spark, "x", casts.to_long) is None
    assert [one(spark, v, casts.to_boolean) for v in ("Si", "Verdadero", "no", "0", "quizás", None)] == [True, True, False, False, None, None]
    assert one(spark, "2025/01/02 03:04:05", casts.to_timestamp) == datetime.datetime(2025, 1, 2, 3, 4, 5)


def test_digest_equals_library(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, "señal", lambda c: digest.hmac_sha256(c, key)) == hmac.new(key, "señal".encode(), hashlib.sha256).hexdigest()
    assert one(spark, None, lambda c: digest.hmac_sha256(c, b"k")) is None


def test_similarity():
    assert round(similarity.jaro_winkler_of("MARTHA", "MARHTA"), 4) == 0.9611
    assert similarity.jaro_winkler_of("", "A") == 0.0
    assert similarity.jaro_winkler_of("A", "A") == 1.0


def test_buckets(spark):
    got = [one(spark, v, lambda c: text.bucketed(c.cast("int"), [0, 1, 5, 20])) for v in ("0", "1", "2", "5", "6", "21", None)]
    assert got == ["0", "1", "2-5", "2-5", "6-20", ">20", None]
