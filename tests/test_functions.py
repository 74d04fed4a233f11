import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from urna.functions.dates import parse_date
from urna.functions.numbers import as_int, parse_italian_float, parse_italian_int, ratio
from urna.functions.text import canonical_municipality, edit_similarity, scan_key, slug
from urna.functions.urls import query_code, url_policy


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expression(F.col("x")), "i").orderBy("i").collect()]


def test_slug_equals_a_plain_restatement(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in (*range(32, 0x250), *range(0x2150, 0x2190), *range(0x1D400, 0x1D480), 0xFB01, 0x1E9E)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(3000)]

    def plain(text):
        kept = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", "_", kept.casefold()).strip("_")

    assert column(spark, texts, slug) == [plain(t) for t in texts]


def test_slug_of_long_accented_texts_costs_little_more_than_of_plain_ones(spark):
    def seconds(word):
        rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit(word * 4000), F.col("id").cast("string")).alias("x"))
        start = time.perf_counter()
        assert rows.select(slug(F.col("x")).alias("k")).agg(F.sum(F.length("k"))).first()[0] > 0
        return time.perf_counter() - start

    seconds("warm up "), seconds("échauffé ")
    assert seconds("più città è già ") < 10 * seconds("piu citta e gia ") + 1
    assert column(spark, ["a b" * 1000 + "ß\n½ \u4e00Ⅳ"], slug) == [re.sub(" ", "_", "a b" * 1000) + "ss_1_2_iv"]


def test_places(spark):
    labels = ["Roma centro", "Verona Est", "REGGIO DI CALABRIA", "VERONELLA", "ROMANO CANAVESE", "Milano 10",
              "parte del comune di Trieste", "TRIESTE II", "Roma: Municipio XIV", "  ", None, "Parte di Comune REGGIO DI CALABRIA"]
    assert column(spark, labels, canonical_municipality) == [
        "ROMA", "VERONA", "REGGIO CALABRIA", "VERONELLA", "ROMANO CANAVESE", "MILANO",
        "TRIESTE", "TRIESTE", "ROMA", None, None, "REGGIO CALABRIA"]


def test_numbers(spark):
    texts = ["1.234,00", "2.000,00", "1234.5", "1,5", "+-5", ",0", "", None, "12 000"]
    assert column(spark, texts, as_int) == [1234, 2000, 12345, None, None, 0, None, None, 12000]
    assert column(spark, ["7.697", "12,5", "-3"], parse_italian_int) == [7697, None, -3]
    assert column(spark, ["75,15 %", "1.234,5", "x"], parse_italian_float) == [75.15, 1234.5, None]
    assert column(spark, [1234.5, 1234.0], lambda x: as_int(F.lit("9"), x), "double") == [None, 1234]
    assert column(spark, [1], lambda x: ratio(x, F.lit(128)), "int") == [0.007812]


def test_dates_and_urls(spark):
    days = column(spark, ["1994-03-27", "27/03/1994", "19940327", "x"], parse_date)
    assert [str(d) for d in days] == ["1994-03-27"] * 3 + ["None"]
    urls = ["https://dait.interno.gov.it/x", "http://dait.interno.gov.it/x", "https://a:b@dait.interno.gov.it/",
            "https://dait.interno.gov.it:8443/", "https://dait.interno.gov.it:443/", "https://example.org/", "not a url"]
    assert column(spark, urls, url_policy) == [
        "ok", "not_https", "credentials", "port_not_allowed", "ok", "host_not_allowed", "not_https"]
    assert column(spark, ["http://h/p?lev2=12&x=a%20b"], lambda u: query_code(u, "x")) == ["a b"]


def test_scanned_names(spark):
    assert column(spark, ["8ARZAN0'", "CHIETI"], scan_key) == ["BARZANO", "CMIETI"]
    assert column(spark, ["DUNE"], lambda x: edit_similarity(x, F.lit("DUNO"))) == [0.75]
