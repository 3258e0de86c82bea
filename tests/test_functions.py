import datetime as dt

import pytest
from pyspark.sql import functions as F

from epilode.functions import codes, dates, measures, text
from epilode.functions import distance as D


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def date(s):
    return F.lit(s).cast("date")


@pytest.mark.parametrize(
    "day, start, year, week",
    [
        ("2024-01-01", "2023-12-31", 2024, 1), ("2023-12-30", "2023-12-24", 2023, 52),
        ("2021-01-02", "2020-12-27", 2020, 53), ("2021-01-03", "2021-01-03", 2021, 1),
        ("2025-12-31", "2025-12-28", 2025, 53), ("2022-12-31", "2022-12-25", 2022, 52),
    ],
)
def test_epi_week(spark, day, start, year, week):
    d = date(day)
    got = spark.range(1).select(dates.week_start(d), dates.week_end(d), dates.week_year(d), dates.week_number(d)).first()
    first = dt.date.fromisoformat(start)
    assert tuple(got) == (first, first + dt.timedelta(days=6), year, week)


@pytest.mark.parametrize("n, want", [(0, 0), (1, None), (4, None), (5, 5), (None, None)])
def test_suppress(spark, n, want):
    assert value(spark, measures.suppress_count(F.lit(n).cast("int"))) == want


def test_rate(spark):
    assert value(spark, measures.rate(F.lit(5), F.lit(2), 1)) == 2
    assert value(spark, measures.rate(F.lit(7), F.lit(2), 1)) == 4
    assert value(spark, measures.rate(F.lit(5), F.lit(0), 1)) is None


@pytest.mark.parametrize(
    "age, band",
    [(19, "< 20"), (19.5, "< 20"), (20, "20s"), (79, "70s"), (79.5, "> 80"), (80, "> 80"), (101, "> 80"), (None, None)],
)
def test_age_band(spark, age, band):
    assert value(spark, measures.age_band(F.lit(age).cast("double"))) == band


@pytest.mark.parametrize(
    "raw, want",
    [
        ("John A", "JOHN"), ("Ann-Marie Jr", "ANNMARIE"), ("John Jrue", "JOHNUE"), ("José Núñez", "JOSÉNÚÑEZ"), (None, None),
    ],
)
def test_name_key(spark, raw, want):
    assert value(spark, text.name_key(F.lit(raw))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("12 N. Main St Apt 4", "12 NORTH MAIN STREET"), ("1 SE Oak", "1 SOUTEAST OAK"),
        ("5 Elm Rd 60601-1234", "5 ELM ROAD 60601"), ("9 Lake Ave Apt #12", "9 LAKE AVENUE APT"),
        ("1 Main FL 33101", "1 MAIN"), ("St Charles", "STREET CHARLES"), ("3 É n", "3 É NORTH"), ("én 3", "ÉN 3"),
    ],
)
def test_address(spark, raw, want):
    assert value(spark, text.clean_address(F.lit(raw))) == want


def test_address_keeps_zip(spark):
    assert value(spark, text.clean_address(F.lit("5 Elm Rd 60601-1234"), shorten_zip=False)) == "5 ELM ROAD 60601-1234"


@pytest.mark.parametrize(
    "raw, want",
    [
        (" Summit Argo", "Summit"), ("Oak Illinois", "Oaklinois"), ("Chicago Hts", "Chicago Heights"), ("Elk Grove", "Elk Grove Village"),
        ("Elk Grove Village", "Elk Grove Village"), ("Palos?heights", "Palos Heights"), ("Blue Islane D", "Blue Island D"),
        ("Blue Island D", "Blue Island"), ("S Chiacgo Heights", "South Chiacgo Heights"), ("La Grange Highlands", "La Grange"),
        ("Orlaand Patk", "Orland Park"), ("Hoffman Est", "Hoffman Estates"), ("Evanston, Il", "Evanston"),
    ],
)
def test_town_rules(spark, raw, want):
    assert value(spark, text.correct_town(F.lit(raw))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("N", "North"), ("n/a", "North/A"), ("harvey il", "Harvey "), ("illinois city", " City"), ("chicago hts.", "Chicago Heights"),
        ("mt prospect", "Mount Prospect"), ("summit argo", "Summit"), ("argo", "Summit"), ("chgo", "Chicago"), ("w spgs", "West Springs"),
        ("cc hills", "Country Club Hills"), ("so holland", "South Holland"), ("elk grove vlg", "Elk Grove Village"),
    ],
)
def test_town_normalisation(spark, raw, want):
    assert value(spark, text.normalise_town(F.lit(raw))) == want


@pytest.mark.parametrize(
    "raw, want",
    [("oak-lawn", "Oak-Lawn"), ("n/a", "N/A"), ("o'brien", "O'brien"), ("EAST  side", "East  Side"), ("élan vital", "Élan Vital"), ("u.s.a.", "U.s.a.")],
)
def test_title(spark, raw, want):
    assert value(spark, text.title_case(F.lit(raw))) == want


def test_literal_rules_equal_their_patterns(spark):
    import re

    from epilode.functions import fixed_values as V

    samples = [p.replace("\\", "").replace("|", " ") + x for p, _ in V.TOWN_CORRECTIONS for x in ("", " Il", "s")]
    rows = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in rows.select(text.fold_rules(F.col("t"), V.TOWN_CORRECTIONS)).collect()]
    want = []
    for s in samples:
        for p, r in V.TOWN_CORRECTIONS:
            s = re.sub(p, r, s)
        want.append(s)
    assert got == want


@pytest.mark.parametrize(
    "race, eth, want",
    [
        (";2106-3;", ";2135-2;", "Hispanic/Latino"), (";2106-3;UNK;", ";2186-5;", "Non-Hispanic White"),
        (";UNK;", None, "Unknown"), (";2106-3;2054-5;", None, "Non-Hispanic Multiple Races"), (None, None, "Unknown"),
        (";9999;", None, "Unknown"), (";NR;PHC1175;", ";", "Unknown"),
    ],
)
def test_race(spark, race, eth, want):
    assert value(spark, codes.race_ethnicity(F.lit(race).cast("string"), F.lit(eth).cast("string"))) == want


def test_feed_date_and_url(spark):
    assert value(spark, dates.feed_date(date("2023-05-08"))) == "08May2023"
    today = value(spark, F.current_date())
    assert value(spark, dates.feed_date(days_ago=3)) == (today - dt.timedelta(days=3)).strftime("%d%b%Y")
    url = codes.set_feed_window(F.lit("u?startDate=1&endDate=2"), F.lit("A"), F.lit("B"))
    assert value(spark, url) == "u?startDate=A&endDate=2"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("5/8/2023 1:05 PM", dt.datetime(2023, 5, 8, 13, 5)), ("5/8/2023", dt.datetime(2023, 5, 8)), ("nope", None),
        ("12/31/2023 12:00 am", dt.datetime(2023, 12, 31)), (None, None),
    ],
)
def test_parse_datetime(spark, raw, want):
    assert value(spark, dates.parse_report_datetime(F.lit(raw).cast("string"))) == want


def test_parens_and_parts(spark):
    assert value(spark, text.strip_parens(F.lit(" 1 Main St (rear) (41.8, -87) "))) == "1 Main St"
    assert value(spark, text.city_part(F.lit("Oak Park, IL"))) == "Oak Park"
    assert value(spark, text.state_part(F.lit("Oak Park, IL"))) == "IL"
    assert value(spark, text.zip5(F.lit("60601-1234"))) == "60601"


def test_labels(spark):
    assert value(spark, codes.label_sex(F.lit("Estimate!!Total!!Female!!5 to 9 years"))) == "Female"
    assert value(spark, codes.label_age(F.lit("Estimate!!Total!!Female!!5 to 9 years"))) == "5 to 9 years"
    assert value(spark, codes.label_age(F.lit("Estimate!!Total"))) == "Total"
    assert value(spark, codes.label_sex(F.lit("Estimate!!Total"))) == "Total"


def test_jaro_winkler(spark):
    a, b = F.lit("martha"), F.lit("marhta")
    assert value(spark, D.jaro(a, b)) == pytest.approx(1 - 0.944444444444)
    assert value(spark, D.jaro(a, b, 0.1)) == pytest.approx(1 - 0.961111111111)
    assert value(spark, D.jaro(a, b, 0.1, 0.5)) == pytest.approx(1 - 0.944444444444)
    assert value(spark, D.jaro(F.lit("abcdefgh"), F.lit("bcadefgh"))) == pytest.approx(1 - 0.958333333333)
    assert value(spark, D.jaro(F.lit(None).cast("string"), b)) is None


def plain_osa(a, b, d=1.0, i=1.0, s=1.0, t=1.0):
    m = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            if not x or not y:
                m[x][y] = x * d + y * i
                continue
            m[x][y] = min(m[x - 1][y] + d, m[x][y - 1] + i, m[x - 1][y - 1] + (a[x - 1] != b[y - 1]) * s)
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                m[x][y] = min(m[x][y], m[x - 2][y - 2] + t)
    return m[-1][-1]


def test_edit_distances(spark):
    import random

    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(400)]
    df = spark.createDataFrame([*pairs, ("ca", "abc")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", D.osa(a, b).alias("d"), D.osa(a, b, 0.5, 0.7, 0.9, 0.3).alias("w"),
                     D.one_edit_apart(a, b).alias("one")).collect()
    for r in rows:
        assert r["d"] == plain_osa(r["a"], r["b"])
        assert r["w"] == pytest.approx(plain_osa(r["a"], r["b"], 0.5, 0.7, 0.9, 0.3))
        assert r["one"] == (r["d"] == 1), r


def test_cosine(spark):
    assert value(spark, D.cosine(F.lit("abc"), F.lit("cab"))) == pytest.approx(0)
    assert value(spark, D.cosine(F.lit("aab"), F.lit("b"))) == pytest.approx(1 - 1 / 5**0.5)
    assert value(spark, D.cosine(F.lit("ab"), F.lit("cd"))) == 1
