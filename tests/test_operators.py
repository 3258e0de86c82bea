import datetime as dt

import pytest
from pyspark.sql import functions as F

from epilode.operators import aggregates as A
from epilode.operators import columns as C
from epilode.operators import ordered as O
from epilode.operators import sets as S
from epilode.operators.joins import city_in_zip, single_city_zips, triage_cases
from epilode.plans.census import estimates_table, jurisdiction_estimate
from epilode.plans.geocoding import add_batches, join_results, request_payloads
from epilode.plans.reports import clean_report


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_share(spark):
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "k string, n bigint")
    assert [r[2] for r in rows(A.add_share(n), "k")] == [25.0, 25.0, 50.0]
    gap = n.unionByName(spark.createDataFrame([("d", None)], n.schema))
    assert {r[2] for r in rows(A.add_share(gap))} == {None}
    grouped = spark.createDataFrame([("x", 1), ("x", 3), (None, 2), ("y", None)], "g string, n bigint")
    got = {(r["g"], r["n"]): r["proportion"] for r in A.add_share(grouped, "n", ["g"]).collect()}
    assert got == {("x", 1): 25.0, ("x", 3): 75.0, (None, 2): 100.0, ("y", None): None}


def test_frequency_counts_missing_in_the_base(spark):
    df = spark.createDataFrame([("good",), ("good",), ("bad",), (None,)], "result string")
    assert rows(A.frequency(df, "result"), F.desc("n")) == [("good", 2, 50.0), ("bad", 1, 25.0)]


def test_median_is_exact_with_a_hot_group(spark):
    import statistics

    # One group holds most rows, one is constant, one has two values, one a missing key.
    data = [("hot", float((i * 7919) % 30011)) for i in range(30011)]
    data += [("flat", 3.0)] * 999 + [("two", 1.0), ("two", 2.0), ("one", 5.0), (None, 4.0), (None, 8.0), ("two", None)]
    got = {r["k"]: r for r in A.median_sd(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    for k in {d[0] for d in data}:
        values = [v for g, v in data if g == k and v is not None]
        assert got[k]["n"] == len(values)
        assert got[k]["median"] == statistics.median(values)
        if len(values) > 1:
            assert got[k]["sd"] == pytest.approx(statistics.stdev(values))


def test_wide_and_long(spark):
    df = spark.createDataFrame([("a", "E", 1.0), ("a", "M", 0.5), ("b", "E", 2.0)], "id string, kind string, v double")
    wide = A.to_wide(df, ["id"], "kind", "v", {"E": "estimate", "M": "moe"})
    assert rows(wide, "id") == [("a", 1.0, 0.5), ("b", 2.0, None)]
    assert A.to_long(wide, ["id"], ["estimate", "moe"]).count() == 4


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "`Zip Code` int, `zip_code` int, `% Done` int, `wwtpName` int, `2nd #` int")
    assert C.clean_names(df).columns == ["zip_code", "zip_code_2", "percent_done", "wwtp_name", "x2nd_number"]


def test_across_contains_matches_parts_of_words(spark):
    df = spark.createDataFrame([("a", "a", "a")], "`Home City` string, Ethnicity string, Race string")
    assert rows(C.across_contains(df, "City", F.upper)) == [("A", "A", "a")]
    assert rows(C.across_contains(df, "City", F.upper, exact_tokens=True)) == [("A", "a", "a")]


def test_report(spark):
    df = spark.createDataFrame(
        [("1", "x", "5/8/2023 1:05 PM", "Oaklawn")], "`Case No` string, `Case (2)` string, `Open Date` string, `City?` string"
    )
    out = clean_report(df)
    assert out.columns == ["CaseNo", "OpenDate", "City"]
    assert rows(out) == [("1", dt.datetime(2023, 5, 8, 13, 5), "Oak Lawn")]
    assert clean_report(df, formatted=False).columns == ["CaseNo", "Case2", "OpenDate", "City"]


def test_unnest_keeps_rows_without_result(spark):
    df = spark.createDataFrame([(1, [("m", 9.0)]), (2, [])], "id int, r array<struct<a:string,s:double>>")
    assert rows(C.unnest(df, "r"), "id") == [(1, "m", 9.0), (2, None, None)]


def test_interval_labels(spark):
    lv = spark.createDataFrame([("[0,10)", 1), ("[10,20)", 2), ("[20,30)", 3)], "interval string, code int")
    assert [r[2] for r in rows(O.label_levels(lv), "code")] == ["0 - 9.9", "10 - 19.9", "More than 20"]


def test_numbers_are_consecutive(spark):
    df = spark.range(0, 5003).withColumn("k", (F.col("id") * 7) % 5003).drop("id")
    got = rows(add_batches(df, "k", 2000).select("k", "id_for_geocoding", "batch"), "k")
    assert [r[1] for r in got] == list(range(1, 5004))
    assert all(r[2] == r[1] // 2000 for r in got)
    assert sum(r[2] == 0 for r in got) == 1999


def test_sample(spark):
    df = spark.range(0, 20000)
    a, b = O.sample_n(df, "id", 500, seed=3), O.sample_n(df, "id", 500, seed=3)
    got = {r[0] for r in a.collect()}
    assert len(got) == 500 and got == {r[0] for r in b.collect()}
    assert O.sample_n(df, "id", 30000).count() == 20000


def test_city_in_zip_and_single(spark):
    cz = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "A")], "zip string, city string")
    df = spark.createDataFrame([("A", "1"), ("C", "1"), (None, "1"), ("A", None)], "t string, z string")
    assert {(r["t"], r["z"]): r["in_zip"] for r in city_in_zip(df, "t", "z", cz).collect()} == {
        ("A", "1"): True, ("C", "1"): False, (None, "1"): None, ("A", None): None,
    }
    assert rows(single_city_zips(cz)) == [("2", "A")]


def test_triage_rule_order(spark):
    cases = spark.createDataFrame(
        [("1", "Else", "Closed", "x"), ("2", "Home", "Closed", "x"), ("3", "Home", "Completed - Needs Closure", ""),
         ("4", "Home", "Open", "x"), ("5", "Home", "Open", "x"), ("6", "Home", "Open", ""), ("7", "Home", "Open", None)],
        "case_number string, jurisdiction string, investigation_status string, current_investigator string",
    )
    requests = spark.createDataFrame(
        [("1", "a", True), ("2", "a", True), ("3", "a", False), ("4", "a", False), ("5", "a", True), ("6", " ", False), ("7", "zz", False)],
        "case_number string, requested_investigator string, overwrite boolean",
    )
    known = spark.createDataFrame([("a",), ("a",)], "investigator string")
    got = {r["case_number"]: r["outcome"] for r in triage_cases(cases, requests, known, "Home").collect()}
    assert got == {"1": "transferred", "2": "closed", "3": "closed", "4": "already assigned", "5": "assigned",
                   "6": "cleared", "7": "unknown investigator"}


def test_jurisdiction(spark):
    data = [("county", "C", "v", 1000.0), ("place", "P1", "v", 300.0), ("place", "P2", "v", 100.0), ("place", "P3", "v", 80.0),
            ("place", "P4", "v", 60.0), ("place", "other", "v", 7.0), ("county subdivision", "T", "v", 40.0),
            ("county", "C", "w", 10.0), ("county subdivision", "T", "w", 1.0), ("county", "C", "x", 10.0)]
    units = spark.createDataFrame(data, "geography string, name string, variable string, value double")
    got = dict(rows(jurisdiction_estimate(units, "C", ["P1", "P2", "P3", "P4"], "T")))
    assert got == {"v": 420.0, "w": 9.0, "x": None}


def test_estimates_table(spark):
    payload = (
        '[["NAME","GEO_ID","B1E","B1M","B1EA","B1MA","state","place"],'
        '["Town","g","12","3",null,"(X)","17","5"],["Other","h","N","4",null,null,"17","6"]]'
    )
    landed = spark.createDataFrame([(5, payload)], "code int, payload string")
    labels = spark.createDataFrame([("B1E", "Total", "POP")], "name string, label string, concept string")
    got = {r["NAME"]: r for r in estimates_table(landed, "payload", "code", labels).collect()}
    assert got["Town"]["estimate"] == 12.0 and got["Town"]["moe"] == "3" and got["Town"]["label"] == "Total"
    assert got["Other"]["estimate"] is None and got["Town"]["census_place_code"] == "5"


def test_geocode_round(spark):
    df = spark.createDataFrame(
        [(1, 0, "1 Main", "Worth", "60482"), (2, 0, None, "Worth", "60482"), (3, 1, "3 Elm", "Worth", "60482")],
        "id bigint, batch int, street string, city string, zip string",
    )
    body = request_payloads(df, "id", "street", "city", "zip")
    assert dict(rows(body))[0] == '{"records":[{"attributes":{"ADDRESS":"1 Main","CITY":"Worth","POSTAL":"60482","OBJECTID":1}}]}'
    answer = '{"locations":[{"score":99.0,"attributes":{"ResultID":1,"X":1.5,"Y":2.5,"Status":"M","Match_addr":"1 MAIN","User_fld":"Worth"}}]}'
    landed = spark.createDataFrame([(0, answer, True), (1, None, False)], "batch int, payload string, ok boolean")
    got = {r["id"]: r for r in join_results(df, landed, "payload", "id").collect()}
    assert (got[1]["X"], got[1]["geo_status"]) == (1.5, "SUCCESS")
    assert got[2]["geo_status"] == "SUCCESS" and got[2]["X"] is None
    assert got[3]["geo_status"] == "FAIL"
    strict = join_results(df, landed, "payload", "id", complete=["street", "city", "zip"], compatible=False)
    assert {r["id"]: r["geo_status"] for r in strict.collect()} == {1: "SUCCESS", 2: "SKIPPED", 3: "FAIL"}


def test_gazetteer_lists(spark):
    places = spark.createDataFrame([("Worth village, Illinois",), ("Chicago city, Illinois",), ("Worth town, Illinois",), ("Cary CDP, Illinois",)], "NAME string")
    members = spark.createDataFrame([("Worth",)], "m string")
    assert rows(S.build_city_list(places, "NAME", members, "m"), "city") == [
        ("Cary", False), ("Chicago", True), ("Hines", True), ("Worth", True)
    ]
    zctas = spark.createDataFrame([("1760002",), ("1760004",)], "GEOID string")
    assert rows(S.build_zip_list(zctas, "GEOID", spark.createDataFrame([("60004",)], "z string"), "z"), "zip") == [
        ("60002", False), ("60004", True)
    ]


def test_union_distinct_drops_lists(spark):
    a = spark.createDataFrame([("x",), ("y",)], "a string")
    b = spark.createDataFrame([("y",), ("p, q",)], "b string")
    assert rows(S.union_distinct(a, "a", b, "b"), "area") == [("x",), ("y",)]


def test_numbers_do_not_depend_on_partitions(spark):
    """Rows of one hot key keep their numbers whatever the partitions; equal rows may change places."""
    rows = [(None if i % 7 == 0 else i % 5 if i % 3 else 1, f"row {i}", i / 3) for i in range(600)] + [(1, "twice", 0.0)] * 2
    df = spark.createDataFrame(rows, "k int, t string, v double")
    first, second = (
        sorted((r["row_id"], r["k"], r["t"], r["v"]) for r in O.number_rows(some, "k").collect())
        for some in (df.repartition(3), df.orderBy(F.desc("t")).repartition(11, "t"))
    )
    assert first == second and [r[0] for r in first] == list(range(1, 603))
