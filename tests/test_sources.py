import os
import time

from pyspark.sql import functions as F

import pytest

from epilode.sources import feeds, files

FIELDS = "date string, count int, name string"


def test_gazetteer_keeps_file_order(spark, tmp_path):
    path = tmp_path / "cities.csv"
    names = [f"town {i * 7919 % 5000:05d}" for i in range(5000)]
    path.write_text("city,in_cook\n" + "".join(f"{n},{'TRUE' if i % 3 else 'FALSE'}\n" for i, n in enumerate(names)))
    df = files.read_gazetteer(spark, str(path), files.CITIES)
    assert [r["city"] for r in df.orderBy("ordinal").collect()] == names
    assert dict(df.dtypes)["in_cook"] == "boolean"


def test_areas(spark, tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text('neighborhood,community_area\nAlbany Park,Albany Park\nAltgeld Gardens,Riverdale\n"A, B",Edgewater\n')
    got = [r["area"] for r in files.read_areas(spark, str(path)).orderBy("ordinal").collect()]
    assert got == ["Albany Park", "Altgeld Gardens", "Riverdale", "Edgewater"]


def test_report_skips_the_preamble_of_every_file(spark, tmp_path):
    for k in range(3):
        body = "".join(f"{k * 100 + i},town {i}\n" for i in range(50))
        (tmp_path / f"r{k}.csv").write_text(f"Title\n\nrun,{k}\nid,city\n{body}\n")
    df = files.read_report(spark, str(tmp_path), "id int, city string")
    assert sorted(r["id"] for r in df.collect()) == [k * 100 + i for k in range(3) for i in range(50)]


def test_report_split_across_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a\nb\nc\nid,city\n" + "".join(f"{i},town\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = files.read_report(spark, str(tmp_path), "id int, city string")
        assert df.rdd.getNumPartitions() > 1
        assert sorted(r["id"] for r in df.collect()) == list(range(20000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_newest_files(spark, tmp_path):
    now = time.time()
    for i, name in enumerate(["cases_2.csv", "cases_10.csv", "cases_1.csv", "cases_3.xlsx", "other.csv"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (now - 100 + i * 10, now - 100 + i * 10))
    got = files.latest_files(spark, str(tmp_path), "cases", "csv", 2)
    assert [r["name"] for r in got.collect()] == ["cases_10.csv", "cases_1.csv"]


def test_headerless_and_blank_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Worth,60482\n")
    assert tuple(files.read_headerless(spark, str(tmp_path / "a.csv"), ["city", "zip"]).first()) == ("Worth", "60482")
    (tmp_path / "b.csv").write_text("Zip Code,n\n00482,1\n")
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "`Zip Code` string, n int").first()["Zip Code"] == "00482"


def test_feed_shapes(spark):
    rows = '[{"date":"2024-01-01","count":3,"name":"a"},{"date":"2024-01-02","count":4}]'
    landed = spark.createDataFrame(
        [
            (1, '{"dataDetails":' + rows + "}", "details"),
            (2, 'name,count,date\r\n"a, ""b""",3,2024-01-01\r\n,4,2024-01-02\r\n', "csv"),
            (3, rows, "list"), (4, "[" + rows + "]", "list"), (5, '[{"x":1},' + rows + "]", "list"),
            (6, '[["meta"],' + rows + "]", "list"), (7, '[{"date":"2024-01-05","count":1}]', "list"),
            (8, '{"dataDetails":[]}', "details"),
        ],
        "id int, payload string, kind string",
    )
    got = {}
    for r in feeds.details_rows(landed, "payload", FIELDS, ["id"]).collect():
        got.setdefault(r["id"], set()).add((r["date"], r["count"], r["name"]))
    plain = {("2024-01-01", 3, "a"), ("2024-01-02", 4, None)}
    assert got[1] == got[3] == got[4] == got[5] == got[6] == plain
    assert got[2] == {("2024-01-01", 3, 'a, "b"'), ("2024-01-02", 4, None)}
    assert got[7] == {("2024-01-05", 1, None)} and 8 not in got


def test_matrix_headers_differ_per_payload(spark):
    landed = spark.createDataFrame(
        [(1, '[["NAME","GEO_ID","A"],["x","g",null]]'), (2, '[["B","GEO_ID","NAME"],["5","h","y"]]')], "id int, p string"
    )
    got = {tuple(r) for r in feeds.matrix_rows(landed, "p", ["id"], ["NAME", "GEO_ID"]).collect()}
    assert got == {(1, 0, "x", "g", "A", None), (2, 0, "y", "h", "B", "5")}


def test_single_candidate(spark):
    c = '{"score":%d,"location":{"x":1,"y":2},"attributes":{"Match_addr":"A","Addr_type":"P","User_fld":"W"}}'
    df = spark.createDataFrame([('{"candidates":[' + c % 9 + "," + c % 8 + "]}",), ('{"candidates":[]}',), ("bad",)], "p string")
    got = [r["r"] for r in df.select(feeds.geocode_candidate(F.col("p")).alias("r")).collect()]
    assert got[0]["score"] == 9.0 and got[0]["residence_city"] == "W" and got[1] is None and got[2] is None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("60482", 'Worth, "IL"')], "zip string, city string")
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), "zip string, city string").collect() == df.collect()


def test_payloads_that_can_not_be_read_are_reported(spark):
    rows = [(1, "{", "details"), (2, '{"dataDetails":[{"a":1}]}', "details"), (3, "x", "list"), (4, "a\n1", "csv"), (5, "[]", "what"), (6, None, "csv")]
    landed = spark.createDataFrame(rows, "id int, p string, kind string")
    got = {tuple(r) for r in feeds.unreadable_payloads(landed, "p", ["id"], "kind").collect()}
    assert got == {(1, "no dataDetails array"), (3, "not a list"), (5, "unknown kind"), (6, "empty")}


def test_matrix_with_repeated_names_and_short_rows(spark):
    rows = [(1, '[["NAME","a","a"],["x","1","2"]]'), (2, '[["NAME","a"],["y"]]'), (3, "{bad")]
    landed = spark.createDataFrame(rows, "id int, p string")
    got = sorted(tuple(r) for r in feeds.matrix_rows(landed, "p", ["id"], ["NAME"]).select("id", "NAME", "variable", "value").collect())
    assert got[:2] == [(1, "x", "a", "1"), (1, "x", "a", "2")] and got[2] == (2, "y", "a", None) and len(got) == 3
    reasons = {tuple(r) for r in feeds.unreadable_payloads(landed, "p", ["id"]).collect()}
    assert reasons == {(1, "header names repeat"), (2, "rows of another length than the header"), (3, "not an array of rows")}


def test_quoted_line_ends(spark):
    landed = spark.createDataFrame([(1, 'a,b\n"x\ny",1\r\n"q ""u"", v",2\n', "csv")], "id int, p string, kind string")
    got = sorted(tuple(r) for r in feeds.details_rows(landed, "p", "a string, b int", ["id"]).collect())
    assert got == [(1, 'q "u", v', 2), (1, "x\ny", 1)]


def test_layers_of_mixed_systems_are_refused(spark):
    from epilode.sources import layers

    mixed = spark.createDataFrame([(1, 3435), (2, 4326)], "id int, srid int")
    with pytest.raises(ValueError):
        layers.layer_srid(mixed)
    assert layers.layer_srid(mixed.filter("id = 2")) == 4326 and layers.layer_srid(mixed.drop("srid")) == 3435


def test_undeclared_fields_are_united(spark):
    payloads = [
        '{"dataDetails":[{"a":1,"b":"x"},{"a":2.5,"c":true}]}', '[{"a":3,"it\'s \\"q\\"":"q"}]', '[[{"b":"y","n":{"z":1}}]]',
        '[{"meta":1},[{"b":7,"d":null}]]', "junk", None, "", "[]", '{"x":1}', "[1,2]", '[{"a":1},{"a":2}]', '[{}]',
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, p string")
    found = feeds.undeclared_rows(df, "p", ["id"])
    assert found.columns == ["id", "a", "b", "c", "d", 'it\'s "q"', "n"]
    rows = sorted(((r[0], *(None if x is None else str(x) for x in r[1:])) for r in found.collect()), key=repr)
    assert rows == sorted([
        (0, "1.0", "x", None, None, None, None), (0, "2.5", None, "True", None, None, None), (1, "3.0", None, None, None, "q", None),
        (2, None, "y", None, None, None, '{"z":1}'), (3, None, "7", None, None, None, None), (10, "1.0", None, None, None, None, None),
        (10, "2.0", None, None, None, None, None), (11, None, None, None, None, None, None),
    ], key=repr)
    assert feeds.undeclared_rows(df.limit(0), "p", ["id"]).collect() == []


def test_failed_payloads_are_counted_on_the_way(spark, tmp_path):
    rows = [(1, '[["a"],["1"]]'), (2, "junk"), (3, None), (4, '[["a","b"],["1"]]'), (5, '[["a","b"],["1","2"]]')]
    spark.createDataFrame(rows, "id int, p string").write.parquet(f"{tmp_path}/landed")
    landed = spark.read.parquet(f"{tmp_path}/landed")
    kept, counts = feeds.keep_readable(landed, "p")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in kept.collect()) == [1, 5] and kept.columns == ["id", "p"]
    failed = feeds.unreadable_payloads(landed, "p", ["id"]).count()
    assert counts.get == {"landed": 5, "kept": 2, "failed": failed} and failed == 3
    assert plan.count("FileScan") == 1
