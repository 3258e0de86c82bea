"""Matching against brute force over all pairs."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from epilode.catalog import QUERIES
from epilode.functions.text import blank_to_null, normalise_town, title_case
from epilode.operators import matching as M
from epilode.plans.town_matching import Gazetteer, compare_methods, match_towns
from test_functions import plain_osa

CITIES = [
    ("Oak Lawn", True), ("Evanston", True), ("Wilmette", True), ("Worth", True), ("Elgin", True), ("Cary", False),
    ("Harvey", True), ("Markham", True), ("Schaumburg", True), ("Champaign", False), ("Chicago", True), ("Oak Park", True),
    ("Park Ridge", True), ("Palos Park", True), ("Palos Hills", True), ("Marengo", False), ("Northlake", True), ("Peoria", False),
    ("McCook", True), ("La Grange", True), ("River Grove", True), ("Galena", False), ("Moline", False), ("Zion", False),
]
AREAS = ["Hyde Park", "Wrigleyville", "Oak Park", "Rogers Park", "Bronzeville", "Loop"]
ZIPS = [("1", "Evanston"), ("1", "Chicago"), ("2", "Elgin"), ("3", "Chicago"), ("3", "Oak Park"), ("3", "River Grove"),
        ("4", "Schaumburg"), ("5", "Palos Park"), ("5", "Palos Hills"), ("5", "Worth")]
STATE = ["1", "2", "3", "4", "5", "6", "7"]


def damage(rng, name):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(name))
        kind = rng.randrange(5)
        if kind == 0 and len(name) > 1:
            name = name[:i] + name[i + 1:]
        elif kind == 1:
            name = name[:i] + rng.choice("aeiourstlxz ") + name[i:]
        elif kind == 2:
            name = name[:i] + rng.choice("aeiourstlxz") + name[i + 1:]
        elif kind == 3:
            name = name[:i] + name[i:i + 2][::-1] + name[i + 2:]
        else:
            name = name.upper()
    return name


@pytest.fixture(scope="module")
def towns():
    rng = random.Random(11)
    pool = [c for c, _ in CITIES] + AREAS + ["Unknown", "Zzzzqq", "N", "Harvey Il", "Q"]
    rows = [(damage(rng, rng.choice(pool)), rng.choice([None, "1", "2", "3", "4", "5", "6", "9"])) for _ in range(700)]
    return [*rows, (None, "1"), (None, None)]


@pytest.fixture(scope="module")
def gaz(spark):
    frame = spark.createDataFrame
    return Gazetteer(
        frame([(i, c, k) for i, (c, k) in enumerate(CITIES)], "ordinal int, city string, in_cook boolean"),
        frame([(i, z, c) for i, (z, c) in enumerate(ZIPS)], "ordinal int, zip string, city string"),
        frame(list(enumerate(AREAS)), "ordinal int, area string"),
        frame([(z,) for z in STATE], "zip string"),
    )




def all_distances(names, options):
    con = duckdb.connect()
    con.execute("CREATE TABLE a(x VARCHAR)")
    con.execute("CREATE TABLE b(y VARCHAR)")
    con.executemany("INSERT INTO a VALUES (?)", [[n] for n in names])
    con.executemany("INSERT INTO b VALUES (?)", [[o] for o in options])
    rows = con.execute("SELECT x, y, round(1 - jaro_similarity(x, y), 12) FROM a, b").fetchall()
    return {(x, y): d for x, y, d in rows}


def ladder(norm, zip_code, dist):
    """The rules one by one, over all candidates."""
    if norm is None:
        return None, 0
    cities = [c for c, _ in CITIES]

    def nearest(options, limit):
        if not options:
            return None
        best = min(options, key=lambda o: dist[norm.lower(), o.lower()])
        return best if dist[norm.lower(), best.lower()] <= limit else None

    if norm in cities:
        return norm, 1
    if norm in AREAS:
        return "Chicago", 2
    listed = [c for z, c in ZIPS if z == zip_code]
    if listed:
        hit = nearest(listed, 0.35)
        if hit is None and "Chicago" in listed and nearest(AREAS, 0.2):
            hit = "Chicago"
        if hit:
            return hit, 3
    hit = nearest(cities, 0.05)
    if hit:
        return hit, 4
    one = [c for c in cities if plain_osa(norm.lower(), c.lower()) == 1]
    if len(one) == 1:
        return one[0], 5
    if zip_code is not None and zip_code not in STATE:
        return nearest(cities, 0.1), 6
    hit = nearest([c for c, k in CITIES if k], 0.25)
    if hit:
        return hit, 7
    if len(listed) == 1:
        return listed[0], 8
    hit = nearest(cities, 0.2)
    return (hit, 9) if hit else (None, 10)


def test_ladder_equals_brute_force(spark, towns, gaz):
    df = spark.createDataFrame(towns, "town string, zip string")
    got = match_towns(df.withColumn("norm", blank_to_null(normalise_town(F.col("town")))), "town", "zip", gaz).collect()
    assert len(got) == len(towns)
    names = {r["norm"].lower() for r in got if r["norm"] is not None}
    dist = all_distances(names, {o.lower() for o in [*(c for c, _ in CITIES), *AREAS]})
    stages = set()
    for r in got:
        assert (r["clean"], r["match_stage"]) == ladder(r["norm"], r["zip"], dist), r
        stages.add(r["match_stage"])
    assert {0, 1, 2, 3, 5, 6, 7, 8, 10} <= stages


def test_without_zip(spark, towns, gaz):
    df = spark.createDataFrame(towns, "town string, zip string").drop("zip")
    got = match_towns(df.withColumn("norm", blank_to_null(normalise_town(F.col("town")))), "town", None, gaz).collect()
    names = {r["norm"].lower() for r in got if r["norm"] is not None}
    dist = all_distances(names, {o.lower() for o in [*(c for c, _ in CITIES), *AREAS]})
    assert all((r["clean"], r["match_stage"]) == ladder(r["norm"], None, dist) for r in got)


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.3, 0.45])
def test_pairs_within_a_threshold_are_complete(spark, threshold):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("aabcdeo ", k=rng.randint(1, 11))) for _ in range(150)})
    others = sorted({"".join(rng.choices("aabcdeo ", k=rng.randint(1, 11))) for _ in range(80)})
    names = spark.createDataFrame([(w,) for w in words], "name string")
    options = spark.createDataFrame(list(enumerate(others)), "ordinal int, candidate string")
    got = {(r["name"], r["candidate"]) for r in M.jaro_pairs(names, options, threshold).collect()}
    want = {p for p, d in all_distances(words, others).items() if d <= threshold}
    assert got == want


def test_first_in_list_wins_a_tie(spark):
    names = spark.createDataFrame([("abcd",)], "n string")
    options = spark.createDataFrame([(2, "abce"), (1, "abcf"), (3, "abcg")], "o int, c string")
    assert M.add_closest(names, "n", options, "c", "o").first()["match"] == "abcf"


def test_only_one_edit_away(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(120)})
    others = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(25)})
    got = {
        r["name"]: r["match"]
        for r in M.only_one_edit_away(
            spark.createDataFrame([(w,) for w in words], "n string"), "n",
            spark.createDataFrame(list(enumerate(others)), "o int, c string"), "c", "o",
        ).collect()
    }
    want = {}
    for w in words:
        near = [o for o in others if plain_osa(w, o) == 1]
        if len(near) == 1:
            want[w] = near[0]
    assert got == want


def cosine(a, b):
    chars = set(a) | set(b)
    dot = sum(a.count(c) * b.count(c) for c in chars)
    return round(1 - dot / (sum(a.count(c) ** 2 for c in chars) * sum(b.count(c) ** 2 for c in chars)) ** 0.5, 12)


#: The ways a search goes by the number of pairs: all at once, after guesses, after near keys, over parts of a list.
WAYS = [{}, {"_SHORT": 0}, {"_SHORT": 0, "_FEW": 0}, {"_SHORT": 0, "_FEW": 0, "_MANY": 0}, {"_SHORT": 0, "_FEW": 0, "_PART_ROWS": 7}]


@pytest.fixture(params=WAYS, ids=["short", "counted", "guessed", "keyed", "parts"])
def way(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(M, name, value)


@pytest.mark.parametrize("method", ["jw", "cosine"])
def test_nearest_without_threshold(spark, method, way):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcdexyz", k=rng.randint(1, 8))) for _ in range(120)} | {"QQ"})
    others = list(dict.fromkeys("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(20)))
    got = M.nearest(
        spark.createDataFrame([(w,) for w in words], "n string"), "n",
        spark.createDataFrame(list(enumerate(others)), "o int, c string"), "c", "o", method,
    ).collect()
    dist = all_distances(words, others) if method == "jw" else {p: cosine(*p) for p in itertools.product(words, others)}
    assert len(got) == len(words)
    for r in got:
        best = min(others, key=lambda o: dist[r["name"], o])
        assert r["distance"] == pytest.approx(dist[r["name"], best], abs=1e-9)
        assert dist[r["name"], r["match"]] == pytest.approx(dist[r["name"], best], abs=1e-9)


def test_methods_use_the_zip_list(spark, gaz):
    df = spark.createDataFrame(
        [("evanstn", "2"), ("hyde park", "1"), ("hyde park", "2"), ("evanstn", "77"), (None, "1")], "town string, zip string"
    )
    got = {(r["town"], r["zip"]): r["match"] for r in compare_methods(df, "town", "zip", gaz).collect()}
    assert got[("evanstn", "2")] == "Elgin"
    assert got[("hyde park", "1")] == "Chicago"
    assert got[("hyde park", "2")] == "Elgin"
    assert got[("evanstn", "77")] == "Evanston"
    assert got[(None, "1")] is None


def test_answers_come_from_the_list(spark, towns, gaz):
    df = spark.createDataFrame(towns, "town string, zip string")
    cities = {c for c, _ in CITIES}
    assert {r["clean"] for r in match_towns(df, "town", "zip", gaz).collect()} - {None} <= cities


def test_title_is_stable(spark):
    once = title_case(F.lit("north-side o'hare"))
    row = spark.range(1).select(once.alias("a"), title_case(once).alias("b")).first()
    assert row["a"] == row["b"] == "North-Side O'hare"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_measure_each_pair_once_and_never_cross(spark, towns, gaz):
    names = spark.createDataFrame(towns, "name string, zip string").select("name").distinct()
    options = gaz.cities.select(F.col("city").alias("candidate"), "ordinal")
    plans = [
        plan_of(M.jaro_pairs(names, options, 0.25)),
        plan_of(M.closest_in_block(names.withColumn("z", F.substring("name", 1, 1)), "name", "z", gaz.city_zips, "city", "zip", "ordinal")),
        plan_of(M.only_one_edit_away(names, "name", gaz.cities, "city", "ordinal")),
        plan_of(M.nearest(names, "name", gaz.cities, "city", "ordinal", "cosine")),
    ]
    for plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [p.count("ArrowEvalPython") for p in plans] == [1, 1, 0, 0]


def _osa(a, b, d=1.0, i=1.0, s=1.0, t=1.0):
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            best = [0.0] if x == y == 0 else []
            if x:
                best.append(rows[x - 1][y] + d)
            if y:
                best.append(rows[x][y - 1] + i)
            if x and y:
                best.append(rows[x - 1][y - 1] + (0 if a[x - 1] == b[y - 1] else s))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                best.append(rows[x - 2][y - 2] + t)
            rows[x][y] = min(best)
    return rows[-1][-1]


@pytest.mark.parametrize("weight", [(1.0, 1.0, 1.0, 1.0), (1.0, 2.0, 3.0, 1.5), (0.3, 0.5, 1.0, 0.2)])
def test_nearest_by_edits_equals_brute_force(spark, weight, way):
    rng = random.Random(7)
    names = {"".join(rng.choice("abcdxyz") for _ in range(rng.randrange(0, 7))) for _ in range(60)} | {"qqqq", ""}
    options = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(40)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    cand = spark.createDataFrame([(c, k) for k, c in enumerate(options)], "c string, o int")
    got = {r["name"]: (r["match"], round(r["distance"], 9)) for r in M.nearest(df, "n", cand, "c", "o", "osa", weight=weight).collect()}
    want = {}
    for n in names:
        d, _, c = min((round(_osa(n, c, *weight), 9), k, c) for k, c in enumerate(options))
        want[n] = (c, d)
    assert got == want


def test_pairs_that_reach_the_measure_are_few(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct()
    rows = [r["w"] for r in words.orderBy(F.md5("w")).limit(800).collect()]
    names = spark.createDataFrame([(w,) for w in rows[:400]], "name string")
    options = spark.createDataFrame([(w, k) for k, w in enumerate(rows[400:])], "candidate string, ordinal int")
    measured = M.measured_pairs(names, options, 0.25).select("distance").collect()
    assert len(measured) <= 0.03 * 400 * 400


def test_empty_texts_and_thresholds(spark):
    names = spark.createDataFrame([("",), ("a",)], "name string")
    options = spark.createDataFrame([("", 0), ("a", 1)], "candidate string, ordinal int")
    assert sorted(tuple(r) for r in M.jaro_pairs(names, options, 0.25).select("name", "candidate", "distance").collect()) == [("", "", 0.0), ("a", "a", 0.0)]
    with pytest.raises(ValueError):
        M.jaro_pairs(names, options, 0.7)
    with pytest.raises(ValueError):
        M.nearest(names, "name", options, "candidate", "ordinal", "soundex")
    assert M.closest(names, "name", options, "candidate", "ordinal", 1, "osa").count() == 2


def plain_jaro(a, b):
    reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            left.append(x)
    m = len(left)
    turned = sum(x != b[j] for x, j in zip(left, sorted(taken))) // 2
    return (m / len(a) + m / len(b) + (m - turned) / m) / 3 if m else 0.0


def test_all_words_equal_brute_force(spark, tmp_path):
    rng = random.Random(21)
    known = sorted({"".join(rng.choice("aeiouléñstr") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    asked = sorted({damage(rng, rng.choice(known)).lower().replace(" ", "") or "a" for _ in range(120)} | {"été", "il", "zzqq"})
    for name, own in (("documents", known), ("benchmark", asked)):
        rows = [(n, ", ".join(own[n::5]).upper() + ".") for n in range(5)]
        spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.name: (r.match, r.distance) for r in QUERIES["match_closest_all_words"](spark, str(tmp_path)).collect()}
    want = {}
    for a in asked:
        d, w = min((round(1 - plain_jaro(a, w), 12), w) for w in known)
        if d <= 0.25:
            want[a] = (w, round(d, 9))
    assert got == want
    assert any(d > 0.1 for _, d in got.values()) and any(len(a) <= 3 for a in got) and any("é" in a for a in got)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_all_pairs_within_some_edits(spark, edits):
    rng = random.Random(9)
    names = sorted({"".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(90)} | {""})
    options = sorted({damage(rng, rng.choice(names) or "a").lower() for _ in range(90)} | {"", "dcba"})
    got = sorted((r["name"], r["candidate"], r["edits"]) for r in M.within_edits(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(o,) for o in options], "candidate string"), edits
    ).collect())
    distances = ((n, o, _osa(n, o)) for n in names for o in options)
    assert got == sorted(x for x in distances if x[2] <= edits)


def test_closest_goes_every_way(spark, way):
    rng = random.Random(31)
    known = sorted({"".join(rng.choice("aeioulnstr") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    asked = sorted({damage(rng, rng.choice(known)).lower().replace(" ", "") or "a" for _ in range(60)} | {"zzqq"})
    frame = spark.createDataFrame
    found = M.closest(frame([(w,) for w in asked], "w string"), "w", frame(list(enumerate(known)), "o int, c string"), "c", "o").collect()
    dist = all_distances(asked, known)
    want = {a: min((dist[a, k], n) for n, k in enumerate(known)) for a in asked}
    assert {r["name"]: r["match"] for r in found} == {a: known[n] for a, (d, n) in want.items() if d <= 0.25}


@pytest.mark.parametrize("way", [WAYS[0], WAYS[2]], indirect=True, ids=["short", "guessed"])
def test_methods_are_scored_together(spark, way):
    rng = random.Random(17)
    known = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(60)})
    asked = [(damage(rng, rng.choice(known)) or "a",) for _ in range(40)] + [("",), (None,)]
    args = (spark.createDataFrame(asked, "w string"), "w", spark.createDataFrame(list(enumerate(known)), "o int, c string"), "c", "o")
    together = {r["name"]: r for r in M.nearest_by(*args, ("jw", "cosine", "osa")).collect()}
    assert set(together) == {a for a, in asked if a is not None}
    for method in ("jw", "cosine", "osa"):
        alone = {r["name"]: (r["match"], r["distance"]) for r in M.nearest(*args, method).collect()}
        assert {n: tuple(r[method]) for n, r in together.items()} == alone
