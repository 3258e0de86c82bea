"""Fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import nested_rules, query, title_sql
from epilode.catalog.scalar_queries import cosine_sql
from epilode.catalog.towns import ANCHOR, LINE_TOWNS_SQL, LISTS_SQL, PART_TOWNS_SQL, gazetteer, line_towns, part_towns
from epilode.functions import fixed_values as V
from epilode.functions.text import title_case
from epilode.operators import matching as M
from epilode.operators.joins import city_in_zip, single_city_zips
from epilode.plans.town_matching import match_report, match_towns, method_table

_DIST = "round(1 - jaro_similarity(lower({0}), lower({1})), 12)"


@query(
    "match_closest",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL},
      s AS (SELECT town, city, {_DIST.format('town', 'city')} AS d FROM (SELECT DISTINCT town FROM dirty WHERE town IS NOT NULL), cities),
      b AS (SELECT town, arg_min(city, ROW(d, city)) AS match, min(d) AS distance FROM s WHERE d <= 0.25 GROUP BY town)
    SELECT p_partkey, dirty.town, match, round(distance, 9) AS distance FROM dirty LEFT JOIN b ON dirty.town = b.town
    """,
)
def _closest(t):
    rows = M.add_closest(part_towns(t), "town", gazetteer(t).cities, "city", "ordinal", 0.25)
    return rows.select("p_partkey", "town", "match", F.round("distance", 9).alias("distance"))


@query(
    "match_in_block",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL},
      s AS (SELECT town, k.zip, city, {_DIST.format('town', 'city')} AS d
            FROM (SELECT DISTINCT town, zip FROM dirty WHERE town IS NOT NULL) k JOIN city_zips ON k.zip = city_zips.zip)
    SELECT town AS name, zip AS block, arg_min(city, ROW(d, city)) AS match, round(min(d), 9) AS distance
    FROM s WHERE d <= 0.35 GROUP BY ALL
    """,
)
def _in_block(t):
    rows = M.closest_in_block(part_towns(t), "town", "zip", gazetteer(t).city_zips, "city", "zip", "ordinal", 0.35)
    return rows.withColumn("distance", F.round("distance", 9))


@query(
    "match_alias_group",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL},
      a AS (SELECT DISTINCT town FROM dirty, areas WHERE {_DIST.format('town', 'area')} <= 0.2),
      z AS (SELECT DISTINCT zip FROM city_zips WHERE city = '{ANCHOR}')
    SELECT p_partkey, dirty.town, dirty.zip,
           CASE WHEN a.town IS NOT NULL AND z.zip IS NOT NULL THEN '{ANCHOR}' END AS match
    FROM dirty LEFT JOIN a ON dirty.town = a.town LEFT JOIN z ON dirty.zip = z.zip
    """,
)
def _alias(t):
    gaz, rows = gazetteer(t), part_towns(t).drop("p_name")
    near = M.closest(rows, "town", gaz.areas, "area", "ordinal", 0.2).select(F.col("name").alias("an"))
    zips = gaz.city_zips.filter(F.col("city") == ANCHOR).select(F.col("zip").alias("az")).distinct()
    return (
        rows.join(near, F.col("town") == F.col("an"), "left")
        .join(zips, F.col("zip") == F.col("az"), "left")
        .withColumn("match", F.when(F.col("an").isNotNull() & F.col("az").isNotNull(), F.lit(ANCHOR)))
        .drop("an", "az")
    )


@query(
    "match_unique_edit1",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL},
      s AS (SELECT name, city FROM (SELECT DISTINCT lower(town) AS name FROM dirty WHERE town IS NOT NULL), cities
            WHERE damerau_levenshtein(name, lower(city)) = 1)
    SELECT name, min(city) AS match FROM s GROUP BY name HAVING count(*) = 1
    """,
)
def _edit1(t):
    return M.only_one_edit_away(part_towns(t), "town", gazetteer(t).cities, "city", "ordinal")


_NORM_SQL = nested_rules(
    f"regexp_replace({title_sql('town')}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')", V.TOWN_NORMALISATION
)
_BLANKS = ", ".join("'" + b + "'" for b in V.BLANK_TOWNS)


def _ladder_sql(p: str, zip_code: str) -> str:
    """Tables ending in `m{p}` (town, zip, clean, match_stage) for the towns of `dirty` with this zip."""
    return f"""
      keys{p} AS (SELECT DISTINCT town, {zip_code} AS zip FROM dirty),
      n{p} AS (SELECT town, zip, CASE WHEN norm IN ({_BLANKS}) THEN NULL ELSE norm END AS norm
            FROM (SELECT *, {_NORM_SQL} AS norm FROM keys{p})),
      names{p} AS (SELECT DISTINCT norm FROM n{p} WHERE norm IS NOT NULL),
      s{p} AS (SELECT norm, city, in_cook, {_DIST.format('norm', 'city')} AS d,
                   damerau_levenshtein(lower(norm), lower(city)) = 1 AS one FROM names{p}, cities),
      best{p} AS (SELECT norm, min(d) AS any_d, arg_min(city, ROW(d, city)) AS any_city,
                      min(d) FILTER (in_cook) AS cook_d, arg_min(city, ROW(d, city)) FILTER (in_cook) AS cook_city,
                      count(*) FILTER (one) AS n_one, min(city) FILTER (one) AS one_city
               FROM s{p} GROUP BY norm),
      zs{p} AS (SELECT n.norm, n.zip, c.city, {_DIST.format('n.norm', 'c.city')} AS d
             FROM (SELECT DISTINCT norm, zip FROM n{p} WHERE norm IS NOT NULL) n JOIN city_zips c ON n.zip = c.zip),
      zb{p} AS (SELECT norm, zip, arg_min(city, ROW(d, city)) AS zip_city FROM zs{p} WHERE d <= 0.35 GROUP BY ALL),
      ar{p} AS (SELECT DISTINCT norm FROM names{p}, areas WHERE {_DIST.format('norm', 'area')} <= 0.2),
      az{p} AS (SELECT DISTINCT zip FROM city_zips WHERE city = '{ANCHOR}'),
      one_zip{p} AS (SELECT zip, min(city) AS only_city FROM city_zips GROUP BY zip HAVING count(*) = 1),
      st{p} AS (SELECT n.town, n.zip, n.norm, any_city, cook_city, one_city, zip_city, only_city,
               CASE WHEN n.norm IS NULL THEN 0
                    WHEN n.norm IN (SELECT city FROM cities) THEN 1
                    WHEN n.norm IN (SELECT area FROM areas) THEN 2
                    WHEN zip_city IS NOT NULL THEN 3
                    WHEN az.zip IS NOT NULL AND ar.norm IS NOT NULL THEN 33
                    WHEN any_d <= 0.05 THEN 4
                    WHEN n_one = 1 THEN 5
                    WHEN n.zip IS NOT NULL AND n.zip NOT IN (SELECT zip FROM state_zips) THEN CASE WHEN any_d <= 0.1 THEN 6 ELSE 66 END
                    WHEN cook_d <= 0.25 THEN 7
                    WHEN only_city IS NOT NULL THEN 8
                    WHEN any_d <= 0.2 THEN 9
                    ELSE 10 END AS code
             FROM n{p} n LEFT JOIN best{p} best ON n.norm = best.norm LEFT JOIN zb{p} zb ON n.norm = zb.norm AND n.zip = zb.zip
                    LEFT JOIN ar{p} ar ON n.norm = ar.norm LEFT JOIN az{p} az ON n.zip = az.zip
                    LEFT JOIN one_zip{p} one_zip ON n.zip = one_zip.zip),
      m{p} AS (SELECT town, zip,
              CASE code WHEN 1 THEN norm WHEN 2 THEN '{ANCHOR}' WHEN 33 THEN '{ANCHOR}' WHEN 3 THEN zip_city WHEN 4 THEN any_city
                        WHEN 5 THEN one_city WHEN 6 THEN any_city WHEN 7 THEN cook_city WHEN 8 THEN only_city WHEN 9 THEN any_city END AS clean,
              CAST(CASE code WHEN 33 THEN 3 WHEN 66 THEN 6 ELSE code END AS INTEGER) AS match_stage FROM st{p})"""


@query(
    "match_town",
    f"""
    WITH {LINE_TOWNS_SQL}, {LISTS_SQL}, {_ladder_sql('', 'zip')}
    SELECT l_orderkey, l_linenumber, l_partkey, dirty.town, dirty.zip, clean, match_stage
    FROM dirty JOIN m ON dirty.town IS NOT DISTINCT FROM m.town AND dirty.zip IS NOT DISTINCT FROM m.zip
    """,
)
def _match_town(t):
    return match_towns(line_towns(t), "town", "zip", gazetteer(t), anchor=ANCHOR)


_MEASURES = {
    "jw": "round(1 - jaro_similarity(name, city), 12)",
    "cosine": f"round({cosine_sql('name', 'city')}, 12)",
    # A swap that costs two edits is no swap.
    "osa": "levenshtein(name, city)",
}


def _method_sql(method: str) -> str:
    measure = _MEASURES[method]
    return f"""
      free_{method} AS (SELECT name, arg_min(city, ROW({measure}, city)) AS m
               FROM (SELECT DISTINCT name FROM k WHERE name IS NOT NULL), cities GROUP BY name),
      zip_{method} AS (SELECT name, k.zip, arg_min(city, ROW({measure}, city)) AS m
              FROM (SELECT DISTINCT name, zip FROM k WHERE name IS NOT NULL) k JOIN city_zips ON k.zip = city_zips.zip
              GROUP BY name, k.zip),
      with_{method} AS (SELECT f.town, f.zip, CASE WHEN is_area AND (has_anchor OR coalesce(listed, FALSE) = FALSE) THEN '{ANCHOR}'
              WHEN listed THEN z.m ELSE a.m END AS with_zip, CASE WHEN is_area THEN '{ANCHOR}' ELSE a.m END AS without
              FROM f LEFT JOIN zip_{method} z ON f.name = z.name AND f.zip = z.zip LEFT JOIN free_{method} a ON f.name = a.name)"""


@query(
    "match_method_compare",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL},
      k AS (SELECT DISTINCT town, zip, {title_sql('town')} AS name FROM dirty),
      f AS (SELECT k.*, k.zip IN (SELECT zip FROM city_zips) AS listed,
                   name IN (SELECT area FROM areas) AS is_area,
                   k.zip IN (SELECT zip FROM city_zips WHERE city = '{ANCHOR}') AS has_anchor FROM k),
      {_method_sql('jw')}, {_method_sql('cosine')}, {_method_sql('osa')},
      r AS (SELECT f.town, f.zip, f.name, j.with_zip AS jw, j.without AS jw_all, c.with_zip AS cosine, c.without AS cosine_all,
                   o.with_zip AS osa, o.without AS osa_all
            FROM f JOIN with_jw j ON f.town IS NOT DISTINCT FROM j.town AND f.zip IS NOT DISTINCT FROM j.zip
                   JOIN with_cosine c ON f.town IS NOT DISTINCT FROM c.town AND f.zip IS NOT DISTINCT FROM c.zip
                   JOIN with_osa o ON f.town IS NOT DISTINCT FROM o.town AND f.zip IS NOT DISTINCT FROM o.zip)
    SELECT town, zip, jw, jw_all, cosine, cosine_all, osa, osa_all, round(1 - jaro_similarity(name, jw_all), 9) AS jw_dist,
           round({cosine_sql('name', 'jw_all')}, 9) AS cos_dist FROM r
    """,
)
def _methods(t):
    rows = method_table(part_towns(t), "town", "zip", gazetteer(t), ANCHOR, weight=(1.0, 1.0, 1.0, 2.0))
    return rows.withColumns({c: F.round(c, 9) for c in ("jw_dist", "cos_dist")})


_WORDS_SQL = """
    words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) > 3),
    items AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) > 3)
"""


@query(
    "match_closest_words",
    f"""
    WITH {_WORDS_SQL},
      s AS (SELECT items.w AS name, words.w AS match, round(1 - jaro_similarity(items.w, words.w), 12) AS d FROM items, words)
    SELECT name, arg_min(match, ROW(d, match)) AS match, round(min(d), 9) AS distance FROM s WHERE d <= 0.1 GROUP BY name
    """,
)
def _closest_words(t):
    """The words of the benchmark against those of the documents, whose number grows with them."""
    def words(df):
        found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
        return df.select(found.alias("w")).distinct().filter("length(w) > 3")

    known = words(t.documents).select("w", F.col("w").alias("ordinal"))
    found = M.closest(words(t.benchmark), "w", known, "w", "ordinal", 0.1)
    return found.withColumn("distance", F.round("distance", 9))


def _all_words_sql(table: str) -> str:
    return f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS w FROM {table}"


# DuckDB compares bytes: accented letters count as one character when a capital stands for each.
_ACCENTED, _CAPITALS = "ßàáâäæçèéêëìíîïñòóôöùúûüÿœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALL_WORDS_SQL = ", ".join(
    f"{name} AS (SELECT w, translate(w, '{_ACCENTED}', '{_CAPITALS}') AS c FROM ({_all_words_sql(table)}))"
    for name, table in (("words", "documents"), ("items", "benchmark"))
)


@query(
    "match_closest_all_words",
    f"""
    WITH {_ALL_WORDS_SQL},
      s AS (SELECT items.w AS name, words.w AS match, round(1 - jaro_similarity(items.c, words.c), 12) AS d FROM items, words)
    SELECT name, arg_min(match, ROW(d, match)) AS match, round(min(d), 9) AS distance FROM s WHERE d <= 0.25 GROUP BY name
    """,
)
def _closest_all_words(t):
    """All words of the benchmark against all of the documents, at the operator's default threshold."""
    def words(df):
        found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
        return df.select(found.alias("w")).distinct()

    known = words(t.documents).select("w", F.col("w").alias("ordinal"))
    found = M.closest(words(t.benchmark), "w", known, "w", "ordinal")
    return found.withColumn("distance", F.round("distance", 9))


@query(
    "match_report",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL}, {_ladder_sql('', 'zip')}, {_ladder_sql('2', 'CAST(NULL AS VARCHAR)')},
      r AS (SELECT p_partkey, dirty.town, dirty.zip, m.clean AS wz, m2.clean AS nz FROM dirty
            JOIN m ON dirty.town IS NOT DISTINCT FROM m.town AND dirty.zip IS NOT DISTINCT FROM m.zip
            JOIN m2 ON dirty.town IS NOT DISTINCT FROM m2.town)
    SELECT p_partkey, wz AS clean_city_zip, nz AS clean_city,
           CASE WHEN wz IS NOT NULL AND r.zip IS NOT NULL THEN c.city IS NOT NULL END AS in_zip,
           coalesce(wz <> {title_sql('town')}, FALSE) OR (town IS NOT NULL AND wz IS NULL) AS changed,
           (wz IS NULL) <> (nz IS NULL) AS null_mismatch,
           wz IS DISTINCT FROM nz AS zip_matters,
           round(1 - jaro_similarity(town, wz), 9) AS distance_with_zip,
           round(1 - jaro_similarity(town, nz), 9) AS distance_without_zip
    FROM r LEFT JOIN city_zips c ON r.zip = c.zip AND r.wz = c.city
    """,
)
def _report(t):
    gaz = gazetteer(t)
    rows = match_towns(part_towns(t).drop("p_name"), "town", "zip", gaz, ANCHOR, "clean_city_zip", "stage")
    answers = match_towns(rows.drop("stage"), "town", None, gaz, ANCHOR, "clean_city", "stage").drop("stage")
    flags = match_report(answers, "town", "zip", "clean_city_zip", "clean_city", gaz.city_zips)
    return flags.select(
        "p_partkey", "clean_city_zip", "clean_city", "in_zip", "changed", "null_mismatch", "zip_matters",
        F.round("distance_with_zip", 9).alias("distance_with_zip"),
        F.round("distance_without_zip", 9).alias("distance_without_zip"),
    )


@query(
    "join_city_in_zip",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL}, r AS (SELECT *, {title_sql('town')} AS name FROM dirty)
    SELECT p_partkey, name, r.zip, CASE WHEN name IS NOT NULL AND r.zip IS NOT NULL THEN c.city IS NOT NULL END AS in_zip
    FROM r LEFT JOIN city_zips c ON r.zip = c.zip AND r.name = c.city
    """,
)
def _city_in_zip(t):
    rows = part_towns(t).select("p_partkey", title_case(F.col("town")).alias("name"), "zip")
    return city_in_zip(rows, "name", "zip", gazetteer(t).city_zips)


@query(
    "join_single_candidate",
    f"""
    WITH {PART_TOWNS_SQL}, {LISTS_SQL},
      one AS (SELECT zip, min(city) AS only_city FROM city_zips GROUP BY zip HAVING count(*) = 1)
    SELECT p_partkey, dirty.zip, only_city FROM dirty LEFT JOIN one ON dirty.zip = one.zip
    """,
)
def _single(t):
    one = single_city_zips(gazetteer(t).city_zips).withColumnRenamed("zip", "oz")
    return part_towns(t).select("p_partkey", "zip").join(one, F.col("zip") == F.col("oz"), "left").drop("oz")
