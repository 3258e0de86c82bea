"""Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import nested_rules, query, title_sql
from epilode.catalog.towns import PART_TOWNS_SQL, part_towns
from epilode.functions import codes, dates, fixed_values as V, measures, text
from epilode.functions import distance as D
from epilode.operators.ordered import label_levels


@query(
    "fn_mmwr_week",
    """
    WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
         w AS (SELECT *, day - CAST(dayofweek(day) AS INTEGER) AS ws FROM d)
    SELECT o_orderkey, ws AS week_start, ws + 6 AS week_end,
           CAST(year(ws + 3) AS INTEGER) AS week_year,
           CAST((dayofyear(ws + 3) - 1) // 7 + 1 AS INTEGER) AS week
    FROM w
    """,
)
def _mmwr(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        dates.week_start(day).alias("week_start"),
        dates.week_end(day).alias("week_end"),
        dates.week_year(day).alias("week_year"),
        dates.week_number(day).alias("week"),
    )


@query(
    "fn_suppress",
    """
    SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
           CASE WHEN count(*) > 0 AND count(*) < 5 THEN NULL ELSE count(*) END AS n_shown,
           CASE WHEN count(*) > 0 AND count(*) < 2 THEN NULL ELSE count(*) END AS n_shown_2
    FROM orders GROUP BY ALL
    """,
)
def _suppress(t):
    counts = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "o_custkey", "day", "n",
        measures.suppress_count(F.col("n")).alias("n_shown"),
        measures.suppress_count(F.col("n"), 2).alias("n_shown_2"),
    )


@query(
    "fn_rate",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_discount = 0 THEN NULL ELSE round_even(l_quantity / (l_discount * 100) * 100, 0) END AS rate_0,
           CASE WHEN l_tax = 0 THEN NULL ELSE round_even(l_quantity / (l_tax * 100) * 1000, 1) END AS rate_1
    FROM lineitem
    """,
)
def _rate(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        measures.rate(F.col("l_quantity"), F.col("l_discount") * 100, 100).alias("rate_0"),
        measures.rate(F.col("l_quantity"), F.col("l_tax") * 100, 1000, 1).alias("rate_1"),
    )


@query(
    "fn_age_band",
    """
    WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1.7 AS age FROM lineitem),
         x AS (SELECT *, CASE WHEN age < 20 THEN '< 20' WHEN age > 79 THEN '> 80'
                         WHEN age < 80 AND age > 19 THEN left(CAST(floor(age) AS INTEGER)::VARCHAR, 1) || '0s' END AS band
               FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, band,
           CAST(list_position(['< 20','20s','30s','40s','50s','60s','70s','> 80'], band) AS INTEGER) AS band_order
    FROM x
    """,
)
def _age(t):
    band = measures.age_band(F.col("l_quantity") * 1.7)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", band.alias("band"), measures.age_band_order(band).alias("band_order")
    )


_LEVELS = """
    WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice / 7500.5) AS INTEGER) AS c FROM lineitem),
         r AS (SELECT * EXCLUDE (c), CASE WHEN c BETWEEN 3 AND 5 THEN 3 ELSE c END AS code FROM c),
         s AS (SELECT code, round_even(code * 7500.5, 1) AS start FROM (SELECT DISTINCT code FROM r)),
         n AS (SELECT code, start, lead(start) OVER (ORDER BY code) AS nxt FROM s),
         f AS (SELECT code,
                 CASE WHEN start = floor(start) THEN CAST(CAST(start AS BIGINT) AS VARCHAR) ELSE CAST(start AS VARCHAR) END AS st,
                 round_even(nxt - 0.1, 1) AS en FROM n)
"""


@query(
    "fn_interval_label",
    _LEVELS
    + """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN en IS NULL THEN 'More than ' || st
                ELSE st || ' - ' || CASE WHEN en = floor(en) THEN CAST(CAST(en AS BIGINT) AS VARCHAR)
                                         ELSE CAST(en AS VARCHAR) END END AS pretty
    FROM r JOIN f USING (code)
    """,
)
def _interval(t):
    # Three bands made one: the codes have a gap.
    code = F.floor(F.col("l_extendedprice") / 7500.5).cast("int")
    code = F.when(code.between(3, 5), 3).otherwise(code)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code"))
    start = F.bround(F.col("code") * 7500.5, 1)
    levels = rows.select("code").distinct().withColumn(
        "interval", F.concat(F.lit("["), start.cast("string"), F.lit(","), F.bround(start + 7500.5, 1).cast("string"), F.lit(")"))
    )
    labels = label_levels(levels).select("code", "pretty")
    return rows.join(labels, "code").select("l_orderkey", "l_linenumber", "l_partkey", "pretty")


@query(
    "fn_name_key",
    r"""
    SELECT c_custkey,
           regexp_replace(upper(c_mktsegment || ' o''' || c_name || ' jr. x'), ' JR| SR| [0-9A-Za-z_]$|[^0-9A-Za-z_]', '', 'g') AS name_key,
           regexp_replace(upper(c_name || '-' || c_mktsegment || ' Sr'), ' JR| SR| [0-9A-Za-z_]$|[^0-9A-Za-z_]', '', 'g') AS name_key_2
    FROM customer
    """,
)
def _name_key(t):
    return t.customer.select(
        "c_custkey",
        text.name_key(F.concat("c_mktsegment", F.lit(" o'"), "c_name", F.lit(" jr. x"))).alias("name_key"),
        text.name_key(F.concat("c_name", F.lit("-"), "c_mktsegment", F.lit(" Sr"))).alias("name_key_2"),
    )


_TOWN_SQL = nested_rules("regexp_replace(raw, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')", V.TOWN_CORRECTIONS)


@query(
    "fn_town_rules",
    f"""
    WITH r AS (SELECT conv_id, turn, text AS raw FROM conversations
               UNION ALL SELECT -1 - p_partkey, 0, ' ' || p_brand || ' Pk, Il  Hts. Cicerocicero Elk Grove' FROM part)
    SELECT conv_id, turn, {_TOWN_SQL} AS cleaned FROM r
    """,
)
def _town_rules(t):
    made = t.part.select(
        (-1 - F.col("p_partkey")).alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
        F.concat(F.lit(" "), "p_brand", F.lit(" Pk, Il  Hts. Cicerocicero Elk Grove")).alias("text"),
    )
    rows = t.conversations.select("conv_id", "turn", "text").unionByName(made)
    return rows.select("conv_id", "turn", text.correct_town(F.col("text")).alias("cleaned"))


_PRENORM_SQL = nested_rules(
    f"regexp_replace({title_sql('raw')}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')", V.TOWN_NORMALISATION
)


@query(
    "fn_town_prenorm",
    f"""
    WITH r AS (SELECT p_partkey, unnest([p_name || ' hts', 'n ' || p_name || ' il', p_brand || ' vlg. e',
                                         'mt ' || p_type || ' spgs', 'argo chgo ' || p_name, 's. w. ' || p_name || ',  pk so']) AS raw
               FROM part)
    SELECT p_partkey, raw, {_PRENORM_SQL} AS town FROM r
    """,
)
def _prenorm(t):
    raws = F.array(
        F.concat("p_name", F.lit(" hts")),
        F.concat(F.lit("n "), "p_name", F.lit(" il")),
        F.concat("p_brand", F.lit(" vlg. e")),
        F.concat(F.lit("mt "), "p_type", F.lit(" spgs")),
        F.concat(F.lit("argo chgo "), "p_name"),
        F.concat(F.lit("s. w. "), "p_name", F.lit(",  pk so")),
    )
    rows = t.part.select("p_partkey", F.explode(raws).alias("raw"))
    return rows.select("p_partkey", "raw", text.normalise_town(F.col("raw")).alias("town"))


@query(
    "fn_title",
    r"""
    SELECT conv_id, turn,
           list_aggregate(list_transform(
             regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+([''.:][\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*)*|[^\p{L}\p{M}\p{N}_]+'),
             lambda w: CASE WHEN left(w, 1) = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END || substr(w, 2)), 'string_agg', '') AS titled
    FROM conversations
    """,
)
def _title(t):
    return t.conversations.select("conv_id", "turn", text.title_case(F.col("text")).alias("titled"))


def _bounded(expr: str, word: str, full: str) -> str:
    # RE2 has no Unicode word boundary: match the neighbours and put them back.
    once = "regexp_replace({0}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){1}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{2}\\2', 'g')"
    for _ in range(2):
        expr = once.format(expr, word, full)
    return expr


def _address_sql(expr: str) -> str:
    expr = f"replace(upper({expr}), '.', '')"
    for word, full in V.ADDRESS_WORDS:
        expr = _bounded(expr, word, full)
    expr = f"regexp_replace({expr}, '{V.ADDRESS_UNIT}', '', 'g')"
    return f"regexp_replace({expr}, '{V.ZIP_PLUS_FOUR}', '', 'g')"


@query(
    "fn_address",
    f"""
    WITH a AS (SELECT c_custkey, c_custkey || ' n. ' || c_mktsegment || ' st apt ' || c_nationkey || ' se ' || c_name
                      || ' Blvd #' || c_nationkey || ' 60601-' || lpad(c_nationkey::VARCHAR, 4, '0') AS a FROM customer)
    SELECT c_custkey, {_address_sql('a')} AS address FROM a
    """,
)
def _address(t):
    raw = F.concat(
        F.col("c_custkey").cast("string"), F.lit(" n. "), "c_mktsegment", F.lit(" st apt "),
        F.col("c_nationkey").cast("string"), F.lit(" se "), "c_name", F.lit(" Blvd #"),
        F.col("c_nationkey").cast("string"), F.lit(" 60601-"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"),
    )
    return t.customer.select("c_custkey", text.clean_address(raw).alias("address"))


@query(
    "fn_city_state_split",
    """
    SELECT s_suppkey, n_name AS city, r_name AS state, CAST(s_suppkey AS VARCHAR) AS zip
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def _city_state(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    raw = F.concat_ws(", ", "n_name", "r_name")
    zip9 = F.concat(F.col("s_suppkey").cast("string"), F.lit("-"), F.col("s_nationkey").cast("string"))
    return rows.select(
        "s_suppkey", text.city_part(raw).alias("city"), text.state_part(raw).alias("state"), text.zip5(zip9).alias("zip")
    )


@query(
    "fn_strip_parens",
    r"""
    SELECT page_id, regexp_replace(regexp_replace(html, '\s*\([^)]+\)', '', 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS plain
    FROM pages
    UNION ALL
    SELECT -1 - o_orderkey, o_orderpriority || ' ' || o_orderkey AS plain FROM orders
    """,
)
def _parens(t):
    made = t.orders.select(
        (-1 - F.col("o_orderkey")).alias("page_id"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" (x, y) "), F.col("o_orderkey").cast("string"),
                 F.lit("  ("), "o_orderstatus", F.lit(")")).alias("html"),
    )
    rows = t.pages.select("page_id", "html").unionByName(made)
    return rows.select("page_id", text.strip_parens(F.col("html")).alias("plain"))


@query(
    "fn_parse_datetime",
    """
    SELECT event_id, date_trunc('minute', ts) AS with_time, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date_only,
           CAST(NULL AS TIMESTAMP) AS unreadable
    FROM events
    """,
)
def _parse(t):
    return t.events.select(
        "event_id",
        dates.parse_report_datetime(F.date_format("ts", "M/d/yyyy h:mm a")).alias("with_time"),
        dates.parse_report_datetime(F.date_format("ts", "M/d/yyyy")).alias("date_only"),
        dates.parse_report_datetime(F.col("event_type")).alias("unreadable"),
    )


@query(
    "fn_feed_date",
    "SELECT o_orderkey, strftime(o_orderdate, '%d%b%Y') AS feed_date FROM orders",
)
def _feed_date(t):
    return t.orders.select("o_orderkey", dates.feed_date(F.col("o_orderdate")).alias("feed_date"))


@query(
    "fn_feed_url",
    """
    SELECT o_orderkey,
           'https://feed/' || o_orderstatus || '?endDate=02Jan2024&id=' || o_orderkey || '&startDate=' || strftime(o_orderdate, '%d%b%Y') || '&x=1' AS url,
           'https://feed/?startDate=' || strftime(o_orderdate, '%d%b%Y') || '&endDate=1' AS url_last
    FROM orders
    """,
)
def _feed_url(t):
    url = F.concat(F.lit("https://feed/"), "o_orderstatus", F.lit("?endDate=1&id="),
                   F.col("o_orderkey").cast("string"), F.lit("&startDate=2&x=1"))
    day = dates.feed_date(F.col("o_orderdate"))
    return t.orders.select(
        "o_orderkey",
        codes.set_feed_window(url, day, F.lit("02Jan2024")).alias("url"),
        codes.set_feed_window(F.lit("https://feed/?startDate=9&endDate=1"), day, F.lit("02Jan2024")).alias("url_last"),
    )


@query(
    "fn_acs_url",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'muni' ELSE 'zcta' END AS g, p_brand AS place,
                      p_type AS v, p_size > 10 AS grp, p_retailprice > 950 AS inc FROM part)
    SELECT p_partkey,
           CASE WHEN NOT (g = 'zcta' AND inc) THEN
             'base?get=NAME,GEO_ID,' || CASE WHEN grp THEN 'group(' || v || ')' ELSE v END ||
             CASE WHEN g = 'muni' AND inc THEN '&for=county%20(or%20part):031&in=state:17%20place:' || place
                  WHEN g = 'muni' THEN '&for=place:' || place || '&in=state:17'
                  ELSE '&for=zip%20code%20tabulation%20area:' || place END END AS url,
           CASE WHEN g = 'zcta' AND inc THEN 'Partial ZCTA populations are not available.' END AS error
    FROM p
    """,
)
def _acs_url(t):
    url, error = codes.census_url(
        F.lit("base"), F.when(F.col("p_size") <= 25, F.lit("muni")).otherwise(F.lit("zcta")), F.col("p_brand"),
        F.col("p_type"), F.col("p_size") > 10, F.col("p_retailprice") > 950,
    )
    return t.part.select("p_partkey", url.alias("url"), error.alias("error"))


@query(
    "fn_geocode_url",
    f"""
    SELECT c_custkey,
           replace('svc?Address=' || c_name || ' st&City=' || c_mktsegment || '&Postal=' || c_nationkey || '&outSR=3435{V.GEOCODE_OPTIONS}', ' ', '+') AS url,
           'svc?Street=&City=&SingleLine=' || c_name || ' st&outSR=4326{V.GEOCODE_OPTIONS_ONE_LINE}' AS url_one_line
    FROM customer
    """,
)
def _geocode_url(t):
    street = F.concat("c_name", F.lit(" st"))
    return t.customer.select(
        "c_custkey",
        codes.geocode_url(F.lit("svc"), street, F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("url"),
        codes.geocode_url_one_line(F.lit("svc"), street, 4326).alias("url_one_line"),
    )


_RACE_CASE = "\n".join(f"WHEN race = '{code}' THEN '{label}'" for code, label in V.RACE_LABELS)


def _race_columns():
    # Codes put together from the event's own fields.
    race = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_type") == "click", F.concat(F.lit(";2106-3;"), F.when(F.col("user_id") > 50, F.lit("UNK;")).otherwise(F.lit(""))))
        .when(F.col("event_type") == "view", F.lit(";2106-3;2054-5;"))
        .when(F.col("event_type") == "signup", F.when(F.col("value") > 50, F.lit(";2028-9;NR;")).otherwise(F.lit(";UNK;")))
        .otherwise(F.when(F.col("value") > 20, F.lit(";1002-5;")).otherwise(F.lit(";9999;")))
    )
    ethnicity = F.when(F.col("value") > 100, F.lit(";2135-2;UNK;")).when(F.col("value") > 1, F.lit(";2186-5;"))
    return race, ethnicity


@query(
    "fn_race_eth",
    f"""
    WITH e AS (SELECT event_id,
                 CASE WHEN event_type = 'error' THEN NULL
                      WHEN event_type = 'click' THEN ';2106-3;' || CASE WHEN user_id > 50 THEN 'UNK;' ELSE '' END
                      WHEN event_type = 'view' THEN ';2106-3;2054-5;'
                      WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN ';2028-9;NR;' ELSE ';UNK;' END
                      ELSE CASE WHEN value > 20 THEN ';1002-5;' ELSE ';9999;' END END AS rf,
                 CASE WHEN value > 100 THEN ';2135-2;UNK;' WHEN value > 1 THEN ';2186-5;' END AS ef
               FROM events),
         r AS (SELECT *, regexp_replace(rf, ';UNK|;PHC1175|;NR', '', 'g') AS race FROM e)
    SELECT event_id, CASE WHEN ef LIKE '%;2135-2;%' THEN 'Hispanic/Latino' {_RACE_CASE}
                          WHEN regexp_matches(race, ';.*;.*;') THEN 'Non-Hispanic Multiple Races'
                          ELSE 'Unknown' END AS race_eth
    FROM r
    """,
)
def _race(t):
    race, ethnicity = _race_columns()
    return t.events.select("event_id", codes.race_ethnicity(race, ethnicity).alias("race_eth"))


@query(
    "fn_split_last",
    """
    SELECT event_id, left(event_type, length(event_type) - 1) AS stem, right(event_type, 1) AS kind,
           left(event_type, length(event_type) - 1) || 'E' AS variable
    FROM events
    """,
)
def _split(t):
    stem, kind = text.split_last(F.col("event_type"))
    return t.events.select("event_id", stem.alias("stem"), kind.alias("kind"), F.concat(stem, F.lit("E")).alias("variable"))


@query(
    "fn_label_parse",
    """
    WITH l AS (SELECT p_partkey, 'Estimate!!Total' || CASE WHEN p_type = 'ECONOMY' THEN '' WHEN p_size > 25 THEN '!!Male' ELSE '!!Female' END
                      || CASE WHEN p_size > 40 THEN '!!' || p_brand ELSE '' END AS label FROM part),
         a AS (SELECT *, regexp_replace(label, '^.*!!', '') AS last FROM l)
    SELECT p_partkey, CASE WHEN label LIKE '%Male%' THEN 'Male' WHEN label LIKE '%Female%' THEN 'Female' ELSE 'Total' END AS sex,
           CASE WHEN last IN ('Total', 'Male', 'Female') THEN 'Total' ELSE last END AS age
    FROM a
    """,
)
def _label(t):
    label = F.concat(
        F.lit("Estimate!!Total"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("")).when(F.col("p_size") > 25, F.lit("!!Male")).otherwise(F.lit("!!Female")),
        F.when(F.col("p_size") > 40, F.concat(F.lit("!!"), "p_brand")).otherwise(F.lit("")),
    )
    return t.part.select("p_partkey", codes.label_sex(label).alias("sex"), codes.label_age(label).alias("age"))


@query(
    "fn_substr_geoid",
    """
    SELECT o_orderkey, substr(lpad(o_orderkey::VARCHAR, 9, '0'), 3, 5) AS zip,
           '17' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || lpad(o_orderkey::VARCHAR, 6, '0') AS geoid
    FROM orders
    """,
)
def _geoid(t):
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        "o_orderkey", F.substring(F.lpad(key, 9, "0"), 3, 5).alias("zip"),
        F.concat(F.lit("17"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lpad(key, 6, "0")).alias("geoid"),
    )


@query(
    "fn_case_fold",
    r"""
    SELECT doc_id, lower(text) AS low, replace(upper(replace(text, 'ß', 'SS')), 'ẞ', 'SS') AS up,
           regexp_replace(E' \t' || text || E'\r\n ', '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS trimmed FROM documents
    """,
)
def _fold(t):
    return t.documents.select(
        "doc_id", F.lower("text").alias("low"), F.upper("text").alias("up"),
        text.trim_blanks(F.concat(F.lit(" \t"), "text", F.lit("\r\n "))).alias("trimmed"),
    )


@query(
    "fn_date_shift",
    """
    WITH b AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a,
                      min(CAST(o_orderdate AS DATE)) + CAST(count(*) AS INTEGER) AS z FROM orders GROUP BY o_custkey),
         g AS (SELECT o_custkey, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b)
    SELECT o_custkey, CAST(d AS DATE) AS day, CAST(d AS DATE) + 1 AS day_after, CAST(d AS DATE) - 1 AS day_before FROM g
    """,
)
def _shift(t):
    spans = t.orders.groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("a"), F.count(F.lit(1)).cast("int").alias("n")
    )
    days = spans.select("o_custkey", dates.daily_grid(F.col("a"), F.date_add("a", F.col("n"))).alias("day"))
    return days.select("o_custkey", "day", F.date_add("day", 1).alias("day_after"), F.date_sub("day", 1).alias("day_before"))


@query(
    "fn_normalize_flow",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round(l_extendedprice * l_quantity * CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 6) AS norm
    FROM lineitem
    """,
)
def _flow(t):
    norm = measures.normalize_flow(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(norm, 6).alias("norm"))


_PAIRS_SQL = f"WITH {PART_TOWNS_SQL}, d AS (SELECT DISTINCT p_name AS a, town AS b FROM dirty WHERE town IS NOT NULL) "


def _name_pairs(t):
    # Every name with its own misspelling.
    return part_towns(t).filter("town is not null").select(F.col("p_name").alias("a"), F.col("town").alias("b")).distinct()


@query("fn_jaro", _PAIRS_SQL + "SELECT a, b, round(1 - jaro_similarity(a, b), 9) AS distance FROM d")
def _jaro(t):
    return _name_pairs(t).select("a", "b", F.round(D.jaro(F.col("a"), F.col("b")), 9).alias("distance"))


@query(
    "fn_osa",
    # Equal to the unrestricted distance here: no pair edits within a swap.
    _PAIRS_SQL + """SELECT a, b, CAST(damerau_levenshtein(a, b) AS DOUBLE) AS distance,
      CAST(levenshtein(a, b) AS DOUBLE) AS without_swaps FROM d""",
)
def _osa(t):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(t).select("a", "b", D.osa(a, b).alias("distance"), D.osa(a, b, transposition=9.0).alias("without_swaps"))


_CNT = "CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE)"
_DOT = "list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: " + _CNT + " * " + _CNT.replace("{0}", "{1}") + "))"


def cosine_sql(a: str, b: str) -> str:
    """SQL text for the cosine distance of character counts."""
    return f"1 - {_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}))"


@query("fn_cosine_qgram", _PAIRS_SQL + f"SELECT a, b, round({cosine_sql('a', 'b')}, 9) AS distance FROM d")
def _cosine(t):
    return _name_pairs(t).select("a", "b", F.round(D.cosine(F.col("a"), F.col("b")), 9).alias("distance"))


@query(
    "fn_area_units",
    """
    SELECT p_partkey, round(p_retailprice * 1000000 / 27878400.0, 9) AS land_sqmi,
           round(p_size * 1000000 / 2589988.110336, 9) AS water_sqmi_from_m2,
           round((p_retailprice + p_size) * 1000000 / 27878400.0, 9) AS total_sqmi
    FROM part
    """,
)
def _area_units(t):
    land, water = F.col("p_retailprice") * 1000000, F.col("p_size").cast("double") * 1000000
    return t.part.select(
        "p_partkey",
        F.round(measures.area_sqmi(land), 9).alias("land_sqmi"),
        F.round(measures.area_sqmi(water, "m2"), 9).alias("water_sqmi_from_m2"),
        F.round(measures.area_sqmi(land) + measures.area_sqmi(water), 9).alias("total_sqmi"),
    )
