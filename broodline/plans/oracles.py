"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

# --- shared table expressions ------------------------------------------------

CYCLE_DAILY = """
daily AS (
    SELECT user_id AS unit,
           CAST(date_trunc('week', ts) AS DATE) AS cycle_start,
           CAST(ts AS DATE) AS obs_date,
           count(*) FILTER (WHERE event_type = 'error') AS depletion,
           count(*) FILTER (WHERE event_type = 'purchase') AS harvest,
           sum(CAST(value AS DECIMAL(18,2))) AS feed
    FROM events
    GROUP BY ALL
),
counted AS (
    SELECT unit, cycle_start, obs_date,
           CAST(date_diff('day', cycle_start, obs_date) + 1 AS INTEGER) AS age,
           CAST(1000 + unit % 50 AS BIGINT) AS initial_pop,
           CAST(sum(depletion) OVER w AS BIGINT) AS cum_depletion,
           CAST(sum(harvest) OVER w AS BIGINT) AS cum_harvest,
           CAST(sum(feed) OVER w AS DOUBLE) AS cum_feed
    FROM daily
    WINDOW w AS (PARTITION BY unit, cycle_start ORDER BY obs_date)
),
weighed AS (
    SELECT *, CAST(initial_pop - cum_depletion - cum_harvest AS BIGINT) AS pop_end,
           CAST(40 + 55 * age + unit % 7 AS DOUBLE) AS bw
    FROM counted
),
cycle_daily AS (
    SELECT *, cum_feed / (bw * initial_pop / 1000) AS fcr,
           cum_depletion * 100.0 / initial_pop AS total_depletion
    FROM weighed
)"""

CYCLE_METRICS = (
    CYCLE_DAILY
    + """,
lagged AS (
    SELECT *,
           cum_harvest - lag(cum_harvest) OVER w AS harvest_daily,
           bw - lag(bw) OVER w AS adg,
           bw * (pop_end + cum_harvest) / 1000 AS total_bw
    FROM cycle_daily
    WINDOW w AS (PARTITION BY unit, cycle_start ORDER BY age)
),
ratios AS (
    SELECT *,
           CASE WHEN total_bw = 0 THEN 0 ELSE cum_feed / total_bw END AS fcr_calc,
           CASE WHEN harvest_daily = 0 THEN 0 ELSE age * harvest_daily END AS catch_age_daily
    FROM lagged
),
metrics AS (
    SELECT *,
           CAST(sum(catch_age_daily) OVER w AS BIGINT) AS catch_age_cum,
           CASE WHEN harvest_daily > 0
                THEN avg(age) FILTER (WHERE harvest_daily > 0) OVER w
                ELSE age END AS harvest_age
    FROM ratios
    WINDOW w AS (PARTITION BY unit, cycle_start ORDER BY age)
),
cycle_metrics AS (
    SELECT *,
           CASE WHEN fcr_calc = 0 THEN 0
                ELSE (100 - total_depletion) * bw * 0.1 / nullif(fcr_calc * harvest_age, 0)
           END AS ip_quick
    FROM metrics
)"""
)

UNIT_DIM = """
unit_dim AS (
    SELECT c_custkey AS unit, c_mktsegment AS officer, n_name AS manager, r_name AS area,
           CASE WHEN c_acctbal < 3000 THEN 'partner' ELSE 'own' END AS partnership
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
)"""

MONITORED = """
monitored AS (
    SELECT DISTINCT user_id AS unit_name, CAST(date_trunc('week', ts) AS DATE) AS start_date,
           CAST(isodow(ts) AS INTEGER) AS day_age,
           CAST(date_diff('day', DATE '2024-01-01', CAST(date_trunc('week', ts) AS DATE)) // 7 + 1
                AS INTEGER) AS period
    FROM events
    WHERE event_type IN ('view', 'click')
)"""

SALES = """
sales AS (
    SELECT user_id AS unit, CAST(ts AS DATE) AS sale_date,
           CAST(value AS DECIMAL(18,2)) AS kg, 1 + event_id % 3 AS birds,
           CAST(value AS DECIMAL(18,2)) * 20 AS amount, 800 + event_id % 1500 AS weight
    FROM events
    WHERE event_type = 'purchase'
),
daily_sales AS (
    SELECT unit, sale_date, CAST(sum(kg) AS DOUBLE) AS kg, CAST(sum(birds) AS BIGINT) AS birds,
           CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(weight) AS BIGINT) AS weight
    FROM sales
    WHERE amount > 0 OR kg > 0
    GROUP BY unit, sale_date
)"""

STANDARD = """
standard AS (
    SELECT CAST(a AS INTEGER) AS age, (40 + 55 * a) / 1000 AS bw_std, CAST(0.055 AS DOUBLE) AS adg_std,
           1 + a / 10 AS fcr_std, a / 500 AS mortality_std
    FROM range(1, 7) AS r(a)
)"""

CYCLE_HEAD = (
    UNIT_DIM
    + """,
cycles AS (
    SELECT user_id AS unit, CAST(date_trunc('week', ts) AS DATE) AS cycle_start,
           count(*) FILTER (WHERE event_type = 'error') AS errors,
           max(isodow(ts)) AS last_age
    FROM events
    GROUP BY ALL
),
cycle_head AS (
    SELECT unit, cycle_start,
           CASE WHEN unit % 13 = 0 THEN NULL ELSE 'D' || CAST(unit % 5 AS VARCHAR) END AS doc,
           area AS hatchery,
           CASE WHEN unit % 19 = 0 THEN NULL ELSE officer END AS feed,
           CAST(CASE WHEN unit % 37 = 0 THEN NULL WHEN unit % 29 = 0 THEN 0 ELSE 40 + unit % 7 END
                AS DOUBLE) AS bw_0,
           CAST(40 + 55 * last_age AS DOUBLE) AS bw_8,
           errors / 8.0 AS mortality_8
    FROM cycles JOIN unit_dim USING (unit)
)"""
)

BRANDS = ["click", "view", "error", "signup", "purchase"]
PHASES = ["p1", "p2", "p3"]
DAYS = range(1, 8)

FEED_EVENTS = """
feed_events AS (
    SELECT user_id AS unit, CAST(date_trunc('week', ts) AS DATE) AS cycle_start,
           isodow(ts) AS day, event_type AS brand,
           CASE WHEN hour(ts) < 8 THEN 'p1' WHEN hour(ts) < 16 THEN 'p2' ELSE 'p3' END AS phase,
           CAST(value AS DECIMAL(18,2)) AS value
    FROM events
)"""

DOCS = """
docs AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

PRICED_LINES = """
lines AS (
    SELECT CAST(l_shipdate AS DATE) AS day, p_brand, p_type, l_extendedprice AS y,
           CASE WHEN p_partkey % 10 <> 0 THEN (p_retailprice - 900) * 120 + 1000 END AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def month_week(day: str) -> str:
    return (
        f"CAST(ceil((day({day}) + isodow(date_trunc('month', {day})) - 1) / 7.0) AS INTEGER)"
    )


def bucketed(source: str, name: str) -> str:
    """Calendar bucket columns for every row of ``source``."""
    return f"""
{name} AS (
    SELECT *, CAST(isoyear(day) AS INTEGER) AS year, strftime(day, '%b') AS month,
           {month_week("day")} AS week_of_month
    FROM {source}
)"""


def correlations(member_tables: str, rows: str, members: str) -> str:
    """Correlation by the textbook: an explicit 0/1 column per bucket and feature.

    ``rows`` has one row per observation (id, bucket, y), ``members`` one row per
    observation and feature.
    """
    return f"""
WITH {member_tables},
present AS (SELECT DISTINCT year, month, week_of_month, feature FROM {members}),
matrix AS (
    SELECT p.year, p.month, p.week_of_month, p.feature, r.y,
           CASE WHEN m.id IS NULL THEN 0 ELSE 1 END AS x
    FROM present p
    JOIN {rows} r USING (year, month, week_of_month)
    LEFT JOIN {members} m ON m.id = r.id AND m.feature = p.feature
)
SELECT year, month, week_of_month, feature, count(*) AS n,
       CAST(sum(x) AS BIGINT) AS n_feature,
       CASE WHEN count(DISTINCT x) = 2 AND count(DISTINCT y) > 1
            THEN round(corr(x, y), 3) + 0.0 END AS r
FROM matrix
GROUP BY ALL"""


LINE_MEMBERS = (
    PRICED_LINES
    + ","
    + bucketed("(SELECT row_number() OVER () AS id, * FROM lines)", "rows_")
    + """,
members AS (
    SELECT id, year, month, week_of_month, p_brand AS feature FROM rows_
    UNION ALL
    SELECT id, year, month, week_of_month, p_brand || '__' || p_type FROM rows_
)"""
)

PRICE_LABEL = """CASE WHEN price < 2000 THEN ' < 2000' WHEN price < 4000 THEN '2000 - 4000'
    WHEN price < 6000 THEN '4000 - 6000' WHEN price < 8000 THEN '6000 - 8000'
    WHEN price < 10000 THEN '8000 - 10000' WHEN price <= 12000 THEN '10000 - 12000'
    WHEN price > 12000 THEN '> 12000' END"""

PRICE_MEMBERS = (
    PRICED_LINES
    + """,
filled AS (
    SELECT day, p_brand, y, coalesce(price, (SELECT median(price) FROM lines)) AS price FROM lines
),"""
    + bucketed("(SELECT row_number() OVER () AS id, * FROM filled)", "rows_")
    + f""",
members AS (
    SELECT id, year, month, week_of_month, p_brand || '_' || {PRICE_LABEL} AS feature FROM rows_
)"""
)

HEAD_MEMBERS = (
    CYCLE_HEAD
    + """,
kept AS (
    SELECT cycle_start AS day, doc, hatchery, round(mortality_8 * 100, 4) AS y
    FROM cycle_head
    WHERE round(mortality_8 * 100, 4) <= 100 AND doc IS NOT NULL AND hatchery IS NOT NULL
),"""
    + bucketed("(SELECT row_number() OVER () AS id, * FROM kept)", "rows_")
    + """,
members AS (
    SELECT id, year, month, week_of_month, doc AS feature FROM rows_
    UNION ALL
    SELECT id, year, month, week_of_month, doc || '__' || hatchery FROM rows_
)"""
)

FEED_MEMBERS = (
    FEED_EVENTS
    + """,
outcomes AS (
    SELECT unit, cycle_start AS day, CAST(sum(value) AS DOUBLE) AS y
    FROM feed_events GROUP BY ALL
),
leaders AS (
    SELECT DISTINCT arg_max(brand, (n, brand)) OVER (PARTITION BY unit, cycle_start) AS leader
    FROM (SELECT unit, cycle_start, brand, count(*) AS n FROM feed_events GROUP BY ALL)
),"""
    + bucketed("(SELECT row_number() OVER () AS id, * FROM outcomes)", "rows_")
    + """,
used AS (
    SELECT DISTINCT unit, cycle_start, brand, brand AS feature FROM feed_events
    UNION
    SELECT DISTINCT unit, cycle_start, brand, phase || '_' || brand FROM feed_events
),
members AS (
    SELECT id, year, month, week_of_month, feature
    FROM rows_ r JOIN used u ON u.unit = r.unit AND u.cycle_start = r.day
    WHERE brand IN (SELECT leader FROM leaders)
)"""
)


def scorecard(group: str, required: list[str], shown: list[str], chicks: bool) -> str:
    """Newest seven rows per group as max(CASE rank) columns."""
    mortality = "round(round(mortality_8 * 100, 4), 2)" if chicks else "round(mortality_8, 2)"
    keep = " AND ".join(f"{c} IS NOT NULL" for c in required)
    if chicks:
        keep += " AND round(mortality_8 * 100, 4) <= 100"
    cells = ", ".join(
        f"max(CASE WHEN rn = {i} THEN {c} END) AS {c}_{i}" for i in range(1, 8) for c in shown
    )
    return f"""
WITH {CYCLE_HEAD},
ranked AS (
    SELECT {group} AS grp, unit, cycle_start, doc, hatchery, feed, {mortality} AS mortality_8,
           round(bw_0, 2) AS bw_0, round(bw_8, 2) AS bw_8,
           round(round(bw_8 / nullif(bw_0, 0), 1), 2) AS growth,
           row_number() OVER (PARTITION BY {group} ORDER BY cycle_start DESC, unit) AS rn
    FROM cycle_head
    WHERE {keep}
)
SELECT grp, {cells} FROM ranked WHERE rn <= 7 GROUP BY grp"""


SHOWN = ["cycle_start", "unit", "mortality_8", "bw_0", "bw_8", "growth"]


def replaced(column: str, rules: list[tuple[str, str]]) -> str:
    for old, new in rules:
        column = f"replace({column}, '{old}', '{new}')"
    return column


def performance_report(where_cycle: str, where_unit: str, where_monitored: str) -> str:
    """The report with its two branches joined on the cycle day."""
    scoped = CYCLE_METRICS.replace("FROM cycle_daily\n", f"FROM cycle_daily {where_cycle}\n")
    return f"""
WITH {scoped}, {UNIT_DIM}, {MONITORED}, {SALES}, {STANDARD},
days AS (
    SELECT c.*, u.officer, u.manager, u.area, m.period
    FROM cycle_metrics c
    JOIN (SELECT * FROM unit_dim {where_unit}) u USING (unit)
    JOIN (SELECT * FROM monitored {where_monitored}) m
      ON c.unit = m.unit_name AND c.cycle_start = m.start_date AND c.age = m.day_age
),
sold AS (
    SELECT d.*, coalesce(s.kg, 0) AS sold_kg, coalesce(s.birds, 0) AS sold_birds
    FROM days d LEFT JOIN daily_sales s ON d.unit = s.unit AND d.obs_date = s.sale_date
),
summed AS (
    SELECT *, sum(CAST(sold_kg AS DECIMAL(18,2))) OVER w + pop_end * bw / 1000 AS total_kg,
           sum(age * sold_birds) OVER w + age * pop_end AS age_total,
           initial_pop - cum_depletion AS living
    FROM sold
    WINDOW w AS (PARTITION BY unit, cycle_start ORDER BY age)
),
indexed AS (
    SELECT unit, cycle_start, age,
           CASE WHEN cum_feed / total_kg = 0 THEN 0
                ELSE (living / initial_pop * (total_kg / living * 1000))
                     / (cum_feed / total_kg * (age_total / living)) * 10 END AS ip
    FROM summed
    WHERE bw > 0 AND initial_pop > 0 AND total_kg > 0
)
SELECT d.unit, d.cycle_start, d.period, d.obs_date, d.age,
       round(d.bw, 6) AS bw_actual, round(s.bw_std * 1000, 6) AS bw_standard,
       round(d.adg, 6) AS adg_actual, round(s.adg_std * 1000, 6) AS adg_standard,
       round(d.fcr, 6) AS fcr_actual, round(s.fcr_std, 6) AS fcr_standard,
       round(d.total_depletion, 6) AS depletion_actual,
       round(s.mortality_std * 100, 6) AS mortality_standard,
       d.officer, d.manager, d.area, round(i.ip, 6) AS ip
FROM days d
LEFT JOIN standard s ON d.age = s.age
LEFT JOIN indexed i ON d.unit = i.unit AND d.cycle_start = i.cycle_start AND d.age = i.age"""


def fuzzy(left: str, right: str, columns: str, name: str, threshold: float, limit: int) -> str:
    """All pairs of names, scored and ranked; ``right`` may repeat names."""
    clean = "trim(lower(regexp_replace({}, '[^a-zA-Z0-9_]', ' ', 'g')))"
    a, b = clean.format("l.name"), clean.format("r.name")
    return f"""
WITH lefts AS ({left}), rights AS ({right}),
pairs AS (
    SELECT l.name AS a, r.name AS b,
           100.0 * (greatest(length({a}), length({b})) - levenshtein({a}, {b}))
               / greatest(length({a}), length({b})) AS score
    FROM (SELECT DISTINCT {name} AS name FROM lefts) l, rights r
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn
    FROM pairs WHERE score >= {threshold}
),
listed AS (
    SELECT a, string_agg(b, ', ' ORDER BY rn) AS matches FROM ranked WHERE rn <= {limit} GROUP BY a
)
SELECT {columns}, coalesce(matches, '') AS matches
FROM lefts LEFT JOIN listed ON {name} = a"""


def word_scored(whole: str, threshold: float, limit: int) -> str:
    """All pairs of part names and noisy names, scored by the words they share."""
    split = "list_distinct(list_filter(string_split(trim(lower(regexp_replace({}, '[^a-zA-Z0-9_]', ' ', 'g'))), ' '), lambda w: w <> ''))"
    return f"""
WITH noisy AS (SELECT DISTINCT array_to_string(
    CASE WHEN p_partkey % 4 = 1 THEN ['ltd', w[1]] ELSE ['LTD.'] END
    || CASE WHEN p_partkey % 3 = 0 THEN w[1:len(w) - 1] ELSE list_reverse(w) END, ' ') AS b
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)),
rights AS (SELECT b, {split.format("b")} AS v FROM noisy),
lefts AS (SELECT DISTINCT p_name AS a, {split.format("p_name")} AS u FROM part),
pairs AS (SELECT a, b, len(list_intersect(u, v)) AS hits, len(u) AS n, len(v) AS m FROM lefts, rights),
scored AS (SELECT a, b, 100.0 * hits / {whole} AS score FROM pairs WHERE n > 0 AND m > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn
    FROM scored WHERE score >= {threshold} - 1e-9),
listed AS (SELECT a, string_agg(b, ', ' ORDER BY rn) AS matches FROM ranked WHERE rn <= {limit} GROUP BY a)
SELECT p_partkey, p_name, coalesce(matches, '') AS matches FROM part LEFT JOIN listed ON p_name = a"""


MISSPELT = (
    "replace(replace(replace(replace(p_name, 'gizmo', 'gizzmo'), 'small', 'smal'),"
    " 'anvil', 'ANVIL!'), 'cold', 'gold')"
)

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FULL_LABELS = [
    f"{m} {y:02d} : week {w}"
    for y in (95, 96, 97, 98, 99, 0, 1)
    for m in MONTH_NAMES
    for w in range(1, 7)
]
PIVOT_LABELS = [
    f"{m} {y} : week {w}" for y in (96, 97) for m in MONTH_NAMES for w in range(1, 6)
][50:]

NOISED_CUSTOMERS = """
noised AS (
    SELECT c_custkey,
           CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' || lower(n_name) || ' '
                WHEN 2 THEN n_name || ' 2' WHEN 3 THEN upper(n_name[1]) || lower(n_name[2:])
                ELSE n_name END AS nation_text
    FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

ORDER_CHANGES = """
orders_ AS (SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders),
changes AS (
    SELECT l_linestatus AS o_orderstatus, l_orderkey AS o_orderkey,
           l_extendedprice AS o_totalprice, l_linenumber AS seq
    FROM lineitem
)"""


def newest_change(keys: str) -> str:
    return f"""
newest AS (
    SELECT o_orderstatus, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (
            PARTITION BY {keys} ORDER BY seq DESC, o_totalprice DESC, o_orderstatus) AS rn
        FROM changes)
    WHERE rn = 1
)"""


def domains(columns: list[str], condition: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct,"
        f" string_agg(DISTINCT CAST({c} AS VARCHAR), ', ' ORDER BY CAST({c} AS VARCHAR)) AS \"values\""
        f" FROM docs HAVING count(DISTINCT {c}) {condition}"
        for c in columns
    )


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
NULL_FACTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count,"
    f" round((count(*) - count({c})) / count(*) * 100, 3) AS null_pct"
    f" FROM docs HAVING count(*) > count({c})"
    for c in DOC_COLUMNS
)
SMALL_TEXTS = domains(["text", "lang", "source"], "< 13")
TWO_VALUED = domains(["doc_id", "n_chars", "quality", "toxic"], "= 2")

# --- oracles -----------------------------------------------------------------

def pivoted(labels: list[str]) -> str:
    cells = ", ".join(f"max(CASE WHEN heading = '{x}' THEN r END) AS \"{x}\"" for x in labels)
    return f"""
        WITH long AS ({correlations(LINE_MEMBERS, "rows_", "members")}),
        named AS (SELECT *, month || ' ' || lpad(CAST(year % 100 AS VARCHAR), 2, '0') || ' : week '
                  || CAST(week_of_month AS VARCHAR) AS heading FROM long)
        SELECT feature, {cells} FROM named GROUP BY feature"""


ORACLES: dict[str, str] = {
    "scan_table": "SELECT * FROM customer",
    "search_path_scan": """
        SELECT nation.*, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "catalog_views": """
        SELECT r_name, count(*) AS suppliers, max(s_acctbal) AS most
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "intake_profile": """
        WITH named AS (SELECT count(DISTINCT c_mktsegment) AS d,
            string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS v FROM customer)
        SELECT 'table' AS section, NULL AS "column", 'row_count' AS metric,
               CAST(count(*) AS DOUBLE) AS value, NULL AS listing FROM customer
        UNION ALL SELECT 'table', NULL, 'column_count', 5, NULL
        UNION ALL SELECT 'table', NULL, 'duplicate_rows', 0, NULL
        UNION ALL SELECT 'table', NULL, 'duplicate_pct', 0, NULL
        UNION ALL SELECT 'low_cardinality', 'c_mktsegment', 'n_distinct', d, v FROM named""",
    "intake_cleansed": """
        SELECT DISTINCT c_custkey, c_nationkey, c_acctbal,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN NULL
                    ELSE c_mktsegment END AS c_mktsegment
        FROM customer WHERE c_acctbal > 0""",
    "read_many_union": """
        SELECT c_custkey AS party, c_acctbal AS balance, c_mktsegment, 'customer' AS source
        FROM customer
        UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""",
    "project_rename": f"""WITH {CYCLE_DAILY}
        SELECT unit AS house, cycle_start AS placed_on, obs_date AS cut_off, age AS day,
               pop_end AS birds FROM cycle_daily""",
    "computed_metrics": f"""WITH {CYCLE_DAILY}
        SELECT unit, cycle_start, age, round(bw * (pop_end + cum_harvest) / 1000, 6) AS total_bw,
               round(pop_end * bw / 1000, 6) AS live_kg, pop_end * age AS age_alive,
               initial_pop - cum_depletion AS living FROM cycle_daily""",
    "filter_predicates": f"""WITH {CYCLE_DAILY}
        SELECT unit, cycle_start, age, cum_harvest, cum_depletion FROM cycle_daily
        WHERE bw > 100 AND (cum_harvest > 0 OR cum_depletion > 2)""",
    "filter_optional_range": f"""WITH {CYCLE_DAILY}
        SELECT unit, cycle_start, age, pop_end FROM cycle_daily
        WHERE cycle_start >= DATE '2024-01-08'""",
    "filter_optional_in": f"""WITH {UNIT_DIM}
        SELECT * FROM unit_dim
        WHERE officer IN ('BUILDING', 'MACHINERY') AND area IN ('ASIA', 'EUROPE')""",
    "filter_last_n_days": """
        SELECT event_id, user_id, CAST(ts AS DATE) AS event_date FROM events
        WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - INTERVAL 7 DAY""",
    "dropna_subset": f"""WITH {DOCS}
        SELECT doc_id, lang, quality, toxic FROM docs
        WHERE quality IS NOT NULL AND lang IS NOT NULL""",
    "value_map": """
        SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BUDGET' WHEN 'PROMO' THEN 'OFFER'
            WHEN 'SMALL' THEN NULL ELSE p_type END AS kind FROM part""",
    "canonicalize_names": """
        SELECT p_partkey, trim(replace(replace(replace(replace(replace(replace(replace(p_name,
            'old', 'aged'), 'red', 'dark red'), 'dark red', 'crimson'), 'caged', 'cold'),
            'ring', 'rings'), 'crimson rings', ' ruby rings '), 'gizmo', ' '), ' ') AS name
        FROM part""",
    "compound_key": """
        SELECT p_partkey, p_brand || '__' || CASE WHEN p_type <> 'PROMO' THEN p_type END AS key,
               upper(p_type[1]) || lower(p_type[2:]) AS label FROM part""",
    "coerce_numeric": """
        SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 2 = 1 THEN replace(p_brand, 'Brand#', '')
            ELSE p_brand END AS DOUBLE) AS brand_no FROM part""",
    "coerce_date": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day
        FROM orders""",
    "age_band": f"""WITH {CYCLE_DAILY},
        b AS (SELECT *, age * 3 + unit % 20 AS days FROM cycle_daily)
        SELECT unit, cycle_start, age,
               CASE WHEN days <= 7 THEN 'w1' WHEN days <= 14 THEN 'w2' WHEN days <= 21 THEN 'w3'
                    WHEN days <= 28 THEN 'w4' WHEN days <= 35 THEN 'w5' ELSE 'w6' END AS band
        FROM b""",
    "price_band": f"""
        SELECT p_partkey, {PRICE_LABEL} AS band
        FROM (SELECT p_partkey, (p_retailprice - 900) * 120 + 1000 AS price FROM part)""",
    "calendar_parts": f"""
        SELECT DISTINCT day, CAST(week(day) AS INTEGER) AS week, strftime(day, '%b') AS month,
               CAST(isoyear(day) AS INTEGER) AS iso_year, {month_week("day")} AS week_of_month,
               CAST(year(day) AS INTEGER) AS plain_year
        FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)""",
    "week_of_month": f"""
        SELECT DISTINCT day, {month_week("day")} AS week_of_month
        FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)""",
    "bucket_label": f"""
        SELECT DISTINCT day, strftime(day, '%b') || ' '
            || lpad(CAST(isoyear(day) % 100 AS VARCHAR), 2, '0') || ' : week '
            || CAST({month_week("day")} AS VARCHAR) AS label
        FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)""",
    "growth_rate": f"""WITH {CYCLE_HEAD}
        SELECT unit, cycle_start, round(bw_8 / nullif(bw_0, 0), 1) AS growth,
               round(mortality_8 * 100, 4) AS mortality_pct FROM cycle_head""",
    "impute_median": """
        WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS price
                   FROM part)
        SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM p)), 6) AS price FROM p""",
    "impute_median_nan": """
        WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price
                   FROM part)
        SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM p)), 6) AS price FROM p""",
    "impute_mode": f"""WITH {DOCS}
        SELECT doc_id,
               coalesce(quality, (SELECT quality FROM docs WHERE quality IS NOT NULL
                   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS quality,
               coalesce(toxic, (SELECT toxic FROM docs WHERE toxic IS NOT NULL
                   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS toxic
        FROM docs""",
    "cleanse_table": f"""WITH {DOCS}
        SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS lang, n_chars,
               coalesce(quality, (SELECT quality FROM docs WHERE quality IS NOT NULL
                   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS quality,
               coalesce(toxic, 0) AS toxic
        FROM docs WHERE n_chars > 100""",
    "drop_duplicate_rows": "SELECT DISTINCT text, lang FROM documents",
    "harvest_daily": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, harvest_daily, catch_age_daily FROM cycle_metrics""",
    "adg": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, bw, adg FROM cycle_metrics""",
    "depletion_daily": f"""WITH {CYCLE_DAILY}, {UNIT_DIM}, {MONITORED}
        SELECT c.unit, c.cycle_start, c.age, m.period,
               c.cum_depletion - lag(c.cum_depletion)
                   OVER (PARTITION BY c.unit, c.cycle_start ORDER BY c.age) AS depletion_daily
        FROM cycle_daily c JOIN unit_dim u USING (unit)
        JOIN monitored m ON c.unit = m.unit_name AND c.cycle_start = m.start_date
            AND c.age = m.day_age""",
    "running_sum": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, catch_age_cum FROM cycle_metrics""",
    "running_sum_with_ties": f"""WITH {SALES}
        SELECT unit, sale_date, CAST(kg AS DOUBLE) AS kg,
               CAST(sum(kg) OVER (PARTITION BY unit ORDER BY sale_date) AS DOUBLE) AS kg_so_far
        FROM sales""",
    "running_avg_filtered": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, round(harvest_age, 6) AS harvest_age,
               harvest_daily AS harvest,
               round(avg(age) FILTER (WHERE harvest_daily > 0)
                   OVER (PARTITION BY unit, cycle_start ORDER BY age), 6) AS mean_age
        FROM cycle_metrics""",
    "fcr_calc": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, round(total_bw, 6) AS total_bw,
               round(fcr_calc, 6) AS fcr_calc FROM cycle_metrics""",
    "performance_index_quick": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, round(ip_quick, 9) AS ip_quick FROM cycle_metrics""",
    "running_sum_hot_groups": """
        SELECT o_orderkey, o_orderstatus,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (
                   PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE)) AS DOUBLE) AS so_far
        FROM orders""",
    "delta_hot_groups": """
        SELECT o_orderkey, o_orderstatus,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) - lag(CAST(o_totalprice AS DECIMAL(18,2)))
                   OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS DOUBLE) AS change
        FROM orders""",
    "latest_per_cycle": f"""WITH {CYCLE_DAILY},
        r AS (SELECT *, row_number() OVER (PARTITION BY unit, cycle_start ORDER BY age DESC) AS rn
              FROM cycle_daily)
        SELECT unit AS unit_name, cycle_start, obs_date, age, pop_end FROM r
        WHERE rn = 1 AND pop_end > 0 AND obs_date >= DATE '2024-01-31' - INTERVAL 21 DAY""",
    "latest_n_per_group": """
        SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice,
               CAST(rn AS INTEGER) AS rn
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
                  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
        WHERE rn <= 7""",
    "latest_n_hot_groups": """
        SELECT o_orderstatus, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(rn AS INTEGER) AS rn
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
                  ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders)
        WHERE rn <= 7""",
    "spread_ranked_rows": f"""WITH {CYCLE_HEAD},
        r AS (SELECT CASE WHEN unit % 17 = 0 THEN lower(hatchery) ELSE hatchery END AS place,
                     unit, cycle_start, CAST(CAST(bw_8 AS BIGINT) AS VARCHAR) AS bw_8
              FROM cycle_head),
        k AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY cycle_start DESC, unit) AS rn
              FROM r)
        SELECT place AS hatchery, {
        ", ".join(
            f"max(CASE WHEN rn = {i} THEN {c} END) AS {c}_{i}"
            for i in range(1, 8)
            for c in ("unit", "cycle_start", "bw_8")
        )
    } FROM k WHERE rn <= 7 GROUP BY place""",
    "join_inner_dim": f"""WITH {CYCLE_DAILY}, {UNIT_DIM}
        SELECT unit, cycle_start, age, pop_end, officer, manager, area, partnership
        FROM cycle_daily JOIN unit_dim USING (unit) WHERE area IN ('ASIA', 'AFRICA', 'EUROPE')""",
    "join_inner_3key": f"""WITH {CYCLE_DAILY}, {MONITORED}
        SELECT unit, cycle_start, age, cum_harvest, period FROM cycle_daily JOIN monitored
            ON unit = unit_name AND cycle_start = start_date AND age = day_age""",
    "join_left_2key": f"""WITH {CYCLE_DAILY}, {SALES}
        SELECT c.unit, obs_date, age, coalesce(kg, 0) AS kg, coalesce(birds, 0) AS birds
        FROM cycle_daily c LEFT JOIN daily_sales s
            ON c.unit = s.unit AND c.obs_date = s.sale_date""",
    "actual_vs_standard": f"""WITH {CYCLE_METRICS}, {STANDARD}
        SELECT unit, cycle_start, c.age, bw, round(bw_std * 1000, 6) AS bw_standard, adg,
               round(adg_std * 1000, 6) AS adg_standard, round(fcr, 6) AS fcr,
               round(fcr_std, 6) AS fcr_standard, round(total_depletion, 6) AS total_depletion,
               round(mortality_std * 100, 6) AS mortality_standard
        FROM cycle_metrics c LEFT JOIN standard s ON c.age = s.age""",
    "join_normalized_key": f"""WITH {NOISED_CUSTOMERS}
        SELECT c_custkey, nation_text, n_name, n_regionkey FROM noised
        LEFT JOIN nation ON upper(trim(nation_text, ' ')) = upper(trim(n_name, ' '))""",
    "join_normalized_chain": f"""WITH {NOISED_CUSTOMERS},
        regions AS (SELECT n_name, ' ' || lower(r_name) AS region_text
                    FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT c_custkey, nation_text, n_name, region_text, r_regionkey, r_name FROM noised
        LEFT JOIN regions ON upper(trim(nation_text, ' ')) = upper(n_name)
        LEFT JOIN region ON upper(trim(region_text, ' ')) = r_name""",
    "fuzzy_topk_join": fuzzy(
        "SELECT p_partkey, p_name FROM part",
        f"SELECT DISTINCT {MISSPELT} AS name FROM part",
        "p_partkey, p_name",
        "p_name",
        80,
        2,
    ),
    "fuzzy_topk_join_copies": fuzzy(
        "SELECT n_nationkey, n_name FROM nation",
        "SELECT CASE WHEN s_suppkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS name"
        " FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "n_nationkey, n_name",
        "n_name",
        87.5,
        5,
    ),
    "fuzzy_topk_join_long": f"""
WITH lefts AS (SELECT p_partkey, p_name, concat_ws(' ', concat_ws(' ', p_type, p_name, p_brand),
        'of part number', p_partkey, concat_ws(' ', p_type, p_name, p_brand)) AS name FROM part),
cleaned AS (SELECT DISTINCT name, trim(lower(regexp_replace(name, '[^a-zA-Z0-9_]', ' ', 'g'))) AS t
    FROM lefts),
choices AS (SELECT DISTINCT {MISSPELT.replace("p_name", "name")} AS b FROM lefts),
compared AS (SELECT b, trim(lower(regexp_replace(b, '[^a-zA-Z0-9_]', ' ', 'g'))) AS u FROM choices),
near AS (SELECT name, b, t, u, levenshtein(t, u) AS edits FROM cleaned JOIN compared
    ON abs(length(t) - length(u)) <= 0.05 * greatest(length(t), length(u))),
best AS (SELECT name, arg_min(b, (edits / greatest(length(t), length(u)), b)) AS matches FROM near
    WHERE 100 * edits <= 5 * greatest(length(t), length(u)) GROUP BY name)
SELECT p_partkey, lefts.name, coalesce(matches, '') AS matches FROM lefts
LEFT JOIN best ON lefts.name = best.name""",
    "fuzzy_topk_join_any_order": """
WITH turned AS (SELECT DISTINCT array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS b
    FROM part),
sorted AS (SELECT min(b) AS b,
    array_to_string(list_sort(string_split(trim(lower(regexp_replace(b, '[^a-zA-Z0-9_]', ' ', 'g'))), ' ')), ' ') AS t
    FROM turned GROUP BY t)
SELECT p_partkey, p_name, coalesce(b, '') AS matches FROM part LEFT JOIN sorted
ON t = array_to_string(list_sort(string_split(trim(lower(regexp_replace(p_name, '[^a-zA-Z0-9_]', ' ', 'g'))), ' ')), ' ')""",
    "fuzzy_topk_join_word_set": word_scored("(n + m - hits)", 60, 3),
    "fuzzy_topk_join_word_part": word_scored("least(n, m)", 75, 3),
    "fuzzy_topk_join_prefixed": fuzzy(
        "SELECT s_suppkey, s_name FROM supplier",
        "SELECT replace(s_name, 'Supp', 'Sup') AS name FROM supplier",
        "s_suppkey, s_name",
        "s_name",
        90,
        3,
    ),
    "agg_sales_daily": f"""WITH {SALES}
        SELECT unit, sale_date, kg, birds, amount, weight,
               round(amount / nullif(kg, 0), 6) AS price_per_kg
        FROM daily_sales""",
    "distinct_project": f"""WITH {UNIT_DIM}
        SELECT DISTINCT officer, manager, area FROM unit_dim""",
    "wide_row_sum": f"""WITH {FEED_EVENTS}
        SELECT unit, cycle_start, {
        ", ".join(f"count(*) FILTER (WHERE brand = '{x}') AS {x}" for x in BRANDS)
    }, {
        ", ".join(
            f"count(*) FILTER (WHERE brand = '{x}' AND phase = '{p}') AS {p}_{x}"
            for p in PHASES
            for x in BRANDS
        )
    },
        (SELECT string_agg(DISTINCT f, ',' ORDER BY f) FROM (
            SELECT e.brand AS f FROM feed_events e
            WHERE e.unit = o.unit AND e.cycle_start = o.cycle_start
            UNION SELECT e.phase || '_' || e.brand FROM feed_events e
            WHERE e.unit = o.unit AND e.cycle_start = o.cycle_start)) AS used
        FROM feed_events o GROUP BY unit, cycle_start""",
    "one_hot": """
        SELECT p_partkey, p_type, CAST(p_type = 'ECONOMY' AS INTEGER) AS type_ECONOMY,
               CAST(p_type = 'LARGE' AS INTEGER) AS type_LARGE,
               CAST(p_type = 'MEDIUM' AS INTEGER) AS type_MEDIUM,
               CAST(p_type = 'PROMO' AS INTEGER) AS type_PROMO,
               CAST(p_type = 'SMALL' AS INTEGER) AS type_SMALL,
               CAST(p_type = 'STANDARD' AS INTEGER) AS type_STANDARD FROM part""",
    "corr_brand_hatchery": correlations(LINE_MEMBERS, "rows_", "members"),
    "corr_brand_hatchery_mortality": correlations(HEAD_MEMBERS, "rows_", "members"),
    "corr_price_band": correlations(PRICE_MEMBERS, "rows_", "members"),
    "corr_feed_brand": correlations(FEED_MEMBERS, "rows_", "members"),
    "corr_pivot_report": pivoted(PIVOT_LABELS),
    "corr_pivot_full": pivoted(FULL_LABELS),
    "performance_index": performance_report("", "", ""),
    "performance_index_filtered": performance_report(
        "WHERE cycle_start BETWEEN DATE '2024-01-08' AND DATE '2024-01-22'",
        "WHERE officer IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"
        " AND area IN ('ASIA', 'AFRICA', 'EUROPE') AND partnership IN ('own')",
        "WHERE period IN (2, 3, 4)",
    ),
    "population_by_age_band": f"""WITH {CYCLE_DAILY}, {UNIT_DIM},
        named AS (
            SELECT CASE unit % 10 WHEN 0 THEN ' unit ' || unit WHEN 1 THEN 'UNIT ' || unit || ' (OLD)'
                       WHEN 2 THEN 'UNT ' || unit ELSE 'UNIT ' || unit END AS unit_name,
                   cycle_start, age * 3 + unit % 20 AS days, pop_end
            FROM cycle_daily),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY unit_name, cycle_start ORDER BY days DESC) AS rn
            FROM named),
        living AS (
            SELECT trim({
        replaced(
            "unit_name",
            [(" (OLD)", ""), ("UNT", "UNIT"), ("UNIT 1", "UNIT 01"), ("UNIT 010", "UNIT 10")],
        )
    }, ' ') AS unit_name, days, pop_end
            FROM ranked WHERE rn = 1 AND pop_end > 0),
        masters AS (
            SELECT trim(' Unit ' || unit, ' ') AS unit_name,
                   trim(replace(CASE WHEN unit % 4 = 0 THEN lower(officer) ELSE officer END,
                       'AUTOMOBILE', 'AUTO'), ' ') AS officer,
                   {
        replaced(
            "manager",
            [("NATION_1", "NATION_01"), ("NATION_010", "NATION_10"), ("NATION_2", "N_2")],
        )
    } AS manager
            FROM unit_dim),
        branches AS (
            SELECT trim(replace(officer, 'AUTOMOBILE', 'AUTO'), ' ') AS officer, branch, province
            FROM (SELECT DISTINCT c_mktsegment || ' ' AS officer, 'Branch ' || c_mktsegment[1] AS branch,
                         'Province ' || CAST(length(c_mktsegment) % 3 AS VARCHAR) AS province
                  FROM customer))
        SELECT province AS "Province", branch AS "Unit", manager AS "Mitra Manager",
               CAST(sum(CASE WHEN days <= 7 THEN pop_end ELSE 0 END) AS BIGINT) AS "W1 (0-7)",
               CAST(sum(CASE WHEN days > 7 AND days <= 14 THEN pop_end ELSE 0 END) AS BIGINT)
                   AS "W2 (7-14)",
               CAST(sum(CASE WHEN days > 14 AND days <= 21 THEN pop_end ELSE 0 END) AS BIGINT)
                   AS "W3 (14-21)",
               CAST(sum(CASE WHEN days > 21 AND days <= 28 THEN pop_end ELSE 0 END) AS BIGINT)
                   AS "W4 (21-28)",
               CAST(sum(CASE WHEN days <= 28 THEN pop_end ELSE 0 END) AS BIGINT) AS "Grand Total"
        FROM living l
        LEFT JOIN masters m ON upper(l.unit_name) = upper(m.unit_name)
        LEFT JOIN branches b ON upper(m.officer) = upper(b.officer)
        GROUP BY ALL ORDER BY 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST""",
    "recent_scorecard_brand": scorecard("doc", ["doc", "hatchery"], [*SHOWN, "hatchery"], True),
    "recent_scorecard_brand_hatchery": scorecard(
        "doc || '_' || hatchery", ["doc", "hatchery"], SHOWN, True
    ),
    "recent_scorecard_hatchery": scorecard("hatchery", ["doc", "hatchery"], SHOWN, True),
    "recent_scorecard_feed": scorecard("feed", ["feed"], [*SHOWN, "hatchery"], False),
    "recent_scorecard_feed_hatchery": scorecard(
        "feed || '_' || hatchery", ["feed", "hatchery"], [*SHOWN, "hatchery", "feed"], False
    ),
    "recent_scorecard_feed_combination": scorecard(
        "hatchery", ["hatchery"], [*SHOWN, "feed"], False
    ),
    "profile_table": f"""WITH {DOCS},
        dup AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM docs))
                AS d FROM docs),
        nulls AS ({NULL_FACTS}), texts AS ({SMALL_TEXTS}), pairs AS ({TWO_VALUED})
        SELECT 'table' AS section, NULL AS "column", 'row_count' AS metric,
               CAST(n AS DOUBLE) AS value, NULL AS listing FROM dup
        UNION ALL SELECT 'table', NULL, 'column_count', {len(DOC_COLUMNS)}, NULL
        UNION ALL SELECT 'table', NULL, 'duplicate_rows', d, NULL FROM dup
        UNION ALL SELECT 'table', NULL, 'duplicate_pct', round(d / n * 100, 1), NULL FROM dup
        UNION ALL SELECT 'nulls', "column", 'null_count', null_count, NULL FROM nulls
        UNION ALL SELECT 'nulls', "column", 'null_pct', null_pct, NULL FROM nulls
        UNION ALL SELECT 'low_cardinality', "column", 'n_distinct', n_distinct, "values" FROM texts
        UNION ALL SELECT 'boolean_candidates', "column", 'n_distinct', n_distinct, "values"
            FROM pairs""",
    "profile_duplicates": """
        SELECT n AS row_count, n - d AS duplicate_rows, round((n - d) / n * 100, 1) AS duplicate_pct
        FROM (SELECT (SELECT count(*) FROM documents) AS n,
                     (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS d)""",
    "profile_duplicate_texts": """
        SELECT n AS row_count, n - d AS duplicate_rows, round((n - d) / n * 100, 1) AS duplicate_pct
        FROM (SELECT count(*) AS n, count(DISTINCT text) AS d FROM documents)""",
    "profile_nulls": f"WITH {DOCS} {NULL_FACTS}",
    "profile_low_cardinality": f"WITH {DOCS} {SMALL_TEXTS}",
    "profile_boolean_candidates": f"WITH {DOCS} {TWO_VALUED}",
    "sink_overwrite": "SELECT * FROM customer WHERE c_acctbal > 0",
    "sink_append": """
        SELECT * FROM supplier UNION ALL
        SELECT * REPLACE (s_suppkey + 1000000 AS s_suppkey) FROM supplier""",
    "sink_sheets": """
        SELECT n_nationkey, n_name, n_regionkey, 'nation' AS source FROM nation
        UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, 'nation' FROM nation
        UNION ALL SELECT CAST(p_partkey AS INTEGER), p_name, NULL, 'part' FROM part""",
    "sink_upsert": f"""WITH {ORDER_CHANGES}, {newest_change("o_orderkey")}
        SELECT * FROM newest UNION ALL
        SELECT * FROM orders_ WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newest)""",
    "sink_upsert_partitions": f"""WITH {ORDER_CHANGES}, {newest_change("o_orderstatus, o_orderkey")}
        SELECT * FROM newest UNION ALL
        SELECT o.* FROM orders_ o
        WHERE NOT EXISTS (SELECT 1 FROM newest n
            WHERE n.o_orderkey = o.o_orderkey AND n.o_orderstatus = o.o_orderstatus)""",
    "sink_upsert_null_partition": """
        WITH old AS (
            SELECT CASE WHEN o_orderstatus <> 'P' THEN '0' || ascii(o_orderstatus) END AS part,
                   o_orderkey AS k, o_totalprice AS v FROM orders),
        new AS (
            SELECT part, CASE WHEN k % 5 = 0 THEN -k ELSE k END AS k, v + 1 AS v FROM old
            WHERE k % 3 = 0 AND part IS DISTINCT FROM '070')
        SELECT part, k, v FROM new
        UNION ALL SELECT o.part, o.k, o.v FROM old o WHERE NOT EXISTS (
            SELECT 1 FROM new n WHERE n.k = o.k AND n.part IS NOT DISTINCT FROM o.part)""",
    "sink_versions_append": """
        SELECT *, 2 AS version FROM supplier UNION ALL SELECT *, 3 FROM supplier
        UNION ALL SELECT * REPLACE (s_suppkey + 1000000 AS s_suppkey), 3 FROM supplier""",
    "sink_versions_upsert": """
        WITH old AS (
            SELECT CASE WHEN strftime(o_orderdate, '%Y-%m') >= '1996-01' THEN strftime(o_orderdate, '%Y-%m') END AS month,
                   o_orderkey AS k, o_totalprice AS v FROM orders),
        new AS (
            SELECT CASE WHEN k % 7 <> 0 THEN month ELSE 'none' END AS month, k, v + 1 AS v FROM old
            WHERE k % 3 = 0 AND (month IS NULL OR month < '1996-07'))
        SELECT *, 1 AS version FROM old UNION ALL SELECT *, 2 FROM new
        UNION ALL SELECT *, 2 FROM old o WHERE NOT EXISTS (
            SELECT 1 FROM new n WHERE n.k = o.k AND n.month IS NOT DISTINCT FROM o.month)""",
    "profile_merged": f"WITH {DOCS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) AS row_count, count(*) - count({c}) AS null_count,
            round(100.0 * (count(*) - count({c})) / count(*), 3) AS null_pct,
            CASE WHEN count(DISTINCT {c}) < 4096 THEN count(DISTINCT {c}) END AS n_distinct,
            CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 12
                THEN string_agg(DISTINCT CAST({c} AS VARCHAR), ', ' ORDER BY CAST({c} AS VARCHAR)) END AS listing,
            CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM docs"""
        for c in ("doc_id", "text", "lang", "n_chars", "quality", "toxic")
    ),
    "scan_totals_hot_groups": """
        SELECT o_orderkey, o_orderstatus,
               CAST(sum(a) OVER w AS DOUBLE) AS so_far,
               CAST(sum(a) FILTER (WHERE a > 150000) OVER w AS DOUBLE)
                   / nullif(count(*) FILTER (WHERE a > 150000) OVER w, 0) AS dear_mean,
               CAST(min(a) OVER w AS DOUBLE) AS least,
               CAST(max(a) OVER w AS DOUBLE) AS greatest
        FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders)
        WINDOW w AS (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE))""",
    "scan_delta_hot_groups": """
        SELECT o_orderkey, o_orderstatus, CAST(a - lag(a) OVER w AS DOUBLE) AS change,
               CAST(sum(a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS earlier
        FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders)
        WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)""",
    "one_hot_found": """
        SELECT p_partkey, p_type, CAST(p_type = 'ECONOMY' AS INTEGER) AS type_ECONOMY,
               CAST(p_type = 'LARGE' AS INTEGER) AS type_LARGE,
               CAST(p_type = 'MEDIUM' AS INTEGER) AS type_MEDIUM,
               CAST(p_type = 'PROMO' AS INTEGER) AS type_PROMO,
               CAST(p_type = 'SMALL' AS INTEGER) AS type_SMALL,
               CAST(p_type = 'STANDARD' AS INTEGER) AS type_STANDARD,
               0 AS type__rest, CAST(NULL AS VARCHAR) AS rest FROM part""",
    "one_hot_rest": """
        SELECT p_partkey, kind, CAST(coalesce(kind = 'even', false) AS INTEGER) AS kind_even,
               CAST(coalesce(kind = 'third', false) AS INTEGER) AS kind_third,
               CAST(coalesce(kind NOT IN ('even', 'third'), false) AS INTEGER) AS kind__rest,
               CASE WHEN kind NOT IN ('even', 'third') THEN kind END AS rest
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'even' WHEN p_partkey % 3 = 0 THEN 'third'
              WHEN p_partkey % 5 <> 0 THEN p_name END AS kind FROM part)""",
    "corr_brand_hatchery_by_day": correlations(LINE_MEMBERS, "rows_", "members"),
    "corr_amount_by_status": """
        SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(avg(l_extendedprice), 6) AS mean_y,
               round(corr(l_quantity, l_extendedprice), 6) AS r
        FROM lineitem GROUP BY l_returnflag""",
    "running_avg_colocated": f"""WITH {CYCLE_METRICS}
        SELECT unit, cycle_start, age, round(harvest_age, 6) AS harvest_age,
               harvest_daily AS harvest,
               round(avg(age) FILTER (WHERE harvest_daily > 0)
                   OVER (PARTITION BY unit, cycle_start ORDER BY age), 6) AS mean_age
        FROM cycle_metrics""",
    "join_cycles_colocated": f"""WITH {CYCLE_DAILY}
        SELECT unit, cycle_start, age, count(*) OVER c AS days, max(age) OVER c AS last_age
        FROM cycle_daily WINDOW c AS (PARTITION BY unit, cycle_start)""",
}
