"""The registered queries as SQL, to check the Spark results with another engine.

Written for DuckDB over the star-schema tables. Each statement starts from the
same wide facts; columns that a query does not read cost nothing there.
"""

from __future__ import annotations

from salesloom.functions.encoding import HASH_SHARES
from salesloom.functions.fixed_values import GEO_SAMPLE_SEED, OPTION_SAMPLE_FRACTION
from salesloom.operators.sites import STEP_LAT, STEP_LON
from salesloom.plans import queries as q
from salesloom.plans.queries import NUDGE
from salesloom.sources.star import STAR_CENTERS, STAR_MENUS

FACTS = """WITH facts AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key, l_suppkey AS supplier_key, p_brand AS truck_brand_name, p_type AS menu_type,
         split_part(p_name, ' ', 1) AS item_subcategory, split_part(p_name, ' ', 2) AS item_category,
         p_name AS menu_item_name, n_name AS city, l_extendedprice AS price, o_totalprice AS order_total,
         l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
         p_retailprice AS cost_of_goods_usd,
         o_orderdate + to_hours(((o_orderkey * 7 + l_linenumber * 5) % 24)::INT) AS order_ts,
         52.2298::DOUBLE + ((l_suppkey % 21) - 10) / 1000.0::DOUBLE AS latitude,
         21.0118::DOUBLE + ((l_suppkey % 17) - 8) / 1000.0::DOUBLE AS longitude
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
), calendar AS (
  SELECT *, order_ts::DATE AS date, hour(order_ts)::INT AS hour, month(order_ts)::INT AS month,
         CASE WHEN hour(order_ts) >= 5 AND hour(order_ts) < 12 THEN 'Morning'
              WHEN hour(order_ts) >= 12 AND hour(order_ts) < 17 THEN 'Afternoon'
              WHEN hour(order_ts) >= 17 AND hour(order_ts) < 21 THEN 'Evening' ELSE 'Night' END AS time_of_day,
         CASE WHEN month(order_ts) IN (12, 1, 2) THEN 'Winter' WHEN month(order_ts) IN (3, 4, 5) THEN 'Spring'
              WHEN month(order_ts) IN (6, 7, 8) THEN 'Summer'
              WHEN month(order_ts) IN (9, 10, 11) THEN 'Autumn' END AS season
  FROM facts
)"""

# Values of the test tables that become columns.
CATEGORIES = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")


def _mean(expression: str, name: str) -> str:
    return f"round({expression} + {NUDGE}, 4) AS {name}"


def _values(rows) -> str:
    def literal(value) -> str:
        return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)

    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


def _in(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


_SALES = "truck_brand_name, menu_type, price, city, item_category, item_subcategory, order_total, order_ts"
_GEO = (
    "latitude, longitude, price, menu_type, item_category, city, order_ts, unit_price, "
    "menu_item_name, cost_of_goods_usd, quantity"
)
_LOCATION_KEYS = "latitude, longitude, menu_type, item_category, season, time_of_day"

_MENUS = f"menus AS (SELECT * FROM (VALUES {_values(STAR_MENUS)}) AS m(menu_type, rating, image))"

_SUMMARY = """summary AS (
  SELECT item_subcategory, avg(price) AS avg_spending, sum(price) AS total_sales
  FROM facts GROUP BY item_subcategory)"""

_TOP_SUBCATEGORIES = "(SELECT * FROM summary ORDER BY total_sales DESC, item_subcategory LIMIT 3)"

# Sundays: DuckDB weeks start on Monday, so the week's last day is six days on.
_WEEKLY = """totals AS (
  SELECT (date_trunc('week', order_ts)::DATE + 6)::DATE AS week_end, item_category, sum(price) AS y
  FROM facts GROUP BY ALL
), weeks AS (
  SELECT unnest(generate_series((SELECT min(week_end) FROM totals)::TIMESTAMP,
                                (SELECT max(week_end) FROM totals)::TIMESTAMP - INTERVAL 7 DAY,
                                INTERVAL 7 DAY))::DATE AS week_end
), weekly AS (
  SELECT w.week_end, c.item_category, coalesce(t.y, 0.0) AS y
  FROM weeks w CROSS JOIN (SELECT DISTINCT item_category FROM facts) c
  LEFT JOIN totals t ON t.week_end = w.week_end AND t.item_category = c.item_category)"""

_RATED = f"""{_MENUS}, rated AS (
  SELECT item_subcategory, f.menu_type, image, sum(price) AS total, avg(rating) AS rating
  FROM facts f LEFT JOIN menus m ON f.menu_type = m.menu_type GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_subcategory ORDER BY total DESC, menu_type)::INT AS place
  FROM rated)"""

_PROFITS = """profits AS (
  SELECT city, season, item_category, menu_item_name, avg(unit_price) AS unit_price,
         avg(cost_of_goods_usd) AS avg_cost, sum(price) AS total_sales,
         avg(unit_price) - avg(cost_of_goods_usd) AS profit
  FROM calendar GROUP BY city, season, item_category, menu_item_name
), best AS (
  SELECT menu_item_name, item_category, avg(avg_cost) AS avg_cost, avg(unit_price) AS unit_price,
         avg(profit) AS total_profit
  FROM profits GROUP BY menu_item_name, item_category
  ORDER BY total_profit DESC, menu_item_name, item_category LIMIT 3)"""

_TOP_ITEMS = (
    f"{FACTS}, {_PROFITS} SELECT menu_item_name, item_category, {_mean('avg_cost', 'avg_cost')}, "
    f"{_mean('unit_price', 'unit_price')}, {_mean('total_profit', 'total_profit')} FROM best"
)

_LOCATIONS = f"""locations AS (
  SELECT {_LOCATION_KEYS}, sum(price) AS total_sales FROM calendar GROUP BY {_LOCATION_KEYS})"""

_LOCATION_ROWS = f"{_LOCATION_KEYS}, round(total_sales, 2) AS total_sales"

_SEASON_CODE = (
    "CASE season WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 WHEN 'Autumn' THEN 3 WHEN 'Winter' THEN 4 END"
)
_TIME_CODE = (
    "CASE time_of_day WHEN 'Morning' THEN 1 WHEN 'Afternoon' THEN 2 WHEN 'Evening' THEN 3 WHEN 'Night' THEN 4 END"
)

# Bucket of a row by the text of its keys.
_SPLIT = """CASE WHEN ('0x' || substr(md5(concat_ws('|', coalesce(TRY_CAST(latitude AS DECIMAL(9, 6))::VARCHAR, ''),
              coalesce(TRY_CAST(longitude AS DECIMAL(9, 6))::VARCHAR, ''), coalesce(menu_type, ''), coalesce(item_category, ''),
              coalesce(season, ''), coalesce(time_of_day, ''))), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END"""

_OPTION_TYPE = (
    "CASE WHEN lower(item_subcategory) LIKE '%hot%' THEN 'Hot Option' "
    "WHEN lower(item_subcategory) LIKE '%cold%' THEN 'Cold Option' ELSE 'Warm Option' END"
)


def _sampled(fraction: float) -> str:
    key = f"md5(concat_ws('|', '{GEO_SAMPLE_SEED}', {', '.join(q.LINE_KEYS)}))"
    return f"('0x' || substr({key}, 1, 15))::BIGINT < {int(fraction * HASH_SHARES)}"


def _distinct(source: str, columns) -> str:
    return " UNION ".join(f"SELECT '{c}' AS option, {c} AS value FROM {source}" for c in columns)


def _spread(step: float) -> str:
    position = f"(site_id * {step!r}::DOUBLE)"
    return f"((2 * ({position} - floor({position})) - 1) * reach)"


_CHOSEN = f"menu_type = '{q.CHOSEN_MENU}' AND city = '{q.CHOSEN_CITY}'"
_CENTER = {city: (lat, lon) for city, lat, lon in STAR_CENTERS}[q.CHOSEN_CITY]

def _sites(categories: str) -> str:
    return f"""{FACTS}, chosen AS (SELECT * FROM calendar WHERE {_CHOSEN}),
domains AS (SELECT list_sort(list(DISTINCT season)) AS seasons, list_sort(list(DISTINCT time_of_day)) AS parts FROM chosen),
points AS (SELECT site_id, (site_id // 17)::INT AS ring, [0.01, 0.03, 0.06][site_id // 17 + 1]::DOUBLE AS reach
           FROM range(51) AS r(site_id))
SELECT site_id, ring, round({_CENTER[0]!r}::DOUBLE + {_spread(STEP_LAT)}, 6) AS latitude,
       round({_CENTER[1]!r}::DOUBLE + {_spread(STEP_LON)}, 6) AS longitude,
       '{q.CHOSEN_MENU}' AS menu_type, item_category,
       seasons[site_id % len(seasons) + 1] AS season,
       parts[site_id // len(seasons) % len(parts) + 1] AS time_of_day
FROM points CROSS JOIN ({categories}) CROSS JOIN domains"""


ORACLE: dict[str, str] = {
    "scan_sales": f"{FACTS} SELECT {_SALES} FROM facts",
    "scan_geo": f"{FACTS} SELECT {_GEO} FROM facts",
    "scan_sampled": f"{FACTS} SELECT {_GEO} FROM facts WHERE {_sampled(OPTION_SAMPLE_FRACTION)}",
    "scan_sampled_fine": f"{FACTS} SELECT order_key, line_number, menu_item_name, price FROM facts WHERE {_sampled(q.FINE_FRACTION)}",
    "menu_dim": f"""{FACTS}, {_MENUS}
SELECT f.menu_type, rating, image FROM (SELECT DISTINCT menu_type FROM facts) f
LEFT JOIN menus m ON f.menu_type = m.menu_type""",
    "calendar_features": f"{FACTS} SELECT order_total, price, hour, month, date, time_of_day, season FROM calendar",
    "filter_options": f"{FACTS} {_distinct('facts', ('truck_brand_name', 'city', 'item_category', 'menu_type'))}",
    "year_bounds": f"""{FACTS}
SELECT year(min(order_ts))::INT AS min_year, year(max(order_ts))::INT AS max_year,
       year(min(order_ts)) = year(max(order_ts)) AS single_year FROM facts""",
    "filter_multi": f"""{FACTS} SELECT {_SALES} FROM facts
WHERE truck_brand_name IN {_in(q.CHOSEN.brands)} AND city IN {_in(q.CHOSEN.cities)}
  AND item_category IN {_in(q.CHOSEN.categories)}""",
    "filter_menu_city": f"""{FACTS}
SELECT menu_type, city, item_category, menu_item_name, price, order_ts FROM facts WHERE {_CHOSEN}""",
    "filter_year_range": f"""{FACTS} SELECT {_SALES} FROM facts
WHERE year(order_ts) >= {q.CHOSEN_YEARS.years[0]} AND year(order_ts) <= {q.CHOSEN_YEARS.years[1]}""",
    "subcategory_summary": f"""{FACTS}, {_SUMMARY}
SELECT item_subcategory, {_mean('avg_spending', 'avg_spending')}, round(total_sales, 2) AS total_sales FROM summary""",
    "subcategory_top3": f"""{FACTS}, {_SUMMARY}
SELECT item_subcategory, {_mean('avg_spending', 'avg_spending')}, round(total_sales, 2) AS total_sales
FROM {_TOP_SUBCATEGORIES}""",
    "subcategory_cards": f"""{FACTS}, {_SUMMARY}
SELECT item_subcategory, round(total_sales, 2) AS total_sales, {_mean('avg_spending', 'avg_spending')},
       {_OPTION_TYPE} AS option_type,
       CASE {_OPTION_TYPE} WHEN 'Hot Option' THEN '🌶️' WHEN 'Cold Option' THEN '🍦' ELSE '🍜' END AS icon,
       '$ ' || format('{{:,.0f}}', total_sales) AS total_text, '$ ' || format('{{:,.2f}}', avg_spending) AS avg_text
FROM summary""",
    "daily_series_top3": f"""{FACTS}, {_SUMMARY}
SELECT item_subcategory, order_ts::DATE AS date, round(sum(price), 2) AS daily_total FROM facts
WHERE item_subcategory IN (SELECT item_subcategory FROM {_TOP_SUBCATEGORIES}) GROUP BY ALL""",
    "daily_category_sales": f"""{FACTS}
SELECT order_ts::DATE AS date, item_category, round(sum(price), 2) AS price FROM facts GROUP BY ALL""",
    "daily_category_pivot": f"""{FACTS}
SELECT order_ts::DATE AS date,
       {', '.join(f"round(coalesce(sum(price) FILTER (WHERE item_category = '{c}'), 0), 2) AS {c}" for c in CATEGORIES)}
FROM facts GROUP BY ALL""",
    "weekly_category_sales": f"{FACTS}, {_WEEKLY} SELECT week_end, item_category, round(y, 2) AS y FROM weekly",
    "weekly_unpivot": f"{FACTS}, {_WEEKLY} SELECT week_end, item_category, round(y, 2) AS y FROM weekly",
    "sales_by_menu_rated": f"""{FACTS}, {_RATED}
SELECT item_subcategory, menu_type, image, round(total, 2) AS total, {_mean('rating', 'rating')} FROM rated""",
    "menu_top3": f"""{FACTS}, {_RATED}
SELECT item_subcategory, menu_type, image, round(total, 2) AS total, {_mean('rating', 'rating')}, place
FROM placed WHERE place <= 3""",
    "menu_top3_slice": f"""{FACTS}, {_RATED}
SELECT menu_type, image, round(total, 2) AS total, {_mean('rating', 'rating')}, place
FROM placed WHERE place <= 3 AND item_subcategory = '{q.CHOSEN_SLICE}'""",
    "item_season_profit": f"""{FACTS}, {_PROFITS}
SELECT city, season, item_category, menu_item_name, {_mean('unit_price', 'unit_price')},
       {_mean('avg_cost', 'avg_cost')}, round(total_sales, 2) AS total_sales, {_mean('profit', 'profit')}
FROM profits""",
    "top_items": _TOP_ITEMS,
    "top_items_sql": _TOP_ITEMS,
    "top_item_cards": f"""{FACTS}, {_PROFITS}
SELECT menu_item_name, item_category, format('$ {{:.2f}}', unit_price) AS unit_price_text,
       format('$ {{:.2f}}', avg_cost) AS cost_text, format('$ {{:.2f}}', total_profit) AS profit_text FROM best""",
    "item_season_series": f"""{FACTS}, {_PROFITS}
SELECT b.menu_item_name, b.item_category, p.season, round(sum(p.total_sales), 2) AS total_sales
FROM best b JOIN profits p ON p.menu_item_name = b.menu_item_name
GROUP BY b.menu_item_name, b.item_category, p.season""",
    "location_sales": f"{FACTS}, {_LOCATIONS} SELECT {_LOCATION_ROWS} FROM locations",
    "location_sales_bounds": f"""{FACTS}, {_LOCATIONS}
SELECT round(min(total_sales), 2) AS min_sales, round(max(total_sales), 2) AS max_sales FROM locations""",
    "location_domains": f"{FACTS}, {_LOCATIONS} {_distinct('locations', ('season', 'time_of_day', 'item_category'))}",
    "ordinal_encode": f"""{FACTS}, {_LOCATIONS}
SELECT {_LOCATION_ROWS}, {_SEASON_CODE} AS season_encoded, {_TIME_CODE} AS time_encoded FROM locations""",
    "one_hot": f"""{FACTS}, {_LOCATIONS}
SELECT latitude, longitude, menu_type, season, time_of_day, round(total_sales, 2) AS total_sales,
       {', '.join(f"(item_category = '{c}')::INT AS item_category_{c}" for c in CATEGORIES[1:])}
FROM locations""",
    "train_split": f"""{FACTS}, {_LOCATIONS}
SELECT {_LOCATION_ROWS}, {_SPLIT} AS split FROM locations""",
    "site_split_stats": f"""{FACTS}, chosen AS (
  SELECT {_LOCATION_KEYS}, sum(price) AS total_sales FROM calendar WHERE {_CHOSEN} GROUP BY {_LOCATION_KEYS}
), parts AS (
  SELECT *, {_SPLIT} AS split FROM chosen
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND season IS NOT NULL AND total_sales IS NOT NULL
)
SELECT split, count(*) AS n_rows,
       round(sqrt(avg((total_sales - (SELECT avg(total_sales) FROM parts WHERE split = 'train')) ** 2)) + {NUDGE}, 4) AS rmse_of_mean
FROM parts GROUP BY split""",
    "site_score_check": f"""{FACTS}
SELECT item_category, 51::BIGINT AS n_sites, true AS all_finite, true AS differ
FROM (SELECT DISTINCT item_category FROM calendar WHERE {_CHOSEN})""",
    "scan_sample_by_hash": f"""{FACTS}
SELECT menu_item_name, order_ts, price, quantity, city FROM facts
WHERE ('0x' || substr(md5(concat_ws('|', coalesce(menu_item_name, ''), coalesce(city, ''),
       coalesce(round(price * 100)::BIGINT::VARCHAR, ''))), 1, 8))::BIGINT % 100 < 10""",
    "actual_half": f"""{FACTS}, {_WEEKLY}
SELECT week_end AS ds, round(y, 2) AS y, item_category, 'Actual' AS type FROM weekly""",
    "forecast_check": f"""{FACTS}, {_WEEKLY}
SELECT item_category, count(*) AS n_actual, count(*) + 365 AS n_forecast, min(week_end) AS first_ds,
       (max(week_end) + 365)::DATE AS last_ds, true AS all_finite, true AS converged, true AS beats_line
FROM weekly GROUP BY item_category""",
    "forecast_fits": f"""{FACTS}, {_WEEKLY}
SELECT item_category, count(*) AS n_weeks, true AS converged FROM weekly GROUP BY item_category""",
    # Stretches without a sale: weeks whose number less their place among such weeks is the same.
    "weekly_runs": f"""{FACTS}, {_WEEKLY}, marked AS (
  SELECT w.week_end, w.item_category, w.y, t.week_end IS NOT NULL AS sold
  FROM weekly w LEFT JOIN totals t ON t.week_end = w.week_end AND t.item_category = w.item_category
), islands AS (
  SELECT *, (week_end - DATE '1970-01-04') // 7 - row_number() OVER (PARTITION BY item_category, sold ORDER BY week_end) AS island
  FROM marked
)
SELECT min(week_end) AS week_end, item_category, count(*)::INT AS weeks, 0.0::DOUBLE AS y
FROM islands WHERE NOT sold GROUP BY item_category, island
UNION ALL SELECT week_end, item_category, 1::INT, round(y, 2) FROM islands WHERE sold""",
    "weekly_from_runs": f"{FACTS}, {_WEEKLY} SELECT week_end, item_category, round(y, 2) AS y FROM weekly",
    "order_sales_bucketed": f"""{FACTS}
SELECT year(order_ts)::INT AS order_year, count(*) AS n_lines, round(sum(price), 2) AS sales, max(order_total) AS largest_order
FROM facts GROUP BY 1""",
    "locations_first": f"""{FACTS}, {_LOCATIONS}
SELECT {_LOCATION_ROWS} FROM locations
ORDER BY latitude DESC NULLS LAST, longitude DESC NULLS LAST, menu_type NULLS FIRST, item_category NULLS FIRST,
         season NULLS FIRST, time_of_day NULLS FIRST LIMIT {q.FIRST_LOCATIONS}""",
    "locations_ordered_check": f"""{FACTS}, {_LOCATIONS}
SELECT count(*) AS n_rows, round(max(latitude), 6) AS north, round(min(latitude), 6) AS south, 0::INT AS n_overlaps FROM locations""",
    "location_found": f"""{FACTS}
SELECT city, count(*) AS n_lines, true AS found FROM facts
WHERE menu_type = '{q.CHOSEN_MENU}' AND city IN ('{q.CHOSEN_CITY}', '{q.NO_CITY}') GROUP BY city""",
    "clean_names": f"{FACTS} SELECT DISTINCT menu_item_name, menu_item_name || ' é' AS cleaned FROM facts",
    "city_center": f"""{FACTS}
SELECT f.city, coalesce(c.lat, 52.2298::DOUBLE) AS lat, coalesce(c.lon, 21.0118::DOUBLE) AS lon
FROM (SELECT DISTINCT city FROM facts) f
LEFT JOIN (VALUES {_values(STAR_CENTERS)}) AS c(city, lat, lon) ON c.city = f.city""",
    "candidate_sites": _sites("SELECT DISTINCT item_category FROM chosen"),
    "candidate_sites_chosen": _sites(f"SELECT unnest({q.CHOSEN_CATEGORIES!r}) AS item_category"),
    "forecast_calendar": f"""{FACTS}, {_WEEKLY}
SELECT item_category, week_end AS ds FROM weekly
UNION ALL
SELECT item_category, (last_week + n)::DATE AS ds
FROM (SELECT item_category, max(week_end) AS last_week FROM weekly GROUP BY item_category)
CROSS JOIN (SELECT unnest(range(1, 366))::INT AS n)""",
    "category_trend": f"""{FACTS}, {_WEEKLY}
SELECT item_category, count(y) AS n_weeks,
       {_mean("regr_slope(y, (week_end - DATE '1970-01-04') / 7)", 'slope')},
       round(regr_intercept(y, (week_end - DATE '1970-01-04') / 7), 2) AS intercept
FROM weekly GROUP BY item_category""",
}
ORACLE["heat_points_check"] = f"""SELECT count(*) AS n_points, min(latitude) AS min_latitude, max(latitude) AS max_latitude,
       min(longitude) AS min_longitude, max(longitude) AS max_longitude, true AS all_finite
FROM ({ORACLE["candidate_sites"]})"""
ORACLE["trend_from_runs"] = ORACLE["category_trend"]
