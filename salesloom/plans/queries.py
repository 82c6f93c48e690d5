"""The registered queries: every operator over the whole star-schema tables.

Sums are rounded to 2 digits and means to 4, so that results can be compared
with another engine that adds up in another order. Means get a nudge first: a
mean of few cent amounts can lie exactly between two roundings, where the last
bit of a sum would decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from salesloom.functions.calendar import with_calendar
from salesloom.functions.encoding import hash_bucket, one_hot, with_ordinals
from salesloom.functions.fixed_values import GEO_SAMPLE_SEED, OPTION_SAMPLE_FRACTION
from salesloom.functions.labels import clean_text
from salesloom.functions.names import quoted
from salesloom.operators import forecast, menus, model_store, options, profit, sites, summaries, weekly
from salesloom.operators.filters import Choice, SalesFilter, at_location, has_rows
from salesloom.session import table_folder
from salesloom.sources.dimensions import city_table, menu_table
from salesloom.sources.ordered import first_rows, overlaps, read_bounds, write_ordered
from salesloom.sources.sales import GEO_COLUMNS, SALES_COLUMNS, sample_by_key
from salesloom.sources.star import STAR_CENTERS, STAR_MENUS, bucket_star, star_sales

NUDGE = 1e-9

# Choices that the filter queries make.
CHOSEN = SalesFilter(
    brands=["Brand#1", "Brand#7", "Brand#14", "Brand#20"],
    cities=["NATION_2", "NATION_6", "NATION_9", "NATION_14"],
    categories=["bolt", "gear", "ring"],
)
CHOSEN_YEARS = SalesFilter(years=(1996, 1998))
CHOSEN_MENU, CHOSEN_CITY = "PROMO", "NATION_3"
NO_CITY = "NATION_99"
CHOSEN_CATEGORIES = ["bolt", "not sold"]
CHOSEN_SLICE = "hot"

LINE_KEYS = ("order_key", "line_number", "part_key", "supplier_key")
FINE_FRACTION = 0.001
BUCKETS = 8
FIRST_LOCATIONS = 100
# What tells locations apart, from north to south.
LOCATION_ORDER = (
    ("latitude", False),
    ("longitude", False),
    ("menu_type", True),
    ("item_category", True),
    ("season", True),
    ("time_of_day", True),
)


def _sum(*names: str) -> dict[str, Column]:
    return {name: F.round(F.col(quoted(name)), 2) for name in names}


def _mean(*names: str) -> dict[str, Column]:
    return {name: F.round(F.col(name) + NUDGE, 4) for name in names}


def _degrees(*names: str) -> dict[str, Column]:
    return {name: F.round(name, 6) for name in names}


def _sales(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: star_sales(spark, sf_dir, columns)


_priced_categories = _sales("price", "item_category", "order_ts")


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.weekly_category_sales(_priced_categories(spark, sf_dir))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = star_sales(spark, sf_dir, ("item_subcategory", "menu_type", "price"))
    return menus.sales_by_menu_rated(sales, menu_table(spark, STAR_MENUS))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.subcategory_summary(star_sales(spark, sf_dir, ("item_subcategory", "price")))


def _placed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("latitude", "longitude", "menu_type", "item_category", "order_ts", "price")
    return with_calendar(star_sales(spark, sf_dir, columns))


def _all_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.location_sales(_placed_sales(spark, sf_dir))


def _kept(totals: DataFrame) -> DataFrame:
    """Cached totals, for results that first look up which values become columns.

    The facts are scanned once for both steps. What is kept has a row per day or
    week and category, or per location, and goes when the session or its cache is
    cleared: the result that is built on it is lazy and reads it later.
    """
    return totals.persist(StorageLevel.MEMORY_AND_DISK)


def _chosen_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("latitude", "longitude", "menu_type", "city", "item_category", "order_ts", "price")
    chosen = star_sales(spark, sf_dir, columns).transform(at_location, CHOSEN_MENU, CHOSEN_CITY)
    return sites.location_sales(with_calendar(chosen))


def _chosen_sites(spark: SparkSession, sf_dir: str, categories: Choice = None) -> DataFrame:
    center = sites.center_of(CHOSEN_CITY, STAR_CENTERS)
    return sites.candidate_sites(_chosen_locations(spark, sf_dir), CHOSEN_MENU, center, categories)


def _model(spark: SparkSession, sf_dir: str) -> PipelineModel | None:
    """The model of the chosen place, trained once for all queries over the same rows."""
    return model_store.site_model(_chosen_locations(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.score_sites(_model(spark, sf_dir), _chosen_sites(spark, sf_dir))


def _profits(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("city", "item_category", "menu_item_name", "unit_price", "cost_of_goods_usd", "price", "order_ts")
    return profit.item_season_profit(with_calendar(star_sales(spark, sf_dir, columns)))


def scan_sales(spark, sf_dir):
    return star_sales(spark, sf_dir, SALES_COLUMNS)


def scan_geo(spark, sf_dir):
    return star_sales(spark, sf_dir, GEO_COLUMNS)


def _sampled(spark: SparkSession, sf_dir: str, fraction: float) -> DataFrame:
    lines = star_sales(spark, sf_dir, (*GEO_COLUMNS, *LINE_KEYS))
    return sample_by_key(lines, LINE_KEYS, fraction, GEO_SAMPLE_SEED)


def scan_sampled(spark, sf_dir):
    """A tenth of the order lines by a hash of their keys and a seed."""
    return _sampled(spark, sf_dir, OPTION_SAMPLE_FRACTION).select(*GEO_COLUMNS)


def scan_sampled_fine(spark, sf_dir):
    """A thousandth of the order lines, which lies within the tenth."""
    return _sampled(spark, sf_dir, FINE_FRACTION).select("order_key", "line_number", "menu_item_name", "price")


def menu_dim(spark, sf_dir):
    return menus.menus_on_sale(star_sales(spark, sf_dir, ("menu_type",)), menu_table(spark, STAR_MENUS))


def calendar_features(spark, sf_dir):
    ts = F.col("order_ts")
    sales = star_sales(spark, sf_dir, ("order_ts", "order_total", "price"))
    return with_calendar(sales.withColumns({"hour": F.hour(ts), "month": F.month(ts)}))


def filter_options(spark, sf_dir):
    return options.distinct_values(star_sales(spark, sf_dir, options.OPTION_COLUMNS))


def year_bounds(spark, sf_dir):
    return options.year_bounds(star_sales(spark, sf_dir, ("order_ts",)))


def filter_multi(spark, sf_dir):
    return star_sales(spark, sf_dir, SALES_COLUMNS).transform(CHOSEN)


def filter_menu_city(spark, sf_dir):
    columns = ("menu_type", "city", "item_category", "menu_item_name", "price", "order_ts")
    return star_sales(spark, sf_dir, columns).transform(at_location, CHOSEN_MENU, CHOSEN_CITY)


def filter_year_range(spark, sf_dir):
    return star_sales(spark, sf_dir, SALES_COLUMNS, years=CHOSEN_YEARS.years).transform(CHOSEN_YEARS)


def subcategory_summary(spark, sf_dir):
    return _summary(spark, sf_dir).withColumns(_mean("avg_spending") | _sum("total_sales"))


def subcategory_top3(spark, sf_dir):
    top = summaries.top_subcategories(_summary(spark, sf_dir))
    return top.withColumns(_mean("avg_spending") | _sum("total_sales"))


def subcategory_cards(spark, sf_dir):
    cards = summaries.subcategory_cards(_summary(spark, sf_dir))
    return cards.withColumns(_mean("avg_spending") | _sum("total_sales"))


def daily_series_top3(spark, sf_dir):
    sales = star_sales(spark, sf_dir, ("item_subcategory", "price", "order_ts"))
    return summaries.top_daily_series(sales).withColumns(_sum("daily_total"))


def daily_category_sales(spark, sf_dir):
    return summaries.daily_category_sales(_priced_categories(spark, sf_dir)).withColumns(_sum("price"))


def daily_category_pivot(spark, sf_dir):
    daily = _kept(summaries.daily_category_sales(_priced_categories(spark, sf_dir)))
    categories = options.levels(daily, "item_category")
    wide = summaries.daily_category_pivot(daily, categories)
    return wide.withColumns(_sum(*(name for name in wide.columns if name != "date")))


def weekly_category_sales(spark, sf_dir):
    return _weekly(spark, sf_dir).withColumns(_sum("y"))


def weekly_unpivot(spark, sf_dir):
    long = _kept(_weekly(spark, sf_dir))
    wide = weekly.weekly_wide(long, options.levels(long, "item_category"))
    return weekly.weekly_long(wide).withColumns(_sum("y"))


def sales_by_menu_rated(spark, sf_dir):
    return _rated(spark, sf_dir).withColumns(_sum("total") | _mean("rating"))


def menu_top3(spark, sf_dir):
    return menus.menu_top(_rated(spark, sf_dir)).withColumns(_sum("total") | _mean("rating"))


def menu_top3_slice(spark, sf_dir):
    top = menus.menu_slice(menus.menu_top(_rated(spark, sf_dir)), CHOSEN_SLICE)
    return top.withColumns(_sum("total") | _mean("rating"))


def item_season_profit(spark, sf_dir):
    profits = profit.by_profit(_profits(spark, sf_dir))
    return profits.withColumns(_mean("unit_price", "avg_cost", "profit") | _sum("total_sales"))


def top_items(spark, sf_dir):
    return profit.top_items(_profits(spark, sf_dir)).withColumns(
        _mean("unit_price", "avg_cost", "total_profit")
    )


def top_items_sql(spark, sf_dir):
    return profit.top_items_sql(_profits(spark, sf_dir)).withColumns(
        _mean("unit_price", "avg_cost", "total_profit")
    )


def top_item_cards(spark, sf_dir):
    return profit.item_cards(profit.top_items(_profits(spark, sf_dir)))


def item_season_series(spark, sf_dir):
    return profit.top_item_season_series(_profits(spark, sf_dir)).withColumns(_sum("total_sales"))


def location_sales(spark, sf_dir):
    ordered = sites.north_to_south(_all_locations(spark, sf_dir))
    return ordered.withColumns(_sum("total_sales"))


def location_sales_bounds(spark, sf_dir):
    return sites.sales_bounds(_all_locations(spark, sf_dir)).withColumns(_sum("min_sales", "max_sales"))


def location_domains(spark, sf_dir):
    return sites.location_domains(_placed_sales(spark, sf_dir))


def ordinal_encode(spark, sf_dir):
    encoded = with_ordinals(_all_locations(spark, sf_dir))
    return encoded.withColumns(_sum("total_sales"))


def one_hot_categories(spark, sf_dir):
    locations = _kept(_all_locations(spark, sf_dir))
    categories = [name for name in options.levels(locations, "item_category") if name is not None]
    return one_hot(locations, "item_category", categories).withColumns(_sum("total_sales"))


def train_split(spark, sf_dir):
    split = sites.with_split(_all_locations(spark, sf_dir))
    return split.withColumns(_sum("total_sales"))


def city_center(spark, sf_dir):
    cities = star_sales(spark, sf_dir, ("city",)).distinct()
    return sites.city_centers(cities, city_table(spark, STAR_CENTERS))


def candidate_sites(spark, sf_dir):
    return _chosen_sites(spark, sf_dir).withColumns(_degrees("latitude", "longitude"))


def candidate_sites_chosen(spark, sf_dir):
    """Sites of chosen categories, one of which is not sold there."""
    return _chosen_sites(spark, sf_dir, CHOSEN_CATEGORIES).withColumns(_degrees("latitude", "longitude"))


def site_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


def heat_points(spark, sf_dir):
    return sites.heat_points(_scores(spark, sf_dir))


def site_model_metrics(spark, sf_dir):
    return sites.model_metrics(_model(spark, sf_dir), _chosen_locations(spark, sf_dir))


def site_split_stats(spark, sf_dir):
    """The part of the metrics that does not depend on the model."""
    return sites.split_stats(_chosen_locations(spark, sf_dir)).withColumns(_mean("rmse_of_mean"))


def site_score_check(spark, sf_dir):
    """Of each category the scored sites, and whether all scores are finite and differ."""
    score = F.col("predicted_sales")
    return _scores(spark, sf_dir).groupBy("item_category").agg(
        F.count("*").alias("n_sites"),
        F.bool_and(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).alias("all_finite"),
        (F.count_distinct(score) > 1).alias("differ"),
    )


def scan_sample_by_hash(spark, sf_dir):
    """A tenth of the order lines by a hash of their columns, the same on every engine."""
    lines = star_sales(spark, sf_dir, ("menu_item_name", "order_ts", "price", "quantity", "city"))
    cents = F.round(F.col("price") * 100).cast("long").cast("string")
    bucket = hash_bucket(F.coalesce("menu_item_name", F.lit("")), F.coalesce("city", F.lit("")), F.coalesce(cents, F.lit("")))
    return lines.where(bucket < round(100 * OPTION_SAMPLE_FRACTION))


def forecast_calendar(spark, sf_dir):
    return forecast.forecast_calendar(_weekly(spark, sf_dir))


def category_trend(spark, sf_dir):
    return forecast.category_trend(_weekly(spark, sf_dir)).withColumns(_mean("slope") | _sum("intercept"))


def category_forecast(spark, sf_dir):
    return forecast.category_forecast(_weekly(spark, sf_dir))


def actual_vs_forecast(spark, sf_dir):
    return forecast.actual_vs_forecast(_weekly(spark, sf_dir))


def forecast_fits(spark, sf_dir):
    """Of each category the weeks that its model was fitted to, and whether the fit converged."""
    return forecast.forecast_fits(_weekly(spark, sf_dir)).select("item_category", "n_weeks", "converged")


def weekly_runs(spark, sf_dir):
    return weekly.weekly_runs(_priced_categories(spark, sf_dir)).withColumns(_sum("y"))


def weekly_from_runs(spark, sf_dir):
    return weekly.unfolded(weekly.weekly_runs(_priced_categories(spark, sf_dir))).withColumns(_sum("y"))


def trend_from_runs(spark, sf_dir):
    runs = weekly.weekly_runs(_priced_categories(spark, sf_dir))
    return forecast.trend_of_runs(runs).withColumns(_mean("slope") | _sum("intercept"))


def order_sales_bucketed(spark, sf_dir):
    """Sales by year of order, from orders and lines stored in buckets by order key."""
    tables = bucket_star(spark, sf_dir, f"{table_folder(spark)}/buckets-{uuid.uuid4().hex}", BUCKETS)
    lines = star_sales(spark, sf_dir, ("order_ts", "price", "order_total"), tables=tables)
    by_year = lines.groupBy(F.year("order_ts").alias("order_year"))
    return by_year.agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("price").alias("sales"), F.max("order_total").alias("largest_order")
    ).withColumns(_sum("sales"))


def _ordered_locations(spark: SparkSession, sf_dir: str) -> str:
    path = f"{table_folder(spark)}/locations-{uuid.uuid4().hex}"
    write_ordered(_all_locations(spark, sf_dir), path, LOCATION_ORDER)
    return path


def locations_first(spark, sf_dir):
    """The northernmost location totals, from the first ranges of a table that is kept in order."""
    rows = first_rows(spark, _ordered_locations(spark, sf_dir), FIRST_LOCATIONS)
    return rows.withColumns(_sum("total_sales"))


def locations_ordered_check(spark, sf_dir):
    """Rows of the ordered table by its bounds, and how many of its ranges overlap."""
    path = _ordered_locations(spark, sf_dir)
    counted = read_bounds(spark, path).agg(F.sum("n_rows").alias("n_rows"), F.max("most0").alias("north"), F.min("least0").alias("south"))
    return counted.withColumns(_degrees("north", "south")).withColumn("n_overlaps", F.lit(overlaps(spark, path)))


def heat_points_check(spark, sf_dir):
    """Of the heat points their number, the box they lie in, and whether all weights are finite."""
    weight = F.col("predicted_sales")
    return heat_points(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_points"),
        *(F.round(f(name), 6).alias(f"{f.__name__}_{name}") for name in ("latitude", "longitude") for f in (F.min, F.max)),
        F.bool_and(weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) < float("inf"))).alias("all_finite"),
    )


def location_found(spark, sf_dir):
    """Whether a place has sales at all, for the chosen place and for one that has none, with their numbers of lines."""
    sales = star_sales(spark, sf_dir, ("menu_type", "city", "item_category"))
    found = [(city, has_rows(sales.transform(at_location, CHOSEN_MENU, city))) for city in (CHOSEN_CITY, NO_CITY)]
    city, guard = F.col("city"), F.lit(False)
    for name, any_row in found:
        guard = F.when(city == name, F.lit(any_row)).otherwise(guard)
    here = sales.where(F.col("menu_type") == CHOSEN_MENU).groupBy("city").agg(F.count(F.lit(1)).alias("n_lines"))
    return here.where(city.isin(*(name for name, _ in found))).withColumn("found", guard)


def clean_names(spark, sf_dir):
    """Item names with a byte in them that is no UTF-8, and the same without it."""
    names = star_sales(spark, sf_dir, ("menu_item_name",)).distinct()
    broken = F.concat(F.col("menu_item_name").cast("binary"), F.unhex(F.lit("ff")), F.lit(" é").cast("binary")).cast("string")
    return names.select("menu_item_name", clean_text(broken).alias("cleaned"))


def actual_half(spark, sf_dir):
    """The rows of ``actual_vs_forecast`` that are no forecast."""
    return actual_vs_forecast(spark, sf_dir).where("type = 'Actual'").drop("converged").withColumns(_sum("y"))


def forecast_check(spark, sf_dir):
    """Of each category both kinds of rows, their dates, and whether the fit beats a straight line."""
    rows = actual_vs_forecast(spark, sf_dir)
    both = rows.groupBy("item_category", "ds").agg(
        F.max(F.when(F.col("type") == "Actual", F.col("y"))).alias("sold"),
        F.max(F.when(F.col("type") == "Forecast", F.col("y"))).alias("fit"),
        F.bool_and("converged").alias("ended"),
    )
    day = F.when(F.col("sold").isNotNull(), F.unix_date("ds"))
    return both.groupBy("item_category").agg(
        F.count("sold").alias("n_actual"),
        F.count("fit").alias("n_forecast"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.bool_and(F.abs("fit") < float("inf")).alias("all_finite"),
        F.bool_and("ended").alias("converged"),
        # What a line leaves unexplained, against what the model does.
        (
            F.sum(F.pow(F.col("sold") - F.col("fit"), 2))
            <= F.regr_syy("sold", day) - F.pow(F.regr_sxy("sold", day), 2) / F.regr_sxx("sold", day)
        ).alias("beats_line"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_sales": scan_sales,
    "scan_geo": scan_geo,
    "scan_sampled": scan_sampled,
    "menu_dim": menu_dim,
    "calendar_features": calendar_features,
    "filter_options": filter_options,
    "year_bounds": year_bounds,
    "filter_multi": filter_multi,
    "filter_menu_city": filter_menu_city,
    "filter_year_range": filter_year_range,
    "subcategory_summary": subcategory_summary,
    "subcategory_top3": subcategory_top3,
    "subcategory_cards": subcategory_cards,
    "daily_series_top3": daily_series_top3,
    "daily_category_sales": daily_category_sales,
    "daily_category_pivot": daily_category_pivot,
    "weekly_category_sales": weekly_category_sales,
    "weekly_unpivot": weekly_unpivot,
    "sales_by_menu_rated": sales_by_menu_rated,
    "menu_top3": menu_top3,
    "menu_top3_slice": menu_top3_slice,
    "item_season_profit": item_season_profit,
    "top_items": top_items,
    "top_items_sql": top_items_sql,
    "top_item_cards": top_item_cards,
    "item_season_series": item_season_series,
    "location_sales": location_sales,
    "location_sales_bounds": location_sales_bounds,
    "location_domains": location_domains,
    "ordinal_encode": ordinal_encode,
    "one_hot": one_hot_categories,
    "train_split": train_split,
    "city_center": city_center,
    "candidate_sites": candidate_sites,
    "site_scores": site_scores,
    "heat_points": heat_points,
    "site_model_metrics": site_model_metrics,
    "candidate_sites_chosen": candidate_sites_chosen,
    "site_split_stats": site_split_stats,
    "site_score_check": site_score_check,
    "scan_sample_by_hash": scan_sample_by_hash,
    "forecast_calendar": forecast_calendar,
    "category_trend": category_trend,
    "category_forecast": category_forecast,
    "actual_vs_forecast": actual_vs_forecast,
    "actual_half": actual_half,
    "forecast_check": forecast_check,
    "forecast_fits": forecast_fits,
    "scan_sampled_fine": scan_sampled_fine,
    "weekly_runs": weekly_runs,
    "weekly_from_runs": weekly_from_runs,
    "trend_from_runs": trend_from_runs,
    "order_sales_bucketed": order_sales_bucketed,
    "locations_first": locations_first,
    "locations_ordered_check": locations_ordered_check,
    "heat_points_check": heat_points_check,
    "location_found": location_found,
    "clean_names": clean_names,
}
