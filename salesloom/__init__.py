"""Sales analytics on Spark: filter, summarise, forecast and score sales facts."""

from salesloom.operators.filters import SalesFilter, at_location
from salesloom.plans.hotspots import Hotspots
from salesloom.plans.projection import SalesProjection
from salesloom.session import build_session
from salesloom.sources.sales import read_sales, write_sales

__all__ = [
    "Hotspots",
    "SalesFilter",
    "SalesProjection",
    "at_location",
    "build_session",
    "read_sales",
    "write_sales",
]
