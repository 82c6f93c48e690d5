"""Display labels: option type, icon and money text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesloom.functions.fixed_values import OPTION_DEFAULT, OPTION_ICONS, OPTION_WORDS


def option_type(name: Column) -> Column:
    """Hot, cold or warm, by the first known word found anywhere in the name."""
    lowered = F.lower(name)
    label = reduce(lambda case, rule: case.when(lowered.contains(rule[0]), rule[1]), OPTION_WORDS, F)
    return label.otherwise(OPTION_DEFAULT)


def option_icon(option: Column) -> Column:
    """Icon of an option type; empty text for an unknown one."""
    pairs = [F.lit(part) for pair in OPTION_ICONS.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), option), F.lit(""))


def money(amount: Column, digits: int) -> Column:
    """``$ 1,234.50`` with thousands separators."""
    return F.concat(F.lit("$ "), F.format_number(amount, digits))


def plain_money(amount: Column) -> Column:
    """``$ 1234.50`` without thousands separators."""
    return F.concat(F.lit("$ "), F.call_function("format_number", amount, F.lit("0.00")))


def clean_text(text: Column) -> Column:
    """``text`` without bytes that are no valid UTF-8; valid text is left as it is."""
    marked = F.make_valid_utf8(text)
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(marked, F.lit("\ufffd"), F.lit("")))
