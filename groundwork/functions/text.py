"""Text expressions: slugs, lists, fenced blocks, log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and line ends that the log and list formats recognise.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
LINE_ENDS = "\n\r\u2028\u2029"

# Fixed values: "[tag] message", the tag and the message each within one line.
LOG_LINE = rf"^\[([^\]{LINE_ENDS}]*)\][{SPACES}]*([^{LINE_ENDS}]*)"

# Fixed value: the fence that marks a chart inside an answer.
CHART_FENCE = "chartjs"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written once, so a pushed-down filter does not repeat it."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of every kind, line ends included."""
    return F.btrim(col, F.lit(SPACES))


def slug(col: Column) -> Column:
    """Identifier form of a name: lower case, each run of white space one underscore."""
    return F.regexp_replace(F.lower(col), f"[{SPACES}]+", "_")


def split_list(col: Column) -> Column:
    """Comma list to an array of stripped, non-empty items."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda item: item != "")


def fenced_block(col: Column, fence: str = CHART_FENCE) -> Column:
    """Content of the first fenced block, or NULL when there is none or it is not JSON."""
    body = strip(F.regexp_extract(col, rf"(?s)```{fence}(.*?)```", 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def without_block(col: Column, fence: str = CHART_FENCE) -> Column:
    """The text without its first fenced block; unchanged when that block is not JSON."""
    cut = F.regexp_replace(col, rf"(?s)^(.*?)```{fence}.*?```", "$1")
    return F.when(fenced_block(col, fence).isNotNull(), cut).otherwise(col)


def iso_utc(col: Column) -> Column:
    """Timestamp as ``2024-01-31T08:00:00Z``."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_text(fmt: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    """The query's start time as text."""
    return F.date_format(F.current_timestamp(), fmt)


def json_array(col: Column) -> Column:
    """JSON text of a string array as an array column."""
    return F.from_json(col, "array<string>")


def is_blank(col: Column) -> Column:
    return F.coalesce(F.trim(col) == "", F.lit(True))
