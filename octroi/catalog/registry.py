"""Registry of named queries: a Spark callable and, where SQL can say it, a checking text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from octroi.operators.cleaning import NAME_WORDS
from octroi.sources.standins import Inputs, checker_sql

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Shared views for checking texts, beyond the stand-in inputs.
VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> str:
    VIEWS[name] = text
    return name


def query(key: str, check: str | None = None):
    """Registers a function of `Inputs` under `key` with an optional checking text."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = check
        return fn

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {k: bind(fn) for k, fn in QUERIES.items()}


def checking_texts() -> dict[str, str]:
    return {k: checker_sql(t, VIEWS) for k, t in CHECKS.items()}


# --- SQL fragments shared by checking texts ----------------------------------------------------


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: float) -> str:
    return (
        f"(CASE WHEN {lat1} + {lon1} + {lat2} + {lon2} IS NOT NULL THEN {2 * radius} * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) END)"
    )


def pipe_list(c: str, sep: str = "'|'") -> str:
    return (
        f"list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({c}, ''), {sep}),"
        " lambda s: trim(s)), lambda s: s <> '')))"
    )


def tokens(c: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(list_transform(string_split_regex(coalesce({c}, ''), '[|;,]'),"
        " lambda s: trim(s)), lambda s: s <> '')))"
    )


def norm_name(c: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents({c})), '\\s+', ' ', 'g'))"


def flag_cases() -> str:
    """One CASE for each flag that a gate's name can set."""
    holds = lambda w: f"contains(strip_accents(lower(canonical_name)), '{w}')"
    return ", ".join("CASE WHEN " + " OR ".join(map(holds, words)) + f" THEN '{flag}' END" for flag, words in NAME_WORDS.items())
