"""Match and score of a node name against one query string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_subsequence(name: Column, query: str) -> Column:
    """All characters of ``query`` occur in ``name`` in this order (any case).

    One left-to-right scan: before each wanted character only others may stand.
    """
    pattern = "".join(f"[^{_in_class(c)}]*{re.escape(c)}" for c in query.lower())
    return F.lower(name).rlike(f"(?s)^{pattern}")


def _in_class(c: str) -> str:
    return "\\" + c if c in r"\]^-[&~#" else c


def longest_run(name: Column, query: str | Column) -> Column:
    """Longest stretch of neighbouring characters in the greedy match."""
    return greedy_match(name, query)["best"]


def greedy_match(name: Column, query: str | Column) -> Column:
    """One scan over ``name`` that takes each character of ``query`` where it first can.

    A struct of hit, the characters found, and best, the longest run of neighbours.
    """
    letters = F.split(F.lower(query), "") if isinstance(query, Column) else F.array(*[F.lit(c) for c in query.lower()])
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, ch: Column) -> Column:
        match = F.coalesce(ch == F.get(letters, acc["hit"]), F.lit(False))
        run = F.when(match, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(
            (acc["hit"] + match.cast("int")).alias("hit"), run.alias("run"), F.greatest(acc["best"], run).alias("best")
        )

    return F.aggregate(F.split(F.lower(name), ""), start, step)


def relevance(name: Column, query: str, child_count: Column, level: Column) -> Column:
    """Score of a match; 0 for no match. Fixed weights of the scoring rule."""
    base = F.coalesce(_contained(name, F.lit(query.lower())), _fuzzy(name, longest_run(name, query), F.lit(len(query))))
    return F.when(is_subsequence(name, query), base + _place_bonus(child_count, level)).otherwise(0.0)


def relevance_to(name: Column, query: Column, child_count: Column, level: Column) -> Column:
    """As ``relevance``, for a query that is a column."""
    match = greedy_match(name, query)
    fuzzy = F.when(match["hit"] == F.length(query), _fuzzy(name, match["best"], F.length(query)))
    return F.coalesce(F.coalesce(_contained(name, F.lower(query)), fuzzy) + _place_bonus(child_count, level), F.lit(0.0))


def _fuzzy(name: Column, run: Column, asked: Column) -> Column:
    return 200.0 + run * 10 - F.greatest(F.lit(0.0), F.length(name).cast("double") - 2.0 * asked)


def _contained(name: Column, q: Column) -> Column:
    """Score of equality, prefix or substring; null for none of them."""
    lower, size = F.lower(name), F.length(name).cast("double")
    at = F.position(q, lower) - 1
    return (
        F.when(lower == q, F.lit(1000.0))
        .when(at == 0, 800.0 + F.greatest(F.lit(0.0), 100.0 - size))
        .when(at > 0, 400.0 + F.greatest(F.lit(0.0), 50.0 - at) + F.greatest(F.lit(0.0), 50.0 - size / 2))
    )


def _place_bonus(child_count: Column, level: Column) -> Column:
    few = F.when(child_count == 0, 30.0).when(child_count < 10, 20.0).otherwise(0.0)
    return few + F.when(level.between(2, 8), 10.0).otherwise(0.0)


def path_bonus(path_names: Column, query: str | Column) -> Column:
    """100 when the full path contains the query, 50 more when the parent path does."""
    q = F.lower(query) if isinstance(query, Column) else F.lit(query.lower())
    full = F.lower(F.array_join(path_names, " / "))
    parent = F.lower(F.array_join(F.slice(path_names, F.lit(1), F.greatest(F.size(path_names) - 1, F.lit(0))), " / "))
    in_full = F.contains(full, q)
    return F.when(in_full, F.lit(100.0) + F.when(F.contains(parent, q), 50.0).otherwise(0.0)).otherwise(0.0)
