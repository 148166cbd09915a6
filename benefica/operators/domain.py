"""Filters given as data: prefix-notation lists of (path, operator, value)."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.functions.text import is_similar, trigrams


@dataclass(frozen=True)
class Relation:
    """A child table reached by a dotted path: rows meet where ``local`` equals ``foreign``."""

    table: DataFrame
    local: str
    foreign: str


def parse_domain(text: str) -> list:
    """Domain given as text; only literals are read."""
    domain = ast.literal_eval(text or "[]")
    if not isinstance(domain, list):
        raise ValueError("a domain is a list")
    return domain


def leaf_column(name: str, op: str, value) -> Column:
    """One condition.  An empty value means "not set"; negative operators keep rows that are not set."""
    c = F.col(name)
    unset = c.isNull()
    if op == "=?":
        return F.lit(True) if value in (None, False) else leaf_column(name, "=", value)
    if op in ("=", "!="):
        if value is None or value is False:
            test = unset | (F.coalesce(c.cast("string"), F.lit("false")) == "false") if value is False else unset
            return test if op == "=" else ~test
        return F.coalesce(c == value, F.lit(False)) if op == "=" else F.coalesce(c != value, F.lit(True))
    if op in ("in", "not in"):
        values = [v for v in value if v not in (None, False)]
        inside = F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)
        if len(values) < len(list(value)):
            inside = inside | unset
        return inside if op == "in" else ~inside
    if op in ("<", "<=", ">", ">="):
        test = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
        return F.coalesce(test, F.lit(False))
    if op in ("like", "not like", "ilike", "not ilike"):
        text, want = (c, value) if op.endswith(" like") or op == "like" else (F.lower(c), value.lower())
        hit = F.coalesce(text.contains(want), F.lit(False))
        return ~hit if op.startswith("not") else hit
    if op == "%":
        return F.coalesce(is_similar(trigrams(c), trigrams(F.lit(value))), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def domain_filter(df: DataFrame, domain: list, relations: dict[str, Relation] | None = None) -> DataFrame:
    """Rows for which the domain holds.

    A condition on a dotted path holds when some child row satisfies it.  When it
    is one of the top-level, implicitly joined conditions it is a semi join;
    below ``|`` or ``!`` the matching parents are marked by a left join.
    """
    relations = relations or {}
    columns = df.columns
    marks = 0

    def parents(path: str, op: str, value):
        head, rest = path.split(".", 1)
        r = relations[head]
        kept = domain_filter(r.table, [(rest, op, value)], relations)
        return r.local, kept.select(F.col(r.foreign).alias("_key")).where("_key IS NOT NULL").distinct()

    def is_path(term) -> bool:
        return not isinstance(term, str) and "." in term[0]

    plain, stack = [], []
    if not any(t in ("|", "!") for t in domain if isinstance(t, str)):
        for term in domain:
            if is_path(term):
                local, keys = parents(*term)
                df = df.join(keys, F.col(local) == F.col("_key"), "left_semi")
            elif term != "&":
                plain.append(leaf_column(*term))
        for c in plain:
            df = df.where(c)
        return df

    for term in reversed(domain):
        if isinstance(term, str):
            if term == "!":
                stack.append(~stack.pop())
            else:
                a, b = stack.pop(), stack.pop()
                stack.append(a & b if term == "&" else a | b)
        elif is_path(term):
            local, keys = parents(*term)
            mark, key = f"_mark{marks}", f"_key{marks}"
            marks += 1
            keys = keys.select(F.col("_key").alias(key), F.lit(True).alias(mark))
            df = df.join(keys, F.col(local) == F.col(key), "left")
            stack.append(F.coalesce(F.col(mark), F.lit(False)))
        else:
            stack.append(leaf_column(*term))
    while stack:
        df = df.where(stack.pop())
    return df.select(*columns)
