"""A QuerySpec over a QueryTable to one DataFrame expression: names resolved, literals typed, patterns translated."""

from __future__ import annotations

import operator
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.plans.parser import parse
from folio.types import Comparison, QueryError, QueryResult, QuerySpec, QueryTable

_OPS = {"==": operator.eq, "<=": operator.le, "<": operator.lt, ">": operator.gt, ">=": operator.ge}
#: Date parts by the names that data frames use; weekday counts from Monday as 0.
_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "quarter": F.quarter, "dayofyear": F.dayofyear, "day_of_year": F.dayofyear, "weekday": F.weekday, "dayofweek": F.weekday, "day_of_week": F.weekday,
}
_MOMENTS = ("%Y", "%Y-%m", "%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S")


def resolve(df: DataFrame, name: str) -> str | None:
    """The column of that name; hyphens stand for underscores."""
    if name in df.columns:
        return name
    other = name.replace("-", "_")
    return other if other in df.columns else None


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A Python pattern in Java's dialect, with Unicode case rules and, where classes are used, Unicode classes."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    flags = ("iu" if ignore_case else "") + ("U" if re.search(r"\\[wWdDsSbB]", out) else "")
    return f"(?{flags}){out}" if flags else out


def _usable(df: DataFrame, pattern: str) -> str | None:
    """Why a pattern can't be used, or None."""
    try:
        re.compile(pattern)
    except re.error as wrong:
        return str(wrong)
    machine = getattr(df.sparkSession, "_jvm", None)
    if machine is not None:
        try:
            machine.java.util.regex.Pattern.compile(java_pattern(pattern))
        except Exception as wrong:
            return str(getattr(wrong, "java_exception", wrong)).splitlines()[0]
    return None


def matches(column: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether a value, as text, has a match anywhere; null never has."""
    return column.cast("string").rlike(java_pattern(pattern, ignore_case))


def _typed(kind: T.DataType, c: Comparison) -> Column:
    """The literal in the column's type: how it was spelt doesn't matter."""
    text = c.literal
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return F.lit(text)
    try:
        if isinstance(kind, T.IntegralType):
            return F.lit(int(text)) if re.fullmatch(r"-?\d+", text) and abs(int(text)) < 1 << 63 else F.lit(float(text))
        if isinstance(kind, T.NumericType):
            return F.lit(float(text))
        if isinstance(kind, T.BooleanType):
            return F.lit({"true": True, "false": False, "1": True, "0": False}[text.lower()])
    except (ValueError, KeyError):
        raise QueryError(f"{c.column} is {kind.simpleString()}, which {text!r} is not") from None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        for form in _MOMENTS:
            try:
                moment = datetime.strptime(text, form)
            except ValueError:
                continue
            # cast from text, so that the session's time zone applies to zoned columns
            return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast(kind if not isinstance(kind, T.DateType) else "timestamp_ntz")
        raise QueryError(f"{text!r} is not a date like 2024, 2024-05, 2024-05-01 or 2024-05-01 10:30")
    raise QueryError(f"{c.column} is {kind.simpleString()} and can't be compared")


def comparison(df: DataFrame, c: Comparison) -> Column:
    name = resolve(df, c.column)
    part = re.fullmatch(r"(.+)\.dt\.(\w+)", c.column)
    if name is None and part and part[2] in _PARTS and resolve(df, part[1]):
        value, kind = _PARTS[part[2]](F.col(f"`{resolve(df, part[1])}`")), T.IntegerType()
    elif name is None:
        raise QueryError(f"no column {c.column!r}")
    else:
        value, kind = F.col(f"`{name}`"), df.schema[name].dataType
    return _OPS[c.op](value, _typed(kind, c))


def shown(table: QueryTable, spec: QuerySpec) -> list[str]:
    """Names of the columns that come out."""
    df = table.df
    include = list(spec.include)
    if include[:1] == ["*"]:
        include = [*df.columns, *include[1:]]
    names = [c for c in table.base_cols if c in df.columns]
    for c in (resolve(df, x) for x in include):
        if c and c not in names:
            names.append(c)
    gone = {resolve(df, x) for x in spec.exclude}
    names = [c for c in names if c not in gone]
    if "recent" in spec.flags and table.recent_field in df.columns and table.recent_field not in names:
        names.insert(0, table.recent_field)
    return names


def filtered(table: QueryTable, spec: QuerySpec) -> tuple[DataFrame, list[str]]:
    """Rows that all comparisons and patterns keep; a pattern that is no regex is left out, with a message."""
    df, said = table.df, list(spec.messages)
    for c in spec.where:
        df = df.where(comparison(table.df, c))
    for field, pattern in spec.regex:
        name = resolve(table.df, field or table.bang_field)
        if name is None:
            raise QueryError(f"no column {field!r}")
        wrong = _usable(table.df, pattern)
        if wrong:
            said.append(f"regex {pattern!r} left out: {wrong}")
        else:
            df = df.where(matches(F.col(f"`{name}`"), pattern))
    return df, said


def order(table: QueryTable, spec: QuerySpec) -> list[Column]:
    """Sort keys, nulls last both ways; the table's keys settle ties, and order rows before a bare `top`."""
    keys = []
    if "recent" in spec.flags:
        keys = [(table.recent_field, False)]
    elif spec.sort:
        keys = list(spec.sort)
    out = []
    for name, up in keys:
        found = resolve(table.df, name)
        if found is None:
            raise QueryError(f"no column {name!r}")
        c = F.col(f"`{found}`")
        out.append(c.asc_nulls_last() if up else c.desc_nulls_last())
    if out or spec.top > 0:
        out += [F.col(f"`{k}`").asc_nulls_last() for k in table.keys if k in table.df.columns]
    return out


def without_empty(df: DataFrame) -> DataFrame:
    """df without string columns that hold nothing but ''; a job. Null is not '', and no rows keep all columns."""
    names = [c for c, kind in df.dtypes if kind == "string"]
    if not names:
        return df
    row = df.agg(F.count("*").alias("__n"), *[F.count_if(F.coalesce(F.col(f"`{c}`"), F.lit("x")) != "").alias(c) for c in names]).first()
    return df.drop(*[c for c in names if row["__n"] and row[c] == 0])


def plan(table: QueryTable, spec: QuerySpec, drop_empty: bool = False) -> QueryResult:
    """Filters, order, top, columns, title braces, in this order, as one lazy expression."""
    rows, said = filtered(table, spec)
    keys = order(table, spec)
    kept = rows.orderBy(*keys) if keys else rows
    if spec.top > 0:
        kept = kept.limit(spec.top)
    out = kept.select(*[F.col(f"`{c}`") for c in shown(table, spec)])
    if dict(out.dtypes).get("title") == "string":
        out = out.withColumn("title", F.translate("title", "{}", ""))
    return QueryResult(without_empty(out) if drop_empty else out, rows, spec, tuple(said))


def query(table: QueryTable, text: str, drop_empty: bool = False) -> QueryResult:
    """Runs nothing: the result's rows are computed by an action on them."""
    return plan(table, parse(text), drop_empty)
