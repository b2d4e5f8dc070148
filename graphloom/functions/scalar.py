"""Functions of the query language as Column builders: each takes Columns and gives a Column."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    size = F.length(s)
    begin = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(start)
    if n is None:
        return F.substring(s, (begin + 1).cast("int"), size)
    return F.substring(s, (begin + 1).cast("int"), F.when(n < 0, F.greatest(size - begin + n, F.lit(0))).otherwise(n).cast("int"))


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    step = F.lit(1) if step is None else step
    ok = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    safe = F.when(step == 0, F.raise_error(F.lit("range step is 0"))).otherwise(step)
    return F.when(ok, F.sequence(a.cast("long"), b.cast("long"), F.when(ok, safe).otherwise(F.lit(1)).cast("long"))).when(step == 0, F.raise_error(F.lit("range step is 0")).cast("array<bigint>")).otherwise(F.array().cast("array<bigint>"))


def _to_integer(x: Column) -> Column:
    s = x.cast("string")
    whole = F.regexp_extract(s, r"^\s*([+-]?\d+)", 1)
    return F.when(x.isNull(), F.lit(None)).when(F.typeof(x).isin("double", "float"), x.try_cast("double").cast("long")).when(F.lower(s) == "true", F.lit(1)).when(F.lower(s) == "false", F.lit(0)).when(whole == "", F.raise_error(F.concat(F.lit("not an integer: "), s))).otherwise(whole).cast("long")


def _to_boolean(x: Column) -> Column:
    s = F.lower(x.cast("string"))
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(~s.isin("false", "0", "0.0", ""))


_DURATION = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def duration(s: Column) -> Column:
    """A duration (months, days, nanos) from its ISO form; null of null, an error if malformed."""
    n = [F.coalesce(F.regexp_extract(s, _DURATION, i).try_cast("long"), F.lit(0)) for i in range(1, 8)]
    made = F.struct((n[0] * 12 + n[1]).alias("months"), (n[2] * 7 + n[3]).alias("days"), ((n[4] * 3600 + n[5] * 60 + n[6]) * 1_000_000_000).alias("nanos"))
    bad = F.raise_error(F.concat(F.lit("not a duration: "), s)).cast("struct<months: bigint, days: bigint, nanos: bigint>")
    return F.when(s.isNull(), F.lit(None)).when(F.rlike(s, F.lit(_DURATION)), made).otherwise(bad)


def _guard(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _split(s: Column, d: Column) -> Column:
    return F.when(d == "", F.filter(F.split(s, ""), lambda x: x != "")).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1))


_WS = r"[ \t\n\x0B\f\r]+"

FUNCTIONS: dict[str, tuple[int, int, Builder]] = {
    "tostring": (1, 1, lambda x: F.coalesce(x.cast("string"), F.lit("null"))),
    "upper": (1, 1, F.upper), "toupper": (1, 1, F.upper), "lower": (1, 1, F.lower), "tolower": (1, 1, F.lower),
    "substring": (2, 3, _substring),
    "trim": (1, 1, lambda s: F.regexp_replace(s, f"^{_WS}|{_WS}$", "")),
    "ltrim": (1, 1, lambda s: F.regexp_replace(s, f"^{_WS}", "")), "rtrim": (1, 1, lambda s: F.regexp_replace(s, f"{_WS}$", "")),
    "startswith": (2, 2, F.startswith), "endswith": (2, 2, F.endswith), "contains": (2, 2, F.contains),
    "replace": (3, 3, lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b))),
    "left": (2, 2, lambda s, n: _guard(n >= 0, F.left(s, n.cast("int")))), "right": (2, 2, lambda s, n: _guard(n >= 0, F.right(s, n.cast("int")))),
    "split": (2, 2, _split), "reverse": (1, 1, F.reverse),
    "abs": (1, 1, F.abs), "ceil": (1, 1, lambda x: F.ceil(x).cast("double")), "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "round": (1, 2, lambda x, n=None: (F.round(x.cast("double")) if n is None else F.round(x.cast("double"), n.cast("int"))).cast("double")), "sqrt": (1, 1, lambda x: _guard(x >= 0, F.sqrt(x))),
    "sign": (1, 1, lambda x: F.signum(x).cast("long")), "log": (1, 1, lambda x: _guard(x > 0, F.ln(x))), "log10": (1, 1, lambda x: _guard(x > 0, F.log10(x))),
    "exp": (1, 1, F.exp), "pow": (2, 2, F.pow), "sin": (1, 1, F.sin), "cos": (1, 1, F.cos), "tan": (1, 1, F.tan),
    "asin": (1, 1, lambda x: _guard(F.abs(x) <= 1, F.asin(x))), "acos": (1, 1, lambda x: _guard(F.abs(x) <= 1, F.acos(x))),
    "atan": (1, 1, F.atan), "atan2": (2, 2, F.atan2), "rand": (0, 0, F.rand), "pi": (0, 0, lambda: F.lit(math.pi)), "e": (0, 0, lambda: F.lit(math.e)),
    "head": (1, 1, lambda a: F.get(a, F.lit(0))), "last": (1, 1, lambda a: _guard(F.size(a) > 0, F.get(a, F.size(a) - 1))),
    "tail": (1, 1, lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))), "range": (2, 3, _range), "coalesce": (1, 99, F.coalesce),
    "tointeger": (1, 1, _to_integer), "tofloat": (1, 1, lambda x: x.cast("double")), "toboolean": (1, 1, _to_boolean),
    "timestamp": (0, 0, lambda: F.unix_millis(F.current_timestamp())), "randomuuid": (0, 0, F.uuid),
    "date": (0, 1, lambda x=None: F.current_date() if x is None else F.to_date(x)),
    "datetime": (0, 1, lambda x=None: F.current_timestamp().cast("timestamp_ntz") if x is None else F.to_timestamp_ntz(F.replace(F.replace(x, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")))),
}


def _percentile_disc(x: Column, p: Column, distinct: bool = False) -> Column:
    s = F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))
    return F.get(s, F.floor(p * (F.size(s) - 1)).cast("int"))


def _percentile_cont(x: Column, p: Column) -> Column:
    """Over distinct values, between the two neighbours of the place p * (n - 1)."""
    s = F.sort_array(F.collect_set(x.cast("double")))
    at = p * (F.size(s) - 1)
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def _deviation(x: Column, less: int) -> Column:
    """Standard deviation of the distinct values."""
    s = F.collect_set(x.cast("double"))
    add = lambda a, v: a + v
    mean = F.aggregate(s, F.lit(0.0), add) / F.nullif(F.size(s), F.lit(0))
    squares = F.aggregate(F.transform(s, lambda v: (v - mean) * (v - mean)), F.lit(0.0), add)
    return F.when(F.size(s) > less, F.sqrt(squares / F.nullif(F.size(s) - less, F.lit(0))))


#: name -> builder(column, distinct, further arguments)
AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": lambda x, d: F.count_distinct(x) if d else F.count(x),
    "sum": lambda x, d: F.sum_distinct(x) if d else F.sum(x),
    "avg": lambda x, d: F.avg(x) if not d else F.sum_distinct(x.cast("double")) / F.count_distinct(x),
    "min": lambda x, d: F.min(x), "max": lambda x, d: F.max(x),
    "collect": lambda x, d: F.array_distinct(F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])) if d else F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"]),
    "stdev": lambda x, d: _deviation(x, 1) if d else F.stddev_samp(x), "stdevp": lambda x, d: _deviation(x, 0) if d else F.stddev_pop(x),
    "percentiledisc": lambda x, d, p: _percentile_disc(x, p, d), "percentilecont": lambda x, d, p: _percentile_cont(x, p) if d else F.percentile(x, p),
}


def register_function(name: str, least: int, most: int, builder: Builder) -> None:
    """Add a scalar function; ``builder`` takes Columns and gives a Column."""
    FUNCTIONS[name.lower()] = (least, most, builder)
