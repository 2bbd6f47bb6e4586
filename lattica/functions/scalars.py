"""Scalar and aggregate functions of the query language, each a built-in of Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

SCALARS = {
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "sign": F.signum, "exp": F.exp, "log": F.log, "round": F.round,
    "coalesce": F.coalesce, "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("long"), "tofloat": lambda x: x.try_cast("double"),
    "toboolean": lambda x: x.try_cast("boolean"), "substring": lambda s, i, n=None: F.substring(s, i + 1, n if n is not None else F.length(s)),
    "left": lambda s, n: F.substring(s, F.lit(1), n), "right": lambda s, n: F.right(s, n), "replace": F.replace, "split": lambda s, d: F.split(s, d),
    "head": lambda x: F.try_element_at(x, F.lit(1)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "range": lambda a, b, step=None: F.sequence(a, b, *([step] if step is not None else [])),
    "date": lambda x: x.try_cast("date"), "timestamp": lambda x: x.try_cast("timestamp"), "current_date": F.current_date, "current_timestamp": F.current_timestamp,
    "year": F.year, "month": F.month, "day": F.dayofmonth, "date_part": lambda part, x: F.date_part(part, x),
    "concat": lambda *xs: F.concat(*[x.cast("string") for x in xs]), "lpad": F.lpad, "rpad": F.rpad, "repeat": F.repeat, "regexp_matches": F.rlike,
    "starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains, "levenshtein": F.levenshtein, "md5": F.md5, "sha256": lambda x: F.sha2(x, 256),
    "list_contains": F.array_contains, "list_sort": F.array_sort, "list_distinct": F.array_distinct, "list_concat": F.concat, "list_reverse": F.reverse,
    "list_sum": lambda x: F.aggregate(F.filter(x, lambda v: v.isNotNull()), F.try_element_at(x, F.lit(1)) * 0, lambda a, v: a + v), "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "pi": F.pi, "e": F.e, "log2": F.log2, "log10": F.log10, "ln": F.log,
    "pow": F.pow, "cbrt": F.cbrt, "degrees": F.degrees, "radians": F.radians, "greatest": F.greatest, "least": F.least, "nullif": F.nullif,
}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "percentilecont"}
