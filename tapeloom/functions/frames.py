"""Window frames over bars.

Two notions of "previous" are kept apart. ``lookback`` is session-exact: it reads the bar exactly ``k`` sessions
earlier and is null when the name did not print then. ``F.lag`` over ``own_bars`` is the previous printed bar.

Windows partition by the series key. After the bar builders a series has at most one row per session, so a
partition is never larger than the calendar, however many raw rows one key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEY, SESSION = "symbol", "session_no"


def series(*keys: str, order: str = SESSION) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,))).orderBy(order)


def upto(*keys: str, order: str = SESSION) -> WindowSpec:
    return series(*keys, order=order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lookback(col: Column | str, k: int, *keys: str) -> Column:
    """Value exactly ``k`` sessions earlier (later when negative), null when that session has no bar."""
    return F.first(col).over(series(*keys).rangeBetween(-k, -k))


def rolling(aggregate: Column, counted: Column | str, width: int, least: int | None = None, *keys: str) -> Column:
    """Aggregate over the last ``width`` sessions when at least ``least`` of them hold a value."""
    frame = series(*keys).rangeBetween(-(width - 1), 0)
    return F.when(F.count(counted).over(frame) >= (width if least is None else least), aggregate.over(frame))


def median_of(col: Column | str) -> Column:
    """Interpolated median that is accepted inside a framed window."""
    return F.percentile(col, 0.5)


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def clean(col: Column) -> Column:
    """The value, null when it is not a number or not finite. Spark orders NaN above every number, so it passes gates."""
    return F.when(finite(col), col)


def cleaned(df: DataFrame) -> DataFrame:
    """All fractional columns of a scan without NaN and infinities."""
    return df.withColumns({f.name: clean(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null instead of failing or overflowing on a zero denominator."""
    return top / F.nullif(bottom, F.lit(0.0))


def log_or_inf(col: Column) -> Column:
    """Natural logarithm; of zero, such as a product too small for a double, it is minus infinity as in SQL engines, not null."""
    return F.when(col == 0, F.lit(float("-inf"))).otherwise(F.log(col))


def fixed(col: Column, digits: int = 6) -> Column:
    """Rounded for output; adding zero turns −0.0 into 0.0."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame as a scalar subquery, so that no cross join is planned."""
    row = one.select(F.struct(*one.columns)).scalar()
    return df.select("*", *[row[c].alias(c) for c in one.columns])
