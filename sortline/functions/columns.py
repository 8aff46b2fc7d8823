"""Column functions: predicates and scalars that the operators share."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fixed as V

Name = Column | str


def _c(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text ------------------------------------------------------------------------------------------------------------


def blank_to_null(c: Name) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", ""), F.lit(""))


def first_text(*cs: Name) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*map(blank_to_null, cs))


def key_text(c: Name) -> Column:
    """Key by which codes are compared, ignoring case."""
    return F.upper(_c(c))


def safe_int(c: Name) -> Column:
    """The whole number that a text holds, else null."""
    return blank_to_null(c).try_cast("int")


def alphanumeric_key(c: Name) -> Column:
    """Letters and digits alone, upper-cased."""
    return F.upper(F.regexp_replace(_c(c), r"[^\p{L}\p{Nd}]", ""))


def has_zone(c: Name) -> Column:
    """Whether a text is a time with a zone or offset: one that can be read, and that can't take another zone."""
    text = F.upper(F.trim(_c(c)))
    read = lambda x: x.try_cast("timestamp").isNotNull()
    return read(text) & ~read(F.concat(text, F.lit("Z"))) & ~read(F.concat(text, F.lit(" 00:00:00Z")))


def clean_text(c: Name, length: int) -> Column:
    """Without control characters, cut to a length."""
    return F.left(F.regexp_replace(_c(c), r"\p{Cntrl}", ""), F.lit(length))


def mapped(c: Name, texts: dict, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*texts.items()))), _c(c)), F.lit(other))


def status_text(c: Name) -> Column:
    return mapped(c, V.STATUS_TEXT, V.UNKNOWN_STATUS_TEXT)


def source_text(c: Name) -> Column:
    return mapped(c, V.SOURCE_TEXT, V.UNKNOWN_SOURCE_TEXT)


def yes_no(c: Name) -> Column:
    return F.when(_c(c), V.YES).otherwise(V.NO)


# --- numbers and times -----------------------------------------------------------------------------------------------


def percent(n: Name, d: Name) -> Column:
    """100 n / d with three decimals, halves up; 0 where d isn't positive."""
    n, d = _c(n).cast("long"), _c(d).cast("long")
    thousandths = F.call_function("div", n * 200_000 + d, F.nullif(2 * d, F.lit(0)))
    return (F.coalesce(F.when(d > 0, thousandths), F.lit(0)).cast("decimal(18,0)") / 1000).cast("decimal(18,3)")


def minute(c: Name) -> Column:
    return F.date_trunc("MINUTE", _c(c)).cast("timestamp_ntz")


def month_key(c: Name) -> Column:
    return F.date_format(_c(c), "yyyyMM")


def month_of_name(c: Name) -> Column:
    """First day of the month that ends a table's name, null if there is none."""
    return F.try_to_timestamp(F.concat(F.regexp_extract(_c(c), r"_(\d{6})$", 1), F.lit("01")), F.lit("yyyyMMdd")).cast("date")


def retention_threshold(now: Name, keep_months: int) -> Column:
    """First of the oldest month that is kept, the current one counted."""
    return F.add_months(F.trunc(_c(now), "MM"), -(keep_months - 1))


# --- keys ------------------------------------------------------------------------------------------------------------


def business_key(*cs: tuple[str, str]) -> Column:
    """Values of (name, type) columns joined by |; null is empty, times have seven decimals."""
    one = lambda n, t: F.concat(F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")) if t.startswith("timestamp") else F.col(n).cast("string")
    return F.concat_ws("|", *(F.coalesce(one(n, t), F.lit("")) for n, t in cs))


def split_key(c: Name, n: int) -> list[Column]:
    """The n values of a business key. Wrong where a value holds |; keep key columns where that can be."""
    parts = F.split(_c(c), r"\|")
    return [F.get(parts, F.lit(k)) for k in range(n)]


def generated_code(c: Name, prefix: str = "S") -> Column:
    """A stable code for a key that has none."""
    return F.concat(F.lit(prefix), F.lpad(F.hex(F.xxhash64(_c(c))), 16, "0"))


def row_digest(*names: str) -> Column:
    """SHA-256 over names and values with their lengths, names in order ignoring case. Only equality matters."""
    parts = []
    for n in sorted(names, key=str.lower):
        v = F.col(n).cast("string")
        parts += [F.lit(f"{len(n)}:{n.lower()}="), F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")), F.lit(";")]
    return F.sha2(F.concat(*parts), 256)


# --- tasks -----------------------------------------------------------------------------------------------------------


def is_sorted(status: Name = "status") -> Column:
    return _c(status).isin(V.DROPPED, V.FEEDBACK_PENDING)


def is_cleanable(status: Name = "status") -> Column:
    return ~_c(status).isin(V.DROPPED, V.EXCEPTION)


def is_exceptional() -> Column:
    return F.col("is_exception") | (F.col("status") == V.EXCEPTION)


def is_recirculated_dock(dock: Name = "resolved_dock_code") -> Column:
    """By the dock's number alone: aggregates, summaries and zones."""
    return F.coalesce(safe_int(dock) > V.LAST_DOCK, F.lit(False))


def is_recirculated_dock_strict(dock: Name = "resolved_dock_code") -> Column:
    """As above, of docks written in ASCII digits alone: the search filter."""
    return F.coalesce(_c(dock).rlike("^[0-9]+$"), F.lit(False)) & is_recirculated_dock(dock)


def is_recirculated_any() -> Column:
    """By the task's flag or its dock: wave details, box status and the cleanup preview."""
    return F.col("is_recirculated") | is_recirculated_dock()


def is_exception_dock(dock: Name) -> Column:
    return F.coalesce(safe_int(dock) == V.EXCEPTION_DOCK, F.lit(False))


def normalized_wave() -> Column:
    return blank_to_null("wave_code")


def chute() -> Column:
    """Actual, else target chute, else dock."""
    return first_text("actual_chute_code", "target_chute_code", "resolved_dock_code")


def resolved_dock() -> Column:
    return F.coalesce(first_text("actual_chute_code", "target_chute_code"), F.lit(V.NO_DOCK))


def parse_barcode(c: Name) -> tuple[Column, Column, Column]:
    """(code trimmed and upper-cased, source type 0-2, chute or null). Zero: blank or of a kind that isn't known."""
    code = F.upper(blank_to_null(c))
    kind, digit = F.regexp_extract(code, "^(02|Z)([0-9])", 1), F.nullif(F.regexp_extract(code, "^(02|Z)([0-9])", 2), F.lit(""))
    return code, F.when(kind == "02", V.SPLIT).when(kind == "Z", V.FULL_CASE).otherwise(V.UNKNOWN), digit


def in_range(c: Name, start, end) -> Column:
    """[start, end)"""
    return (_c(c) >= ntz(start)) & (_c(c) < ntz(end))


def ntz(t) -> Column:
    return t if isinstance(t, Column) else F.lit(str(t)).cast("timestamp_ntz")


# --- rows ------------------------------------------------------------------------------------------------------------


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark keeps one row a key and task before it shuffles (WindowGroupLimit), so a hot key meets in no task alone, and
    columns that aren't used aren't read, which a max_by() over a struct of them would prevent."""
    nth = "__nth"
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(nth) == 1).drop(nth)
