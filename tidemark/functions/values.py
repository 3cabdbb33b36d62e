"""Scalar column expressions: cleaning, parsing, formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import FLAGS

# Words read as true, and the plain-number pattern.
TRUE_WORDS = ("true", "1", "yes", "y", "above", "gc")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
SECURITY_CODE = "^[0-9A-Z]{5}$"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(c(x).cast("string"), F.lit(""))


def normalize_ticker(x: Column | str) -> Column:
    t = F.upper(F.trim(text(x)))
    return F.when(t.rlike("^[0-9]+$"), F.concat(t, F.lit(".T"))).otherwise(t)


def normalize_bool(x: Column | str) -> Column:
    return F.lower(F.trim(text(x))).isin(*TRUE_WORDS)


def to_double(x: Column | str, strip_commas: bool = False) -> Column:
    """Number from text, null when it is not one (no ANSI error, no 1d / 1f forms)."""
    t = c(x).cast("string")
    if strip_commas:
        t = F.replace(t, F.lit(","), F.lit(""))
    return F.when(t.rlike(NUMBER), F.trim(t).try_cast("double"))


def safe_float(x: Column | str, default: float | Column | None = 0.0, strip_commas: bool = False) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default).cast("double")
    return F.coalesce(to_double(x, strip_commas), fallback)


def first_text(*xs: Column | str) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(text(x)), F.lit("")) for x in xs])


def signal_date(fields: list[Column | str], received_at: Column | str) -> Column:
    day = F.date_format(c(received_at), "yyyy-MM-dd")
    return F.substring(F.coalesce(first_text(*fields), day), 1, 10)


def dedup_key(rule: str, ticker: Column | str, day: Column | str) -> Column:
    return F.concat_ws(":", F.lit(rule), c(ticker), c(day))


def is_security_code(x: Column | str) -> Column:
    return F.trim(text(x)).rlike(SECURITY_CODE)


def strict_security_code(x: Column | str) -> Column:
    t = F.trim(text(x))
    return F.when(t.rlike(SECURITY_CODE), t).otherwise(
        F.raise_error(F.concat(F.lit("bad security code: "), t))
    )


def zero_padded(number: Column, width: int) -> Column:
    """Zeros in front up to ``width``; lpad alone would cut longer input."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def ticker_to_code(x: Column | str) -> Column:
    head = F.split_part(text(x), F.lit("."), F.lit(1))
    return F.concat(zero_padded(head, 4), F.lit("0"))


def parse_date(x: Column | str) -> Column:
    head = F.substring(text(x), 1, 10)
    return F.when(head.rlike(ISO_DATE), head.try_cast("date"))


def freshness(as_of: Column | str, data_date: Column | str) -> Column:
    return (
        F.when(c(data_date).isNull(), "no_data")
        .when(c(data_date) == c(as_of), "current")
        .otherwise("stale")
    )


def bool_text(x: Column | str) -> Column:
    return F.when(F.coalesce(c(x), F.lit(False)), "true").otherwise("false")


def float_text(x: Column | str, digits: int = 6) -> Column:
    v = c(x)
    return F.when(v.isNull() | F.isnan(v), "").otherwise(F.format_string(f"%.{digits}f", v))


def number_text(x: Column | str) -> Column:
    """Whole numbers without a point, others to six places without trailing zeros."""
    v = c(x).cast("double")
    whole = v == F.floor(v).cast("double")
    trimmed = F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    return F.when(whole, F.format_string("%.0f", v)).otherwise(trimmed)


def finite(x: Column | str) -> Column:
    v = c(x)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null when the denominator is 0 or not finite."""
    d = c(den).cast("double")
    return F.when((d != 0) & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), c(num) / d)


def truth(x: Column | str) -> Column:
    return F.coalesce(c(x).cast("boolean"), F.lit(False))


def flag_mask(flags: dict[str, tuple[int, int]] = FLAGS) -> Column:
    return reduce(lambda a, b: a + b, [truth(n).cast("int") * bit for n, (_, bit) in flags.items()])


def flag_score(flags: dict[str, tuple[int, int]] = FLAGS) -> Column:
    return reduce(lambda a, b: a + b, [F.when(truth(n), w).otherwise(0) for n, (w, _) in flags.items()])


def mask_flag(mask: Column | str, bit: int) -> Column:
    return c(mask).cast("int").bitwiseAND(F.lit(bit)) != 0


def mask_score(mask: Column | str) -> Column:
    return reduce(
        lambda a, b: a + b, [F.when(mask_flag(mask, bit), w).otherwise(0) for w, bit in FLAGS.values()]
    )


def mask_pattern(mask: Column | str) -> Column:
    return F.lpad(F.bin(c(mask).cast("long")), len(FLAGS), "0")


def exit_group(x: Column | str) -> Column:
    r = text(x)
    return (
        F.when(r.isin("stop_loss", "stop_and_take_same_day_stop_first"), "stop_loss")
        .when(r.isin("take_profit", "stop_and_take_same_day_take_first"), "take_profit")
        .when(r.isin("stop_gap", "take_profit_gap", "max_holding"), r)
        .when(r.startswith("premature_data_end"), "data_end_or_haircut")
        .otherwise("other")
    )


def valid_bar(o="open", h="high", l="low", cl="close", v="volume") -> Column:
    """All five fields present and positive (``least`` alone would skip nulls)."""
    return reduce(lambda a, b: a & b, [F.coalesce(c(x) > 0, F.lit(False)) for x in (o, h, l, cl, v)])


def stamp_run_id(prefix: str, stamp: Column | str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(c(stamp), "yyyyMMdd'T'HHmmss"))


def fingerprint_run_id(canonical: Column | str) -> Column:
    return F.substring(F.sha2(c(canonical), 256), 1, 16)


def rounded(df, digits: int = 6):
    """Round every double column; reports are compared at this precision."""
    return df.select(
        *[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
          for f in df.schema.fields]
    )
