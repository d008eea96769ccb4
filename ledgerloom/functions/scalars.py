"""Column expressions over cells, amounts, dates, packs, quantities and file names; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def strip(c: Column) -> Column:
    """c without blanks of any kind, line breaks and tabs too, at its ends."""
    return F.btrim(c, F.lit(C.BLANKS))


def strip_sql(x: str) -> str:
    return f"btrim({x}, '{C.BLANKS}')"


def normalize_cell(c: Column) -> Column:
    """Runs of blanks, Unicode ones too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def parse_amount(c: Column) -> Column:
    """Digits and dots read as a double, negative if the text starts with a minus; null if that is no number."""
    value = F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
    return value * F.when(strip(c).startswith("-"), -1.0).otherwise(1.0)


def is_date(c: Column) -> Column:
    return c.rlike(C.WHOLE_DATE)


def is_gstin(c: Column) -> Column:
    return F.length(c) == 15


def is_irn(c: Column) -> Column:
    return c.rlike(f"^(?:{C.SHAPES['irn']})$")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one; a group that matches nothing is null too."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_date(c: Column) -> Column:
    """DD-MM-YYYY for the five shapes of dates in use, day first and the first day where there is none; else unchanged."""
    v = strip(c)
    months = F.create_map(*[F.lit(x) for kv in C.MONTHS.items() for x in kv])

    def pick(pattern: str, day: int, month: int, year: int, named: bool) -> tuple[Column, Column]:
        part = lambda i: found(v, pattern, i)
        d = F.lit(1) if not day else part(day).try_cast("int")
        m = F.element_at(months, F.lower(part(month))) if named else part(month).try_cast("int")
        y = part(year).try_cast("int")
        y = F.when(y < 100, y + 2000).otherwise(y)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return v.rlike(pattern) & d.between(1, 31) & m.between(1, 12), F.concat(pad(d, 2), F.lit("-"), pad(m, 2), F.lit("-"), pad(y, 4))

    out = None
    for args in C.DATE_FORMS:
        test, value = pick(*args)
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(c)


def _pack(c: Column, pattern: str) -> Column:
    hit = c.rlike(pattern)
    return F.when(hit, F.struct(strip(F.regexp_extract(c, pattern, 1)).alias("description"), strip(F.regexp_extract(c, pattern, 2)).alias("pack"))).otherwise(F.struct(c.alias("description"), F.lit(None).cast("string").alias("pack")))


def split_pack_label(c: Column) -> Column:
    """struct(description, pack) at "pack size:"; without it the text and null."""
    return _pack(c, C.PACK_LABEL)


def split_pack_hyphen(c: Column) -> Column:
    """struct(description, pack) at the last hyphen after a blank that has one word after it."""
    return _pack(c, C.PACK_HYPHEN)


def split_pack_number(c: Column) -> Column:
    """struct(description, pack) from the last word that starts with a digit, to the end."""
    return _pack(strip(c), C.PACK_NUMBER)


def resolve_pack(description: Column, pack: Column) -> Column:
    """struct(description, pack): a pack already there wins, then the label, then the hyphen."""
    label, hyphen = split_pack_label(description), split_pack_hyphen(description)
    own = F.struct(description.alias("description"), pack.alias("pack"))
    return F.when(F.nullif(pack, F.lit("")).isNotNull(), own).when(label["pack"].isNotNull(), label).otherwise(hyphen)


def effective_quantity(quantity: Column, total: Column, sold: Column, free: Column) -> Column:
    some = F.when(sold.isNotNull() | free.isNotNull(), F.coalesce(sold, F.lit(0.0)) + F.coalesce(free, F.lit(0.0)))
    return F.coalesce(quantity, total, some)


def effective_divisor(rate_pts: Column, unit_rate: Column) -> Column:
    return F.coalesce(F.nullif(rate_pts, F.lit(0.0)), unit_rate)


def derived_quantities(quantity: Column, taxable: Column, divisor: Column) -> Column:
    """struct(original, free): what the taxable value pays for, rounded half to even, and the rest of quantity."""
    original = F.when(quantity.isNotNull(), F.bround(taxable / F.nullif(divisor, F.lit(0.0)), 0))
    return F.struct(original.alias("original"), (quantity - original).alias("free"))


def is_subtotal(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*(grand\s*total|sub[\s\-]?total|total)\b"), F.lit(False))


def sanitize_filename(value: Column, index: Column, prefix: str = "Unnamed") -> Column:
    fallback = F.concat(F.lit(f"{prefix}_"), index.cast("string"))
    clean = F.regexp_replace(F.btrim(strip(F.regexp_replace(value, C.RESERVED, "-")), F.lit("'")), r"\s+", "_")
    return F.substring(F.coalesce(F.nullif(F.when(F.nullif(value, F.lit("")).isNotNull(), clean), F.lit("")), fallback), 1, C.NAME_LENGTH)


def filename_seed(buyer: Column, date: Column, number: Column, as_of: Column) -> Column:
    """buyer_date_tail: defaults for what is missing, the last five characters of the number."""
    none = F.lit("")
    tail = F.coalesce(F.nullif(F.right(number, F.lit(5)), none), F.lit("NoIRN"))
    return F.concat_ws("_", F.coalesce(F.nullif(buyer, none), F.lit("Customer_Unspecified")), F.coalesce(F.nullif(date, none), as_of), tail)


def float_text(c: Column) -> Column:
    """A double as the shortest text, without exponent between 1e-3 and 1e16: 850.0."""
    plain = c.cast("string")
    large = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), F.when(c == F.floor(c), large).otherwise(F.regexp_replace(c.cast("decimal(38,8)").cast("string"), r"0+$", ""))).otherwise(plain)


def column_label(c: Column) -> Column:
    """The printed name of a line-item column, or its words capitalised."""
    names = F.create_map(*[F.lit(x) for kv in C.ITEM_COLUMNS.items() for x in kv])
    return F.coalesce(F.element_at(names, c), F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))
