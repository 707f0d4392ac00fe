"""Column functions over security codes of the form symbol.VENUE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Venues, their currencies, and vendor prefixes.
CN = ("SH", "SZ", "BJ", "OF")
US = ("O", "N", "A")
INDEX = ("CSI", "TI", "WI", "GI")
CURRENCY = {"SH": "CNY", "SZ": "CNY", "BJ": "CNY", "OF": "CNY", "TI": "CNY", "WI": "CNY", "CSI": "CNY", "HK": "HKD", "O": "USD", "N": "USD", "A": "USD"}
PREFIX = {"SH": "sh", "SZ": "sz"}
#: Security types by venue and beginning of the symbol, the first that fits.
TYPES = [
    ("SH", ("6",), "stock"), ("SH", ("000", "950"), "index"), ("SH", ("501",), "lof"), ("SH", ("5",), "etf"), ("SZ", ("00", "30"), "stock"), ("SZ", ("15",), "etf"), ("SZ", ("16",), "lof"), ("SZ", ("39",), "index"), ("BJ", ("4", "8", "9"), "stock"),
]


def venue(code: Column) -> Column:
    """The text after the last dot, upper case; null without a dot."""
    return F.when(code.contains("."), F.upper(F.trim(F.substring_index(code, ".", -1))))


def symbol(code: Column) -> Column:
    """The text before the last dot, upper case, filled with zeros to 6 digits in Chinese markets."""
    raw = F.upper(F.trim(F.regexp_extract(F.trim(code), r"^(.*)\.[^.]*$", 1)))
    return F.when(venue(code).isin(*CN), F.lpad(raw, F.greatest(F.length(raw), F.lit(6)), F.lit("0"))).otherwise(raw)


def is_valid(code: Column) -> Column:
    raw = F.upper(F.trim(F.regexp_extract(F.trim(code), r"^(.*)\.[^.]*$", 1)))
    known = F.when(venue(code).isin(*CN), raw.rlike(r"^[0-9]{1,6}$")).when(venue(code).isin(*US, *INDEX, "HK"), raw.rlike(r"^[A-Z0-9]{1,10}$"))
    return F.coalesce(known, F.lit(False))


def canonical(code: Column) -> Column:
    """symbol.VENUE, or null where the code is not valid."""
    return F.when(is_valid(code), F.concat(symbol(code), F.lit("."), venue(code)))


def security_type(code: Column) -> Column:
    """Type by venue and symbol; null where it cannot be told."""
    found = F.when(venue(code) == "OF", "fund").when(venue(code).isin(*US), "stock").when(venue(code).isin(*INDEX), "index")
    for at, starts, kind in TYPES:
        for start in starts:
            found = found.when((venue(code) == at) & symbol(code).startswith(start), kind)
    return F.when(is_valid(code), found)


def currency(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CURRENCY.items() for x in pair])
    return F.when(code.contains("."), table[F.substring_index(code, ".", -1)])


def to_vendor(code: Column, style: str) -> Column:
    """A canonical code as a vendor writes it: bare (600000), prefixed (sh600000) or dotted (sh.600000); null where it can't."""
    prefix = F.when(venue(code) == "SH", "sh").when(venue(code) == "SZ", "sz")
    return {"bare": F.when(venue(code).isin(*CN), symbol(code)), "prefixed": F.concat(prefix, symbol(code)), "dotted": F.concat(prefix, F.lit("."), symbol(code))}[style]


def from_vendor(raw: Column, default_venue: Column) -> Column:
    """The canonical code of a vendor's: its prefix tells the venue, else ``default_venue`` does."""
    text = F.lower(F.trim(raw))
    told = F.regexp_extract(text, r"^(sh|sz)\.?[0-9]{1,6}$", 1)
    return canonical(F.when(told != "", F.concat(F.regexp_replace(text, r"^(sh|sz)\.?", ""), F.lit("."), F.upper(told))).otherwise(F.concat(text, F.lit("."), F.upper(default_venue))))


def market(code: Column) -> Column:
    return F.when(venue(code) == "HK", "hk").when(venue(code).isin(*US), "us").otherwise("cn")


def listing_type(code: Column, kind: Column) -> Column:
    """Funds listed on an exchange are lof; other kinds as they are."""
    return F.when((kind == "fund") & venue(code).isin("SH", "SZ", "BJ"), "lof").otherwise(kind)
