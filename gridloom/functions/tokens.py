"""Tokens: one unambiguous text for each typed value, and the estimate of what a text costs a language model.

Different types never share a text (1, 1.0 and "1" are three tokens), so tokens serve as grouping keys for cells of mixed types.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: Text that can't stand bare: it would be read as something else, or split.
QUOTED = (
    r"""^$|^["#@=]|^[\p{IsWhite_Space}]|[\p{IsWhite_Space}]$|[|\x00-\x1F\x7F-\x9F  ]|^(TRUE|FALSE|\^)$|^""" + NUMBER
    + r"""$|^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$|^[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$|\*[0-9]+$|^[A-Z]{1,3}="""
)


def json_literal(s: Column) -> Column:
    """A JSON string with control characters and line separators escaped, all else as it is."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    for ch in [*map(chr, range(32)), "\x7f", "\x85", " ", " "]:
        out = F.replace(out, F.lit(ch), F.lit(short.get(ch, f"\\u{ord(ch):04x}")))
    special = F.concat(F.lit('"'), out, F.lit('"'))
    plain = F.concat(F.lit('"'), s, F.lit('"'))
    return F.when(s.rlike(r'["\\\x00-\x1F\x7F\u0085  ]'), special).otherwise(plain)


_ESCAPED = re.compile('["\\\\\x00-\x1f\x7f\x85\u2028\u2029]')
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_text(s: str) -> str:
    """``json_literal`` of a text."""
    return f'"{_ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", s)}"'


def scalar(s: Column) -> Column:
    """A value of compact XML: a JSON string if it has spaces, parentheses or quotes, or is empty."""
    return F.when(s.rlike(r'^[^\s()"]+$'), s).otherwise(json_literal(s))


def text_token(s: Column) -> Column:
    return F.when(s.rlike(QUOTED), json_literal(s)).otherwise(s)


def error_token(s: Column) -> Column:
    bare = s.startswith("#") & (F.length(s) > 1) & ~s.rlike(r"\*[0-9]+$|[|\s\x00-\x1F\x7F-\x9F]")
    return F.when(bare, s).otherwise(F.concat(F.lit("@err:"), json_literal(s)))


def bool_token(b: Column) -> Column:
    return F.when(b, "TRUE").otherwise("FALSE")


def float_text(v: float) -> str:
    """Shortest text that reads back as the same number, with a point; exponents as two digits or more."""
    if not math.isfinite(v):
        return "@float:" + ("nan" if math.isnan(v) else "inf" if v > 0 else "-inf")
    text = repr(float(v))
    if "e" not in text:
        return text
    mantissa, exponent = text.split("e")
    if "." not in mantissa:
        mantissa += ".0"
    return f"{mantissa}e{exponent[0]}{exponent[1:].zfill(2)}"


@F.pandas_udf(T.StringType())
def float_token(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else float_text(v), na_action=None)


def datetime_token(ts: Column) -> Column:
    us = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(us != 0, F.concat(F.lit("."), F.lpad(us.cast("string"), 6, "0"))).otherwise(""))


def date_token(d: Column) -> Column:
    return F.concat(F.lit("@date:"), F.date_format(d, "yyyy-MM-dd"))


def duration_token(us: Column) -> Column:
    a = F.abs(us)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    rest = F.pmod(a, F.lit(1_000_000))
    clock = F.concat(F.floor(a / 3_600_000_000).cast("string"), F.lit(":"), pad(F.pmod(F.floor(a / 60_000_000), F.lit(60))), F.lit(":"), pad(F.pmod(F.floor(a / 1_000_000), F.lit(60))))
    return F.concat(F.lit("@td:"), F.when(us < 0, "-").otherwise(""), clock, F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""))


def token(c: Column, kind: str) -> Column:
    """The token of a column of a Spark type."""
    if kind in ("string",) or kind.startswith(("varchar", "char")):
        return text_token(c)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("string")
    if kind in ("float", "double"):
        return float_token(c.cast("double"))
    if kind == "boolean":
        return F.when(c.isNotNull(), bool_token(c))
    if kind in ("timestamp", "timestamp_ntz"):
        return datetime_token(c)
    if kind == "date":
        return date_token(c)
    if kind.startswith("decimal"):
        return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(float_token(c.cast("double")))
    raise TypeError(f"no token for {kind}")


def kind_of_type(kind: str) -> str:
    return "text" if kind == "string" else "bool" if kind == "boolean" else "date" if kind.startswith(("timestamp", "date")) else "number"


def token_kind(t: Column) -> Column:
    """The kind of value that a token stands for, in the order in which a reader tests."""
    return (
        F.when(t.startswith('"'), "text").when(t.startswith("#") | t.startswith("@err:"), "error").when(t.startswith("@float:"), "number").when(t.startswith("@"), "date").when(t.isin("TRUE", "FALSE"), "bool")
        .when(t.rlike(f"^{NUMBER}$"), "number").when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( |$)|^[0-9]{2}:[0-9]{2}:[0-9]{2}"), "date").otherwise("text")
    )


def token_cost(s: Column) -> Column:
    """Estimated language-model tokens of a text: letters by 6, digits by 3, loose spaces and equal signs by 4, wide characters one each."""
    def share(pattern: str, per: int) -> Column:
        found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.ceil(F.length(x) / per))

    count = lambda pattern: F.regexp_count(s, F.lit(pattern)).cast("long")
    punctuation = r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x00-\x1F\x7F])\1*"
    out = share("[A-Za-z]+", 6) + share("[0-9]+", 3) + share(r"(?<! )(?: {2,}| (?![A-Za-z0-9]))", 4) + share(punctuation, 4)
    return out + count(r"[\x{800}-\x{10FFFF}]") + count(r"(?<![A-Za-z])[\x{80}-\x{7FF}]")


@F.pandas_udf(T.StringType())
def _number_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: f"{v:.16g}" if math.isfinite(v) else "")


def number_text(v: Column) -> Column:
    """A number with at most 16 digits, as it is written into cells; empty for what isn't finite."""
    return F.when(v.isNotNull(), _number_text(v.cast("double")))


def token_value(t: Column) -> Column:
    """struct(kind, number, text, us) of a token: numbers, and 1 or 0 of truth values; texts and errors; microseconds of dates (since 1970), times and durations."""
    quoted = F.from_json(F.concat(F.lit('{"v":'), F.when(t.startswith("@err:"), F.substr(t, F.lit(6))).otherwise(t), F.lit("}")), "v string")["v"]
    payload = F.regexp_replace(t, "^@[a-z]+:", "")
    part = lambda p, i: F.coalesce(F.regexp_extract(payload, p, i).try_cast("long"), F.lit(0))
    span = r"^(-?)(\d+):(\d\d):(\d\d)(?:\.(\d{1,6}))?$"
    fraction = F.coalesce(F.rpad(F.regexp_extract(payload, span, 5), 6, "0").try_cast("long"), F.lit(0))
    duration = F.when(payload.startswith("-"), -1).otherwise(1) * ((part(span, 2) * 3600 + part(span, 3) * 60 + part(span, 4)) * 1_000_000 + fraction)
    day = F.unix_date(F.regexp_extract(payload, r"^\d{4}-\d{2}-\d{2}", 0).try_cast("date")).cast("long") * 86_400_000_000
    moment = F.coalesce(day, F.lit(0)) + _clock(F.regexp_extract(payload, r"(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)$", 1))
    kind = token_kind(t)
    number = F.when(t.startswith("@float:"), payload.try_cast("double")).when(t.isin("TRUE", "FALSE"), (t == "TRUE").cast("double")).otherwise(F.when(kind == "number", t.try_cast("double")))
    text = F.when(t.startswith('"') | t.startswith("@err:"), quoted).otherwise(F.when(kind.isin("text", "error"), t))
    us = F.when(kind == "date", F.when(t.startswith("@td:"), duration).otherwise(moment))
    return F.struct(kind.alias("kind"), number.alias("number"), text.alias("text"), us.cast("long").alias("us"))


def _clock(s: Column) -> Column:
    part = F.split(s, "[:.]")
    at = lambda i: F.coalesce(F.get(part, i).try_cast("long"), F.lit(0))
    return (at(0) * 3600 + at(1) * 60 + at(2)) * 1_000_000 + F.coalesce(F.rpad(F.get(part, 3), 6, "0").try_cast("long"), F.lit(0))
