"""Date and time texts: strptime formats as strict Spark parses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are tried, in order.
DATETIME_FORMATS = (
    "%Y-%m-%d",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%Y/%m/%d",
    "%d-%m-%Y",
    "%m-%d-%Y",
    "%Y-%m-%d %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
)
TIME_FORMATS = ("%H:%M:%S", "%H.%M.%S", "%H:%M", "%H.%M")

#: Directive: Spark's letters, and what the text must look like.
DIRECTIVES = {
    "%Y": ("yyyy", "[0-9]{4}"), "%m": ("M", "[0-9]{1,2}"), "%d": ("d", "[0-9]{1,2}"), "%H": ("H", "[0-9]{1,2}"),
    "%M": ("m", "[0-9]{1,2}"), "%S": ("s", "[0-9]{1,2}"), "%f": ("SSSSSS", "[0-9]{6}"), "%y": ("yy", "[0-9]{2}"),
    "%b": ("MMM", "[A-Za-z]{3}"), "%B": ("MMMM", "[A-Za-z]+"), "%j": ("D", "[0-9]{1,3}"), "%p": ("a", "[AaPp][Mm]"),
    "%I": ("h", "[0-9]{1,2}"),
}


def translated(form: str) -> tuple[str, str]:
    """Spark's pattern for a strptime format, and the expression that its texts match."""
    pattern, shape, at = "", "", 0
    while at < len(form):
        if form[at] == "%":
            directive = form[at : at + 2]
            if directive not in DIRECTIVES:
                raise ValueError(f"Unsupported date format directive: {directive}.")
            letters, look = DIRECTIVES[directive]
            pattern, shape, at = pattern + letters, shape + look, at + 2
        else:
            c = form[at]
            pattern += "''" if c == "'" else f"'{c}'" if c.isalpha() else c
            shape += c if c.isalnum() or c == " " else "\\" + c
            at += 1
    return pattern, f"^{shape}$"


def parsed(text: Column, form: str) -> Column:
    """Timestamp without zone of a text that matches the whole format, else null."""
    pattern, shape = translated(form)
    value = F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(pattern)).cast("timestamp_ntz")
    if "%Y" in form:  # the years that nanosecond timestamps hold
        value = F.when(F.year(value).between(1678, 2261), value)
    return value


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def day_micros(ts: Column) -> Column:
    """Microseconds since midnight."""
    return F.pmod(micros(ts), F.lit(86_400_000_000))
