"""Is decoded text worth reading: ratio tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import DecodeOptions


def residue(text: Column) -> Column:
    """The characters that are not printable; all that are not ASCII, and the control characters, are among them."""
    return F.regexp_replace(text, r"[\x20-\x7E\t\n\r]+", "")


def _share(text: Column, others: Column) -> Column:
    """Share of a text's characters that are not in `others`."""
    return F.try_divide(F.length(text) - F.length(others), F.length(text))


def _printable(text: Column, rest: Column) -> Column:
    return _share(text, rest)


def _ascii(text: Column, rest: Column) -> Column:
    return _share(text, F.regexp_replace(rest, r"[\x00-\x7F]+", ""))


def _control(text: Column, rest: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(rest, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]+", "")), F.length(text))


def printable_share(text: Column) -> Column:
    return _printable(text, residue(text))


def ascii_share(text: Column) -> Column:
    return _ascii(text, residue(text))


def control_share(text: Column) -> Column:
    return _control(text, residue(text))


def _judged(text: Column, test) -> Column:
    """test(text, residue): as the one element of a list, the residue is worked out once."""
    both = F.array(F.struct(text.alias("t"), residue(text).alias("r")))
    return F.get(F.transform(both, lambda s: test(s["t"], s["r"])), F.lit(0))


BLANKS = "".join(map(chr, range(33)))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def looks_structured(text: Column, brace_balance: bool = False) -> Column:
    return F.get(F.transform(F.array(trimmed(text)), lambda t: _structured(t, brace_balance)), F.lit(0))


def _structured(t: Column, brace_balance: bool) -> Column:
    braces = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    json = braces & (F.length(t) > 1)
    if brace_balance:  # never more than two closing braces ahead of the opening ones
        low = F.aggregate(
            F.split(F.regexp_replace(t, r"[^{}]+", ""), ""),
            F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
            lambda a, c: F.struct(
                (a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"),
                F.least(a["low"], a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("low"),
            ),
        )["low"]
        json = json & (low >= -2)
    link = t.startswith("http://") | t.startswith("https://")
    fields = (F.instr(t, ":") > 1) & (F.instr(t, ",") > 1)
    at = F.instr(t, "@")
    mail = (at > 1) & F.contains(F.substring(t, at + 1, F.length(t)), F.lit("."))
    return json | link | fields | mail


def _passes(text: Column, rest: Column, options: DecodeOptions) -> Column:
    p, a, c, plain = (0.90, 0.85, 0.01, 0.94) if options.strict else (0.80, 0.70, 0.03, 0.86)
    printable = _printable(text, rest)
    shares = (printable >= p) & (_ascii(text, rest) >= a) & (_control(text, rest) <= c)
    return (F.length(text) > 0) & shares & ((printable >= plain) | looks_structured(text, options.brace_balance))


def _readable(text: Column, rest: Column) -> Column:
    return (_control(text, rest) <= 0.05) & (_printable(text, rest) >= 0.70)


def passes(text: Column, options: DecodeOptions) -> Column:
    return _judged(text, lambda t, r: _passes(t, r, options))


def readable(text: Column) -> Column:
    return _judged(text, _readable)


def accepted(text: Column, options: DecodeOptions) -> Column:
    """Not null, of a length within bounds, and through the gates; never null."""

    def good(t: Column, r: Column) -> Column:
        ok = _passes(t, r, options)
        return ok & _readable(t, r) if options.readable_only else ok

    some = F.when(F.length(text).between(options.min_decoded, options.max_decoded), text)
    return F.coalesce(_judged(some, good), F.lit(False))
