"""Hierarchical station names: parts, order keys and escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator candidates, in order of preference.
SEPARATOR_CANDIDATES = "./:;,!|\\ ~+*^='`\"#$%&?@<>()[]{}"


def canon_name(name: Column, case="lower", truncate=None, sep=".") -> Column:
    """Name with each part folded to one case and cut to `truncate` characters."""
    folded = {"lower": F.lower, "upper": F.upper, "off": lambda c: c}[case](name)
    if truncate is None:
        return folded
    parts = F.transform(
        F.split(folded, _quote(sep)), lambda p: F.substring(p, 1, truncate)
    )
    return F.array_join(parts, sep)


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def full_name(scope: Column, name: Column, sep=".") -> Column:
    """Name inside a survey; an empty or NULL scope adds nothing."""
    return F.concat_ws(sep, F.when(scope != "", scope), name)


def survey_of(name: Column, sep=".") -> Column:
    """Everything before the last separator, '' at the top level."""
    depth = F.size(F.split(name, _quote(sep)))
    return F.when(depth > 1, F.array_join(F.slice(F.split(name, _quote(sep)), 1, depth - 1), sep)).otherwise("")


def leaf(name: Column, sep=".") -> Column:
    return F.substring_index(name, sep, -1)


def depth_of(name: Column, sep=".") -> Column:
    """Number of parts of a name; 0 for the empty name."""
    return F.when(name == "", 0).otherwise(F.size(F.split(name, _quote(sep))))


def ancestors(name: Column, sep=".") -> Column:
    """Array of the proper prefixes of a name, outermost first ('' excluded)."""
    parts = F.split(name, _quote(sep))
    n = F.size(parts)
    return F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep),
        ),
    ).otherwise(F.array().cast("array<string>"))


def natural_key(name: Column, sep=".") -> Column:
    """String whose plain order is the natural order of names.

    Digit runs compare by value and before other characters, a separator comes
    before digits, and among equal values more leading zeros come first.
    """

    def encode(token):
        digits = F.regexp_replace(token, "^0+", "")
        zeros = F.length(token) - F.length(digits)
        number = F.concat(
            F.lit("\u0002"),
            F.lpad(F.length(digits).cast("string"), 5, "0"),
            digits,
            F.lpad((99999 - zeros).cast("string"), 5, "0"),
        )
        return (
            F.when(token == sep, F.lit("\u0001"))
            .when(token.rlike("^[0-9]"), number)
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9])"), 1)
    return F.array_join(F.transform(tokens, encode), "")


def csv_quote(text: Column) -> Column:
    """Quoted, with quotes doubled, only when the text needs it."""
    return F.when(
        text.rlike("[,\"\\r\\n]"),
        F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"')),
    ).otherwise(text)


def xml_escape(text: Column) -> Column:
    t = F.regexp_replace(text, "&", "&amp;")
    t = F.regexp_replace(t, "<", "&lt;")
    return F.regexp_replace(t, ">", "&gt;")


def plot_escape(text: Column) -> Column:
    """Name fit for a line-coded plot file, where space and controls are taken.

    '^' starts an escape: '^^' itself, '^_' a space, '^@'..'^Z' bytes 0-26 and
    '^a'..'^e' bytes 27-31.
    """
    t = F.regexp_replace(text, r"\^", "^^")
    t = F.regexp_replace(t, " ", "^_")
    code = F.ascii
    chars = F.split(t, "")
    return F.when(
        t.rlike("[\\x00-\\x1f]"),
        F.array_join(
            F.transform(
                chars,
                lambda c: F.when(
                    (c != "") & (code(c) <= 26),
                    F.concat(F.lit("^"), F.char(code(c) + 64)),
                )
                .when(
                    (c != "") & (code(c) < 32),
                    F.concat(F.lit("^"), F.char(code(c) + 70)),
                )
                .otherwise(c),
            ),
            "",
        ),
    ).otherwise(t)
