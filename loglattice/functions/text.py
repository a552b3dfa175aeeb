"""Scalar functions on text: tokenizers, predicates, number forms. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
TOKEN = "([^ \\t:=,]+|[ \\t:=,])"
TRAINING_TOKEN = "(<\\*>|\\s+|[:,=]|(?:(?!<\\*>)[^\\s:,=])+)"
INTEGER = "^(0|-?[1-9][0-9]{0,17})$"
FIXED_DIGITS = "^[0-9]{1,18}$"
SIGNATURE_CHARS = "[^-#><_:;,\\[\\]\\\\/.()]"


def match_tokens(text: Column) -> Column:
    """Tokens for matching: each blank, tab, colon, equals sign and comma is a token of its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def training_tokens(text: Column) -> Column:
    """Tokens for training: as for matching, but a run of white space is one token."""
    return F.regexp_extract_all(text, F.lit(TRAINING_TOKEN), F.lit(1))


def header_fields(text: Column) -> Column:
    """Fields between runs of blanks, tabs and bars."""
    return F.regexp_extract_all(text, F.lit("[^ \\t|]+"), F.lit(0))


def header_separators(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[ \\t|]+"), F.lit(0))


def head_of(text: Column, length: int) -> Column:
    """The first `length` header fields with their separators, exactly as written; empty if the line has fewer."""
    return F.regexp_extract(text, f"^((?:[^ \\t|]+[ \\t|]+){{{length}}})", 1)


def content_of(text: Column, length: int) -> Column:
    """What follows the header."""
    return F.regexp_extract(text, f"^(?:[^ \\t|]+[ \\t|]+){{{length}}}((?s).*)$", 1)


def digit_runs(text: Column) -> Column:
    """Alternating runs of digits and of other characters."""
    return F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def masked_numbers(tokens: Column) -> Column:
    """All-digit tokens and tokens that begin with a dotted IPv4 address become wildcards."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$|^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+"), WILDCARD).otherwise(t))


def masked_digits(tokens: Column) -> Column:
    """Every token with a digit becomes a wildcard."""
    return F.transform(tokens, lambda t: F.when(has_digit(t), WILDCARD).otherwise(t))


def is_integer(value: Column) -> Column:
    """Canonical 64-bit integers only: what is restored from a number must be the same text."""
    return value.rlike(INTEGER)


def zero_padded(value: Column, length: Column) -> Column:
    """Left-padded with zeros to a length; longer values and length -1 stay as they are."""
    return F.when((length > F.length(value)) & (length > 0), F.lpad(value, length, "0")).otherwise(value)


def number_prefix(value: Column) -> Column:
    return F.regexp_extract(value, "^([0-9]+)", 1).try_cast("bigint") if hasattr(value, "try_cast") else F.regexp_extract(value, "^([0-9]+)", 1).cast("bigint")


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    import re

    return re.sub(r"([\\.^$|?*+()\[\]{}/-])", r"\\\1", text)


def fits_layout(head: Column, layout: list) -> Column:
    """Do a header's fields fit a layout's rows (field, part, piece, length): literals as they are, numbers of the given length, of any where that is -1."""
    out = F.lit(True)
    for field in sorted({r.field for r in layout}):
        parts = [("[0-9]+" if r.length < 0 else f"[0-9]{{{r.length}}}") if r.piece == "%d" else literal(r.piece) for r in sorted(layout, key=lambda r: r.part) if r.field == field]
        out = out & F.coalesce(F.get(header_fields(head), F.lit(field)).rlike(f"^{''.join(parts)}\\z"), F.lit(False))
    return out


def fits_format(value: Column, pattern: str) -> Column:
    """Does a header value fit a format of literals and %d parts."""
    import re

    parts = "".join("[0-9]+" if p == "%d" else literal(p) for p in re.split(r"(%d)", pattern))
    return value.rlike(f"^{parts}$")


def signature(value: Column) -> Column:
    """The delimiter characters of a value, in order."""
    return F.regexp_replace(value, SIGNATURE_CHARS, "")


def transposed(values: Column) -> Column:
    """Texts written character column by character column; shorter ones are skipped where they end."""
    longest = F.array_max(F.transform(values, lambda v: F.length(v)))
    return F.when(longest > 0, F.array_join(F.transform(F.sequence(F.lit(1), longest), lambda i: F.array_join(F.transform(values, lambda v: F.substr(v, i, F.lit(1))), "")), "")).otherwise("")


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("bigint")))


def varint_size(z: Column) -> Column:
    """Bytes of a variable-length integer of 7-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(z), "^0+", "")) / F.lit(7.0))).cast("bigint")


def big_endian(n: Column) -> Column:
    """The low 32 bits as 4 bytes, high byte first."""
    return F.unhex(F.right(F.lpad(F.hex(n), 16, "0"), F.lit(8)))


def collapsed_wildcards(text: Column) -> Column:
    return F.regexp_replace(text, "(<\\*>)+", WILDCARD)
