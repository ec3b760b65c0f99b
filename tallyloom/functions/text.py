"""Text helpers for names, codes and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character Python's ``str.strip`` removes, as a class both Java and RE2 read.
WHITESPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def joined(*parts: Column, sep: str = " ") -> Column:
    """Concatenate with ``sep``; NULL if any part is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = F.concat(out, F.lit(sep), part)
    return out


def joined_present(*parts: Column, sep: str = " ") -> Column:
    """Concatenate the parts that are not NULL."""
    return F.concat_ws(sep, *parts)


def nth_part(text: Column, sep: str, n: int) -> Column:
    """The n-th piece (1-based); empty when there is none."""
    return F.split_part(text, F.lit(sep), F.lit(n))


def before(text: Column, mark: str) -> Column:
    """Text before the first ``mark``; the whole text without one."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """Text after the first ``mark``; NULL without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + F.lit(len(mark))))


def initials(*parts: Column) -> Column:
    return F.upper(F.concat(*[F.left(p, F.lit(1)) for p in parts]))


def length_or_zero(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def has_text(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def stars(count: Column, mark: str = "*") -> Column:
    return F.repeat(F.lit(mark), count.cast("int"))


def contains_text(text: Column, needle: str) -> Column:
    return text.contains(needle)


def clean_name(name: str, prefix: str = "") -> str:
    """A lower-case column name with underscores and without ``prefix``."""
    name = name.strip()
    if prefix and name.lower().startswith(prefix.lower()):
        name = name[len(prefix):]
    kept = "".join(c if c.isalnum() else "_" for c in name.lower())
    return "_".join(piece for piece in kept.split("_") if piece)
