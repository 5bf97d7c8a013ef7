"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_if(s: Column, chars: str) -> Column:
    """s without leading and trailing characters of a class, e.g. r"\\p{Punct}"."""
    return F.regexp_replace(s, f"^[{chars}]+|[{chars}]+$", "")


def all_of(s: Column, chars: str) -> Column:
    """Whether every character is of the class; true for an empty string."""
    return s.rlike(f"^[{chars}]*$")


def find_head(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def find_tail(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def find_first(s: Column, what: str) -> Column:
    """Place from 0, or -1."""
    return F.instr(s, what) - 1


def find_last(s: Column, what: str) -> Column:
    return F.when(F.instr(s, what) == 0, F.lit(-1)).otherwise(F.length(s) - F.instr(F.reverse(s), what[::-1]) - len(what) + 1)


def ifind_all(s: Column, what: str) -> Column:
    """All places where what occurs, in any case, as written."""
    return F.regexp_extract_all(s, F.lit(f"(?i)({what})"), F.lit(1))


def split(s: Column, chars: str, compress: bool = False) -> Column:
    """Parts between separators; empty edges stay. compress takes neighbouring separators as one."""
    return F.split(s, f"[{chars}]{'+' if compress else ''}", -1)


def join_if(parts: Column, by: str, pred) -> Column:
    return F.array_join(F.filter(parts, pred), by)


def tokens(s: Column, pattern: str = r"\w+") -> Column:
    return F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))


def separated(s: Column, dropped: str, kept: str = "", keep_empty: bool = False) -> Column:
    """Tokens between dropped separators; kept separators are tokens of their own."""
    if kept:
        s = F.regexp_replace(s, f"([{kept}])", "\x01$1\x01")
    parts = F.split(s, f"[\x01{dropped}]", -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def default_tokens(s: Column) -> Column:
    """Words between white space and punctuation."""
    return F.filter(F.split(s, r"[\s\p{Punct}]+"), lambda x: x != "")


def offsets(s: Column, sizes: list[int]) -> Column:
    """Pieces of fixed sizes, one after the other."""
    starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    return F.array(*[F.substring(s, a, n) for a, n in zip(starts, sizes, strict=True)])


def iequals(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def replace_nth(s: Column, what: str, new: str, n: int) -> Column:
    """s with its n-th place of what, from 0 or from the end if negative, replaced; s itself where there is none."""
    import re

    parts = F.split(s, re.escape(what), -1)
    at = F.lit(n + 1) if n >= 0 else F.size(parts) + n
    left = F.array_join(F.slice(parts, F.lit(1), F.greatest(at, F.lit(0))), what)
    right = F.array_join(F.slice(parts, F.greatest(at + 1, F.lit(1)), F.greatest(F.size(parts) - at, F.lit(0))), what)
    return F.when((at >= 1) & (at < F.size(parts)), F.concat(left, F.lit(new), right)).otherwise(s)


def erase_all(s: Column, what: str) -> Column:
    return F.replace(s, F.lit(what), F.lit(""))


def ireplace_all(s: Column, what: str, new: str) -> Column:
    """Every place of what, in any case, replaced."""
    import re

    return F.regexp_replace(s, "(?i)" + re.escape(what), new.replace("\\", "\\\\").replace("$", "\\$"))


def erase_head(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(n + 1), F.greatest(F.length(s) - n, F.lit(0)))


def is_class(s: Column, name: str) -> Column:
    """Whether every character is of a class: alnum, alpha, digit, lower, upper, punct, space, xdigit."""
    return all_of(s, "\\p{" + {"xdigit": "XDigit"}.get(name, name.capitalize()) + "}")
