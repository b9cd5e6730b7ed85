"""String helpers that keep the audit's text semantics inside Spark expressions.

The audit rules were written against a wider notion of white space than Java's
``\\s`` (it includes the no-break space and the byte order mark) and against an
end anchor that does not tolerate a final newline. Everything here builds
Columns; nothing runs per row in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white-space characters that trimming and \s cover.
WS_CLASS = "\\t-\\r\\p{Z}\\x{feff}"
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


# ASCII word boundary; Java's own \\b also counts accented letters as word characters.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def opens_with(pattern: str, i: int) -> str | None:
    """The letters and digits (as the inside of a class) one of which opens whatever matches the pattern from ``i`` on; None
    where that is not plain."""
    if pattern[i : i + 1] == "(":
        depth, j, starts = 0, i, [i + (3 if pattern.startswith("(?:", i) else 1)]
        if pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
            return None
        while j < len(pattern):
            ch = pattern[j]
            if ch in "\\[":
                j = pattern.find("]", j) if ch == "[" else j + 1
                if j < 0:
                    return None
            elif ch in "()":
                depth += 1 if ch == "(" else -1
                if depth == 0:
                    break
            elif ch == "|" and depth == 1:
                starts.append(j + 1)
            j += 1
        found = [opens_with(pattern, k) for k in starts]
        end, out = j + 1, None if None in found else "".join(found)
    elif pattern.startswith("\\d", i):
        end, out = i + 2, "0-9"
    elif m := re.match(r"\[((?:A-Z|0-9)+)\]", pattern[i:]):
        end, out = i + m.end(), m.group(1)
    elif m := re.match("[A-Za-z0-9]", pattern[i:]):
        end, out = i + 1, m.group()
    else:
        return None
    # what may be left out does not open the match
    return None if re.match(r"[?*]|\{0?,|\{0\}", pattern[end:]) else out


def rx(pattern: str, flags: str = "") -> str:
    """Rule pattern -> Java pattern: wide ``\\s``/``\\S``, strict ``$``, ``i`` flag as a prefix. A word boundary ahead of a known
    letter or digit asks for that first: one comparison rules most places out."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_CLASS if in_class else f"[{WS_CLASS}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{WS_CLASS}]")
            elif nxt == "b" and not in_class:
                first = opens_with(pattern, i + 2)
                out.append(WORD_EDGE if first is None else f"(?=[{first}])(?<!\\w)")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "$" and not in_class:
            out.append("\\z")
            i += 1
            continue
        out.append(ch)
        i += 1
    prefix = "(?i)" if "i" in flags else ""
    return prefix + "".join(out)


def test(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(rx(pattern, flags))


def extract(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match's group, null when the pattern does not match (or the group is empty)."""
    return F.nullif(F.regexp_extract(col, rx(pattern, flags), group), F.lit(""))


def replace(col: Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(col, rx(pattern, flags), to)


def trim(col: Column) -> Column:
    """Plain blanks go first: each of them costs the wide trim a search through its characters."""
    return F.btrim(F.trim(col), F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    """Null, or nothing but white space. A value that opens with a visible ASCII character is not, and needs no trim."""
    return F.coalesce(~((col >= "!") & (col < "\x7f")) & (trim(col) == ""), F.lit(True))


def trim_value(v: Column) -> Column:
    """``trim`` of a value that costs nothing to read again (a column, an item): between visible ASCII characters there is
    nothing to trim, and the wide trim looks both ends up in all its characters."""
    last = F.substring(v, -1, 1)
    return F.when((v >= "!") & (v < "\x7f") & (last >= "!") & (last < "\x7f"), v).otherwise(trim(v))


def holds(v: Column, word: str) -> Column:
    """Whether the value holds a word (lower-case ASCII) in any case: rules out what a pattern with it needn't be tried on."""
    return F.lower(v).contains(word)


def drop_white_space(col: Column) -> Column:
    return F.regexp_replace(col, f"[{WS_CLASS}]+", "")


def without(col: Column, chars: str, to: str = "") -> Column:
    """Each of a few characters replaced: a search of the bytes for each, where ``translate`` looks every character up."""
    for ch in chars:
        col = F.replace(col, F.lit(ch), F.lit(to))
    return col


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def alnum_key(col: Column) -> Column:
    """Upper case, letters and digits only: the form payload text is compared in."""
    return F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), "[^A-Z0-9]+", "")


def unique_non_empty(arr: Column) -> Column:
    """Trimmed, non-empty, first occurrence kept."""
    return F.array_distinct(
        F.filter(F.transform(arr, lambda v: F.coalesce(trim_value(v), F.lit(""))), lambda v: v != "")
    )


def struct_of(df: DataFrame, fields: dict[str, Column] | list[Column], only: set[str] | None = None) -> Column:
    """A struct of the fields (by name, or named columns) over df's columns; those that ``only`` leaves out are nulls of their
    type, so that nothing derives them."""
    cols = [c.alias(n) for n, c in fields.items()] if isinstance(fields, dict) else fields
    if only is None:
        return F.struct(*cols)
    types = df.select(*cols).schema
    return F.struct(*[c if t.name in only else F.lit(None).cast(t.dataType).alias(t.name) for c, t in zip(cols, types, strict=True)])


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (a let-binding built from array functions)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def number_text(col: Column) -> Column:
    """Double shown without a trailing ``.0``."""
    return F.regexp_replace(col.cast("string"), "\\.0$", "")
