"""Scalar functions on texts, paths and patterns, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY_PROBE = 1024


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def under_any(path: Column, prefixes: list[str]) -> Column:
    """True if ``path`` starts with one of ``prefixes`` (as strings, not as folders); all if there are none."""
    if not prefixes:
        return F.lit(True)
    specs = F.array(*[F.lit(p.replace("\\", "/")) for p in prefixes])
    return F.exists(specs, lambda p: F.startswith(path, p))


def stored_text(text: Column) -> Column:
    """Storage form: without carriage returns, unless there is a NUL anywhere."""
    return F.when(F.contains(text, F.lit("\x00")), text).otherwise(F.replace(text, F.lit("\r"), F.lit("")))


def diff_text(text: Column) -> Column:
    """Form for diffs: no byte order mark, and every kind of line end a line feed."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def show_text(text: Column) -> Column:
    """Form for display: no byte order mark, pairs of CR and LF a line feed."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")


def is_binary(text: Column) -> Column:
    return F.contains(F.substring(text, 1, BINARY_PROBE), F.lit("\x00"))


def lines(text: Column) -> Column:
    """Lines without a trailing empty one; none of an empty text."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def joined(line_array: Column, trailing_newline: Column) -> Column:
    return F.concat(F.array_join(line_array, "\n"), F.when(trailing_newline, "\n").otherwise(""))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def short_id(hash_: Column) -> Column:
    """The first 8 characters of an id."""
    return F.substring(hash_, 1, 8)


def short_date(at: Column) -> Column:
    """Day, hour and minute."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def kilobytes(n_bytes: Column) -> Column:
    """Bytes as kilobytes of 1,024, with one decimal, halves up."""
    tenths = F.floor((n_bytes * 10 + 512) / 1024)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" KB"))


def ignore_pattern(globs: list[str]) -> str:
    """One regular expression for ignore globs in the style of ignore files (no negation).

    A pattern without a slash matches a name at any depth; a trailing slash or a matching
    folder takes all below it; ``*`` and ``?`` stop at slashes and ``**`` does not.
    """
    out = []
    for g in globs:
        g = g.strip()
        if not g or g.startswith("#"):
            continue
        body = g.strip("/")
        text, k = "", 0
        while k < len(body):
            if body[k : k + 3] == "**/":
                text, k = text + "(?:.*/)?", k + 3
            elif body[k : k + 2] == "**":
                text, k = text + ".*", k + 2
            elif body[k] == "*":
                text, k = text + "[^/]*", k + 1
            elif body[k] == "?":
                text, k = text + "[^/]", k + 1
            else:
                text, k = text + ("\\" + body[k] if body[k] in r".+()[]{}^$|\\" else body[k]), k + 1
        anchored = "/" in body or g.startswith("/")
        out.append(("^" if anchored else "(?:^|/)") + text + ("/" if g.endswith("/") else "(?:/|$)"))
    return "|".join(out)
