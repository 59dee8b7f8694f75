"""Small scalar functions."""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import Column
from pyspark.sql import functions as F


def longer_suffix(s: Column, suffix: Column) -> Column:
    """Whether s ends with the suffix and isn't the suffix itself."""
    return F.endswith(s, suffix) & (F.length(s) > F.length(suffix))


def octal(field: Column) -> Column:
    """A number in octal digits, blanks and NULs around it trimmed."""
    return F.conv(F.btrim(field, F.lit(" \0")), 8, 10).cast("long")


def tar_number(field: bytes) -> int:
    """Numeric tar field: octal digits, or base 256 when the high bit is set."""
    if field and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.split(b"\0")[0].strip()
    return int(digits, 8) if digits else 0


def member_name(path: str) -> str:
    """name/name.mtx for .../name.tar.gz: where such an archive holds its matrix."""
    base = re.sub(r"\.(tar\.gz|tgz|tar)$", "", path.rsplit("/", 1)[-1])
    return f"{base}/{base}.mtx"


def reorder_suffix(path: str) -> tuple[str, str | None, int]:
    """Path without __RCM and __GP<n> suffixes, the orderings asked for ("rcm", "gp", "rcm+gp") and the number of parts."""
    asked, parts = [], 0
    for mark in ("__RCM", "__GP"):
        at = path.rfind(mark)
        if at >= 0:
            found = re.match(r"\d+", path[at + len(mark) :])
            if mark == "__GP":
                parts = int(found[0]) if found else 0
            path = path[:at]
            asked.append(mark[2:].lower())
    return path, "+".join(asked) or None, parts


def wrap_text(s: str, width: int) -> str:
    return "\n".join(textwrap.wrap(s, width, break_long_words=False))
