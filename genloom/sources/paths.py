"""Path templates: {a:b} stands for every integer from a to b."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = re.compile(r"\{(-?\d+):(-?\d+)\}")


def expand(template: str) -> list[str]:
    """All paths of a template, in order; a template without a range is one path."""
    m = _RANGE.search(template)
    if not m:
        return [template]
    return [p for i in range(int(m[1]), int(m[2]) + 1) for p in expand(template[: m.start()] + str(i) + template[m.end() :])]


def number_in(template: str, path: Column) -> Column:
    """The integer that a template's first range has in a path, e.g. of input_file_name()."""
    m = _RANGE.search(template)
    assert m, "the template has no range"
    name = re.escape(template[: m.start()].rpartition("/")[2])
    return F.regexp_extract(path, f"{name}(-?\\d+)", 1).cast("int")
