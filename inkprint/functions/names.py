"""Column names taken from corpus text may hold dots, quotes or backticks; these helpers write them safely."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(names: Iterable[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]
