"""Non-null items, as expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestframe.functions.coerce import Coerced


def non_null_items(items: Column) -> Column:
    """A list whose items may not be null: null as a whole where one is."""
    return F.when(~F.exists(items, lambda x: x.isNull()), items)


def items(values: Column, item: Callable[[Column], Coerced], non_null: bool = False) -> Column:
    """Each item coerced; an item that can't be is null, or, where items may not be null, the whole list."""
    out = F.transform(values, lambda x: item(x).value)
    return non_null_items(out) if non_null else out
