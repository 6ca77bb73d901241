"""Keep the optimizer from evaluating a dear expression more than once per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinned(c: Column) -> Column:
    """The same value, but neither inlined into several readers nor pushed into filters.

    A later filter on a parsed field would otherwise be moved below the parse
    with the whole expression copied into it. Filters that can prune files
    belong before the parse.
    """
    return F.when(F.spark_partition_id() >= 0, c)
