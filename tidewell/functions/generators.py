"""Table functions: generators that yield rows one after the other."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf


@udtf(returnType="win int, features array<double>")
class windows_of:  # noqa: N801  used as a function
    """(win, features): windows of a list, `size` values every `step`."""

    def eval(self, values: list, size: int, step: int) -> Iterator[tuple]:
        for i in range((len(values) - size) // step + 1 if values and len(values) >= size else 0):
            yield i, [float(v) for v in values[i * step : i * step + size]]
