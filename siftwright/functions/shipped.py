"""What every Python worker needs whole, such as a dictionary: sent once, not with each task."""

from __future__ import annotations

from pyspark import Broadcast, SparkContext
from pyspark.sql import SparkSession


class Shipped:
    """An object that goes to each Python worker once, however many columns and tasks use it."""

    _shared: tuple[SparkContext, Broadcast] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shared": None}

    def shared(self) -> Broadcast:
        context = SparkSession.active().sparkContext
        if self._shared is None or self._shared[0] is not context:
            self._shared = context, context.broadcast(self)
        return self._shared[1]
