"""Settings that every operator takes explicitly, so that results can be repeated."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EngineConf:
    as_of: datetime = datetime(2024, 1, 31)
    session_gap_s: int = 1800
    seed: int = 42
    #: Days since the last purchase from which a client counts as churning.
    churn_days: int = 14
    compat_weekday: bool = False
    #: Items of a session that take part in a profile's pairs; None for all.
    pair_items: int | None = 20

    @property
    def now(self) -> Column:
        return F.lit(self.as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


CONF = EngineConf()

# Event types and weights of the profile features.
EVENT_TYPES = ["page_visit", "add_to_cart", "product_buy", "remove_from_cart", "search_query"]
EVENT_WEIGHTS = {"page_visit": 1, "add_to_cart": 3, "product_buy": 5, "remove_from_cart": -2}
