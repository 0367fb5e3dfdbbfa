"""Export of a month range as JSON lines: activities by month, and the months' summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C

TEXTS = ("title", "subtitle", "description", "counterparty")


def export_rows(items: DataFrame, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """``items`` as they are written: long runs of digits in the texts keep their last four."""
    return items.withColumns({c: C.mask_long_digits(F.col(c)) for c in texts if c in items.columns})


def export_items(items: DataFrame, path: str, texts: tuple[str, ...] = TEXTS, summaries: DataFrame | None = None) -> None:
    """Writes ``items`` under ``path``, one folder a month, or under ``path``/items beside ``path``/summaries if there are any."""
    export_rows(items, texts).write.partitionBy("month").json(f"{path}/items" if summaries is not None else path)
    if summaries is not None:
        summaries.write.json(f"{path}/summaries")
