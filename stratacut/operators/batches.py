"""Grouped work in numpy on many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROWS = 20_000


def starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups begin in rows sorted by ``keys``."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least: int) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut anew where groups end: at least ``least`` rows each but the last, and no group in two."""
    held, n, wanted = [], 0, least
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < wanted:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = int(starts(rows, keys)[-1])
        if last:
            yield rows.iloc[:last].reset_index(drop=True)
            held, n, wanted = [rows.iloc[last:]], len(rows) - last, least
        else:  # one long group: look again when it has doubled
            held, wanted = [rows], 2 * n
    if n:
        yield pd.concat(held, ignore_index=True)


def by_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, least: int = ROWS) -> DataFrame:
    """``work`` on tables of many whole groups of ``keys``, sorted by ``keys`` and ``order``.

    A call of its own for each group costs some milliseconds, which is most of the time where groups are pictures of a few hundred rows. A
    table is some ``least`` rows, or one group where that is larger. The number of partitions is fixed, as rows say little of the work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups((b for b in batches if len(b)), keys, least):
            yield work(rows)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
