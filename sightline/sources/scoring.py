"""Hook for a user's own scoring model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sightline.schemas import CANDIDATES

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_tiles(tiles: DataFrame, scorer: Scorer) -> DataFrame:
    """CANDIDATES from tile rows through a user function over Arrow batches.

    The function is called once per partition, so it can load its model once.
    """
    return tiles.mapInPandas(scorer, CANDIDATES)
