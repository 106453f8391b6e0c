"""Retrieval: exact neighbours by vectors and by words, and the embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from opinionlake.operators.neighbours import nearest, touched
from opinionlake.operators.postings import nearest_terms, words_of

__all__ = ["embed", "nearest", "nearest_terms", "touched", "words_of"]


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Adds ``embedding`` from a user's batch function, one Arrow batch a time."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = model(batch[text_col].tolist())
            yield batch.assign(embedding=[np.asarray(v, dtype=np.float32) for v in vectors])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(add, f"{fields}, embedding array<float>")
