"""Compatibility normalisation, which Spark has no function for. Arrow-batched; ASCII rows cost one check."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(text: Column) -> Column:
    """Lower-case letters a-z and digits after NFKC (mathematical letters become plain ones)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        fold = lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t)
        return texts.map(lambda t: None if t is None else re.sub("[^0-9a-z]", "", fold(t).lower()))

    return run(text)
