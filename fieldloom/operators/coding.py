"""Entropy code tables as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.entropy import canonical_codes, code_lengths
from fieldloom.functions.scalars import CAPACITY


def code_table(histogram: DataFrame) -> DataFrame:
    """(q, freq, length, code): canonical Huffman code of one histogram.

    The alphabet of quantization indices has at most CAPACITY + 1 symbols, which
    bounds the one group that builds the tree; the symbols themselves are
    counted and coded in parallel.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > CAPACITY + 1:
            raise ValueError("not a histogram of quantization indices")
        pdf = pdf.sort_values("q")
        lengths = code_lengths(pdf.freq.to_numpy())
        pdf = pdf.assign(length=lengths.astype(np.int32)).sort_values(["length", "q"])
        return pdf.assign(code=canonical_codes(pdf.length.to_numpy()).astype(np.int64))

    return (
        histogram.select(F.lit(0).alias("one"), "q", "freq")
        .groupBy("one")
        .applyInPandas(lambda pdf: build(pdf.drop(columns="one")), "q int, freq bigint, length int, code bigint")
    )
