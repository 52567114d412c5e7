"""Bloom filters that spare rows an exchange: a filter of bounded size goes to every task in place of the keys.

A key that was put in is always found; others seldom are, so whoever asks decides exactly afterwards. The
filter has `PER_KEY` bits a key, but never more than `MOST_BITS` (8 MB), whatever the number of keys. Far more
keys than that fill it, and then it spares less, up to nothing, but never loses a row.

Defined results: without keys nothing is found; null keys are keys like any other (as hashes have them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_KEY, MOST_BITS = 16, 1 << 26
#: Where in the hash each of a key's places starts.
STARTS = (0, 19, 38)


class Bloom:
    """What `columns` of `keys` hold, asked by columns of the same types in the same order."""

    def __init__(self, keys: DataFrame, columns: list[str], most_bits: int = MOST_BITS):
        self.bits, wanted = 64, min(most_bits, PER_KEY * keys.count())
        while self.bits < wanted:
            self.bits *= 2
        hashes = F.xxhash64(*columns)
        places = F.explode(F.array(*(F.shiftrightunsigned(hashes, s).bitwiseAND(F.lit(self.bits - 1).cast("long")) for s in STARTS)))
        words = keys.select(places.alias("p")).select(F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # most_bits / 64 rows at most
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)

    def may_hold(self, *columns: Column) -> Column:
        words, bits = self.words, np.uint64(self.bits - 1)

        @F.pandas_udf("boolean")
        def held(hashes: pd.Series) -> pd.Series:
            h = hashes.to_numpy(np.int64).view(np.uint64)
            out = np.ones(len(h), bool)
            for s in STARTS:
                p = (h >> np.uint64(s)) & bits
                out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pd.Series(out)

        return held(F.xxhash64(*columns))
