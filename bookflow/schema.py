"""Column names, types and constants of order-book snapshots."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = (1, 2, 3, 4, 5)
BIDS = [f"n_bid{i}" for i in LEVELS]
ASKS = [f"n_ask{i}" for i in LEVELS]
BSIZES = [f"n_bsize{i}" for i in LEVELS]
ASIZES = [f"n_asize{i}" for i in LEVELS]
RAW = ["n_close", "amount_delta", "n_midprice", *(f"n_{s}{i}" for pair in (("bid", "bsize"), ("ask", "asize")) for i in LEVELS for s in pair)]
# Prediction horizons in ticks; half-width of the flat band of the direction label, by horizon; price change
# at which an instrument is at its limit; what is added to divisors.
HORIZONS = (5, 10, 20, 40, 60)
ALPHA = {5: 0.0005, 10: 0.0005, 20: 0.001, 40: 0.001, 60: 0.001}
LIMIT = 0.095
EPS = 1e-10
LABELS = [f"label_{h}" for h in HORIZONS]
#: The key of a window: one instrument, day and session; windows never cross these.
GROUP = ("sym", "date", "session")
SNAPSHOT = T.StructType(
    [T.StructField("date", T.IntegerType()), T.StructField("time", T.StringType()), T.StructField("sym", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW]
    + [T.StructField(c, T.DoubleType()) for c in LABELS]
)
