"""Rules that turn class probabilities (down, flat, up) into signals 0, 1, 2. All comparisons with thresholds are strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The thresholds of the standard sweep.
THRESHOLDS = (0.0, 0.50, 0.55, 0.60, 0.65, 0.70, 0.72, 0.73, 0.74, 0.75, 0.78, 0.80, 0.82, 0.84, 0.85, 0.88, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98)


def argmax(down: Column, flat: Column, up: Column) -> Column:
    """The likeliest class; ties go to the lower one."""
    return F.when((down >= flat) & (down >= up), 0).when(flat >= up, 1).otherwise(2)


def threshold_rule(down: Column, flat: Column, up: Column, threshold: Column) -> Column:
    """Argmax at threshold 0; else the side over the threshold, the likelier if both are, ties to up."""
    return F.when(threshold <= 0, argmax(down, flat, up)).when((up > threshold) & (~(down > threshold) | (up >= down)), 2).when(down > threshold, 0).otherwise(1)


def up_first_rule(down: Column, up: Column, threshold: Column) -> Column:
    """The older rule: up wins whenever it is over the threshold."""
    return F.when(up > threshold, 2).when(down > threshold, 0).otherwise(1)


def sell_first_rule(down: Column, up: Column, threshold: Column) -> Column:
    """The candle chart's rule: sell if down is over the threshold, else buy if up is."""
    return F.when(down > threshold, 0).when(up > threshold, 2).otherwise(1)


def ratio_rule(down: Column, flat: Column, up: Column, down_ratio: Column, up_ratio: Column) -> Column:
    return argmax(down * down_ratio, flat, up * up_ratio)


def pnl(signal: Column, change: Column) -> Column:
    """What a signal earns; 0 without one."""
    return F.when(signal == 2, change).when(signal == 0, -change).otherwise(0.0)
