"""Blocks of audio samples as arrays: resampling by means of buckets, 16-bit quantising, bytes.

A block is a row; blocks are resampled one by one, and what is left of a bucket at a block's end is dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rates of input and output, and frames of a block.
INPUT_RATE, OUTPUT_RATE, BLOCK_FRAMES = 48_000, 16_000, 4_096


def quantise(sample: Column) -> Column:
    """A sample as a 16-bit number: clamped to [-1, 1], scaled by 32768 below zero, else by 32767, cut towards
    zero. Null and NaN are 0."""
    x = F.coalesce(F.nanvl(sample.cast("double"), F.lit(0.0)), F.lit(0.0))
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.when(x < 0, x * 32768.0).otherwise(x * 32767.0).cast("smallint")


def _means(samples: Column, n: Column, start, end) -> Column:
    """Means of the buckets [start(i), end(i)) for i from 0 to n - 1; an empty bucket's is 0."""

    def mean(i: Column) -> Column:
        a, z = start(i), end(i)
        bucket = F.slice(samples, (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))
        total = F.aggregate(bucket, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))
        return F.when(z > a, total / F.greatest(z - a, F.lit(1))).otherwise(F.lit(0.0))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), mean)).otherwise(F.array().cast("array<double>"))


def capture(samples: Column, rate: int = INPUT_RATE, to: int = OUTPUT_RATE) -> Column:
    """Samples at another rate as 16-bit numbers: one at least, none of an empty or null block.
    Raising the rate leaves gaps of zeros."""
    ratio, size = rate / to, F.size(samples)
    n = F.greatest(F.lit(1), F.floor(size / ratio))
    edge = lambda i: F.least(size, F.floor(i * F.lit(ratio)))
    made = F.transform(_means(samples, n, edge, lambda i: edge(i + 1)), quantise)
    return F.when(F.coalesce(size, F.lit(0)) > 0, made).otherwise(F.array().cast("array<smallint>"))


def worklet(samples: Column, rate: int = INPUT_RATE, to: int = OUTPUT_RATE) -> Column:
    """The other variant: bucket ends are rounded half up, means are kept as 32-bit floats, a block under one
    bucket gives nothing, and a rate that is not lowered leaves the samples as they are."""
    if to >= rate:
        return F.coalesce(F.transform(samples, quantise), F.array().cast("array<smallint>"))
    ratio, size = rate / to, F.coalesce(F.size(samples), F.lit(0))
    edge = lambda i: F.least(size, F.floor(i * F.lit(ratio) + 0.5))
    means = _means(samples, F.floor(size / ratio), edge, lambda i: edge(i + 1))
    return F.transform(F.transform(means, lambda x: x.cast("float")), quantise)


def channel(channels: Column, i: int = 0) -> Column:
    """One channel of a block; null where it is missing."""
    return F.get(channels, F.lit(i))


def to_bytes(samples: Column) -> Column:
    """16-bit samples as bytes, the low byte first."""
    pair = lambda s: F.concat(F.lpad(F.hex(s.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(s.cast("int"), 8).bitwiseAND(255)), 2, "0"))
    return F.unhex(F.array_join(F.transform(samples, lambda s: pair(s.cast("int"))), ""))


def from_bytes(data: Column) -> Column:
    """Bytes as 16-bit samples; an odd last byte is dropped. Null where nothing is left, so that such chunks can be filtered."""

    def read(text: Column) -> Column:
        n = F.floor(F.length(text) / 4).cast("int")
        byte = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def sample(i: Column) -> Column:
            x = byte(i * 2) + byte(i * 2 + 1) * 256
            return F.when(x >= 32768, x - 65536).otherwise(x).cast("smallint")

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), sample))

    return F.transform(F.array(F.hex(data)), read)[0]  # the digits are made once, not for each sample
