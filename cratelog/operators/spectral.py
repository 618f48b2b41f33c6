"""Spectral masking between the stems of a section, and the corrections planned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import let


def scaled(spectrum: Column) -> Column:
    """A magnitude spectrum over its maximum."""
    top = F.array_max(spectrum)
    return let(top, lambda m: F.transform(spectrum, lambda v: v / (m + 1e-6)))


def clash(target: Column, other: Column) -> Column:
    """Struct of bin and strength: of the bins that clash, the one where the other stem is loudest (first if equal), or null.

    Bins clash where the other stem is over 0.3 and the target over 0.2.
    """
    each = F.zip_with(target, other, lambda t, o: F.when((o > 0.3) & (t > 0.2), o).otherwise(0.0))

    def strongest(v: Column) -> Column:
        top = F.array_max(v)
        return F.when(top > 0, F.struct((F.array_position(v, top) - 1).cast("int").alias("bin"), top.alias("strength")))

    return let(each, strongest)


def masking_pairs(stems: DataFrame, section: str = "section") -> DataFrame:
    """(section, stem, other, bin, strength) for stems that one of higher priority in the section masks.

    stems: section, stem, priority, spectrum. Sections hold a few stems, so the pairs stay few.
    """
    a = stems.select(section, "stem", "priority", scaled(F.col("spectrum")).alias("spectrum"))
    b = a.select(section, F.col("stem").alias("other"), F.col("priority").alias("other_priority"), F.col("spectrum").alias("other_spectrum"))
    pairs = a.join(b, section).where(F.col("other_priority") > F.col("priority"))
    return pairs.withColumn("c", clash(F.col("spectrum"), F.col("other_spectrum"))).where("c IS NOT NULL").select(section, "stem", "other", "c.bin", "c.strength")


def eq_plan(stems: DataFrame, pairs: DataFrame, bin_hz: float, section: str = "section") -> DataFrame:
    """Filters: a high-pass at 100 Hz unless the role is low, and a -3 dB dip for each masking stem (20 Hz to 20 kHz).

    A bass stem is not dipped under 150 Hz.
    """
    high = stems.where(~F.col("role").isin("bass", "sub", "kick", "drums")).select(section, "stem", F.lit("highpass").alias("filter"), F.lit(100.0).alias("hz"), F.lit(0.0).alias("gain_db"))
    dips = pairs.join(stems.select(section, "stem", "role"), [section, "stem"]).withColumn("hz", F.col("bin") * F.lit(bin_hz))
    dips = dips.where(F.col("hz").between(20.0, 20000.0) & ~((F.col("role") == "bass") & (F.col("hz") < 150.0)))
    return high.unionByName(dips.select(section, "stem", F.lit("peak").alias("filter"), "hz", F.lit(-3.0).alias("gain_db")))
