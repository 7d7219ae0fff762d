"""A bitmap of ids that tells most rows without them apart before a join shuffles their texts.

Its size does not depend on the number of ids: ``BITS`` bits, one for a hash of the id. A row whose bit is not
set surely has none of the ids; of the others the join decides. When very many ids set most bits, all rows
go to the join, as without a bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB, as 2,048 rows of 4 KB


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS)) + 1


def maybe_in(rows: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: FALSE where ``column`` is surely not among those of ``ids``."""
    bits = ids.select(_slot(column).alias("slot"))
    bits = bits.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")
    )
    place = F.bitmap_bit_position(_slot(column))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8 + 1).cast("int"))
    known = rows.withColumn("_bucket", F.bitmap_bucket_number(_slot(column)))
    known = known.join(F.broadcast(bits), "_bucket", "left")  # bounded, see BITS
    return known.withColumn(flag, F.coalesce(byte.bitwiseAND(power) != 0, F.lit(False))).drop("_bucket", "_bits")
