"""Equi-joins that hold when one key owns a large share of the left rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.plans.staging import stage

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
SALTS = 32
# Into how many parts of equal size the left rows are thought to be cut: a key with
# more rows than one part is hot and gets a salt per part.
PARTS = 1000


def measured_bytes(table: DataFrame) -> int:
    """Size of a lookup table, measured by one aggregate (one row comes back)."""
    per_row = F.lit(ROW_OVERHEAD_BYTES)
    for field in table.schema.fields:
        per_row = per_row + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    return table.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("b")).first()["b"]


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str],
    how: str = "inner", salts: int = SALTS, heat: str | None = None, parts: int = PARTS,
) -> DataFrame:
    """Shuffle join that splits hot left keys over several tasks; exact for any skew.

    ``right`` is unique per key.  If its column ``heat`` says how many left rows each
    key has, a key with more than 1/``parts`` of them is salted and copied as often as
    its share asks for, so no (key, salt) has many more than 1/``parts`` of the left
    rows.  Fewer than ``parts`` keys can be that hot, which bounds what is broadcast.
    ``right`` is read four times in that case, so it should be a written table.
    Without ``heat`` every key is spread over ``salts`` tasks.

    The hint keeps Catalyst from broadcasting a side whose size it underestimates.
    Both sides are sorted, which spills; a hashed side would have to fit in memory.
    """
    mixed = F.xxhash64(*spread_by)
    if heat is None:
        spread = left.withColumn("_salt", F.pmod(mixed, F.lit(salts)).cast("int"))
        copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        part = (right.agg(F.sum(heat)).first()[0] or 0) / parts
        # the list holds hashes, so its size does not depend on the length of the keys
        key = F.xxhash64(*on)
        shares = F.ceil(F.max(heat) / F.lit(max(part, 1.0))).cast("int").alias("_salts")
        hot = F.broadcast(
            right.filter(F.col(heat) > part).groupBy(key.alias("_key")).agg(shares))
        own = F.coalesce("_salts", F.lit(1))
        spread = (
            left.withColumn("_key", key).join(hot, "_key", "left")
            .withColumn("_salt", F.pmod(mixed, own).cast("int"))
            .drop("_salts", "_key")
        )
        copies = (
            right.withColumn("_key", key).join(hot, "_key", "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1)))
            .drop("_salts", "_key")
        )
    return spread.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str],
) -> DataFrame:
    """Inner join: broadcast ``right`` when its measured size allows it, else salts by share."""
    if measured_bytes(right) <= BROADCAST_LIMIT_BYTES:
        return left.join(F.broadcast(right), on)
    return on_demand_join(stage(left, "lookups"), stage(right, "lookup-table"), on, spread_by)


def on_demand_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], parts: int = PARTS,
) -> DataFrame:
    """Inner join of a skewed ``left`` with a large ``right`` unique per key.

    A key with more than 1/``parts`` of the left rows is salted, and its right row copied,
    as often as its share asks for; other keys are joined as they are.  Fewer than ``parts``
    keys can be that hot, which bounds the list that is broadcast.  ``left`` is read twice,
    so it should be a written table.
    """
    counts = stage(left.groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    part = max((counts.agg(F.sum("_n")).first()[0] or 0) / parts, 1.0)
    key = F.xxhash64(*on)
    hot = F.broadcast(stage(
        counts.filter(F.col("_n") > part).groupBy(key.alias("_key"))
        .agg(F.ceil(F.max("_n") / F.lit(part)).cast("int").alias("_salts")), "hot-keys"))
    own = F.coalesce("_salts", F.lit(1))
    spread = (
        left.withColumn("_key", key).join(hot, "_key", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), own).cast("int")).drop("_salts", "_key")
    )
    copies = (
        right.withColumn("_key", key).join(hot, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("_salts", "_key")
    )
    return spread.join(copies.hint("merge"), [*on, "_salt"]).drop("_salt")


# A bitmap of this many bits and more per wanted key lets 1/BITS_PER_KEY of the others pass.
BITS_PER_KEY = 32
# Bits of a bitmap's row, which Spark's bitmap functions fix.
_ROW_BITS = 1 << 15
# At most 64 MB of bitmaps; beyond 16 million keys more of the other rows pass.
MOST_BITS = 1 << 29


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bitmaps(wanted: DataFrame, key: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(table ``bucket, bitmap``, bits in all): a one-hash Bloom filter of a column's values.

    The number of bits follows the number of keys up to ``most_bits``, so the table has a
    proven size.  Places, not bitmaps, are shuffled: 8 bytes a key.
    """
    n = wanted.agg(F.approx_count_distinct(key)).first()[0]
    bits = min(most_bits, max(_ROW_BITS, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
    place = wanted.filter(F.col(key).isNotNull()).select(_place(key, bits).alias("place"))
    dealt = place.select(F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    bitmaps = dealt.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return stage(bitmaps, "bitmaps"), bits


def keep_wanted(rows: DataFrame, key: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``key`` may be wanted: all wanted ones and a few others.

    Runs in the scan's own stage: wide rows are never shuffled.  What comes out of the rows
    later is narrow and meets the wanted keys in an exact join.
    """
    place = _place(key, bits)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = rows.join(
        F.broadcast(bitmaps.withColumnRenamed("bitmap", "_bitmap").withColumnRenamed("bucket", "_bucket")),
        F.bitmap_bucket_number(place) == F.col("_bucket"))
    return found.filter(is_set).select(*rows.columns)
