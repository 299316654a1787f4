"""Column expressions over whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from newsloom.plans.staging import stage

#: ASCII white space, as java.util.regex and RE2 both read it.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The text's words in order; an empty array for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(seed: str, *key: Column) -> Column:
    """A uniform number in [0, 1) that depends on seed and key alone: 52 bits of an MD5 digest."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in key]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of the caller's meets one made here; maps as sorted entries."""
    return F.struct(*[(F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")).alias(f.name) for f in docs.schema.fields])


def unpacked(docs: DataFrame, row: str) -> list[Column]:
    """The columns of docs again, from a column made by `packed`."""
    field = lambda f: F.col(row).getField(f.name)
    return [(F.map_from_entries(field(f)) if isinstance(f.dataType, MapType) else field(f)).alias(f.name) for f in docs.schema.fields]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for docs not to have them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Copies of one row that one task writes in a go.
COPIES_AT_ONCE = 10_000


def numbered_copies(rows: DataFrame, name: str) -> DataFrame:
    """rows (columns of their own names, no maps) with `copy`: equal rows are numbered from 1, whatever the order.

    Equal rows are counted, with partial counts before the shuffle, and written out again; groups of many are dealt
    to several tasks.
    """
    counted = stage(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")), name)
    single = counted.where("__n = 1").select(*rows.columns, F.lit(1).cast("long").alias("copy"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES_AT_ONCE}")))
    many = counted.where("__n > 1").withColumn("__part", parts).repartition(*rows.columns, "__part")
    first = F.col("__part") * COPIES_AT_ONCE + 1
    last = F.least(first + COPIES_AT_ONCE - 1, F.col("__n"))
    return single.unionByName(many.select(*rows.columns, F.explode(F.sequence(first, last)).alias("copy")))
