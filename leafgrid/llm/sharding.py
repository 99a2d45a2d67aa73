"""Sharding: a keyed Feistel permutation of global row numbers, in native expressions.

Rows are numbered 0..n-1 in a fixed order, the number is permuted within 0..n-1, and
the permuted number gives shard (its remainder) and slot (its quotient). Anyone who
knows n and the key can compute where row k went and, by the inverse, which row
sits in a given slot, without the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 24
#: Rows are numbered bucket by bucket; the table of bucket sizes has this many rows at most.
BUCKETS = 4096
ROUNDS = 6
#: Steps of a walk. The domain exceeds n by less than its shorter side, so that a walk
#: this long has a chance below 2**-128 even for the least favourable n; it is checked.
WALK = 256
PRIME = 2_147_483_647


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0..n-1 over pairs (left < a, right < b) with a * b >= n."""

    n: int
    key: int = 20_240_601
    rounds: int = ROUNDS

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return a, max(1, -(-self.n // a))

    def _constants(self, r: int) -> tuple[int, int]:
        x = (self.key + 7_919 * (r + 1)) % PRIME
        x = x * x % PRIME
        return 1 + x % (PRIME - 1), (x * 48_271 + r) % PRIME

    def mix(self, x: int, r: int) -> int:
        c, k = self._constants(r)
        t = (x % PRIME * c + k) % PRIME
        t = (t * t + x % PRIME) % PRIME
        return (t * c + k) % PRIME

    def forward(self, x: int) -> int:
        """Where row number x goes."""
        while True:
            x = self._once(x, False)
            if x < self.n:
                return x

    def backward(self, y: int) -> int:
        """Which row number is at y."""
        while True:
            y = self._once(y, True)
            if y < self.n:
                return y

    def _once(self, x: int, back: bool) -> int:
        a, b = self.sides
        left, right = x % a, x // a
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * self.mix(left, r)) % b
            else:
                left = (left + sign * self.mix(right, r)) % a
        return right * a + left

    def _mix_column(self, x: Column, r: int) -> Column:
        c, k = (F.lit(v).cast("long") for v in self._constants(r))
        p = F.lit(PRIME).cast("long")
        t = (x % p * c + k) % p
        t = (t * t + x % p) % p
        return (t * c + k) % p

    def _once_column(self, x: Column) -> Column:
        a, b = (F.lit(v).cast("long") for v in self.sides)
        # x - x % a is a multiple of a, and exact as a double below 2**53 rows
        pair = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))
        for r in range(self.rounds):
            pair = F.get(F.transform(F.array(pair), self._round(r, a, b)), F.lit(0))
        return F.get(F.transform(F.array(pair), lambda s: s["r"] * a + s["l"]), F.lit(0))

    def _round(self, r: int, a: Column, b: Column):
        if r % 2:
            return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + self._mix_column(s["l"], r)) % b).alias("r"))
        return lambda s: F.struct(((s["l"] + self._mix_column(s["r"], r)) % a).alias("l"), s["r"].alias("r"))

    def column(self, x: Column) -> Column:
        """``forward`` as an expression: one step, then steps while the result is outside 0..n-1."""
        n = F.lit(self.n).cast("long")
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)), self._once_column(x), lambda at, _: F.when(at < n, at).otherwise(self._once_column(at))
        )
        return F.get(
            F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))),
            F.lit(0),
        )


def numbered(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """The rows with ``row_number`` 0..n-1 and n, by bucket of all order columns together, then the order.

    Only one row for each bucket is gathered, and windows hold one bucket, so that many rows of one
    or no first column spread over all. Rows that agree in every order column are interchangeable.
    """
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), "__n")
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    within = Window.partitionBy("__bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    out = (
        bucketed.join(F.broadcast(starts.drop("__n")), "__bucket")
        .withColumn("row_number", F.col("__start") + F.row_number().over(within) - 1)
        .drop("__bucket", "__start")
    )
    return out, total


def shard(docs: DataFrame, shards: int = SHARDS, key: int = Feistel.key) -> DataFrame:
    """Every document with its shard and slot by the law ``rows``.

    Shard sizes differ by one row at most, slots run from 0 without gaps, and the
    result depends on the rows, the key and the number of shards alone. A null text
    has size 8 and crc32 0; a null doc_id is a key like any other; repeated rows
    keep a slot each; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("__at", Feistel(max(n, 1), key).column(F.col("row_number")))
    k = F.lit(shards).cast("long")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("__at") % k).cast("int").alias("shard"),
        F.expr(f"__at div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
