"""Join building blocks.

* ``skew_left_join`` salts hot keys: of the side that a left join does not
  preserve, which AQE cannot split, and of the preserved one where it is counted;
* ``keep_keys`` and ``semi_join_small`` broadcast only relations with a
  LIMIT-proven size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Session setting for the number of equal shares of a side's rows above one of
#: which a key is hot; unset, the number of shuffle partitions.
SHARES = "spark.stagelight.skewJoin.shares"
#: Buckets for each equal share of rows that a hot key holds: small ones, so that
#: those which meet in a task beside other keys stay well below another share.
BUCKETS = 4


def shares_of(df: DataFrame) -> int:
    conf = df.sparkSession.conf
    return int(conf.get(SHARES, None) or conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, shares: int) -> DataFrame:
    """Of ``counts`` (_hk, _rows) the keys with more rows than an equal share,
    with the number of shares they hold, rounded up (_fan). Fewer than ``shares``
    keys can each hold more than one share, so the result has a proven bound."""
    total = counts.agg(F.sum("_rows")).scalar()
    held = F.col("_rows") * F.lit(shares) / total
    return counts.where(held > 1).select("_hk", F.ceil(held).cast("int").alias("_fan"))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(_hk, _rows) of the non-null keys."""
    return (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hk"))
              .agg(F.count(F.lit(1)).alias("_rows")))


def _bucket(cols: list[Column], fan: Column) -> Column:
    """Deterministic bucket in [0, fan) from a hash of ``cols``; 0 when no fan."""
    return F.when(fan.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*cols), fan).cast("int"))


def hot_fans(shares: int, **sources: tuple[DataFrame, str]) -> DataFrame:
    """The keys that are hot in any of the named (rows, key) sources, broadcast: _hk
    and for each source _fan_<name>, its number of buckets, null where it is not hot
    there. All sources are counted in one aggregation; per source fewer than
    ``shares`` keys can be hot, so the table has a proven bound."""
    keyed = {name: df.where(F.col(key).isNotNull()) for name, (df, key) in sources.items()}
    counted = [keyed[name].select(
        F.col(key).alias("_hk"), *[F.lit(int(other == name)).cast("bigint").alias(other) for other in sources])
        for name, (_, key) in sources.items()]
    counts = reduce(DataFrame.unionByName, counted).groupBy("_hk").agg(*[F.sum(name).alias(name) for name in sources])
    fans = []
    for name, df in keyed.items():
        held = F.col(name) * F.lit(shares) / F.greatest(df.agg(F.count(F.lit(1))).scalar(), F.lit(1))
        fans.append(F.ceil(F.nullif(F.greatest(held, F.lit(1)), F.lit(1))).cast("int") * BUCKETS)
    table = counts.select("_hk", *[fan.alias(f"_fan_{name}") for name, fan in zip(sources, fans)])
    return F.broadcast(table.dropna("all", subset=[f"_fan_{name}" for name in sources]))


def _tag(df: DataFrame, key: str, fans: DataFrame, **fan: str) -> DataFrame:
    """``df`` with the fans of its row's key under the given names."""
    few = fans.select("_hk", *[F.col(f"_fan_{source}").alias(name) for name, source in fan.items()])
    return df.join(few, df[key] == few["_hk"], "left").drop("_hk")


def _copies(fan: str) -> Column:
    """Every bucket of a hot key; the one bucket of any other."""
    return F.explode(F.when(F.col(fan).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(fan) - 1)))


def skew_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   fans: DataFrame | None = None, right_fan: str = "right", left_fan: str | None = None,
                   salt_cols: list[str] | None = None, left_salt: list[str] | None = None) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key`` that stays balanced when
    one key holds a large share of the right side, of the left side, or of both.

    1. ``fans`` (see ``hot_fans``) names the hot keys of the inputs that can make a
       side hot, ``right_fan`` and ``left_fan`` which of its sources are this join's;
       each row of such a source must give a row of that side at least. Without
       it the right side's own rows are counted. Joins on one key share one table.
    2. Both sides are tagged map-side. A hot key's rows get a bucket on their own
       side by a hash of ``salt_cols`` or ``left_salt`` (default: all columns; rows
       of equal values share a bucket), and are repeated for each bucket of the
       other side. With ``left_fan``, left rows without a key, which meet nothing,
       are dealt to all tasks.
    3. One shuffle join on (key, right bucket, left bucket). A left row that meets
       an empty right bucket of a hot key gives a null-extended row, which is
       removed; the result is exactly the plain left join.
    """
    shares = shares_of(right)
    r_cols, l_cols = right.columns, left.columns
    if fans is None:
        fans = hot_fans(shares, right=(right, right_key))
    own = {"_fan": right_fan} | ({"_lfan": left_fan} if left_fan else {})
    left = _tag(left, left_key, fans, **own).withColumn("_lbucket", _copies("_fan"))
    right = _tag(right, right_key, fans, **own)
    right = right.withColumn("_rbucket", _bucket([F.col(f"`{c}`") for c in (salt_cols or r_cols)], F.col("_fan"))).drop("_fan")
    on = [("_lbucket", "_rbucket")]
    if left_fan:
        salt = [F.col(f"`{c}`") for c in (left_salt or l_cols)]
        spread = F.when(F.col(left_key).isNull(), F.pmod(F.xxhash64(*salt), F.lit(BUCKETS * shares)).cast("int"))
        left = left.withColumn("_lslot", F.coalesce(spread, _bucket(salt, F.col("_lfan")))).drop("_lfan")
        right = right.withColumn("_rslot", _copies("_lfan")).drop("_lfan")
        on.append(("_lslot", "_rslot"))
    right = right.withColumn("_hit", F.lit(True))
    match = left[left_key] == right[right_key]
    for a, b in on:
        match = match & (left[a] == right[b])
    joined = left.join(right, match, "left")
    spurious = F.col("_fan").isNotNull() & F.col("_hit").isNull()
    return joined.where(~spurious).drop("_fan", "_hit", *[c for pair in on for c in pair])


def look_up(rows: DataFrame, per_key: DataFrame, key: str, weight: str, spread: list[str]) -> DataFrame:
    """``rows LEFT JOIN per_key`` on ``key`` where ``per_key`` is an aggregate with
    one row for each key and ``weight``, its number of ``rows``. AQE does not split
    ``rows`` against an aggregate, so the entries of hot keys (bounded, see
    ``hot_keys``) are broadcast, and their rows and those without a key are spread
    over all tasks by a hash of ``spread`` instead of meeting in one."""
    shares = shares_of(rows)
    total = per_key.agg(F.sum(weight)).scalar()
    values = [c for c in per_key.columns if c not in (key, weight)]
    hot = per_key.where(F.col(weight) * F.lit(shares) > total)
    hot = F.broadcast(hot.select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot")))
    tagged = rows.join(hot, rows[key] == hot["_hk"], "left").drop("_hk")
    away = F.col("_hot").isNotNull() | F.col(key).isNull()
    tagged = tagged.withColumn("_spread", F.when(away, 1 + F.pmod(F.xxhash64(*spread), F.lit(4 * shares))).otherwise(F.lit(0)))
    cold = per_key.select(key, F.lit(0).cast("long").alias("_spread"), F.struct(*values).alias("_cold"))
    found = tagged.join(cold, [key, "_spread"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_found.{c}").alias(c) for c in values])


def keep_keys(df: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` appears in ``small`` (a relation with unique
    keys and a proven small bound, broadcast).

    Written as an inner join rather than a semi join on purpose: Catalyst
    pushes a semi join below an aggregate it sits on, which makes the
    aggregate differ from its other uses in the same plan, so the shuffle is
    no longer reused and the input is computed twice.
    """
    return df.join(F.broadcast(small.select(on)), on=on, how="inner")


def semi_join_small(df: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """``df`` rows whose key appears in ``small``; ``small`` must have a proven
    small bound (a LIMIT, a fixed list) because it is broadcast."""
    return df.join(F.broadcast(small), on=on, how="left_semi")
