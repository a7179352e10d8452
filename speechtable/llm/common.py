"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    It cuts lineage, and a lost executor costs no more than the tasks that it ran. Rows are computed once, where
    DataFrame.checkpoint() computes its last stage twice.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter. Pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def let(value: Column, use) -> Column:
    """use(value), with value computed once, also where use has it inside a function over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns computed in one place.

    The optimizer moves a filter below the projection that makes its column and repeats the whole expression there, as
    often as it is used; it doesn't move it below a generator.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode_outer(F.array(F.struct(*columns))).alias("_once")).select(*others, *(F.col(f"_once.{c}").alias(c) for c in columns))


#: keys with more than this share of all rows are hot: fewer than so many keys; and bytes of their rows that are broadcast
HOT, HOT_BYTES = 4096, 16_000_000


def with_key(rows: DataFrame, own: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows left-joined with own (a row a key), where a few keys may hold most of the rows. counts: key, n (its rows).

    Keys with over 1/HOT of all rows number fewer than HOT. If their rows of own are at most HOT_BYTES, these are broadcast, and
    rows with such a key stay where they are; else they are dealt out by salts. The others are joined as Spark likes; none of
    their keys has more than 1/HOT of the rows.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = written(counts.filter(F.col("n") > total / HOT).select(key).join(own, key, "left"), "hot")
    if (hot.agg(F.sum(F.octet_length(F.to_json(F.struct(*hot.columns))))).first()[0] or 0) > HOT_BYTES:
        return _salted(rows, own, key, hot)
    light = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(own, key, "left")
    return light.unionByName(rows.join(F.broadcast(hot), key))


def _salted(rows: DataFrame, own: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The same with hashes of the hot keys (eight bytes each) to tell their rows from the others; these are dealt out over as
    many salts as there are shuffle partitions, and their rows of own are repeated for each."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = F.broadcast(hot.select(F.xxhash64(key).alias("_hash")).distinct())
    marked = lambda df: df.withColumn("_hash", F.xxhash64(key))
    light = marked(rows).join(hashes, "_hash", "left_anti").drop("_hash").join(own, key, "left")
    dealt = marked(rows).join(hashes, "_hash", "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    each = marked(own).join(hashes, "_hash", "left_semi").drop("_hash").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return light.unionByName(dealt.drop("_hash").join(each, [key, "_salt"], "left").drop("_salt"))
