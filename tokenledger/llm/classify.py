"""What the text classifiers share: bounded training samples and folds by crc32."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def sample(df: DataFrame, rows: int, chars: int, seed: int, labels: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """One row for each of at most rows doc_ids, those of the smallest hash: the same at every run.

    With labels (one row a doc_id), only their ids are drawn and their columns
    added. Only ids and lengths are ranked and joined; texts are fetched for
    the chosen ids alone. The sample ends where its texts exceed chars
    characters in all, and passes over texts of more than a twentieth of that.
    Of rows of one doc_id the least counts; rows without doc_id are not drawn.
    With by, rows and chars hold for each value of that column, and a doc_id
    counts once for each of its values. A value's ids are ranked only up to the
    hash under which some 2 * rows + 64 of them are expected (all, if it has no
    more), so no task ranks a frequent value's ids; that fewer than rows lie
    there has a chance of less than 1e-20.
    """
    key = ["doc_id", *([by] if by else [])]
    size = F.coalesce(F.length("text"), F.lit(0))
    fit = df.where(F.col("doc_id").isNotNull() & (size <= chars // 20))
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    ids = fit.select(*key, size.alias("size")).groupBy(*key).agg(F.max("size").alias("size"))
    ids = ids if labels is None else ids.join(labels, "doc_id")
    place = Window.partitionBy(by).orderBy(*order) if by else Window.orderBy(*order)
    if by:
        many = ids.groupBy(F.col(by).alias("of")).agg((F.lit(2.0 * rows + 64) / F.count("*")).alias("share"))
        ids = ids.join(many, ids[by].eqNullSafe(many["of"])).where(order[0] / F.lit(2.0**64) + 0.5 <= F.col("share")).select(*ids.columns)
    ids = ids.withColumn("place", F.row_number().over(place)).where(F.col("place") <= rows).drop("place") if by else ids.orderBy(*order).limit(rows)
    ids = ids.withColumn("all", F.sum("size").over(place)).where(F.col("all") <= chars).drop("size", "all")
    chosen = fit.join(F.broadcast(ids), key)
    rest = [c for c in chosen.columns if c not in key]
    least = chosen.groupBy(*key).agg(F.min(F.struct(*rest)).alias("row"))
    return least.select(*key, *[F.col("row").getField(c).alias(c) for c in rest]).orderBy(*order, *key[1:])
