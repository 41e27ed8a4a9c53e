"""Tables that cut a lineage: written to the folder all executors share, read again from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.session import new_path


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """The table, computed once and kept below ``spark.checkpoint.dir``; a lost executor costs nothing that was written.

    ``narrow`` is for tables of a few numbers per row that come out of a shuffle: neighbouring partitions are written together, an eighth
    of the shuffle partitions or four per core at least, because such a table would be more files than data.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if narrow:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing will read again."""
    spark: SparkSession = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
