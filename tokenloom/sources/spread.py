"""Small inputs on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, in as many partitions as there are cores if its files give fewer.

    A file of one row group is one task however long its texts are to work on.
    Only a table of fewer splits than cores is moved, so a large one never is.
    scan must be a plain read: counting the partitions of other frames would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
