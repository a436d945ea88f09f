"""python tests/compare_all.py SF_DIR [NAME...]: each query beside its SQL, one line each."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    connection, sql = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if name in names or not names and name in sql:
            began = time.time()
            try:
                said = compare(query(spark, folder), sql[name], connection) or "same"
            except Exception as error:
                said = f"{type(error).__name__}: {str(error)[:500]}"
            print(f"{name}: {time.time() - began:.1f} s: {said[:700]}", flush=True)
