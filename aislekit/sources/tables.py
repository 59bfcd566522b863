"""Driver tables (parquet) and the catalogue CSV source."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# pandas' default NA strings (read_csv), mapped to NULL after the scan; fixed values.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   encoding: str = "UTF-8") -> DataFrame:
    """Header CSV, comma separated; pandas NA strings become NULL in string columns."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", False)
    df = reader.csv(path)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(PANDAS_NA), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
