"""Readers for the driver's Parquet tables and the raw loan CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kreditflow.functions.features import nan_to_null

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting columns here makes the ReadSchema narrow."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


# Raw loan file schema (explicit: inference would cost a second pass).
RAW_LOAN_SCHEMA = T.StructType(
    [
        T.StructField("loan_amnt", T.DoubleType()),
        T.StructField("term", T.StringType()),
        T.StructField("int_rate", T.DoubleType()),
        T.StructField("installment", T.DoubleType()),
        T.StructField("grade", T.StringType()),
        T.StructField("sub_grade", T.StringType()),
        T.StructField("emp_title", T.StringType()),
        T.StructField("emp_length", T.StringType()),
        T.StructField("home_ownership", T.StringType()),
        T.StructField("annual_inc", T.DoubleType()),
        T.StructField("verification_status", T.StringType()),
        T.StructField("issue_d", T.StringType()),
        T.StructField("loan_status", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("dti", T.DoubleType()),
        T.StructField("earliest_cr_line", T.StringType()),
        T.StructField("open_acc", T.DoubleType()),
        T.StructField("pub_rec", T.DoubleType()),
        T.StructField("revol_bal", T.DoubleType()),
        T.StructField("revol_util", T.DoubleType()),
        T.StructField("total_acc", T.DoubleType()),
        T.StructField("initial_list_status", T.StringType()),
        T.StructField("application_type", T.StringType()),
        T.StructField("mort_acc", T.DoubleType()),
        T.StructField("pub_rec_bankruptcies", T.DoubleType()),
        T.StructField("address", T.StringType()),
    ]
)


# Schema of the derived loan table when stored as text.
LOAN_CSV_SCHEMA = T.StructType(
    [
        T.StructField("loan_id", T.LongType()),
        T.StructField("pool_id", T.IntegerType()),
        T.StructField("decided_at", T.TimestampNTZType()),
        T.StructField("loan_status", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("dti", T.DoubleType()),
        T.StructField("revol_util", T.DoubleType()),
        T.StructField("pub_rec", T.DoubleType()),
        T.StructField("annual_inc", T.DoubleType()),
        T.StructField("open_acc", T.DoubleType()),
        T.StructField("mort_acc", T.DoubleType()),
        T.StructField("revol_bal", T.DoubleType()),
        T.StructField("emp_length", T.StringType()),
        T.StructField("home_ownership", T.StringType()),
        T.StructField("issue_d", T.StringType()),
        T.StructField("earliest_cr_line", T.StringType()),
    ]
)


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_LOAN_SCHEMA) -> DataFrame:
    """SRC-01: raw loan CSV with a header and an explicit schema.

    Malformed numbers become NULL (PERMISSIVE), the same as a tolerant parse,
    and so does NaN, which aggregates would otherwise count as a value.
    """
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("nanValue", "NaN")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    return nan_to_null(raw, [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)])


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SRC-03: clean-table sink (overwrite; header when CSV)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
