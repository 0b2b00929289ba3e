import pytest
from pyspark.sql import functions as F

from modloom.checks import require
from modloom.domains import UNIFIED_SCHEMA
from modloom.operators.schema import enforce_schema, validate_schema


def rows(spark, *uids, label=0):
    data = [(u, "jigsaw", "text", label, "neither", "train", 1) for u in uids]
    return spark.createDataFrame(
        data,
        "uid string, source string, text string, label int, label_name string, split string, extra int",
    )


def test_columns_types_and_nulls(spark):
    df = enforce_schema(rows(spark, "a"))
    assert len(UNIFIED_SCHEMA.names) == 37 and df.columns == UNIFIED_SCHEMA.names
    kinds = dict(df.dtypes)
    assert (kinds["label"], kinds["dup_group_size"], kinds["m_n_annotators"]) == (
        "tinyint", "bigint", "bigint"
    )
    assert (kinds["m_insult"], kinds["t_age"], kinds["j_toxic"]) == ("float", "boolean", "tinyint")
    assert df.first().j_toxic is None


def test_validation(spark):
    require(validate_schema(enforce_schema(rows(spark, "a", "b"))), "schema")
    with pytest.raises(ValueError, match="repeated_uid_rows"):
        require(validate_schema(enforce_schema(rows(spark, "a", "a"))), "schema")
    with pytest.raises(ValueError, match="null_label"):
        require(validate_schema(enforce_schema(rows(spark, "a").drop("label"))), "schema")
    with pytest.raises(ValueError):
        validate_schema(rows(spark, "a"))
    broken = enforce_schema(rows(spark, "a")).withColumn("uid", F.lit(None).cast("string"))
    assert validate_schema(broken).first().null_uid == 1
