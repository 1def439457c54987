"""Functions in Java, where a call of Python for each of very many small steps would take most of a job's time."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Made from plotwise/java by `javac` and `jar`, as the README says.
JAR = Path(__file__).resolve().parents[1] / "java" / "plotwise.jar"


def java_function(spark: SparkSession, name: str, kind: DataType) -> Callable[..., Column]:
    """A class of the jar as a function of columns; executors get the jar from the driver."""
    if not any(str(r[0]).endswith(f"/{JAR.name}") for r in spark.sql("LIST JARS").collect()):
        spark.sql(f"ADD JAR '{JAR}'")
    function = name.replace(".", "_")
    spark.udf.registerJavaFunction(function, name, kind)
    return lambda *columns: F.call_function(function, *columns)
