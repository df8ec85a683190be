"""Table functions for SQL: an ordered partition goes in row by row, finished windows come out.

    SELECT * FROM count_windows(TABLE(rows) PARTITION BY (series_id, block) ORDER BY (idx), 336)

One partition is one ordered pass in one task, whatever its size in constant memory (the rows of one window). A series
with a third of all rows therefore should not be one partition: ``numbered`` adds a ``block`` that cuts a
series at window borders, so its blocks spread over tasks and every window lies in one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from tidemark.operators.segment import dense_index

BLOCK_WINDOWS = 64
NEEDED = {"series_id": T.StringType(), "idx": T.LongType(), "ts": T.TimestampType(), "value": T.DoubleType()}


@udtf
class CountWindows:
    """Windows of ``length`` consecutive rows: no or one row out for each row in. A tail shorter than a window yields nothing.

    A gap in ``idx`` drops the window begun, so a window never joins rows that are not neighbours; a null value stays one.
    """

    def __init__(self):
        self.values: list[float | None] = []
        self.first, self.next = None, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("count_windows takes TABLE(rows) first")
        got = {f.name: f.dataType for f in rows.dataType.fields}
        wrong = [f"{name} {kind.simpleString()}" for name, kind in NEEDED.items() if got.get(name) != kind]
        if wrong:
            raise ValueError(f"count_windows needs {', '.join(wrong)}")
        if not length.isConstantExpression or not isinstance(length.value, int) or length.value < 1:
            raise ValueError("count_windows takes a window length of 1 or more second")
        schema = T.StructType().add("series_id", "string").add("window_id", "long").add("start_ts", "timestamp").add("end_ts", "timestamp")
        return AnalyzeResult(schema=schema.add("values", T.ArrayType(T.DoubleType())))

    def eval(self, row, length):
        if row["idx"] != self.next:
            self.values = []
        self.next = row["idx"] + 1
        if not self.values:
            if row["idx"] % length:
                return
            self.first = row["ts"]
        self.values.append(row["value"])
        if len(self.values) == length:
            done, self.values = self.values, []
            yield row["series_id"], row["idx"] // length, self.first, row["ts"], done


def register(spark: SparkSession) -> None:
    spark.udtf.register("count_windows", CountWindows)


def numbered(rows: DataFrame, order: list[str], length: int) -> DataFrame:
    """``series_id, idx, ts, value, block`` of rows with a series, in ``order`` within their series."""
    dense = dense_index(rows.filter("series_id IS NOT NULL"), order)
    block = F.floor(F.col("idx") / (BLOCK_WINDOWS * length))
    return dense.select("series_id", F.col("idx").cast("long").alias("idx"), "ts", F.col("value").cast("double").alias("value"), block.alias("block"))
