"""CSV files whose delimiter and header are told from their first line, and the folder they are uploaded to.

Rules: the delimiter is ; if the first line holds one, else a comma. The first row is a header if either of its first two cells, stripped, is of letters only. Cells are
matched by position; rows with another number of cells are skipped; cells are stripped of white space, then of " and of '. A cell that its column's type does not take
fails the load. An empty file has no rows. A cell holds no line break, so that a large file is read in parallel.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.kernels import truncate_bytes


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, str, int]]) -> DataFrame:
    """columns: (name, kind, bytes) with kind int, float or char. The columns, and _order, which rises with the place in the file."""
    first = spark.read.text(path).limit(1).collect()
    delimiter = ";" if first and ";" in first[0][0] else ","
    names = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "broken"]])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "emptyValue": "", "nullValue": "\x00"}
    lines = spark.read.csv(path, schema=schema, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).withColumn("_order", F.monotonically_increasing_id())
    kept = lines.where("broken IS NULL")  # elsewhere: rows with another number of cells

    def cell(i: int):
        return F.btrim(F.btrim(F.btrim(F.col(names[i]), F.lit(" \t\r\n")), F.lit('"')), F.lit("'"))

    head = lines.limit(1).collect()
    if head and any((head[0][n] or "").strip().isalpha() for n in names[:2]):
        kept = kept.where(F.col("_order") > head[0]["_order"])

    def typed(i: int, name: str, kind: str, size: int):
        c = cell(i)
        return (c.cast("int") if kind == "int" else c.cast("float") if kind == "float" else truncate_bytes(c, size)).alias(name)

    return kept.select("_order", *(typed(i, *c) for i, c in enumerate(columns)))


class Uploads:
    """The folder of CSV files that FROM FILE reads."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def listed(self, any_case: bool = False) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if (p.name.lower() if any_case else p.name).endswith(".csv"))

    def save(self, name: str, content: bytes) -> Path:
        clean = name.replace("\\", "/").rpartition("/")[2]
        if not clean.endswith(".csv"):
            raise ValueError("only .csv files are taken")
        path = self.folder / clean
        path.write_bytes(content)
        return path

    def find(self, name: str) -> Path | None:
        path = self.folder / name.replace("\\", "/").rpartition("/")[2]
        return path if path.is_file() else None

    def delete(self, name: str) -> bool:
        path = self.find(name)
        if path:
            path.unlink()
        return bool(path)
