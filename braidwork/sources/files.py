"""CSV and JSON at the edges."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocking import Refused


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Typed by an explicit schema; blank is null, a bad value of a typed column too."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE")


def _reads(spark: SparkSession, path: str, df: DataFrame, encoding: str) -> bool:
    """Whether a file is of an encoding: all its bytes for UTF-8, no bad character in the head for others."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return not spark.read.text(path).where(~F.is_valid_utf8("value")).head(1)
    head = df.limit(1000)
    bad = head.where(F.exists(F.array(*[F.col(f"`{c}`") for c in df.columns]), lambda v: F.contains(v, F.lit("\ufffd"))))
    return not bad.head(1)


def read_csv_text(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"), line_end: str | None = None) -> DataFrame:
    """All columns as text, blank as an empty string; by the first encoding that the file is of, else the last.

    Without ``line_end`` it is found from the beginning of the file, where line ends inside of texts count too.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "inferSchema": False}
    if line_end:
        options["lineSep"] = line_end
    df = None
    for encoding in encodings:
        df = spark.read.csv(path, encoding=encoding, **options)
        if _reads(spark, path, df, encoding):
            break
    names = [c.removeprefix("\ufeff") for c in df.columns]
    return df.toDF(*names).na.fill("")


def read_labels(spark: SparkSession, path: str, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Label pairs; ids stay text even where they look like numbers."""
    df = read_csv_text(spark, path)
    if missing := {left, right} - set(df.columns):
        raise Refused(f"{path} lacks {sorted(missing)}")
    return df.select(F.col(left).alias("left_id"), F.col(right).alias("right_id")).distinct()


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header and lines that end in LF; blanks around a text stay. ``one_file`` only for results of known size."""
    options = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, **options)


def plain(value):
    """A metric as JSON knows it; refuses other types."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        return plain(value.item())
    raise Refused(f"{type(value).__name__} can't be recorded")


def recorded(run: dict) -> str:
    """A run as text: sorted, without times, so that an unchanged run gives an unchanged file."""
    return json.dumps(plain(run), indent=2, sort_keys=True) + "\n"


def read_run(text: str, names: Sequence[str], at: str = "rows") -> dict:
    run = json.loads(text)
    if set(run[at]) != set(names):
        raise Refused(f"recorded {sorted(run[at])}, expected {sorted(names)}")
    return run
