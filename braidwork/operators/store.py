"""Records are kept, decisions can always be made again: record, entity and record_entity as Parquet.

Each table is a folder of versions and a pointer that names the current one, so a reader sees one whole
version and a failed write leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import number, spaced_key, text_or_null
from .blocking import Refused

STORED = ("title", "category", "upc", "price", "rating", "source_url", "description")
RECORD = T.StructType([
    T.StructField("record_id", T.LongType(), False), T.StructField("source", T.StringType(), False),
    T.StructField("external_id", T.StringType(), False), T.StructField("title", T.StringType(), False),
    T.StructField("category", T.StringType()), T.StructField("upc", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("rating", T.IntegerType()), T.StructField("source_url", T.StringType()), T.StructField("description", T.StringType()),
])
ENTITY = T.StructType([T.StructField("entity_id", T.LongType(), False), T.StructField("label", T.StringType(), False)])
RECORD_ENTITY = T.StructType([T.StructField("record_id", T.LongType(), False), T.StructField("entity_id", T.LongType(), False)])
SCHEMAS = {"record": RECORD, "entity": ENTITY, "record_entity": RECORD_ENTITY}


def check_schema(df: DataFrame, schema: T.StructType, name: str) -> None:
    missing, extra = sorted(set(schema.names) - set(df.columns)), sorted(set(df.columns) - set(schema.names))
    if missing or extra:
        raise Refused(f"{name} has another schema: missing {missing}, extra {extra}")


def choose_key(frame: DataFrame, column: str | None) -> DataFrame:
    """Adds ``external_id``: the declared column if it has no blank and no repeated value, else ``row-<i>``.

    The fallback numbers rows as read and holds only for this order of the input.
    """
    if column in frame.columns:
        value = F.trim(F.col(column).cast("string"))
        row = frame.agg(
            F.count("*").alias("n"), F.count_if(F.coalesce(value, F.lit("")) == "").alias("blank"), F.count_distinct(value).alias("d")
        ).first()
        if not row["blank"] and row["n"] == row["d"]:
            return frame.withColumn("external_id", value)
    from .entities import dense_numbers

    rows = dense_numbers(frame.withColumn("_i", F.monotonically_increasing_id()), "_i", "_k")
    return rows.withColumn("external_id", F.concat(F.lit("row-"), (F.col("_k") - 1).cast("string"))).drop("_i", "_k")


def offered(frame: DataFrame, source: str, mapping: dict[str, str], key: str | None) -> DataFrame:
    """A source's rows in the stored columns; blanks and bad numbers are null, a missing title refuses."""
    back = {to: c for c, to in mapping.items() if c in frame.columns}
    if "title" not in back:
        raise Refused(f"{source} has no title: nothing to match on")
    rows = choose_key(frame, key)
    value = lambda c: (
        F.lit(None) if c not in back
        else number(F.col(back[c]).cast("string"), "int" if c == "rating" else "double") if c in ("price", "rating")
        else text_or_null(F.col(back[c]).cast("string"))
    )
    out = rows.select(F.lit(source).alias("source"), "external_id", *[value(c).cast(RECORD[c].dataType).alias(c) for c in STORED])
    if out.where("title is null").head(1):
        raise Refused(f"{source} has a row without a title")
    return out


def upsert(record: DataFrame, new: DataFrame) -> DataFrame:
    """``record`` with new rows by (source, external_id): known ones keep their record_id and any value that
    the new row lacks, others get the next numbers in the order of their keys."""
    from .entities import dense_numbers

    keys = ["source", "external_id"]
    fresh = new.join(record.select(*keys), keys, "left_anti")
    top = record.agg(F.coalesce(F.max("record_id"), F.lit(0)).alias("_top"))
    order = F.struct(*keys)
    numbered = dense_numbers(fresh.withColumn("_key", order), "_key", "_k").join(F.broadcast(top))
    added = numbered.select((F.col("_k") + F.col("_top")).alias("record_id"), *keys, *STORED)
    changed = record.alias("o").join(new.alias("n"), keys, "left").select(
        "record_id", *keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in STORED]
    )
    return changed.unionByName(added)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A keyed merge of two tables with equal columns: a new value replaces an old one unless it is null."""
    rest = [c for c in old.columns if c not in keys]
    return old.alias("o").join(new.alias("n"), list(keys), "full_outer").select(
        *keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest]
    )


class Store:
    """The three tables in a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.folder}/{name}")
        if not fs.exists(p):
            return None
        marks = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("current-")]
        return max(marks).split("-", 2)[2] if marks else None

    def read(self, name: str) -> DataFrame:
        version = self.current(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.parquet(f"{self.folder}/{name}/{version}")
        check_schema(df, SCHEMAS[name], name)
        return df

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new version; the marker that names it is written last."""
        check_schema(df, SCHEMAS[name], name)
        old = self.current(name)
        version = uuid.uuid4().hex
        df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]]).write.parquet(f"{self.folder}/{name}/{version}")
        fs, folder = self._fs(f"{self.folder}/{name}")
        n = 1 + max([int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("current-")], default=0)
        fs.create(self._fs(f"{self.folder}/{name}/current-{n:09d}-{version}")[1]).close()
        if old:
            fs.delete(self._fs(f"{self.folder}/{name}/{old}")[1], True)
        return self.read(name)

    def load(self, frame: DataFrame, source: str, mapping: dict[str, str], key: str | None) -> dict[str, int]:
        new = offered(frame, source, mapping, key)
        before = self.read("record")
        n, was = new.count(), before.where(F.col("source") == source).count()
        after = self.write("record", upsert(before, new))
        inserted = after.where(F.col("source") == source).count() - was
        return {"offered": n, "inserted": inserted, "updated": n - inserted}

    def source(self, name: str, id_column: str, price_column: str) -> DataFrame:
        """One source's records for matching; refuses an unknown source and missing prices."""
        rows = self.read("record").where(F.col("source") == name)
        row = rows.agg(F.count("*").alias("n"), F.count_if(F.col("price").isNull()).alias("missing")).first()
        if not row["n"]:
            raise Refused(f"no records of {name}")
        if row["missing"]:
            raise Refused(f"{row['missing']} records of {name} have no price")
        return rows.select(
            F.col("record_id").alias(id_column), "external_id", "title", F.coalesce("category", F.lit("")).alias("category"),
            spaced_key("title").alias("key"), F.col("price").alias(price_column),
        )

    def write_entities(self, entities: DataFrame) -> None:
        """Both decision tables anew; running it again gives the same."""
        from .entities import numbered

        labels, links = numbered(entities, self.read("record"))
        self.write("entity", labels)
        self.write("record_entity", links)

    def check(self) -> None:
        """What a database would enforce: unique keys, no blank titles, no dangling links."""
        record, entity, links = (self.read(n) for n in ("record", "entity", "record_entity"))
        if record.groupBy("source", "external_id").agg(F.count("*").alias("n")).where("n > 1").head(1):
            raise Refused("a source has two records of one external_id")
        if record.where("title is null or source is null or external_id is null").head(1):
            raise Refused("a record lacks a required value")
        if links.join(record, "record_id", "left_anti").head(1) or links.join(entity, "entity_id", "left_anti").head(1):
            raise Refused("a link names a record or an entity that doesn't exist")


def plan_loads(sources: dict[str, dict], exists) -> list[str]:
    """The sources to load, in order: required ones have to have their cleaned file, optional ones may lack it.

    A source has a ``path``, whether it is ``required`` and perhaps a ``raw_path``. Raw records have passed
    no rule, so a required source of which only they are there refuses too. ``exists`` tests a path.
    """
    found = []
    for name, source in sources.items():
        if exists(source["path"]):
            found.append(name)
        elif source.get("required"):
            raw = source.get("raw_path")
            seen = f"; {raw} is there, but nothing has been checked in it" if raw and exists(raw) else ""
            raise Refused(f"{source['path']} of {name} is missing{seen}")
    return found


def read_truth(labels: DataFrame, records: DataFrame, left_source: str, right_source: str) -> DataFrame:
    """Labels by external ids (as text) to record ids; refuses when none or only some reach records."""
    t = labels.select(F.col("left_id").cast("string").alias("l"), F.col("right_id").cast("string").alias("r")).distinct()
    side = lambda s, c, i: records.where(F.col("source") == s).select(F.col("external_id").alias(c), F.col("record_id").alias(i))
    found = t.join(side(left_source, "l", "left_id"), "l").join(side(right_source, "r", "right_id"), "r").select("left_id", "right_id")
    n, k = t.count(), found.count()
    if not k or k < n:
        raise Refused(f"{k} of {n} labels reach stored records")
    return found


def report(record: DataFrame) -> DataFrame:
    return record.groupBy("source").agg(F.count("*").alias("records")).orderBy("source")


def populated(record: DataFrame, columns: Sequence[str] = STORED) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("populated")) for c in columns]
    return record.groupBy("source").agg(F.array(*parts).alias("a")).select("source", F.inline("a"))


def top_categories(record: DataFrame, n: int = 5, category: str = "category") -> DataFrame:
    label = F.coalesce(F.col(category), F.lit("(none)")).alias("category")
    return record.groupBy(label).agg(F.count("*").alias("records")).orderBy(F.desc("records"), "category").limit(n)
