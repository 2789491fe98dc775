"""Tables on the object store: ``<root>/<topic>/year=YYYY/`` Parquet, CSV in and out."""

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from emberline.functions.geo import ring_to_4326
from emberline.operators.zones import mask_name
from emberline.schema import COVER_LEGEND, RINGS
from emberline.sources.order import number_parquet, number_text


#: What an empty field without quotes is read as, and so NULL; an empty text in quotes stays a text.
NO_VALUE = "\0"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, order: str | None = None) -> DataFrame:
    """One Parquet table; NaN in floating columns becomes NULL. ``order`` names a column to add: the rows' order in the files."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return nan_to_null(number_parquet(df, order) if order else df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_rings(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """Geometry table: ``region, part, ring`` in lon/lat, whatever projection (``crs``) the file is in."""
    return spark.read.schema(RINGS).parquet(path).withColumn("ring", ring_to_4326(F.col("ring"), crs))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sep: str = ",",
    encoding: str = "utf-8",
    header: bool = True,
    multi_line: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Standard CSV: quotes double inside quotes. ``multi_line`` allows line breaks there, but then a file is not split.

    ``order`` names a column to add: the rows' order in the files.
    """
    reader = spark.read.schema(schema).options(header=header, sep=sep, encoding=encoding, multiLine=multi_line)
    df = reader.options(quote='"', escape='"', nullValue=NO_VALUE).csv(path)
    return nan_to_null(number_text(df, order) if order else df)


def read_legend(spark: SparkSession, path: str, code: str = "Unnamed: 0", label: str = "Column6") -> DataFrame:
    """``code, label`` of the land-cover legend. The code column may have no name in the file."""
    raw = spark.read.options(header=True, encoding="utf-8", quote='"', escape='"').csv(path)
    source = code if code in raw.columns else raw.columns[0]
    return raw.select(
        F.expr(f"try_cast(`{source}` AS INT)").alias("code"), F.col(f"`{label}`").alias("label")
    ).to(COVER_LEGEND)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), date_as_text: Sequence[str] = ()) -> None:
    """Parquet, replacing what was there; ``date_as_text`` columns are stored as yyyy-MM-dd."""
    for c in date_as_text:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Standard CSV. Spaces stay; an empty text is written in quotes, NULL as nothing."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""'}
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', **keep).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType, **options) -> DataFrame:
    write_table(read_csv(spark, source, schema, **options), target)
    return spark.read.schema(schema).parquet(target)


def _schema_path(root: str, topic: str) -> str:
    return f"{root}/topic-schemas/{topic}"


def topic_schema(spark: SparkSession, root: str, topic: str) -> StructType | None:
    """The declared schema of a topic, NULL allowed everywhere, or None if it was never declared.

    Versions are only ever added, so writers need no lock; a column that a later version names too keeps its first type.
    """
    try:
        versions = spark.read.schema("version long, schema string").json(_schema_path(root, topic)).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    fields: dict[str, StructField] = {}
    for row in sorted(versions):
        for f in StructType.fromJson(json.loads(row.schema)).fields:
            held = fields.setdefault(f.name, StructField(f.name, f.dataType, True, f.metadata))
            if held.dataType != f.dataType:
                raise ValueError(f"topic {topic}: column {f.name} is {held.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType(list(fields.values()))


def declare_topic(spark: SparkSession, root: str, topic: str, schema: StructType, defaults: dict[str, object] | None = None) -> None:
    """State the columns of a topic (without ``year``), or add columns to it.

    ``defaults`` are numbers, texts or booleans that stand for a NULL or an absent value of a column when the topic is read. A column with
    another type than the topic has is an error. Once declared, a topic is read without opening a footer to learn its columns.
    """
    unknown = set(defaults or {}) - set(schema.names)
    if unknown:
        raise ValueError(f"defaults of columns that are not in the schema: {sorted(unknown)}")
    known = topic_schema(spark, root, topic)
    marked = [StructField(f.name, f.dataType, True, {"default": defaults[f.name]} if defaults and f.name in defaults else {}) for f in schema.fields]
    for f in marked if known else ():
        if f.name in known.names and known[f.name].dataType != f.dataType:
            raise ValueError(f"topic {topic}: column {f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    added = [f for f in marked if known is None or f.name not in known.names]
    if added:
        rows = [(0 if known is None else len(known), json.dumps(StructType(added).jsonValue()))]
        version = spark.createDataFrame(rows, "version long, schema string").coalesce(1)
        version.write.mode("append").json(_schema_path(root, topic))


def write_topic(df: DataFrame, root: str, topic: str, date: str = "date") -> None:
    """Add rows of a topic under their year. Years already there and not in ``df`` stay. New columns of a declared topic are declared."""
    if topic_schema(df.sparkSession, root, topic) is not None:
        declare_topic(df.sparkSession, root, topic, df.schema)
    dated = df.withColumn("year", F.year(date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{root}/{topic}")


def read_topic(spark: SparkSession, root: str, topic: str, years: Sequence[int] | None = None) -> DataFrame:
    """All parts of a topic, or those of some years; only their folders are read.

    A declared topic takes its columns and defaults from there and opens the files of the chosen years only; the columns of any other are
    learned from the footers of all its files.
    """
    schema = topic_schema(spark, root, topic)
    if schema is None:
        df = spark.read.option("mergeSchema", True).parquet(f"{root}/{topic}")
    else:
        df = spark.read.schema(StructType([*schema.fields, StructField("year", IntegerType())])).parquet(f"{root}/{topic}")
        given = {f.name: f for f in schema.fields if "default" in f.metadata}
        if given:
            filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(f.metadata["default"]).cast(f.dataType)) for c, f in given.items()}
            df = df.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])
    return df if years is None else df.where(F.col("year").isin(*years))


def read_year_files(spark: SparkSession, root: str, topic: str, year: int, depth: int = 0) -> DataFrame:
    """Parquet tables of a topic whose name ends in the year, ``depth`` folders down: ``<topic>/*<year>.parquet``.

    Columns only some of them have are NULL in the others.
    """
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{topic}/{'*/' * depth}*{year}.parquet")


def read_topics(spark: SparkSession, root: str, topics: Sequence[str], years: Sequence[int]) -> dict[str, DataFrame]:
    return {topic: read_topic(spark, root, topic, years) for topic in topics}


def write_by_region(masks: DataFrame, path: str) -> None:
    """One folder per region mask, under its shortened name."""
    named = masks.withColumn("region", mask_name(F.col("region")))
    named.write.mode("overwrite").partitionBy("region").parquet(path)


def write_label_union(labelled: DataFrame, path: str, date: str = "date_first") -> None:
    """The labelled points, one folder per year, the date stored as text."""
    dated = labelled.withColumn("year", F.year(date)).withColumn(date, F.date_format(date, "yyyy-MM-dd"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
