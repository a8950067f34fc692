"""Stored indexes, traces and case lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2


def write_index(folder: str, documents: DataFrame, parent_sections: DataFrame, chunks: DataFrame, info: dict[str, str]) -> None:
    """One Parquet table each; an index that is there is replaced."""
    spark = documents.sparkSession
    for name, df in (("documents", documents), ("parent_sections", parent_sections), ("chunks", chunks)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    values = {"schema_version": str(SCHEMA_VERSION)} | info
    spark.createDataFrame([(values,)], "info map<string,string>").write.mode("overwrite").parquet(f"{folder}/index_info")


def masked(ids: str | Column) -> Column:
    """As many marks as there are ids."""
    return F.transform(ids, lambda _: F.lit("<redacted>"))


def write_traces(df: DataFrame, folder: str, run: str, redact: tuple[str, ...] = ()) -> None:
    """Traces as JSON lines by run, id lists masked where asked."""
    for c in redact:
        df = df.withColumn(c, masked(c))
    df.write.mode("overwrite").partitionBy(run).json(folder)


def public(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Without columns and nested fields that begin with _ or are named in `drop`, at any depth."""

    def hidden(name: str) -> bool:
        return name.startswith("_") or name in drop

    def kept(kind: T.DataType, value: Column) -> Column:
        if isinstance(kind, T.StructType):
            fields = [kept(f.dataType, value[f.name]).alias(f.name) for f in kind.fields if not hidden(f.name)]
            return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
        if isinstance(kind, T.ArrayType) and _holds(kind.elementType, hidden):
            return F.transform(value, lambda x: kept(kind.elementType, x))
        if isinstance(kind, T.MapType):
            own = F.map_filter(value, lambda k, _: ~(k.startswith("_") | k.isin(*drop)) if drop else ~k.startswith("_")) if isinstance(kind.keyType, T.StringType) else value
            return F.transform_values(own, lambda _, x: kept(kind.valueType, x)) if _holds(kind.valueType, hidden) else own
        return value

    return df.select(*(kept(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields if not hidden(f.name)))


def _holds(kind: T.DataType, hidden) -> bool:
    """Whether something hidden can stand below."""
    if isinstance(kind, T.StructType):
        return any(hidden(f.name) or _holds(f.dataType, hidden) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds(kind.elementType, hidden)


def forbidden_columns(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of columns and nested fields that a report must not hold."""

    def walk(kind, path: str) -> list[str]:
        found = []
        for f in getattr(kind, "fields", []):
            at = f"{path}.{f.name}".lstrip(".")
            found += [at] * (f.name in names) + walk(getattr(f.dataType, "elementType", f.dataType), at)
        return found

    return walk(df.schema, "")
