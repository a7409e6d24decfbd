"""Schemas bound to dialects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillet.options import DEFAULT, DYNAMIC_DEFAULT, Options, OptionsError
from quillet.schema import Schema
from quillet.sources import reader, writer


@dataclass(frozen=True)
class Static:
    """A schema and a dialect, checked once and used for any number of texts. Without a schema of its own, the dialect's provider gives it."""

    schema: Schema | None = None
    options: Options = DEFAULT

    def __post_init__(self) -> None:
        if self.schema is None:
            given = self.options.schema_provider
            if given is None:
                raise OptionsError("neither a schema nor a provider of one is given")
            object.__setattr__(self, "schema", given() if callable(given) else given)
        for f in self.schema.fields:
            f.get_parser()
            f.get_formatter()

    def read(self, texts: DataFrame, on_error: str = "raise") -> DataFrame:
        return reader.read_static(texts, self.schema, self.options, on_error)

    def read_files(self, spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
        return self.read(reader.from_files(spark, path, encoding))

    def read_texts(self, spark: SparkSession, *texts: str) -> DataFrame:
        return self.read(reader.from_texts(spark, *texts))

    def read_large_files(self, spark: SparkSession, path: str | list[str], on_error: str = "raise") -> DataFrame:
        return reader.read_static_large(spark, path, self.schema, self.options, on_error)

    def lines(self, df: DataFrame) -> DataFrame:
        return writer.lines(df, self.schema, self.options)

    def to_text(self, df: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
        return writer.to_text(df, self.schema, order, self.options, group)

    def write(self, df: DataFrame, path: str, header: str | None = None) -> None:
        writer.write(df, self.schema, path, self.options, header)


@dataclass(frozen=True)
class Dynamic:
    """A dialect for rows without a schema."""

    options: Options = DYNAMIC_DEFAULT

    def __post_init__(self) -> None:
        if self.options.read_header == "DETECT":
            raise OptionsError("untyped rows have no names of their own to detect a header by")

    def read(self, texts: DataFrame) -> DataFrame:
        return reader.read_dynamic(texts, self.options)

    def read_files(self, spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
        return self.read(reader.from_files(spark, path, encoding))

    def read_texts(self, spark: SparkSession, *texts: str) -> DataFrame:
        return self.read(reader.from_texts(spark, *texts))

    def to_text(self, df: DataFrame, column: str, order: list[str], group: list[str] | None = None, before: tuple[str, ...] = ()) -> DataFrame:
        return writer.dynamic_to_text(df, column, order, self.options, group, before=before)
