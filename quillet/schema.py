"""Row schemas: fields with their parsers, formatters and policies, and where they come from."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions import format as fmt
from quillet.functions import parse


class SchemaError(ValueError):
    """A schema that can't be bound."""


#: Spark's types and the kinds they are read and written as.
SPARK_KINDS = {
    T.StringType: "string", T.BooleanType: "bool", T.ByteType: "sbyte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long",
    T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "decimal", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DayTimeIntervalType: "timespan",
}
PYTHON_KINDS = {"str": "string", "int": "long", "float": "double", "bool": "bool", "Decimal": "decimal", "datetime": "datetime", "timedelta": "timespan", "UUID": "guid"}


@dataclass(frozen=True)
class Field:
    """One member: how it is read and how it is written.

    ``default`` is what an absent value leaves in the row. ``reset`` gives the value a member has before its own is set, from the
    row's other text cells; ``should_write`` says, from the row, whether its cell is filled. With ``emit_default`` off, a cell that
    holds ``zero`` (the type's default) is left empty. A skipped cell is empty; its separator stays. ``never_null`` is a contract: a null that the parser
    or the reset gives, or that an absent value would leave, is an error. ``getter`` gives the value to write, in place of the column of the field's name. With ``quote_empty``
    an empty text is written in quotes, and a null as nothing.
    """

    name: str
    kind: str = "string"
    nullable: bool = False
    required: bool = False
    default: Any = None
    order: int | None = None
    emit_default: bool = True
    zero: Any = None
    column: str | None = None
    names: tuple[str, ...] | None = None
    values: Mapping[str, int] | None = None
    parser: parse.Parser | None = None
    formatter: fmt.Formatter | None = None
    should_write: Callable[[], Column] | None = None
    reset: Callable[[], Column] | None = None
    never_null: bool = False
    getter: Callable[[], Column] | None = None
    quote_empty: bool = False

    def start(self, schema: Schema) -> Column:
        """What the member holds before its own value is set: its reset, its default, or what the schema's default row gives it."""
        if self.reset:
            return self.reset()
        if schema.provider is not None and self.default is None:
            return schema.provider().getField(self.name)
        return F.lit(self.default)

    def get_parser(self) -> parse.Parser:
        p = self.parser or (parse.enum(list(self.names)) if self.kind == "enum" else parse.flags(self.values) if self.kind == "flags" else parse.parser_of(self.kind))
        if p is None:
            raise SchemaError(f"no parser for {self.name}: {self.kind}")
        return parse.nullable(p) if self.nullable else p

    def get_formatter(self) -> fmt.Formatter:
        f = self.formatter or (fmt.enum(list(self.names)) if self.kind == "enum" else fmt.flags(self.values) if self.kind == "flags" else fmt.formatter_of(self.kind))
        if f is None:
            raise SchemaError(f"no formatter for {self.name}: {self.kind}")
        return f


def member_order(fields: list[Field]) -> list[Field]:
    """Explicit orders first, ascending; the others after them as they came."""
    return sorted(fields, key=lambda f: (f.order is None, f.order or 0))


@dataclass(frozen=True)
class Schema:
    """Fields in their order; ``provider`` gives a default row, as a struct with a member for each field, from which rows start."""

    fields: tuple[Field, ...] = field(default_factory=tuple)
    provider: Callable[[], Column] | None = None

    def __post_init__(self) -> None:
        if not self.fields:
            raise SchemaError("a schema has at least one field")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SchemaError("Two or more members with same name")  # a fixed message
        object.__setattr__(self, "fields", tuple(member_order(list(self.fields))))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def override(self, name: str, **changes) -> Schema:
        """The same schema with one field changed: a subclass's hook."""
        return dataclasses.replace(self, fields=tuple(dataclasses.replace(f, **changes) if f.name == name else f for f in self.fields))

    def starting_from(self, *providers: Callable[[], Column]) -> Schema:
        """Rows start from the first of these default rows (structs) that isn't null."""
        return dataclasses.replace(self, provider=lambda: F.coalesce(*(p() for p in providers)))

    # --- providers

    @classmethod
    def of(cls, **kinds: str) -> Schema:
        """``Schema.of(a="int", b="string?")``: a question mark makes a field nullable."""
        return cls(tuple(Field(n, k.rstrip("?"), k.endswith("?")) for n, k in kinds.items()))

    @classmethod
    def from_struct(cls, struct: T.StructType) -> Schema:
        """Spark's fields; their metadata may give name, kind, order, required, emit_default and ignore."""
        fields = []
        for f in struct.fields:
            m = f.metadata or {}
            if m.get("ignore"):
                continue
            kind = m.get("kind") or SPARK_KINDS.get(type(f.dataType))
            if kind is None:
                raise SchemaError(f"no kind for {f.name}: {f.dataType.simpleString()}")
            fields.append(Field(m.get("name", f.name), kind, f.nullable and kind != "string", m.get("required", False), order=m.get("order"), emit_default=m.get("emit_default", True), column=f.name))
        return cls(tuple(fields))

    @classmethod
    def from_dataclass(cls, kind: type) -> Schema:
        """A dataclass: fields without a default are required (they come with the constructor), inherited ones first."""
        fields = []
        for f in dataclasses.fields(kind):
            if f.metadata.get("ignore"):
                continue
            name = f.type if isinstance(f.type, str) else getattr(f.type, "__name__", str(f.type))
            if typing.get_args(f.type):  # X | None
                name = " | ".join(getattr(t, "__name__", str(t)).replace("NoneType", "None") for t in typing.get_args(f.type))
            optional = name.endswith("| None")
            base = name.removesuffix("| None").strip().rpartition(".")[2]
            has_default = f.default is not dataclasses.MISSING
            fields.append(Field(f.metadata.get("name", f.name), f.metadata.get("kind") or PYTHON_KINDS.get(base, "string"), optional, not has_default, f.default if has_default else None, f.metadata.get("order"), f.metadata.get("emit_default", True), column=f.name))
        return cls(tuple(fields))

    @classmethod
    def scalar(cls, kind: str, nullable: bool = False) -> Schema:
        """Rows that are one well-known value: the column has the type's name."""
        names = {"bool": "Boolean", "byte": "Byte", "sbyte": "SByte", "char": "Char", "short": "Int16", "ushort": "UInt16", "int": "Int32", "uint": "UInt32", "long": "Int64", "ulong": "UInt64", "float": "Single", "double": "Double", "decimal": "Decimal", "string": "String", "datetime": "DateTime", "datetimeoffset": "DateTimeOffset", "timespan": "TimeSpan", "guid": "Guid", "uri": "Uri", "version": "Version", "index": "Index", "range": "Range"}
        if kind not in names:
            raise SchemaError(f"not a well-known type: {kind}")
        return cls((Field(("Nullable" if nullable else "") + names[kind], kind, nullable),))

    @classmethod
    def tuple_of(cls, *kinds: str) -> Schema:
        return cls.of(**{f"Item{i + 1}": k for i, k in enumerate(kinds)})

    def surrogate(self, other: Schema) -> Schema:
        """These fields by the shape of another schema: same names, same kinds; what the other leaves out is left out."""
        for f in other.fields:
            if f.name not in self.names or self[f.name].kind != f.kind:
                raise SchemaError(f"the surrogate's {f.name} has no match")
            if f.parser or f.formatter:
                raise SchemaError(f"the surrogate's {f.name} is backed by a function")
        return Schema(tuple(dataclasses.replace(f, column=self[f.name].column) for f in other.fields))


class ManualSchema:
    """A builder of schemas, field by field; ``fallback`` answers for types that were not described (None: an error)."""

    def __init__(self, fallback: Callable[[str], Schema] | None = None):
        self.types: dict[str, list[Field]] = {}
        self.fallback = fallback

    def add(self, type_name: str, *fields: Field) -> ManualSchema:
        self.types.setdefault(type_name, []).extend(fields)
        return self

    def build(self, type_name: str) -> Schema:
        if type_name in self.types:
            return Schema(tuple(self.types[type_name]))
        if self.fallback is None:
            raise SchemaError(f"no members were described for {type_name}")
        return self.fallback(type_name)
