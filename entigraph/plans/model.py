"""Schema model: field types, entities, relations, constraints and versioned schemas."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

#: Scalar types and the Spark types that hold them; decimals and vectors carry parameters of their own.
SCALARS: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "timestamp": T.TimestampNTZType(),
    "uuid": T.StringType(),
    "vector": T.ArrayType(T.FloatType(), False),
    "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "text": T.StringType(),
}


@dataclass(frozen=True)
class FieldType:
    """``shape``: scalar, optional, array, enum, optional_enum, embedded, optional_embedded or array_embedded."""

    shape: str
    scalar: str = "string"
    variants: tuple[str, ...] = ()
    fields: tuple["Field", ...] = ()
    name: str = ""
    precision: int = 0
    scale: int = 0
    dimensions: int = 0
    metric: str = "cosine"
    language: str = "english"

    def spark(self) -> T.DataType:
        if "embedded" in self.shape:
            inner = T.StructType([T.StructField(f.name, f.type.spark(), f.type.nullable) for f in self.fields])
        elif "enum" in self.shape:
            inner = T.StringType()
        else:
            inner = T.DecimalType(self.precision, self.scale) if self.scalar == "decimal" else SCALARS[self.scalar]
        return T.ArrayType(inner, False) if self.shape.startswith("array") else inner

    @property
    def nullable(self) -> bool:
        return self.shape.startswith("optional")


def scalar(kind: str, **more) -> FieldType:
    return FieldType("scalar", kind, **more)


def optional(kind: str, **more) -> FieldType:
    return FieldType("optional", kind, **more)


def array(kind: str) -> FieldType:
    return FieldType("array", kind)


def enum(name: str, *variants: str) -> FieldType:
    return FieldType("enum", name=name, variants=variants)


@dataclass(frozen=True)
class Field:
    """``default`` and ``computed`` are SQL expressions; ``access`` is public, internal, sensitive or restricted."""

    name: str
    type: FieldType
    required: bool = False
    default: str | None = None
    computed: str | None = None
    indexed: bool = False
    access: str = "public"
    capability: str = ""
    mask: tuple = ("null",)


@dataclass(frozen=True)
class Entity:
    name: str
    identity: tuple[str, ...]
    fields: tuple[Field, ...]
    soft_delete: bool = False
    default_order: tuple[tuple[str, bool], ...] = ()

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"unknown field {name!r} of {self.name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark(), f.type.nullable or not f.required) for f in self.fields])


@dataclass(frozen=True)
class Relation:
    """A named join: ``from_fields`` of one entity equal ``to_fields`` of another, or both equal fields of an edge entity."""

    name: str
    from_entity: str
    from_fields: tuple[str, ...]
    to_entity: str
    to_fields: tuple[str, ...]
    cardinality: str = "one_to_many"
    on_delete: str = "restrict"
    edge_entity: str | None = None
    edge_from: tuple[str, ...] = ()
    edge_to: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.cardinality == "many_to_many" and not self.edge_entity:
            raise ValueError(f"relation {self.name}: many-to-many needs an edge entity")

    def inverse(self, name: str) -> "Relation":
        turned = {"one_to_many": "many_to_one", "many_to_one": "one_to_many"}.get(self.cardinality, self.cardinality)
        return replace(self, name=name, from_entity=self.to_entity, from_fields=self.to_fields, to_entity=self.from_entity, to_fields=self.from_fields, cardinality=turned, edge_from=self.edge_to, edge_to=self.edge_from)


@dataclass(frozen=True)
class Constraint:
    """``kind``: unique (fields), foreign_key (fields to ``target`` by ``target_fields``) or check (expression)."""

    name: str
    kind: str
    entity: str
    fields: tuple[str, ...] = ()
    target: str = ""
    target_fields: tuple[str, ...] = ()
    expression: str = ""


@dataclass(frozen=True)
class Schema:
    version: int = 0
    entities: dict[str, Entity] = field(default_factory=dict)
    #: By source entity and name, so that two entities may have relations of the same name.
    relations: dict[tuple[str, str], Relation] = field(default_factory=dict)
    constraints: tuple[Constraint, ...] = ()

    @staticmethod
    def of(entities: list[Entity], relations: list[Relation] = (), constraints: list[Constraint] = ()) -> "Schema":
        return Schema(0, {e.name: e for e in entities}, {(r.from_entity, r.name): r for r in relations}, tuple(constraints))

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise ValueError(f"unknown entity {name!r}")
        return self.entities[name]

    def relation(self, entity: str, name: str) -> Relation:
        if (entity, name) not in self.relations:
            raise ValueError(f"unknown relation {name!r} of {entity}")
        return self.relations[entity, name]

    def to_json(self) -> str:
        data = {"version": self.version, "entities": [asdict(e) for e in self.entities.values()], "relations": [asdict(r) for r in self.relations.values()], "constraints": [asdict(c) for c in self.constraints]}
        return json.dumps(data, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Schema":
        data = json.loads(text)
        made = Schema.of([_entity(e) for e in data["entities"]], [Relation(**_tuples(r)) for r in data["relations"]], [Constraint(**_tuples(c)) for c in data["constraints"]])
        return replace(made, version=data["version"])


def _tuples(data: dict) -> dict:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}


def _type(data: dict) -> FieldType:
    return FieldType(**{**_tuples(data), "fields": tuple(_field(f) for f in data["fields"])})


def _field(data: dict) -> Field:
    return Field(**{**_tuples(data), "type": _type(data["type"])})


def _entity(data: dict) -> Entity:
    return Entity(data["name"], tuple(data["identity"]), tuple(_field(f) for f in data["fields"]), data["soft_delete"], tuple((f, d) for f, d in data["default_order"]))


class Catalog:
    """Schema versions: each applied schema becomes the next version, and older ones stay readable."""

    def __init__(self) -> None:
        self.versions: list[Schema] = []

    def apply(self, schema: Schema) -> Schema:
        made = replace(schema, version=len(self.versions) + 1)
        self.versions.append(made)
        return made

    def current(self) -> Schema:
        if not self.versions:
            raise ValueError("no schema has been applied")
        return self.versions[-1]

    def at(self, version: int) -> Schema:
        if not 1 <= version <= len(self.versions):
            raise ValueError(f"no schema version {version}")
        return self.versions[version - 1]

    def rows(self) -> list[tuple[int, str]]:
        """Version and JSON text: the rows of a schema table."""
        return [(s.version, s.to_json()) for s in self.versions]

    @staticmethod
    def of_rows(rows: list[tuple[int, str]]) -> "Catalog":
        made = Catalog()
        made.versions = [Schema.from_json(text) for _, text in sorted(rows)]
        return made
