"""Declared fields: what a field stores, and which queries can find something in it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: Type names of the spec string, with the modifiers each takes.
MODIFIERS = {
    "text": {"positions"},
    "keyword": {"sorteddv"},
    "longpoint": {"numericdv", "stored"},
    "intpoint": {"numericdv", "stored"},
    "numericdv": {"stored"},
    "sorteddv": {"stored"},
    "binarydv": {"stored"},
    "stored": set(),
}
POLICIES = ("strict", "dynamic", "stored-only")


@dataclass(frozen=True)
class FieldSpec:
    """A field. kind: text, keyword, long, int, string, bytes or any (stored as it comes)."""

    name: str
    kind: str
    indexed: bool = False
    tokenized: bool = False
    positions: bool = False
    points: bool = False
    doc_values: str | None = None  # numeric, sorted or binary
    stored: bool = False

    def __post_init__(self) -> None:
        if self.positions and not self.tokenized:
            raise ValueError(f"{self.name}: only tokenized text has positions")
        if self.points and self.kind not in ("long", "int"):
            raise ValueError(f"{self.name}: points are long or int")

    @staticmethod
    def text(name: str, positions: bool = False) -> FieldSpec:
        return FieldSpec(name, "text", indexed=True, tokenized=True, positions=positions, stored=True)

    @staticmethod
    def keyword(name: str) -> FieldSpec:
        return FieldSpec(name, "keyword", indexed=True, stored=True)

    @staticmethod
    def long_point(name: str) -> FieldSpec:
        return FieldSpec(name, "long", points=True)

    @staticmethod
    def int_point(name: str) -> FieldSpec:
        return FieldSpec(name, "int", points=True)

    @staticmethod
    def numeric_dv(name: str) -> FieldSpec:
        return FieldSpec(name, "long", doc_values="numeric")

    @staticmethod
    def sorted_dv(name: str) -> FieldSpec:
        return FieldSpec(name, "string", doc_values="sorted")

    @staticmethod
    def binary_dv(name: str) -> FieldSpec:
        return FieldSpec(name, "bytes", doc_values="binary")

    @staticmethod
    def only_stored(name: str) -> FieldSpec:
        return FieldSpec(name, "any", stored=True)

    def with_doc_values(self, kind: str) -> FieldSpec:
        return replace(self, doc_values=kind)

    def with_stored(self, stored: bool = True) -> FieldSpec:
        return replace(self, stored=stored)

    def data_type(self) -> T.DataType:
        return {"long": T.LongType(), "int": T.IntegerType(), "bytes": T.BinaryType()}.get(self.kind, T.StringType())


_MAKERS = {
    "text": FieldSpec.text,
    "keyword": FieldSpec.keyword,
    "longpoint": FieldSpec.long_point,
    "intpoint": FieldSpec.int_point,
    "numericdv": FieldSpec.numeric_dv,
    "sorteddv": FieldSpec.sorted_dv,
    "binarydv": FieldSpec.binary_dv,
    "stored": FieldSpec.only_stored,
}


@dataclass
class Schema:
    """Fields in order, JSON keys of renamed fields, and what becomes of unknown keys."""

    fields: dict[str, FieldSpec] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)  # field name to JSON key
    policy: str = "strict"

    def add(self, spec: FieldSpec) -> Schema:
        if spec.name in self.fields:
            raise ValueError(f"field declared twice: {spec.name}")
        self.fields[spec.name] = spec
        return self

    def get(self, name: str) -> FieldSpec | None:
        return self.fields.get(name)

    def json_key(self, name: str) -> str:
        return self.aliases.get(name, name)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type()) for f in self.fields.values()])

    @staticmethod
    def of(*specs: FieldSpec) -> Schema:
        out = Schema()
        for s in specs:
            out.add(s)
        return out

    @staticmethod
    def parse(spec: str) -> Schema:
        """`$policy=...`, and `name:type+modifier@json_key` entries, with commas between."""
        out = Schema()
        for entry in filter(None, (e.strip() for e in spec.split(","))):
            if entry[0] == "$":
                key, _, value = entry[1:].partition("=")
                if key != "policy" or value.strip() not in POLICIES:
                    raise ValueError(f"unknown directive: {entry}")
                out.policy = value.strip()
                continue
            declared, at, key = entry.partition("@")
            name, colon, kind = (x.strip() for x in declared.partition(":"))
            kind, *more = (m.strip() for m in kind.split("+"))
            if not name or not colon or kind not in _MAKERS:
                raise ValueError(f"unknown field type: {entry}")
            if at and not key.strip():
                raise ValueError(f"empty JSON key: {entry}")
            known = {m for m in more if m in MODIFIERS[kind]}
            made = _MAKERS[kind](name)
            if "positions" in known:
                made = replace(made, positions=True)
            if "sorteddv" in known:
                made = made.with_doc_values("sorted")
            if "numericdv" in known:
                made = made.with_doc_values("numeric")
            if "stored" in known:
                made = made.with_stored()
            out.add(made)
            if at:
                out.aliases[name] = key.strip()
        return out
