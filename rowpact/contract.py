"""The declarative column contract: what each column must look like, plus table rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from rowpact.fixed_values import DEFAULT_DATE_LAYOUT
from rowpact.functions.layouts import split_layout
from rowpact.functions.patterns import java_pattern


class ContractError(ValueError):
    """The contract itself is not valid."""


#: Names of the result, and beginnings of names, that validation adds itself.
RESERVED = ("errors", "valid")
RESERVED_PREFIXES = ("_raw_", "_clean_", "_date_", "_age_", "_message_", "_rule_", "_dup_", "_value", "_owner", "_word", "_bits", "_suspect")


def reserved(name: str) -> bool:
    """Whether validation adds columns of this name, or of this kind, itself."""
    return name.lower() in RESERVED or name.lower().startswith(RESERVED_PREFIXES)


@dataclass(frozen=True)
class CleanseRule:
    trim: bool = False
    remove: tuple[str, ...] = ()
    replace: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class PatternRule:
    regex: str = ""
    message: str = ""


@dataclass(frozen=True)
class Bounds:
    min: Decimal | None = None
    max: Decimal | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    required: bool = False
    secret: bool = False
    min_len: int | None = None
    max_len: int | None = None
    regex: str = ""
    enum: tuple[str, ...] = ()
    range: Bounds | None = None
    format: str = ""
    preprocess: tuple[CleanseRule, ...] = ()
    validators: tuple[PatternRule, ...] = ()
    transform: tuple[str, ...] = ()
    normalize: tuple[tuple[str, str], ...] = ()

    @property
    def layout(self) -> str:
        return self.format or DEFAULT_DATE_LAYOUT

    @property
    def is_date(self) -> bool:
        return self.type.startswith("date")

    @property
    def decimal_size(self) -> tuple[int, int] | None:
        sized = re.fullmatch(r"decimal\(\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\)", self.type)
        return (int(sized.group(1)), int(sized.group(2))) if sized else None


@dataclass(frozen=True)
class RowRule:
    name: str
    expr: str


@dataclass(frozen=True)
class UniqueRule:
    """Each column on its own, or (`composite`) all columns as one key."""

    columns: tuple[str, ...]
    composite: bool = False


@dataclass(frozen=True)
class Contract:
    columns: tuple[ColumnSpec, ...]
    row_rules: tuple[RowRule, ...] = ()
    uniqueness: tuple[UniqueRule, ...] = ()
    treat_empty_as_null: bool = False
    version: int = 1
    unique_keys: tuple[tuple[str, ...], ...] = field(init=False, compare=False, default=())

    def __post_init__(self) -> None:
        if self.version != 1:
            raise ContractError(f"unsupported contract version: {self.version}")
        if not self.columns:
            raise ContractError("a contract needs at least one column")
        seen: set[str] = set()
        for spec in self.columns:
            if not spec.name:
                raise ContractError("column names cannot be empty")
            if spec.name in seen:
                raise ContractError(f"duplicate column name: {spec.name}")
            if reserved(spec.name):
                raise ContractError(f"column name that validation uses itself: {spec.name}")
            seen.add(spec.name)
            _check_column(spec)
        object.__setattr__(self, "unique_keys", tuple(_unique_keys(self.uniqueness, seen)))

    @property
    def names(self) -> list[str]:
        return [spec.name for spec in self.columns]

    @property
    def secret_names(self) -> list[str]:
        return [spec.name for spec in self.columns if spec.secret]

    def column(self, name: str) -> ColumnSpec | None:
        return next((spec for spec in self.columns if spec.name == name), None)

    def struct_type(self) -> T.StructType:
        """The scan schema: text everywhere."""
        return T.StructType([T.StructField(name, T.StringType()) for name in self.names])

    def typed_struct_type(self) -> T.StructType:
        """The schema of the typed output."""
        return T.StructType([T.StructField(s.name, _spark_type(s)) for s in self.columns])

    @classmethod
    def from_dict(cls, source: Mapping[str, Any]) -> Contract:
        policy = source.get("null_policy") or {}
        return cls(
            version=int(source.get("version") or 0),
            columns=tuple(_column_from(c) for c in source.get("columns") or ()),
            row_rules=tuple(
                RowRule(str(r.get("name") or ""), str(r.get("expr") or ""))
                for r in source.get("row_rules") or ()
            ),
            uniqueness=tuple(
                UniqueRule(_texts(u.get("columns")), _flag(u.get("composite")))
                for u in source.get("uniqueness") or ()
            ),
            treat_empty_as_null=_flag(policy.get("treat_empty_as_null")),
        )

    @classmethod
    def from_yaml(cls, source: str | Path) -> Contract:
        """Read a contract from a YAML file, or from YAML text."""
        return cls.from_dict(read_yaml(source))


def read_yaml(source: str | Path) -> Mapping[str, Any]:
    """YAML with every scalar kept as text, so `2` stays the text `2`."""
    try:
        import yaml
    except ImportError as error:
        raise ContractError("PyYAML is needed to read YAML; use from_dict instead") from error
    is_path = isinstance(source, Path) or "\n" not in str(source)
    text = Path(source).read_text(encoding="utf-8") if is_path else str(source)
    loaded = yaml.load(text, Loader=yaml.BaseLoader)
    if not isinstance(loaded, Mapping):
        raise ContractError("the YAML document must be a mapping")
    return loaded


def _check_column(spec: ColumnSpec) -> None:
    size = spec.decimal_size
    known = spec.type in ("string", "int", "float") or spec.is_date or (
        size is not None and size[0] > 0 and 0 <= size[1] <= size[0]
    )
    if not known:
        raise ContractError(f"invalid type {spec.type!r} for column {spec.name!r}")
    unknown = [t for t in spec.transform if t != "format_korean_phone_e164"]
    if unknown:
        raise ContractError(f"unknown transform {unknown} for column {spec.name!r}")
    try:
        for regex in (spec.regex, *[rule.regex for rule in spec.validators]):
            if regex:
                java_pattern(regex)
        if spec.is_date:
            split_layout(spec.layout)
    except ValueError as error:
        raise ContractError(f"column {spec.name!r}: {error}") from error


def _unique_keys(rules: Iterable[UniqueRule], names: set[str]) -> list[tuple[str, ...]]:
    """Keys in rule order, each once. A column outside the contract is always empty, so never a key."""
    keys: list[tuple[str, ...]] = []
    for rule in rules:
        groups = [rule.columns] if rule.composite else [(c,) for c in rule.columns]
        for key in groups:
            if key and key not in keys and all(c in names for c in key):
                keys.append(key)
    return keys


def _spark_type(spec: ColumnSpec) -> T.DataType:
    if spec.is_date:
        return T.DateType()
    if spec.decimal_size:
        precision, scale = spec.decimal_size
        if precision > 38:
            raise ContractError(f"column {spec.name!r}: typed output allows at most 38 digits")
        return T.DecimalType(precision, scale)
    return {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType()}[spec.type]


def _flag(value: Any) -> bool:
    return value is True or (isinstance(value, str) and value.lower() == "true")


def _texts(value: Any) -> tuple[str, ...]:
    return tuple(str(v) for v in value or ())


def _pairs(value: Mapping[Any, Any] | None) -> tuple[tuple[str, str], ...]:
    return tuple((str(k), str(v)) for k, v in (value or {}).items())


def _number(value: Any) -> int | None:
    return None if value in (None, "") else int(value)


def _decimal(value: Any) -> Decimal | None:
    return None if value in (None, "") else Decimal(str(value))


def _column_from(source: Mapping[str, Any]) -> ColumnSpec:
    bounds = source.get("range") or None
    return ColumnSpec(
        name=str(source.get("name") or ""),
        type=str(source.get("type") or ""),
        required=_flag(source.get("required")),
        secret=_flag(source.get("secret")),
        min_len=_number(source.get("min_len")),
        max_len=_number(source.get("max_len")),
        regex=str(source.get("regex") or ""),
        enum=_texts(source.get("enum")),
        range=Bounds(_decimal(bounds.get("min")), _decimal(bounds.get("max"))) if bounds else None,
        format=str(source.get("format") or ""),
        preprocess=tuple(
            CleanseRule(_flag(r.get("trim")), _texts(r.get("remove")), _pairs(r.get("replace")))
            for r in source.get("preprocess") or ()
        ),
        validators=tuple(
            PatternRule(str(r.get("regex") or ""), str(r.get("message") or ""))
            for r in source.get("validators") or ()
        ),
        transform=tuple(
            name for r in source.get("transform") or () for name, on in r.items() if _flag(on)
        ),
        normalize=_pairs((source.get("normalize") or {}).get("map")),
    )
