"""Valid rows as request records."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rowpact.contract import Contract, ContractError, read_yaml
from rowpact.fixed_values import DEFAULT_SUCCESS_STATUS, HASH_HEAD, HASH_HEADER, HASH_VALUE, PREVIEW_ROWS
from rowpact.functions.scalars import interpolate
from rowpact.operators.validate import RAW, valid_rows, validate

Part = str | Column


@dataclass(frozen=True)
class RequestSpec:
    """How a row becomes a request. A part is a `{column}` template or a Column.

    A Column that yields NULL means that the row cannot be rendered. The texts in
    `sources` stand in for Column parts in the request hash.
    """

    method: str
    url: Part
    headers: Mapping[str, Part] = field(default_factory=dict)
    body: Part = ""
    proxy: Part = ""
    status_in: tuple[int, ...] = ()
    response_keys: Mapping[str, str] = field(default_factory=dict)
    sources: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.method:
            raise ContractError("method is required")
        if isinstance(self.url, str) and not self.url:
            raise ContractError("url is required")
        if not self.status_in:
            object.__setattr__(self, "status_in", DEFAULT_SUCCESS_STATUS)
        for name in ("url", "body"):
            if isinstance(getattr(self, name), Column) and name not in self.sources:
                raise ContractError(f"sources[{name!r}] must name the {name} column for the hash")

    @classmethod
    def from_dict(cls, source: Mapping[str, Any]) -> RequestSpec:
        success = source.get("success") or {}
        return cls(
            method=str(source.get("method") or ""),
            url=str(source.get("url") or ""),
            headers={str(k): str(v) for k, v in (source.get("headers") or {}).items()},
            body=str(source.get("body") or ""),
            proxy=str(source.get("proxy") or ""),
            status_in=tuple(int(s) for s in success.get("status_in") or ()),
            response_keys={str(k): str(v) for k, v in (success.get("response_keys") or {}).items()},
        )

    @classmethod
    def from_yaml(cls, source: str | Path) -> RequestSpec:
        return cls.from_dict(read_yaml(source))

    def source_text(self, name: str) -> str:
        part = getattr(self, name)
        return self.sources.get(name, "") if isinstance(part, Column) else part


def part_column(part: Part) -> Column:
    return part if isinstance(part, Column) else interpolate(part)


def render_headers(headers: Mapping[str, Part]) -> Column:
    """The header map without empty values, keys sorted."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    maps = []
    for name in sorted(headers):
        value = part_column(headers[name])
        maps.append(F.when(value != "", F.create_map(F.lit(name), value)).otherwise(none))
    return F.map_concat(none, *maps)


def request_hash(spec: RequestSpec, names: list[str], include_headers: bool = False) -> Column:
    """Idempotency hash of the request definition and the processed values, keys sorted."""
    head = HASH_HEAD.format(
        method=spec.method, url=spec.source_text("url"), body=spec.source_text("body"))
    if include_headers:
        for key in sorted(spec.headers):
            part = spec.headers[key]
            text = spec.sources.get(f"header:{key}", "") if isinstance(part, Column) else part
            head += HASH_HEADER.format(key=key, value=text)
    pieces: list[Column] = []
    for name in sorted(names):
        before, after = HASH_VALUE.split("{value}")
        pieces += [F.lit(before.replace("{name}", name)), F.col(f"`{name}`"), F.lit(after)]
    return F.sha2(F.concat(F.lit(head), *pieces), 256)


def request_id(names: list[str], row: str = "row", prefix: str = RAW) -> Column:
    """`req_{row}_{hash}` with a hash of the raw values, in contract order."""
    pieces: list[Column] = []
    for name in names:
        pieces += [F.lit(f"{name}="), F.col(f"`{prefix}{name}`"), F.lit("\n")]
    digest = F.substring(F.sha2(F.concat(*pieces), 256), 1, 16)
    return F.concat(F.lit("req_"), F.col(row).cast("string"), F.lit("_"), digest)


def render(
    rows: DataFrame, spec: RequestSpec, contract: Contract, include_headers: bool = False
) -> DataFrame:
    """Add `request` and `rendered` (false where a part could not be rendered)."""
    url, body, proxy = part_column(spec.url), part_column(spec.body), part_column(spec.proxy)
    ready = url.isNotNull() & body.isNotNull() & proxy.isNotNull()
    for part in spec.headers.values():
        if isinstance(part, Column):
            ready &= part.isNotNull()
    request = F.struct(
        F.lit(spec.method).alias("method"),
        url.alias("url"),
        render_headers(spec.headers).alias("headers"),
        body.alias("body"),
        proxy.alias("proxy"),
        request_hash(spec, contract.names, include_headers).alias("request_hash"),
    )
    return rows.select("*", request.alias("request"), ready.alias("rendered"))


def preview(
    df: DataFrame,
    contract: Contract,
    spec: RequestSpec,
    n: int = PREVIEW_ROWS,
    as_of=None,
    row: str = "row",
) -> DataFrame:
    """The requests of the first `n` input rows; uniqueness looks at those rows only.

    Rows are numbered 1, 2, ..., so a filter, which a written table prunes by, finds them.
    """
    head = df.filter(F.col(row) <= n)
    return render(valid_rows(validate(head, contract, as_of, row)), spec, contract).filter("rendered")


def request_json(escape_html: bool = True) -> Column:
    """One JSON text per request with sorted keys; `<`, `>`, `&` as unicode escapes."""
    text = F.to_json(F.struct(
        F.col("request.body").alias("body"),
        F.col("request.headers").alias("headers"),
        F.col("request.method").alias("method"),
        F.col("request.proxy").alias("proxy"),
        F.col("row").alias("row"),
        F.col("request.url").alias("url"),
    ))
    if escape_html:
        # Characters that must not appear as themselves, and their escapes.
        for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
                           ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
            text = F.replace(text, F.lit(char), F.lit(code))
    return text
