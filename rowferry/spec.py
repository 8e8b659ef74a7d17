"""What a migration is: frozen descriptions, read from a configuration document or built in code."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from rowferry.functions.casts import spark_type

# Fixed values of the configuration format.
CONNECTION_TYPES = ("MYSQL", "MSSQL", "POSTGRESQL", "CSV_S3_BUCKET", "LOCAL_CSV", "PARQUET")
JOIN_TYPES = ("INNER", "LEFT", "RIGHT", "FULL")
JOIN_OPERATORS = ("=", "!=", "<>", "<", "<=", ">", ">=")
MAPPING_KINDS = ("DIRECT", "DERIVED", "EXPRESSION", "CONSTANT")
POLICIES = ("FAIL", "IGNORE", "UPSERT", "IGNORE_AND_LOG", "IGNORE_AND_INSERT_UNPROCESSED")
DEFAULT_AUDIT_TABLE = "migration_conflict_log"
DERIVED_PREFIX = "derivations."


class SpecError(ValueError):
    """A description that cannot be run."""


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise SpecError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")
    return value


@dataclass(frozen=True)
class Connection:
    """Where data lives. ``options`` holds the remaining fields of the connection entry."""

    kind: str
    location: str
    options: Mapping[str, Any] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        _one_of(self.kind, CONNECTION_TYPES, "connection type")

    def __repr__(self) -> str:  # a connection string may hold a password
        return f"Connection(kind={self.kind!r})"


@dataclass(frozen=True)
class Source:
    alias: str
    connection: str
    table: str
    schema: str | None = None

    def __post_init__(self) -> None:
        if self.alias.lower() == "derivations":
            raise SpecError("'derivations' names the derived variables and cannot be a source alias")


@dataclass(frozen=True)
class Condition:
    left: str
    operator: str
    right: str

    def __post_init__(self) -> None:
        _one_of(self.operator, JOIN_OPERATORS, "join operator")


@dataclass(frozen=True)
class Join:
    """One joined source.

    ``salted`` spreads keys that hold a large share of the left rows. ``stripe`` joins the range
    ``point >= low`` and ``point < high`` by stripes of that width in place of a nested loop.
    """

    source: Source
    conditions: tuple[Condition, ...]
    how: str = "INNER"
    salted: bool = False
    stripe: float | None = None

    def __post_init__(self) -> None:
        _one_of(self.how, JOIN_TYPES, "join type")
        if not self.conditions:
            raise SpecError(f"join with {self.source.alias!r} needs at least one condition")


@dataclass(frozen=True)
class ColumnMap:
    column: str
    kind: str
    value: str
    cast_to: str
    nullable: bool = True

    def __post_init__(self) -> None:
        _one_of(self.kind, MAPPING_KINDS, "mapping source type")
        if not self.value.strip():
            raise SpecError(f"mapping of {self.column!r} has no source value")
        try:
            spark_type(self.cast_to)
        except ValueError as error:
            raise SpecError(f"mapping of {self.column!r}: {error}") from None
        if self.kind == "DERIVED" and not self.value.startswith(DERIVED_PREFIX):
            raise SpecError(f"DERIVED mapping of {self.column!r} must read '{DERIVED_PREFIX}<name>'")


@dataclass(frozen=True)
class Chunking:
    column: str
    size: int

    def __post_init__(self) -> None:
        if not self.column or self.size < 1:
            raise SpecError("chunking needs a column and a size of at least 1")


@dataclass(frozen=True)
class Target:
    schema: str
    table: str
    keys: tuple[str, ...]
    policy: str = "FAIL"
    unprocessed_table: str | None = None
    audit_table: str | None = None
    connection: str | None = None
    order_by: tuple[str, ...] = ()
    buckets: int | None = None  # keep the table by the hash of its key, so that updates rewrite parts of it

    def __post_init__(self) -> None:
        _one_of(self.policy, POLICIES, "conflict policy")
        if self.buckets is not None and (self.buckets < 1 or not self.keys):
            raise SpecError("buckets need primary key columns and a number of at least 1")
        if not self.keys and self.policy not in ("FAIL", "IGNORE"):
            raise SpecError(f"{self.policy} needs primary key columns")
        if self.policy == "IGNORE_AND_INSERT_UNPROCESSED" and not self.unprocessed_table:
            raise SpecError("IGNORE_AND_INSERT_UNPROCESSED needs unprocessed_table")


@dataclass(frozen=True)
class Step:
    """One load: root source, joins, derived variables, filters, mapped columns and target."""

    order: int
    target: Target
    root: Source
    columns: tuple[ColumnMap, ...]
    joins: tuple[Join, ...] = ()
    pre_filters: tuple[str, ...] = ()
    derivations: Mapping[str, str] = field(default_factory=dict)
    post_filters: tuple[str, ...] = ()
    chunking: Chunking | None = None

    def __post_init__(self) -> None:
        names = [c.column for c in self.columns]
        if not names:
            raise SpecError(f"step {self.order} maps no columns")
        if len(set(names)) != len(names):
            raise SpecError(f"step {self.order} maps a target column twice")
        missing = [k for k in self.target.keys if k not in names]
        if missing:
            raise SpecError(f"step {self.order} does not map key columns {missing}")
        missing = [c for c in self.target.order_by if c not in names]
        if missing:
            raise SpecError(f"step {self.order} orders by columns it does not map: {missing}")
        aliases = [self.root.alias, *(j.source.alias for j in self.joins)]
        if len(set(aliases)) != len(aliases):
            raise SpecError(f"step {self.order} uses a source alias twice")


@dataclass(frozen=True)
class Migration:
    migration_id: str
    client_id: str
    version: str
    connections: Mapping[str, Connection]
    steps: tuple[Step, ...]

    def __post_init__(self) -> None:
        orders = sorted(s.order for s in self.steps)
        if orders != list(range(1, len(orders) + 1)):
            raise SpecError(f"steps must be numbered 1..n without gaps; got {orders}")
        object.__setattr__(self, "steps", tuple(sorted(self.steps, key=lambda s: s.order)))
        for step in self.steps:
            for source in (step.root, *(j.source for j in step.joins)):
                if source.connection not in self.connections:
                    raise SpecError(f"step {step.order} reads unknown connection {source.connection!r}")


# ---------------------------------------------------------------------------------------------
# Reading a configuration document (already parsed JSON)

_IGNORED = {"comment", "$schema"}


def _take(entry: Mapping[str, Any], where: str, required: str, optional: str = "") -> dict[str, Any]:
    """The named fields of a document entry; unknown or missing ones are an error."""
    need, may = required.split(), optional.split()
    unknown = set(entry) - set(need) - set(may) - _IGNORED
    missing = [n for n in need if n not in entry]
    if unknown or missing:
        raise SpecError(f"{where}: missing {missing}, unknown {sorted(unknown)}")
    return {name: entry.get(name) for name in (*need, *may)}


def connection_from(entry: Mapping[str, Any]) -> Connection:
    location_field = {
        "CSV_S3_BUCKET": "s3_bucket_uri",
        "LOCAL_CSV": "file_path",
        "PARQUET": "path",
    }.get(entry.get("type", ""), "connection_string")
    if location_field not in entry:
        raise SpecError(f"{entry.get('type')} connection needs {location_field}")
    rest = {k: v for k, v in entry.items() if k not in ("type", location_field, *_IGNORED)}
    return Connection(entry["type"], entry[location_field], rest)


def _source_from(entry: Mapping[str, Any], where: str) -> Source:
    if entry.get("file_name"):
        return Source(entry["alias"], entry["connection_ref"], entry["file_name"])
    f = _take(entry, where, "connection_ref table_name alias", "schema file_name join_type conditions salted stripe")
    return Source(f["alias"], f["connection_ref"], f["table_name"], f["schema"])


def _join_from(entry: Mapping[str, Any], where: str) -> Join:
    conditions = []
    for c in entry.get("conditions", ()):
        f = _take(c, where, "left_expression operator right_expression")
        conditions.append(Condition(f["left_expression"], f["operator"], f["right_expression"]))
    return Join(_source_from(entry, where), tuple(conditions), entry["join_type"], bool(entry.get("salted")),
                entry.get("stripe"))


def step_from(entry: Mapping[str, Any]) -> Step:
    where = f"step {entry.get('sequence_order')}"
    f = _take(entry, where, "sequence_order target sources mappings",
              "chunking_strategy pre_filters derivations post_filters")
    t = _take(f["target"], f"{where} target", "schema table_name primary_keys on_conflict",
              "connection_ref unprocessed_table audit_table order_by buckets")
    audit = t["audit_table"]
    if isinstance(audit, Mapping):
        audit = ".".join(filter(None, (audit.get("schema"), audit.get("table_name"))))
    chunk = f["chunking_strategy"] or {}
    columns = []
    for m in f["mappings"]:
        c = _take(m, f"{where} mapping", "target_column source_type source_value cast_to", "is_nullable")
        columns.append(ColumnMap(c["target_column"], c["source_type"], c["source_value"], c["cast_to"],
                                 c["is_nullable"] is not False))
    derived = {d["variable_name"]: d["expression"] for d in f["derivations"] or ()}
    return Step(
        order=f["sequence_order"],
        target=Target(t["schema"], t["table_name"], tuple(t["primary_keys"]), t["on_conflict"],
                      t["unprocessed_table"], audit, t["connection_ref"], tuple(t["order_by"] or ()), t["buckets"]),
        root=_source_from(f["sources"]["root_table"], f"{where} root"),
        joins=tuple(_join_from(j, f"{where} join") for j in f["sources"].get("joins", ())),
        columns=tuple(columns),
        pre_filters=tuple(f["pre_filters"] or ()),
        derivations=derived,
        post_filters=tuple(f["post_filters"] or ()),
        chunking=Chunking(chunk["chunk_by_column"], chunk["chunk_size"]) if chunk.get("is_enabled") else None,
    )


def migration_from(document: Mapping[str, Any]) -> Migration:
    """A migration from its configuration document."""
    f = _take(document, "migration", "migration_id client_id version connections blueprints", "output_format")
    return Migration(
        f["migration_id"], f["client_id"], f["version"],
        {name: connection_from(entry) for name, entry in f["connections"].items()},
        tuple(step_from(b) for b in f["blueprints"]),
    )
