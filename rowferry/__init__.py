"""rowferry: configured table migrations as Spark jobs."""

from rowferry.plans.blueprint import run_blueprint
from rowferry.plans.migration import run_migration
from rowferry.sinks.tables import TableStore
from rowferry.spec import Migration, Step, migration_from, step_from

__all__ = ["Migration", "Step", "TableStore", "migration_from", "run_blueprint", "run_migration", "step_from"]
