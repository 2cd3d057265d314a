"""What a check needs to know besides the rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame

from .rules import SOURCE_GROUP
from .templates import staging_levels


@dataclass(frozen=True)
class ColumnMeta:
    """One mapped column of one file."""

    staging: str
    raw: str = ""
    sql_type: str = "varchar"
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    level: str = "unclassified"


@dataclass(frozen=True)
class TransactionTypes:
    """Codes compare as written, descriptions in lower case."""

    charge_codes: frozenset[str] = frozenset()
    charge_descriptions: frozenset[str] = frozenset()
    transaction_codes: frozenset[str] = frozenset()
    transaction_descriptions: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Context:
    source: str = "billing_charges"
    client: str = ""
    round: str = "v1"
    file: str = ""
    test_month: str | None = None
    window: tuple[date, date] | None = None
    columns: tuple[ColumnMeta, ...] = ()
    types: TransactionTypes = field(default_factory=TransactionTypes)
    ref_cpt: DataFrame | None = None
    ref_pos: DataFrame | None = None
    #: Whether a combined file has charge rows, where that was found when its parsed rows were written.
    has_charges: bool | None = None

    @property
    def source_group(self) -> str:
        return SOURCE_GROUP.get(self.source, self.source)

    @property
    def raw_names(self) -> dict[str, str]:
        return {c.staging: c.raw for c in self.columns if c.raw}

    def levels(self) -> dict[str, str]:
        known = staging_levels(self.source)
        return {c.staging: known.get(c.staging, c.level) for c in self.columns}

    def for_file(self, **changes) -> "Context":
        return replace(self, **changes)
