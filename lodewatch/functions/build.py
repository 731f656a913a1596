"""Unified events from columns by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch import schemas


class EventBuilder:
    """Fields are set one after the other; ``over`` gives unified events of a table, with the schema's types and defaults."""

    def __init__(self, **fields: Column | str | int | bool | None) -> None:
        self.fields: dict[str, Column] = {}
        self.set(**fields)

    def set(self, **fields: Column | str | int | bool | None) -> EventBuilder:
        unknown = set(fields) - set(schemas.UNIFIED.names)
        if unknown:
            raise ValueError(f"no fields of events: {sorted(unknown)}")
        self.fields |= {n: c if isinstance(c, Column) else F.lit(c) for n, c in fields.items()}
        return self

    def over(self, df: DataFrame) -> DataFrame:
        flags = ("credential_access", "amsi_bypass", "process_injection")
        default = {"us": F.unix_micros(self.fields["ts"]) if "ts" in self.fields else None} | dict.fromkeys(flags, F.lit(False))
        columns = []
        for f in schemas.UNIFIED.fields:
            kind = f.dataType.simpleString()
            c = self.fields.get(f.name, default.get(f.name))
            c = F.lit(None) if c is None else c
            columns.append((F.coalesce(c.cast(kind), F.lit("")) if kind == "string" else c.cast(kind)).alias(f.name))
        return df.select(*columns)
