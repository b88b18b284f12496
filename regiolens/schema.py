"""Column names of the enrollment fact table.

All operators take a ``FactSchema`` so the measure list is data, not code:
the reference discovers its age columns as "configured and present", which is
what :meth:`FactSchema.present_measures` does against a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FactSchema:
    date: str = "date"
    state: str = "state"
    district: str = "district"
    unit: str = "pincode"
    measures: tuple[str, ...] = ("age_0_5", "age_5_17", "age_18_greater")
    children: tuple[str, ...] = ("age_0_5", "age_5_17")
    adults: tuple[str, ...] = ("age_18_greater",)
    total: str = "total_enrollment"
    record_id: str = "record_id"
    year_month: str = "year_month"

    @property
    def geo(self) -> tuple[str, str]:
        return (self.state, self.district)

    @property
    def keys(self) -> tuple[str, ...]:
        """Uniqueness key of one observation (date, state, district, unit)."""
        return (self.date, self.state, self.district, self.unit)

    @property
    def required(self) -> tuple[str, ...]:
        return (self.date, self.state, self.district, self.unit, *self.measures)

    @property
    def all_measures(self) -> tuple[str, ...]:
        """Age columns plus the row total (``M`` in the docs)."""
        return (*self.measures, self.total)

    def present_id(self, df) -> list[str]:
        return [self.record_id] if self.record_id in df.columns else []

    def row_order(self, df) -> list[str]:
        """Columns that order rows: the record id if present, else keys and measures."""
        return self.present_id(df) or [
            c for c in (*self.keys, *self.all_measures) if c in df.columns]

    def present_measures(self, df) -> list[str]:
        return [c for c in self.measures if c in df.columns]

    def present_all(self, df) -> list[str]:
        return [c for c in self.all_measures if c in df.columns]


DEFAULT_SCHEMA = FactSchema()
