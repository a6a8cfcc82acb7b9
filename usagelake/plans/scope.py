"""Scope of a question and the choice between the event log and the rollups."""

from __future__ import annotations

from dataclasses import dataclass

from usagelake.contract import EventFilters, Settings
from usagelake.operators.rollups import active_can_answer, rollups_can_answer
from usagelake.plans.ranges import ResolvedRange, granularity_for

# Fixed value: spans up to this many days are answered from the log.
ROLLUP_THRESHOLD_DAYS = 8


@dataclass(frozen=True)
class Scope:
    resolved: ResolvedRange
    filters: EventFilters
    previous: EventFilters
    settings: Settings
    granularity: str
    use_rollups: bool

    @property
    def active_from_rollups(self) -> bool:
        """Counters may come from rollups while active time still has to come from the log."""
        return self.use_rollups and active_can_answer(self.filters)


def make_scope(
    resolved: ResolvedRange, settings: Settings, filters: EventFilters | None = None
) -> Scope:
    shared = filters or EventFilters()

    def on(span) -> EventFilters:
        return shared.but(from_day=span.first.isoformat(), to_day=span.last.isoformat())

    current = on(resolved.current)
    return Scope(
        resolved=resolved,
        filters=current,
        previous=on(resolved.previous),
        settings=settings,
        granularity=granularity_for(resolved),
        use_rollups=(
            resolved.span_days > ROLLUP_THRESHOLD_DAYS and rollups_can_answer(current)
        ),
    )
