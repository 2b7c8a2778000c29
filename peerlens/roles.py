"""Column roles of one benchmark run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Which columns of a long-format fact table play which part.

    ``metric`` is the share metric; ``total`` and ``numerators`` (rate name ->
    column) drive rate mode.  ``target`` is the benchmarked entity, or ``None``
    for a peer-only run.
    """

    entity: str
    dimensions: tuple[str, ...]
    metric: str | None = None
    total: str | None = None
    numerators: dict[str, str] = field(default_factory=dict)
    secondary: tuple[str, ...] = ()
    time: str | None = None
    target: str | None = None
