"""Systems: what a plug-in says of its kind of campaign, by id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points


@dataclass(frozen=True)
class System:
    id: str
    name: str
    character_types: tuple[str, ...] = ("pc", "npc")
    defaults: dict = field(default_factory=dict)
    check_sheet: Callable[[dict], list[str]] | None = None


class Systems:
    """Systems by id: each is registered once; those of installed plug-ins are found by the name of an entry-point group."""

    def __init__(self, group: str = "palimpsest.systems"):
        self.group, self._own = group, {}

    def register(self, system: System) -> None:
        if self._own.setdefault(system.id, system) is not system:
            raise ValueError(f"system {system.id!r} is there already")

    def get(self, name: str) -> System:
        if name not in self._own:
            raise LookupError(f"unknown system {name!r}")
        return self._own[name]

    def all(self) -> list[System]:
        return [self._own[k] for k in sorted(self._own)]

    def discover(self) -> list[System]:
        """Register what installed plug-ins give, a system or a function that makes one; systems that are there stay."""
        new = []
        for entry in entry_points(group=self.group):
            given = entry.load()
            system = given() if callable(given) else given
            if not isinstance(system, System):
                raise TypeError(f"{entry.name} gives no system")
            if system.id not in self._own:
                self.register(system)
                new.append(system)
        return new
