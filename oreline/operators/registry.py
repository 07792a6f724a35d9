"""Plug-ins: named DataFrame transforms in phases, chosen by name or tag and run in order of registration."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = ("probe", "detector", "report")


@dataclass(frozen=True)
class Plugin:
    name: str
    phase: str
    run: Callable[[DataFrame], DataFrame]
    tags: frozenset[str] = field(default_factory=frozenset)


class Registry:
    """Plug-ins by name. A name is used once; unloading one that is not there does nothing."""

    def __init__(self) -> None:
        self._plugins: dict[str, Plugin] = {}

    def load(self, name: str, phase: str, run: Callable[[DataFrame], DataFrame], tags: Iterable[str] = ()) -> None:
        if phase not in PHASES:
            raise ValueError(f"{phase} is no phase: {', '.join(PHASES)}")
        if name in self._plugins:
            raise ValueError(f"{name} is loaded")
        self._plugins[name] = Plugin(name, phase, run, frozenset(tags))

    def unload(self, name: str) -> None:
        self._plugins.pop(name, None)

    def select(self, phase: str | None = None, tag: str | None = None) -> list[Plugin]:
        return [p for p in self._plugins.values() if phase in (None, p.phase) and (tag is None or tag in p.tags)]

    def probe(self, rows: DataFrame, tag: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
        """The union of what the probes find, marked with ``source``, and the errors of those whose plan could not be built."""
        out, errors = None, {}
        for p in self.select("probe", tag):
            try:
                found = p.run(rows).withColumn("source", F.lit(p.name))
            except Exception as e:  # noqa: BLE001  a plug-in's failure is reported, not raised
                errors[p.name] = str(e)
                continue
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        return out, errors

    def run(self, rows: DataFrame, least: float = 0.3, tag: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
        """Probes, then each detector on their union, then the confidence filter; as one plan."""
        found, errors = self.probe(rows, tag)
        for p in self.select("detector", tag) if found is not None else ():
            try:
                found = p.run(found)
            except Exception as e:  # noqa: BLE001
                errors[p.name] = str(e)
        return (found.where(F.col("confidence") >= least) if found is not None and "confidence" in found.columns else found), errors
