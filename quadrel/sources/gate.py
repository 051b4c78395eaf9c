"""Licence gate: checked on the driver before a plan is built, so that nothing is read first."""

from __future__ import annotations

from dataclasses import dataclass, field

PURPOSES = ("training", "evaluation", "gap_filling", "analysis")


class ProvenanceError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """One entry of a registry; what it doesn't name is kept in extras."""

    source_id: str
    tier: str = "core"
    role: str | None = None
    family: str = "none"
    commercial: bool = True
    attribution: str | None = None
    pin: str | None = None
    extras: dict = field(default_factory=dict)

    @property
    def ingestible(self) -> bool:
        return self.tier != "quarantined" and self.commercial


class Gate:
    def __init__(self, sources: list[Source]):
        self.sources = {s.source_id: s for s in sources}
        if len(self.sources) != len(sources):
            raise ProvenanceError("a source is registered twice")

    def open(self, source_id: str, version: str | None = None, purpose: str | None = None) -> Source:
        """The source, if it is registered, may be read, for that purpose and in that version."""
        source = self.sources.get(source_id)
        if source is None:
            raise ProvenanceError(f"{source_id} isn't registered")
        if not source.ingestible:
            raise ProvenanceError(f"{source_id} may not be read: {source.tier}")
        if source.pin and version and version != source.pin:
            raise ProvenanceError(f"{source_id} is pinned to {source.pin}, not {version}")
        if purpose is not None and purpose not in PURPOSES:
            raise ProvenanceError(f"{source_id} may not be used for {purpose!r}")
        return source

    def exportable(self, source_ids: list[str]) -> list[str]:
        """Findings that stand against shipping what these sources went into."""
        unknown = [f"{s}: unknown" for s in sorted(set(source_ids)) if s not in self.sources]
        known = [self.sources[s] for s in sorted(set(source_ids)) if s in self.sources]
        found = unknown + [f"{s.source_id}: {s.tier}" for s in known if s.tier in ("quarantined", "research")]
        found += [f"{s.source_id}: for training only" for s in known if s.role == "training_only"]
        families = {s.family for s in known}
        if {"ODbL", "CC-BY-SA"} <= families:
            found.append("licence families that exclude each other")
        return found
