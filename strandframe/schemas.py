"""Tables of the store and the layers of calls."""

from __future__ import annotations

from dataclasses import dataclass

SCHEMA_VERSION = "8.0"
#: Fibers with a longer span are artefacts; they are left out of fiber look-ups, not of layers.
MAX_FIBER_SPAN = 100_000
MISSING_LINKER = -1.0

FIBERS = "fiber_int_id long, fiber_id string, start long, end long"


@dataclass(frozen=True)
class Layer:
    """A class of calls on fibers. ``kind`` is 'interval' (start, end) or 'point' (start = position, end = position)."""

    name: str
    table: str
    kind: str
    fields: str


LAYERS = {
    x.name: x
    for x in (
        Layer("nucleosomes", "nucleosomes", "interval", "fiber_int_id long, start long, end long, width long, linker float, ord long"),
        Layer("5mC", "m5c", "point", "fiber_int_id long, pos long, prob float, is_methylated boolean, ord long"),
        Layer("5hmC", "m5hc", "point", "fiber_int_id long, pos long, prob float, is_methylated boolean, ord long"),
        Layer("6mA", "m6a", "point", "fiber_int_id long, pos long, ord long"),
        Layer("msp", "msp", "interval", "fiber_int_id long, start long, end long, width long, ord long"),
        Layer("fire_accessibility", "fire", "interval", "fiber_int_id long, start long, end long, width long, score double, haplotype string, ord long"),
    )
}


def layer(name: str) -> Layer:
    if name not in LAYERS:
        raise ValueError(f"unknown layer {name!r}; known are {sorted(LAYERS)}")
    return LAYERS[name]
