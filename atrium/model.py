"""Schemas, defaults and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace

CLASSES = ("wall", "door", "window", "room")

PLAN_SCHEMA = (
    "scale struct<pixels_per_meter:double>,"
    "walls array<struct<start:array<double>,end:array<double>,thickness:double,confidence:double>>,"
    "doors array<struct<position:variant,width:double,height:double,type:string,wall_index:int,confidence:double>>,"
    "windows array<struct<position:variant,width:double,height:double,sill_height:double,wall_index:int,confidence:double>>,"
    "rooms array<struct<label:string,polygon:array<array<double>>,area:double>>"
)


@dataclass(frozen=True)
class Config:
    """The defaults that documents and detections fall back on, and the cutoffs of the detection path."""

    pixels_per_meter: float = 50.0
    min_confidence: float = 0.5
    max_overlap: float = 0.45
    snap_threshold: float = 0.1
    min_wall_length: float = 0.3
    min_room_area: float = 1.0
    simplify_pixels: float = 5.0
    wall_thickness: float = 0.15
    wall_height: float = 2.7
    door_width: float = 0.9
    door_height: float = 2.1
    window_width: float = 1.2
    window_height: float = 1.2
    sill_height: float = 0.9
    min_door: float = 0.7
    min_window: float = 0.5
    degenerate: float = 1e-6
    cutter_margin: float = 1.5
    label_z: float = 0.01
    label_size: float = 0.3
    val_share: float = 0.15
    test_share: float = 0.05
    seed: int = 42


DEFAULT = Config()

#: Where a configuration file keeps the settings.
SETTINGS = {
    ("inference", "confidence_threshold"): "min_confidence",
    ("inference", "iou_threshold"): "max_overlap",
    ("inference", "snap_threshold"): "snap_threshold",
    ("inference", "min_wall_length"): "min_wall_length",
    ("inference", "min_room_area"): "min_room_area",
    ("output", "default_wall_thickness"): "wall_thickness",
    ("output", "default_wall_height"): "wall_height",
    ("output", "default_door_height"): "door_height",
    ("output", "default_window_height"): "window_height",
    ("output", "default_window_sill_height"): "sill_height",
    ("training", "val_split"): "val_share",
    ("training", "test_split"): "test_share",
}


def configured(settings: dict) -> Config:
    """The settings of a configuration file, as read; what it leaves out keeps its default, other keys don't matter."""
    given = {name: (settings.get(part) or {}).get(key) for (part, key), name in SETTINGS.items()}
    return replace(DEFAULT, **{k: float(v) for k, v in given.items() if v is not None})


#: Material of each kind of object, as red, green, blue, alpha.
MATERIALS = {"wall": (0.92, 0.90, 0.87, 1.0), "floor": (0.76, 0.60, 0.42, 1.0), "ceiling": (0.95, 0.95, 0.95, 1.0)}

#: Bounds of the settings.
BOUNDS = {"wall_height": (1.0, 10.0), "pixels_per_meter": (1.0, 500.0)}


def checked(name: str, value: float) -> float:
    lo, hi = BOUNDS[name]
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value}")
    return value
