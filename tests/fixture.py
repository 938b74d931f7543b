"""A small export of an observatory's stock, written as the exporter would, and what stands in it."""

from __future__ import annotations

import gzip
import json

D, S, U = 0, 1, 2
HOUSE, GUEST = "house.stock", "guest.loans"
COMMON = [["alarm.cue", "Bell_Low", D], ["plug", "TypeF", D]]
"""Fields that every rig has."""


def entity(kind, name, label, fields=(), mod=HOUSE, cls=None, generated=False, dropped=0):
    rows = [*(COMMON if kind == "RigDef" else []), *map(list, fields)]
    return {"kind": "def", "def_type": kind, "def_name": name, "label": label or "", "description": "", "source_mod": mod, "source_file": f"{kind}/{name}.xml", "generated": generated, "class": cls or f"Optics.{kind}", "fields": rows, "fields_truncated": dropped}


DEFS = [
    # A namesake in another type, without label and fields.
    entity("PlanDef", "Lantern", None),
    entity("RigDef", "Lantern", "lantern", [("maker", "Optics.Lamp", D), ("art.sheet", "Sheets/Lamp", D), ("case.artFolded.sheet", "Sheets/Case", D), ("gauges[0].unit", "ArcMinute", D)]),
    # The same label, and the same leaf and value under another path.
    entity("RigDef", "LanternPole", "lantern", [("ratios[0].unit", "ArcMinute", D), ("maker", "Optics.Lamp", D)]),
    # A list of records with siblings, a hidden default, and three bookkeeping fields.
    entity("RigDef", "Sextant_Brass", "brass sextant", [
        ("shortHash", "90", D), ("parts[0].index", "1", D), ("modContentPack.name", "x", D), ("maker", "Optics.Sextant", D), ("parts[0].driveClass", "Optics.CompTilt", S), ("parts[0].tune.drift", "0.011", D),
        ("parts[0].tune.gain", "0.25", D), ("gauges[0].span", "60", D), ("gauges[0].unit", "ArcMinute", D), ("gauges[1].span", "4", D), ("gauges[1].unit", "Lux", D),
    ]),
    # All three states under one head, and fields that the exporter dropped.
    entity("RigDef", "Slit_Echelle", "echelle slit", [("slit.angle", "15", U), ("slit.blades", "1", S), ("slit.width", "80", D), ("maker", "Optics.Slit", D)], dropped=5),
    entity("RigDef", "Plate_Cold", "cold plate", [("cooling.fluid", "Glycol", D)], generated=True),
    entity("KitDef", "Filter_Narrow", "narrow filter", [("parts[0].driveClass", "Optics.SlideDrive", D), ("kitClass", "Optics.FilterKit", D)]),
    # Of another mod.
    entity("RigDef", "Probe_Loaned", "loaned probe", [("feeds[0].target", "Slit_Echelle", D), ("maker", "Optics.Sextant", D), ("parts[0].Class", "Optics.CompProperties_Tilt", D), ("parts[0].driveClass", "Optics.CompTilt", S)], GUEST),
    # Names of joined words, one within the other.
    *(entity("RigDef", "".join(words), " ".join(words).lower(), mod=GUEST) for words in (("Quiet", "Dish"), ("Quiet", "Dish", "Rim"), ("Folded", "Quiet", "Dish"), ("Dish", "Cover"))),
    # A class that isn't its type's.
    entity("FrameDef", "FrameTilted", "tilted frame", [("runner", "Optics.FrameRunner", D)], GUEST, "Optics.TiltedFrame"),
    entity("FrameDef", "FrameFlat", "flat frame", mod=GUEST),
]


def node(kind, name, parent, def_name=None, ops=0):
    return {"kind": "xmlnode", "def_type": kind, "name": name, "parent_name": parent, "abstract": def_name is None, "def_name": def_name, "label": None, "source_mod": HOUSE, "source_file": "nodes.xml", "patch_ops": ops}


NODES = [
    node("RigDef", "RingWest", "RingEast"),  # a cycle of two
    node("RigDef", "RingEast", "RingWest"),
    node("RigDef", None, "Glass", "Lantern"),
    node("TiltedFrame", None, "Glass", "FrameTilted"),  # not the entity's type, but there is one of the name
    node("RigDef", None, "GoneWithItsMod", "Probe_Loaned"),  # no such node
    node("RigDef", None, "ThinGlass", "Slit_Echelle"),
    node("RigDef", "ThinGlass", "Glass", ops=3),
    node("RigDef", "Glass", None),
]

INJECTIONS = [
    {"kind": "definj", "def_type": kind, "def_name": name, "path": path, "translated": text, "original": original}
    for kind, name, path, text, original in [
        ("RigDef", "Lantern", "label", "提灯", "lantern"),
        ("LostDef", "Lantern", "note", "无主文字", ""),  # no owner: two entities of the name, none of the type
        ("RigDef", "Sextant_Brass", "label", "黄铜六分仪", "brass sextant"),
    ]
]

KEYED = [
    {"kind": "keyed", "key": key, "translated": text, "original": original, "source_file": "ui.xml", "source_line": line, "placeholder": open_}
    for line, (key, text, original, open_) in enumerate([("DomeShut", "圆顶已关", "Dome shut", False), ("DomeShutHint", "关闭圆顶", "Shut the dome", False), ("", "无键", "no key", False), ("SkyTodo", "TODO", "Still to do", True), ("PointAt", "指向", "Point", False), ("NoCurrent", "没有电流", "No current", False)])
]

META = {
    "kind": "meta", "format_version": 4, "exporter_version": "0.3.1", "exported_at_utc": "2031-05-06T07:08:09Z", "game_version": "2.7.0001 rev3", "language": "ChineseSimplified",
    "mods": [{"package_id": HOUSE, "name": "House", "version": "2.7"}, {"package_id": GUEST, "name": "Loans", "version": "0.4"}], "limits": {},
}


def records(**changed):
    body = [META | changed, *DEFS, *NODES, *KEYED, *INJECTIONS]
    return [*body, {"kind": "end", "records": len(body) + 1}]


def write(path, lines):
    text = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines)
    with (gzip.open(path, "wt", encoding="utf-8") if str(path).endswith(".gz") else open(path, "w", encoding="utf-8")) as f:
        f.write(text + "\n")
    return str(path)
