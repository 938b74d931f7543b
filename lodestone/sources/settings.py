"""Settings (TOML) and mod lists (XML)."""

from __future__ import annotations

import json
import tomllib
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

from lodestone.sources.languages import package_id


@dataclass
class Settings:
    """Where things are, which snapshot is pinned, and named groups of mods.

    mods: the folder of installed mods; mod_list: the file of the present mod list; version: that
    of the game; file: where the settings were read from.
    """

    home: str = "."
    snapshot: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    groups: dict[str, list[str]] = field(default_factory=dict)
    sources: str | None = None
    official: str = "base."
    mods: str | None = None
    mod_list: str | None = None
    version: str | None = None
    file: str | None = None


def load_settings(*paths: str) -> Settings:
    """Settings from TOML files; later files win, tables are merged. Missing files are passed over."""
    merged: dict = {}
    for path in paths:
        if Path(path).is_file():
            for key, value in tomllib.loads(Path(path).read_text(encoding="utf-8-sig")).items():
                merged[key] = merged.get(key, {}) | value if isinstance(value, dict) else value
    known = {k: v for k, v in merged.items() if k in Settings.__dataclass_fields__}
    return Settings(**known | {"file": paths[-1] if paths else None})


def pin(path: str, name: str) -> None:
    """Sets `snapshot` in a settings file, whose other lines stay as they are."""
    file = Path(path)
    lines = file.read_text(encoding="utf-8-sig").splitlines() if file.is_file() else []
    table = next((i for i, line in enumerate(lines) if line.lstrip().startswith("[")), len(lines))
    kept = [line for i, line in enumerate(lines) if i >= table or line.partition("=")[0].strip() != "snapshot"]
    file.write_text("\n".join([f"snapshot = {json.dumps(name)}", *kept]) + "\n", encoding="utf-8")


def installed(folder: str | None) -> dict[str, str]:
    """The mods in a folder: package id and path. Of two folders with one id the first by name counts."""
    out: dict[str, str] = {}
    for path in sorted(Path(folder).iterdir()) if folder and Path(folder).is_dir() else []:
        if path.is_dir():
            out.setdefault(package_id(str(path)).lower(), str(path))
    return out


@dataclass
class ModList:
    """A named mod list: ids in load order, and names where the file has them."""

    name: str
    ids: list[str]
    names: list[str | None]


def read_mod_list(path: str) -> ModList:
    """A mod list file: ids under modIds, ids, or activeMods, names under modNames or names. Damaged ones raise ValueError."""
    try:
        root = ET.parse(path).getroot()
    except ET.ParseError as e:
        raise ValueError(f"{path} is damaged: {e}") from e

    def items(*tags: str) -> list[str]:
        for e in root.iter():
            if e.tag.lower() in tags and len(e):
                return [(x.text or "").strip() for x in e if x.tag == "li"]
        return []

    found = items("modids", "ids", "activemods")
    names = items("modnames", "names")
    return ModList(Path(path).stem, found, [names[i] if i < len(names) else None for i in range(len(found))])


def write_mod_list(path: str, mods: ModList) -> None:
    root = ET.Element("savedModList")
    held = ET.SubElement(root, "modList")
    for tag, values in (("ids", mods.ids), ("names", mods.names)):
        e = ET.SubElement(held, tag)
        for v in values:
            ET.SubElement(e, "li").text = v or ""
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def mod_lists(folder: str) -> tuple[list[ModList], list[str]]:
    """The lists in a folder, and the files that are damaged."""
    good, bad = [], []
    for path in sorted(Path(folder).glob("*.rml")):
        try:
            good.append(read_mod_list(str(path)))
        except ValueError:
            bad.append(path.name)
    return good, bad


def lists_with(lists: list[ModList], text: str) -> dict[str, list[str]]:
    """Across lists, the ids that a text is in, or in the name of, by list."""
    low = text.lower()
    found = {m.name: [i for i, n in zip(m.ids, m.names, strict=True) if low in i.lower() or low in (n or "").lower()] for m in lists}
    return {k: v for k, v in found.items() if v}
