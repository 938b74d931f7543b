"""Snapshots at hand: choosing one, fingerprints, and what has changed since it was made."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.model import Snapshot

MARK = "\u0001"


class CatalogError(ValueError):
    """No snapshot can be chosen."""


def fingerprint(parts: Iterable[str]) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the parts."""
    return hashlib.sha256(MARK.join(parts).encode()).hexdigest()[:16]


def environment_fingerprint(version: str, language: str, mods: Iterable[tuple[str, str]]) -> str:
    """Of a game version, a language, and mods (id, version) in load order."""
    return fingerprint([version, language, *(f"{i}@{v}" for i, v in mods)])


def list_fingerprint(ids: Iterable[str]) -> str:
    """Of the ids of a mod list, in order."""
    return fingerprint(i.lower() for i in ids)


def fingerprint_of(s: Snapshot) -> DataFrame:
    """N4 as a query: of a snapshot's mods. A mod list is small, so one ordered array holds it."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "package_id", "version"))), lambda m: F.concat(m["package_id"], F.lit("@"), m["version"]))
    return s.mods.agg(F.substring(F.sha2(F.array_join(parts, MARK), 256), 1, 16).alias("fingerprint"))


def snapshots(home: str, aliases: dict[str, str] | None = None) -> dict[str, str]:
    """Names and paths of the finished snapshots in a folder, and of the settings' aliases, which win; sorted without case."""
    found = {p.name: str(p) for p in Path(home).iterdir() if (p / "meta").is_dir()} if os.path.isdir(home) else {}
    return dict(sorted((found | (aliases or {})).items(), key=lambda x: x[0].lower()))


def choose(known: dict[str, str], path: str | None = None, name: str | None = None, pinned: str | None = None, fingerprints: dict[str, str] | None = None, current: str | None = None) -> tuple[str, str]:
    """The path of the snapshot to use, and why: path, name, pinned, mod list, only one.

    What is asked for by path or name must exist, even if another choice would win.
    """
    low = {k.lower(): v for k, v in known.items()}
    for asked in (name, pinned):
        if asked and asked.lower() not in low:
            raise CatalogError(f"no snapshot is called {asked}; there are: {', '.join(known) or 'none'}")
    if path and not os.path.isdir(path):
        raise CatalogError(f"there is no snapshot at {path}")
    if path:
        return path, "path"
    if name:
        return low[name.lower()], "name"
    if pinned:
        return low[pinned.lower()], "pinned"
    same = [n for n, f in (fingerprints or {}).items() if current and f == current and n in known]
    if len(same) == 1:
        return known[same[0]], "mod list"
    if len(known) == 1:
        return next(iter(known.values())), "only one"
    raise CatalogError(f"several snapshots, and none is asked for: {', '.join(known)}" if known else "there is no snapshot yet; import one")


def content_fingerprint(folder: str, within: tuple[str, ...] = ("Defs", "Patches")) -> str | None:
    """Of a mod's XML files: relative paths, sizes and times; None if it has none."""
    found = []
    for part in within:
        for path in Path(folder, part).rglob("*"):
            if path.suffix.lower() == ".xml" and path.is_file():
                stat = path.stat()
                found.append(f"{path.relative_to(folder).as_posix()}|{stat.st_size}:{stat.st_mtime_ns}")
    return fingerprint(sorted(found)) if found else None


def content_scan(folders: dict[str, str]) -> dict[str, str]:
    """Content fingerprints of mods by id; the order of scanning doesn't show."""
    with ThreadPoolExecutor() as pool:
        found = dict(zip(folders, pool.map(content_fingerprint, folders.values()), strict=True))
    return {k: v for k, v in sorted(found.items()) if v}


def content_drift(recorded: dict[str, str], now: dict[str, str]) -> tuple[list[str], list[str]]:
    """Mods whose content has changed, and mods of the record that are gone."""
    return sorted(k for k in recorded if k in now and recorded[k] != now[k]), sorted(k for k in recorded if k not in now)


@dataclass
class Drift:
    """What differs between a snapshot's environment and the present one."""

    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    reordered: bool = False
    versions: list[tuple[str, str, str]] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.reordered or self.versions or self.changed)


def environment_drift(recorded: list[tuple[str, str]], now: list[tuple[str, str]], changed: Iterable[str] = ()) -> Drift:
    """Mods (id, version) in load order, then and now. Order counts among the mods in both only."""
    then, here = {i.lower(): v for i, v in recorded}, {i.lower(): v for i, v in now}
    common = [i for i, _ in ((i.lower(), v) for i, v in recorded) if i in here]
    order = [i.lower() for i, _ in now if i.lower() in then]
    return Drift([i for i, _ in now if i.lower() not in then], [i for i, _ in recorded if i.lower() not in here], common != order, [(i, then[i], here[i]) for i in common if then[i] != here[i]], sorted(changed))


def list_fingerprints(spark: SparkSession, known: dict[str, str]) -> dict[str, str]:
    """The mod list fingerprint of each snapshot that has one. meta has a few rows."""
    out = {}
    for name, path in known.items():
        row = spark.read.parquet(f"{path}/meta").where("key = 'list_fingerprint'").first()
        if row:
            out[name] = row.value
    return out


def staleness(s: Snapshot, ids: list[str] | None, version: str | None, content: dict[str, str] | None) -> list[tuple[str, set[str]]]:
    """N6, N7 as sentences, each with the mods that it is about (none: about all).

    ids: the present mod list; version: the present game's; content: the installed mods' content
    fingerprints. What isn't known is not compared.
    """
    meta = {r.key: r.value for r in s.meta.collect()}
    recorded = [(r.package_id, r.version or "") for r in s.mods.orderBy("ordinal").collect()]
    out: list[tuple[str, set[str]]] = []
    if version and meta.get("game_version") and normal_version(version) != normal_version(meta["game_version"]):
        out.append((f"the snapshot is of version {normal_version(meta['game_version'])}, the game of {normal_version(version)}", set()))
    if ids is not None:
        then = {i.lower(): v for i, v in recorded}
        drift = environment_drift(recorded, [(i, then.get(i.lower(), "")) for i in ids])
        for what, names in (("added", drift.added), ("removed", drift.removed)):
            if names:
                out.append((f"mods {what} since the snapshot: {', '.join(names[:3])}" + (f" and {len(names) - 3} more" if len(names) > 3 else ""), {n.lower() for n in names} if what == "removed" else set()))
        if drift.reordered:
            out.append(("the mods' order has changed since the snapshot", set()))
    if content is not None and meta.get("content_fingerprint"):
        changed, _ = content_drift(json.loads(meta["content_fingerprint"]), content)
        if changed:
            out.append((f"files have changed since the snapshot in {', '.join(changed[:3])}" + (f" and {len(changed) - 3} more" if len(changed) > 3 else ""), set(changed)))
    return out


def source_plan(mods: dict[str, str], within: str = "Source") -> dict[str, str]:
    """The source trees that installed mods bring: name and fingerprint of their files."""
    out = {}
    for name, folder in sorted(mods.items()):
        found = sorted(f"{p.relative_to(folder).as_posix()}|{p.stat().st_size}:{p.stat().st_mtime_ns}" for p in Path(folder, within).rglob("*.cs") if p.is_file())
        if found:
            out[name] = fingerprint(found)
    return out


MANIFEST = ".manifest.json"


def source_manifest(root: str) -> dict[str, str]:
    """The trees that were built below a source root, by what."""
    path = Path(root, MANIFEST)
    return json.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}


def sync_sources(mods: dict[str, str], root: str, within: str = "Source") -> list[str]:
    """Copies the trees that are stale or were never built, and notes them in the manifest; returns their names.

    A tree is copied beside its place and moved there whole; the manifest is written last.
    """
    planned, built = source_plan(mods, within), source_manifest(root)
    done = [name for name, state in reconcile(planned, built).items() if state in ("stale", "never built")]
    for name in done:
        place, new = Path(root, name), Path(root, f".{name}.new")
        shutil.rmtree(new, ignore_errors=True)
        shutil.copytree(Path(mods[name], within), new, ignore=lambda at, names: [n for n in names if not Path(at, n).is_dir() and not n.endswith(".cs")])
        shutil.rmtree(place, ignore_errors=True)
        new.rename(place)
    if done:
        Path(root, MANIFEST).write_text(json.dumps(built | {n: planned[n] for n in done}, indent=1, sort_keys=True), encoding="utf-8")
    return done


def normal_version(text: str) -> str:
    """The first two numbers of a version: `1.6.4630 rev1` is 1.6."""
    return ".".join((text.split() or [""])[0].split(".")[:2])


def load_folders(mod: str, version: str, entries: list[dict], active: set[str]) -> list[str]:
    """The folders of a mod that load, most specific first, each once.

    entries: {version, folder, if_active, if_all, if_not}. The version's own entries hold; else
    those of the highest version below it; else those of `default`; a mod without entries loads
    a folder of that version, Common, and itself.
    """
    if not entries:
        return [f for f in (version, "Common", "") if f == "" or os.path.isdir(os.path.join(mod, f))]
    number = lambda v: tuple(int(x) for x in v.split(".") if x.isdigit())
    names = {e["version"].lstrip("v") for e in entries}
    numbered = sorted((n for n in names if n[:1].isdigit() and number(n) <= number(version)), key=number)
    pick = version if version in names else numbered[-1] if numbered else "default"
    low = {a.lower() for a in active}
    have = lambda e, key: [x.strip().lower() for x in (e.get(key) or "").split(",") if x.strip()]
    out: list[str] = []
    for e in reversed([e for e in entries if e["version"].lstrip("v") == pick]):
        some, every, none = have(e, "if_active"), have(e, "if_all"), have(e, "if_not")
        if (not some or low & set(some)) and low >= set(every) and not low & set(none) and e["folder"].strip("/") not in out:
            out.append(e["folder"].strip("/"))
    return out


def reconcile(planned: dict[str, str], built: dict[str, str]) -> dict[str, str]:
    """For each source tree, whether it is current, stale, never built, or outside the plan."""
    return {name: "outside" if name not in planned else "never built" if name not in built else "current" if planned[name] == built[name] else "stale" for name in sorted(planned | built)}


def with_dependencies(ids: list[str], needs: dict[str, list[str]], passes: int = 16) -> list[str]:
    """A mod list with what its mods need put in before them, until nothing is missing."""
    out = list(ids)
    for _ in range(passes):
        have = {i.lower() for i in out}
        missing = [(at, need) for at, i in enumerate(out) for need in needs.get(i.lower(), []) if need.lower() not in have]
        if not missing:
            break
        at, need = missing[0]
        new = [need]
        for other_at, other in missing[1:]:
            if other_at == at and other.lower() not in {n.lower() for n in new}:
                new.append(other)
        out[at:at] = new
    return out
