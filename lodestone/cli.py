"""The command line: strict options, commands over a snapshot, reports (M6-M9, §2.11).

Exit codes: 0 found, 1 nothing found, 2 wrong usage, 70 an error inside.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import effective_terms
from lodestone.model import Snapshot, SnapshotError, open_snapshot
from lodestone.operators import catalog, corpus, graph, keyed, lookup, reverse, search, triage
from lodestone.operators.paging import MAX_LIMIT, UsageError, limit_of, offset_of
from lodestone.plans.predicates import PathQuery
from lodestone.plans.scope import ScopeError, parse
from lodestone.report import Block, Kind, Notice, Report, counted, name_list, page_notice, snake
from lodestone.sources import settings as config


@dataclass(frozen=True)
class Option:
    name: str
    help: str
    kind: str = "single"  # single, multi, flag
    short: str | None = None


@dataclass(frozen=True)
class Command:
    name: str
    help: str
    run: Callable
    positionals: tuple[str, ...] = ()
    options: tuple[Option, ...] = ()
    keys: tuple[str, ...] = ()
    needs_snapshot: bool = True


COMMON = (Option("snapshot", "snapshot by name"), Option("db", "snapshot by path"), Option("mods", "scope of mods: a, b, -c"), Option("limit", "rows at most, or all", short="n"), Option("offset", "rows to pass over"), Option("json", "answer as JSON", "flag"))


@dataclass
class Parsed:
    values: dict[str, object] = field(default_factory=dict)
    positionals: list[str] = field(default_factory=list)

    def get(self, name: str, default=None):
        return self.values.get(name, default)


NARROWING = ("type", "class", "name-like", "path-contains", "mods", "glob", "source")
MAX_FILES = 50_000


def normal(name: str) -> str:
    return name.lower().replace("_", "-").strip("-")


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(name: str, known: list[str], most: int = 2) -> list[str]:
    """Names at most `most` edits away or that begin alike."""
    scored = sorted((distance(name, k), k) for k in known)
    return [k for d, k in scored if d <= most or k.startswith(name)][:3]


def parse_args(command: Command, args: list[str]) -> Parsed:
    """Every option must be known; nothing is passed over."""
    options = {normal(o.name): o for o in (*COMMON, *command.options)}
    shorts = {o.short: o for o in options.values() if o.short}
    out, i, only = Parsed(), 0, False
    while i < len(args):
        arg = args[i]
        i += 1
        if only or not arg.startswith("-") or arg == "-" or arg.lstrip("-").replace(".", "").isdigit():
            out.positionals.append(arg)
            continue
        if arg == "--":
            only = True
            continue
        name, mark, value = arg.partition("=")
        option = options.get(normal(name)) if name.startswith("--") else shorts.get(name[1:])
        if option is None:
            wanted = normal(name)
            if wanted in command.positionals:
                raise UsageError(f"{name}: give {wanted} without --{wanted}: {command.name} <{wanted}>")
            also = [c.name for c in COMMANDS.values() if wanted in {normal(o.name) for o in c.options}]
            hint = f"; {', '.join(also)} has it" if also else f"; did you mean {' or '.join('--' + x for x in close)}?" if (close := near(wanted, list(options))) else ""
            raise UsageError(f"{command.name} has no option {name}{hint}")
        if option.kind == "flag":
            if mark:
                raise UsageError(f"--{option.name} takes no value")
            out.values[option.name] = True
            continue
        if not mark:
            if i >= len(args):
                raise UsageError(f"--{option.name} needs a value")
            value, i = args[i], i + 1
        if option.kind == "multi":
            out.values.setdefault(option.name, []).append(value)
        elif option.name in out.values:
            raise UsageError(f"--{option.name} is given twice")
        else:
            out.values[option.name] = value
    if len(out.positionals) > len(command.positionals):
        raise UsageError(f"{command.name} takes {len(command.positionals)} words, not {len(out.positionals)}")
    return out


@dataclass
class Context:
    spark: SparkSession
    args: Parsed
    report: Report
    settings: config.Settings
    _snapshot: Snapshot | None = None
    _expanded: bool = False

    @property
    def snapshot(self) -> Snapshot:
        """Opened when first needed."""
        if self._snapshot is None:
            asked = self.args.get("db") or self.args.get("snapshot") or self.settings.snapshot
            current = catalog.list_fingerprint(self.mod_list) if self.mod_list and not asked else None
            prints = catalog.list_fingerprints(self.spark, self.known) if current and len(self.known) > 1 else None
            path, why = catalog.choose(self.known, self.args.get("db"), self.args.get("snapshot"), self.settings.snapshot, prints, current)
            self._snapshot = open_snapshot(self.spark, path)
            if why not in ("path", "name"):
                self.report.note(Kind.SNAPSHOT, f"snapshot {path} ({why})")
            for text, mods in self.stale(self._snapshot):
                self.report.defer(Notice(Kind.STALENESS, text), mods)
        return self._snapshot

    @cached_property
    def known(self) -> dict[str, str]:
        return catalog.snapshots(self.settings.home, self.settings.aliases)

    @cached_property
    def mod_list(self) -> list[str] | None:
        """The ids of the present mod list, if the settings name its file."""
        path = self.settings.mod_list
        return config.read_mod_list(path).ids if path and os.path.isfile(path) else None

    @cached_property
    def others(self) -> dict[str, Snapshot]:
        """The other snapshots, opened when a probe needs them."""
        here = os.path.abspath(self.snapshot.path or "")
        return {name: open_snapshot(self.spark, path) for name, path in self.known.items() if os.path.abspath(path) != here}

    def stale(self, s: Snapshot) -> list[tuple[str, set[str]]]:
        content = catalog.content_scan(config.installed(self.settings.mods)) if self.settings.mods else None
        return catalog.staleness(s, self.mod_list, self.settings.version, content)

    @property
    def scope(self):
        if not self.args.get("mods"):
            return None
        universe = [r.package_id for r in lookup.mods(self.snapshot).take().collect()]
        found = parse(self.args.get("mods"), universe, self.settings.groups, self.settings.official)
        if not self._expanded:
            self._expanded = True
            asked = self.args.get("mods").strip()
            if asked.lstrip("-").lower() in {n.lower() for n in self.known}:
                self.report.note(Kind.SNAPSHOT, f"{asked} is also a snapshot's name; here it is a scope of mods")
            if found.ids is not None and sorted(found.ids) != [asked]:
                self.report.note(Kind.FILTER, f"the scope {asked} is {name_list(sorted(found.ids))}", total=len(found.ids))
        return found

    def within(self) -> str:
        """M8: the options that narrow a count, as they were given."""
        given = [f"--{o} {', '.join(v) if isinstance(v, list) else v}" for o in NARROWING if (v := self.args.get(o))]
        return f" within {' '.join(given)}" if given else ""

    @property
    def limit(self):
        given = self.args.get("limit")
        if given and given.isdigit() and int(given) > MAX_LIMIT:
            self.report.note(Kind.CLAMP, f"limit {given} is taken as {MAX_LIMIT}")
        return limit_of(given)

    @property
    def offset(self) -> int:
        return offset_of(self.args.get("offset"))

    def word(self, i: int = 0) -> str | None:
        return self.args.positionals[i] if i < len(self.args.positionals) else None

    def need(self, i: int, what: str) -> str:
        value = self.word(i)
        if not value:
            raise UsageError(f"{what} is missing")
        return value

    def page(self, key: str, page, noun: str, columns: list[str] | None = None) -> int:
        """A page of rows and its notice; returns the total."""
        total = page.total()
        shown = self.report.table(key, page.take(self.limit, self.offset), columns, "source_mod")
        self.told(shown, total, noun)
        return total

    def told(self, shown: int, total: int, noun: str, at_least: bool = False) -> None:
        """The notice of a page, with what it was narrowed by."""
        notice = page_notice(shown, total, noun, at_least)
        notice.text += self.within()
        self.report.add(notice)

    def explain(self, finding) -> None:
        if finding:
            self.report.note(Kind.NEXT, finding.text + (f": {name_list(list(finding.names))}" if finding.names else ""))

    def excluded(self, page_of: Callable, noun: str) -> None:
        """How many rows the same query has in what a pure exclusion leaves out."""
        rest = self.scope.complement() if self.scope else None
        if rest and (n := page_of(rest).total()):
            self.report.note(Kind.FILTER, f"in the excluded mods: {counted(n, noun)}", total=n)


def run_search(c: Context) -> None:
    query = c.need(0, "query")
    if not effective_terms(query):
        raise UsageError(f"nothing in {query!r} can be searched for")
    stage, page, total = search.cascade(c.snapshot, query, c.scope, c.args.get("type"), c.limit, c.offset)
    shown = c.report.table("results", page)
    c.told(shown, total, "match")
    if stage in ("original", "fuzzy"):
        c.report.note(Kind.ADVISORY, {"original": "found by the originals of texts", "fuzzy": "found by names that are like it"}[stage])
    if not total:
        for finding in triage.locate(c.snapshot, query, c.scope, c.others):
            c.explain(finding)
    elif finding := triage.outside_texts(c.snapshot):
        c.report.note(Kind.ADVISORY, finding.text)


def run_get(c: Context) -> None:
    name = c.need(0, "name")
    rows = lookup.named(c.snapshot, name)
    if c.args.get("type"):
        rows = rows.where(F.col("def_type") == c.args.get("type"))
    first = rows.orderBy("id").first()
    if first is None:
        for finding in triage.locate(c.snapshot, name, c.scope, c.others):
            c.explain(finding)
        c.report.note(Kind.NEXT, "names like it: " + name_list(search.closest(c.snapshot.defs.select("def_name"), name)))
        return
    parts = triage.entity(c.snapshot, first.id, c.args.get("path-contains"), bool(c.args.get("defaults")), c.limit)
    for key, df in parts.items():
        c.report.table(key, df)
    if not next(e for e in c.report.entries if isinstance(e, Block) and e.key == "fields").rows and (filters := c.args.get("path-contains")):
        for text in filters:  # M11: the index holds values only; they may live deeper, or in a nested class
            below = reverse.paths_below(c.snapshot, text, c.scope).take(3).collect()
            if below:
                c.report.note(Kind.BOUNDARY, f"{text} holds no value itself; elsewhere values are below it: {name_list([r.path for r in below])}")
    if finding := search_source(c, first.def_type):
        c.report.note(Kind.ADVISORY, finding)


def search_source(c: Context, name: str) -> str | None:
    """C11: where a type's source is, if there is a corpus."""
    if not c.settings.sources or not os.path.isdir(c.settings.sources):
        return None
    found = corpus.in_source(corpus.read_files(c.spark, c.settings.sources), name).orderBy("file").limit(3).collect()
    return f"{name} is declared in {name_list([r.file for r in found])}" if found else None


def run_where(c: Context) -> None:
    path = PathQuery(c.need(0, "path"), bool(c.args.get("exact-path")))
    value, exact = c.word(1), bool(c.args.get("exact"))
    if value == "":
        raise UsageError("the value is empty")
    page, counts = reverse.find_by_field(c.snapshot, path, value, exact, c.scope)
    n = counts.first()
    shown = c.report.table("matches", page.take(c.limit, c.offset))
    c.told(shown, n.matches, "row")
    c.report.note(Kind.COUNT, f"in {counted(n.defs, 'entity')}", total=n.defs)
    if n.matches:
        for finding in triage.advisories(c.snapshot, path, value, exact, c.scope, n.matches):
            c.report.note(Kind.ADVISORY, finding.text + (f": {name_list(list(finding.names))}" if finding.names else ""))
    else:
        c.explain(triage.where_triage(c.snapshot, path, value, exact, c.scope))
        if names := triage.elsewhere(c.others, lambda o: reverse.matching(o, path, value, exact)):
            c.report.note(Kind.NEXT, f"other snapshots have it: {name_list(names)}")
    c.excluded(lambda rest: reverse.find_by_field(c.snapshot, path, value, exact, rest)[0], "row")


def run_list(c: Context) -> None:
    if not c.word():
        c.page("types", lookup.types(c.snapshot, c.scope), "type")
        return
    build = lambda scope: lookup.list_by_type(c.snapshot, c.word(), scope, c.args.get("class"), c.args.get("name-like"))
    if not c.page("defs", build(c.scope), "entity", ["def_name", "label", "class", "source_mod"]):
        c.explain(triage.list_triage(c.snapshot, c.word(), c.scope, c.args.get("class"), c.args.get("name-like"), c.offset))
    c.excluded(build, "entity")


def run_fields(c: Context) -> None:
    page, _ = reverse.paths_of_type(c.snapshot, c.need(0, "type"), c.args.get("path-contains"))
    c.page("fields", page, "path")


def run_values(c: Context) -> None:
    path = PathQuery(c.need(0, "path"), bool(c.args.get("exact-path")))
    if not c.page("values", reverse.distinct_values(c.snapshot, path, c.scope, c.args.get("type")), "value"):
        c.explain(triage.values_triage(c.snapshot, path, c.scope, c.args.get("type")))
        return
    for key, page in zip(("paths", "types"), reverse.value_coverage(c.snapshot, path, c.scope, c.args.get("type"))[:2], strict=True):
        c.report.table(key, page.take(c.limit))


def run_mods(c: Context) -> None:
    c.page("mods", lookup.mods(c.snapshot), "mod")


def run_inherit(c: Context) -> None:
    name = c.need(0, "name")
    chain, end = graph.ancestors(c.snapshot, name)
    c.report.add(Block("ancestors", ["hop", "name"], list(enumerate(chain, 1))))
    c.report.note(Kind.BOUNDARY, f"the chain ends: {end}")
    c.page("children", lookup.nodes_below(c.snapshot, name), "child", ["def_type", "name", "def_name", "abstract"])
    for text in c.args.get("path-contains") or []:
        rows = graph.witness_table(c.snapshot, name, text)
        c.report.add(Block(f"witnesses of {text}", ["layer", "value", "descendants", "with_path", "same_value", "truncated"], [tuple(r[k] for k in ("layer", "value", "descendants", "with_path", "same_value", "truncated")) for r in rows]))


def run_keyed(c: Context) -> None:
    placeholders = bool(c.args.get("placeholders"))
    if not c.word():
        c.page("keyed", keyed.all_texts(c.snapshot, placeholders), "text")
        return
    how, page = keyed.lookup(c.snapshot, c.word(), placeholders)
    if not c.page("keyed", page, "text", ["key", "translated", "original", "origin", "placeholder"]):
        c.report.note(Kind.NEXT, "keys like it: " + name_list(search.closest(keyed.all_keys(c.snapshot), c.word())))
    elif how == "key":
        more = keyed.prefix_siblings(c.snapshot, c.word())
        if n := more.total():
            c.report.note(Kind.ADVISORY, f"{n} other keys begin so: {name_list([r.key for r in more.take(3).collect()])}")


def run_code_search(c: Context) -> None:
    files = corpus.read_files(c.spark, c.settings.sources or ".")
    pattern, glob = c.need(0, "pattern"), c.args.get("glob")
    if wanted := c.args.get("source"):
        files = files.where(F.lower("tree").isin(*[w.lower() for w in wanted]))
    most = int(c.args.get("max-files") or MAX_FILES)
    files, more = corpus.bounded(files, most)
    matches = corpus.search(files, pattern, bool(c.args.get("ignore-case")), glob)
    n = corpus.match_counts(matches).first()
    page = corpus.shown(matches, limit=c.limit)
    k = int(c.args.get("context") or 0)
    rows = corpus.with_context(files, page, k).orderBy(corpus.tree_order(), "tree", "file", "line") if k else page
    shown = c.report.table("lines", rows)
    if k:
        shown = page.count()
    c.told(shown, n.lines, "line", more)
    c.report.note(Kind.COUNT, ("at least " if more else "") + f"in {counted(n.files, 'file')}", total=n.files)
    if not n.lines:
        for hint in [*corpus.pattern_hints(pattern), *filter(None, [corpus.glob_hint(glob) if glob else None])]:
            c.report.note(Kind.NEXT, hint)
    elif c.args.get("texts"):  # C5: of the lines that are shown
        c.report.table("texts", corpus.resolve_keys(page, c.snapshot.keyed).orderBy("key"))
        if loose := corpus.assembled(page).first().n:
            c.report.note(Kind.BOUNDARY, f"{counted(loose, 'line')} put the key together at run time")


def run_read(c: Context) -> None:
    files = corpus.read_files(c.spark, c.settings.sources or ".")
    found = corpus.resolve_file(files, c.need(0, "file")).orderBy("tree", "file").limit(10).collect()
    if len(found) != 1:
        c.report.note(Kind.BOUNDARY, "no such file" if not found else "several files: " + name_list([f.file for f in found], 10))
    elif c.args.get("outline"):
        c.report.table("outline", corpus.outlines(files.where(F.col("file") == found[0].file)).orderBy("first"))
    elif c.args.get("member"):
        c.report.table("lines", corpus.member(files.where(F.col("file") == found[0].file), c.args.get("member")).orderBy("line").limit(corpus.MAX_LINES))
    else:
        c.report.table("lines", corpus.read_lines(files, found[0].file, c.args.get("lines")).orderBy("line"), ["line", "text"])


def run_snapshots(c: Context) -> None:
    known = catalog.snapshots(c.settings.home, c.settings.aliases)
    c.report.add(Block("snapshots", ["name", "path"], list(known.items())))


def run_status(c: Context) -> None:
    c.report.table("meta", c.snapshot.meta.orderBy("key"))
    if not c.stale(c.snapshot):
        compared = [what for what, given in (("mod list", c.mod_list), ("version", c.settings.version), ("mods' files", c.settings.mods)) if given]
        c.report.note(Kind.STALENESS, f"nothing has changed since the snapshot: {', '.join(compared)}" if compared else "nothing is known to compare the snapshot with")
    c.report.table("counts", lookup.counts(c.snapshot))


def run_use(c: Context) -> None:
    """Pins a snapshot in the settings file."""
    name = c.need(0, "name")
    path, _ = catalog.choose(c.known, name=name)
    config.pin(c.settings.file or "lodestone.toml", name)
    c.report.add(Block("snapshots", ["name", "path"], [(name, path)]))
    c.report.note(Kind.SNAPSHOT, f"{name} is used from now on")


def run_truncated(c: Context) -> None:
    c.page("truncated", lookup.truncated(c.snapshot, c.scope, c.args.get("type"), c.args.get("name-like")), "entity", ["def_type", "def_name", "fields_truncated"])


def run_import(c: Context) -> None:
    """With a folder of mods, their language files are harvested and their files' fingerprints kept."""
    from lodestone.sources.jsonl import import_export, peek
    from lodestone.sources.languages import harvest

    source, target = c.need(0, "file"), c.need(1, "target")
    harvested = content = None
    if mods := config.installed(c.settings.mods):
        meta = peek(c.spark, source)
        listed = {m[0].lower() for m in meta.mods}
        harvested = harvest(c.spark, mods, meta.language, listed)
        content = catalog.content_scan({k: v for k, v in mods.items() if k in listed})
        c.report.note(Kind.COUNT, f"{counted(harvested['keyed'].count(), 'text')} and {counted(harvested['translations'].count(), 'translation')} harvested from {counted(len(mods), 'mod')}")
    c._snapshot = import_export(c.spark, source, target, harvested, content)
    c.report.table("counts", lookup.counts(c.snapshot))


def run_sources(c: Context) -> None:
    """The source trees that mods bring, against those that were built."""
    states = catalog.reconcile(catalog.source_plan(config.installed(c.settings.mods)), catalog.source_manifest(c.settings.sources or "."))
    for name, state in states.items():
        c.report.item("sources", tree=name, state=state)
    for state in dict.fromkeys(states.values()):
        c.report.note(Kind.COUNT, f"{list(states.values()).count(state)} {state}")


def run_sync(c: Context) -> None:
    if not c.settings.sources:
        raise UsageError("the settings name no folder of sources")
    for name in catalog.sync_sources(config.installed(c.settings.mods), c.settings.sources):
        c.report.item("sources", tree=name, state="current")


def run_mod_lists(c: Context) -> None:
    good, bad = config.mod_lists(c.need(0, "folder"))
    rows = config.lists_with(good, c.word(1)) if c.word(1) else {m.name: m.ids for m in good}
    c.report.add(Block("lists", ["name", "mods"], [(k, len(v)) for k, v in rows.items()]))
    for name in bad:
        c.report.note(Kind.BOUNDARY, f"{name} is damaged")


def run_mod_list(c: Context) -> None:
    found = config.read_mod_list(c.need(0, "file"))
    here = {r.package_id.lower() for r in lookup.mods(c.snapshot).take(None).collect()} if c.args.get("snapshot") or c.args.get("db") else None
    rows = [(i, mod, name, None if here is None else mod.lower() in here) for i, (mod, name) in enumerate(zip(found.ids, found.names, strict=True), 1)]
    c.report.add(Block("mods", ["place", "mod", "name", "in snapshot"], rows))


def run_save_list(c: Context) -> None:
    """The snapshot's mods, or the present list, as a mod list file; with --needs, what mods need is put in before them."""
    file = c.need(0, "file")
    rows = [(r.package_id, r.name) for r in lookup.mods(c.snapshot).take(None).collect()]
    ids, names = [i for i, _ in rows], dict(rows)
    needs: dict[str, list[str]] = {}
    for given in c.args.get("needs") or []:
        mod, _, need = given.partition(":")
        needs.setdefault(mod.lower(), []).append(need)
    ids = catalog.with_dependencies(ids, needs)
    config.write_mod_list(file, config.ModList(os.path.basename(file), ids, [names.get(i) for i in ids]))
    c.report.add(Block("lists", ["name", "mods"], [(file, len(ids))]))


def run_docs(c: Context) -> None:
    for command in COMMANDS.values():
        c.report.item("commands", command=" ".join([command.name, *(f"<{p}>" for p in command.positionals)]), what=command.help)
    c.report.note(Kind.NEXT, markdown())


TYPE = Option("type", "entities of this type", short="t")
PATHS = Option("path-contains", "paths that contain this", "multi")
LIKE = Option("name-like", "names or labels that contain this")
EXACT_PATH = Option("exact-path", "the whole path", "flag")

COMMANDS = {
    c.name: c
    for c in (
        Command("search", "entities by words", run_search, ("query",), (TYPE,), ("results",)),
        Command("get", "one entity", run_get, ("name",), (TYPE, PATHS, Option("defaults", "show default values", "flag")), ("identity", "fields")),
        Command("where", "entities by field and value", run_where, ("path", "value"), (EXACT_PATH, Option("exact", "just this value", "flag")), ("matches",)),
        Command("list", "types, or a type's entities", run_list, ("type",), (Option("class", "of this class"), LIKE), ("defs",)),
        Command("fields", "a type's paths", run_fields, ("type",), (PATHS,), ("fields",)),
        Command("values", "a field's values", run_values, ("path",), (TYPE, EXACT_PATH), ("values",)),
        Command("mods", "the mods in load order", run_mods, (), (), ("mods",)),
        Command("inherit", "what an entity inherits from", run_inherit, ("name",), (PATHS,), ("ancestors", "children")),
        Command("keyed", "UI texts", run_keyed, ("key",), (Option("placeholders", "untranslated ones", "flag"),), ("keyed",)),
        Command("code-search", "source lines by pattern", run_code_search, ("pattern",), (Option("ignore-case", "ignore case", "flag", "i"), Option("glob", "files"), Option("context", "lines around each", short="C"), Option("source", "of this tree", "multi"), Option("max-files", "files at most"), Option("texts", "the UI texts that the lines ask for", "flag")), ("lines",), False),
        Command("read", "a source file", run_read, ("file",), (Option("lines", "a-b, a+n, a, all"), Option("outline", "declarations", "flag"), Option("member", "one declaration")), ("lines",), False),
        Command("snapshot list", "snapshots", run_snapshots, (), (), ("snapshots",), False),
        Command("snapshot use", "use a snapshot from now on", run_use, ("name",), (), ("snapshots",), False),
        Command("sources list", "source trees and their state", run_sources, (), (), ("sources",), False),
        Command("sources sync", "copy what is stale or missing", run_sync, (), (), ("sources",), False),
        Command("modlist show", "the mods of a list", run_mod_list, ("file",), (), ("mods",), False),
        Command("modlist save", "the snapshot's mods as a list", run_save_list, ("file",), (Option("needs", "mod:needed, put in before it", "multi"),), ("lists",)),
        Command("docs", "all commands, in Markdown", run_docs, (), (), ("commands",), False),
        Command("snapshot status", "a snapshot's facts", run_status, (), (), ("meta",)),
        Command("snapshot truncated", "entities with dropped fields", run_truncated, (), (Option("type", "of these types", "multi", "t"), LIKE), ("truncated",)),
        Command("snapshot import", "import an export", run_import, ("file", "target"), (), ("counts",), False),
        Command("modlist list", "mod lists in a folder", run_mod_lists, ("folder", "text"), (), ("lists",), False),
    )
}


def markdown() -> str:
    """M7: the reference of all commands in Markdown, from what the parser reads."""
    out = ["# Commands"]
    for c in COMMANDS.values():
        out += [f"\n## {c.name}", f"\n{c.help}: `{' '.join([c.name, *(f'<{p}>' for p in c.positionals)])}`", "\n| Option | |", "|---|---|"]
        out += [f"| `--{o.name}`" + (f", `-{o.short}`" if o.short else "") + f" | {o.help} |" for o in (*c.options, *COMMON)]
        if c.keys:
            out.append(f"\nKeys of the JSON answer: {', '.join(f'`{snake(k)}`' for k in c.keys)}")
    return "\n".join(out)


def help_text() -> str:
    """All commands and options, from what the parser reads."""
    out = []
    for c in COMMANDS.values():
        out.append(f"{c.name} {' '.join(f'<{p}>' for p in c.positionals)}".rstrip() + f": {c.help}")
        out += [f"    --{o.name}" + (f", -{o.short}" if o.short else "") + f": {o.help}" for o in c.options]
    return "\n".join([*out, "everywhere:", *(f"    --{o.name}: {o.help}" for o in COMMON)])


def resolve(argv: list[str]) -> tuple[Command, list[str]]:
    """A command of two words before one of one."""
    for n in (2, 1):
        if (c := COMMANDS.get(" ".join(argv[:n]).lower())) and len(argv) >= n:
            return c, argv[n:]
    close = near(" ".join(argv[:1]).lower(), [k for c in COMMANDS for k in (c, c.split()[0])]) if argv else []
    raise UsageError(f"no command is called {' '.join(argv[:2])}" + (f"; did you mean {', '.join(dict.fromkeys(close))}?" if close else "") + "\n" + help_text())


def main(argv: list[str], spark: SparkSession | None = None, settings: config.Settings | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        command, rest = resolve(argv)
        args = parse_args(command, rest)
        context = Context(spark or SparkSession.builder.appName("lodestone").getOrCreate(), args, Report(promised=list(command.keys)), settings or config.load_settings("lodestone.toml"))
        command.run(context)
    except (UsageError, ScopeError, catalog.CatalogError, SnapshotError) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # what no user can mend
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 70
    print(context.report.json() if args.get("json") else context.report.text(), file=out)
    return 0 if context.report.found else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
