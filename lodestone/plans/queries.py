"""Named queries over the test tables, each with the DuckDB SQL that it must agree with.

A name begins with the operator's number in the inventory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.model import Snapshot
from lodestone.operators import catalog, corpus, graph, keyed, lookup, reverse, search
from lodestone.operators.paging import Page
from lodestone.plans import scope as scopes
from lodestone.plans.predicates import PathQuery, ValueMatch, any_contains, class_condition, type_condition, types_condition, value_condition
from lodestone.sources.build import resolve_owners
from lodestone.sources.flatten import flatten
from lodestone.sources.tables import duckdb_tables, snapshot_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TABLES = duckdb_tables()
_TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_WORDS = r"trim(concat_ws(' ', {0}, array_to_string(list_filter(regexp_split_to_array(regexp_replace({0}, '([^\p{{Lu}}_\-. ])(\p{{Lu}})', '\1 \2', 'g'), '[_\-. ]+'), lambda x: length(x) > 1), ' ')))"


def _index(name: str, source: str, columns: list[str]) -> str:
    """CTEs <name> (doc_id, k, term, p) and <name>_len (doc_id, d)."""
    parts = " union all ".join(f"select id doc_id, {k} k, unnest(t) term, unnest(range(len(t))) p from (select id, {_TOKENS.format(c)} t from {source})" for k, c in enumerate(columns))
    return f"{name} as ({parts}), {name}_len as (select s.id doc_id, count(i.term)::double d from {source} s left join {name} i on i.doc_id = s.id group by 1)"


def _bm25(index: str, phrases: list[str], weights: tuple[float, ...]) -> str:
    """CTE <index>_score: phrases are conditions on term."""
    w = "case k " + " ".join(f"when {k} then {x}" for k, x in enumerate(weights)) + " end"
    hits = " union all ".join(f"select {i} ph, doc_id, sum({w})::double f from {index} where {c} group by doc_id" for i, c in enumerate(phrases))
    return (
        f"{index}_hits as ({hits}), {index}_n as (select ph, count(*) n from {index}_hits group by 1), {index}_all as (select count(*) nd, avg(d) mean from {index}_len), "
        f"{index}_score as (select h.doc_id, sum(-greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) score "
        f"from {index}_hits h join {index}_n using (ph) join {index}_len l using (doc_id), {index}_all group by 1 having count(*) = {len(phrases)})"
    )


INDEXED = f"named as (select d.id, {_WORDS.format('d.def_name')} def_name, coalesce(d.label, '') label, coalesce(d.description, '') description, coalesce(t.translated, '') translated from defs d left join (select id, array_to_string(list_sort(list_distinct(list(translated))), ' ') translated from (select def_id id, translated from translations where def_id is not null union all select d.id, translated from translations t join defs d using (def_name) where t.def_id is null) group by 1) t using (id)), " + _index("ix", "named", ["def_name", "label", "description", "translated"])
KEYED_INDEXED = f"named_keys as (select id, {_WORDS.format('key')} key, coalesce(translated, '') translated, coalesce(original, '') original from keyed), " + _index("kx", "named_keys", ["key", "translated", "original"])


def _needed(sql: str) -> str:
    """The CTEs that a query uses, in their order."""
    used: set[str] = set()
    todo = sql
    while True:
        new = {t for t in _TABLES if t not in used and re.search(rf"\b{t}\b", todo)}
        if not new:
            break
        used |= new
        todo = " ".join(_TABLES[t] for t in new)
    return ", ".join(f"{t} as ({_TABLES[t]})" for t in _TABLES if t in used)


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers a query; sql may use the snapshot's tables and further CTEs."""

    def register(f: Callable[[Snapshot], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(snapshot_of(spark, sf_dir))
        if sql is not None:
            head = ", ".join(x for x in (_needed(ctes + " " + sql), ctes) if x)
            SQL[name] = f"with {'recursive ' * recursive}{head} {sql}" if head else sql
        return f

    return register


def scope_of(s: Snapshot, expression: str) -> scopes.Scope:
    """A scope over the snapshot's mods. The mod list is small by nature: an entity's mod is one of a game's."""
    return scopes.parse(expression, [r.package_id for r in s.mods.orderBy("ordinal").collect()], official="geo.")


def files_of(s: Snapshot) -> DataFrame:
    """The documents as a tree of source files: a tree for each language."""
    return s.translations.select(F.col("language").alias("tree"), F.concat(F.col("path"), F.lit("/"), F.col("def_name"), F.lit(".cs")).alias("file"), F.col("translated").alias("text"))


FILES = "files as (select language tree, concat(path, '/', def_name, '.cs') as file, translated as text from translations), lines as (select tree, file, unnest(range(1, len(l) + 1)) line, unnest(l) as text from (select tree, file, string_split(text, chr(10)) l from files))"

# Predicates

query("p1_like_escape", "select def_id, path from f where value like '%\\%%' escape '\\' or lower(value) like '%/_%' escape '/'")(lambda s: s.facts.where(F.col("value_fold").like("%" + paths.like_escape("%") + "%") | F.col("value_fold").like("%" + paths.like_escape("_") + "%")).select("def_id", "path"))
query("p2_path_exact", "select def_id, value from f where lower(path) = 'stats[0].value'")(lambda s: s.facts.where(PathQuery("Stats[0].VALUE", exact=True).condition()).select("def_id", "value"))
query("p2q_path_any_index", "select def_id, path, value from f where lower(path) like 'stats[%].value'")(lambda s: s.facts.where(PathQuery("stats[].value", exact=True).condition()).select("def_id", "path", "value"))
query("p2_path_suffix", "select def_id, path, value from f where lower(path) like '%s[1].value'")(lambda s: s.facts.where(PathQuery("s[1].value").condition()).select("def_id", "path", "value"))
query("p2_path_leaf", "select def_id, path, value from f where lower(leaf) = 'acctbal'")(lambda s: s.facts.where(PathQuery("acctBal").condition()).select("def_id", "path", "value"))
query("p3_value_substring", "select def_id, path from f where lower(value) like '%brand#1%'")(lambda s: s.facts.where(value_condition("brand#1", ValueMatch.SUBSTRING)).select("def_id", "path"))
query("p3_value_exact", "select def_id, path from f where lower(value) = 'brand#1'")(lambda s: s.facts.where(value_condition("BRAND#1", ValueMatch.EXACT)).select("def_id", "path"))
query("p3_value_identifier", "select def_id, path from f where lower(value) = 'building' or lower(value) like '%.building'")(lambda s: s.facts.where(value_condition("Building", ValueMatch.IDENTIFIER)).select("def_id", "path"))
query("p4_scope", "select id from defs where source_mod in ('geo.ASIA', 'Brand#7')")(lambda s: scopes.scoped(s.defs, scope_of(s, "asia,brand#7")).select("id"))
query("p5_type", "select id from defs where def_type = 'part'")(lambda s: s.defs.where(type_condition("PART")).select("id"))
query("p6_class", "select id from defs where lower(class) = 'building' or lower(class) like '%.building'")(lambda s: s.defs.where(class_condition("Building")).select("id"))
query("p7_any_contains", "select def_id, path from f where lower(path) like '%tax%' or lower(path) like '%comp%'")(lambda s: s.facts.where(any_contains("path_fold", ["Tax", "comp"])).select("def_id", "path"))
query("p8_whole_segments", "select def_id, path from f where regexp_matches(lower(path), '(^|\\.)(stats|k)($|\\.|\\[)')")(lambda s: s.facts.where(paths.whole_segments("path", ["Stats", "k"])).select("def_id", "path"))
query("p10_types_with_case", "select id from defs where def_type in ('part', 'Nation')")(lambda s: s.defs.where(types_condition(["part", "Nation"])).select("id"))

# Ingest


def _flat(s: Snapshot) -> DataFrame:
    """Nations as nested rows, flattened."""
    rows = s.defs.where("def_type = 'nation'").select("def_name", F.struct("label", F.col("source_mod").alias("mod")).alias("s"), F.array("class", "label").alias("l"))
    defs, values = flatten(rows, "nation", "def_name")
    return values.join(defs.select(F.col("id").alias("def_id"), "def_name"), "def_id").select("def_name", "path", "value", "is_default")



query("s4_facts", "select def_id, seq::int seq, path, leaf, value, is_default::tinyint is_default from f")(lambda s: s.facts.select("def_id", "seq", "path", "leaf", "value", "is_default"))
query("s5_nodes", "select * from xml_nodes")(lambda s: s.xml_nodes.drop("name_fold", "parent_name_fold", "def_name_fold"))
query("s14_flatten", "select def_name, path, value, 2::tinyint is_default from (select def_name, c.path path, c.value as value from (select def_name, unnest([{'path': 's.label', 'value': label}, {'path': 's.mod', 'value': source_mod}, {'path': 'l[0]', 'value': class}, {'path': 'l[1]', 'value': label}]) c from defs where def_type = 'nation'))")(lambda s: _flat(s))
query("s6_owner", "select t.def_name, t.path, case when count(d.id) = 1 then min(d.id) when count(d.id) filter (d.def_type = t.def_type) = 1 then min(d.id) filter (d.def_type = t.def_type) end def_id from (select distinct 'part' def_type, p_name def_name, 'label' path from part union all select 'nation', n_name, 'label' from nation union all select 'orders', 'nobody', 'label') t left join defs d using (def_name) group by t.def_name, t.path, t.def_type")(
    lambda s: resolve_owners(
        s.defs.where("def_type in ('part', 'nation')").select("def_type", "def_name").distinct().union(s.spark.sql("select 'orders', 'nobody'")).withColumn("path", F.lit("label")), s.defs
    ).select("def_name", "path", "def_id")
)
query("s8_postings", "select doc_id, term, count(*)::bigint n from ix group by all", INDEXED)(lambda s: s.postings.where("term is not null").select("doc_id", "term", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")))
query("a1_shared_values", "select v.def_type, path, value, n::bigint defs from (select def_type, path, value, count(distinct def_id) n from f where is_default <> 1 group by all having n >= 8) v join (select def_type, count(*) t from defs group by 1) using (def_type) where 2 * n > t")(lambda s: s.shared_values)

# Lookups

query("l1_types", "select def_type, count(*) n from defs group by 1 order by 2 desc, 1")(lambda s: lookup.types(s).take())
query("l2_names", "select def_name from defs where source_mod like 'geo.%'")(lambda s: lookup.all_names(s, scope_of(s, "core")))
query("l3_named", "select id, def_type from defs where lower(def_name) = 'red widget'")(lambda s: lookup.named(s, "RED Widget").select("id", "def_type"))
query("l4_by_names", "select id, def_name from defs where lower(def_name) in ('nation_7', 'red bolt', 'order#11')")(lambda s: lookup.by_names(s, ["Nation_7", "red bolt", "NATION_7", "order#11"]).take().select("id", "def_name"))
query("l5_list", "select id, def_name from defs where def_type = 'customer' and class = 'Seg.BUILDING' and (lower(def_name) like '%7%' or lower(label) like '%7%') order by def_name, id limit 25 offset 5")(lambda s: lookup.list_by_type(s, "Customer", None, "building", "7").take(25, 5).select("id", "def_name"))
query("l6_fields", "select path, value, is_default::tinyint is_default from f where def_id = 5000000000007 and lower(path) like '%lines%' and is_default <> 1")(lambda s: lookup.fields(s, 5000000000007, ["Lines"])[0].take().select("path", "value", "is_default"))
query("l6_field_counts", "select count(*) filter (lower(path) like '%lines%') matched, count(*) total, count(*) filter (lower(path) like '%lines%' and is_default = 1) defaulted from f where def_id = 5000000000007")(lambda s: lookup.fields(s, 5000000000007, ["lines"])[1])
query("l7_value_hits", "select count(*) filter (lower(value) like '%1%') hits from f where def_id = 5000000000007")(lambda s: lookup.value_hits(s, 5000000000007, "1"))
query("l8_truncated", "select id, fields_truncated from defs where fields_truncated > 0 and def_type in ('orders')")(lambda s: lookup.truncated(s, None, ["orders", "PART"]).take().select("id", "fields_truncated"))
query("l9_counts", "select (select count(*) from defs) defs, (select count(*) from defs where fields_truncated > 0) truncated, (select count(*) from keyed) keyed, (select count(*) from xml_nodes) nodes")(lookup.counts)
query("l10_mods", "select * from mods")(lambda s: lookup.mods(s).take())
query("l11_page", "select id from defs order by def_name, id limit 100 offset 50")(lambda s: Page(s.defs, [F.asc("def_name"), F.asc("id")]).take(100, 50).select("id"))
query("l13_texts", "select path, translated, origin from translations where def_id = 5000000000003")(lambda s: lookup.translations_of(s, 5000000000003).take().select("path", "translated", "origin"))
query("l14_texts_outside", "select count(distinct def_name) n from translations where origin = 'harvested_outside'")(lookup.translations_outside)
query("l15_nodes_named", "select id, parent_name from xml_nodes where lower(name) = 'nation_5' or lower(def_name) = 'nation_5'")(lambda s: lookup.nodes_named(s, "nation_5").take().select("id", "parent_name"))
query("l15_nodes_below", "select id, def_name from xml_nodes where lower(parent_name) = 'nation_5'")(lambda s: lookup.nodes_below(s, "NATION_5").take().select("id", "def_name"))

# Reverse lookups and profiles

TAX = PathQuery("tax")
query("r1_find_rows", "select def_id, path, value, is_default::tinyint is_default from f where lower(leaf) = 'tax' and lower(value) = '0.00'")(lambda s: reverse.find_by_field(s, TAX, "0.00", exact=True)[0].take().select("def_id", "path", "value", "is_default"))
query("r1_find_counts", "select count(*) matches, count(distinct def_id) defs from f where lower(leaf) = 'tax' and value like '%0.0%'")(lambda s: reverse.find_by_field(s, TAX, "0.0")[1])
query("r2_shapes", "select shape, count(*) n from f where lower(leaf) = 'value' group by 1")(lambda s: reverse.path_shapes(s, PathQuery("value")).take())
query("r3_generated", "select distinct def_name from f where lower(leaf) = 'tax' and value = '0.00' and generated")(lambda s: reverse.generated_defs(s, TAX, "0.00", exact=True)[0])
query("r3_generated_count", "select count(distinct def_id) defs from f where lower(leaf) = 'tax' and value = '0.00' and generated")(lambda s: reverse.generated_defs(s, TAX, "0.00", exact=True)[1])
query("r4_type_defs_with_path", "select count(distinct def_id) defs, count(distinct path) paths from f where def_type = 'orders' and (lower(path) like '%part%' or lower(path) like '%flag%')")(lambda s: reverse.type_defs_with_path(s, "orders", ["part", "Flag"]))
query("r5_paths_of_type", "select path, count(*) n from f where def_type = 'orders' group by 1")(lambda s: reverse.paths_of_type(s, "orders")[0].take())
query("r5_path_counts", "select count(distinct path) paths, count(distinct path) filter (regexp_matches(lower(path), '(^|\\.)part($|\\.|\\[)')) whole from f where def_type = 'orders' and lower(path) like '%part%'")(lambda s: reverse.paths_of_type(s, "orders", ["part"])[1])
query("r6_coverage_paths", "select path, count(*) n from f where lower(leaf) = 'value' group by 1")(lambda s: reverse.value_coverage(s, PathQuery("value"))[0].take())
query("r6_coverage_types", "select def_type, count(distinct def_id) defs from f where lower(leaf) = 'value' group by 1")(lambda s: reverse.value_coverage(s, PathQuery("value"))[1].take())
query("r7_distinct_values", "select value, count(*) matches from f where lower(leaf) = 'quantity' group by 1")(lambda s: reverse.distinct_values(s, PathQuery("quantity")).take())
query("r8_paths_with_value", "select path, def_type, count(distinct def_id) defs, min(value) sample from f where value like '%12%' group by 1, 2")(lambda s: reverse.paths_with_value(s, "12")[0].take())
query("r8_value_counts", "select count(*) groups, count(*) filter (e) exact from (select path, def_type, bool_or(value = '12') e from f where value like '%12%' group by 1, 2)")(lambda s: reverse.paths_with_value(s, "12")[1])
query(
    "r9_value_elsewhere",
    "select shape, defs, others from (select *, max(rank) filter (rank <= 3 or (rank <= 6 and rough = bound)) over () take from (select *, max(rough) filter (rank = 3) over () bound from (select shape, defs, rough, row_number() over (order by rough desc, shape) rank, count(*) over () others from sh))) where rank <= take or others = take + 1",
    "hits as (select * from f where value like '%5%'), mine as (select * from hits where lower(leaf) = 'quantity'), oth as (select * from hits where def_type in (select def_type from mine) and shape not in (select shape from mine)), sh as (select shape, any_value(defs) defs, sum(n)::bigint rough from (select shape, path, count(distinct def_id) n from oth group by 1, 2) join (select shape, count(distinct def_id) defs from oth group by 1) using (shape) group by 1)",
)(lambda s: reverse.value_elsewhere(s, PathQuery("quantity"), "5"))
query("r10_paths_below", "select path, sum(n)::bigint defs, arg_min(def_type, (-n, def_type)) top_type from (select path, def_type, count(distinct def_id) n from f where regexp_matches(lower(path), '(^|\\.)(lines|props)(\\[[^\\]]*\\])*\\.') group by 1, 2) group by 1")(lambda s: Page(reverse.paths_below(s, "lines").rows.union(reverse.paths_below(s, "props").rows), [F.asc("path")]).take())
query("r11_path_exists", "select exists (select 1 from f where lower(leaf) = 'discount') yes, exists (select 1 from f where lower(leaf) = 'nothing') no")(lambda s: s.spark.createDataFrame([(reverse.path_exists(s, PathQuery("discount")), reverse.path_exists(s, PathQuery("nothing")))], "yes boolean, no boolean"))
query("r12_siblings", "select distinct leaf from f join (select distinct def_id, regexp_extract(path, '^(.*\\]\\.)', 1) block from f where lower(leaf) = 'stat' and value = 'Price') b using (def_id) where starts_with(path, block) and is_default <> 1 and not (lower(leaf) = 'stat' and value = 'Price')")(lambda s: reverse.authored_siblings(s, reverse.matching(s, PathQuery("stat"), "Price", exact=True)).rows.select("leaf"))
query("r13_shared_of", "select 'stats[1].stat' path, 'Price' as value, count(*) defs from defs where def_type = 'part' having count(*) >= 8")(lambda s: reverse.shared_of(s, "part", s.facts.where(F.col("def_id") == 4000000000001)))
query("r14_classes", "select class, count(*) n from defs where def_type = 'event' group by 1")(lambda s: reverse.classes_in_type(s, "Event").take())
query("r14_types_of_class", "select def_type, count(*) n from defs where lower(class) = 'f' or lower(class) like '%.f' group by 1")(lambda s: reverse.types_holding_class(s, "F").take())
query("r15_truncated_sharing", "select def_type, count(*) n from defs where fields_truncated > 0 and def_type in (select def_type from f where lower(leaf) = 'tax') group by 1")(lambda s: reverse.truncated_sharing(s, reverse.matching(s, TAX)).take())
query("a7_same_labels", "select label, def_type, count(*) n from defs where def_type in ('part', 'supplier') and label <> '' group by 1, 2 having count(*) > 1")(lambda s: reverse.same_label_groups(s.defs.where("def_type in ('part', 'supplier')")))
query("a8_hidden_indexes", "select distinct regexp_extract(path, '^([^\\]]*\\])', 1) prefix from f where def_id = 5000000000007 and path like '%]%' and regexp_extract(path, '^([^\\]]*\\])', 1) <> 'lines[0]'")(lambda s: reverse.hidden_indexes(s, 5000000000007, s.facts.where("def_id = 5000000000007 and path like 'lines[0]%'")))

# Text

query("t3_identifier_words", f"select distinct def_name, {_WORDS.format('def_name')} words from defs")(lambda s: s.defs.select("def_name", text.identifier_words("def_name").alias("words")).distinct())
query("t5_tokens", f"select doc_id, len({_TOKENS.format('text')})::int n, array_to_string({_TOKENS.format('text')}, ' ') tokens from documents")(lambda s: s.translations.select(F.substring_index("def_name", "#", -1).cast("long").alias("doc_id"), F.size(text.tokens("translated")).alias("n"), F.array_join(text.tokens("translated"), " ").alias("tokens")))
_SCORE = "cast(cast(round(score, 6) as decimal(18, 6)) as string) score"


def _score(c: str = "score") -> F.Column:
    return F.round(c, 6).cast("decimal(18,6)").cast("string").alias("score")


query("t8_search", f"select id, def_name, {_SCORE} from ix_score join defs on id = doc_id", INDEXED + ", " + _bm25("ix", ["starts_with(term, 'red')", "starts_with(term, 'wid')"], search.DEF_WEIGHTS))(lambda s: search.search_index(s, "red wid").take().select("id", "def_name", _score()))
query("t8_search_texts", f"select id, def_name, {_SCORE} from ix_score join defs on id = doc_id", INDEXED + ", " + _bm25("ix", ["starts_with(term, 'order')", "starts_with(term, 'ea')", "starts_with(term, 'que')"], search.DEF_WEIGHTS))(lambda s: search.search_index(s, "order éa que").take().select("id", "def_name", _score()))
query("t9_search_keyed", f"select id, key, {_SCORE} from kx_score join keyed on id = doc_id", KEYED_INDEXED + ", " + _bm25("kx", ["starts_with(term, 'assist')", "starts_with(term, 'the')"], search.KEYED_WEIGHTS))(lambda s: search.search_keyed(s, "assist the").take().select("id", "key", _score()))
query("t10_names_containing", "select id from defs where lower(def_name) like '%idge%' and id not in (select doc_id from ix where starts_with(term, 'idge'))", INDEXED)(lambda s: search.names_containing(s, "idge").take().select("id"))
query("t11_names_by_original", "select distinct def_name from defs where def_name in (select def_name from translations where original like '%de%')")(lambda s: search.names_by_original(s, "DE"))
query(
    "t12_fuzzy",
    "select * from (select def_name, case when n = q then 100.0 when starts_with(n, q) then 90.0 when e <= 2 and e <= length(q) * 0.3 then least(95.0 - 5 * e + case when abs(length(n) - length(q)) <= 1 then 3 else 0 end, 95.0) when len(list_filter(regexp_split_to_array(n, '[_.\\-\\s]+'), lambda w: starts_with(w, q))) > 0 then 80.0 when e <= 3 and 1 - e / greatest(length(n), length(q)) >= 0.75 then 70 * (1 - e / greatest(length(n), length(q))) end::double score from (select distinct def_name, lower(def_name) n, 'red widgte' q, levenshtein(lower(def_name), 'red widgte') e from defs where def_type = 'part')) where score >= 60",
)(lambda s: s.defs.where("def_type = 'part'").select("def_name").distinct().withColumn("score", text.fuzzy_score("def_name", "red widgte")).where("score >= 60"))
query("t17_cascade", "select id, def_name from ix_score join defs on id = doc_id", INDEXED + ", " + _bm25("ix", ["starts_with(term, 'small')", "starts_with(term, 'gizmo')"], search.DEF_WEIGHTS))(lambda s: search.cascade(s, "small gizmo", limit=None)[1].select("id", "def_name"))
_CJK_LETTERS = "'aeiourtn', '天地人火水木金土'"
query(
    "t2_cjk_pairs",
    f"select distinct def_name, case when regexp_matches(t, '[天地人火水木金土]') then t || array_to_string(list_transform(list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda b: regexp_matches(b, '^[天地人火水木金土]{{2}}$')), lambda b: ' ' || b), '') else t end pairs from (select def_name, translate(def_name, {_CJK_LETTERS}) t from defs)",
)(lambda s: s.defs.select("def_name", text.with_cjk_pairs(F.translate("def_name", "aeiourtn", "天地人火水木金土")).alias("pairs")).distinct())
query(
    "t6q_phrase",
    f"select id, def_name, {_SCORE} from px_score join defs on id = doc_id",
    INDEXED + ", px as (select a.doc_id, a.k, a.term || ' ' || b.term term, a.p from ix a join ix b on a.doc_id = b.doc_id and a.k = b.k and b.p = a.p + 1), px_len as (select * from ix_len), " + _bm25("px", ["starts_with(term, 'red wid')"], search.DEF_WEIGHTS),
)(lambda s: search.search_index(s, "red.wid").take(None).select("id", "def_name", _score()))


def _fuzzy(names: str, q: str) -> str:
    """def_name, score of the names (a table) that score 60 or more; for queries that open no initials."""
    few = 0.5 if len(q) <= 4 else 0.3
    return (
        f"select def_name, score from (select def_name, case when n = q then 100.0 when starts_with(n, q) then 90.0 when e <= 2 and e <= length(q) * {few} then least(95.0 - 5 * e + case when abs(length(n) - length(q)) <= 1 then 3 else 0 end, 95.0) "
        "when len(list_filter(regexp_split_to_array(n, '[_.\\-\\s]+'), lambda w: starts_with(w, q))) > 0 then 80.0 when e <= 3 and 1 - e / greatest(length(n), length(q)) >= 0.75 then 70 * (1 - e / greatest(length(n), length(q))) end::double score "
        f"from (select distinct def_name, lower(def_name) n, '{q}' q, levenshtein(lower(def_name), '{q}') e from {names})) where score >= 60"
    )


query("t13_fuzzy_rank", f"select * from ({_fuzzy('defs', 'nation_1')}) order by score desc, length(def_name), def_name limit 25")(lambda s: search.fuzzy(s, "Nation_1").take())
query("t17_fuzzy_stage", f"select id, def_name from defs where def_name in (select def_name from ({_fuzzy('defs', 'red widgte')}))")(lambda s: search.cascade(s, "red widgte", limit=None)[1].select("id", "def_name"))
query("t19_matched_on", f"select id, case when len(list_filter({_TOKENS.format('def_name')}, lambda x: starts_with(x, 'red'))) > 0 then 'def_name' else 'indexed text' end matched_on from defs where def_type = 'part'")(lambda s: search.matched_on(s, s.defs.where("def_type = 'part'"), "red").select("id", "matched_on"))
query("t19_matched_texts", f"select id, coalesce(p, 'indexed text') matched_on from defs left join (select def_id, min(path) p from translations where len(list_filter({_TOKENS.format('translated')}, lambda x: starts_with(x, 'eaque'))) > 0 and def_id is not null group by 1) t on t.def_id = id where def_type = 'orders' and def_name not in (select def_name from translations where def_id is null)")(
    lambda s: search.matched_on(s, s.defs.where("def_type = 'orders'").join(s.translations.where("def_id is null").select("def_name"), "def_name", "left_anti"), "eaque").select("id", "matched_on")
)

# Inheritance

query("g1_ancestors", "select * from (values (0, 'NATION_3'), (1, (select r_name from nation join region on n_regionkey = r_regionkey where n_name = 'NATION_3')), (2, 'World')) t(hop, name)")(lambda s: s.spark.createDataFrame(list(enumerate(["NATION_3", *graph.ancestors(s, "NATION_3")[0]])), "hop int, name string"))
_CLOSURE = "anc as (select lower('{0}') nm union select lower(n.name) from xml_nodes n join anc a on lower(n.parent_name) = a.nm where n.name is not null and n.name <> '')"
_KIN = _CLOSURE + ", kin as (select distinct d.id from xml_nodes x join defs d on lower(d.def_name) = lower(x.def_name) where lower(x.parent_name) in (select nm from anc) and (lower(d.def_type) = lower(x.def_type) or (select count(*) from defs e where lower(e.def_name) = lower(x.def_name)) = 1))"
query("g3_descendants", "select nm name_fold from anc", _CLOSURE.format("World"), True)(lambda s: graph.descendants(s, "World"))
query("g3_kin", "select id from kin", _KIN.format("ASIA"), True)(lambda s: graph.kin(s, "asia"))
query("g4_witnesses", "select (select count(*) from kin) descendants, count(distinct def_id) with_path, count(distinct def_id) filter (lower(value) = 'building') same_value, (select count(*) from kin join defs using (id) where fields_truncated > 0) truncated from f where lower(path) like '%segment%' and def_id in (select id from kin)", _KIN.format("EUROPE"), True)(lambda s: graph.witnesses(s, "EUROPE", "segment", "building"))
query("g5_dominant", "select min(value) as value, count(distinct def_id) defs, (select count(distinct lower(value)) from f where lower(path) like '%segment%' and def_id in (select id from kin)) distinct from f where lower(path) like '%segment%' and def_id in (select id from kin) group by lower(value) order by 2 desc, 1 limit 1".replace(") distinct from", ') "distinct" from'), _KIN.format("AFRICA"), True)(lambda s: graph.dominant_value(s, "AFRICA", "segment"))
query(
    "g6_witness_table",
    "select 'World' layer, (select min(value) from f where lower(path) like '%segment%' and def_id in (select id from kin) group by lower(value) order by count(distinct def_id) desc, min(value) limit 1) as value, (select count(*) from kin) descendants, "
    "(select count(distinct def_id) from f where lower(path) like '%segment%' and def_id in (select id from kin)) with_path, (select count(distinct def_id) n from f where lower(path) like '%segment%' and def_id in (select id from kin) group by lower(value) order by n desc limit 1) same_value, "
    "(select count(*) from kin join defs using (id) where fields_truncated > 0) truncated",
    _KIN.format("World"),
    True,
)(lambda s: s.spark.createDataFrame([tuple(r[k] for k in ("layer", "value", "descendants", "with_path", "same_value", "truncated")) for r in graph.witness_table(s, "ASIA", "segment")], "layer string, value string, descendants long, with_path long, same_value long, truncated long"))
query("g7_outside_layer", "select count(*) n from defs d where lower(def_name) = 'order#3' and not exists (select 1 from xml_nodes x where lower(x.def_name) = lower(d.def_name) and x.def_type = d.def_type)")(lambda s: graph.outside_layer(s, "order#3"))

# UI texts

query("k1_by_key", "select id, origin, translated from keyed where lower(key) = 'conv3_user'")(lambda s: keyed.by_key(s, "conv3_USER").take().select("id", "origin", "translated"))
query("k2_siblings", "select distinct key from keyed where lower(key) like 'conv1%' and lower(key) <> 'conv1'")(lambda s: keyed.prefix_siblings(s, "Conv1").take())
query("k3_placeholders", "select id, key from keyed where placeholder")(lambda s: keyed.all_texts(s, True).take().select("id", "key"))
query("k4_in_effect", "select key, translated, placeholder from keyed where origin = 'runtime' and key in ('Conv1_user', 'Conv2_user', 'Conv2_system', 'None')")(lambda s: keyed.in_effect(s, s.spark.createDataFrame([("Conv1_user",), ("Conv2_user",), ("Conv2_system",), ("None",)], "key string")))
query("k5_keys", "select distinct key from keyed")(keyed.all_keys)
query("k6_lookup", "select id from keyed where lower(key) = 'conv5_assistant'")(lambda s: keyed.lookup(s, "Conv5_Assistant")[1].take().select("id"))

# Corpus

query("c1_trees", "select tree, count(*) files from files group by 1", FILES)(lambda s: corpus.trees(files_of(s)))
query("c2_glob", "select tree, file from files where regexp_matches(lower(file), '^text\\.src1[^/]*/order#[^/]*7\\.cs$')", FILES)(lambda s: files_of(s).where(F.col("file").rlike(corpus.glob_regex("text.src1*/Order#*7.cs"))).select("tree", "file"))
query("c3_search", "select tree, file, line::int line, text from lines where regexp_matches(text, '[Tt]he\\.$')", FILES)(lambda s: corpus.search(files_of(s), r"[Tt]he\.$"))
query("c3_counts", "select count(*) lines, count(distinct (tree, file)) files from lines where regexp_matches(text, 'que')", FILES)(lambda s: corpus.match_counts(corpus.search(files_of(s), "que")))
query("c3_shown", "select tree, file, line::int line from (select *, row_number() over (partition by tree, file order by line) nth from lines where regexp_matches(text, '(?i)and')) where nth <= 20 order by tree, file, line limit 25", FILES)(lambda s: corpus.shown(corpus.search(files_of(s), "and", ignore_case=True)).select("tree", "file", "line"))
query("c4_context", "select distinct tree, file, unnest(range(greatest(line - 2, 1), line + 3))::int line from lines where regexp_matches(text, 'license')", FILES)(lambda s: corpus.context(corpus.search(files_of(s), "license"), 2).select("tree", "file", "line"))
query("c5_keys", "select k.key, count(*) n, (select min(translated) from keyed r where r.origin = 'runtime' and r.key = k.key) translated from keyed k group by 1")(lambda s: corpus.resolve_keys(s.keyed.select(F.concat(F.lit('Say("'), "key", F.lit('".Translate());')).alias("text")), s.keyed))
query("c4_context_text", "select distinct l.tree, l.file, l.line::int line, l.text, exists (select 1 from lines h where h.tree = l.tree and h.file = l.file and h.line = l.line and regexp_matches(h.text, 'license')) hit from lines l join lines m on l.tree = m.tree and l.file = m.file and abs(l.line - m.line) <= 1 and regexp_matches(m.text, 'license')", FILES)(lambda s: corpus.with_context(files_of(s), corpus.search(files_of(s), "license"), 1).drop("window"))
query("c6_resolve", "select tree, file from files where lower(file) like '%/order#17.cs'", FILES)(lambda s: corpus.resolve_file(files_of(s), "Order#17"))
query("c7_range", "select tree, file, line::int line, text from lines where file like '%/Order#5.cs' and line between 2 and 4", FILES)(lambda s: corpus.read_lines(files_of(s), files_of(s).where("file like '%/Order#5.cs'").first().file, "2+3"))
query("c11_in_source", "select tree, file from files where lower(file) like '%/order#23.cs'", FILES)(lambda s: corpus.in_source(files_of(s), "Order#23"))

# Scopes and catalogue

query("x1_scope", "select source_mod, count(*) n from defs where source_mod like 'geo.%' and source_mod <> 'geo.ASIA' or source_mod = 'log.events' group by 1")(lambda s: scopes.scoped(s.defs, scope_of(s, "core,-asia,log.events")).groupBy("source_mod").agg(F.count("*").alias("n")))
query("x3_complement", "select id from defs where source_mod in ('sales.F', 'sales.O')")(lambda s: scopes.scoped(s.defs, scope_of(s, "-sales.f,-sales.o").complement()).select("id"))
query("n4_fingerprint", "select substr(sha256(string_agg(concat(package_id, '@', version), chr(1) order by ordinal)), 1, 16) fingerprint from mods")(catalog.fingerprint_of)
