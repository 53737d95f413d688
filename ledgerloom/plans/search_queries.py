"""Queries that search notes and records and resolve names, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.functions import facts, inflection, normal
from ledgerloom.functions.similarity import ratio_sql
from ledgerloom.operators import decode, gazetteer, graph, nearest, noted, notes, resolution, spellings
from ledgerloom.plans.queries import _sql_matching, _window_best, query
from ledgerloom.sources import catalogues
from ledgerloom.storage import stored

_Q = "thanedble"
_N = len(_Q)


def _sql_archival(c: str) -> str:
    return f"translate({_sql_matching(c)}, '{normal.HISTORIC[0]}', '{normal.HISTORIC[1]}')"


def _sql_scores(source: str, columns: str) -> str:
    """Rows of ``source`` (columns, matched) with their score to the query, those of 80 and more."""
    inside, around = _window_best(f"'{_Q}'", "norm", str(_N)), _window_best("norm", f"'{_Q}'", "length(norm)")
    return f"""normal AS (SELECT {columns}, matched, {_sql_archival('matched')} AS norm FROM {source}),
whole AS (SELECT *, {ratio_sql(f"'{_Q}'", 'norm')} AS s FROM normal WHERE length(norm) >= {max(4, int(0.6 * _N))}),
scored AS (SELECT {columns}, matched, round_even(CASE WHEN length(norm) > {_N} THEN greatest(s, {inside}) WHEN length(norm) = {_N} THEN greatest(s, {inside}, {around}) ELSE s END, 0)::INT AS score FROM whole)
SELECT {columns}, matched, score FROM scored WHERE score >= 80"""


@query(f"""WITH named AS (SELECT source AS case_key, doc_id AS scan, unnest(regexp_extract_all(text, '\\p{{L}}+')[1:8]) AS matched FROM documents), {_sql_scores('named', 'case_key, scan')}""")
def grep_surnames(t) -> DataFrame:
    """Documents as noted pages, their first words as the surnames on them."""
    surnames = F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0), 1, 8)
    notes = t("documents").select(F.col("source").alias("case_key"), F.col("doc_id").alias("scan"), F.lit("").alias("page_type"), F.lit("full").alias("status"), F.lit("").alias("comment"), surnames.alias("surnames"), F.array().cast("array<string>").alias("places"))
    return noted.search_notes(notes, _Q, limit=None).select("case_key", "scan", "matched", "score")


@query(f"""WITH named AS (SELECT lang AS case_key, doc_id AS rid, unnest(list_concat(
  [w[5]], [w[3]])) AS matched, unnest([1, 2]) AS nth FROM (SELECT *, regexp_extract_all(text, '\\p{{L}}+') AS w FROM documents) WHERE len(w) >= 5 AND doc_id % 2 = 0),
{_sql_scores('named', 'case_key, rid, nth')}""")
def grep_records(t) -> DataFrame:
    """Even documents as baptisms of a child, by surname or the last word of a name, and a godparent; odd ones are no baptisms."""
    w = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    at = lambda k: F.get(w, F.lit(k))
    child = F.struct(F.lit("1").alias("role"), F.concat_ws(" ", at(3), F.when(F.col("doc_id") % 3 > 0, at(4))).alias("name"), F.when(F.col("doc_id") % 3 == 0, at(4)).otherwise("").alias("surname"))
    other = F.struct(F.lit("2").alias("role"), at(2).alias("name"), F.lit(None).cast("string").alias("surname"))
    rtype = F.when(F.col("doc_id") % 2 == 0, "birth").otherwise("death")
    records = t("documents").where(F.size(w) >= 5).select(F.col("lang").alias("case_key"), F.col("doc_id").alias("rid"), rtype.alias("rtype"), F.lit("1850").alias("date"), F.array(F.lit("1")).alias("scans"), F.array(child, other).alias("persons"))
    return noted.search_records(records, _Q, rtype="birth", limit=None).select("case_key", "rid", F.col("role").cast("int").alias("nth"), "matched", "score")


@query("""WITH n AS (SELECT count(*) AS pages, count(DISTINCT source) AS runs FROM documents), l AS (SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'license'))
SELECT 'present' AS asked, (SELECT n > 0 FROM l) AS found, pages, runs, (SELECT n = 0 FROM l) AS warned FROM n UNION ALL SELECT 'absent', false, pages, runs, true FROM n""")
def search_run_coverage(t) -> DataFrame:
    """Two searches in decoded pages, one for what is there and one for what is not, each with what was searched."""
    pages = t("documents").select(F.col("source").alias("run"), F.col("doc_id").alias("page"), "text")
    wanted = {"present": "license", "absent": "шшшшщщщщ"}
    # The pages are read once for both.
    found = stored(decode.near_candidates(pages, list(wanted.values()), 90), "near")
    out = None
    for asked, stem in wanted.items():
        a = noted.searched(stored(decode.search(found, [stem], 90), "hits"), pages, "decode", "run")
        n = {r["dim"]: r["denominator"] for r in a.coverage.collect()}
        hit = a.rows.agg((F.count(F.lit(1)) > 0).alias("found"))
        row = hit.select(F.lit(asked).alias("asked"), "found", F.lit(n["all"]).alias("pages"), F.lit(n["groups"]).alias("runs"), F.lit(bool(a.warnings)).alias("warned"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH c AS (SELECT 's' || s_suppkey::VARCHAR AS card, lower(s_name) AS uk, s_name AS ru FROM supplier UNION ALL SELECT 'p' || p_partkey::VARCHAR, p_name, p_type FROM part),
f AS (SELECT DISTINCT card, kind, name FROM (SELECT card, 0 AS kind, uk AS name FROM c UNION ALL SELECT card, 1, ru FROM c)), n AS (SELECT DISTINCT name FROM f),
s AS (SELECT a.name AS a, b.name AS b, {ratio_sql('a.name', 'b.name')} AS s FROM n a, n b),
m AS (SELECT x.card, y.card AS confuser, max(round_even(s, 0)::INT) AS score FROM (SELECT * FROM s WHERE s >= 78) JOIN f x ON x.name = a JOIN f y ON y.name = b WHERE x.card <> y.card AND x.kind + y.kind < 2 GROUP BY 1, 2)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY card ORDER BY score DESC, confuser) <= 8""")
def confusers_all(t) -> DataFrame:
    """All suppliers and all parts as places, without a stated set of queries."""
    suppliers = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("card"), F.lower("s_name").alias("norm_uk"), F.col("s_name").alias("norm_ru"))
    parts = t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("card"), F.col("p_name").alias("norm_uk"), F.col("p_type").alias("norm_ru"))
    return nearest.all_confusers(suppliers.unionByName(parts))


_STEM = "regexp_extract_all(text, '[a-z]{6,}')"
_EVERY = ", ".join(f"('{o}', '{e}')" for o in inflection.PARADIGMS["noun_ov"] for e in inflection.coded("noun_ov", o).values())


@query(f"""WITH s AS (SELECT DISTINCT unnest({_STEM}) AS name FROM benchmark), f AS (SELECT DISTINCT name, form FROM (
  SELECT name, name || e AS form FROM s, (VALUES {_EVERY}) v(o, e) UNION ALL SELECT name, upper(name) FROM s
  UNION ALL SELECT name, substr(name, 1, 3) || '-' FROM s UNION ALL SELECT name, substr(name, 4) FROM s UNION ALL SELECT name, substr(name, 1, 3) || '- ' || substr(name, 4) FROM s)),
h AS (SELECT doc_id, form, (instr(text, form) - 1)::INT AS "first", (length(text) - instr(reverse(text), reverse(form)) - length(form) + 1)::INT AS "last" FROM (SELECT DISTINCT form FROM f) JOIN documents ON length(form) > 2 AND contains(text, form))
SELECT doc_id, name, form, "first", "last" FROM h JOIN f USING (form)""")
def surname_forms(t) -> DataFrame:
    """Words of the test items as surnames: all their forms, in capitals and broken over lines, in whole documents."""
    stem = F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), 0)).alias("name")
    names = t("benchmark").select(stem).distinct()
    stems = F.create_map(*(x for o in inflection.PARADIGMS["noun_ov"] for x in (F.lit(o), F.col("name"))))
    slots = ["hyphen_head(nom_m@uk, 3)", "hyphen_tail(nom_m@uk, 3)", "hyphen(nom_m@ru_modern, 3)"]
    forms = inflection.all_spellings(stems, "noun_ov", F.array(F.upper("name")), slots)
    named = names.select("name", F.explode(forms).alias("form")).where("length(form) > 2")
    return spellings.spelled_hits(t("documents"), named, "doc_id").drop("n")


_KEY = "'DAHMO/' || (o_custkey % 50 + 100)::VARCHAR || '/' || o_orderkey::VARCHAR"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 11 AS way, {_KEY} AS key FROM orders)
SELECT 'r' || o_orderkey::VARCHAR AS id, CASE WHEN way = 4 AND o_orderkey < 100 OR way = 7 THEN NULL WHEN way = 0 THEN '@bundle' ELSE key END AS case_key,
  CASE way WHEN 0 THEN 'override' WHEN 1 THEN 'meta_key' WHEN 3 THEN 'run_name' WHEN 4 THEN CASE WHEN o_orderkey < 100 THEN 'none' ELSE 'run_name' END
    WHEN 5 THEN 'derived' WHEN 7 THEN 'none' WHEN 8 THEN 'archium' ELSE 'case_dir' END AS resolved_by FROM o""")
def resolve_runs(t) -> DataFrame:
    """Orders as cases and as runs that each name theirs in another way, one in eleven in none."""
    fund, inventory, number = (F.col("o_custkey") % 50 + 100).cast("string"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.col("o_orderkey").cast("string")
    o = t("orders").select(F.col("o_orderkey"), fund.alias("fund"), inventory.alias("inventory"), number.alias("case")).withColumn("way", F.col("o_orderkey") % 11)
    key, file_id = F.concat_ws("/", F.lit("DAHMO"), "fund", "case"), (F.col("o_orderkey") + 10_000_000_000).cast("string")
    library = o.select(key.alias("case_key"), F.lit("DAHMO").alias("repo"), "fund", "inventory", "case", F.lit("canonical").alias("desc_source"))
    paths = o.select(F.concat(F.lit("archive/x/"), "case").alias("path"), key.alias("case_key"))
    way = lambda k, *parts: F.when(F.col("way") == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    other = F.concat(F.lit("text"), F.translate("case", "0123456789", "abcdefghij"))
    case = F.col("case")
    name = F.coalesce(way(3, "dahmo-", F.concat_ws("-", "fund", "inventory", "case")), way(4, "spov1846-", case), way(5, other, "-skryba_f792_v6-review"), way(8, "spr_", file_id), other)
    folder = F.coalesce(way(2, "archive\\x\\", case, "\\"), way(6, "data/raw/dahmo_", F.col("fund"), "/spr-", case), way(9, "short/", case), way(10, "data/raw/dahmo_archium/f9_spr_", file_id), F.lit(""))
    runs = o.select(F.concat(F.lit("r"), "case").alias("id"), name.alias("run"), F.coalesce(way(1, key), F.lit("")).alias("meta_key"), folder.alias("case_dir"))
    overrides = o.where("way = 0").select(other.alias("run"), F.lit("@bundle").alias("case_key")).unionByName(o.where("way = 5").select(other.alias("run"), key.alias("case_key")))
    catalogue = o.select(file_id.alias("file_id"), "fund", F.concat(F.lit("Опис "), "inventory").alias("inventory"), F.concat(F.lit("Справа "), "case").alias("case"))
    junctions = runs.sparkSession.createDataFrame([("short", "archive/x"), ("shorter", "nowhere")], "target string, real string")
    return resolution.resolve_runs(runs, library, paths, overrides, catalogue, junctions).select("id", "case_key", "resolved_by")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 7 AS way, p_size, p_partkey + 1 AS n FROM part)
SELECT p_partkey, CASE WHEN way IN (0, 1, 2, 3) THEN 'DAHMO/' || (p_size + 1)::VARCHAR || '/' || n::VARCHAR WHEN way = 5 THEN 'ANRM/211-' || (p_size % 2 + 1)::VARCHAR || '/' || n::VARCHAR END AS case_key,
  way IN (0, 1, 2, 3) AND p_partkey % 2 = 0 OR way = 5 AS on_disk, CASE way WHEN 4 THEN 'no archive' WHEN 6 THEN 'not understood' END AS problem FROM p""")
def resolve_cases(t) -> DataFrame:
    """Parts called by keys, marks, source ids and paths, one without its archive, one of a fund that needs its inventory, one not at all."""
    fund, case = (F.col("p_size") + 1).cast("string"), (F.col("p_partkey") + 1).cast("string")
    way = lambda k, *parts: F.when(F.col("p_partkey") % 7 == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    value = F.coalesce(
        way(0, "DAHMO/", fund, "/", case), way(1, "ДАХмО ", fund, "-1-", case), way(2, "S_DAHMO_F", fund, "_D", case), way(3, "data/raw/dahmo_", fund, "/spr-", case),
        way(4, fund, "-1-", case), way(5, "ANRM/211/", case), way(6, "part ", case),
    )
    held = t("part").where("p_partkey % 2 = 0 and p_partkey % 7 <> 5").select(F.concat(F.lit("DAHMO/"), fund, F.lit("/"), case).alias("case_key"), F.lit("DAHMO").alias("repo"), fund.alias("fund"), F.lit("1").alias("inventory"), case.alias("case"))
    inventory = (F.col("p_size") % 2 + 1).cast("string")
    other = t("part").where("p_partkey % 7 = 5").select(F.concat(F.lit("ANRM/211-"), inventory, F.lit("/"), case).alias("case_key"), F.lit("ANRM").alias("repo"), F.lit("211").alias("fund"), inventory.alias("inventory"), case.alias("case"))
    asked = t("part").select("p_partkey", value.alias("value"))
    found = resolution.resolve_cases(asked.select("value").distinct(), held.unionByName(other))
    return asked.join(found, "value").select("p_partkey", "case_key", "on_disk", "problem")


@query("SELECT source AS case_key, count(*) AS n_noted, count(*) FILTER (quality = 1) AS n_full FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def noted_page_counts(t) -> DataFrame:
    noted = t("documents").join(t("labels"), "doc_id").select(F.col("source").alias("case_key"), F.when(F.col("quality") == 1, "full").otherwise("partial").alias("status"))
    return notes.noted_pages(noted, "case_key")


_FULL, _CONFUSER, _ANCHOR = "smallrods", "smallring", "anvil"


@query(f"""WITH l AS (SELECT p_brand AS run, p_type AS page, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS line_no, CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END AS line FROM part),
w AS (SELECT run, page, line_no, unnest(string_split(line, ' ')) AS w FROM l), s AS (SELECT *, {ratio_sql(f"'{_ANCHOR}'", 'w')} AS a, {ratio_sql(f"'{_CONFUSER}'", 'w')} AS c, CASE WHEN length(w) >= 5 THEN {ratio_sql(f"'{_FULL}'", 'w')} ELSE 0 END AS f,
  CASE WHEN length(w) >= {len(_FULL)} THEN greatest({_window_best(f"'{_FULL}'", 'w', str(len(_FULL)))}, CASE WHEN length(w) = {len(_FULL)} THEN {_window_best('w', f"'{_FULL}'", 'length(w)')} ELSE 0 END) ELSE 0 END AS p FROM w WHERE w <> ''),
seed AS (SELECT DISTINCT run, page, line_no FROM s WHERE length(w) >= 5 AND a >= 82 OR length(w) >= 7 AND c < greatest(f, p) AND greatest(f, p) >= 60 AND greatest(f, p) < 78)
SELECT run, page, line_no, line FROM l WHERE trim(line) <> '' AND EXISTS (SELECT 1 FROM seed x WHERE x.run = l.run AND x.page = l.page AND abs(x.line_no - l.line_no) <= 1)""")
def rescue_pick(t) -> DataFrame:
    """Names of parts as lines, some blank: an anchor, a surname's grey band, and a confuser that vetoes."""
    nth = F.row_number().over(W.Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")).cast("long")
    line = F.when(F.col("p_partkey") % 9 == 0, " ").when(F.col("p_partkey") % 2 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    lines = t("part").select(F.col("p_brand").alias("run"), F.col("p_type").alias("page"), nth.alias("line_no"), line.alias("line"))
    return decode.rescue_pick(lines, [_FULL], [_CONFUSER], [_ANCHOR])


_CONF = "['direct', 'indirect', 'circumstantial', 'speculative', 'negative', 'rumour']"


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, year(ts) AS y, event_id % 4 = 0 AS undated, event_id % 3 = 0 AS ranged, {_CONF}[(event_id % 6 + 1)::INT] AS conf FROM events),
first AS (SELECT user_id, arg_min(y, event_id) AS birth, arg_min(CASE WHEN event_id % 2 = 0 THEN 'about' ELSE 'exact' END, event_id) AS how FROM e WHERE event_type = 'click' AND NOT undated GROUP BY 1),
life AS (SELECT user_id, min(y) AS low, max(y + CASE WHEN ranged THEN 3 ELSE 0 END) AS high FROM e WHERE event_type IN ('view', 'scroll', 'purchase') AND NOT undated GROUP BY 1),
proof AS (SELECT user_id, arg_min(conf, struct_pack(r := CASE conf WHEN 'direct' THEN 4 WHEN 'indirect' THEN 3 WHEN 'circumstantial' THEN 2 WHEN 'speculative' THEN 1 WHEN 'negative' THEN 0 ELSE 99 END, i := event_id)) AS weakest FROM e GROUP BY 1)
SELECT p.user_id, birth::INT AS birth, how, low::INT AS low, high::INT AS high, weakest FROM proof p LEFT JOIN first USING (user_id) LEFT JOIN life USING (user_id)""")
def fact_summaries(t) -> DataFrame:
    """Users as persons, their events as facts: first dated birth with its qualifier, range of dated life facts, weakest proof."""
    e = F.col("event_id")
    year = F.year("ts")
    text = lambda y: F.concat(y.cast("string"), F.lit("-01"))
    conf = F.element_at(F.array(*map(F.lit, ("direct", "indirect", "circumstantial", "speculative", "negative", "rumour"))), (e % 6 + 1).cast("int"))
    fact = F.struct(
        e.alias("at"), F.col("event_type").alias("type"), F.when(e % 4 == 0, "unknown").otherwise(text(year)).alias("date"), F.when((e % 3 == 0) & (e % 4 != 0), text(year + 3)).alias("range_end"),
        F.when(e % 2 == 0, "about").otherwise("").alias("qualifier"), conf.alias("confidence"),
    )
    persons = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    born, life = facts.year_of(F.col("facts"), "click"), facts.year_range(F.col("facts"), ("view", "scroll", "purchase"))
    return persons.select("user_id", born["year"].alias("birth"), born["qualifier"].alias("how"), life["low"].alias("low"), life["high"].alias("high"), facts.weakest(F.transform("facts", lambda f: f["confidence"])).alias("weakest"))


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS id, 'p' || (c_custkey * 10)::VARCHAR AS h, 'p' || (c_custkey * 10 + 1)::VARCHAR AS w, CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey * 10 + 2)::VARCHAR END AS hw FROM customer),
sure AS (SELECT k, id, h, w, CASE k % 5 WHEN 1 THEN 'disputed' WHEN 2 THEN 'hypothesis' ELSE 'confirmed' END AS pair, CASE k % 5 WHEN 1 THEN 'disputed' ELSE 'confirmed' END AS parent, CASE k % 5 WHEN 0 THEN NULL WHEN 2 THEN 'speculative' ELSE 'indirect' END AS conf, hw FROM f),
child AS (SELECT *, 'p' || (k * 10 + 5)::VARCHAR AS c, false AS maybe FROM sure UNION ALL SELECT *, 'p' || (k * 10 + 6)::VARCHAR, true FROM sure WHERE k % 4 = 0)
SELECT h AS source, c AS target, 'parent' AS kind, id AS family_id, maybe AS hypothetical, CASE WHEN maybe THEN 'hypothesis' ELSE parent END AS status, conf AS confidence FROM child
UNION ALL SELECT w, c, 'parent', id, maybe, CASE WHEN maybe THEN 'hypothesis' ELSE parent END, conf FROM child UNION ALL SELECT hw, c, 'parent', id, true, 'hypothesis', conf FROM child WHERE hw IS NOT NULL
UNION ALL SELECT h, w, 'spouse', id, false, pair, conf FROM sure UNION ALL SELECT h, hw, 'spouse', id, true, 'hypothesis', conf FROM sure WHERE hw IS NOT NULL""")
def family_links(t) -> DataFrame:
    """Customers as families: a couple, at times a second wife who is a guess, a child, at times another that is a guess, one nobody knows."""
    k = F.col("c_custkey")
    p = lambda n: F.concat(F.lit("p"), (k * 10 + n).cast("string"))
    conf = F.when(k % 5 == 2, F.array(F.lit("direct"), F.lit("speculative"))).otherwise(F.array(F.lit("indirect"), F.lit("direct")))
    marriage = F.struct(F.lit("marriage").alias("type"), F.when(k % 5 == 1, "disputed").otherwise("known").alias("status"), conf.alias("confidences"))
    other = F.struct(F.lit("move").alias("type"), F.lit("disputed").alias("status"), F.array(F.lit("negative")).alias("confidences"))
    nobody = F.lit(None).cast("string")
    families = t("customer").select(
        k.cast("string").alias("family_id"), p(0).alias("husband"), p(1).alias("wife"), nobody.alias("hypothetical_husband"), F.when(k % 3 == 0, p(2)).otherwise(p(1)).alias("hypothetical_wife"),
        F.array(p(5), p(9)).alias("children"), F.when(k % 4 == 0, F.array(p(5), p(6))).alias("hypothetical_children"), F.when(k % 5 == 0, F.array(other)).otherwise(F.array(other, marriage)).alias("facts"),
    )
    persons = t("customer").select(F.explode(F.array(*(p(n) for n in (0, 1, 2, 5, 6)))).alias("node"))
    return graph.typed_links(families, persons)


@query("""WITH m AS (SELECT p_partkey, p_partkey % 6 AS k FROM part), v AS (SELECT p_partkey, k, unnest(CASE k WHEN 0 THEN ['pysar'] WHEN 1 THEN ['pysar', 'diak'] WHEN 2 THEN ['diak'] WHEN 4 THEN ['skryba'] ELSE []::VARCHAR[] END) AS voice FROM m),
n AS (SELECT p_partkey, string_agg(voice, '+' ORDER BY voice DESC) AS voices FROM v GROUP BY 1)
SELECT p_partkey, CASE k WHEN 0 THEN 'parseq' WHEN 1 THEN 'parseq' WHEN 2 THEN 'kraken' WHEN 3 THEN 'churro' WHEN 4 THEN 'own' ELSE '' END AS engine, coalesce(voices, '') AS voices,
  CASE k WHEN 0 THEN 'cyrillic' WHEN 1 THEN 'cyrillic' WHEN 2 THEN 'latin' WHEN 4 THEN 'latin' ELSE 'unknown' END AS script, CASE WHEN p_partkey % 4 = 0 THEN 'latin' WHEN p_partkey % 4 = 1 THEN 'latin' ELSE 'cyrillic' END AS case_script FROM m LEFT JOIN n USING (p_partkey)""")
def run_voices(t) -> DataFrame:
    """Parts as runs: engine, voices and script by the names of models, and a case's script by its folder or a person's word."""
    k = F.col("p_partkey") % 6
    models = ("pysar_cyr_v17.pt", "pysar_v3+diak_v4.pt", "x/other.mlmodel", "org/churro-3b", "skryba_f792", "mystery")
    model = F.element_at(F.array(*map(F.lit, models)), (k + 1).cast("int"))
    engine = facts.engine_of(F.when(k == 4, "own").otherwise(""), F.col("model"))
    runs = t("part").select("p_partkey", model.alias("model"), k.alias("k")).withColumn("engine", engine)
    said = F.array_join(F.sort_array(F.transform(facts.voices(F.col("model"), F.col("engine")), lambda v: v["voice"]), asc=False), "+")
    turn = F.col("p_partkey") % 4
    case = facts.script_of_case(F.when(turn == 1, "raw/kostel_12").otherwise("raw/latin/spr-1"), F.when(turn == 0, "latin").otherwise("both"))
    return runs.select("p_partkey", "engine", said.alias("voices"), facts.script_of(F.col("model"), F.col("engine")).alias("script"), case.alias("case_script"))


@query("""WITH r AS (SELECT conv_id, turn, role, text, conv_id % 2 = 0 AS numbered FROM conversations), g AS (SELECT conv_id, string_agg(role || ':' || left(text, 10), '|' ORDER BY turn, role, text) AS sig, count(*) AS n FROM r GROUP BY 1)
SELECT conv_id, 'page' || conv_id::VARCHAR || '-b' || CASE WHEN conv_id % 2 = 0 THEN (conv_id + 5)::VARCHAR || 'a' ELSE 'x' || left(sha256(sig), 8) END AS rid, n::INT AS total FROM g""")
def record_ids(t) -> DataFrame:
    """Conversations as records: ids by their number, or by who takes part where it is unreadable; counts without what is no number."""
    person = F.struct("turn", "role", "text", F.left("text", F.lit(10)).alias("name"))
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(person)).alias("persons"))
    row = F.when(F.col("conv_id") % 2 == 0, F.concat((F.col("conv_id") + 5).cast("string"), F.lit(" A"))).otherwise("[unreadable]")
    scans = F.array(F.concat(F.lit("page"), F.col("conv_id").cast("string"), F.lit(".jpg")))
    counts = facts.clean_counts(F.create_map(F.lit("all"), F.concat(F.lit(" "), F.size("persons").cast("string"), F.lit(" ")), F.lit("m"), F.lit("illegible")))
    return g.select("conv_id", facts.record_id(scans, F.lit("birth"), row, F.col("persons")).alias("rid"), F.when(F.size(counts) == 1, counts["all"]).alias("total"))


@query("""WITH f AS (SELECT user_id, event_type AS page, arg_max(props, event_id) AS reason, max(event_id) AS at, count(*) AS n FROM events WHERE value < 30 GROUP BY 1, 2) SELECT * FROM f""")
def quarantine(t) -> DataFrame:
    """Events of little value as failures of pages: the earlier ones set aside already, the later ones on top."""
    failed = t("events").where("value < 30").select("user_id", F.col("event_type").alias("page"), F.col("props").alias("reason"), F.col("event_id").alias("at"))
    key = ["user_id", "page"]
    none = failed.limit(0).withColumn("n", F.lit(0).cast("long"))
    before = notes.quarantined(none, failed.where("at % 3 = 0"), key)
    return notes.quarantined(before, failed.where("at % 3 <> 0"), key)


@query(f"""WITH n AS (SELECT DISTINCT p_name, {_sql_matching('p_name')} AS f FROM part), r AS (SELECT *, CASE WHEN regexp_matches(f, '^.{{4,}}ska$') THEN left(f, length(f) - 3) WHEN regexp_matches(f, '^.{{4,}}sk$') THEN left(f, length(f) - 2) ELSE f END AS r FROM n)
SELECT p_partkey, p_name FROM part JOIN r USING (p_name) WHERE starts_with(r, 'cold bol') OR starts_with('cold bol', r) AND r <> '' OR length(r) >= 3 AND {ratio_sql("'cold bol'", 'r')} >= 80""")
def of_place(t) -> DataFrame:
    """Parts as places by a derived form of a name, in another case and script."""
    return gazetteer.of_place(t("part").select("p_partkey", "p_name"), "Cold Bolскому", "p_name")


@query("SELECT p_partkey AS case_no, p_name AS description FROM part WHERE contains(p_name || ' ' || p_partkey::VARCHAR, 'red gear') ORDER BY 1")
def catalogue_search(t) -> DataFrame:
    rows = t("part").select(F.col("p_partkey").cast("string").alias("case_no"), F.col("p_name").alias("description"), F.col("p_partkey").alias("k"))
    return catalogues.catalogue_search(rows, "RED, Gear", limit=None).select(F.col("k").alias("case_no"), "description")


_SHEETS = "s AS (SELECT l_suppkey AS film, l_orderkey AS position, l_linenumber * 10 AS start_, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_linenumber * 10 ELSE l_linenumber * 10 + 7 END AS end_, l_returnflag || l_linestatus || l_quantity::INT::VARCHAR AS name FROM lineitem)"


def _sheets(t) -> DataFrame:
    n = F.col("l_linenumber")
    end = F.when(n % 3 == 0, None).when(n % 3 == 1, n * 10).otherwise(n * 10 + 7)
    name = F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    return t("lineitem").select(F.col("l_suppkey").alias("film"), F.col("l_orderkey").alias("position"), (n * 10).alias("start"), end.alias("end"), name.alias("name"), F.lit("").alias("contents"))


@query(f"""WITH {_SHEETS} SELECT film, position, 'Л. ' || start_::VARCHAR || CASE WHEN end_ IS NULL THEN '-…' WHEN end_ = start_ THEN '' ELSE '-' || end_::VARCHAR END || ' - ' || name AS label FROM s WHERE contains(lower(name), 'rf1')""")
def sheet_search(t) -> DataFrame:
    """Lines of orders as entries of a sheet index."""
    return catalogues.sheet_search(_sheets(t), " RF1 ", limit=None).select("film", "position", "label")


@query(f"""WITH {_SHEETS} SELECT film, arg_min(start_, struct_pack(p := position, s := start_)) AS "start", arg_min(coalesce(end_, -1), struct_pack(p := position, s := start_)) AS "end" FROM s WHERE contains(lower(name), 'no4') GROUP BY 1""")
def frames_for(t) -> DataFrame:
    sheets = _sheets(t).withColumn("position", F.struct("position", "start"))
    return catalogues.frames_for(sheets, "NO4").select("film", "start", F.coalesce("end", F.lit(-1)).alias("end"))


@query("SELECT event_id, value FROM events WHERE event_type IN ('click', 'view') AND value >= 40 AND user_id % 5 = 2")
def pending_candidates(t) -> DataFrame:
    """Events as candidates of sources, in states of review."""
    status = F.when(F.col("event_type") == "click", "new").when(F.col("event_type") == "view", "reviewing").otherwise("accepted")
    rows = t("events").select(F.col("event_id").alias("candidate_id"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source_id"), status.alias("status"), F.col("value").alias("score"))
    return catalogues.pending(rows, "s2", 40.0).select(F.col("candidate_id").alias("event_id"), F.col("score").alias("value"))


@query("SELECT o_orderkey AS case_key, coalesce(max(l_quantity)::BIGINT, 0) AS frames FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 3 GROUP BY 1")
def best_frames(t) -> DataFrame:
    """Orders as cases with four folders each, of which their lines hold frames."""
    path = lambda n: F.concat_ws("/", F.col("o_orderkey").cast("string"), F.lit(n))
    cases = t("orders").select(F.col("o_orderkey").alias("case_key"), F.array(*(path(n) for n in ("1", "2", "3", "none"))).alias("paths"))
    counted = t("lineitem").groupBy(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path")).agg(F.max("l_quantity").cast("long").alias("frames"))
    return catalogues.best_frames(cases, counted).select("case_key", "frames")


@query("""WITH f AS (SELECT l_orderkey AS folder, l_quantity::BIGINT AS pages, l_partkey % 3 = 0 AS part, l_suppkey % 17 = 0 AS unread FROM lineitem),
g AS (SELECT folder, sum(pages) FILTER (part) AS parts, max(pages) FILTER (NOT part) AS largest, sum(DISTINCT pages) FILTER (NOT part) AS singles, bool_or(unread) AS unread FROM f GROUP BY 1)
SELECT folder, CASE WHEN unread THEN 0 WHEN parts IS NULL THEN singles ELSE greatest(parts, coalesce(largest, 0)) END::BIGINT AS pages FROM g""")
def volume_pages(t) -> DataFrame:
    """Orders as folders, their lines as files, parts or whole volumes, some of which cannot be counted."""
    name = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("vol Ч. "), F.col("l_linenumber").cast("string"))).otherwise("volume_combined")
    files = t("lineitem").select(F.col("l_orderkey").alias("folder"), name.alias("name"), F.when(F.col("l_suppkey") % 17 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("pages"))
    return catalogues.volume_pages(files)
