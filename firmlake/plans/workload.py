"""The operators as queries over the stand-ins, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.functions.scalar import config_hash, fold_mnemonic, mnemonic_class
from firmlake.operators import canon, corpus, graph, layout, match, spans
from firmlake.plans import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def text(column: str):
    return F.array_join(column, ",").alias(column)


FN = r"""
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
fn AS (SELECT doc_id, pos::INT AS pos, sha256('v3' || chr(10) || lower(trim(line))) AS digest, doc_id % 3 AS build_id, 'f' || (doc_id % 5) AS name,
  source AS component, CASE WHEN doc_id % 2 = 0 THEN 'linked' ELSE 'archive' END AS origin, doc_id % 4 = 0 AS target FROM ln WHERE trim(line) <> ''),
tg AS (SELECT doc_id, pos, digest FROM fn WHERE target),
sg AS (SELECT DISTINCT digest, name, component, origin, build_id FROM fn WHERE NOT target AND digest IN (SELECT digest FROM tg)),
rk AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY origin <> 'linked', name, build_id, component NULLS FIRST) AS rn FROM sg),
best AS (SELECT digest, name, component, origin FROM rk WHERE rn = 1),
amb AS (SELECT s.digest, list_sort(list(DISTINCT s.name) FILTER (s.name <> b.name)) AS l, list_sort(list(DISTINCT s.build_id) FILTER (s.name = b.name)) AS src
  FROM sg s JOIN best b USING (digest) GROUP BY s.digest),
pb AS (SELECT s.digest, s.build_id, b.component AS bc, list(DISTINCT s.component) AS cs FROM sg s JOIN best b ON s.digest = b.digest AND s.name = b.name
  WHERE s.component <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT s.component) > 1),
sh AS (SELECT digest, string_agg(DISTINCT c, ',' ORDER BY c) FILTER (c IS DISTINCT FROM bc) AS shared FROM (SELECT digest, bc, unnest(cs) AS c FROM pb) GROUP BY digest),
hit AS (SELECT b.digest, b.name, b.component, b.origin, CASE WHEN coalesce(len(l), 0) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  coalesce(array_to_string(l, ','), '') AS ambiguous_with, coalesce(shared, '') AS shared_components, src FROM best b JOIN amb USING (digest) LEFT JOIN sh USING (digest))
"""


def hits(spark, d):
    return match.preferred(S.signatures(spark, d))


@query("WITH " + FN + "SELECT t.doc_id, t.pos, h.digest, h.name, h.component, h.origin, h.confidence, h.ambiguous_with, array_to_string(h.src, ',') AS source_ids FROM tg t JOIN hit h USING (digest)")
def q_match_symbols(spark, d):
    df = match.identify(S.targets(spark, d), hits(spark, d)).where("identified")
    return df.select("doc_id", "pos", "digest", "name", "component", "origin", "confidence", text("ambiguous_with"), F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@query("WITH " + FN + "SELECT digest, name, component, shared_components FROM hit WHERE shared_components <> ''")
def q_shared_components(spark, d):
    return hits(spark, d).where(F.size("shared_components") > 0).select("digest", "name", "component", text("shared_components"))


@query("WITH " + FN + "SELECT count(*)::BIGINT AS matched, (count(*) FILTER (ambiguous_with = ''))::BIGINT AS unambiguous, (count(*) FILTER (ambiguous_with <> ''))::BIGINT AS ambiguous FROM tg JOIN hit USING (digest)")
def q_ambiguity_summary(spark, d):
    df = match.identify(S.targets(spark, d), hits(spark, d)).where("identified")
    return df.agg(F.count("*").alias("matched"), F.count_if(F.size("ambiguous_with") == 0).alias("unambiguous"), F.count_if(F.size("ambiguous_with") > 0).alias("ambiguous"))


@query("WITH " + FN + "SELECT t.doc_id, t.pos, t.digest, h.name, CASE WHEN h.digest IS NULL THEN 'unidentified' ELSE 'identified' END AS status FROM tg t LEFT JOIN hit h USING (digest)")
def q_identified_split(spark, d):
    df = match.identify(S.targets(spark, d), hits(spark, d))
    return df.select("doc_id", "pos", "digest", "name", F.when(F.col("identified"), "identified").otherwise("unidentified").alias("status"))


@query("WITH " + FN + """, e AS (SELECT doc_id, pos, unnest(src) AS b FROM tg JOIN hit USING (digest)), v AS (SELECT *, 'v' || (b // 2) AS version FROM e)
SELECT 'build' AS kind, 'b' || b AS label, count(*)::BIGINT AS n FROM v GROUP BY b UNION ALL SELECT 'version', version, count(DISTINCT (doc_id, pos))::BIGINT FROM v GROUP BY version""")
def q_hits_by_version_and_build(spark, d):
    df = match.identify(S.targets(spark, d), hits(spark, d)).where("identified").select("doc_id", "pos", F.explode("source_ids").alias("b"))
    df = df.withColumn("version", F.concat(F.lit("v"), F.floor(F.col("b") / 2).cast("string")))
    by_build = df.groupBy(F.lit("build").alias("kind"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("label")).agg(F.count("*").alias("n"))
    return by_build.unionByName(df.groupBy(F.lit("version").alias("kind"), F.col("version").alias("label")).agg(F.countDistinct("doc_id", "pos").alias("n")))


@query("WITH " + FN + """, c AS (SELECT component, count(*) AS n FROM tg JOIN hit USING (digest) GROUP BY component), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, component) AS k FROM c)
SELECT least(k, 6)::INT AS rank, CASE WHEN min(k) <= 5 THEN min(component) ELSE 'other (' || count(*) || ' component(s))' END AS component, sum(n)::BIGINT AS n, sum(n)::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE AS share FROM r GROUP BY least(k, 6)""")
def q_top_components_with_other(spark, d):
    counts = match.identify(S.targets(spark, d), hits(spark, d)).where("identified").groupBy("component").agg(F.count("*").alias("n"))
    return match.top_with_other(counts, "component", 5, "component")


@query("WITH " + FN + "SELECT digest, count(DISTINCT name)::BIGINT AS names FROM fn WHERE NOT target GROUP BY digest HAVING count(DISTINCT name) > 1")
def q_duplicate_digests(spark, d):
    return match.duplicate_digests(S.lines(spark, d).where("NOT target"))


@query("WITH " + FN + """, a AS (SELECT name, component, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC, pos DESC) AS r FROM (SELECT digest AS name, component, doc_id, pos FROM fn WHERE origin = 'archive'))
SELECT f.doc_id, f.pos, f.digest AS name, a.component FROM fn f LEFT JOIN a ON f.digest = a.name AND a.r = 1 WHERE f.origin = 'linked'""")
def q_component_carryover(spark, d):
    fn = S.lines(spark, d).withColumn("name", F.col("digest"))
    archived = fn.where("origin = 'archive'").select("name", "component", F.col("doc_id").alias("path"), F.col("pos").alias("member"), F.lit(0).alias("ord"))
    linked = fn.where("origin = 'linked'").select("doc_id", "pos", "name", "component")
    return match.carry_components(linked, archived).select("doc_id", "pos", "name", "component")


AS = """
mem AS (SELECT user_id AS image, event_id AS vaddr, (16 + floor(value))::BIGINT AS size, event_type AS component, event_type <> 'signup' AS identified,
  CASE WHEN event_type <> 'signup' AND event_type <> 'error' AND 16 + floor(value) >= 24 THEN event_type END AS anchor FROM events),
m1 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR anchor IS DISTINCT FROM lag(anchor) OVER w THEN 1 ELSE 0 END AS nw FROM mem WINDOW w AS (PARTITION BY image ORDER BY vaddr)),
m2 AS (SELECT *, sum(nw) OVER (PARTITION BY image ORDER BY vaddr) AS run FROM m1),
r1 AS (SELECT image, run, min(anchor) AS own FROM m2 GROUP BY image, run),
r2 AS (SELECT *, CASE WHEN own IS NULL AND lag(own) OVER w = lead(own) OVER w THEN lag(own) OVER w ELSE own END AS label FROM r1 WINDOW w AS (PARTITION BY image ORDER BY run)),
r3 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS nw FROM r2 WINDOW w AS (PARTITION BY image ORDER BY run)),
r4 AS (SELECT image, run, own, label, sum(nw) OVER (PARTITION BY image ORDER BY run) AS region FROM r3),
lab AS (SELECT m.*, r.region, r.label, r.own IS NULL AND r.label IS NOT NULL AS absorbed FROM m2 m JOIN r4 r USING (image, run)),
reg AS (SELECT image, region::BIGINT AS region, min(label) AS component, min(vaddr) AS start, arg_max(vaddr + size, vaddr) AS "end", count(*)::BIGINT AS functions,
  (count(*) FILTER (identified))::BIGINT AS identified, (count(*) FILTER (absorbed))::BIGINT AS inferred FROM lab GROUP BY image, region)
"""


@query("WITH " + AS + "SELECT * FROM reg")
def q_layout_regions(spark, d):
    return layout.regions(S.anchored(spark, d))


@query("WITH " + AS + "SELECT image, vaddr, label AS likely_component FROM lab WHERE NOT identified AND label IS NOT NULL")
def q_likely_component(spark, d):
    return layout.likely_components(S.anchored(spark, d))


@query("WITH " + AS + """, n AS (SELECT *, "end" - start AS bytes, last_value(component IGNORE NULLS) OVER (PARTITION BY image ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(component IGNORE NULLS) OVER (PARTITION BY image ORDER BY region ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM reg)
SELECT image, start, "end", bytes, functions, before, after FROM n WHERE component IS NULL AND bytes >= 32 ORDER BY bytes DESC, image, start LIMIT 12""")
def q_unclaimed_neighbours(spark, d):
    return layout.unclaimed(layout.regions(S.anchored(spark, d)), 32).orderBy(F.desc("bytes"), "image", "start").limit(12)


@query("WITH " + AS + """, sp AS (SELECT image, min(start) AS low, max("end") AS high FROM reg GROUP BY image),
b AS (SELECT r.*, s.low, greatest(ceil((s.high - s.low) / 64.0), 1)::BIGINT AS step, unnest(range(0, 65)) AS bucket FROM reg r JOIN sp s USING (image)),
o AS (SELECT *, greatest(0, least("end", low + (bucket + 1) * step) - greatest(start, low + bucket * step))::DOUBLE AS ov FROM b WHERE bucket >= (start - low) // step AND bucket <= (greatest("end" - 1, start) - low) // step),
s AS (SELECT image, bucket, sum(CASE WHEN component IS NULL THEN 0.0 ELSE ov * (identified::DOUBLE / functions) END) AS k, sum(CASE WHEN component IS NULL THEN 0.0 ELSE ov * (1 - identified::DOUBLE / functions) END) AS i,
  sum(CASE WHEN component IS NULL THEN ov ELSE 0.0 END) AS z FROM o GROUP BY image, bucket)
SELECT image, bucket, CASE WHEN greatest(k, i, z) <= 0 THEN ' ' WHEN k >= i AND k >= z THEN '#' WHEN i >= z THEN '+' ELSE '.' END AS symbol FROM s""")
def q_layout_bar(spark, d):
    return layout.bar(layout.regions(S.anchored(spark, d)))


@query("WITH " + AS + "SELECT image, (count(*) FILTER (identified))::BIGINT AS matched, count(*)::BIGINT AS total FROM mem GROUP BY image")
def q_coverage(spark, d):
    return layout.coverage(S.anchored(spark, d))


@query("WITH " + AS + "SELECT image, component, count(*)::BIGINT AS n, min(vaddr) AS first FROM mem WHERE identified GROUP BY image, component")
def q_by_component(spark, d):
    return layout.by_component(S.anchored(spark, d))


CG = """
en AS (SELECT p_partkey AS entry, p_name, p_size FROM part),
ed AS (SELECT l_partkey AS src, l_orderkey % 2500 AS dst FROM lineitem),
ke AS (SELECT * FROM ed WHERE dst IN (SELECT entry FROM en))
"""


@query("WITH " + CG + """SELECT entry, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree FROM en
LEFT JOIN (SELECT dst AS entry, count(*) AS i FROM ke GROUP BY dst) USING (entry) LEFT JOIN (SELECT src AS entry, count(*) AS o FROM ke GROUP BY src) USING (entry)""")
def q_call_degree(spark, d):
    return graph.degrees(S.edges(spark, d), S.entries(spark, d))


@query("WITH " + CG + "SELECT src, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS callees FROM ke JOIN en ON dst = entry WHERE p_size >= 25 GROUP BY src")
def q_known_callees(spark, d):
    names = S.entries(spark, d).where("p_size >= 25").select("entry", F.col("p_name").alias("name"))
    return graph.known_callees(graph.known_edges(S.edges(spark, d), S.entries(spark, d)), names).select("src", text("callees"))


@query("WITH RECURSIVE " + CG + """, de AS (SELECT DISTINCT * FROM ke), r(node, level) USING KEY (node) AS (SELECT entry, 0 FROM en WHERE entry % 500 = 0
UNION SELECT de.dst, min(r.level) + 1 FROM r JOIN de ON r.node = de.src LEFT JOIN recurring.r AS k ON k.node = de.dst WHERE k.node IS NULL GROUP BY de.dst) SELECT node, level FROM r""")
def q_reachable(spark, d):
    entries = S.entries(spark, d)
    return graph.reachable(graph.known_edges(S.edges(spark, d), entries), entries.where("entry % 500 = 0"))


#: Control flow of a function: one block a callee, in order, each ending in the call; what follows the call is reached unless the callee
#: never returns. A function whose size leaves no remainder by 7 hangs at its end; where it leaves 1, a branch jumps from the start to a return.
@query("WITH RECURSIVE " + CG + """, c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM ke)),
f AS (SELECT entry, p_size % 7 = 0 AS hangs, p_size % 7 = 1 AS shortcut FROM en),
s(pass, entry, nr) AS (SELECT 0, entry, false FROM f UNION ALL
  SELECT n.pass, n.entry, n.nr FROM (SELECT s.pass + 1 AS pass, f.entry, NOT f.shortcut AND (f.hangs OR bool_or(coalesce(t.nr, false))) AS nr, bool_or(s.nr) AS was
    FROM s JOIN f ON f.entry = s.entry LEFT JOIN c ON c.src = f.entry LEFT JOIN s t ON t.entry = c.dst GROUP BY s.pass, f.entry, f.hangs, f.shortcut) n WHERE n.pass <= 6)
SELECT entry, nr AS noreturn FROM s WHERE pass = 6""")
def q_noreturn_fixpoint(spark, d):
    entries = S.entries(spark, d)
    calls = graph.known_edges(S.edges(spark, d), entries).distinct()
    kind = F.col("p_size") % 7
    hangs, shortcut = entries.where(kind == 0).select("entry"), entries.where(kind == 1).select("entry")
    return graph.noreturn(*S.flow(calls, entries.select("entry"), hangs, shortcut), 6)


IN = """
i0 AS (SELECT user_id::VARCHAR AS fn, event_id AS addr, event_type AS k, 'a' || (event_id % 3) AS reg, CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN event_id * 16 END AS lit FROM events),
ev AS (SELECT fn, addr, lag(k) OVER w AS pc, lag(lit) OVER w AS pl, lag(addr) OVER w AS pa FROM i0 WHERE k IN ('view', 'click', 'error') WINDOW w AS (PARTITION BY fn, reg ORDER BY addr)),
i1 AS (SELECT i.*, pc, pl, pa, lag(i.addr) OVER (PARTITION BY i.fn ORDER BY i.addr) AS la FROM i0 i LEFT JOIN ev ON i.fn = ev.fn AND i.addr = ev.addr),
i2 AS (SELECT *, coalesce(k = 'click' AND pc = 'view' AND la = pa, false) AS col, CASE WHEN k = 'click' AND pc = 'view' THEN pl END AS res FROM i1),
i3 AS (SELECT *, k = 'view' AND coalesce(lead(col) OVER (PARTITION BY fn ORDER BY addr), false) AS gone FROM i2),
i4 AS (SELECT *, CASE WHEN gone THEN NULL WHEN col THEN 'call8 CALL' WHEN k = 'view' THEN 'l32r ' || reg || ' LIT' WHEN k = 'click' THEN 'callx8 ' || reg WHEN k = 'purchase' THEN 'call8 CALL'
  WHEN k = 'signup' THEN 'beqz ' || reg || ' +12' ELSE 'addi ' || reg || ' ' || reg || ' -32' END AS line,
  CASE WHEN k = 'purchase' THEN addr + 64 ELSE res END AS tgt, k = 'purchase' OR (k = 'click' AND (res IS NOT NULL OR col)) AS edge, k = 'click' AND res IS NULL AND NOT col AS open FROM i3)
"""


@query("WITH " + IN + """, t AS (SELECT fn, coalesce(string_agg(line, chr(10) ORDER BY addr), '') AS canonical_text, count(*)::BIGINT AS instruction_count FROM i4 GROUP BY fn)
SELECT *, sha256('canonical-form-v3' || chr(10) || canonical_text) AS digest FROM t""")
def q_canonical_text(spark, d):
    return canon.forms(S.instructions(spark, d)).select("fn", "canonical_text", "instruction_count", "digest")


@query("WITH " + IN + """SELECT fn, coalesce(string_agg(tgt::VARCHAR, ',' ORDER BY addr), '') AS call_targets, (count(*) FILTER (edge))::BIGINT AS call_edges, (count(*) FILTER (open))::BIGINT AS indirect_calls,
coalesce(string_agg(lit::VARCHAR, ',' ORDER BY addr), '') AS literals, (count(*) FILTER (k = 'error'))::BIGINT AS immediates, (count(*) FILTER (k = 'signup'))::BIGINT AS branch_count FROM i4 GROUP BY fn""")
def q_call_targets(spark, d):
    df = canon.forms(S.instructions(spark, d))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return df.select("fn", joined("call_targets"), F.size("call_edges").cast("long").alias("call_edges"), "indirect_calls", joined("literals"), F.size("immediates").cast("long").alias("immediates"), "branch_count")


@query("""WITH i AS (SELECT user_id::VARCHAR AS fn, event_id AS addr, event_type IN ('error', 'signup') AS pad FROM events),
e AS (SELECT fn, coalesce(max(addr) FILTER (NOT pad), min(addr)) AS last FROM i GROUP BY fn) SELECT i.fn, count(*)::BIGINT AS n, max(addr) AS last FROM i JOIN e USING (fn) WHERE addr <= last GROUP BY i.fn""")
def q_trailing_padding(spark, d):
    e = S.table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("fn"), F.col("event_id").alias("addr"), F.when(F.col("event_type").isin("error", "signup"), "NOP.N").otherwise("ret").alias("mnemonic"))
    return canon.strip_trailing_padding(rows).groupBy("fn").agg(F.count("*").alias("n"), F.max("addr").alias("last"))


@query("""WITH r AS (SELECT user_id AS key, event_id AS addr, (16 + floor(value))::BIGINT AS size, event_type IN ('error', 'view') AS hit FROM events),
i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY addr) AS isl FROM r), b AS (SELECT key, isl, sum(CASE WHEN hit THEN size ELSE 0 END) AS bytes FROM i GROUP BY key, isl)
SELECT key, max(bytes)::BIGINT AS longest FROM b GROUP BY key""")
def q_longest_data_run(spark, d):
    rows = S.members(spark, d).select(F.col("image").alias("key"), F.col("vaddr").alias("addr"), "size", "component")
    return spans.longest_run(rows, F.col("component").isin("error", "view"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS key, l_linenumber::BIGINT AS s, l_linenumber::BIGINT + 1 AS e FROM lineitem),
n AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY key ORDER BY s) <> s, true)::INT AS nw FROM p), g AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY s) AS r FROM n)
SELECT key, min(s) AS start, max(e) AS "end" FROM g GROUP BY key, r""")
def q_contiguous_ranges(spark, d):
    line = F.col("l_linenumber").cast("long")
    return spans.contiguous_ranges(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), line.alias("start"), (line + 1).alias("end")).distinct())


def _starts(spark, d):
    e = S.table(spark, d, "events")
    ends = e.groupBy(F.col("user_id").alias("image")).agg((F.max("event_id") + 1).alias("span_end"))
    return e.where("event_type = 'purchase'").select(F.col("user_id").alias("image"), F.col("event_id").alias("start")).join(ends, "image")


@query("""WITH e AS (SELECT user_id AS image, max(event_id) + 1 AS span_end FROM events GROUP BY user_id)
SELECT user_id AS image, event_id AS start, span_end, least(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), span_end) AS ceiling FROM events JOIN e ON user_id = image WHERE event_type = 'purchase'""")
def q_function_ceilings(spark, d):
    return spans.ceilings(_starts(spark, d))


@query("SELECT e.user_id AS image, e.event_id AS addr, (SELECT max(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.event_id <= e.event_id) AS owner FROM events e")
def q_assign_to_function(spark, d):
    rows = S.table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("addr"))
    return spans.owners(rows, _starts(spark, d))


RG = "rg AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {k}, '{name}', {low}, {high})" for m, rows in S.BANDS.items() for k, (name, low, high) in enumerate(rows)) + ") AS t(map, ord, name, low, high))"


@query("WITH " + RG + """, o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS addr, unnest(['m0', 'm1', 'm2']) AS map FROM orders), j AS (SELECT o.*, name, row_number() OVER (PARTITION BY o_orderkey, o.map ORDER BY high - low, ord) AS r
FROM o LEFT JOIN rg ON rg.map = o.map AND low <= addr AND addr < high) SELECT o_orderkey, addr, map, name AS region FROM j WHERE r = 1""")
def q_region_of_address(spark, d):
    orders = S.table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("addr"))
    return orders.select("o_orderkey", "addr", F.inline(F.array(*[F.struct(F.lit(m).alias("map"), spans.smallest_region(F.col("addr"), rows).alias("region")) for m, rows in S.BANDS.items()])))


@query("WITH " + RG + """, o AS (SELECT o_custkey AS key, o_orderkey, floor(o_totalprice)::BIGINT AS addr FROM orders), n AS (SELECT key, count(*) AS seen FROM o WHERE addr <> 0 GROUP BY key),
h AS (SELECT key, map, count(DISTINCT o_orderkey) AS hits FROM o JOIN rg ON low <= addr AND addr < high WHERE addr <> 0 GROUP BY key, map),
c AS (SELECT key, map, hits::DOUBLE / seen AS score, hits || '/' || seen AS evidence, 1 AS src FROM h JOIN n USING (key)), dc AS (SELECT DISTINCT key, 'm' || (key % 4) AS map, CASE WHEN key % 4 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS score, 'declared' AS evidence, 0 AS src FROM o),
u AS (SELECT * FROM dc UNION ALL SELECT * FROM c), m AS (SELECT key, map, sum(score) AS score, string_agg(evidence, ';' ORDER BY src) AS evidence, min(src) AS src FROM u GROUP BY key, map)
SELECT key, map, score, evidence, row_number() OVER (PARTITION BY key ORDER BY score DESC, src, map)::INT AS rank FROM m""")
def q_chip_candidates(spark, d):
    from pyspark.sql import Window

    rows = S.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.floor("o_totalprice").alias("addr"))
    covered = spans.map_candidates(rows, S.BANDS).select("key", "map", (F.col("hits").cast("double") / F.col("seen")).alias("score"), F.concat_ws("/", "hits", "seen").alias("evidence"))
    number = F.col("key") % 4
    declared = rows.select("key").distinct().select("key", F.concat(F.lit("m"), number.cast("string")).alias("map"), F.when(number == 0, 0.6).otherwise(1.0).alias("score"), F.lit("declared").alias("evidence"))
    merged = spans.merge_candidates(declared, covered)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "src", "map"))
    return merged.select("key", "map", "score", F.array_join("evidence", ";").alias("evidence"), rank.alias("rank"))


@query("""WITH l AS (SELECT doc_id, list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT starts_with(x, '#'))) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l, chr(10)) || chr(10)) AS config_hash FROM l""")
def q_config_hash(spark, d):
    return S.table(spark, d, "documents").select("doc_id", config_hash(F.col("text")).alias("config_hash"))


BD = """
f AS (SELECT source, lang, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang),
l AS (SELECT *, list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT starts_with(x, '#'))) AS cl, row_number() OVER (ORDER BY source, lang) AS k FROM f),
bd AS (SELECT k AS build_id, source AS idf_version, lang AS config_name, sha256(array_to_string(cl, chr(10)) || chr(10)) AS config_hash, CASE WHEN doc_id % 2 = 0 THEN 'c0' ELSE 'c1' END AS chip, 't' AS toolchain,
  (3 - k % 2)::INT AS canon_version, doc_id::VARCHAR AS created_at FROM l)
"""


@query("WITH " + BD + "SELECT * FROM bd WHERE chip = 'c0' AND canon_version = 3")
def q_current_builds(spark, d):
    return corpus.current_builds(S.builds(spark, d), "c0", 3)


@query("WITH " + BD + "," + FN + """, c AS (SELECT build_id + 1 AS build_id, count(*) FILTER (origin = 'archive') AS a, count(*) FILTER (origin = 'linked') AS l, count(*) AS t FROM fn GROUP BY build_id)
SELECT b.build_id, idf_version, config_name, chip, coalesce(a, 0)::BIGINT AS archive, coalesce(c.l, 0)::BIGINT AS linked, coalesce(t, 0)::BIGINT AS total, canon_version <> 3 AS stale,
concat_ws(',', CASE WHEN canon_version <> 3 THEN 'stale' END, CASE WHEN coalesce(t, 0) = 0 THEN 'empty' END) AS warnings FROM bd b LEFT JOIN c USING (build_id)""")
def q_list_builds(spark, d):
    functions = S.lines(spark, d).withColumn("build_id", F.col("build_id") + 1)
    return corpus.listing(S.builds(spark, d), functions, 3).select("build_id", "idf_version", "config_name", "chip", "archive", "linked", "total", "stale", text("warnings"))


@query("WITH " + FN + "SELECT build_id, (count(*) FILTER (origin = 'archive'))::BIGINT AS archive, (count(*) FILTER (origin = 'linked'))::BIGINT AS linked, count(*)::BIGINT AS total FROM fn GROUP BY build_id")
def q_build_counts(spark, d):
    return corpus.counts_by_origin(S.lines(spark, d))


@query("WITH " + BD + "SELECT * FROM bd WHERE starts_with(config_hash, 'a')")
def q_prefix_select(spark, d):
    return corpus.prefixed(S.builds(spark, d), "a")


@query("WITH " + BD + "SELECT canon_version, count(*)::BIGINT AS builds, canon_version <> 3 AS removed FROM bd GROUP BY canon_version")
def q_gc_candidates(spark, d):
    return S.builds(spark, d).groupBy("canon_version").agg(F.count("*").alias("builds")).withColumn("removed", F.col("canon_version") != 3)


@query("WITH " + BD + "SELECT chip, CASE WHEN count(*) = 1 THEN min('build:' || build_id || '@' || created_at) ELSE left(sha256(string_agg('build:' || build_id || '@' || created_at, ',' ORDER BY build_id)), 16) END AS revision FROM bd GROUP BY chip")
def q_corpus_revision(spark, d):
    df = S.builds(spark, d)
    return corpus.revision(df.where("chip = 'c0'")).withColumn("chip", F.lit("c0")).unionByName(corpus.revision(df.where("chip = 'c1'")).withColumn("chip", F.lit("c1")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_orderpriority FROM r WHERE k = 1""")
def q_slot_selection(spark, d):
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    df = S.table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderpriority"), F.struct(priority.alias("p"), "o_orderkey")).alias("x"))
    return df.select("o_custkey", "x.*")


@query("SELECT source, count(DISTINCT sha256(text))::BIGINT AS fingerprints, count(DISTINCT sha256(text)) = 1 AS identical FROM documents GROUP BY source")
def q_distinct_fingerprints(spark, d):
    n = F.countDistinct(F.sha2("text", 256))
    return S.table(spark, d, "documents").groupBy("source").agg(n.alias("fingerprints"), (n == 1).alias("identical"))


@query("""WITH w AS (SELECT unnest(string_split(text, ' ')) AS m FROM documents), k AS (SELECT m, lower(m) AS l, count(*)::BIGINT AS n FROM w WHERE m <> '' GROUP BY m)
SELECT m AS mnemonic, n, CASE WHEN starts_with(l, '.') THEN 'data' WHEN l IN ('call0', 'call4', 'call8', 'call12') THEN 'call' WHEN l IN ('callx0', 'callx4', 'callx8', 'callx12') THEN 'call_indirect'
WHEN l IN ('ret', 'ret.n', 'retw', 'retw.n', 'rfe', 'rfi', 'rfwo', 'rfwu', 'rfde') THEN 'return' WHEN l IN ('j', 'j.l') THEN 'jump' WHEN l = 'jx' THEN 'jump_indirect' WHEN l IN ('loop', 'loopnez', 'loopgtz') THEN 'loop'
WHEN l = 'entry' THEN 'entry' WHEN l = 'l32r' THEN 'literal_load' WHEN starts_with(l, 'b') AND l NOT IN ('break', 'break.n') THEN 'branch' ELSE 'normal' END AS cls,
CASE WHEN l IN ('add.n', 'addi.n', 'beqz.n', 'bnez.n', 'break.n', 'l32i.n', 'mov.n', 'movi.n', 'nop.n', 'ret.n', 'retw.n', 's32i.n') THEN replace(l, '.n', '') ELSE m END AS folded FROM k""")
def q_classify_mnemonic(spark, d):
    words = S.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("mnemonic")).where("mnemonic <> ''")
    counts = words.groupBy("mnemonic").agg(F.count("*").alias("n"))
    return counts.select("mnemonic", "n", mnemonic_class(F.col("mnemonic")).alias("cls"), fold_mnemonic(F.col("mnemonic")).alias("folded"))


@query("WITH " + CG + "SELECT src, dst FROM ke INTERSECT SELECT dst, src FROM ed")
def q_edge_intersection(spark, d):
    edges = S.edges(spark, d)
    return graph.known_edges(edges, S.entries(spark, d)).intersect(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("""WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), f AS (SELECT DISTINCT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'trash'))
SELECT count(t.doc_id)::BIGINT AS truth, count(f.doc_id)::BIGINT AS found, (count(*) FILTER (t.doc_id IS NOT NULL AND f.doc_id IS NOT NULL))::BIGINT AS both FROM t FULL JOIN f ON t.doc_id = f.doc_id""")
def q_score_recall_precision(spark, d):
    low = F.lower("text")
    truth = S.table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("t")).distinct()
    found = S.table(spark, d, "documents").where(F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("trash"))).select("doc_id", F.lit(1).alias("f")).distinct()
    df = truth.join(found, "doc_id", "full")
    return df.agg(F.count("t").alias("truth"), F.count("f").alias("found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("both"))


@query("""WITH h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark), b AS (SELECT item_id, ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT AS v FROM h, LATERAL (SELECT unnest(range(0, len(h) // 2)) AS i))
SELECT item_id, xor(coalesce(bit_xor(v), 0), 239) AS checksum FROM h LEFT JOIN b USING (item_id) GROUP BY item_id""")
def q_xor_checksum(spark, d):
    h = F.hex(F.encode("text", "utf-8"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1)), F.lit(2)), lambda i: i < F.length(h))
    byte = lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int")
    checksum = F.aggregate(places, F.lit(0xEF), lambda x, i: x.bitwiseXOR(byte(i)))
    return S.table(spark, d, "benchmark").select("item_id", F.coalesce(checksum, F.lit(0xEF)).alias("checksum"))


MADE = 1 << 20  # bytes of made files handed on together


def _made(rows: DataFrame, make) -> DataFrame:
    """Rows (key, payload) -> (path, content) of the files that ``make`` gives for each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made, held = [], 0
            for key, payload in zip(*batch.columns, strict=True):
                made += make(key.as_py(), payload.as_py())
                held += len(made[-1][1])
                if held > MADE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables are read by one task, which all that follows would stay in
    return rows.repartition(tasks).mapInArrow(run, "path string, content binary")


def _images(spark, d):
    """Pages as images: the HTML as data, as many functions as the page's id leaves modulo 6, and one."""
    from firmlake.sources import synthetic

    return _made(S.table(spark, d, "pages").select("page_id", "html"), lambda key, text: [(f"page-{key}", synthetic.image((text or "").encode(), key % 6 + 1))])


def _dumps(spark, d):
    from firmlake.sources import synthetic

    return _made(S.table(spark, d, "pages").select("page_id", "html"), lambda key, text: [(f"dump-{key}", synthetic.dump(key, (text or "").encode()))])


def _builds(spark, d):
    from firmlake.sources import synthetic

    return _made(S.table(spark, d, "supplier").select("s_suppkey", "s_name"), lambda key, _: synthetic.build(key))


@query("""SELECT 'page-' || page_id AS path, 'app_partition' AS input_kind, 'esp32' AS chip, 2::BIGINT AS segments, true AS checksum_valid, true AS sha256_valid, (strlen(html) + 3) // 4 * 4 AS data_bytes FROM pages""")
def q_parse_images(spark, d):
    from firmlake.sources import flash

    i = F.col("images")[0]
    return flash.parse(_images(spark, d)).select("path", "input_kind", "chip", F.size(i["segments"]).cast("long").alias("segments"), i["checksum_valid"].alias("checksum_valid"), i["sha256_valid"].alias("sha256_valid"), i["segments"][0]["length"].alias("data_bytes"))


#: What is to be found in each slot of code, by its shape.
SH = r"""
sh(f, off, size, blocks, edges, indirect, callees, reached, grade, why, txt) AS (VALUES
  (0, 0, 5, 1, 0, 0, 0, 5, 'high', 'windowed prologue', 'entry a1 32|retw'),
  (1, 0, 10, 3, 2, 0, 0, 10, 'high', 'windowed prologue', 'entry a1 32|beqz a2 +5|movi a2 1|retw'),
  (2, 0, 10, 3, 2, 0, 0, 10, 'high', 'windowed prologue', 'entry a1 32|loop a3 +5|addi a2 a2 1|retw'),
  (3, 4, 11, 1, 0, 1, 0, 11, 'high', 'windowed prologue', 'entry a1 32|call8 CALL|retw'),
  (4, 0, 10, 1, 0, 1, 0, 6, 'high', 'windowed prologue', 'entry a1 32|jx a4|movi a2 1|retw'),
  (5, 0, 8, 1, 0, 0, 1, 8, 'high', 'windowed prologue', 'entry a1 32|call0 CALL|retw'),
  (5, 16, 4, 1, 0, 0, 0, 4, 'medium', 'no prologue: begins with add.n', 'add a2 a2 a3|ret')),
pf AS (SELECT 'page-' || page_id AS path, page_id % 6 + 1 AS slots, (strlen(html) + 3) // 4 * 4 AS data_bytes, 1074593824 + 32 * f + off AS entry, sh.*,
  CASE WHEN f = 0 THEN 'image_entry,' || CASE WHEN page_id % 6 >= 3 THEN 'pointer,' ELSE '' END || 'prologue_scan' WHEN off = 16 THEN 'direct_call' ELSE 'prologue_scan' END AS origins,
  CASE WHEN f = 0 THEN 'entry point of the image' WHEN off = 16 THEN 'target of a direct call' ELSE 'prologue found by scanning' END || ';' || why AS reasons
  FROM pages JOIN sh ON f <= page_id % 6)
"""


def _analysed(spark, d):
    from firmlake.plans.symbols import analysed

    return analysed(_images(spark, d))


@query("WITH " + SH + """SELECT path, entry::BIGINT AS entry, size::BIGINT AS size, grade AS confidence, reasons, origins, blocks::INT AS basic_blocks, edges::INT AS edges, indirect::INT AS indirect_calls, callees::INT AS callees,
reached::BIGINT AS reached, size::BIGINT AS reached_stretched, 'irom' AS region, (24 + 8 + data_bytes + 8 + 32 * f + off)::BIGINT AS file_offset, false AS never_returns, replace(txt, '|', chr(10)) AS canonical_text FROM pf""")
def q_recover_functions(spark, d):
    out = _analysed(spark, d)
    fn = F.concat_ws(":", "image_id", F.col("entry").cast("string"))
    df = out["boundaries"].withColumn("fn", fn).join(out["forms"].select("fn", "canonical_text"), "fn").join(out["parsed"].select("image_id", "path"), "image_id")
    return df.select("path", "entry", "size", "confidence", F.array_join("confidence_reasons", ";").alias("reasons"), text("origins"), "basic_blocks", "edges", "indirect_calls", F.size("callees").alias("callees"), "reached", "reached_stretched", "region", "file_offset", "never_returns", "canonical_text")


@query("WITH " + SH + """SELECT path, count(*)::BIGINT AS total, (count(*) FILTER (grade = 'high'))::BIGINT AS high_confidence, (count(*) FILTER (grade = 'medium'))::BIGINT AS medium_confidence, 0::BIGINT AS low_confidence, 0::BIGINT AS thunks, sum(size)::BIGINT AS bytes_in_functions,
sum(size)::BIGINT AS bytes_reached, sum(reached)::BIGINT AS bytes_by_flow, (count(*) FILTER (grade = 'high'))::BIGINT AS windowed_prologues, 0::BIGINT AS call0_prologues, (32 * min(slots))::BIGINT AS bytes_executable,
CASE WHEN sum(size) < 0.7 * 32 * min(slots) THEN 'less than 70 % of the executable bytes are claimed; a low match rate may be due to that' ELSE '' END AS cautions FROM pf GROUP BY path""")
def q_boundary_statistics(spark, d):
    from firmlake.sources import recover

    out = _analysed(spark, d)
    df = recover.statistics(out["boundaries"], out["segments"]).join(recover.cautions(out["boundaries"], out["segments"]), "image_id")
    return df.join(out["parsed"].select("image_id", "path"), "image_id").withColumn("cautions", F.array_join("cautions", ";")).drop("image_id")


@query("""WITH p AS (SELECT 'page-' || page_id AS path, page_id % 6 + 1 AS n FROM pages) SELECT path, 'image_entry' AS origin, 1::BIGINT AS n FROM p UNION ALL SELECT path, 'prologue_scan', n FROM p
UNION ALL SELECT path, 'pointer', 1 FROM p WHERE n > 3 UNION ALL SELECT path, 'direct_call', 1 FROM p WHERE n > 5""")
def q_seeds_by_origin(spark, d):
    from firmlake.sources import flash, recover

    files = _images(spark, d)
    parsed = flash.parse(files)
    images = recover.recovered(flash.segment_bytes(parsed, files))
    return recover.seeds_by_origin(images).join(parsed.select("image_id", "path"), "image_id").select("path", "origin", "n")


@query("""SELECT 'page-' || page_id AS path, (1074593824 + 32 * 3 + 7)::BIGINT AS addr, 'l32r' AS mnemonic, (1074593824 + 32 * 3)::BIGINT AS target, 1074593824::BIGINT AS literal_value FROM pages WHERE page_id % 6 >= 3""")
def q_literal_words(spark, d):
    out = _analysed(spark, d)
    return out["instructions"].where("cls = 'literal_load'").join(out["parsed"].select("image_id", "path"), "image_id").select("path", "addr", "mnemonic", "target", "literal_value")


@query("SELECT 'page-' || page_id AS path, 2::BIGINT AS sections, 1074593824::BIGINT AS entry, 32 * (page_id % 6 + 1) AS code_bytes FROM pages")
def q_export_elf(spark, d):
    from firmlake.sources import export, flash

    files = _images(spark, d)
    parsed = flash.parse(files)
    made = export.elf_files(flash.segment_bytes(parsed, files)).join(parsed.select("image_id", "path"), "image_id")
    again = flash.parse(made.select("path", F.col("elf").alias("content")))
    i = F.col("images")[0]
    return again.select("path", F.size(i["segments"]).cast("long").alias("sections"), i["header"]["entry_addr"].alias("entry"), F.element_at(i["segments"], -1)["length"].alias("code_bytes"))


DU = """
im AS (SELECT page_id AS k, 'dump-' || page_id AS path, ((72 + (256 + strlen(html) + 3) // 4 * 4 + 32 * (page_id % 3 + 1 - 1)) // 16 * 16 + 48 + 8191) // 8192 * 8192 AS one, ((72 + (256 + strlen(html) + 1 + 3) // 4 * 4) // 16 * 16 + 48 + 8191) // 8192 * 8192 AS other FROM pages),
sl AS (SELECT *, CASE WHEN k % 4 = 0 THEN one ELSE other END AS two FROM im),
pt AS (SELECT k, path, 0 AS ord, 'nvs' AS label, 'data' AS type_name, 'nvs' AS subtype_name, 40960 AS wh, 16384 AS size FROM sl UNION ALL SELECT k, path, 1, 'coredump', 'data', 'coredump', 57344, 8192 FROM sl
  UNION ALL SELECT k, path, 2, CASE WHEN k % 2 = 1 THEN 'factory' ELSE 'ota_0' END, 'app', CASE WHEN k % 2 = 1 THEN 'factory' ELSE 'ota_0' END, 65536, one FROM sl
  UNION ALL SELECT k, path, 3, 'ota_1', 'app', 'ota_1', 65536 + one, two FROM sl WHERE k % 2 = 0
  UNION ALL SELECT k, path, CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END, 'spare', 'app', 'test', 65536 + one + CASE WHEN k % 2 = 0 THEN two ELSE 0 END, 65536 FROM sl WHERE k % 5 = 0)
"""


@query("WITH " + DU + """SELECT path, ord::INT AS ord, label, type_name, subtype_name, wh::BIGINT AS "offset", size::BIGINT AS size, label <> 'spare' AS present_in_file FROM pt""")
def q_flash_partitions(spark, d):
    from firmlake.sources import flash

    parsed = flash.parse(_dumps(spark, d))
    return flash.partitions(parsed).join(parsed.select("image_id", "path"), "image_id").select("path", "ord", "label", "type_name", "subtype_name", "offset", "size", "present_in_file")


@query("WITH " + DU + """SELECT path, 'flash_dump' AS input_kind, (CASE k % 3 WHEN 1 THEN 36864 WHEN 2 THEN 28672 ELSE 32768 END)::BIGINT AS partition_table_offset, CASE WHEN k % 3 = 2 THEN 4096::BIGINT END AS flash_base_offset,
CASE WHEN k % 2 = 1 THEN 'factory' ELSE 'ota_0' END AS selected, CASE WHEN k % 2 = 0 THEN k % 4 = 0 END AS ota_slots_identical, (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)::INT AS images, 'v' || k AS version,
((k % 3 <> 0)::INT + (k % 5 = 0)::INT + (k % 4 = 2)::INT)::INT AS warnings, (CASE WHEN k % 3 = 2 THEN 61440 ELSE 65536 END)::BIGINT AS file_offset FROM sl""")
def q_flash_dumps(spark, d):
    from firmlake.sources import flash

    parsed = flash.parse(_dumps(spark, d))
    chosen = flash.app_images(parsed).where("selected").select("image_id", F.col("partition_label").alias("selected"), F.col("app_desc.version").alias("version"), "file_offset")
    rows = parsed.select("image_id", "path", "input_kind", "partition_table_offset", "flash_base_offset", "ota_slots_identical", F.size("images").alias("images"), F.size("warnings").alias("warnings"))
    return rows.join(chosen, "image_id").drop("image_id")


HV = """
hv AS (SELECT s_suppkey AS k, 'b' || s_suppkey || '/archives/lib' || CASE WHEN s_suppkey % 2 = 1 THEN 'net' ELSE 'core' END || '.a' AS lib, CASE WHEN s_suppkey % 2 = 1 THEN 'net' ELSE 'core' END AS comp, 'open_' || (s_suppkey % 7) AS leaf, 'b' || s_suppkey || '/app/app.elf' AS app FROM supplier),
la AS (SELECT leaf, arg_max(comp, lib) AS comp FROM hv GROUP BY leaf),
hr AS (SELECT lib AS path, 'a.o' AS member, leaf AS name, comp AS component, 'archive' AS origin, 5 AS size, 'entry a1 32|retw' AS txt, '' AS edges FROM hv
  UNION ALL SELECT lib, 'a_rather_long_name_' || k || '.o', 'step_' || k, comp, 'archive', 10, 'entry a1 32|loop a3 +5|addi a2 a2 1|retw', '' FROM hv
  UNION ALL SELECT app, NULL, 'main', NULL, 'linked', 8, 'entry a1 32|call0 CALL|retw', leaf FROM hv
  UNION ALL SELECT app, NULL, leaf, la.comp, 'linked', 5, 'entry a1 32|retw', '' FROM hv JOIN la USING (leaf))
"""


def _signatures(spark, d):
    from firmlake.sources import harvest

    files = _builds(spark, d)
    return harvest.signatures(harvest.harvested(files), names=harvest.function_names(files))


@query("WITH " + HV + "SELECT path, member, name, component, origin, size::BIGINT AS size, replace(txt, '|', chr(10)) AS canonical_text, edges, sha256('canonical-form-v3' || chr(10) || replace(txt, '|', chr(10))) AS digest, 'windowed' AS prologue FROM hr")
def q_harvest(spark, d):
    return _signatures(spark, d).select("path", F.col("object").alias("member"), "name", "component", "origin", "size", "canonical_text", F.array_join("call_edges", ",").alias("edges"), "digest", "prologue")


@query("""SELECT 'b' || s_suppkey || '/app/app.elf' AS path, '' AS member, (1074266112 + v)::BIGINT AS value, CASE v WHEN 0 THEN 'main' ELSE 'open_' || (s_suppkey % 7) END AS name FROM supplier, (VALUES (0), (16)) AS t(v)
UNION ALL SELECT 'b' || s_suppkey || '/archives/lib' || CASE WHEN s_suppkey % 2 = 1 THEN 'net' ELSE 'core' END || '.a', 'a.o', v, n FROM (SELECT s_suppkey, v, CASE v WHEN 8 THEN 'open_' || (s_suppkey % 7) ELSE 'beyond' END AS n FROM supplier, (VALUES (4), (8)) AS t(v))""")
def q_function_symbols(spark, d):
    from firmlake.sources import harvest

    return harvest.function_names(_builds(spark, d))


LS = r"""
ls AS (SELECT event_id AS k, 1074266112 + 4 * event_id AS addr, event_type AS t, event_id % 16 AS a, event_id % 97 * 4 AS n FROM events)
"""


@query("WITH " + LS + r"""SELECT k, addr::BIGINT AS addr, (CASE WHEN t = 'signup' THEN 2 ELSE 3 END)::INT AS size, CASE t WHEN 'view' THEN 'l32r' WHEN 'click' THEN 'callx8' WHEN 'purchase' THEN 'call8' WHEN 'signup' THEN 'retw.n' ELSE 'beqz' END AS mnemonic,
CASE t WHEN 'view' THEN 'a' || a || ',' || '0x' || printf('%x', addr - n) WHEN 'click' THEN 'a' || a WHEN 'purchase' THEN '0x' || printf('%x', addr + n) WHEN 'signup' THEN '' ELSE 'a' || a || ',' || '0x' || printf('%x', addr + n) END AS operands,
CASE t WHEN 'view' THEN 'literal_load' WHEN 'click' THEN 'call_indirect' WHEN 'purchase' THEN 'call' WHEN 'signup' THEN 'return' ELSE 'branch' END AS cls, (CASE t WHEN 'view' THEN addr - n WHEN 'click' THEN NULL WHEN 'signup' THEN NULL ELSE addr + n END)::BIGINT AS target,
CASE WHEN t = 'view' THEN k END AS literal_value, CASE WHEN t = 'purchase' THEN 'fn_' || a END AS target_symbol, CASE WHEN t = 'signup' THEN '1DF0' ELSE '365A01' END AS raw FROM ls""")
def q_read_listing(spark, d):
    from firmlake.sources.decode import read_listing

    e, kind = S.table(spark, d, "events"), F.col("event_type")
    addr, reg, n = F.lit(1074266112) + 4 * F.col("event_id"), (F.col("event_id") % 16).cast("string"), F.col("event_id") % 97 * 4
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    rest = (
        F.when(kind == "view", F.concat(F.lit("l32r\ta"), reg, F.lit(", "), hexed(addr - n), F.lit(" ("), hexed(F.col("event_id")), F.lit(")")))
        .when(kind == "click", F.concat(F.lit("callx8\ta"), reg))
        .when(kind == "purchase", F.concat(F.lit("call8\t"), hexed(addr + n), F.lit(" <fn_"), reg, F.lit(">")))
        .when(kind == "signup", F.lit("retw.n"))
        .otherwise(F.concat(F.lit("beqz\ta"), reg, F.lit(", "), hexed(addr + n)))
    )
    line = F.concat(F.lower(F.hex(addr)), F.lit(":\t"), F.when(kind == "signup", "f01d  ").otherwise("015a36"), F.lit("        \t"), rest)
    noise = e.select("event_id", F.lit("Disassembly of section .text:").alias("value"))
    rows = read_listing(e.select("event_id", line.alias("value")).union(noise))
    return rows.select(F.col("event_id").alias("k"), "addr", "size", "mnemonic", text("operands"), "cls", "target", "literal_value", "target_symbol", F.hex("raw").alias("raw"))


@query(r"""WITH p AS (SELECT p_partkey AS k, p_partkey % 16 AS t, p_size % 16 AS s, p_partkey % 256 AS b, 4096 + 64 * p_partkey AS ad FROM part)
SELECT k, ad::BIGINT AS addr, 'l32i' AS mnemonic, 'a' || t || ',a' || s || ',' || CASE WHEN b * 4 < 256 THEN (b * 4)::VARCHAR ELSE '0x' || printf('%x', b * 4) END AS operands, NULL::BIGINT AS target FROM p
UNION ALL SELECT k, ad + 3, 'addi', 'a' || t || ',a' || s || ',' || CASE WHEN b >= 128 THEN b - 256 ELSE b END, NULL FROM p
UNION ALL SELECT k, ad + 6, CASE WHEN t % 2 = 0 THEN 'beqi' ELSE 'bltui' END, 'a' || s || ',' || CASE WHEN c > 255 THEN '0x' || printf('%x', c) ELSE c::VARCHAR END || ',0x' || printf('%x', dst), dst
  FROM (SELECT *, CASE WHEN t % 2 = 0 THEN [-1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 32, 64, 128, 256][t + 1] ELSE [32768, 65536, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 32, 64, 128, 256][t + 1] END AS c, ad + 10 + CASE WHEN b >= 128 THEN b - 256 ELSE b END AS dst FROM p)
UNION ALL SELECT k, ad + 9, 'extui', 'a' || t || ',a' || s || ',' || (b % 32) || ',' || (s + 1), NULL FROM p
UNION ALL SELECT k, ad + 12, 'mov.n', 'a' || t || ',a' || s, NULL FROM p UNION ALL SELECT k, ad + 14, '.byte', '0xff', NULL FROM p""")
def q_decode_ranges(spark, d):
    from firmlake.sources.decode import decode_ranges

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            keys, places, blobs = [], [], []
            for k, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t, s, b = k % 16, size % 16, k % 256
                words = [2 | t << 4 | s << 8 | 2 << 12 | b << 16, 2 | t << 4 | s << 8 | 12 << 12 | b << 16, (0x26 if t % 2 == 0 else 0xB6) | s << 8 | t << 12 | b << 16, s << 4 | b % 16 << 8 | t << 12 | (4 | b >> 4 & 1) << 16 | s << 20]
                keys.append(str(k))
                places.append(4096 + 64 * k)
                blobs.append(b"".join(w.to_bytes(3, "little") for w in words) + (13 | t << 4 | s << 8).to_bytes(2, "little") + b"\xff")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places, pa.int64()), pa.array(blobs, pa.binary())], ["key", "vaddr", "data"])

    ranges = S.table(spark, d, "part").select(F.col("p_partkey").cast("long"), F.col("p_size").cast("long")).mapInArrow(encode, "key string, vaddr long, data binary")
    return decode_ranges(ranges).select(F.col("key").cast("long").alias("k"), "addr", "mnemonic", text("operands"), "target")


@query(r"""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS n FROM customer),
o AS (SELECT *, CASE k % 7 WHEN 0 THEN '0x' || printf('%x', k) WHEN 1 THEN '-' || k WHEN 2 THEN '0' || k WHEN 3 THEN 'a' || (k % 16) WHEN 4 THEN '0b101' WHEN 5 THEN '+' || k ELSE '0o17' END AS op FROM c)
SELECT k, (CASE k % 7 WHEN 0 THEN k WHEN 1 THEN -k WHEN 4 THEN 5 WHEN 5 THEN k WHEN 6 THEN 15 WHEN 2 THEN CASE WHEN k = 0 THEN 0 END END)::BIGINT AS number, 'esp-' || (k % 5) || '-' || n || '/binutils-2.' || (k % 9) AS toolchain,
CASE WHEN k % 3 = 0 THEN NULL ELSE 'v' || (k % 4) || '.' || (k % 9) || '.' || n END AS bundled, CASE WHEN k % 2 = 0 THEN lower(seg) ELSE 'main' END AS component, printf('0x%08x', k) AS hexed, left(sha256(name || '|' || seg), 32) AS cache_key,
seg || '/' || name || '/' || left(sha256(name), 12) AS described, CASE k % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'low' WHEN 2 THEN 'low' ELSE 'high' END AS grade, CASE n WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE '0x' || printf('%02x', n) END AS code_name FROM o""")
def q_scalar_functions(spark, d):
    from firmlake.functions import scalar as X

    k, name, seg, n = (F.col(c) for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    digits = k.cast("string")
    token = F.when(k % 7 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 7 == 1, F.concat(F.lit("-"), digits)).when(k % 7 == 2, F.concat(F.lit("0"), digits)).when(k % 7 == 3, F.concat(F.lit("a"), (k % 16).cast("string"))).when(k % 7 == 4, F.lit("0b101")).when(k % 7 == 5, F.concat(F.lit("+"), digits)).otherwise(F.lit("0o17"))
    banner = F.concat(F.lit("GNU objdump (crosstool-NG esp-"), (k % 5).cast("string"), F.lit("-"), n.cast("string"), F.lit(") 2."), (k % 9).cast("string"), F.lit("\nCopyright"))
    lines = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("SDK_VERSION_MAJOR="), (k % 4).cast("string"), F.lit("\n"))), F.lit("SDK_VERSION_MINOR = "), (k % 9).cast("string"), F.lit("\nSDK_VERSION_PATCH="), n.cast("string"))
    path = F.when(k % 2 == 0, F.concat(F.lit("x/lib"), F.lower(seg), F.lit(".a"))).otherwise("y.z/main.elf")
    a, b = F.when(k % 4 == 1, "low").otherwise("high"), F.when(k % 4 == 2, "low").when(k % 4 == 3, "high").otherwise("medium")
    return S.table(spark, d, "customer").select(
        k.alias("k"), X.operand_number(token).alias("number"), X.toolchain_id(banner).alias("toolchain"), X.bundled_version(lines).alias("bundled"), X.component_of(path).alias("component"), X.hex_address(k).alias("hexed"),
        X.cache_key(name, seg).alias("cache_key"), X.describe_build(seg, name, F.sha2(name, 256)).alias("described"), X.lower_grade(a, b).alias("grade"), X.named(n, {0: "zero", 1: "one"}).alias("code_name"),
    )


@query("WITH " + BD + "SELECT * FROM bd WHERE idf_version = (SELECT min(idf_version) FROM bd) AND chip = 'c0' AND toolchain = 't'")
def q_builds_for(spark, d):
    builds = S.builds(spark, d)
    first = builds.agg(F.min("idf_version").alias("v"))
    return corpus.builds_for(builds, first.first()["v"], "c0", "t")


@query("WITH " + FN + """, t AS (SELECT doc_id, pos, digest FROM tg), h AS (SELECT t.doc_id, t.pos, s.digest, s.name, s.origin, s.build_id FROM t JOIN sg s USING (digest))
SELECT doc_id, pos, string_agg(name || ':' || origin || ':' || build_id || ':v' || (build_id // 2), ',' ORDER BY name, origin <> 'linked', build_id) AS signatures FROM (SELECT DISTINCT * FROM h) GROUP BY doc_id, pos""")
def q_hit_signatures(spark, d):
    builds = spark.range(3).select(F.col("id").alias("build_id"), F.concat(F.lit("v"), F.floor(F.col("id") / 2).cast("string")).alias("idf_version"), F.lit("c").alias("config_name"), F.lit("h").alias("config_hash"))
    held = match.with_builds(match.signature_lists(S.signatures(spark, d)), builds)
    rows = S.targets(spark, d).join(held, "digest")
    return rows.select("doc_id", "pos", F.array_join(F.transform("signatures", lambda s: F.concat_ws(":", s["name"], s["origin"], s["build_id"].cast("string"), s["idf_version"])), ",").alias("signatures"))


@query("WITH " + FN + """, u AS (SELECT t.doc_id, t.pos, length(t.digest || '') AS x, row_number() OVER (ORDER BY t.doc_id DESC, t.pos) AS r, count(*) OVER () AS n FROM tg t WHERE digest NOT IN (SELECT digest FROM hit))
SELECT r::INT AS rank, doc_id, pos, (n - least(n, 20))::BIGINT AS more FROM u WHERE r <= 20""")
def q_unidentified_top(spark, d):
    rows = match.identify(S.targets(spark, d), hits(spark, d)).where("NOT identified").select("doc_id", "pos")
    return match.first_and_more(rows, 20, [F.desc("doc_id"), F.asc("pos")])


SG = SH + "," + HV + r""",
sg AS (SELECT split_part(path, '/', 1) AS build, name, component, origin, txt FROM hr),
bs AS (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY origin <> 'linked', name, component NULLS FIRST) AS r FROM sg),
bn AS (SELECT b.txt, b.name, b.component, b.origin, (SELECT count(DISTINCT build) FROM sg s WHERE s.txt = b.txt AND s.name = b.name) AS builds, (SELECT count(DISTINCT name) FROM sg s WHERE s.txt = b.txt AND s.name <> b.name) AS rivals FROM bs b WHERE r = 1)
"""


def _corpus(spark, d):
    """A corpus of the suppliers' builds, written to the shared folder."""
    from firmlake.operators.corpus import Corpus

    found = _signatures(spark, d).withColumn("build_key", F.regexp_extract("path", r"^(b\d+)/", 1))
    builds = S.table(spark, d, "supplier").select(
        F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("build_key"), F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string")).alias("idf_version"), F.lit("default").alias("config_name"),
        F.concat(F.lit("CONFIG_KEY="), F.col("s_suppkey").cast("string")).alias("config_text"), F.lit("esp32").alias("chip"), F.lit("t").alias("toolchain"), F.lit(canon.VERSION).alias("canon_version"), F.lit(None).cast("string").alias("objdump_version"),
    )
    held = Corpus(spark, S.shared(spark, "corpus"))
    held.add(builds, found)
    return held


def _together(spark, *steps):
    """What some steps return, run at the same time: one plans or has few tasks left while another's tasks take the cores."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def _symbols(spark, d):
    """The images' symbols, and their paths. Images are analysed while the corpus is made, as neither needs the other."""
    from firmlake.plans import symbols as plan

    files = _images(spark, d)
    analysis, held = _together(spark, lambda: plan.analysed(files, memo=S.shared(spark, "memo")), lambda: _corpus(spark, d))
    paths = analysis["parsed"].select(F.col("image_id").alias("image"), "path")
    return plan.symbols(analysis, held), paths


@query("WITH " + SG + """SELECT path, entry::BIGINT AS entry, name, component, origin, CASE WHEN rivals = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, rivals::INT AS rivals, builds::INT AS builds, (CASE WHEN off = 16 THEN 1 WHEN f = 0 AND slots > 3 THEN 1 ELSE 0 END)::BIGINT AS in_degree FROM pf JOIN bn USING (txt)""")
def q_symbols_identified(spark, d):
    out, paths = _symbols(spark, d)
    return out["identified"].join(paths, F.col("image_id") == F.col("image")).select("path", "entry", "name", "component", "origin", "confidence", "rivals", "builds", "in_degree")


@query("WITH " + SG + """, u AS (SELECT pf.path, pf.entry, pf.size, CASE WHEN off = 16 THEN 1 ELSE 0 END AS deg FROM pf LEFT JOIN bn USING (txt) WHERE bn.txt IS NULL)
SELECT path, entry::BIGINT AS entry, size::BIGINT AS size, deg::BIGINT AS in_degree, row_number() OVER (PARTITION BY path ORDER BY size DESC, deg DESC, entry)::INT AS rank FROM u""")
def q_symbols_unidentified(spark, d):
    from pyspark.sql import Window

    out, paths = _symbols(spark, d)
    order = Window.partitionBy("path").orderBy(F.desc("size"), F.desc("in_degree"), "entry")
    return out["unidentified"].join(paths, F.col("image_id") == F.col("image")).select("path", "entry", "size", "in_degree", F.row_number().over(order).alias("rank"))


@query("WITH " + SG + """, m AS (SELECT path, count(bn.txt) AS matched, count(*) AS total FROM pf LEFT JOIN bn USING (txt) GROUP BY path), v AS (SELECT path, count(DISTINCT substr(sg.build, 2)::INT % 3) AS versions FROM pf JOIN bn USING (txt) JOIN sg ON sg.txt = bn.txt AND sg.name = bn.name GROUP BY path)
SELECT path, matched::BIGINT AS matched, total::BIGINT AS total, coalesce(versions, 0)::BIGINT AS versions, 'matched: ' || matched || ' of ' || total || ' functions (' || printf('%.1f', 100.0 * matched / total) || '%)' AS line FROM m LEFT JOIN v USING (path)""")
def q_symbols_summary(spark, d):
    from firmlake.plans import report

    out, paths = _symbols(spark, d)
    return out["summary"].join(paths, "image").select("path", "matched", "total", "versions", report.matched_line().alias("line"))


@query("WITH " + HV + """SELECT 'b' || k AS build, 'v' || (k % 3) AS idf_version, 2::BIGINT AS archive, 2::BIGINT AS linked, 4::BIGINT AS total, false AS stale, sha256('CONFIG_KEY=' || k || chr(10)) AS config_hash FROM hv WHERE k % 3 = 1""")
def q_corpus_listing(spark, d):
    held = _corpus(spark, d)
    rows = corpus.listing(held.builds(), held.functions(), canon.VERSION, "v1")
    return rows.select(F.concat(F.lit("b"), F.split("config_text", "=")[1]).alias("build"), "idf_version", "archive", "linked", "total", "stale", "config_hash")


@query("WITH " + HV + """SELECT CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END::INT AS canon_version, count(*)::BIGINT AS builds, (4 * count(*))::BIGINT AS functions FROM hv WHERE k % 3 <> 0 GROUP BY 1""")
def q_corpus_gc(spark, d):
    held = _corpus(spark, d)
    builds, functions = held.builds(), held.functions().drop("chip", "canon_version")
    newer = F.when(F.col("idf_version") == "v0", 3).otherwise(4)
    about = builds.select(F.col("build_id").cast("string").alias("build_key"), "idf_version", "config_name", "config_text", "chip", "toolchain", newer.alias("canon_version"), "objdump_version")
    other = corpus.Corpus(spark, S.shared(spark, "corpus"))
    other.add(about, functions.withColumn("build_key", F.col("build_id").cast("string")).drop("build_id"))
    other.collect_stale(4, dry=False)
    left = other.functions().groupBy("build_id").agg(F.count("*").alias("n"))
    return other.builds().join(left, "build_id").groupBy("canon_version").agg(F.count("*").alias("builds"), F.sum("n").alias("functions"))
