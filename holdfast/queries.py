"""Each operator over the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import graphs, relational
from .storage import parts_of, spread_out, written

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
    WITH sites AS (
        SELECT page_id, 1 AS form, url || ':' || page_id AS site FROM pages UNION ALL SELECT page_id, 2, ' ' || url || ': ' || page_id || ' ' FROM pages
        UNION ALL SELECT page_id, 3, url || ':x' FROM pages UNION ALL SELECT page_id, 4, ':' || page_id FROM pages
        UNION ALL SELECT page_id, 5, url || ':<init>:' || page_id FROM pages UNION ALL SELECT page_id, 6, '' FROM pages
    ), parsed AS (
        SELECT page_id, form, regexp_extract(trim(site), '^(.+):([^:]*)$', 1) AS file, trim(regexp_extract(trim(site), '^(.+):([^:]*)$', 2)) AS line, site FROM sites
    )
    SELECT page_id, form, CASE WHEN ok THEN file END AS file, CASE WHEN ok THEN TRY_CAST(line AS BIGINT) END AS line
    FROM (SELECT *, file <> '' AND NOT contains(site, '<') AND regexp_matches(line, '^[+-]?[0-9]+$') AND TRY_CAST(line AS BIGINT) IS NOT NULL AS ok FROM parsed)""")
def site_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id")
    forms = [F.concat(url, F.lit(":"), page), F.concat(F.lit(" "), url, F.lit(": "), page, F.lit(" ")), F.concat(url, F.lit(":x")), F.concat(F.lit(":"), page), F.concat(url, F.lit(":<init>:"), page), F.lit("")]
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "site"))
    rows = rows.withColumn("parsed", names.site(F.col("site")))
    return rows.select("page_id", (F.col("form") + 1).alias("form"), "parsed.file", "parsed.line")


@query(r"""
    SELECT page_id, replace(split_part(cls, '$', 1), '.', '/') || '.java' AS path, regexp_extract(url, '([^/]*)$', 1) AS base,
        CASE WHEN contains(url, '/') THEN url LIKE '%' || replace(regexp_extract(url, '([^/]*)$', 1), '_', '\_') ESCAPE '\' ELSE true END AS matches,
        replace(substring(descriptor, 2, length(descriptor) - 2), '/', '.') AS dotted
    FROM (SELECT page_id, url, 'com.site' || page_id || '.Page$Inner$1' AS cls, 'Lcom/site' || page_id || '/Page;' AS descriptor FROM pages)""")
def class_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.concat(F.lit("com.site"), F.col("page_id"), F.lit(".Page$Inner$1"))
    descriptor = F.concat(F.lit("Lcom/site"), F.col("page_id"), F.lit("/Page;"))
    base = names.basename(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", names.relative_path(cls).alias("path"), base.alias("base"), names.path_matches(F.col("url"), base).alias("matches"), names.dotted(descriptor).alias("dotted"))


LOCK = "l_returnflag || l_linestatus || CAST(l_suppkey AS VARCHAR)"


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 9 + 1).alias("line"))
    lock = F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string"))
    index = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"), lock.alias("lock"))
    return asked, index


@query(f"""
    SELECT file, line, coalesce(string_agg(DISTINCT lock, ', ' ORDER BY lock), 'N/A') AS resolved
    FROM (SELECT o_orderkey AS file, o_orderkey % 9 + 1 AS line FROM orders) LEFT JOIN
        (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, {LOCK} AS lock FROM lineitem) USING (file, line)
    GROUP BY file, line""")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.lookup(*observed(spark, sf_dir), ["file"], "line", "lock")


NEAR = f"""
    WITH asked AS (SELECT o_orderkey AS file, o_orderkey % 9 + 1 AS line FROM orders),
    sites AS (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS spot, {LOCK} AS lock FROM lineitem),
    near AS (SELECT file, line, spot, lock, rank() OVER (PARTITION BY file, line ORDER BY abs(spot - line), spot) AS r
        FROM asked JOIN sites USING (file) WHERE abs(spot - line) <= 2),
    best AS (SELECT file, line, string_agg(DISTINCT lock, ', ' ORDER BY lock) AS found FROM near WHERE r = 1 GROUP BY file, line)"""


@query(NEAR + " SELECT file, line, coalesce(found, 'N/A') AS resolved FROM asked LEFT JOIN best USING (file, line)")
def resolve_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.lookup(*observed(spark, sf_dir), ["file"], "line", "lock", fuzz=2)


@query(NEAR + """, sole AS (SELECT file, min(lock) AS one FROM sites GROUP BY file HAVING count(DISTINCT lock) = 1)
    SELECT file, line, coalesce(found, one, 'N/A') AS resolved FROM asked LEFT JOIN best USING (file, line) LEFT JOIN sole USING (file)""")
def resolve_sole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.lookup(*observed(spark, sf_dir), ["file"], "line", "lock", fuzz=2, sole=True)


@query("""
    SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, count(*) AS traces
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"]
    return rows.groupBy(*keys).agg(F.count("*").alias("traces")).orderBy(F.desc("traces"), *keys)


@query("""
    SELECT o_custkey, tag, CASE WHEN tag = 'value' THEN v END AS o_orderstatus FROM (
        SELECT o_custkey, min(o_orderstatus) AS v, CASE WHEN bool_or(o_totalprice > 450000) OR count(DISTINCT o_orderstatus) > 1 THEN 'top' ELSE 'value' END AS tag
        FROM orders GROUP BY o_custkey)""")
def meet_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.meet(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", F.col("o_totalprice") > 450000)


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY o_custkey")
def unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unique_or_null(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query("""
    WITH t AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey),
    s AS (SELECT o_custkey, l_returnflag, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_custkey, l_returnflag FROM s JOIN t USING (o_custkey, n)""")
def must_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    parts = parts_of(spark, lines.count())
    sites = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").repartition(parts, "o_orderkey")
    held = lines.repartition(parts, "o_orderkey").join(sites, "o_orderkey")
    return relational.must_intersection(sites, held, ["o_custkey"], "o_orderkey", "l_returnflag", parts)


@query("SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_wins(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["doc_id"])


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY user_id, event_type)
    SELECT user_id, event_type, votes, total FROM (
        SELECT user_id, event_type, votes, CAST(sum(votes) OVER (PARTITION BY user_id) AS BIGINT) AS total,
            row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM c)
    WHERE r = 1 AND votes >= 3 AND votes >= 0.25 * total""")
def guard_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.elect(table(spark, sf_dir, "events"), ["user_id"], "event_type", 3, 0.25)


@query("""
    SELECT l_suppkey, l_partkey, count(*) AS count, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey
    FROM lineitem GROUP BY l_suppkey, l_partkey""")
def argmin_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.argmin(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], ["l_extendedprice", "l_orderkey"], ["l_orderkey"])


@query("""
    WITH r AS (SELECT s_suppkey, r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    u AS (SELECT s_suppkey AS i, 0 AS j, r_name AS value FROM r UNION ALL SELECT s_suppkey, 1, n_name FROM r UNION ALL SELECT s_suppkey, 2, s_name FROM r),
    f AS (SELECT value, min((i, j)) AS place FROM u GROUP BY value)
    SELECT value, row_number() OVER (ORDER BY place) AS id FROM f""")
def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.dictionary(rows, "s_suppkey", ["r_name", "n_name", "s_name"])


FOLLOWING = """
    WITH f AS (SELECT event_type AS "from", lead(event_type) OVER w AS "to", event_id, lead(event_id) OVER w AS next_id FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT "from", "to", count(*) AS count, min(event_id) AS site FROM f WHERE "to" IS NOT NULL AND "from" <> "to" GROUP BY ALL)"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("from"), F.lead("event_type").over(order).alias("to"), "event_id")
    return rows.where("`to` is not null and `from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("count"), F.min("event_id").alias("site"))


@query(FOLLOWING + """
    SELECT a."from", a."to", a.count, a.site, b."from" AS back_from, b."to" AS back_to, b.count AS back_count, b.site AS back_site
    FROM e a JOIN e b ON a."from" = b."to" AND a."to" = b."from" WHERE a."from" < a."to" """)
def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.inversions(event_edges(spark, sf_dir))


@query("""
    WITH p AS (SELECT o_custkey AS pair, min(o_orderkey) AS a, max(o_orderkey) AS b, 'R' AS x, 'N' AS y FROM orders GROUP BY o_custkey),
    h AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS item, l_returnflag AS f FROM lineitem)
    SELECT pair, a, b, gate FROM p LEFT JOIN (
        SELECT pair, min(h.item) AS gate FROM p JOIN h ON h.l_orderkey = a JOIN h h2 ON h2.l_orderkey = b AND h2.item = h.item WHERE h.item <> 'AF' AND h.item <> 'NO' GROUP BY pair) USING (pair)""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pair")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    pairs = pairs.withColumn("x", F.lit("AF")).withColumn("y", F.lit("NO"))
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("item"))
    return relational.gates(pairs, held, ["pair"], "a", "b", "l_orderkey", "item", ["x", "y"]).select("pair", "a", "b", "gate")


GRAPH = "g AS (SELECT c_custkey AS src, (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) AS dst FROM customer)"


def customer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse digraph with one edge from each customer."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    n = rows.count()
    return rows.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * F.col("c_custkey") + 1) % n).alias("dst"))


@query(f"WITH RECURSIVE {GRAPH}, c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src) SELECT src, dst FROM c")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(customer_graph(spark, sf_dir)).select("src", "dst")


REACH = f"""WITH RECURSIVE {GRAPH}, r AS (
    SELECT dst AS node, src % 7 AS label, 1 AS dist FROM g
    UNION SELECT g.dst, r.label, r.dist + 1 FROM r JOIN g ON r.node = g.src WHERE r.dist < 8),
    d AS (SELECT node, label, min(dist) AS dist FROM r GROUP BY ALL)"""


def carried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = customer_graph(spark, sf_dir)
    return edges, edges.select(F.col("dst").alias("node"), (F.col("src") % 7).alias("label"))


@query(REACH + " SELECT node, label, dist FROM d")
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reach(*carried(spark, sf_dir), 8)


@query(REACH + """, p AS (SELECT d.node, d.label, d.dist, min(b.node) AS pred FROM d LEFT JOIN g ON g.dst = d.node
        LEFT JOIN d b ON b.node = g.src AND b.label = d.label AND b.dist = d.dist - 1 GROUP BY ALL),
    w AS (SELECT node, label, dist, CAST(node AS VARCHAR) AS path FROM p WHERE dist = 1
        UNION ALL SELECT p.node, p.label, p.dist, w.path || '>' || p.node FROM w JOIN p ON p.pred = w.node AND p.label = w.label AND p.dist = w.dist + 1)
    SELECT node, label, dist, path FROM w""")
def witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, start = carried(spark, sf_dir)
    nothing = F.lit(None).cast("long")
    steps = graphs.traced(edges.withColumn("via", F.col("src")), start.withColumn("pred", nothing).withColumn("via", nothing), 8)
    out = graphs.paths(written(steps, "traced"), 8)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(f"""WITH RECURSIVE {GRAPH}, c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src),
    m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
    SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cycles(customer_graph(spark, sf_dir))


@query("""
    WITH decl AS (SELECT DISTINCT p_brand AS class, p_type || p_size AS sig FROM part), few AS (SELECT sig FROM decl GROUP BY sig HAVING count(*) <= 16),
    anc AS (SELECT DISTINCT p_brand AS child, substring(p_brand, 1, 7) AS ancestor FROM part)
    SELECT DISTINCT p_partkey AS call_id, d.class AS target FROM part JOIN decl d ON d.sig = p_type || p_size JOIN few ON few.sig = d.sig
    JOIN anc ON anc.child = d.class AND anc.ancestor = substring(p_brand, 1, 7)""")
def override_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    top, sig = F.substring("p_brand", 1, 7), F.concat("p_type", "p_size")
    calls = part.select(F.col("p_partkey").alias("call_id"), top.alias("class"), sig.alias("sig"))
    declared = part.select(F.col("p_brand").alias("class"), sig.alias("sig")).distinct()
    above = part.select(F.col("p_brand").alias("child"), top.alias("ancestor")).distinct()
    return relational.capped_fanout(calls, declared, above, 16)


@query("""
    WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id, ts, max(event_id) AS mark FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
    SELECT a.event_id, a.user_id, m.mark FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.ts >= m.ts""")
def line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    marks = events.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return relational.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "mark").select("event_id", "user_id", "mark")


# --- the lock analyses, over a program with one method for each customer ------------------------


def customer_program(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Method k takes the lock of field k % 37, calls method (k * k + 1) % n on the same object, and lets go."""
    from pyspark.sql.types import StructType

    from .sources.facts import CLASSES, INSTRUCTION, METHODS

    graph = customer_graph(spark, sf_dir).select(F.col("src").cast("int").alias("k"), F.col("dst").alias("j"))
    # A number here is a method there, so numbers are dealt out and not methods.
    graph = graph.repartition(spread_out(spark), "k")
    empty = {n: F.lit(None) for n in ("dst", "src", "base", "class", "field", "ty", "targets", "kind", "args", "name", "sig")}
    kind = StructType.fromDDL(f"i {INSTRUCTION}")["i"].dataType

    def step(offset: int, op: str, **more):
        values = {"offset": F.lit(offset), "op": F.lit(op)} | empty | more
        return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in kind])

    cls, no, one = F.lit("t.C"), F.lit(0), F.lit(1)
    field = F.concat(F.lit("f"), F.col("k") % 37)
    code = F.array(
        step(0, "iget", dst=no, base=one, field=field, **{"class": cls}), step(1, "monitor_enter", src=no),
        step(2, "invoke", kind=F.lit("virtual"), args=F.array(one), name=F.concat(F.lit("m"), F.col("j")), sig=F.lit("()V"), **{"class": cls}),
        step(3, "monitor_exit", src=no), step(4, "return"),
    )
    none = F.array()
    values = {
        "artifact_ord": no, "class_ord": no, "method_ord": F.col("k"), "class": cls, "name": F.concat(F.lit("m"), F.col("k")), "sig": F.lit("()V"), "access": no, "registers": F.lit(2), "ins": one,
        "source_file": F.lit("C.java"), "insns": code, "positions": F.array(F.struct(no.alias("offset"), (F.col("k") + 1).alias("line"))), "catches": none,
    }
    methods = graph.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(METHODS)])
    methods = methods.withColumn("method_id", F.col("method_ord").cast("long")).withColumn("key", F.concat("class", F.lit("."), "name", F.lit(":"), "sig"))
    return spark.createDataFrame([(0, 0, "t.C", "java.lang.Object", [])], CLASSES), methods


@query("""SELECT 't.C' AS class, 't.C.m' || c_custkey || ':()V' AS method, 'C.java' AS source_file, CAST(c_custkey + 1 AS INTEGER) AS line, 't.C.f' || c_custkey % 37 AS lock FROM customer""")
def lock_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.naming import lock_points

    return lock_points(customer_program(spark, sf_dir)[1])


HELD = f"""WITH RECURSIVE {GRAPH}, r AS (
    SELECT dst AS node, src % 37 AS label, 1 AS dist FROM g UNION SELECT g.dst, r.label, r.dist + 1 FROM r JOIN g ON r.node = g.src WHERE r.dist < 8),
    d AS (SELECT node, label, min(dist) AS dist FROM r GROUP BY ALL)"""


@query(HELD + " SELECT 't.C.m' || node || ':()V' AS key, 't.C.f' || label AS lock, dist FROM d")
def may_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.index import build

    index = build(*customer_program(spark, sf_dir))
    return index.may_held.join(index.methods, "method_id").select("key", "lock", "dist")


@query(HELD + """, s AS (SELECT src AS node, src % 37 AS own FROM g WHERE NOT EXISTS (FROM d WHERE d.node = g.src AND d.label = g.src % 37))
    SELECT 't.C.f' || label AS "from", 't.C.f' || own AS "to", count(*) AS count, min(dist) AS dist FROM s JOIN d USING (node) WHERE dist <= 3 AND label <> own GROUP BY ALL""")
def lock_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.index import build

    return build(*customer_program(spark, sf_dir)).orders.select("from", "to", "count", "dist")


@query("""SELECT 't.C.m' || c_custkey || ':()V' AS key, 't.C.f' || c_custkey % 37 AS held, c_custkey + 1 AS line FROM customer""")
def held_at_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.held import effects_and_events
    from .plans.naming import at_hand

    calls = effects_and_events(at_hand(customer_program(spark, sf_dir)[1]))[1].where("kind = 'call'")
    return calls.select("key", F.array_join("held", ", ").alias("held"), F.col("line").cast("long").alias("line"))


@query(HELD + """, p AS (SELECT d.node, d.label, d.dist, min(g.src) AS pred FROM d JOIN g ON g.dst = d.node LEFT JOIN d b ON b.node = g.src AND b.label = d.label AND b.dist = d.dist - 1
        WHERE (d.dist = 1 AND g.src % 37 = d.label) OR b.node IS NOT NULL GROUP BY ALL),
    w AS (SELECT node, label, dist, pred || '>' || node AS path FROM p WHERE dist = 1
        UNION ALL SELECT p.node, p.label, p.dist, w.path || '>' || p.node FROM w JOIN p ON p.pred = w.node AND p.label = w.label AND p.dist = w.dist + 1),
    answers AS (SELECT 'taken' AS question, src AS m, 'f' || src % 37 AS answer, src + 1 AS number FROM g WHERE 'f' || src % 37 LIKE 'f1%'
        UNION ALL SELECT 'holder', node, 'f' || label, dist FROM d WHERE 'f' || label LIKE 'f1%'
        UNION ALL SELECT 'distance', node, 'f' || label, dist FROM d WHERE 'm' || node LIKE 'm2%' AND 'f' || label LIKE 'f1%'
        UNION ALL SELECT 'caller', src, 'm' || dst, src + 1 FROM g WHERE 'm' || dst LIKE 'm2%'
        UNION ALL SELECT 'at', src, 'f' || src % 37, src + 1 FROM g WHERE src = 26
        UNION ALL SELECT 'path', node, 'f' || label || ' by ' || path, dist FROM w WHERE node = 26 AND dist <= 4)
    SELECT question, 'm' || m AS method, answer, CAST(number AS BIGINT) AS number FROM answers""")
def index_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to an index that was written and read again: where locks are taken and who may hold them, distances, callers,
    and what is held at a line, with the way from each holder."""
    from uuid import uuid4

    from .plans.index import Index, build
    from .plans.report import entry_paths, points
    from .storage import shared_dir

    folder = f"{shared_dir(spark)}/lock-index-{uuid4().hex}"
    build(*customer_program(spark, sf_dir)).write(folder, methods_each=100)
    index = Index.read(spark, folder)
    here = written(points(index, "at", "t/C.java:27"), "asked")
    name = index.methods.select("method_id", "key")
    short = lambda c: F.regexp_replace(c, r"t\.C\.(\w+)(:\(\)V)?", "$1")

    def row(question: str, rows: DataFrame, answer: str, number: str, method: str = "method_id") -> DataFrame:
        rows = rows.select(F.col(method).alias("method_id"), short(F.col(answer)).alias("answer"), F.col(number).cast("long").alias("number"))
        return rows.join(name, "method_id").select(F.lit(question).alias("question"), short(F.col("key")).alias("method"), "answer", "number")

    called = index.callers_of("C.m2").join(name.select(F.col("method_id").alias("target"), F.col("key").alias("callee")), "target")
    ways = entry_paths(index, here, 4)
    ways = ways.withColumn("way", F.concat(short(F.col("lock")), F.lit(" by "), F.regexp_replace(short(F.array_join("path", ">")), "m", "")))
    parts = [
        row("taken", index.sites("C.f1"), "lock", "line"), row("holder", index.holders("C.f1"), "lock", "dist"), row("distance", index.distance("C.m2", "C.f1"), "lock", "dist"),
        row("caller", called, "callee", "line", "caller"), row("at", here.withColumn("lock", F.explode("held")), "lock", "line"), row("path", ways, "way", "dist"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""
    SELECT 't.C' AS class, 't.C.m' || c_custkey || ':()V' AS method, CASE WHEN (c_custkey + 1) % 7 <> 0 THEN 'C.java' END AS source_file,
        CASE WHEN (c_custkey + 1) % 5 <> 0 THEN CAST(c_custkey + 1 AS INTEGER) END AS line, 't.C.f' || c_custkey % 37 AS lock FROM customer""")
def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock points, some without a line or a file, to a compressed columnar dump and back."""
    from uuid import uuid4

    from .plans.naming import lock_points
    from .sources.reports import read_points_columns, write_points_columns
    from .storage import shared_dir

    points = lock_points(customer_program(spark, sf_dir)[1])
    known = lambda c, n: F.when(F.col("line") % n != 0, F.col(c)).alias(c)
    folder = f"{shared_dir(spark)}/dump-{uuid4().hex}"
    write_points_columns(points.select("class", "method", known("source_file", 7), known("line", 5), "lock"), folder, gzip=True)
    return read_points_columns(spark, folder)


@query("""
    SELECT 'B' || o_orderkey % 3 AS build_id, o_orderpriority AS device_name, 'F' || o_custkey || '.java:' || o_orderkey AS blocked_src,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'G' || o_custkey || '.java:7' END AS blocking_src, o_orderstatus AS short_blocked_method,
        '' AS short_blocking_method, o_orderpriority || ', "' || o_orderkey || '"' || chr(10) || 'end' AS note
    FROM orders""")
def trace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as CSV, with quotes and line ends in cells, and read by the source's name, a build at a time."""
    import uuid

    from .sources import observations, seam
    from .storage import shared_dir

    key, text = F.col("o_orderkey"), lambda s: F.lit(s)
    rows = table(spark, sf_dir, "orders").select(
        F.concat(text("B"), key % 3).alias("build_id"), F.col("o_orderpriority").alias("device_name"), F.concat(text("F"), "o_custkey", text(".java:"), key).alias("blocked_src"),
        F.when(key % 5 == 0, "").otherwise(F.concat(text("G"), "o_custkey", text(".java:7"))).alias("blocking_src"), F.col("o_orderstatus").alias("short_blocked_method"),
        text("").alias("short_blocking_method"), F.concat("o_orderpriority", text(', "'), key, text('"\nend')).alias("note"),
    )
    path = f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}"
    observations.write_csv(rows, path)
    seam.register(spark)
    one = lambda build: spark.read.format("observations").option("build_id", build).load(path)
    return one("B0").unionByName(one("B1")).unionByName(one("B2"))
