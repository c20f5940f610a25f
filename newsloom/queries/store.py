"""The source registry over customer, supplier, nation and region as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators.components import union_all
from newsloom.plans import registry
from newsloom.sources import tables

from .registry import query

#: supplier as a source table: deleted rows, metadata as JSON, some nulls
SQL_SOURCES = """src AS (SELECT s_suppkey AS id, s_name AS name, 'host' || s_suppkey || '.example.org' AS domain, 'https://host' || s_suppkey || '.example.org/feed' AS url, s_nationkey AS source_type_id,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal END AS reliability, CASE WHEN s_suppkey % 17 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at,
  CASE s_suppkey % 3 WHEN 0 THEN ['news'] WHEN 1 THEN ['news', 'local'] ELSE ['sport'] END AS tags, CASE WHEN s_suppkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language, s_suppkey % 4 <> 0 AS on_, CAST(1 + s_suppkey % 10 AS INTEGER) AS priority FROM supplier)"""


def sources(load):
    k = F.col("s_suppkey")
    tags = F.when(k % 3 == 0, F.lit('["news"]')).when(k % 3 == 1, F.lit('["news","local"]')).otherwise(F.lit('["sport"]'))
    meta = F.concat(
        F.lit('{"tags":'), tags, F.lit(',"language":"'), F.when(k % 2 == 0, "en").otherwise("fr"), F.lit('","enabled":'), F.when(k % 4 != 0, "true").otherwise("false"), F.lit(',"priority":'), (1 + k % 10).cast("string"), F.lit("}")
    )
    host = F.concat(F.lit("host"), k.cast("string"), F.lit(".example.org"))
    return load("supplier").select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        host.alias("domain"),
        F.concat(F.lit("https://"), host, F.lit("/feed")).alias("url"),
        F.col("s_nationkey").alias("source_type_id"),
        F.when(k % 11 != 0, F.col("s_acctbal")).alias("reliability"),
        F.when(k % 17 == 0, F.to_timestamp(F.lit("2024-01-01"))).alias("deleted_at"),
        meta.alias("metadata"),
    )


def types(load):
    return load("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.col("n_name").alias("code"), F.col("n_regionkey").alias("region"))


@query(f"WITH {SQL_SOURCES} SELECT id, name, language, priority, reliability FROM src WHERE deleted_at IS NULL AND (name ILIKE '%1%' OR domain ILIKE '%1%' OR url ILIKE '%1%') AND language = 'en' AND on_ ORDER BY reliability DESC NULLS FIRST, id LIMIT 20 OFFSET 0")
def source_filter_paginate(load):
    page, _ = registry.list_sources(sources(load), search="1", language="en", enabled=True, page=1, page_size=20, sort_by="reliability", sort_direction="desc")
    return page.select("id", "name", "language", "priority", "reliability")


@query(f"WITH {SQL_SOURCES} SELECT src.id, src.name, n_name AS type_name FROM src JOIN nation ON n_nationkey = source_type_id WHERE deleted_at IS NULL AND (n_name = 'NATION_1' OR lower(n_name) = 'nation_1' OR n_name ILIKE '%1%')")
def source_type_join(load):
    kinds = types(load)
    found = registry.filter_sources(sources(load), {"source_type": "1"}, kinds)
    return found.join(kinds.select(F.col("id").alias("source_type_id"), F.col("name").alias("type_name")), "source_type_id").select("id", "name", "type_name")


@query(f"WITH {SQL_SOURCES} SELECT id, name FROM src WHERE deleted_at IS NULL AND id IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)")
def group_semi_join(load):
    members = load("lineitem").select(F.col("l_suppkey").alias("source_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("source_group_id"))
    return registry.filter_sources(sources(load), {"group_id": "R7"}, memberships=members).select("id", "name")


@query("SELECT r_regionkey AS id, r_name AS name, count(n_nationkey) AS source_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def group_source_count(load):
    members = load("nation").select(F.col("n_regionkey").alias("source_group_id"), "n_nationkey")
    return registry.group_counts(load("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), members)


@query(
    f"""WITH {SQL_SOURCES}, u AS (SELECT id, reliability, row_number() OVER (ORDER BY reliability ASC NULLS LAST, id) AS place, 'asc' AS direction FROM src),
d AS (SELECT id, reliability, row_number() OVER (ORDER BY reliability DESC NULLS FIRST, id) AS place, 'desc' AS direction FROM src)
SELECT * FROM u WHERE place BETWEEN 11 AND 30 UNION ALL SELECT * FROM d WHERE place BETWEEN 11 AND 30"""
)
def sort_nulls_pg(load):
    """The second page of ten and of twenty rows in either order: places follow from the pages, no window over the table."""
    parts = []
    for direction in ("asc", "desc"):
        for page, size, first in ((2, 10, 11), (3, 10, 21)):
            rows, _ = registry.paginate(sources(load), page, size, sort_by="reliability", direction=direction)
            parts.append(rows.select("id", "reliability").coalesce(1).withColumn("place", (F.monotonically_increasing_id() + first).cast("long")).withColumn("direction", F.lit(direction)))
    return union_all(parts)


@query(f"WITH {SQL_SOURCES} SELECT 'listed' AS what, count(*) AS n FROM src WHERE deleted_at IS NULL AND language = 'fr' AND on_ UNION ALL SELECT 'page', least(count(*), 7) FROM src WHERE deleted_at IS NULL AND language = 'fr' AND on_")
def paginate_count(load):
    """Rows of a page, and of all pages."""
    page, n = registry.list_sources(sources(load), language="fr", enabled=True, page=1, page_size=7)
    return page.agg(F.count("*").alias("n")).select(F.lit("page").alias("what"), "n").unionByName(page.sparkSession.range(1).select(F.lit("listed").alias("what"), F.lit(n).cast("long").alias("n")))


@query(f"WITH {SQL_SOURCES} SELECT id, name, 'id' AS found_by FROM src WHERE id = 7 UNION ALL SELECT id, name, 'domain' FROM src WHERE domain = 'host9.example.org' UNION ALL SELECT id, name, 'url' FROM src WHERE url = 'https://host10.example.org/feed' UNION ALL SELECT n_nationkey, n_name, 'slug' FROM nation WHERE lower(n_name) = lower((SELECT n_name FROM nation WHERE n_nationkey = 3)) UNION ALL SELECT n_nationkey, n_name, 'code' FROM nation WHERE n_nationkey = 4 UNION ALL SELECT r_regionkey, r_name, 'name' FROM region WHERE r_regionkey = 1")
def point_lookups(load):
    """By key and by the look-up fields of sources, types and groups; a deleted source (17) is not found."""
    nation = {r.n_nationkey: r.n_name for r in load("nation").where("n_nationkey in (3, 4)").collect()}
    region = load("region").where("r_regionkey = 1").first().r_name
    groups = load("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    found = [
        (sources(load), "source", {"id": 7}), (sources(load), "source", {"id": 17}), (sources(load), "source", {"domain": "host9.example.org"}), (sources(load), "source", {"url": "https://host10.example.org/feed"}),
        (types(load), "source_type", {"slug": nation[3].lower()}), (types(load), "source_type", {"code": nation[4]}), (groups, "source_group", {"name": region}),
    ]
    return union_all([registry.look_up(df, table, **by).select(F.col("id").cast("long").alias("id"), "name", F.lit(next(iter(by))).alias("found_by")) for df, table, by in found])


@query(f"WITH {SQL_SOURCES} SELECT id, name FROM src WHERE deleted_at IS NULL AND name ILIKE '%00_2%' ORDER BY id LIMIT 5 OFFSET 2")
def name_search_offset(load):
    """The name criterion, whose wildcards stay wildcards, with an order, an offset and a limit."""
    return registry.search(sources(load), {"name": "00_2"}, registry.SEARCHED["source"], limit=5, offset=2, sort_by="id").select("id", "name")


@query("SELECT p_partkey AS id, p_name AS term FROM part WHERE p_name ILIKE '%blue%' OR p_type ILIKE '%blue%' ORDER BY 1 LIMIT 100")
def model_search_fields(load):
    """Each table searches fields of its own: keywords their term and match type. A criterion that nothing can hold finds nothing."""
    rows = load("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.col("p_type").alias("match_type"))
    found = registry.search(rows, {"q": "blue"}, registry.SEARCHED["keyword"], sort_by="id")
    none = registry.search(rows.drop("term"), {"name": "x"}, registry.SEARCHED["keyword"]).select("id", F.lit("").alias("term"))
    return found.select("id", "term").unionByName(none)


@query("SELECT o_orderkey AS id, min(l_linenumber) AS first_line, min(l_quantity) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_suppkey % 2 = 0 GROUP BY 1")
def one_to_one_child(load):
    """Orders with their first line, if an even supplier has it: a document and its article."""
    first = load("lineitem").where("l_linenumber = 1 and l_suppkey % 2 = 0").select("l_orderkey", "l_linenumber", "l_quantity")
    made = registry.with_one(load("orders").select(F.col("o_orderkey").alias("id")), first, "l_orderkey", "line")
    return made.select("id", F.col("line.l_linenumber").alias("first_line"), F.col("line.l_quantity").alias("quantity"))


@query(
    f"""WITH {SQL_SOURCES}, a AS (SELECT id, CASE WHEN id % 10 = 1 AND id <> 11 AND id <> 51 THEN 'new name ' || id ELSE name END AS name, language, id % 10 = 1 AND id <> 11 AND id <> 51 AND deleted_at IS NULL AS changed FROM src WHERE id <= 60)
SELECT id, CASE WHEN changed THEN name ELSE (SELECT s_name FROM supplier WHERE s_suppkey = a.id) END AS name, CASE WHEN changed THEN 'de' ELSE language END AS language, '' AS violations FROM a
UNION ALL SELECT id, NULL, NULL, 'url: exists' FROM src WHERE id = 11 UNION ALL SELECT id, NULL, NULL, 'id: no live source' FROM src WHERE id = 51 UNION ALL SELECT 999999, NULL, NULL, 'id: no live source'"""
)
def source_update(load):
    """New names and a language in the metadata for each tenth source; a url that is taken and ids that are not live are rejected."""
    now = sources(load).where("id <= 60")
    k = F.col("id")
    ask = now.where(k % 10 == 1).select("id", F.concat(F.lit("new name "), k.cast("string")).alias("name"), F.when(k == 11, F.lit("https://host12.example.org/feed")).alias("url"), F.lit('{"language":"de"}').alias("metadata"))
    ask = ask.unionByName(now.sparkSession.createDataFrame([(999999, "x", None, None)], "id long, name string, url string, metadata string"))
    after, rejected = registry.update_sources(now, ask)
    read = registry.read_view(after).select("id", "name", "language", F.lit("").alias("violations"))
    return read.unionByName(rejected.select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("language"), F.array_join("violations", "; ").alias("violations")))


@query("SELECT n_regionkey AS source_group_id, n_nationkey AS source_id FROM nation WHERE n_nationkey NOT IN (3, 4) UNION SELECT 99, n_nationkey FROM nation WHERE n_nationkey < 3")
def membership_changes(load):
    rows = load("nation").select(F.col("n_regionkey").alias("source_group_id"), F.col("n_nationkey").alias("source_id"))
    more = rows.where("source_id < 3").select(F.lit(99).alias("source_group_id"), "source_id")
    return registry.remove_members(registry.add_members(registry.add_members(rows, more), more), rows.where("source_id in (3, 4)"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def archive_months(load):
    """Old rows exported by month, read back from the files."""
    spark, path = load("orders").sparkSession, tables.shared_dir(load("orders").sparkSession, "archive")
    tables.archive(load("orders"), path, "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    back = spark.read.parquet(path)
    return back.groupBy(F.to_date(F.concat(F.col("month").cast("string"), F.lit("-01"))).alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CAST(o_orderdate AS DATE) AS stat_date, count(*) * CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1995-06-01' THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-05-01' AND o_orderdate < TIMESTAMP '1995-07-01' GROUP BY CAST(o_orderdate AS DATE)")
def daily_upsert(load):
    """Daily rows written, then those of June written again with other values: only their partitions change."""
    spark, path = load("orders").sparkSession, tables.shared_dir(load("orders").sparkSession, "daily")
    rows = load("orders").where("o_orderdate >= '1995-05-01' and o_orderdate < '1995-07-01'").groupBy(F.to_date("o_orderdate").alias("stat_date")).agg(F.count("*").alias("n"))
    tables.overwrite_partitions(rows, path, "stat_date")
    tables.overwrite_partitions(rows.where("stat_date >= '1995-06-01'").withColumn("n", F.col("n") * 2), path, "stat_date")
    return spark.read.parquet(path).select("stat_date", "n")


@query(
    """SELECT 'json_ld' AS form, '{"@id":"' || n_nationkey || '","@type":"nation","name":"' || n_name || '"}' AS line FROM nation
UNION ALL SELECT 'rdf', '<urn:node:' || n_nationkey || '> <urn:type:in> <urn:node:' || (100 + n_regionkey) || '> .' FROM nation
UNION ALL SELECT 'graphml', '<node id="' || n_nationkey || '"><data key="name">' || n_name || ' &amp; co</data></node>' FROM nation
UNION ALL SELECT 'neo4j_csv', n_nationkey || ',' || (100 + n_regionkey) || ',in,1.5' FROM nation"""
)
def graph_exports(load):
    """A file of nodes or edges in each format, read back line by line."""
    spark = load("nation").sparkSession
    nodes = load("nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("label"), F.col("n_name").alias("name"))
    edges = load("nation").select(F.col("n_nationkey").alias("source"), (100 + F.col("n_regionkey")).alias("target"), F.lit("in").alias("type"), F.lit(1.5).alias("weight"))
    parts = []
    for form, part in (("json_ld", "nodes"), ("rdf", "edges"), ("graphml", "nodes"), ("neo4j_csv", "edges")):
        path = tables.shared_dir(spark, "graph")
        named = nodes.withColumn("name", F.concat("name", F.lit(" & co"))) if form == "graphml" else nodes
        tables.export_graph(named, edges, path, form)
        lines = spark.read.text(f"{path}/{part}").where("not startswith(value, ':')")
        parts.append(lines.select(F.lit(form).alias("form"), F.col("value").alias("line")))
    return union_all(parts)


@query(f"WITH {SQL_SOURCES} SELECT id, name FROM src WHERE deleted_at IS NULL AND list_has_all(tags, ['local', 'news'])")
def tags_containment(load):
    return registry.filter_sources(sources(load), {"tags": ["local", "news"]}).select("id", "name")


@query("SELECT n_regionkey AS id, array_to_string(list_sort(list(n_name)), ',') AS children FROM nation GROUP BY 1")
def nested_children(load):
    regions = load("region").select(F.col("r_regionkey").alias("id"))
    kids = load("nation").select(F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return registry.with_children(regions, kids, "parent", "kids").select("id", F.array_join(F.transform("kids", lambda k: k["name"]), ",").alias("children"))


@query("SELECT o_custkey AS id, 'add' AS change FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) UNION ALL SELECT o_custkey, 'remove' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def membership_delta(load):
    of = lambda s: load("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")).distinct()
    add, remove = registry.membership_delta(of("O"), of("F"), ["id"])
    return add.withColumn("change", F.lit("add")).unionByName(remove.withColumn("change", F.lit("remove")))


@query(f"WITH {SQL_SOURCES} SELECT id, language, on_ AS enabled, priority, array_to_string(tags, ',') AS tags, 900 AS refresh_interval_seconds FROM src")
def source_read_view(load):
    made = registry.read_view(sources(load))
    return made.select("id", "language", "enabled", "priority", F.array_join("tags", ",").alias("tags"), "refresh_interval_seconds")


@query("SELECT s_suppkey AS id, s_name AS name, 2 AS version, s_acctbal + 1 AS balance FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, s_name, 1, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0")
def upsert_latest(load):
    now = load("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("version"), F.col("s_acctbal").alias("balance"))
    changes = now.where("id % 5 = 0").withColumns({"version": F.lit(2), "balance": F.col("balance") + 1})
    return tables.upsert(now, changes)


@query(f"WITH {SQL_SOURCES} SELECT count(*) AS live, (SELECT count(*) FROM src WHERE deleted_at IS NOT NULL OR id % 10 = 3) AS gone FROM src WHERE deleted_at IS NULL AND id % 10 <> 3")
def soft_delete(load):
    left = tables.soft_delete(sources(load), F.col("id") % 10 == 3, F.to_timestamp(F.lit("2024-02-01")))
    return left.agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("gone"))


@query(
    """SELECT s_suppkey AS id, array_to_string(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'url: must be an absolute http or https URL' END,
  CASE WHEN s_suppkey % 3 = 0 THEN 'source_type: rss sources need one of rss, feed' END, CASE WHEN s_suppkey % 5 = 0 THEN 'priority: must be in 1..10' END,
  CASE WHEN s_suppkey % 7 = 0 THEN 'authentication.secret_ref: required for authenticated sources' END, CASE WHEN s_suppkey % 2 = 0 THEN 'tags: must be unique' END], lambda x: x IS NOT NULL), '; ') AS violations FROM supplier"""
)
def source_violations(load):
    k = F.col("s_suppkey")
    pick = lambda n, a, b: F.when(k % n == 0, F.lit(a)).otherwise(F.lit(b))
    meta = F.concat(F.lit('{"priority":'), pick(5, "11", "5"), F.lit(',"authentication":{"type":"'), pick(7, "token", "none"), F.lit('"},"tags":'), pick(2, '["a","A "]', '["a"]'), F.lit("}"))
    rows = load("supplier").select(k.alias("id"), pick(4, "/feed", "https://x.example.org/feed").alias("url"), F.lit("rss").alias("type_code"), F.lit("rss").alias("type_slug"), F.when(k % 3 == 0, F.array(F.lit("html"))).otherwise(F.array(F.lit("RSS"))).alias("capabilities"), meta.alias("metadata"))
    return rows.select("id", F.array_join(registry.violations(rows), "; ").alias("violations"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def uniqueness_conflicts(load):
    rows = load("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("url"), F.col("p_partkey").cast("string").alias("domain"), F.col("p_partkey").alias("source_type_id"))
    return registry.conflicts(rows).where("key = 'url'").select("value", F.size("ids").cast("long").alias("n"))
