"""Queries over the test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import keys as K
from keyloom.functions.parse import encode_token
from keyloom.operators import alphabet, compare, paging, sorting, stats, timeline, trace
from keyloom.operators.filters import Filters, key_range
from keyloom.operators.paging import Request
from keyloom.plans import formats, latency, resume, simulate
from keyloom.plans import views as V
from keyloom.schema import keys_only, order_columns, project, type_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:  # two column names are words of DuckDB's grammar
            ORACLES[name] = re.sub(r"""(?<![\w"'])(at|pivot)(?![\w"'])""", r'"\1"', f"WITH RECURSIVE {V.SQL.rstrip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}")
        return f

    return put


def text(df: DataFrame, *more: str) -> DataFrame:
    """Keys as text, for comparison."""
    return df.select(F.col("key").cast("string").alias("key"), *more)


# ---- filters -------------------------------------------------------------------


@query("filter_include_regex", "SELECT key, size FROM P WHERE regexp_matches(key, '/en/[0-9]+')")
def _(s, d):
    return text(Filters(include="/en/[0-9]+").apply(V.pages(s, d)), "size")


@query("filter_exclude_regex", "SELECT key, size FROM P WHERE NOT regexp_matches(key, '[?#]')")
def _(s, d):
    return text(Filters(exclude="[?#]").apply(V.pages(s, d)), "size")


@query("filter_size", "SELECT key, size, row_type FROM O WHERE row_type <> 'OBJECT' OR size BETWEEN 10485760 AND 20971520")
def _(s, d):
    return text(Filters(min_size="10MiB", max_size="20MiB").apply(V.orders(s, d)), "size", "row_type")


@query("filter_mtime", "SELECT key, us FROM O WHERE us BETWEEN epoch_us(TIMESTAMP '1997-01-01') AND epoch_us(TIMESTAMP '1997-06-30 12:00:00')")
def _(s, d):
    rows = Filters(modified_since="1997-01-01", modified_until="1997-06-30T12:00:00Z").apply(V.orders(s, d))
    return rows.select(F.col("key").cast("string").alias("key"), F.unix_micros("last_modified").alias("us"))


@query("filter_class", "SELECT key, storage_class, row_type FROM O WHERE row_type <> 'OBJECT' OR upper(storage_class) IN ('1-URGENT', '5-LOW')")
def _(s, d):
    return text(Filters(storage_classes=("1-urgent", "5-Low")).apply(V.orders(s, d)), "storage_class", "row_type")


@query("filter_chain", "SELECT key, size FROM O WHERE (row_type <> 'OBJECT' OR size >= 1048576) AND (row_type <> 'OBJECT' OR upper(storage_class) = '2-HIGH') AND us >= epoch_us(TIMESTAMP '1996-01-01') AND regexp_matches(key, '/0[1-6]/') AND NOT regexp_matches(key, '7$')")
def _(s, d):
    chain = Filters(include="/0[1-6]/", exclude="7$", min_size="1M", modified_since="1996-01-01", storage_classes=("2-HIGH",))
    return text(Filters.decode(chain.encode()).apply(V.orders(s, d)), "size")


@query("filter_expression", "SELECT key, size FROM L WHERE size % 1000 < 20 AND length(key) > 17")
def _(s, d):
    return text(Filters(expression="size % 1000 < 20 and octet_length(key) > 17").apply(V.lines(s, d)), "size")


# ---- scans, seeks, pages -------------------------------------------------------


@query("prefix_scan", "SELECT key, size FROM L WHERE starts_with(key, '1998/03/')")
def _(s, d):
    return text(key_range(V.lines(s, d), prefix=b"1998/03/"), "size")


@query("range_scan", "SELECT key FROM L WHERE key > '1997/05/10/3' AND key <= '1997/06/01/9'")
def _(s, d):
    return text(key_range(V.lines(s, d), after=b"1997/05/10/3", upto=b"1997/06/01/9"))


@query("range_page", "SELECT key, size FROM L WHERE starts_with(key, '1997/') ORDER BY key LIMIT 1000")
def _(s, d):
    return text(paging.list_objects(V.lines(s, d), Request(prefix=b"1997/")).rows, "size")


@query("start_after_page", "SELECT key, size FROM L WHERE starts_with(key, '1997/') AND key > '1997/08/' ORDER BY key LIMIT 250")
def _(s, d):
    return text(paging.list_objects(V.lines(s, d), Request(prefix=b"1997/", start_after=b"1997/08/", max_keys=250)).rows, "size")


@query("token_page", "SELECT key, size FROM L WHERE key > '1996/02/15/1' ORDER BY key LIMIT 100")
def _(s, d):
    return text(paging.list_objects(V.lines(s, d), Request(token=encode_token(b"1996/02/15/1"), max_keys=100)).rows, "size")


@query("page_walk", "SELECT key, ((row_number() OVER (ORDER BY key) - 1) // 50)::BIGINT AS page, ((row_number() OVER (ORDER BY key) - 1) % 50)::BIGINT AS place FROM L")
def _(s, d):
    return text(paging.page_walk(V.lines(s, d), Request(), 50), "page", "place")


_ROLL = "CASE WHEN instr(substr(key, {n} + 1), '{x}') > 0 THEN substr(key, 1, {n} + instr(substr(key, {n} + 1), '{x}') + {m} - 1) END"


@query("delim_rollup", f"SELECT coalesce(cp, key) AS key, CASE WHEN cp IS NULL THEN 'OBJECT' ELSE 'COMMON_PREFIX' END AS row_type, count(*)::BIGINT AS n_keys, sum(size)::BIGINT AS size FROM (SELECT *, {_ROLL.format(n=0, x='/', m=1)} AS cp FROM P) GROUP BY ALL")
def _(s, d):
    return text(paging.entries(V.pages(s, d), Request(delimiter=b"/")), "row_type", "n_keys", "size")


@query("delim_rollup_mixed", f"SELECT coalesce(cp, key) AS key, CASE WHEN cp IS NULL THEN 'OBJECT' ELSE 'COMMON_PREFIX' END AS row_type, count(*)::BIGINT AS n_keys, sum(size)::BIGINT AS size FROM (SELECT *, {_ROLL.format(n=10, x='-', m=1)} AS cp FROM (SELECT * FROM L WHERE starts_with(key, '1997/05/10') AND key > '1997/05/10/2')) WHERE cp IS NULL OR cp > '1997/05/10/2' GROUP BY ALL")
def _(s, d):
    return text(paging.entries(V.lines(s, d), Request(prefix=b"1997/05/10", delimiter=b"-", start_after=b"1997/05/10/2")), "row_type", "n_keys", "size")


@query("delim_rollup_multibyte", f"SELECT coalesce(cp, key) AS key, CASE WHEN cp IS NULL THEN 'OBJECT' ELSE 'COMMON_PREFIX' END AS row_type, count(*)::BIGINT AS n_keys FROM (SELECT *, {_ROLL.format(n=0, x='.example.', m=9)} AS cp FROM P) GROUP BY ALL")
def _(s, d):
    return text(paging.entries(V.pages(s, d), Request(delimiter=b".example.")), "row_type", "n_keys")


@query("rollup_page", f"SELECT coalesce(cp, key) AS key, count(*)::BIGINT AS n_keys FROM (SELECT *, {_ROLL.format(n=5, x='/', m=1)} AS cp FROM L WHERE starts_with(key, '1998/')) GROUP BY 1 ORDER BY 1 LIMIT 5")
def _(s, d):
    return text(paging.list_objects(V.lines(s, d), Request(prefix=b"1998/", delimiter=b"/", max_keys=5)).rows, "n_keys")


@query("rollup_depth2", "SELECT CASE WHEN array_to_string(string_split(key, '/')[1:2], '/') = key THEN key ELSE array_to_string(string_split(key, '/')[1:2], '/') || '/' END AS prefix, count(*)::BIGINT AS n_keys, sum(size)::BIGINT AS size FROM D GROUP BY 1")
def _(s, d):
    return paging.rollup_depth(V.documents(s, d), 2)


@query("first_key_under", "SELECT min(key) AS key FROM L WHERE starts_with(key, '1996/1')")
def _(s, d):
    return s.createDataFrame([(paging.probe(V.lines(s, d), b"1996/1").decode(),)], "key string")


# ---- aggregation ---------------------------------------------------------------


@query("tally", "SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (row_type = 'OBJECT')::BIGINT AS n_objects, 0::BIGINT AS n_prefixes, count(*) FILTER (row_type = 'DELETE_MARKER')::BIGINT AS n_markers, sum(size) FILTER (row_type = 'OBJECT')::BIGINT AS total_size FROM O")
def _(s, d):
    return stats.tally(V.orders(s, d))


@query("page_tallies", "SELECT page::BIGINT AS page, count(*)::BIGINT AS n_rows, count(*) FILTER (row_type = 'OBJECT')::BIGINT AS n_objects, 0::BIGINT AS n_prefixes, count(*) FILTER (row_type = 'DELETE_MARKER')::BIGINT AS n_markers, coalesce(sum(size) FILTER (row_type = 'OBJECT'), 0)::BIGINT AS total_size FROM (SELECT (row_number() OVER (ORDER BY key, row_type) - 1) // 100 AS page, row_type, size FROM O) GROUP BY 1")
def _(s, d):
    rows = sorting.numbered(V.orders(s, d), ["key", "row_type"]).withColumn("page", F.floor((F.col("n") - 1) / 100))
    return stats.tally(rows, "page")


@query("projection", "SELECT key, row_type, size FROM O")
def _(s, d):
    return text(project(V.orders(s, d), "size"), "row_type", "size")


@query("keys_only", "SELECT key FROM L")
def _(s, d):
    return text(keys_only(V.lines(s, d)))


@query("class_tally", "SELECT storage_class, count(*)::BIGINT AS n_rows, count(*) FILTER (row_type = 'OBJECT')::BIGINT AS n_objects, 0::BIGINT AS n_prefixes, count(*) FILTER (row_type = 'DELETE_MARKER')::BIGINT AS n_markers, coalesce(sum(size) FILTER (row_type = 'OBJECT'), 0)::BIGINT AS total_size FROM O GROUP BY 1")
def _(s, d):
    return stats.tally(V.orders(s, d), "storage_class")


@query("file_stats", "SELECT true AS several, count(*)::BIGINT AS n_rows, min(key) AS first_key, max(key) AS last_key FROM L")
def _(s, d):
    from keyloom.plans.storage import kept

    rows = kept(sorting.sort_listing(V.lines(s, d), 4), "files")
    files = stats.file_stats(rows.withColumn("at", F.col("_metadata.file_name")), "at")
    one = files.agg((F.count("*") > 1).alias("several"), F.sum("n_rows").alias("n_rows"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    return one.select("several", "n_rows", F.col("first_key").cast("string").alias("first_key"), F.col("last_key").cast("string").alias("last_key"))


@query("seed_shapes", "SELECT count(DISTINCT substr(key, 1, 5))::BIGINT AS n_prefixes, 'narrow' AS shape FROM L")
def _(s, d):
    children = paging.entries(V.lines(s, d), Request(delimiter=b"/"))
    one = stats.partitioned(children.select(F.col("key").cast("string").alias("prefix"))).first()
    return s.createDataFrame([(one.n_children, stats.seed_shape(one.n_children, 0, one.partitioned))], "n_prefixes bigint, shape string")


@query("conditions", "SELECT bool_and(size >= 0) AS sized, bool_and(key > '1993') AS late, bool_and(size >= 0) AND bool_and(key > '1993') AS ok FROM L")
def _(s, d):
    return stats.all_hold(V.lines(s, d), {"sized": F.col("size") >= 0, "late": F.col("key") > F.lit(b"1993")})


@query("part_cursors", "SELECT storage_class AS part, us % 5 AS node_id, max(key) AS cursor FROM (SELECT *, size % 5 AS u FROM L) AS l(key, size, x, storage_class, us) GROUP BY 1, 2")
def _(s, d):
    rows = V.lines(s, d).select(F.col("storage_class").alias("part"), (F.col("size") % 5).alias("node_id"), "key")
    return resume.durable_cursors(rows).select("part", "node_id", F.col("cursor").cast("string").alias("cursor"))


@query("gini_mass", """, g AS (SELECT count(*)::DOUBLE AS v FROM P GROUP BY split_part(key, '/', 1)), n AS (SELECT v, count(*)::DOUBLE AS n FROM g GROUP BY v)
SELECT round(sum(a.n * b.n * abs(a.v - b.v)) / (2 * (SELECT sum(n) * sum(n * v) FROM n)), 9) AS gini FROM n a CROSS JOIN n b""")
def _(s, d):
    children = paging.entries(V.pages(s, d), Request(delimiter=b"/"))
    groups = children.groupBy(F.col("n_keys").alias("value")).agg(F.count("*").alias("n"))
    return stats.gini(groups).select(F.round("gini", 9).alias("gini"))


@query("child_mass", "SELECT CASE WHEN n = 0 THEN 'empty' WHEN n <= 10 THEN 'tiny' WHEN n <= 1000 THEN 'small' ELSE 'large' END AS mass_class, count(*)::BIGINT AS n_children, CASE WHEN n = 0 THEN 0 WHEN n <= 10 THEN 10 WHEN n <= 1000 THEN 1005 ELSE 100000 END::BIGINT AS stands_for FROM (SELECT split_part(key, '/', 1) AS p, count(*) AS n FROM P GROUP BY 1) GROUP BY 1, 3")
def _(s, d):
    return stats.child_mass(paging.entries(V.pages(s, d), Request(delimiter=b"/")))


@query("alphabet_cardinality", "SELECT i::INT AS position, count(DISTINCT substr(key, i + 1, 1))::BIGINT AS n_bytes FROM P, range(8) AS r(i) WHERE length(key) > i GROUP BY 1")
def _(s, d):
    return stats.alphabet(V.pages(s, d))


_LCP = "(SELECT coalesce(max(i), 0) FROM range(1, 40) AS r(i) WHERE i <= least(length(a), length(b)) AND substr(a, 1, i) = substr(b, 1, i))"


@query("lcp_histogram", f"SELECT least({_LCP}, 15)::INT AS depth, count(*)::BIGINT AS n_pairs FROM (SELECT min(key) AS a, max(key) AS b FROM P GROUP BY split_part(key, '/', 1)) GROUP BY 1")
def _(s, d):
    pairs = V.pages(s, d).groupBy(F.split_part(F.col("key").cast("string"), F.lit("/"), F.lit(1))).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    return stats.divergence(pairs)


@query("pivot_regions", f"SELECT CASE WHEN c BETWEEN 48 AND 57 THEN 'hex_digit' WHEN c BETWEEN 58 AND 96 THEN 'dead_zone' WHEN c BETWEEN 97 AND 102 THEN 'hex_alpha' ELSE 'other' END AS region, count(*)::BIGINT AS n FROM (SELECT coalesce(ascii(nullif(substr(b, 1 + {_LCP}, 1), '')), 0) AS c FROM (SELECT min(key) AS a, max(key) AS b FROM P GROUP BY substr(key, 1, 2))) GROUP BY 1")
def _(s, d):
    pairs = V.pages(s, d).groupBy(F.substring("key", 1, 2)).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    return pairs.groupBy(stats.pivot_region(F.col("a"), F.col("b")).alias("region")).agg(F.count("*").alias("n"))


@query("fanout", "SELECT max(n)::BIGINT AS most, sum(n)::BIGINT AS total, count(*)::BIGINT AS n_probes FROM (SELECT split_part(key, '/', 1) AS p, count(DISTINCT split_part(key, '/', 2)) AS n FROM D GROUP BY 1)")
def _(s, d):
    two = F.split(F.col("key").cast("string"), "/")
    return stats.fanout(V.documents(s, d).select(two[0].alias("parent"), two[1].alias("child")).distinct())


@query("partition_fanout", "SELECT coalesce(avg((prefix LIKE '%=%')::INT), 0) > 0.5 AS partitioned, count(*)::BIGINT AS n_children FROM (SELECT DISTINCT 'year=' || split_part(key, '/', 1) || '/' AS prefix FROM L)")
def _(s, d):
    years = V.lines(s, d).select(F.concat(F.lit("year="), F.split_part(F.col("key").cast("string"), F.lit("/"), F.lit(1)), F.lit("/")).alias("prefix")).distinct()
    return stats.partitioned(years)


@query("latency_percentiles", "SELECT kind, count(*)::BIGINT AS n, round(quantile_cont(cents, 0.5), 6) AS p50, round(quantile_cont(cents, 0.9), 6) AS p90, round(quantile_cont(cents, 0.99), 6) AS p99, max(cents)::BIGINT AS most FROM E GROUP BY 1")
def _(s, d):
    rows = stats.percentiles(V.events(s, d), "cents", "kind")
    return rows.withColumns({p: F.round(p, 6) for p in ("p50", "p90", "p99")})


@query("nearest_rank", "SELECT kind, min(cents) FILTER (r >= ceil(0.5::DECIMAL(3,2) * n))::DOUBLE AS p50, min(cents) FILTER (r >= ceil(0.9::DECIMAL(3,2) * n))::DOUBLE AS p90, min(cents) FILTER (r >= ceil(0.99::DECIMAL(3,2) * n))::DOUBLE AS p99 FROM (SELECT kind, cents, row_number() OVER (PARTITION BY kind ORDER BY cents) AS r, count(*) OVER (PARTITION BY kind) AS n FROM E) GROUP BY 1")
def _(s, d):
    rows = stats.nearest_rank(V.events(s, d), "cents", "kind")
    return rows.withColumns({p: F.col(p).cast("double") for p in ("p50", "p90", "p99")})


@query("page_fill", "SELECT count(*)::BIGINT AS n_pages, sum(n)::BIGINT AS n_keys, count(*) FILTER (n < 40 AND p < 100000)::BIGINT AS n_short FROM (SELECT us AS p, count(*) AS n FROM L GROUP BY us)")
def _(s, d):
    rows = V.lines(s, d).groupBy("last_modified").agg(F.count("*").alias("n_keys")).select("n_keys", F.lit(40).alias("page_size"), (F.unix_micros("last_modified") < 100000).alias("truncated"))
    return stats.page_fill(rows)


@query("slow_ranges", "SELECT range_id, CASE WHEN l IS NULL THEN 'inf'::DOUBLE WHEN c <= 0 THEN l ELSE round(k / c * l, 6) END AS remaining FROM (SELECT worker AS range_id, count(*)::DOUBLE AS k, (sum(cents) % 11)::DOUBLE AS c, CASE WHEN worker % 50 = 0 THEN NULL ELSE (sum(cents) % 97)::DOUBLE END AS l FROM E GROUP BY worker) ORDER BY CASE WHEN l IS NULL THEN 'inf'::DOUBLE WHEN c <= 0 THEN l ELSE k / c * l END DESC, range_id LIMIT 10")
def _(s, d):
    total = F.sum("cents")
    rows = V.events(s, d).groupBy(F.col("worker").alias("range_id")).agg(F.count("*").cast("double").alias("keys"), (total % 11).cast("double").alias("consumed"), F.when(F.col("worker") % 50 != 0, (total % 97).cast("double")).alias("left"))
    return stats.slowest(rows).select("range_id", F.when(F.col("remaining") == float("inf"), F.col("remaining")).otherwise(F.round("remaining", 6)).alias("remaining"))


@query("meter_snapshot", "SELECT kind AS name, run::VARCHAR AS tags, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total, round(avg(cents), 6) AS mean, max(cents)::BIGINT AS most, round(quantile_cont(cents, 0.5), 6) AS p50, round(quantile_cont(cents, 0.99), 6) AS p99 FROM E GROUP BY 1, 2")
def _(s, d):
    rows = stats.meters(V.events(s, d).select(F.col("kind").alias("name"), F.col("run").cast("string").alias("tags"), F.col("cents").alias("value")))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p99")})


@query("meter_delta", ", a AS (SELECT kind AS name, worker::VARCHAR AS tags, sum(cents) AS v FROM E GROUP BY 1, 2), b AS (SELECT CASE WHEN worker % 10 = 0 THEN 'new_' || kind ELSE kind END AS name, worker::VARCHAR AS tags, sum(cents + depth) AS v FROM E GROUP BY 1, 2) SELECT coalesce(a.name, b.name) AS name, coalesce(a.tags, b.tags) AS tags, (coalesce(b.v, 0) - coalesce(a.v, 0))::BIGINT AS delta FROM a FULL JOIN b ON a.name = b.name AND a.tags = b.tags")
def _(s, d):
    rows = V.events(s, d).withColumn("tags", F.col("worker").cast("string"))
    later = F.when(F.col("worker") % 10 == 0, F.concat(F.lit("new_"), F.col("kind"))).otherwise(F.col("kind"))
    before = rows.groupBy(F.col("kind").alias("name"), "tags").agg(F.sum("cents").alias("value"))
    return compare.meter_delta(before, rows.groupBy(later.alias("name"), "tags").agg(F.sum(F.col("cents") + F.col("depth")).alias("value")))


@query("reason_counts", "SELECT kind, run, count(*)::BIGINT AS n FROM E GROUP BY 1, 2")
def _(s, d):
    return stats.reasons(V.events(s, d), "kind", "run")


# ---- order ---------------------------------------------------------------------


@query("global_sort_rank", "SELECT substr(key, 1, 10) AS key, row_type, row_number() OVER (ORDER BY substr(key, 1, 10), CASE WHEN size % 3 = 0 THEN '' ELSE lpad(size::VARCHAR, 12, '0') || key END, CASE row_type WHEN 'OBJECT' THEN 0 ELSE 2 END)::BIGINT AS n FROM O")
def _(s, d):
    # versions of a day's key; rows without one come first
    rows = V.orders(s, d).withColumns({"version_id": F.when(F.col("size") % 3 > 0, F.concat(F.lpad(F.col("size").cast("string"), 12, "0"), F.col("key").cast("string"))), "key": F.substring("key", 1, 10)})
    rows = rows.withColumn("rank", type_rank(F.col("row_type"))).withColumn("version", F.coalesce("version_id", F.lit("")))
    return text(sorting.numbered(rows, ["key", "version", "rank"]), "row_type", "n")


@query("sort_parts", "SELECT count(*)::BIGINT AS n_rows, (count(*) - count(DISTINCT key))::BIGINT AS n_not_above, 0::BIGINT AS n_overlaps FROM L")
def _(s, d):
    rows = sorting.sort_listing(V.lines(s, d).select("key", "version_id", "row_type"), 8).select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    from keyloom.plans.storage import kept

    rows = kept(rows, "parts")
    checks = sorting.order_check(rows).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_not_above").alias("n_not_above"))
    ends = rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).withColumn("before", F.lag("high").over(Window.orderBy("part")))
    return checks.join(ends.agg(F.count_if(F.col("before") >= F.col("low")).alias("n_overlaps")), F.lit(True))


@query("sort_checks", "SELECT storage_class AS part, count(*)::BIGINT AS n_rows, count(*) FILTER (key <= b)::BIGINT AS n_not_above FROM (SELECT *, lag(key) OVER (PARTITION BY storage_class ORDER BY size, key) AS b FROM L) GROUP BY 1")
def _(s, d):
    rows = V.lines(s, d).withColumn("part", F.col("storage_class")).withColumn("place", F.struct("size", "key"))
    return sorting.order_check(rows)


@query("duplicates", "SELECT substr(key, 1, 10) AS key, count(*)::BIGINT AS n_rows FROM L GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return text(sorting.duplicates(V.lines(s, d).select(F.substring("key", 1, 10).alias("key"))), "n_rows")


@query("range_boundaries", ", k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM L)) SELECT j::BIGINT AS j, key FROM k JOIN range(1, 8) AS r(j) ON i = j * n // 8")
def _(s, d):
    rows = sorting.boundaries(V.lines(s, d), 8)
    return rows.select("j", F.col("key").cast("string").alias("key"))


@query("even_subsample", ", k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM D)) SELECT key, (i + 1)::BIGINT AS n FROM k WHERE i IN (SELECT j * (n - 1) // 99 FROM range(100) AS r(j))")
def _(s, d):
    return text(sorting.even_subsample(V.documents(s, d), 100), "n")


@query("page_sample", ", k AS (SELECT key, row_number() OVER (ORDER BY key) AS n FROM L), pp AS (SELECT key, (n - 1) // 25 AS page FROM k WHERE n % 25 = 1) SELECT page::BIGINT AS page, key FROM pp WHERE page % greatest(1, ((SELECT count(*) FROM pp) + 255) // 256) = 0")
def _(s, d):
    rows = sorting.page_sample(V.lines(s, d), 25, 256)
    return rows.select("page", F.col("key").cast("string").alias("key"))


@query("mass_subsample", """, k AS (SELECT key, m, row_number() OVER (ORDER BY key) AS i FROM (SELECT key, sum(size)::BIGINT AS m FROM P GROUP BY 1)), st AS (SELECT sum(m)::DOUBLE / 40 AS step, count(*) AS n FROM k),
r AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS acc, step AS nxt, false AS hit, 0 AS c FROM st UNION ALL
  SELECT k.i, acc + m, CASE WHEN c < 40 AND acc + m + 1e-9 >= nxt THEN acc + m + step ELSE nxt END, c < 40 AND acc + m + 1e-9 >= nxt, c + (c < 40 AND acc + m + 1e-9 >= nxt)::INT FROM r JOIN k ON k.i = r.i + 1 CROSS JOIN st)
SELECT key FROM k JOIN r ON k.i = r.i CROSS JOIN st WHERE hit OR n <= 40""")
def _(s, d):
    return text(sorting.mass_subsample(V.pages(s, d).groupBy("key").agg(F.sum("size").alias("mass")), 40))


@query("top_k_mass", "SELECT key, size FROM L ORDER BY size DESC, key LIMIT 20")
def _(s, d):
    return text(V.lines(s, d).orderBy(F.col("size").desc(), "key").limit(20), "size")


# ---- text forms ----------------------------------------------------------------

_ISO = "CASE WHEN us = 0 THEN '' WHEN us % 1000000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') WHEN us % 1000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END"


@query("tsv_rows", f"SELECT concat_ws(chr(9), key, size::VARCHAR, {_ISO}, etag, '', 'OBJECT') AS line FROM P")
def _(s, d):
    return formats.lines(V.pages(s, d), "tsv")


@query("jsonl_rows", f"""SELECT '{{"key":"' || key || '","size":' || size || ',"last_modified":"' || {_ISO} || '","etag":"' || etag || '","row_type":"OBJECT"}}' AS line FROM P""")
def _(s, d):
    return formats.lines(V.pages(s, d), "jsonl")


@query("jsonl_markers", f"""SELECT CASE WHEN row_type = 'OBJECT' THEN '{{"key":"a\\\\u000b\\u000b\\u001f' || key || '","size":' || size || ',"last_modified":"' || {_ISO} || '","storage_class":"' || storage_class || '","version_id":"v","is_latest":true,"owner_id":"o","row_type":"OBJECT"}}'
  ELSE '{{"key":"a\\\\u000b\\u000b\\u001f' || key || '","version_id":"v","is_latest":true,"last_modified":"' || {_ISO} || '","owner_id":"o","row_type":"DELETE_MARKER"}}' END AS line FROM O""")
def _(s, d):
    rows = V.orders(s, d).withColumn("key", F.concat(F.lit(b"a\\u000b\x0b\x1f"), "key"))
    return formats.lines(rows.withColumns({"version_id": F.lit("v"), "is_latest": F.lit(True), "owner_id": F.lit("o")}), "jsonl")


@query("table_rows", f"SELECT lpad(CASE row_type WHEN 'OBJECT' THEN size::VARCHAR ELSE '-' END, 14, ' ') || '  ' || rpad({_ISO}, 24, ' ') || '  ' || key AS line FROM O")
def _(s, d):
    return formats.lines(V.orders(s, d), "table")


@query("xml_rows", """SELECT '<Contents><Key>' || replace(replace(replace(replace(key, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</Key><LastModified>' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z</LastModified><ETag>&quot;' || etag || '&quot;</ETag><Size>' || size || '</Size></Contents>' AS line FROM P""")
def _(s, d):
    return V.pages(s, d).select(formats.xml_entry().alias("line"))


@query("output_bytes", f"SELECT count(*)::BIGINT AS n_lines, sum(strlen(concat_ws(chr(9), key, size::VARCHAR, {_ISO}, etag, '', 'OBJECT')) + 1)::BIGINT AS n_bytes FROM P")
def _(s, d):
    return stats.output_bytes(formats.lines(V.pages(s, d), "tsv"))


@query("percent_encoded", "SELECT key, replace(url_encode(key), '%2F', '/') AS encoded FROM P")
def _(s, d):
    return V.pages(s, d).select(F.col("key").cast("string").alias("key"), K.percent_encode(F.col("key")).alias("encoded"))


@query("escaped_keys", "SELECT replace(replace(replace(key, 'e', chr(9)), '/', chr(127)), 't', chr(1)) AS raw, replace(replace(replace(key, 'e', '\\x09'), '/', '\\x7F'), 't', '\\x01') AS escaped FROM P")
def _(s, d):
    raw = F.translate(F.col("key").cast("string"), "e/t", "\t\x7f\x01")
    return V.pages(s, d).select(raw.alias("raw"), K.escape_controls(raw).alias("escaped"))


@query("tokens", "SELECT key, 'v2:' || rtrim(replace(replace(base64(encode(chr(0)) || encode(key)), '+', '-'), '/', '_'), '=') AS token, key AS again FROM P")
def _(s, d):
    made = V.pages(s, d).select(F.col("key").cast("string").alias("key"), K.token(F.col("key")).alias("token"))
    return made.withColumn("again", K.token_key(F.col("token")).cast("string"))


@query("iso_times", f"SELECT event_id, {_ISO} AS iso FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN us // 1000000 * 1000000 WHEN 1 THEN us // 1000 * 1000 WHEN 2 THEN 0 ELSE us END AS us FROM (SELECT event_id, at + 1704067200000000 AS us FROM E))")
def _(s, d):
    us = F.col("at") + 1_704_067_200_000_000
    cut = F.when(F.col("event_id") % 4 == 0, F.floor(us / 1_000_000) * 1_000_000).when(F.col("event_id") % 4 == 1, F.floor(us / 1000) * 1000).when(F.col("event_id") % 4 == 2, 0).otherwise(us)
    return V.events(s, d).select("event_id", K.iso_time(F.timestamp_micros(cut.cast("bigint"))).alias("iso"))


@query("key_lengths", "SELECT key, strlen(key)::INT AS n_bytes, upper(hex(encode(key))) AS hex FROM P")
def _(s, d):
    return V.pages(s, d).select(F.col("key").cast("string").alias("key"), F.octet_length("key").alias("n_bytes"), F.hex("key").alias("hex"))


@query("identities", "SELECT key, sha256(key || chr(0) || coalesce(nullif(etag, etag), '') || chr(0)) AS identity FROM P")
def _(s, d):
    none = F.lit(None).cast("string")
    field = lambda c: F.concat(F.coalesce(c, F.lit("")), F.chr(F.lit(0)))
    return V.pages(s, d).select(F.col("key").cast("string").alias("key"), F.sha2(F.concat(field(F.col("key").cast("string")), field(none)), 256).alias("identity"))


# ---- keys ----------------------------------------------------------------------


@query("successor", "SELECT key, substr(key, 1, length(key) - 1) || chr(ascii(substr(key, length(key), 1)) + 1) AS next FROM P")
def _(s, d):
    return V.pages(s, d).select(F.col("key").cast("string").alias("key"), K.successor(F.col("key")).cast("string").alias("next"))


@query("frac_in", f"""SELECT g, key, round(CASE WHEN fb <= fa THEN 0 ELSE least(greatest((fk - fa) / (fb - fa), 0), 1) END, 9) AS position FROM (
  SELECT g, key, (SELECT sum(coalesce(ascii(nullif(substr(a, n + i, 1), '')), 0) / pow(256.0, i)) FROM range(1, 13) AS r(i)) AS fa, (SELECT sum(coalesce(ascii(nullif(substr(b, n + i, 1), '')), 0) / pow(256.0, i)) FROM range(1, 13) AS r(i)) AS fb, (SELECT sum(coalesce(ascii(nullif(substr(key, n + i, 1), '')), 0) / pow(256.0, i)) FROM range(1, 13) AS r(i)) AS fk
  FROM (SELECT *, {_LCP} AS n FROM (SELECT split_part(key, '/', 1) AS g, key, min(key) OVER (PARTITION BY split_part(key, '/', 1)) AS a, max(key) OVER (PARTITION BY split_part(key, '/', 1)) AS b FROM P)))""")
def _(s, d):
    g = F.split_part(F.col("key").cast("string"), F.lit("/"), F.lit(1))
    w = Window.partitionBy("g")
    rows = V.pages(s, d).select(g.alias("g"), "key").withColumn("a", F.min("key").over(w)).withColumn("b", F.max("key").over(w))
    return rows.select("g", F.col("key").cast("string").alias("key"), F.round(K.fraction_in(F.col("key"), F.col("a"), F.col("b")), 9).alias("position"))


@query("midpoints")
def _(s, d):
    g = F.split_part(F.col("key").cast("string"), F.lit("/"), F.lit(1))
    pairs = V.pages(s, d).groupBy(g.alias("g")).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    made = pairs.withColumn("m", K.midpoint("a", "b")).withColumn("f", K.ahead("a", "b"))
    return made.select("g", F.col("m").cast("string").alias("middle"), F.hex("f").alias("ahead"), ((F.col("a") < F.col("m")) & (F.col("m") < F.col("b"))).alias("inside"))


_MIX = "(({z}::UHUGEINT * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


@query("family_positions", ", k AS (SELECT key, sum(size)::DOUBLE AS m FROM P GROUP BY 1), x AS (SELECT key, sum(m) OVER (ORDER BY key) / sum(m) OVER () AS upto FROM k), f AS (SELECT regexp_replace(split_part(key, '/', 1), '[0-9]{6,}', 'N', 'g') AS family, sum(size)::BIGINT AS mass, min(key) AS a, max(key) AS b FROM P GROUP BY 1 ORDER BY mass DESC, family LIMIT 10) SELECT family, mass, round(xa.upto, 9) AS first_position, round(xb.upto, 9) AS last_position FROM f JOIN x xa ON xa.key = a JOIN x xb ON xb.key = b")
def _(s, d):
    p = V.pages(s, d)
    rows = trace.family_positions(trace.families(p, key="key", mass="size"), trace.mass_axis(p, "key", "size"))
    return rows.select("family", "mass", *[F.round(c, 9).alias(c) for c in ("first_position", "last_position")])


@query("mixed_hashes", f""", a AS (SELECT o_orderkey AS id, xor(o_orderkey::UBIGINT, o_orderkey::UBIGINT >> 30) AS z FROM orders), b AS (SELECT id, {_MIX.format(z='z', m=0xBF58476D1CE4E5B9)} AS z FROM a), c AS (SELECT id, {_MIX.format(z='xor(z, z >> 27)', m=0x94D049BB133111EB)} AS z FROM b), mixed AS (SELECT id, xor(z, z >> 31) AS z FROM c)
SELECT id, (z::HUGEINT - CASE WHEN z >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS mixed FROM mixed""")
def _(s, d):
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), K.mix64(F.col("o_orderkey")).alias("mixed"))


@query("alphabet_choice", ", ch AS (SELECT p AS place, substr(key, 6 + p, 1) AS c FROM L, range(5) AS r(p) WHERE starts_with(key, '1997/')), a AS (SELECT place, list_sort(list(DISTINCT c)) AS seen FROM ch GROUP BY 1), f AS (SELECT place, seen, list_filter(seen, lambda x: x > '0' AND x < '9') AS room FROM a) SELECT place::INT AS place, array_to_string(seen, '') AS seen, room[least(floor(0.6 * len(room))::INT, len(room) - 1) + 1] AS chosen FROM f")
def _(s, d):
    found = alphabet.alphabet(V.lines(s, d), "1997/", 5)
    return found.select("place", F.array_join("seen", "").alias("seen"), alphabet.choose(F.col("seen"), F.lit("0"), F.lit("9"), 0.6).alias("chosen"))


@query("shape_latencies", "SELECT key, CASE WHEN size % 3 = 0 THEN 223000 + 55000 * (size % 11) WHEN size % 3 = 1 THEN 121000 ELSE 223000 END::BIGINT AS micros FROM O")
def _(s, d):
    n = F.col("size")
    at = latency.shape_latency(latency.parse_profile("measured"), F.when(n % 3 == 0, "/"), F.when(n % 3 == 1, 1).otherwise(1000), n % 11, F.xxhash64("key"))
    return text(V.orders(s, d).withColumn("micros", at), "micros")


@query("key_families", "SELECT regexp_replace(split_part(key, '/', 1), '[0-9]{6,}', 'N', 'g') AS family, sum(size)::BIGINT AS mass, count(DISTINCT split_part(key, '/', 1))::BIGINT AS n_dirs, min(key) AS first_key, max(key) AS last_key FROM P GROUP BY 1 ORDER BY mass DESC, family LIMIT 10")
def _(s, d):
    rows = trace.families(V.pages(s, d), key="key", mass="size")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_key", "last_key")})


# ---- time ----------------------------------------------------------------------


@query("time_weighted_avg", "SELECT run, round(sum(depth * h) / sum(h), 9) AS average, sum(h)::BIGINT AS elapsed FROM (SELECT run, depth::DOUBLE AS depth, (lead(at) OVER (PARTITION BY run ORDER BY at) - at)::DOUBLE AS h FROM E) GROUP BY 1")
def _(s, d):
    rows = timeline.step_average(V.events(s, d), "run", "at", "depth")
    return rows.withColumn("average", F.round("average", 9))


_TRAJ = """, smp AS (SELECT run, at, depth, at - coalesce(lag(at) OVER (PARTITION BY run ORDER BY at), 0) AS w, row_number() OVER (PARTITION BY run ORDER BY at) AS k FROM E),
wid AS (SELECT run, max(at) AS most, (1000000 * pow(2, greatest(ceil(log2((max(at) + 1)::DOUBLE / 30000000)), 0)))::BIGINT AS width FROM smp GROUP BY 1),
bin AS (SELECT run, width, at // width AS bin, sum(w)::BIGINT AS elapsed, sum(depth * w)::DOUBLE / sum(w) AS average, count(*) / (sum(w) / 1e6) AS rate FROM smp JOIN wid USING (run) GROUP BY 1, 2, 3),
bins AS (SELECT run, width, bin, coalesce(elapsed, 0) AS elapsed, coalesce(average, 0) AS average, coalesce(rate, 0) AS rate FROM (SELECT run, width, unnest(range(most // width + 1)) AS bin FROM wid) LEFT JOIN bin USING (run, width, bin))"""


def _samples(s, d):
    w = Window.partitionBy("run").orderBy("at")
    rows = V.events(s, d)
    return rows.select("run", "at", "depth", (F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(0))).alias("w"), F.row_number().over(w).alias("k"))


@query("trajectory_bins", _TRAJ + " SELECT run, width, bin, elapsed, round(average, 9) AS average, round(rate, 9) AS rate FROM bins")
def _(s, d):
    rows = timeline.trajectory(_samples(s, d), "run", "at", "w", "depth", "k")
    return rows.withColumns({c: F.round(c, 9) for c in ("average", "rate")})


@query("trajectory_summary", _TRAJ + ", x AS (SELECT run, sum(elapsed) AS t, sum(CASE WHEN average <= 2 THEN elapsed ELSE 0 END) AS low, coalesce(max(CASE WHEN average > 2 THEN bin END) + 1, 0) AS b, max(bin) + 1 AS used, round(max_by(average, bin))::BIGINT AS final FROM bins GROUP BY 1) SELECT run, round(low / t, 9) AS serial_share, CASE WHEN b >= used THEN -1 ELSE round(b / used, 9) END::DOUBLE AS collapse_at, final FROM x")
def _(s, d):
    rows = timeline.trajectory_summary(timeline.trajectory(_samples(s, d), "run", "at", "w", "depth", "k"), "run")
    return rows.withColumns({c: F.round(c, 9) for c in ("serial_share", "collapse_at")})


@query("tail_window", ", k AS (SELECT run, at, depth, row_number() OVER (PARTITION BY run ORDER BY at) AS k FROM E), m AS (SELECT run, max(k) AS t, max(at) AS e FROM k GROUP BY 1) SELECT run, round(avg(depth), 9) AS average, round(1 - min(at)::DOUBLE / max(e), 9) AS time_share FROM k JOIN m USING (run) WHERE k >= t * 0.95::DOUBLE GROUP BY 1")
def _(s, d):
    rows = timeline.tail_window(_samples(s, d), "run", "k", "at", "depth", 5)
    return rows.withColumns({c: F.round(c, 9) for c in ("average", "time_share")})


_LIVE = "(SELECT run, at, event_id, CASE WHEN kind IN ('click', 'view') THEN 1 ELSE -1 END AS c FROM E)"


@query("peak_live", f", lv AS (SELECT run, at, sum(c) OVER (PARTITION BY run ORDER BY at, c DESC ROWS UNBOUNDED PRECEDING) AS live FROM {_LIVE}), m AS (SELECT run, max(live) AS peak FROM lv GROUP BY 1) SELECT run, peak::BIGINT AS peak, min(at)::BIGINT AS peak_at FROM lv JOIN m USING (run) WHERE live = peak GROUP BY 1, 2")
def _(s, d):
    rows = V.events(s, d).withColumn("change", F.when(F.col("kind").isin("click", "view"), 1).otherwise(-1))
    return timeline.peak_live(rows, "run", "at", "change")


@query("time_bins120", ", m AS (SELECT min(at) AS a, max(at) AS b FROM E), s AS (SELECT least(floor(120 * (at - a)::DOUBLE / (b - a)), 119)::BIGINT AS bin, sum(cents)::BIGINT AS mass, count(*)::BIGINT AS n FROM E, m GROUP BY 1) SELECT bin, mass, n, round(mass / max(mass) OVER (), 9) AS share FROM s")
def _(s, d):
    return timeline.time_bins(V.events(s, d), "at", "cents").withColumn("share", F.round("share", 9))


@query("ewma", ", oo AS (SELECT run, cents::DOUBLE AS v, row_number() OVER (PARTITION BY run ORDER BY at) AS i FROM E), f AS (SELECT run, i, v AS e FROM oo WHERE i = 1 UNION ALL SELECT oo.run, oo.i, f.e * 0.8 + oo.v * 0.2 FROM f JOIN oo ON oo.run = f.run AND oo.i = f.i + 1) SELECT run, round(max_by(e, i), 6) AS ewma FROM f GROUP BY 1")
def _(s, d):
    return timeline.ewma(V.events(s, d), "run", "at", "cents", 0.2).withColumn("ewma", F.round("ewma", 6))


@query("density_shares", "SELECT run, worker, round(CASE WHEN o > 0 THEN greatest(least(0.5 + 0.25 * least(t / o, 1), 0.75), 0.5) ELSE 0.5 END, 9) AS share FROM (SELECT run, worker, avg(depth) AS o, avg(depth) FILTER (at > 1296000000000) AS t FROM E GROUP BY 1, 2)")
def _(s, d):
    rows = V.events(s, d).groupBy("run", "worker").agg(F.avg("depth").alias("o"), F.avg(F.when(F.col("at") > 1_296_000_000_000, F.col("depth"))).alias("t"))
    return rows.select("run", "worker", F.round(timeline.density_share(F.col("t"), F.col("o")), 9).alias("share"))


@query("window_verdicts", "SELECT run, ((i - 1) // 32)::BIGINT AS \"window\", count(*)::BIGINT AS n, round(avg(g), 9) AS share, count(*) = 32 AND avg(g) >= 0.5 AS passes FROM (SELECT run, (depth >= 3)::INT AS g, row_number() OVER (PARTITION BY run ORDER BY at) AS i FROM E) GROUP BY 1, 2")
def _(s, d):
    rows = V.events(s, d).withColumn("good", F.col("depth") >= 3)
    return timeline.window_verdicts(rows, "run", "at", "good", 32, 0.5).withColumn("share", F.round("share", 9))


@query("live_rate", "SELECT run, round(max_by(r, at), 9) AS rate FROM (SELECT run, at, 1 / ((at - lag(at) OVER (PARTITION BY run ORDER BY at)) / 1e6) AS r FROM E) GROUP BY 1")
def _(s, d):
    return timeline.live_rate(_samples(s, d), "run", "at", "k").withColumn("rate", F.round("rate", 9))


@query("stuck_runs", ", lst AS (SELECT worker, max(at) FILTER (kind = 'purchase') AS t FROM E GROUP BY 1), c AS (SELECT worker, kind, count(*) AS n FROM E JOIN lst USING (worker) WHERE (t IS NULL OR at > t) AND kind <> 'purchase' GROUP BY 1, 2), b AS (SELECT worker, sum(n) AS total, max(n) AS m, max(kind) FILTER (n = x) AS k FROM (SELECT *, max(n) OVER (PARTITION BY worker) AS x FROM c) GROUP BY 1) SELECT worker, total::BIGINT AS total, CASE WHEN total >= 4 AND m * 2 > total THEN k END AS stuck_on FROM b")
def _(s, d):
    rows = V.events(s, d).withColumn("kind", F.when(F.col("kind") == "purchase", "progress").otherwise(F.col("kind")))
    return timeline.stuck(rows, "worker", "at", "kind", 4)


@query("run_summaries", ", k AS (SELECT run, at, depth, kind, row_number() OVER (PARTITION BY run ORDER BY at) AS k, coalesce(lead(at) OVER (PARTITION BY run ORDER BY at) - at, 0) AS h FROM E), s AS (SELECT run, max(at) FILTER (kind = 'signup') AS p FROM E GROUP BY 1) SELECT run, round((max(at) - max(p))::DOUBLE / (max(at) - min(at)), 9) AS tail_share, round(max(k) / ((max(at) - min(at)) / 1e6), 9) AS rate, round(CASE WHEN max(at) > max(p) THEN (max(k) - min(k) FILTER (at >= p)) / ((max(at) - max(p)) / 1e6) END, 9) AS tail_rate, round(sum(depth * h)::DOUBLE / sum(h), 9) AS occupancy, round(sum(depth * h) FILTER (at >= p)::DOUBLE / nullif(sum(h) FILTER (at >= p), 0), 9) AS tail_occupancy, round(coalesce(sum(h) FILTER (depth <= 2), 0)::DOUBLE / sum(h), 9) AS serial_share, max(depth)::BIGINT AS most FROM k JOIN s USING (run) GROUP BY 1")
def _(s, d):
    last = V.events(s, d).where("kind = 'signup'").groupBy("run").agg(F.max("at").alias("p"))
    rows = timeline.run_summary(_samples(s, d).join(last, "run"), "run", "at", "depth", "k", "p")
    return rows.withColumns({c: F.round(c, 9) for c in ("tail_share", "rate", "tail_rate", "occupancy", "tail_occupancy", "serial_share")})


# ---- traces --------------------------------------------------------------------

_ROOTS = ", up AS (SELECT child_node_id AS node, node_id AS up FROM T WHERE event IN ('split', 'owner_split')), r AS (SELECT node_id AS node, node_id AS root FROM T WHERE event = 'seeded' UNION ALL SELECT up.node, r.root FROM up JOIN r ON up.up = r.node)"


@query("lineage_roots", _ROOTS + " SELECT node, root FROM r")
def _(s, d):
    return trace.lineage(V.trace(s, d))


@query("top_seeds", _ROOTS + " SELECT root, coalesce(sum(keys), 0)::BIGINT AS keys, count(*) FILTER (event IN ('split', 'owner_split'))::BIGINT AS n_splits, count(DISTINCT CASE WHEN event = 'claimed' THEN worker_id END)::BIGINT AS n_workers FROM T JOIN r ON node_id = node GROUP BY 1 ORDER BY keys DESC, root LIMIT 14")
def _(s, d):
    events = V.trace(s, d)
    return trace.seeds(events, trace.lineage(events)).orderBy(F.col("keys").desc(), "root").limit(14)


@query("seed_findings", _ROOTS + ", b AS (SELECT root, coalesce(sum(keys), 0)::BIGINT AS k FROM T JOIN r ON node_id = node GROUP BY 1), x AS (SELECT root, k, row_number() OVER (ORDER BY k DESC, root) AS n FROM b), m AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS c FROM x WHERE n > 1 AND k > 0) SELECT count(*)::BIGINT AS n_seeds, count(*) FILTER (k = 0)::BIGINT AS n_empty, max(root) FILTER (n = 1) AS top_seed, max(k) AS top_keys, round(100.0 * max(k) / sum(k), 9) AS top_share, (SELECT k FROM m WHERE i = c // 2) AS median_keys, (max(k) // (SELECT k FROM m WHERE i = c // 2))::BIGINT AS ratio FROM x")
def _(s, d):
    events = V.trace(s, d)
    rows = trace.seed_findings(trace.seeds(events, trace.lineage(events)))
    return rows.withColumn("top_share", F.round("top_share", 9))


@query("ledger_check", ", lg AS (SELECT count(*) FILTER (event = 'seeded')::BIGINT AS n_seeds, count(*) FILTER (event IN ('split', 'owner_split'))::BIGINT AS n_splits, count(*) FILTER (event = 'claimed')::BIGINT AS n_claimed, count(*) FILTER (event = 'completed')::BIGINT AS n_completed, count(*) FILTER (event = 'failed')::BIGINT AS n_failed FROM T) SELECT *, n_seeds + n_splits = n_claimed AND n_claimed = n_completed AND n_failed = 0 AS ok FROM lg")
def _(s, d):
    return trace.ledger(V.trace(s, d))


@query("page_costs", "SELECT count(*)::BIGINT AS n_pages, sum(keys)::BIGINT AS n_keys, round(1000.0 * count(*) / sum(keys), 9) AS per_1000, ceil(sum(keys) / 1000)::BIGINT AS least_pages FROM T WHERE event = 'page_committed'")
def _(s, d):
    return trace.page_costs(V.trace(s, d)).withColumn("per_1000", F.round("per_1000", 9))


@query("mechanisms", "SELECT event AS kind, mechanism, count(*)::BIGINT AS n, coalesce(array_to_string(list(pivot ORDER BY ts_ns) FILTER (i <= 3), ','), '') AS pivots FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY ts_ns) AS i FROM T WHERE event IN ('split', 'owner_split')) GROUP BY 1, 2")
def _(s, d):
    return trace.mechanisms(V.trace(s, d)).withColumn("pivots", F.array_join("pivots", ","))


@query("steal_outcomes", "SELECT kind || ' / ' || depth AS name, count(*)::BIGINT AS n FROM E GROUP BY 1")
def _(s, d):
    rows = V.events(s, d).select(F.lit("steal_attempt").alias("event"), F.col("kind").alias("outcome"), F.col("depth").cast("string").alias("reason"))
    return trace.outcomes(rows)


@query("gate_reasons", "SELECT kind AS reason, count(*)::BIGINT AS n, true AS blocked FROM E GROUP BY 1 ORDER BY n DESC, reason LIMIT 6")
def _(s, d):
    return trace.gates(V.events(s, d).select(F.lit("owner_split_decision").alias("event"), F.col("kind").alias("reason")))


@query("busy_time", "SELECT round(sum(cents), 6)::DOUBLE AS busy, round(sum(cents) / 16, 6)::DOUBLE AS ideal, round(greatest((max(at + cents) - min(at))::DOUBLE * 16 - sum(cents), 0), 6) AS idle, round(100.0 * sum(cents) / 16 / (max(at + cents) - min(at)), 9) AS speedup_percent FROM E")
def _(s, d):
    rows = trace.busy_time(V.events(s, d).select(F.col("at").alias("begin"), (F.col("at") + F.col("cents")).alias("end")), 16)
    return rows.select(*[F.round(c, 6).alias(c) for c in ("busy", "ideal", "idle")], F.round("speedup_percent", 9).alias("speedup_percent"))


@query("mass_cdf", ", k AS (SELECT key, sum(size)::DOUBLE AS m FROM P GROUP BY 1) SELECT key, m::BIGINT AS mass, round(sum(m) OVER (ORDER BY key) / sum(m) OVER (), 9) AS upto FROM k")
def _(s, d):
    rows = trace.mass_axis(V.pages(s, d), "key", "size")
    return rows.select(F.col("key").cast("string").alias("key"), "mass", F.round("upto", 9).alias("upto"))


@query("mass_positions", """, k AS (SELECT key || '5' AS key, sum(size)::DOUBLE AS m FROM P GROUP BY 1), x AS (SELECT key, sum(m) OVER (ORDER BY key) / sum(m) OVER () AS upto FROM k),
q AS (SELECT DISTINCT key AS k FROM P),
nb AS (SELECT k, (SELECT max(key) FROM x WHERE key <= k) AS a, (SELECT min(key) FROM x WHERE key >= k) AS b FROM q),
f AS (SELECT k, a, b, CASE WHEN a IS NULL THEN 0 ELSE (SELECT coalesce(max(i), 0) FROM range(1, 60) AS r(i) WHERE i <= least(length(a), length(b)) AND substr(a, 1, i) = substr(b, 1, i)) END AS n FROM nb),
g AS (SELECT *, (SELECT sum(coalesce(ascii(nullif(substr(coalesce(a, ''), n + i, 1), '')), 0) / pow(256.0, i)) FROM range(1, 9) AS r(i)) AS fa, (SELECT sum(coalesce(ascii(nullif(substr(b, n + i, 1), '')), 0) / pow(256.0, i)) FROM range(1, 9) AS r(i)) AS fb, (SELECT sum(coalesce(ascii(nullif(substr(k, n + i, 1), '')), 0) / pow(256.0, i)) FROM range(1, 9) AS r(i)) AS fk FROM f)
SELECT k AS key, round(CASE WHEN a = k THEN xa.upto WHEN b IS NULL THEN 1 ELSE coalesce(xa.upto, 0) + (xb.upto - coalesce(xa.upto, 0)) * CASE WHEN fb <= fa THEN 0 ELSE least(greatest((fk - fa) / (fb - fa), 0), 1) END END, 9) AS position FROM g LEFT JOIN x xa ON xa.key = a LEFT JOIN x xb ON xb.key = b""")
def _(s, d):
    rows = V.pages(s, d)
    axis = trace.mass_axis(rows.withColumn("key", F.concat("key", F.lit(b"5"))), "key", "size")
    found = trace.position(rows.select("key"), axis)
    return found.select(F.col("key").cast("string").alias("key"), F.round("position", 9).alias("position"))


# ---- two sides -----------------------------------------------------------------


@query("diff_full_outer", ", b AS (SELECT CASE WHEN size % 3 = 0 THEN key || '+' ELSE key END AS key, CASE WHEN size % 7 = 0 THEN size + 1 ELSE size END AS size FROM O) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'LEFT_ONLY' WHEN a.key IS NULL THEN 'RIGHT_ONLY' WHEN a.size = b.size THEN 'SAME' ELSE 'CHANGED' END AS state FROM O a FULL JOIN b ON a.key = b.key")
def _(s, d):
    o = V.orders(s, d)
    moved = F.when(F.col("size") % 3 == 0, F.concat("key", F.lit(b"+"))).otherwise(F.col("key"))
    return text(compare.diff(o, o.withColumns({"key": moved, "size": F.when(F.col("size") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))})), "state")


@query("anti_finalized", "SELECT key AS file FROM O WHERE key NOT IN (SELECT key FROM O WHERE storage_class = '5-LOW' OR size % 4 = 1)")
def _(s, d):
    o = V.orders(s, d).select(F.col("key").cast("string").alias("file"), "storage_class", "size")
    return compare.not_finalized(o.select("file"), o.where("storage_class = '5-LOW' or size % 4 = 1").select("file"))


@query("except_all", ", a AS (SELECT storage_class, size % 50 AS v FROM O), b AS (SELECT storage_class, CASE WHEN size % 3 = 0 THEN size % 40 ELSE size % 50 END AS v FROM O) SELECT *, 'LEFT' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'RIGHT' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def _(s, d):
    o = V.orders(s, d)
    later = F.when(F.col("size") % 3 == 0, F.col("size") % 40).otherwise(F.col("size") % 50)
    return compare.except_both(o.select("storage_class", (F.col("size") % 50).alias("v")), o.select("storage_class", later.alias("v")))


@query("conformance", ", w AS (SELECT key, '<Size> ' || size || '</Size>' AS want, CASE WHEN size % 7 = 0 THEN NULL ELSE '<Size> ' || (size + (size % 5 = 0)::INT) || '</Size>' END AS got FROM O) SELECT key AS request, CASE WHEN got IS NULL THEN 'MISSING' WHEN got = want THEN 'SAME' ELSE 'DIFFERENT' END AS verdict FROM w UNION ALL SELECT key || '+', 'EXTRA' FROM O WHERE size % 7 = 0")
def _(s, d):
    o = V.orders(s, d).select(F.col("key").cast("string").alias("request"), "size")
    body = lambda c: F.concat(F.lit("<Size> "), c.cast("string"), F.lit("</Size>"))
    gone = F.col("size") % 7 == 0
    replayed = o.select(F.when(gone, F.concat("request", F.lit("+"))).otherwise(F.col("request")).alias("request"), body(F.col("size") + (F.col("size") % 5 == 0).cast("int")).alias("body"))
    return compare.conformance(o.select("request", body(F.col("size")).alias("body")), replayed).select("request", "verdict")


@query("ratio_report", ", m AS (SELECT run::VARCHAR AS mode, sum(cents)::DOUBLE AS wall, avg(depth) AS page FROM E GROUP BY 1) SELECT '0' AS base, mode, round(wall / (SELECT wall FROM m WHERE mode = '0'), 9) AS wall_ratio, round(page / (SELECT page FROM m WHERE mode = '0'), 9) AS page_ratio FROM m WHERE mode <> '0'")
def _(s, d):
    reports = V.events(s, d).groupBy(F.col("run").cast("string").alias("mode")).agg(F.sum("cents").cast("double").alias("wall"), F.avg("depth").alias("page"))
    return compare.ratios(reports, "0", ["wall", "page"]).withColumns({c: F.round(c, 9) for c in ("wall_ratio", "page_ratio")})


@query("either_key", "SELECT key FROM O UNION SELECT CASE WHEN size % 3 = 0 THEN key || '+' ELSE key END FROM O")
def _(s, d):
    o = V.orders(s, d)
    moved = F.when(F.col("size") % 3 == 0, F.concat("key", F.lit(b"+"))).otherwise(F.col("key"))
    return text(compare.either_key(o, o.withColumn("key", moved)))


@query("exchange_sample", ", k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM D) SELECT key FROM k WHERE i IN (SELECT floor(j * (n - 1.0) / 36 + 0.5) FROM range(37) AS r(j))")
def _(s, d):
    return text(sorting.spread_sample(V.documents(s, d).select("key"), ["key"], 37))


@query("range_membership", "SELECT key, CASE WHEN key > '1995/12' THEN 99 ELSE (substr(key, 1, 4)::INT * 12 + substr(key, 6, 2)::INT) % 50 END::BIGINT AS range_id FROM (SELECT DISTINCT key FROM L) WHERE key > '1995/02'")
def _(s, d):
    months = s.range(0, 11).select((F.col("id") + 1).alias("m"))
    month = lambda c: F.concat(F.lit("1995/"), F.lpad(c.cast("string"), 2, "0")).cast("binary")
    ranges = months.where("m >= 2 and m < 12").select(((F.lit(1995 * 12) + F.col("m")) % 50).alias("range_id"), month(F.col("m")).alias("low"), month(F.col("m") + 1).alias("high"))
    ranges = ranges.unionByName(s.range(1).select(F.lit(99).cast("bigint").alias("range_id"), F.lit(b"1995/12").alias("low"), F.lit(None).cast("binary").alias("high")))
    keys = key_range(V.lines(s, d), after=b"1995/02").select("key").distinct()
    return text(compare.owning_range(keys, ranges), "range_id")


@query("range_overlap", "SELECT f.c AS file, y.y AS range_id FROM (SELECT substr(key, 1, 7) AS c, min(key) AS a, max(key) AS b FROM L GROUP BY 1) f JOIN (SELECT y::BIGINT AS y, y::VARCHAR || '/06' AS lo, (y + 1)::VARCHAR || '/06' AS hi FROM range(1993, 1999) AS r(y)) y ON f.b >= y.lo AND f.a < y.hi")
def _(s, d):
    blocks = stats.file_stats(V.lines(s, d), F.substring(F.col("key").cast("string"), 1, 7)).select("file", F.col("first_key").alias("first"), F.col("last_key").alias("last"))
    at = lambda c: F.concat(c.cast("string"), F.lit("/06")).cast("binary")
    ranges = s.range(1993, 1999).select(F.col("id").alias("range_id"), at(F.col("id")).alias("low"), at(F.col("id") + 1).alias("high"))
    return compare.overlapping(blocks, ranges).select("file", "range_id")


# ---- runs ----------------------------------------------------------------------


@query("resume_exactly_once", "SELECT key, size % 4 AS node_id FROM L")
def _(s, d):
    rows = V.lines(s, d).select("key", (F.col("size") % 4).alias("node_id"))
    ends = rows.groupBy("node_id").agg(F.max("key").alias("last"))
    cut = F.when(F.col("node_id") == 0, F.col("last")).otherwise(F.lit(b"1996/05/01"))
    nodes = ends.select("node_id", cut.alias("durable_cursor"), F.when(F.col("node_id") == 0, "COMPLETED").otherwise("OPEN").alias("status"))
    again = rows.where("key > cast('1996/01/01' as binary)")  # more than is needed: from before the durable cursor
    done = rows.where("node_id = 0 or key <= cast('1996/07/01' as binary)")  # more than is durable
    return text(resume.resumed(done, again, nodes), "node_id")


@query("open_ranges", "SELECT c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey ELSE 'l' || c_custkey END AS after, c_mktsegment AS upto FROM customer WHERE c_acctbal >= 0")
def _(s, d):
    c = V.table(s, d, "customer")
    nodes = c.select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("l"), F.col("c_custkey").cast("string")).cast("binary").alias("low"), F.col("c_mktsegment").cast("binary").alias("high"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string")).cast("binary")).alias("durable_cursor"), F.when(F.col("c_acctbal") < 0, "COMPLETED").otherwise("OPEN").alias("status"))
    return resume.open_ranges(nodes).withColumns({c: F.col(c).cast("string") for c in ("after", "upto")})


@query("node_counts", "SELECT CASE WHEN c_acctbal < 0 THEN 'COMPLETED' ELSE 'OPEN' END AS status, count(*)::BIGINT AS n_nodes FROM customer GROUP BY 1")
def _(s, d):
    return resume.counts(V.table(s, d, "customer").select(F.when(F.col("c_acctbal") < 0, "COMPLETED").otherwise("OPEN").alias("status")))


def _published(s, d, **options):
    from keyloom.plans.dataset import write_listing
    from keyloom.plans.storage import kept_path

    path = kept_path(s, "dataset")
    write_listing(V.lines(s, d), path, sort=True, **options)
    return path


@query("manifest_rows", "SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_listed, min(key) AS low, max(key) AS high, true AS sorted, true AS checked FROM L")
def _(s, d):
    import json

    from keyloom.plans.dataset import MANIFEST, Folder, manifest_rows
    from keyloom.sources.listing import eligible, read_listing

    path = _published(s, d, parts=4, part_bytes=1 << 20)
    manifest = json.loads(Folder(s, path).read(MANIFEST))
    ok, _why = eligible(manifest)
    again = {f"data/{r.file}": (r.md5, r["size"]) for r in manifest_rows(s, path).collect()}  # a row each file
    same = again == {f["key"]: (f["MD5checksum"], f["size"]) for f in manifest["files"]}
    ends = [bytes.fromhex(k).decode() for k in (manifest["files"][0]["minKey"], manifest["files"][-1]["maxKey"])]
    listed = sum(f["rowCount"] for f in manifest["files"])
    return read_listing(s, path, objects_only=False).agg(F.count("*").alias("n_rows"), F.lit(listed).cast("bigint").alias("n_listed"), F.lit(ends[0]).alias("low"), F.lit(ends[1]).alias("high"), F.lit(ok).alias("sorted"), F.lit(same).alias("checked"))


@query("dataset_range", "SELECT key, size FROM L WHERE starts_with(key, '1996/0') AND key > '1996/03/1'")
def _(s, d):
    from keyloom.sources.listing import read_range

    return text(read_range(s, _published(s, d, parts=8), prefix=b"1996/0", after=b"1996/03/1"), "size")


@query("row_group_index", "SELECT count(*)::BIGINT AS n_rows, true AS covered, true AS pure, min(key) AS low FROM L")
def _(s, d):
    from keyloom.sources.listing import first_group, row_groups

    groups = row_groups(s, _published(s, d, parts=8))
    middle = groups[len(groups) // 2]
    covered = groups[first_group(groups, middle[3])] == middle and first_group(groups, b"") == 0
    return s.createDataFrame([(sum(g[2] for g in groups), covered, all(g[5] for g in groups), groups[0][3].decode())], "n_rows bigint, covered boolean, pure boolean, low string")


@query("skip_scan_page", f"SELECT DISTINCT coalesce(cp, key) AS key, CASE WHEN cp IS NULL THEN 'OBJECT' ELSE 'COMMON_PREFIX' END AS row_type FROM (SELECT *, {_ROLL.format(n=0, x='/', m=1)} AS cp FROM L WHERE key > '1993/') WHERE cp > '1993/' ORDER BY 1 LIMIT 5")
def _(s, d):
    page, _opened = paging.skip_scan(s, _published(s, d, parts=12), Request(delimiter=b"/", start_after=b"1993/", max_keys=5))
    return text(page.rows, "row_type")


@query("list_document", "SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?><ListBucketResult xmlns=\"http://s3.amazonaws.com/doc/2006-03-01/\"><Name>b</Name><Prefix>1998/</Prefix><KeyCount>' || count(*) || '</KeyCount><MaxKeys>1000</MaxKeys><Delimiter>/</Delimiter><IsTruncated>false</IsTruncated>' || string_agg('<CommonPrefixes><Prefix>' || p || '</Prefix></CommonPrefixes>', '' ORDER BY p) || '</ListBucketResult>' AS document FROM (SELECT DISTINCT substr(key, 1, 8) AS p FROM L WHERE starts_with(key, '1998/'))")
def _(s, d):
    request = Request(prefix=b"1998/", delimiter=b"/")
    return s.createDataFrame([(formats.list_xml(paging.list_objects(V.lines(s, d), request), request, "b"),)], "document string")


@query("live_listing", "SELECT 'data/' || lpad(i::VARCHAR, 6, '0') AS key, 11::BIGINT AS size FROM range(101, 5000) AS r(i)")
def _(s, d):
    from keyloom.sources import live

    live.register(s)
    source = s.read.format("keyloom").option("store", "keyloom.sources.live:made_up_store").option("n", "5000").option("prefix", "data/").option("start_after", b"data/000100".hex()).option("ranges", ",".join(k.hex() for k in (b"data/001000", b"data/003000")))
    return text(source.load(), "size")


@query("simulated_runs")
def _(s, d):
    ranges = V.documents(s, d).groupBy(F.split_part(F.col("key").cast("string"), F.lit("/"), F.lit(1))).agg(F.sum("size").alias("keys"))
    scenarios = s.createDataFrame([(f"w{w}{'s' if x else ''}", w, 0.2, 1000, x) for w in (1, 8, 32) for x in (False, True)], "scenario string, workers int, latency double, page int, split boolean")
    return simulate.sweep(ranges, scenarios)


@query("ordered_listing", "SELECT key, row_type FROM O ORDER BY key LIMIT 500")
def _(s, d):
    return text(V.orders(s, d).orderBy(*order_columns()).limit(500), "row_type")
