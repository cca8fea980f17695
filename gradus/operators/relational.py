"""Filters, joins, sets and paging of the question bank and its attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query


def contains_ci(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def page(df: DataFrame, keys: list[Column], number: int, limit: int) -> DataFrame:
    """A page of an ordered table; limit is kept within 1 to 100, and pages begin at 1."""
    limit = max(1, min(100, limit))
    return df.orderBy(*keys).offset((max(1, number) - 1) * limit).limit(limit)


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def paged_list(t) -> DataFrame:
    return page(t("part").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 3, 20)


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the of')")
def search_substring(t) -> DataFrame:
    return t("documents").where(contains_ci(F.col("text"), "The of")).select("doc_id", "lang")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(lower(c_name), '00[12]$') OR regexp_matches(lower(c_mktsegment), '^b')")
def search_regex_or(t) -> DataFrame:
    return t("customer").where(F.lower("c_name").rlike("00[12]$") | F.lower("c_mktsegment").rlike("^b")).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_size IN (6, 7, 8) AND p_type NOT IN (SELECT min(p_type) FROM part)")
def in_not_in(t) -> DataFrame:
    p = t("part").select("p_partkey", "p_size", "p_type")
    return p.where(F.col("p_size").isin(6, 7, 8)).join(p.agg(F.min("p_type").alias("p_type")), "p_type", "left_anti").select("p_partkey")


@query("SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def null_safe_ne(t) -> DataFrame:
    labels = t("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return t("documents").select("doc_id").join(labels, "doc_id", "left").where(~F.col("toxic").eqNullSafe(1)).select("doc_id")


_NOW = "TIMESTAMP '1996-01-01'"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'archived' WHEN {_NOW} < o_orderdate THEN 'scheduled'
 WHEN {_NOW} > o_orderdate + INTERVAL 365 DAY THEN 'completed' ELSE 'active' END AS status FROM orders""")
def derived_status(t) -> DataFrame:
    """State of a test by a bound clock: some states pass through, others follow its window."""
    now, start = F.expr("timestamp_ntz'1996-01-01'"), F.col("o_orderdate")
    s = F.when(F.col("o_orderstatus") == "P", "archived").when(now < start, "scheduled").when(now > start + F.expr("INTERVAL 365 DAY"), "completed").otherwise("active")
    return t("orders").select("o_orderkey", s.alias("status"))


@query("SELECT o_custkey AS user_id, count(*) AS attempts, count(*) >= 10 AS used_up FROM orders GROUP BY o_custkey")
def quota_check(t) -> DataFrame:
    n = F.count("*")
    return t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(n.alias("attempts"), (n >= 10).alias("used_up"))


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 6 AND 12 AND NOT EXISTS
 (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def available_pool(t) -> DataFrame:
    used = t("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return t("part").where(F.col("p_size").between(6, 12)).select("p_partkey").join(used, "p_partkey", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def row_access_semi(t) -> DataFrame:
    """Row-level access: only attempts of users of one's own region."""
    mine = t("customer").join(t("nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT n_name AS test, count(*) AS attempts, CAST(sum(o_totalprice) AS DECIMAL(18, 2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def lookup_unwind(t) -> DataFrame:
    """Inner joins to the dimensions, which are small and prunable."""
    j = t("orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("test")).agg(F.count("*").alias("attempts"), F.sum("p").cast("decimal(18,2)").alias("total"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def left_populate(t) -> DataFrame:
    n = t("nation").join(t("region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    return t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT l_orderkey AS attempt_id, string_agg(p_type, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS chapters
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def array_populate(t) -> DataFrame:
    """Look up each element of an attempt's answers, and keep their order."""
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_type")
    return l.groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["p_type"]), ",").alias("chapters"))


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus <> 'O')")
def attempted_semi(t) -> DataFrame:
    done = t("orders").where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("c_custkey"))
    users = t("customer").join(done, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("n_nationkey"))
    return t("nation").select("n_nationkey").join(users, "n_nationkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unattempted_anti(t) -> DataFrame:
    return t("orders").select("o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT o_orderkey FROM orders a WHERE o_orderstatus <> 'O' OR NOT EXISTS
 (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus <> 'O')""")
def superseded_self_anti(t) -> DataFrame:
    """Open attempts go where the user has a submitted one of the same test."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    done = o.where("o_orderstatus <> 'O'")
    open_ = o.where("o_orderstatus = 'O'").join(done.select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "left_anti")
    return done.select("o_orderkey").union(open_.select("o_orderkey"))


@query("""SELECT 'lineitem_orders' AS reference, count(*) AS dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def ref_integrity(t) -> DataFrame:
    checks = (("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels_documents", "labels", "doc_id", "documents", "doc_id"), ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"))
    out = None
    for name, left, key, right, id_ in checks:
        n = t(left).select(F.col(key).alias("k")).join(t(right).select(F.col(id_).alias("k")), "k", "left_anti").agg(F.count("*").alias("dangling"))
        one = n.select(F.lit(name).alias("reference"), "dangling")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT CAST(c_nationkey AS BIGINT) AS n, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'neither' FROM (SELECT n_nationkey FROM nation EXCEPT (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier))""")
def set_ops(t) -> DataFrame:
    c, s, n = t("customer").select(F.col("c_nationkey").alias("n")), t("supplier").select(F.col("s_nationkey").alias("n")), t("nation").select(F.col("n_nationkey").alias("n"))
    both, neither = c.intersect(s), n.subtract(c.union(s))
    return both.select(F.col("n").cast("bigint").alias("n"), F.lit("both").alias("side")).union(neither.select(F.col("n").cast("bigint"), F.lit("neither")))


@query("""SELECT coalesce(a.pos, b.pos) AS pos, a.n_name, b.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation) a
FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS pos FROM region) b ON a.pos = b.pos""")
def positional_zip(t) -> DataFrame:
    """Two short lists side by side by position; the windows hold one list each."""
    from pyspark.sql import Window

    a = t("nation").select("n_name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_nationkey")).cast("bigint").alias("pos"))
    b = t("region").select("r_name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r_regionkey")).cast("bigint").alias("pos"))
    return a.join(b, "pos", "full_outer").select("pos", "n_name", "r_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
