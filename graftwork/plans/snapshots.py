"""Queries on two snapshots of a table: outer diff, matching phases, summaries, multi-file moves, keyed cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.operators import matching
from graftwork.storage import table

ADDED = 10_000_000
STATE = ["o_custkey", "o_orderstatus", "o_totalprice"]


def order_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders as they are, and a later state: small ones gone, urgent ones closed, low ones handed on, high ones copied."""
    old = table(spark, sf_dir, "orders")
    new = old.where("o_totalprice >= 20000").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("C")).otherwise(F.col("o_orderstatus"))).withColumn("o_custkey", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return old, new.union(old.where("o_orderpriority = '2-HIGH'").withColumn("o_orderkey", F.col("o_orderkey") + ADDED))


_ORDERS = """
old AS (SELECT * FROM orders),
new AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'C' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 20000
        UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'),
ops AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS order_key, CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS op_type,
          concat_ws(',', CASE WHEN a.o_custkey <> b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END) AS changed,
          coalesce(b.o_orderpriority, a.o_orderpriority) AS priority
        FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey <> b.o_custkey OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice)
"""


def _order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = order_snapshots(spark, sf_dir)
    diff = matching.snapshot_diff(old, new, "o_orderkey", [*STATE, "o_orderpriority"])
    return diff.select(F.col("key").alias("order_key"), "op_type", matching.changed_columns(diff, STATE).alias("changed"), F.coalesce("now.o_orderpriority", "was.o_orderpriority").alias("priority"))


def snapshot_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_ops(spark, sf_dir).select("order_key", "op_type", "changed")


def op_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda op: F.count_if(F.col("op_type") == op).alias(op.lower() + "s")
    return _order_ops(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("ops"), count("INSERT"), count("DELETE"), count("MODIFY"))


def _document_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts by content and path (their source); later the French ones lie in an archive and the short ones are gone."""
    d = table(spark, sf_dir, "documents")
    old = d.select("doc_id", F.col("source").alias("path"), F.md5("text").alias("content"), "lang", "n_chars")
    new = old.where("n_chars >= 200").withColumn("path", F.when(F.col("lang") == "fr", F.concat(F.lit("archive/"), F.col("path"))).otherwise(F.col("path")))
    return old.drop("lang", "n_chars"), new.drop("lang", "n_chars")


_DOCUMENTS = """
old AS (SELECT doc_id, source AS path, md5(text) AS content FROM documents),
new AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'archive/' || source ELSE source END AS path, md5(text) AS content FROM documents WHERE n_chars >= 200)
"""


def exact_match_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal content pairs up in order of path and id; a pair at two paths moved; the unpaired were deleted or inserted."""
    old, new = _document_sides(spark, sf_dir)
    pairs = matching.ordinal_pairs(old, new, ["content"], ["doc_id"])
    op = F.when(F.col("new_doc_id").isNull(), "DELETE").when(F.col("old_doc_id").isNull(), "INSERT").when(F.col("old_path") != F.col("new_path"), "MOVE")
    return pairs.select(F.col("old_doc_id").alias("old_id"), F.col("new_doc_id").alias("new_id"), op.alias("op_type"), "old_path", "new_path").where("op_type is not null")


def multifile_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that left one source and came into another is a move: deletes against inserts of equal content in another file, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("content"))
    w = Window.partitionBy("content").orderBy("source", "doc_id")
    old = d.where("lang <> 'en'").select("content", F.col("source").alias("old_file"), F.col("doc_id").alias("old_id"), F.row_number().over(w).alias("k"))
    new = d.where("lang <> 'en'").withColumn("source", F.concat(F.lit("lang-"), F.col("lang"))).select("content", F.col("source").alias("new_file"), F.col("doc_id").alias("new_id"), F.row_number().over(w).alias("k"))
    return old.join(new, ["content", "k"]).where("old_file <> new_file").select("old_id", "new_id", "old_file", "new_file")


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept by content: texts of pages of conversation by role; assistant turns are stored, all turns are looked up."""
    c = table(spark, sf_dir, "conversations").select("role", F.md5("text").alias("blob"))
    stored = c.where("role = 'assistant'").select("blob").distinct().withColumn("stored", F.lit(True))
    return c.join(stored, "blob", "left").groupBy("role").agg(F.count("*").alias("lookups"), F.count_if(F.col("stored")).alias("hits"), F.count_if(F.col("stored").isNull()).alias("misses"))


def shape_match_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of equal shape (flags) and key pair up in order of content; pairs of other content were modified."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    old = li.where("l_linestatus = 'F'").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    new = li.where("l_linestatus = 'O'").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    pairs = matching.ordinal_pairs(old, new, ["l_partkey", "l_returnflag"], ["quantity", "price"], "inner")
    return pairs.where("old_quantity <> new_quantity or old_price <> new_price").groupBy(F.col("old_l_returnflag").alias("shape")).agg(F.count("*").alias("modified"), F.round(F.sum(F.col("new_quantity") - F.col("old_quantity")), 2).alias("quantity_delta"))


def name_match_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal brand and name pair up in order of key between small and large; pairs of other price were modified."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", "p_retailprice")
    old, new = p.where("p_size <= 25").drop("p_size"), p.where("p_size > 25").drop("p_size")
    pairs = matching.ordinal_pairs(old, new, ["p_brand", "p_name"], ["p_partkey"], "inner")
    return pairs.where("old_p_retailprice <> new_p_retailprice").select(F.col("old_p_partkey").alias("old_key"), F.col("new_p_partkey").alias("new_key"), F.col("old_p_brand").alias("brand"), F.col("old_p_name").alias("name"))


def identity_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose identity (all but the name) is found again under another name: renamed."""
    c = table(spark, sf_dir, "customer")
    identity = F.sha2(F.concat_ws("|", "c_nationkey", F.format_string("%.2f", "c_acctbal"), "c_mktsegment"), 256)
    old = c.select(identity.alias("identity"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = c.select(identity.alias("identity"), F.col("c_custkey").alias("key"), F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Builder "), F.col("c_name"))).otherwise(F.col("c_name")).alias("name"))
    pairs = matching.ordinal_pairs(old, new, ["identity"], ["key"], "inner")
    return pairs.where("old_name <> new_name").select(F.col("old_key").alias("customer"), "old_name", "new_name")


def isomorphic_zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns zipped by ordinal, in conversations with as many of each; pairs of other text count as modified."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = c.select("conv_id", "turn", "role", F.md5("text").alias("content"), F.row_number().over(w).alias("k"))
    same = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a")).where("u = a").select("conv_id")
    a = t.where("role = 'user'").select("conv_id", "k", F.col("turn").alias("old_turn"), F.col("content").alias("was"))
    b = t.where("role = 'assistant'").select("conv_id", "k", F.col("turn").alias("new_turn"), F.col("content").alias("now"))
    return a.join(b, ["conv_id", "k"]).join(same, "conv_id", "left_semi").where("was <> now").select("conv_id", "old_turn", "new_turn")


def symbol_move_rename_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as symbols in files (nations): where each went to, tried as move, then rename, then change of its surface."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    old = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("old_name"), F.col("s_nationkey").alias("old_file"), F.col("s_acctbal").alias("old_body"))
    rich, poor = F.col("s_acctbal") > 7000, F.col("s_acctbal") < 0
    new = s.select(
        F.col("s_suppkey").alias("key"),
        F.when(poor, F.concat(F.lit("Re-"), F.col("s_name"))).otherwise(F.col("s_name")).alias("new_name"),
        F.when(rich | poor, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")).alias("new_file"),
        F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("new_body"),
    )
    event = F.when((F.col("old_body") == F.col("new_body")) & (F.col("old_name") == F.col("new_name")), "cross_file_move").when(F.col("old_body") == F.col("new_body"), "cross_file_rename").otherwise("api_surface_change")
    return old.join(new, "key").where("old_file <> new_file").select("key", event.alias("event"), F.col("old_file").cast("long").alias("old_file"), F.col("new_file").cast("long").alias("new_file"))


def refactor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted parts (large) against modified ones (small) of a brand and type: share of common words over 0.8 is an extraction.

    Only distinct sets of words of a group are compared, so what grows with the square of a group is no more than the result.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.array_sort(F.array_distinct(matching.words(F.concat_ws(" ", "p_name", "p_type")))).alias("w"), "p_size")
    ins, mod = p.where("p_size > 40"), p.where("p_size <= 10")
    sets = lambda side, name: side.select("p_brand", "p_type", F.col("w").alias(name)).distinct()
    sim = F.size(F.array_intersect("wi", "wo")) / F.size(F.array_union("wi", "wo"))
    close = sets(ins, "wi").join(sets(mod, "wo"), ["p_brand", "p_type"]).withColumn("confidence", F.round(sim, 6)).where("confidence > 0.8")
    key = ["p_brand", "p_type"]
    found = ins.select(*key, F.col("p_partkey").alias("inserted"), F.col("w").alias("wi")).join(close, [*key, "wi"])
    # rows are few before this join and many after it, so its tasks are not left to their size
    found = found.repartition(2 * spark.sparkContext.defaultParallelism, *key, "wo")
    return found.join(mod.select(*key, F.col("p_partkey").alias("original"), F.col("w").alias("wo")), [*key, "wo"]).select("inserted", "original", "confidence")


QUERIES = (snapshot_full_outer_diff, op_summary_pivot, exact_match_moves, multifile_move, cache_hit_miss, shape_match_modify, name_match_modify, identity_rename, isomorphic_zip_scan, symbol_move_rename_api, refactor_extract)

SQL = {
    "snapshot_full_outer_diff": f"WITH {_ORDERS} SELECT order_key, op_type, changed FROM ops",
    "op_summary_pivot": f"WITH {_ORDERS} SELECT priority, count(*) AS ops, count(*) FILTER (op_type = 'INSERT') AS inserts, count(*) FILTER (op_type = 'DELETE') AS deletes, count(*) FILTER (op_type = 'MODIFY') AS modifys FROM ops GROUP BY priority",
    "exact_match_moves": f"""WITH {_DOCUMENTS},
        a AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS k FROM old),
        b AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS k FROM new),
        p AS (SELECT a.doc_id AS old_id, b.doc_id AS new_id, CASE WHEN b.doc_id IS NULL THEN 'DELETE' WHEN a.doc_id IS NULL THEN 'INSERT' WHEN a.path <> b.path THEN 'MOVE' END AS op_type, a.path AS old_path, b.path AS new_path
              FROM a FULL JOIN b ON a.content = b.content AND a.k = b.k)
        SELECT * FROM p WHERE op_type IS NOT NULL""",
    "multifile_move": """WITH d AS (SELECT doc_id, lang, source, md5(text) AS content FROM documents WHERE lang <> 'en'),
        a AS (SELECT content, source AS old_file, doc_id AS old_id, row_number() OVER (PARTITION BY content ORDER BY source, doc_id) AS k FROM d),
        b AS (SELECT content, 'lang-' || lang AS new_file, doc_id AS new_id, row_number() OVER (PARTITION BY content ORDER BY 'lang-' || lang, doc_id) AS k FROM d)
        SELECT old_id, new_id, old_file, new_file FROM a JOIN b USING (content, k) WHERE old_file <> new_file""",
    "cache_hit_miss": """WITH c AS (SELECT role, md5(text) AS blob FROM conversations), s AS (SELECT DISTINCT blob FROM c WHERE role = 'assistant')
        SELECT role, count(*) AS lookups, count(s.blob) AS hits, count(*) - count(s.blob) AS misses FROM c LEFT JOIN s ON c.blob = s.blob GROUP BY role""",
    "shape_match_modify": """WITH l AS (SELECT l_partkey, l_returnflag AS shape, l_linestatus, l_quantity AS q, l_extendedprice AS p, row_number() OVER (PARTITION BY l_linestatus, l_partkey, l_returnflag ORDER BY l_quantity, l_extendedprice) AS k FROM lineitem)
        SELECT a.shape, count(*) AS modified, round(sum(b.q - a.q), 2) AS quantity_delta FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.shape = b.shape AND a.k = b.k AND a.l_linestatus = 'F' AND b.l_linestatus = 'O'
        WHERE a.q <> b.q OR a.p <> b.p GROUP BY a.shape""",
    "name_match_modify": """WITH p AS (SELECT p_partkey, p_brand, p_name, p_retailprice, p_size <= 25 AS small, row_number() OVER (PARTITION BY p_size <= 25, p_brand, p_name ORDER BY p_partkey) AS k FROM part)
        SELECT a.p_partkey AS old_key, b.p_partkey AS new_key, a.p_brand AS brand, a.p_name AS name FROM p a JOIN p b ON a.small AND NOT b.small AND a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.k = b.k WHERE a.p_retailprice <> b.p_retailprice""",
    "identity_rename": "SELECT c_custkey AS customer, c_name AS old_name, 'Builder ' || c_name AS new_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "isomorphic_zip_scan": """WITH t AS (SELECT conv_id, turn, role, md5(text) AS content, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
        s AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = count(*) FILTER (role = 'assistant'))
        SELECT conv_id, a.turn AS old_turn, b.turn AS new_turn FROM t a JOIN t b USING (conv_id, k) JOIN s USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant' AND a.content <> b.content""",
    "symbol_move_rename_api": """SELECT s_suppkey AS key, CASE WHEN s_acctbal < 0 THEN 'cross_file_rename' WHEN s_acctbal > 9000 THEN 'api_surface_change' ELSE 'cross_file_move' END AS event, s_nationkey::BIGINT AS old_file, s_nationkey::BIGINT + 100 AS new_file
        FROM supplier WHERE s_acctbal > 7000 OR s_acctbal < 0""",
    "refactor_extract": """WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part)
        SELECT a.p_partkey AS inserted, b.p_partkey AS original, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS confidence
        FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size > 40 AND b.p_size <= 10 WHERE confidence > 0.8""",
}
