"""Queries of similarity, trees and graphs, scores, lint and report over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.operators import matching, scoring, trees
from graftwork.operators.lint import RULES, annotate, lint_lines
from graftwork.plans.snapshots import _ORDERS, _order_ops
from graftwork.sources.paths import detect_language, glob_match
from graftwork.storage import table

_SPLIT = r"'[\x00-\x2f\x3a-\x60\x7b-\x7f]+'"
_WORDS = f"list_filter(string_split_regex(lower(text), {_SPLIT}), lambda x: x <> '')"


def similarity_theta_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its most similar one of the same language, by the set of words, at least 0.7; the higher id of equals."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    sets = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("bucket"), F.array_distinct(matching.words(F.col("text"))).alias("words")).where("size(words) > 0")
    return matching.nearest_sets(sets, 0.7).select(F.col("id").alias("doc_id"), F.col("match").alias("match_id"), F.round("similarity", 6).alias("similarity"))


#: Pairs of items and documents are reported from this similarity on.
SIMILAR = 0.1


def _overlaps(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("l"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("r"), "text")
    return matching.overlap_scores(items, docs, SIMILAR, by).withColumnsRenamed({"l": "item_id", "r": "doc_id"})


def structural_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("shared") / F.col("set_union")
    return _overlaps(spark, sf_dir, "set").where(j >= SIMILAR).select("item_id", "doc_id", F.round(j, 6).alias("jaccard"))


def token_multiset_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("sum_least") / F.col("sum_greatest")
    return _overlaps(spark, sf_dir, "multiset").where(j >= SIMILAR).select("item_id", "doc_id", F.round(j, 6).alias("jaccard"))


def composite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a mean of both reaches the threshold only where one of them does
    c = scoring.composite(F.col("shared") / F.col("set_union"), F.col("sum_least") / F.col("sum_greatest"))
    return _overlaps(spark, sf_dir, "set", "multiset").where(c >= SIMILAR).select("item_id", "doc_id", F.round(c, 6).alias("similarity"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(matching.words(F.col("text"))).alias("token"))


def token_bitset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), scoring.bin_of(F.col("token"), 63).cast("int"))).alias("bits"))


def token_histogram16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.histogram(_tokens(spark, sf_dir), "doc_id", "token")


def histogram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of each document and of its source as a whole; bins that one lacks count as 0."""
    d = table(spark, sf_dir, "documents")
    tokens = d.select("doc_id", "lang", F.explode(matching.words(F.col("text"))).alias("token"))
    bins = tokens.groupBy("doc_id", "lang", scoring.bin_of(F.col("token"), 16).alias("bin")).agg(F.count("*").alias("n"))
    whole = bins.groupBy("lang", "bin").agg(F.least(F.lit(255), F.sum("n")).alias("m"))
    own = bins.groupBy("doc_id", "lang").pivot("bin", list(range(16))).agg(F.first("n"))
    rest = whole.groupBy("lang").pivot("bin", list(range(16))).agg(F.first("m"))
    a = own.select("doc_id", "lang", F.array(*[F.least(F.lit(255), F.coalesce(F.col(f"`{i}`"), F.lit(0))) for i in range(16)]).alias("a"))
    b = rest.select("lang", F.array(*[F.coalesce(F.col(f"`{i}`"), F.lit(0)) for i in range(16)]).alias("b"))
    least = F.aggregate(F.zip_with("a", "b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    most = F.aggregate(F.zip_with("a", "b", lambda x, y: F.greatest(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return a.join(b, "lang").select("doc_id", F.round(least / most, 6).alias("jaccard"))


def positional_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each user turn against those of the turn after it."""
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.struct("conv_id", "turn").alias("key"), F.posexplode(matching.words(F.col("text"))).alias("pos", "token"))
    later = c.where("turn > 0").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("key"), F.posexplode(matching.words(F.col("text"))).alias("pos", "token"))
    return scoring.positional_penalty(t, later).select("key.conv_id", "key.turn", F.round("penalty", 6).alias("penalty"))


def complexity_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("old"), F.count_if(F.col("l_linestatus") == "O").alias("new"))
    return o.select("l_orderkey", F.round(scoring.complexity_factor(F.col("old"), F.col("new")), 6).alias("factor"))


def intensity_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.col("l_quantity") * 2
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", scoring.intensity(percent).alias("change_intensity")).agg(F.count("*").alias("n"))


def merkle_hash_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each customer over the hashes of their orders, and those over the hashes of their lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.md5(F.concat_ws("|", F.lit("line"), "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")).alias("h"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = trees.rollup_hash(li, "l_orderkey", "h").withColumnRenamed("hash", "lines_hash")
    o = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_custkey", F.md5(F.concat_ws("|", "o_orderstatus", "lines_hash")).alias("h"))
    return trees.rollup_hash(o, "o_custkey", "h", F.lit("customer|")).select(F.col("o_custkey").alias("c_custkey"), F.col("children").alias("orders"), "hash")


def context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return trees.context_hash(j, F.md5("r_name"), F.lit("region"), ["n_regionkey"], ["n_nationkey"], 1).select("n_nationkey", "sibling_index", "context_hash")


def window_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within a minute of an error of the same user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    spans = e.select("event_id", "user_id", "event_type", "t", (F.col("t") + 1).alias("u"))
    windows = e.where("event_type = 'error'").select("user_id", (F.col("t") - 60_000_000).alias("lo"), (F.col("t") + 60_000_001).alias("hi"))
    return trees.overlapping(spans, windows, "user_id", "t", "u").select("event_id", "user_id", "event_type")


def call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts call suppliers, who are defined in their nation's file; the first line of each call."""
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_returnflag").alias("caller_file"), (-F.col("l_suppkey") - 1).alias("callee"), F.col("l_linenumber").alias("row"))
    defined = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("name"), F.col("s_nationkey").alias("file"))
    return trees.call_edges(calls, defined).select("caller", "caller_file", (-F.col("callee") - 1).alias("callee"), F.col("callee_file").cast("long").alias("callee_file"), F.col("row").cast("long").alias("row"))


def blast_radius_depth5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is called by the one of half its key: all transitive callers to depth five, and how grave that is."""
    c = table(spark, sf_dir, "customer")
    edges = c.where("c_custkey > 0").select(F.col("c_custkey").alias("callee"), F.floor(F.col("c_custkey") / 2).alias("caller"))
    hit = trees.blast_radius(c.select(F.col("c_custkey").alias("root")), edges)
    n = hit.groupBy("root").agg(F.count("*").alias("callers"), F.max("depth").alias("depth"))
    return c.select(F.col("c_custkey").alias("root")).join(n, "root", "left").select("root", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("depth", F.lit(0)).alias("depth"), trees.severity(F.coalesce("callers", F.lit(0))).alias("severity"))


def removed_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a source's texts that no text of `src0` holds: what a move to that source would remove, by kind."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("source", F.explode(F.split("text", "\n")).alias("line"))
    kind = F.when(F.lower("line").contains("license"), "license").when(F.col("line").contains("@"), "contact").otherwise("prose")
    lines = lines.select("source", kind.alias("kind"), F.md5("line").alias("guard")).distinct()
    kept = lines.where("source = 'src0'").select("kind", "guard")
    return lines.where("source <> 'src0'").join(kept, ["kind", "guard"], "left_anti").groupBy("source", "kind").agg(F.count("*").alias("removed"))


def dataflow_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against the next one of the same customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.lead(F.struct("o_orderstatus", "o_orderpriority", "o_totalprice")).over(w).alias("n")).where("n is not null")
    status, priority = F.col("o_orderstatus") == F.col("n.o_orderstatus"), F.col("o_orderpriority") == F.col("n.o_orderpriority")
    return o.select("o_orderkey", scoring.data_flow_tag(status & priority & (F.col("o_totalprice") == F.col("n.o_totalprice")), status, priority, status).alias("tag"))


def type_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First position at which type and brand of a part differ from the next key's, and whether the size widened."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("a"), "p_size", F.lead(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).over(w).alias("b"), F.lead("p_size").over(w).alias("next")).where("b is not null")
    first = F.filter(F.transform(F.arrays_zip("a", "b"), lambda x, i: F.when(x["a"] != x["b"], F.concat(x["a"], F.lit(" -> "), x["b"]))), lambda x: x.isNotNull())
    return p.select("p_partkey", F.try_element_at(first, F.lit(1)).alias("refactor"), (F.col("next") > F.col("p_size")).alias("widened")).where("refactor is not null")


def classify_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's changes of orders as one commit."""
    ops = _order_ops(spark, sf_dir)
    hit = lambda op: F.count_if(F.col("op_type") == op)
    m = ops.groupBy("priority").agg(F.countDistinct("changed").alias("files"), F.lit(0).cast("long").alias("moves"), F.count_if(F.col("changed") == "o_custkey").alias("renames"), hit("INSERT").alias("inserts"), hit("DELETE").alias("deletes"), F.count_if((F.col("op_type") == "MODIFY") & (F.col("changed") != "o_custkey")).alias("modifies"), F.lit(0).alias("patterns"), hit("INSERT").alias("symbols"), F.count_if(F.col("changed").contains("status")).alias("flow_changes"), F.lit(0.75).alias("avg_similarity"), F.lit(1.0).alias("avg_delta"))
    return scoring.classify(m).select("priority", "primary_class", "confidence")


def intent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each host by the words of its pages, in order of page."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id", "html")
    return scoring.intent_labels(p, "host", "page_id", "html")


def granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How to show each customer's lines of change: orders are files, returned lines are moves."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    g = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey").agg(F.countDistinct("l_orderkey").alias("files"), F.count("*").alias("ops"), F.count_if(F.col("l_returnflag") == "R").alias("moves"))
    return g.select("o_custkey", scoring.granularity(F.lit(0), F.lit(0), F.col("moves"), F.col("files"), F.col("ops")).alias("granularity"))


def lint_crossjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def rule_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(annotate(F.col("text"))).alias("details_md5"), (annotate(F.col("text")) != F.col("text")).alias("annotated"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src/"), F.element_at(F.split(F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), 3), r"\."), -1), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("py", "rs", "tsx", "h++", "jsonc", "txt")]), F.length("url") % 6 + 1)).alias("path"))
    return p.select("page_id", "path", detect_language(F.col("path")).alias("lang"))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(glob_match(F.col("url"), "http*://**/{en,fr}/*")).select("page_id", "url")


QUERIES = (
    similarity_theta_topk, structural_set_jaccard, token_multiset_jaccard, composite_similarity, token_bitset, token_histogram16, histogram_jaccard, positional_penalty, complexity_factor, intensity_case, merkle_hash_rollup, context_hash,
    window_overlap_filter, call_graph_edges, blast_radius_depth5, removed_guards, dataflow_tag, type_widening, classify_commit, intent_labels, granularity, lint_crossjoin, rule_annotate, lang_detect, glob_filter,
)

_PAIRS = f"""
w AS (SELECT 'l' AS side, item_id AS id, unnest({_WORDS}) AS word FROM benchmark UNION ALL SELECT 'r', doc_id, unnest({_WORDS}) FROM documents),
c AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT side, id, count(*) AS d, sum(n) AS t FROM c GROUP BY ALL),
s AS (SELECT a.id AS item_id, b.id AS doc_id, count(*) AS shared, sum(least(a.n, b.n)) AS low FROM c a JOIN c b ON a.word = b.word AND a.side = 'l' AND b.side = 'r' GROUP BY ALL),
o AS (SELECT item_id, doc_id, shared / (x.d + y.d - shared) AS js, low / (x.t + y.t - low) AS jm FROM s JOIN t x ON x.side = 'l' AND x.id = item_id JOIN t y ON y.side = 'r' AND y.id = doc_id)
"""
_BIN = "('0x' || substr(md5(token), 1, 2))::BIGINT"
_TOKENS = f"tok AS (SELECT doc_id, lang, unnest({_WORDS}) AS token FROM documents)"
_RULES = ", ".join(f"({i}, '{r.name}', '{r.severity}', '{r.message}')" for i, r in enumerate(RULES))


def _annotate_sql() -> str:
    out = "text"
    for r in RULES:
        prefix = f"[{r.severity}] [{r.name}]"
        out = f"(SELECT CASE WHEN NOT starts_with(d, '{prefix}') AND (contains(lower(d), '{r.name}') OR contains('{r.source.lower()}', lower(d)) OR contains(d, 'auth') OR contains(d, 'crypto') OR contains(d, 'verify')) THEN '{prefix} ' || d ELSE d END FROM (SELECT {out} AS d))"
    return out


def _points(terms: list[tuple[float, str]]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in terms)


SQL = {
    "similarity_theta_topk": f"""WITH s AS (SELECT doc_id, lang, list_distinct({_WORDS}) AS w FROM documents WHERE lang IS NOT NULL),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS t FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)),
        q AS (SELECT a, b, k / (t - k) AS j FROM p WHERE k >= 0.7 * (t - k)), u AS (SELECT a, b, j FROM q UNION ALL SELECT b, a, j FROM q)
        SELECT a AS doc_id, b AS match_id, round(j, 6) AS similarity FROM u QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b DESC) = 1""",
    "structural_set_jaccard": f"WITH {_PAIRS} SELECT item_id, doc_id, round(js, 6) AS jaccard FROM o WHERE js >= {SIMILAR}",
    "token_multiset_jaccard": f"WITH {_PAIRS} SELECT item_id, doc_id, round(jm, 6) AS jaccard FROM o WHERE jm >= {SIMILAR}",
    "composite_similarity": f"WITH {_PAIRS} SELECT item_id, doc_id, round(0.6 * js + 0.4 * jm, 6) AS similarity FROM o WHERE 0.6 * js + 0.4 * jm >= {SIMILAR}",
    "token_bitset": f"WITH {_TOKENS} SELECT doc_id, bit_or(1::BIGINT << ({_BIN} % 63)::INT) AS bits FROM tok GROUP BY doc_id",
    "token_histogram16": f"WITH {_TOKENS} SELECT doc_id, {_BIN} % 16 AS bin, least(255, count(*)) AS n FROM tok GROUP BY ALL",
    "histogram_jaccard": f"""WITH {_TOKENS}, h AS (SELECT doc_id, lang, {_BIN} % 16 AS bin, count(*) AS n FROM tok GROUP BY ALL),
        g AS (SELECT lang, bin, least(255, sum(n)) AS m FROM h GROUP BY ALL), d AS (SELECT DISTINCT doc_id, lang FROM h)
        SELECT d.doc_id, round(sum(least(m, least(255, coalesce(n, 0)))) / sum(greatest(m, least(255, coalesce(n, 0)))), 6) AS jaccard
        FROM d JOIN g USING (lang) LEFT JOIN h ON h.doc_id = d.doc_id AND h.bin = g.bin AND h.lang = d.lang GROUP BY d.doc_id""",
    "positional_penalty": f"""WITH s AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
        t AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, token ORDER BY pos) AS k FROM t),
        n AS (SELECT a.conv_id, a.turn, len(a.w) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.w) = len(b.w) AND len(a.w) > 0),
        m AS (SELECT a.conv_id, a.turn, sum(abs(a.pos - b.pos)) AS d FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.token = b.token AND a.k = b.k GROUP BY ALL)
        SELECT conv_id, turn, round(least(0.2, 0.2 * coalesce(d, 0) / (n * n)), 6)::DOUBLE AS penalty FROM n LEFT JOIN m USING (conv_id, turn)""",
    "complexity_factor": """SELECT l_orderkey, round(CASE WHEN o + n = 0 THEN 1.0 ELSE 1.0 - least(1.0, abs(n - o) / (o + n)) END, 6)::DOUBLE AS factor
        FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS o, count(*) FILTER (l_linestatus = 'O') AS n FROM lineitem GROUP BY l_orderkey)""",
    "intensity_case": "SELECT l_returnflag, CASE WHEN l_quantity * 2 >= 80 THEN 'low' WHEN l_quantity * 2 >= 50 THEN 'medium' ELSE 'high' END AS change_intensity, count(*) AS n FROM lineitem GROUP BY ALL",
    "merkle_hash_rollup": """WITH l AS (SELECT l_orderkey, md5(concat_ws('|', 'line', l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)) AS h FROM lineitem),
        r AS (SELECT l_orderkey, md5(string_agg(h, '' ORDER BY h)) AS h FROM l GROUP BY l_orderkey),
        o AS (SELECT o_custkey, md5(concat_ws('|', o_orderstatus, h)) AS h FROM orders JOIN r ON o_orderkey = l_orderkey)
        SELECT o_custkey AS c_custkey, count(*) AS orders, md5('customer|' || string_agg(h, '' ORDER BY h)) AS hash FROM o GROUP BY o_custkey""",
    "context_hash": """WITH n AS (SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS sibling_index FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT n_nationkey, sibling_index, md5(concat_ws('|', md5(r_name), 'region', sibling_index, '1')) AS context_hash FROM n""",
    "window_overlap_filter": """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events)
        SELECT event_id, user_id, event_type FROM e WHERE EXISTS (SELECT 1 FROM e w WHERE w.event_type = 'error' AND w.user_id = e.user_id AND abs(w.t - e.t) <= 60000000)""",
    "call_graph_edges": """SELECT l_partkey AS caller, l_returnflag AS caller_file, s_suppkey AS callee, s_nationkey::BIGINT AS callee_file, min(l_linenumber)::BIGINT AS row
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "blast_radius_depth5": """WITH RECURSIVE r(root, node, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT root, node // 2, depth + 1 FROM r WHERE node > 0 AND depth < 5),
        n AS (SELECT root, count(DISTINCT node) FILTER (depth > 0) AS callers, coalesce(max(depth), 0)::BIGINT AS depth FROM r GROUP BY root)
        SELECT root, callers, depth, CASE WHEN callers >= 5 THEN 'HIGH' WHEN callers > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM n""",
    "removed_guards": r"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT DISTINCT source, CASE WHEN contains(lower(line), 'license') THEN 'license' WHEN contains(line, '@') THEN 'contact' ELSE 'prose' END AS kind, md5(line) AS guard FROM l)
        SELECT source, kind, count(*) AS removed FROM k WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM k s WHERE s.source = 'src0' AND s.kind = k.kind AND s.guard = k.guard) GROUP BY ALL""",
    "dataflow_tag": """WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t, lead(o_orderstatus) OVER w AS s2, lead(o_orderpriority) OVER w AS p2, lead(o_totalprice) OVER w AS t2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT o_orderkey, CASE WHEN s = s2 AND p = p2 AND t = t2 THEN 'UNCHANGED' WHEN s = s2 AND p <> p2 THEN 'COSMETIC_LOCAL_RENAME' WHEN p = p2 AND s = s2 THEN 'PURE_CONTROL_FLOW' ELSE 'DATA_FLOW_MUTATED' END AS tag FROM o WHERE s2 IS NOT NULL""",
    "type_widening": """WITH p AS (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS a, p_size, lead(string_split(p_type || ' ' || p_name, ' ')) OVER w AS b, lead(p_size) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
        z AS (SELECT p_partkey, list_filter(list_transform(list_zip(a, b), lambda x: CASE WHEN x[1] <> x[2] THEN x[1] || ' -> ' || x[2] END), lambda x: x IS NOT NULL)[1] AS refactor, next > p_size AS widened FROM p WHERE b IS NOT NULL)
        SELECT * FROM z WHERE refactor IS NOT NULL""",
    "classify_commit": f"""WITH {_ORDERS}, m AS (SELECT priority, count(DISTINCT changed) AS files, count(*) FILTER (changed = 'o_custkey') AS renames, count(*) FILTER (op_type = 'INSERT') AS inserts, count(*) FILTER (op_type = 'DELETE') AS deletes,
            count(*) FILTER (op_type = 'MODIFY' AND changed <> 'o_custkey') AS modifies, count(*) FILTER (contains(changed, 'status')) AS flow FROM ops GROUP BY priority),
        t AS (SELECT *, (renames + inserts + deletes + modifies) AS total FROM m),
        s AS (SELECT priority, total, {_points([(0.30, "renames > inserts"), (0.15, "true")])} AS refactor,
            {_points([(0.40, "inserts / total > 0.5"), (0.15, "inserts / total <= 0.5 AND inserts > 0"), (0.35, "inserts > 0"), (0.15, "inserts > deletes * 2"), (0.10, "modifies > 0 AND inserts > modifies")])} AS feature,
            {_points([(0.30, "modifies / total >= 0.6"), (0.20, "files <= 3 AND total <= 10"), (0.25, "flow > 0"), (0.15, "inserts = 0"), (0.10, "true")])} AS bug_fix,
            {_points([(0.30, "deletes / total > 0.5"), (0.15, "inserts = 0"), (0.15, "flow = 0"), (0.15, "true")])} AS cleanup FROM t),
        l AS (SELECT priority, unnest([{{'s': round(refactor, 6), 'i': 0, 'k': 'refactor'}}, {{'s': round(feature, 6), 'i': 1, 'k': 'feature'}}, {{'s': round(bug_fix, 6), 'i': 2, 'k': 'bug_fix'}}, {{'s': round(cleanup, 6), 'i': 3, 'k': 'cleanup'}}]) AS x FROM s),
        r AS (SELECT priority, x.k AS k, x.s AS s, lead(x.s) OVER w AS second, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY priority ORDER BY x.s DESC, x.i))
        SELECT priority, CASE WHEN round(s - second, 6) < 0.1 AND s > 0 THEN 'mixed' ELSE k END AS primary_class, round(CASE WHEN round(s - second, 6) < 0.1 AND s > 0 THEN s * 0.8 ELSE s END, 6)::DOUBLE AS confidence FROM r WHERE n = 1""",
    "intent_labels": """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id, lower(html) AS d FROM pages),
        x AS (SELECT host, page_id, 0 AS i, 'GUARD_CLAUSE_ADDED' AS label FROM p WHERE contains(d, 'guard') OR contains(d, 'null check') OR contains(d, 'bounds')
              UNION ALL SELECT host, page_id, 1, 'TYPE_SIGNATURE_CHANGED' FROM p WHERE contains(d, 'signature') OR contains(d, 'param') OR contains(d, 'return type')
              UNION ALL SELECT host, page_id, 2, 'RESOURCE_CLEANUP_ADDED' FROM p WHERE contains(d, 'close') OR contains(d, 'drop') OR contains(d, 'cleanup') OR contains(d, 'free')),
        f AS (SELECT host, i, label, min(page_id) AS first FROM x GROUP BY ALL)
        SELECT host, string_agg(label, ',' ORDER BY first, i) AS labels FROM f GROUP BY host""",
    "granularity": """SELECT o_custkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 OR count(DISTINCT l_orderkey) > 2 OR count(*) > 3 THEN 'standard' ELSE 'micro_compact' END AS granularity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    "lint_crossjoin": f"""WITH r(i, name, severity, message) AS (VALUES {_RULES}),
        s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS row FROM s)
        SELECT doc_id, row::BIGINT AS row, name AS rule_name, severity, replace(replace(message, '$file', doc_id::VARCHAR), '$line', row::VARCHAR) AS message
        FROM n, r WHERE len(list_filter(string_split(name, '_'), lambda t: t <> 'no' AND contains(lower(line), t))) > 0""",
    "rule_annotate": f"SELECT conv_id, turn, md5(d) AS details_md5, d <> text AS annotated FROM (SELECT conv_id, turn, text, {_annotate_sql()} AS d FROM conversations)",
    "lang_detect": """WITH p AS (SELECT page_id, 'src/' || string_split(string_split(regexp_replace(url, '[?#].*$', ''), '/')[3], '.')[-1] || '.' || (['py', 'rs', 'tsx', 'h++', 'jsonc', 'txt'])[length(url) % 6 + 1] AS path FROM pages)
        SELECT page_id, path, CASE string_split(path, '.')[-1] WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'tsx' THEN 'typescript' WHEN 'h++' THEN 'cpp' WHEN 'jsonc' THEN 'json' END AS lang FROM p""",
    "glob_filter": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http[^/]*://.*/(en|fr)/[^/]*$')",
}
