"""Each reusable operator on the driver's own tables, with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions.docs import decode_codes, doc_get, with_documents
from tripline.functions.predicates import full_match, ilike_any, ilike_raw, is_internal_host, like_raw
from tripline.functions.text import last_part, remote_host
from tripline.functions.timeops import as_ntz, days_between, from_epoch_seconds, recent, span, time_slice, within
from tripline.operators.aggs import any_of, burst, many_distinct, one_distinct, outcome_counts, sliced_actions, sorted_set
from tripline.operators.baseline import KnownTuples
from tripline.operators.intervals import interval_join
from tripline.operators.latest import first_seen_flag, latest_per_key
from tripline.operators.lookups import exclude_known, flag_known, keep_known, novel_vs_baseline, suffix_pattern_join
from tripline.operators.ordered import first_in_order
from tripline.operators.overlap import overlap_join
from tripline.operators.pieces import put_together, set_pieces
from tripline.operators.sizing import narrow_to_keys
from tripline.operators.workdir import WorkDir
from tripline.sources.file_times import FileTimes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst(
        _table(spark, sf_dir, "events"),
        "ts",
        time_slice("ts", 3600),
        ["user_id"],
        [F.count("*").alias("counter"), F.count_distinct("event_type").alias("types")],
        (F.col("counter") > 2) | (F.col("types") > 1),
    )


HOUR_BURST = """
SELECT date_trunc('hour', ts) AS bucket, user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS counter,
       count(DISTINCT event_type) AS types
FROM events GROUP BY ALL HAVING count(*) > 2 OR count(DISTINCT event_type) > 1
"""


def cond_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    households = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD")
    orders = _table(spark, sf_dir, "orders").where(~like_raw("o_orderpriority", "%LOW"))
    return burst(
        exclude_known(orders, "o_custkey", households, "c_custkey"),
        "o_orderdate",
        F.trunc("o_orderdate", "month"),
        ["o_custkey"],
        [
            *outcome_counts(F.col("o_orderstatus") == "F"),
            F.count_distinct("o_orderkey").alias("object_count"),
        ],
        F.col("object_count") > 2,
    )


COND_BURST = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, o_custkey, min(o_orderdate) AS start_time,
       max(o_orderdate) AS end_time, count(*) FILTER (WHERE o_orderstatus <> 'F') AS successful_attempts,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS failed_attempts, count(DISTINCT o_orderkey) AS object_count
FROM orders
WHERE NOT ends_with(o_orderpriority, 'LOW')
  AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'HOUSEHOLD')
GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) > 2
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn(
        "place", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3)
    )


def _new_places(novel: DataFrame) -> DataFrame:
    return (
        novel.groupBy("user_id", "event_type")
        .agg(
            F.min("ts").alias("earliest"),
            F.max("ts").alias("latest"),
            F.array_join(sorted_set("place").cast("array<string>"), ",").alias("places"),
        )
    )


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _placed(spark, sf_dir)
    baseline = within(events, "ts", "2024-01-01 00:00:00", "2024-01-08 00:00:00")
    return _new_places(novel_vs_baseline(events, baseline, ["user_id", "event_type"], "place"))


def kept_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a baseline that learns in three steps, is compacted and learns some of it again."""
    events = _placed(spark, sf_dir)
    name = f"known_{uuid4().hex}"
    folder = WorkDir.for_session(spark).new_path("baseline")
    known = KnownTuples(spark, name, folder, ["user_id", "event_type"], "place", 8)
    known.learn(within(events, "ts", "2024-01-01 00:00:00", "2024-01-03 00:00:00"))
    known.learn(within(events, "ts", "2024-01-02 00:00:00", "2024-01-06 00:00:00"))
    known.compact()
    known.learn(within(events, "ts", "2024-01-01 00:00:00", "2024-01-08 00:00:00"))
    return _new_places(known.novel(events))


NOVELTY = """
WITH placed AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 END AS place FROM events),
known AS (SELECT DISTINCT user_id AS u, event_type AS t, place AS p FROM placed
          WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-08' AND place IS NOT NULL)
SELECT user_id, event_type, min(ts) AS earliest, max(ts) AS latest,
       coalesce(string_agg(DISTINCT CAST(place AS VARCHAR), ',' ORDER BY CAST(place AS VARCHAR)), '') AS places
FROM placed
WHERE NOT EXISTS (SELECT 1 FROM known WHERE u = user_id AND t = event_type AND (place IS NULL OR p = place))
GROUP BY user_id, event_type
"""


def _signups_and_purchases(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    signups = events.where(F.col("event_type") == "signup").select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_time")
    )
    purchases = events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_time")
    )
    return interval_join(
        signups, purchases, {"user_id": "buyer"}, "signup_time", "purchase_time", 0, 6 * 3600, how
    )


def interval_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signups_and_purchases(spark, sf_dir, "inner")


def interval_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signups_and_purchases(spark, sf_dir, "left")


_INTERVAL_JOIN = """
SELECT s.user_id, s.event_id AS signup_id, s.ts AS signup_time, p.user_id AS buyer, p.event_id AS purchase_id,
       p.ts AS purchase_time
FROM (SELECT * FROM events WHERE event_type = 'signup') AS s
{how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') AS p
  ON p.user_id = s.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 6 HOUR
"""
INTERVAL_JOIN_INNER = _INTERVAL_JOIN.format(how="INNER")
INTERVAL_JOIN_LEFT = _INTERVAL_JOIN.format(how="LEFT")


def latest_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    signups = _table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return latest_per_key(signups, ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "ts", "value")


LATEST_SIGNUP = """
SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'signup'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    flagged = first_seen_flag(events, ["user_id", "event_type"], "ts", ["event_id"], "first")
    return flagged.select("event_id", F.when(F.col("first"), F.lit("first")).otherwise(F.lit("later")).alias("state"))


def first_seen_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    flagged = first_in_order(events, ["user_id", "event_type"], "ts", ["event_id"], "first", WorkDir.for_session(spark))
    return flagged.select("event_id", F.when(F.col("first"), F.lit("first")).otherwise(F.lit("later")).alias("state"))


FIRST_SEEN = """
SELECT event_id, if(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1, 'later', 'first') AS state
FROM events
"""


def known_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    builders = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return flag_known(orders, "o_custkey", builders, "c_custkey", "in_segment")


KNOWN_CUSTOMER = """
SELECT o_orderkey, o_custkey,
       o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS in_segment
FROM orders
"""


def left_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_nation = (
        _table(spark, sf_dir, "supplier")
        .where(F.col("s_acctbal") > 5000)
        .groupBy("s_nationkey")
        .agg(F.count("*").alias("suppliers"), F.max("s_acctbal").alias("highest"))
    )
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customers.join(per_nation, F.col("c_nationkey") == F.col("s_nationkey"), "left").drop("s_nationkey")


LEFT_ONE_KEY = """
SELECT c_custkey, c_nationkey, suppliers, highest
FROM customer
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, max(s_acctbal) AS highest FROM supplier
           WHERE s_acctbal > 5000 GROUP BY s_nationkey) ON s_nationkey = c_nationkey
"""


def left_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7 + 1).alias("line"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    matches = [F.col("o_orderkey") == F.col("l_orderkey"), F.col("line") == F.col("l_linenumber")]
    return orders.join(lines, matches, "left").select(orders["*"], "l_partkey")


LEFT_TWO_KEYS = """
SELECT o_orderkey, o_custkey % 7 + 1 AS line, l_partkey
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1
"""


def semi_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    signups = events.where((F.col("event_type") == "signup") & (F.col("value") > 40))
    return (
        keep_known(events, "user_id", signups, "user_id")
        .groupBy("user_id")
        .agg(F.count("*").alias("counter"), F.max("ts").alias("last_call"))
    )


SEMI_PREFILTER = """
SELECT user_id, count(*) AS counter, max(ts) AS last_call FROM events
WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 40) GROUP BY user_id
"""


def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer").select(
        F.concat("c_name", F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(".json")).alias("file")
    )
    projects = _table(spark, sf_dir, "supplier").select(
        F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("project")
    )
    return suffix_pattern_join(names, "file", projects, "project", r"-[a-z0-9]{12}\.json", 18)


SUFFIX_JOIN = """
SELECT file
FROM (SELECT concat(c_name, '-', lpad(CAST(c_custkey AS VARCHAR), 12, '0'), '.json') AS file FROM customer)
JOIN (SELECT DISTINCT replace(s_name, 'Supplier', 'Customer') AS project FROM supplier)
  ON starts_with(file, project) AND regexp_full_match(substr(file, length(project) + 1), '-[a-z0-9]{12}[.]json')
"""


def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", remote_host("url").alias("host"))
    return (
        pages.where(F.col("host").contains(".") & ~is_internal_host("host"))
        .groupBy("host")
        .agg(
            F.count_distinct("page_id").alias("pages"),
            F.count_distinct(F.lower("url")).alias("urls"),
            F.min("url").alias("example"),
        )
        .orderBy("host")
    )


HOST_ROLLUP = """
SELECT regexp_extract(lower(url), '//([^/]*)', 1) AS host, count(DISTINCT page_id) AS pages,
       count(DISTINCT lower(url)) AS urls, min(url) AS example
FROM pages WHERE contains(regexp_extract(lower(url), '//([^/]*)', 1), '.') GROUP BY 1 ORDER BY 1
"""


def name_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(last_part("p_name", " ").alias("tail")).distinct()


NAME_TAIL = "SELECT DISTINCT regexp_extract(p_name, '[^ ]*$') AS tail FROM part"


def doc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_documents(_table(spark, sf_dir, "events"), "props")
    return (
        events.select(
            "event_id", doc_get("props", "k", "int").alias("k"), doc_get("props", "k.missing").alias("missing")
        )
        .where(F.col("k") < 7)
    )


DOC_FILTER = """
SELECT event_id, CAST(props ->> 'k' AS INT) AS k, CAST(NULL AS VARCHAR) AS missing
FROM events WHERE CAST(props ->> 'k' AS INT) < 7
"""


def any_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return documents.where(ilike_any("text", ("%LICENSE%", "%password%", "%http%@%"))).select("doc_id", "lang")


ANY_PATTERN = """
SELECT doc_id, lang FROM documents
WHERE contains(lower(text), 'license') OR contains(lower(text), 'password')
   OR regexp_matches(lower(text), '(?s)http.*@')
"""


def page_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.where(like_raw(F.lower("html"), '%<html lang="en">%track(%')).select(
        "page_id", ilike_raw("url", "HTTPS:%").alias("secure"), full_match("url", r".*/[a-z]{2}/[0-9]+").alias("plain")
    )


PAGE_PATTERNS = """
SELECT page_id, starts_with(lower(url), 'https:') AS secure, regexp_full_match(url, '.*/[a-z]{2}/[0-9]+') AS plain
FROM pages WHERE regexp_matches(lower(html), '(?s)<html lang="en">.*track[(]')
"""


def raw_backslash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("o_orderpriority", F.char(F.lit(92)), "o_orderstatus", F.lit("%"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return orders.where(like_raw("path", r"%LOW\F%") | ilike_raw("path", r"1-urgent\%"))


RAW_BACKSLASH = """
SELECT o_orderkey, concat(o_orderpriority, chr(92), o_orderstatus, '%') AS path FROM orders
WHERE (ends_with(o_orderpriority, 'LOW') AND o_orderstatus = 'F') OR o_orderpriority = '1-URGENT'
"""


def enum_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = decode_codes(F.col("l_linenumber") - 1, ("unspecified", "user", "system"))
    return (
        _table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.array_join(sorted_set(label), ",").alias("labels"), F.count("*").alias("counter"))
    )


ENUM_DECODE = """
SELECT l_orderkey,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE label IS NOT NULL), '') AS labels,
       count(*) AS counter
FROM (SELECT l_orderkey, ['unspecified', 'user', 'system'][l_linenumber] AS label FROM lineitem)
GROUP BY l_orderkey
"""


def day_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("ts") + span(95, "MINUTE")
    return _table(spark, sf_dir, "events").select(
        "event_id",
        days_between("ts", later).alias("forward"),
        days_between(later, "ts").alias("backward"),
        days_between("ts", as_ntz("2024-01-31 00:00:00")).alias("to_date"),
    )


DAY_DIFFERENCE = """
SELECT event_id, CAST(date_diff('day', ts, ts + INTERVAL 95 MINUTE) AS INT) AS forward,
       CAST(date_diff('day', ts + INTERVAL 95 MINUTE, ts) AS INT) AS backward,
       CAST(date_diff('day', ts, TIMESTAMP '2024-01-31') AS INT) AS to_date
FROM events
"""


def epoch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("l_orderkey") * 1_000_003 - 500_000_000
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", from_epoch_seconds(seconds).alias("moment")
    )


EPOCH_TIME = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_orderkey * 1000003 - 500000000 <= 253402300799
            THEN make_timestamp((l_orderkey * 1000003 - 500000000) * 1000000) END AS moment
FROM lineitem
"""


def slice_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn(
        "weekday", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2)
    )
    slices = sliced_actions(
        events,
        "ts",
        ["user_id"],
        "event_type",
        "weekday",
        6 * 3600,
        (one_distinct("weekday").alias("one"), many_distinct("weekday").alias("many")),
    ).where(any_of("actions", ("click", "view")) & ~F.col("one"))
    return (
        slices.groupBy(time_slice("slice_start", 86400).alias("day"), "sources", "many")
        .agg(
            F.array_join(sorted_set("user_id").cast("array<string>"), ",").alias("users"),
            F.array_join(
                F.array_sort(F.transform(F.collect_set("actions"), lambda actions: F.array_join(actions, "+"))), ","
            ).alias("seen"),
            F.count("*").alias("counter"),
            F.count_distinct("user_id").alias("user_count"),
        )
        .where(F.col("user_count") >= 2)
        .withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))
    )


SLICE_AGG = """
WITH slices AS (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) AS slice, user_id,
         string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS actions,
         bool_or(event_type IN ('click', 'view')) AS wanted,
         count(DISTINCT CASE WHEN event_id % 5 <> 0 THEN event_id % 2 END) AS kinds,
         coalesce(array_to_string(list_sort(list(DISTINCT event_id % 2) FILTER (WHERE event_id % 5 <> 0)), ','), '') AS sources
  FROM events GROUP BY 1, 2
)
SELECT date_trunc('day', slice) AS day, sources, kinds > 1 AS many,
       array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users,
       string_agg(DISTINCT actions, ',' ORDER BY actions) AS seen, count(*) AS counter,
       count(DISTINCT user_id) AS user_count
FROM slices WHERE wanted AND kinds <> 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT user_id) >= 2
"""


def overlapping_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of returned parts against later quarters of other parts, by line number."""
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("owner"),
        F.trunc("l_shipdate", "quarter").cast("timestamp_ntz").alias("start"),
        F.col("l_partkey").alias("element"),
        (F.col("l_returnflag") == "R").alias("is_earlier"),
    )
    members = lines.distinct()
    keys = ["owner", "start", "is_earlier"]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") >= 6)
    set_id = F.concat_ws("/", "owner", F.col("start").cast("date"))
    sets = WorkDir.for_session(spark).store(members.join(sizes, keys).withColumn("set_id", set_id), "sets")
    return overlap_join(sets, 400, 0.075)


OVERLAPPING_BASKETS = """
WITH sets AS (
  SELECT l_returnflag = 'R' AS returned, l_linenumber AS owner, date_trunc('quarter', l_shipdate) AS start,
         list(DISTINCT l_partkey) AS elements
  FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 6
)
SELECT concat(a.owner, '/', CAST(a.start AS DATE)) AS earlier_id, concat(b.owner, '/', CAST(b.start AS DATE)) AS later_id,
       len(list_intersect(a.elements, b.elements)) AS matched
FROM sets AS a JOIN sets AS b ON a.owner = b.owner AND a.returned AND NOT b.returned
WHERE a.start <= b.start AND a.start >= b.start - INTERVAL 400 DAY
  AND len(list_intersect(a.elements, b.elements)) >= 0.075 * least(len(a.elements), len(b.elements))
"""


def recent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    return (
        recent(events, "ts", 20, "2024-01-31 00:00:00")
        .groupBy("event_type")
        .agg(F.count("*").alias("counter"), F.min("ts").alias("earliest"))
    )


RECENT_FILTER = """
SELECT event_type, count(*) AS counter, min(ts) AS earliest FROM events
WHERE event_type IN ('click', 'error') AND ts > TIMESTAMP '2024-01-11' GROUP BY event_type
"""


def distinct_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    found = recent(events, "ts", 20, "2024-01-31 00:00:00", inclusive=True).select("ts", "event_type", "user_id")
    return found.distinct().orderBy("ts", "event_type", "user_id").limit(1000)


DISTINCT_LIMIT = """
SELECT DISTINCT ts, event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-11'
ORDER BY ts, event_type, user_id LIMIT 1000
"""

Query = Callable[[SparkSession, str], DataFrame]

def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of dear urgent orders, in several steps that a filter on rare keys precedes."""
    orders = _table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200000))
    work = WorkDir.for_session(spark)
    rare = work.store(orders.select(F.col("o_orderkey").cast("int").alias("key"), "o_custkey"), "rare")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    close = narrow_to_keys(lines, [{"l_orderkey": "key"}], rare, work, 0.01)
    return close.join(rare, close["l_orderkey"] == rare["key"]).select("l_orderkey", "l_linenumber", "l_suppkey", "o_custkey")


MEMBERSHIP = """
SELECT l_orderkey, l_linenumber, l_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000
"""


def pieces_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of lines by return flag, in pieces of 300, and put together again."""
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    pieces = set_pieces(lines, ["l_returnflag"], "l_partkey", WorkDir.for_session(spark), "parts", 300)
    whole = put_together(pieces, ["l_returnflag"], "parts")
    figures = pieces.groupBy(F.col("l_returnflag").alias("mode")).agg(
        F.max(F.size("parts")).alias("largest"), F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total")
    )
    return whole.join(figures, F.col("l_returnflag") == F.col("mode")).select(
        "l_returnflag", "size", "total", (F.col("largest") <= 300).alias("bounded"), F.array_join(F.slice("parts", 1, 5), ",").alias("first_parts")
    )


PIECES = """
SELECT l_returnflag, count(DISTINCT l_partkey) AS size, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS total, true AS bounded,
       array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 5), ',') AS first_parts
FROM lineitem GROUP BY l_returnflag
"""


def files_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days of a log in eight files whose times are kept beside it; two more files arrive later."""
    work = WorkDir.for_session(spark)
    log, index = work.new_path("log"), work.new_path("times")
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    early, late = (events.where(F.col("ts") < as_ntz("2024-01-28 00:00:00")), events.where(F.col("ts") >= as_ntz("2024-01-28 00:00:00")))
    times = FileTimes(spark, index, "ts")
    for part, count in ((early, 8), (late, 2)):
        part.repartitionByRange(count, "ts").write.mode("append").parquet(log)
        times.update(spark.read.parquet(log).inputFiles())
    return times.read(events.schema, "2024-01-26 00:00:00")


FILES_BY_TIME = "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-26'"


QUERIES: dict[str, tuple[Query, str]] = {
    "hour_burst": (hour_burst, HOUR_BURST),
    "cond_burst": (cond_burst, COND_BURST),
    "novel_vs_baseline": (novelty, NOVELTY),
    "novel_vs_kept_baseline": (kept_novelty, NOVELTY),
    "interval_join_inner": (interval_join_inner, INTERVAL_JOIN_INNER),
    "interval_join_left": (interval_join_left, INTERVAL_JOIN_LEFT),
    "latest_per_key": (latest_signup, LATEST_SIGNUP),
    "first_seen_flag": (first_seen, FIRST_SEEN),
    "first_in_order": (first_seen_in_order, FIRST_SEEN),
    "flag_known": (known_customer, KNOWN_CUSTOMER),
    "left_one_key": (left_one_key, LEFT_ONE_KEY),
    "left_two_keys": (left_two_keys, LEFT_TWO_KEYS),
    "semi_prefilter": (semi_prefilter, SEMI_PREFILTER),
    "suffix_pattern_join": (suffix_join, SUFFIX_JOIN),
    "host_rollup": (host_rollup, HOST_ROLLUP),
    "name_tail": (name_tail, NAME_TAIL),
    "doc_filter": (doc_filter, DOC_FILTER),
    "ilike_any": (any_pattern, ANY_PATTERN),
    "page_patterns": (page_patterns, PAGE_PATTERNS),
    "like_escape": (raw_backslash, RAW_BACKSLASH),
    "enum_decode": (enum_decode, ENUM_DECODE),
    "days_between": (day_difference, DAY_DIFFERENCE),
    "epoch_ts": (epoch_time, EPOCH_TIME),
    "slice_agg": (slice_agg, SLICE_AGG),
    "overlap_join": (overlapping_baskets, OVERLAPPING_BASKETS),
    "recent_filter": (recent_filter, RECENT_FILTER),
    "distinct_limit": (distinct_limit, DISTINCT_LIMIT),
    "narrow_by_membership": (membership, MEMBERSHIP),
    "set_pieces": (pieces_of_sets, PIECES),
    "files_by_time": (files_by_time, FILES_BY_TIME),
}
