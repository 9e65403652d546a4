"""Aggregates, windows, joins and set operations over the star schema and its tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.operators import similarity
from tesserae.operators.bootstrap import RESAMPLES, intervals, weight_sql
from tesserae.operators.ranks import numbered
from tesserae.operators.selection import values_at
from tesserae.operators.sessions import next_marker
from tesserae.plans.registry import query
from tesserae.storage import bounded, cut, shuffle_parts


@query("a1_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def histogram(x):
    return x.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a2_shares", "SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_share, count(*) FILTER (value > 100) AS n_large FROM events GROUP BY 1")
def shares(x):
    return x.events.groupBy("user_id").agg(F.count("*").alias("n"), stats.share(F.col("event_type") == "error").alias("error_share"), F.count_if(F.col("value") > 100).alias("n_large"))


@query("a3_duplicates", "SELECT count(DISTINCT text) AS n_texts, 1 - count(DISTINCT text) / CAST(count(*) AS DOUBLE) AS duplicate_share FROM documents")
def duplicates(x):
    # texts differ where their digests do, which are all that is shuffled
    return x.documents.select(F.sha2("text", 256).alias("d")).agg(F.count_distinct("d").alias("n_texts"), (1 - F.count_distinct("d") / F.count("*")).alias("duplicate_share"))


@query("a4_dispersion", "SELECT l_returnflag AS kernel, l_linestatus AS impl, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd, CASE WHEN avg(l_quantity) = 0 THEN 0 ELSE 100 * stddev_pop(l_quantity) / avg(l_quantity) END AS cv FROM lineitem GROUP BY 1, 2")
def dispersion(x):
    q = F.col("l_quantity")
    return x.lineitem.groupBy(F.col("l_returnflag").alias("kernel"), F.col("l_linestatus").alias("impl")).agg(F.avg(q).alias("mean"), F.stddev_pop(q).alias("sd"), stats.cv_percent(q).alias("cv"))


@query("a5_percentiles", """WITH s AS (SELECT l_suppkey AS k, list_sort(list(l_quantity)) AS v, count(*) AS n, quantile_cont(l_quantity, 0.9) AS linear FROM lineitem GROUP BY 1)
SELECT k, v[CAST(least(n - 1, floor(0.9 * n)) AS BIGINT) + 1] AS floor_index, v[CAST(greatest(0, ceil(0.9 * n) - 1) AS BIGINT) + 1] AS nearest_rank, linear, v[n // 2 + 1] AS upper_median, v[n * 9 // 10 + 1] AS ninth_tenth FROM s""")
def percentiles(x):
    """Five definitions side by side, from the values at their places."""
    n = F.col("n")
    index = {
        "floor_index": F.least(n - 1, F.floor(0.9 * n)), "nearest_rank": F.greatest(F.lit(0), F.ceil(0.9 * n) - 1), "upper_median": F.floor(n / 2), "ninth_tenth": F.floor(n * 9 / 10),
        "below": F.floor(0.9 * (n - 1)), "above": F.ceil(0.9 * (n - 1)),
    }
    found = values_at(x.lineitem.select(F.col("l_suppkey").alias("k"), "l_quantity"), ["k"], "l_quantity", index)
    part = 0.9 * (n - 1) - F.floor(0.9 * (n - 1))
    return found.select("k", "floor_index", "nearest_rank", (F.col("below") + part * (F.col("above") - F.col("below"))).alias("linear"), "upper_median", "ninth_tenth")


@query("a6_geomean", "SELECT l_shipdate IS NULL AS missing, l_linestatus AS impl, exp(avg(ln(l_extendedprice)) FILTER (l_extendedprice > 0)) AS geomean FROM lineitem GROUP BY 1, 2")
def geomean(x):
    return x.lineitem.groupBy(F.col("l_shipdate").isNull().alias("missing"), F.col("l_linestatus").alias("impl")).agg(stats.geomean(F.col("l_extendedprice")).alias("geomean"))


@query("a7_best_row", "SELECT l_partkey, max(struct_pack(p := l_extendedprice, o := -l_orderkey, n := -l_linenumber)).p AS price, -max(struct_pack(p := l_extendedprice, o := -l_orderkey, n := -l_linenumber)).o AS l_orderkey FROM lineitem GROUP BY 1")
def best_row(x):
    best = x.lineitem.groupBy("l_partkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))).alias("b"))
    return best.select("l_partkey", F.col("b.l_extendedprice").alias("price"), (-F.col("b.o")).alias("l_orderkey"))


@query("a8_first_last", "SELECT user_id, min(ts) AS first_seen, arg_max(event_type, event_id) AS last_type, max(value) AS high FROM events GROUP BY 1")
def first_last(x):
    return x.events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max_by("event_type", "event_id").alias("last_type"), F.max("value").alias("high"))


@query("a9_tri_state", "WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS ok FROM orders) SELECT o_custkey, bool_and(ok IS DISTINCT FROM false) AS all_ok, bool_or(coalesce(ok, false)) AS any_ok FROM o GROUP BY 1")
def tri_state(x):
    ok = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return x.orders.groupBy("o_custkey").agg(F.min(stats.not_false(ok)).alias("all_ok"), F.max(F.coalesce(ok, F.lit(False))).alias("any_ok"))


@query("a11_family_summary", """SELECT lang, source, count(*) AS n, avg(n_chars) AS mean_chars, count(*) FILTER (quality = 1) AS n_good, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS toxic_share
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())""")
def family_summary(x):
    joined = x.documents.select("doc_id", "lang", "source", "n_chars").join(x.labels, "doc_id", "left")
    sets = joined.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.count_if(F.col("quality") == 1).alias("n_good"), stats.share(F.col("toxic") == 1).alias("toxic_share"))


@query("a13_repeat_medians", "SELECT l_returnflag AS kernel, l_linestatus AS impl, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median, count(*) AS n_repeats FROM lineitem GROUP BY 1, 2")
def repeat_medians(x):
    """Upper median of each kind's repeats."""
    rows = x.lineitem.select(F.col("l_returnflag").alias("kernel"), F.col("l_linestatus").alias("impl"), "l_quantity")
    return values_at(rows, ["kernel", "impl"], "l_quantity", {"median": F.floor(F.col("n") / 2)}).withColumnRenamed("n", "n_repeats")


@query("a14_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def pivot(x):
    return x.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("a17_occurrences", "SELECT sha256(text) AS sha, count(*) AS n, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY 1")
def occurrences(x):
    return x.documents.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("sources"))


@query("a18_first_last_means", """WITH d AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY d) AS a, row_number() OVER (ORDER BY d DESC) AS b FROM d)
SELECT avg(v) FILTER (a <= 3) AS first3, avg(v) FILTER (b <= 3) AS last3 FROM r""")
def first_last_means(x):
    days = x.events.groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    first, last = days.orderBy("d").limit(3), days.orderBy(F.desc("d")).limit(3)
    return first.agg(F.avg("v").alias("first3")).crossJoin(last.agg(F.avg("v").alias("last3")))


@query("a19_cost", "SELECT sum(l_quantity * CASE WHEN p_type LIKE '%BRASS%' THEN 3.0 WHEN p_type LIKE '%STEEL%' THEN 2.0 ELSE 1.0 END) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey")
def cost(x):
    """Rates by the first name that a type contains, and a default."""
    rate = F.when(F.col("p_type").contains("BRASS"), 3.0).when(F.col("p_type").contains("STEEL"), 2.0).otherwise(1.0)
    return x.lineitem.select("l_partkey", "l_quantity").join(x.part.select("p_partkey", rate.alias("rate")), F.col("l_partkey") == F.col("p_partkey")).agg(F.sum(F.col("l_quantity") * F.col("rate")).alias("cost"))


@query("a20_document_frequency", """WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT greatest(2, 0.05 * count(*)) AS least FROM documents)
SELECT sha256(line) AS line, count(*) AS df FROM l, n WHERE line <> '' GROUP BY l.line, least HAVING count(*) >= least""")
def document_frequency(x):
    """Lines that are common: in at least two documents and in a twentieth of them."""
    docs = x.documents
    least = docs.agg(F.greatest(F.lit(2.0), 0.05 * F.count("*")).alias("least"))
    lines = docs.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    return lines.groupBy(F.sha2("line", 256).alias("line")).agg(F.count("*").alias("df")).crossJoin(F.broadcast(least)).where("df >= least").drop("least")


@query("a21_bootstrap", f"""WITH w AS (SELECT c_nationkey AS g, c_acctbal AS q, b, {weight_sql("c_custkey", "b")} AS w FROM customer, range({RESAMPLES}) AS r(b)),
m AS (SELECT g, b, quantile_cont(q, 0.5) AS m FROM (SELECT g, b, q, unnest(range(w)) FROM w) GROUP BY ALL) SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY g""")
def bootstrap(x):
    """95 % interval of a group's median from its replicates; a row's weight in one is a fixed function of its key."""
    rows = x.customer.select(F.col("c_nationkey").alias("g"), "c_custkey", "c_acctbal")
    return intervals(rows, "g", "c_custkey", "c_acctbal").select(F.col("g").cast("int").alias("g"), "low", "high")


@query("j1_left_lookup", "SELECT d.doc_id, coalesce(quality, -1) AS quality, quality IS NULL AS missing FROM documents d LEFT JOIN labels USING (doc_id)")
def left_lookup(x):
    return x.documents.select("doc_id").join(x.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.col("quality").isNull().alias("missing"))


@query("j2_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending(x):
    return x.documents.select("doc_id").join(x.labels, "doc_id", "left_anti")


@query("j3_valid", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def valid(x):
    return x.documents.select("doc_id", "lang").join(x.labels.where("quality = 1"), "doc_id", "left_semi")


@query("j5_prefix_join", "WITH a AS (SELECT doc_id, left(sha256(text), 12) AS p FROM documents), b AS (SELECT p, min(doc_id) AS first FROM a GROUP BY 1) SELECT doc_id, first FROM a JOIN b USING (p)")
def prefix_join(x):
    a = x.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("p"))
    return a.join(a.groupBy("p").agg(F.min("doc_id").alias("first")), "p").select("doc_id", "first")


@query("j6_baseline_ratio", """WITH b AS (SELECT l_partkey, list_sort(list(l_extendedprice / l_quantity))[count(*) // 2 + 1] AS base FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity / nullif(base, 0) AS ratio FROM lineitem JOIN b USING (l_partkey)""")
def baseline_ratio(x):
    """Each measurement over the upper median of its part's repeats."""
    own = x.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    base = values_at(own.select("l_partkey", "v"), ["l_partkey"], "v", {"base": F.floor(F.col("n") / 2)})
    return own.join(base.select("l_partkey", "base"), "l_partkey").select("l_orderkey", "l_linenumber", F.try_divide("v", "base").alias("ratio"))


@query("j8_containment", """WITH r AS (SELECT DISTINCT item_id, trim(unnest(string_split(replace(text, chr(10), '. '), '. '))) AS s FROM benchmark), rn AS (SELECT item_id, count(*) AS n FROM r WHERE length(s) >= 20 GROUP BY 1),
d AS (SELECT DISTINCT doc_id, trim(unnest(string_split(replace(text, chr(10), '. '), '. '))) AS s FROM documents), m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN r USING (s) WHERE length(s) >= 20 GROUP BY ALL),
dn AS (SELECT doc_id, count(*) AS nd FROM d WHERE length(s) >= 20 GROUP BY 1),
b AS (SELECT doc_id, max(struct_pack(o := shared / n, k := -item_id, s := shared)) AS b, max(struct_pack(j := shared / (n + nd - shared), k := -item_id)) AS c FROM m JOIN rn USING (item_id) JOIN dn USING (doc_id) GROUP BY 1)
SELECT d.doc_id, -(b).k AS item_id, coalesce((b).o, 0) AS overlap, coalesce((b).s, 0) AS shared, -(c).k AS jaccard_item, coalesce((c).j, 0) AS jaccard, coalesce((b).o >= 0.5, false) AS near FROM documents d LEFT JOIN b USING (doc_id)""")
def containment(x):
    """Each document's best benchmark item by the share of the item's sentences that it holds."""

    def sentences(df, key, size):
        parts = F.transform(F.split(F.regexp_replace("text", "\n", ". "), r"\. "), lambda s: F.trim(s))
        own = F.filter(F.array_distinct(parts), lambda s: F.length(s) >= 20)
        # what stands beside a generator is computed for each of its rows, so the size is taken before
        sized = df.select(key, own.alias("own")).select(key, F.size("own").alias(size), "own")
        return sized.select(key, size, F.explode_outer("own").alias("s")).where("s IS NOT NULL")

    # a text is split once, and its size goes with its sentences
    item, own = bounded(sentences(x.benchmark, "item_id", "n")), sentences(x.documents, "doc_id", "nd")
    shared = own.join(item, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("nd").alias("nd"))
    first = (-F.col("item_id")).alias("k")
    jaccard = F.col("shared") / (F.col("n") + F.col("nd") - F.col("shared"))
    best = shared.groupBy("doc_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("o"), first, "shared")).alias("b"), F.max(F.struct(jaccard.alias("j"), first)).alias("c"))
    return x.documents.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id", (-F.col("b.k")).alias("item_id"), F.coalesce("b.o", F.lit(0.0)).alias("overlap"), F.coalesce("b.shared", F.lit(0)).alias("shared"),
        (-F.col("c.k")).alias("jaccard_item"), F.coalesce("c.j", F.lit(0.0)).alias("jaccard"), F.coalesce(F.col("b.o") >= 0.5, F.lit(False)).alias("near"),
    )


WORDS = "[A-Za-z]+"


BEST_MATCH_SQL = f"""WITH d AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{WORDS}'), lambda w: lower(w)))) AS w FROM documents), i AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{WORDS}'), lambda w: lower(w)))) AS w FROM benchmark),
dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (w) GROUP BY ALL),
b AS (SELECT doc_id, max(struct_pack(s := shared / (dn.n + n.n - shared), k := -item_id, o := shared)) AS b FROM m JOIN dn USING (doc_id) JOIN n USING (item_id) GROUP BY 1)
SELECT d.doc_id, -(b).k AS item_id, coalesce((b).s, 0) AS score, coalesce((b).o, 0) AS shared, coalesce((b).s >= 0.5, false) AS near FROM documents d LEFT JOIN b USING (doc_id)"""


def best_words(x):
    """Each document's most similar benchmark item by the words that both use, of which most documents have many in common."""

    def sets(df, key):
        words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORDS), 0), lambda w: F.lower(w)))
        return df.select(key, words.alias("elements"))

    best = similarity.best_matches(sets(x.documents, "doc_id"), "doc_id", sets(x.benchmark, "item_id"), "item_id")
    found = x.documents.select("doc_id").join(best, "doc_id", "left")
    return found.select("doc_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.coalesce(F.col("score") >= 0.5, F.lit(False)).alias("near"))


query("j8_best_match", BEST_MATCH_SQL)(best_words)


@query("j11_override", "WITH b AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT user_id, sum(value) AS v FROM events GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM a WHERE user_id NOT IN (SELECT user_id FROM b)")
def override(x):
    total = lambda df: df.groupBy("user_id").agg(F.sum("value").alias("v"))
    b = total(x.events.where("event_type = 'purchase'"))
    return b.unionByName(total(x.events).join(b.select("user_id"), "user_id", "left_anti"))


@query("j12_group_baseline", "SELECT l_orderkey, l_linenumber, l_extendedprice / max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS ratio FROM lineitem")
def group_baseline(x):
    base = F.max(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))).over(Window.partitionBy("l_orderkey"))
    return x.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / base).alias("ratio"))


@query("j13_grid", "SELECT n_name, d AS dtype, s AS sample FROM nation, (VALUES ('fp16'), ('bf16')) AS v(d), range(3) AS r(s)")
def grid(x):
    return x.nation.select("n_name", F.explode(F.array(F.lit("fp16"), F.lit("bf16"))).alias("dtype")).select("n_name", "dtype", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample"))


@query("j14_seen_unseen", "WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), e AS (SELECT DISTINCT user_id FROM events WHERE value > 400), u AS (SELECT user_id FROM events UNION SELECT c_custkey FROM customer) SELECT (SELECT count(*) FROM s JOIN e USING (user_id)) AS solved_seen, (SELECT count(*) FROM s ANTI JOIN e USING (user_id)) AS solved_unseen, (SELECT count(*) FROM u) - (SELECT count(*) FROM e) AS n_unseen")
def seen_unseen(x):
    """Solved problems that were seen before and that weren't; of all there are, how many weren't seen."""
    by = x.events.groupBy("user_id").agg(F.max(F.col("event_type") == "purchase").alias("s"), F.max(F.col("value") > 400).alias("e"))
    by = x.customer.select(F.col("c_custkey").alias("user_id")).distinct().join(by, "user_id", "full").select(F.coalesce("s", F.lit(False)).alias("s"), F.coalesce("e", F.lit(False)).alias("e"))
    return by.agg(F.count_if(F.col("s") & F.col("e")).alias("solved_seen"), F.count_if(F.col("s") & ~F.col("e")).alias("solved_unseen"), F.count_if(~F.col("e")).alias("n_unseen"))


@query("u3_set_operations", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS n_both, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS n_first, (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS n_any")
def set_operations(x):
    a, b = x.customer.select("c_nationkey"), x.supplier.select("s_nationkey")
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(a.intersect(b), "n_both").crossJoin(one(a.subtract(b), "n_first")).crossJoin(one(a.union(b).distinct(), "n_any"))


@query("u4_jaccard", "WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY 1), v AS (SELECT user_id, a, lead(a) OVER (ORDER BY user_id) AS b FROM u) SELECT user_id, len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE) AS jaccard FROM v WHERE b IS NOT NULL")
def jaccard(x):
    """Each user and the next one: neighbours inside ranges of users, and the first of the next range for the last of one."""
    u = x.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("a"))
    u = cut(u.repartitionByRange(shuffle_parts(x.spark), "user_id").withColumn("part", F.spark_partition_id()))
    # one row a range
    first = u.groupBy("part").agg(F.min_by("a", "user_id").alias("first")).select("part", F.lead("first").over(Window.orderBy("part")).alias("next"))
    v = u.withColumn("b", F.lead("a").over(Window.partitionBy("part").orderBy("user_id"))).join(F.broadcast(first), "part")
    v = v.select("user_id", "a", F.coalesce("b", "next").alias("b")).where("b IS NOT NULL")
    return v.select("user_id", F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), F.lit(0.0)).alias("jaccard"))


@query("u5_changed", "WITH a AS (SELECT user_id, bool_or(event_type = 'purchase') FILTER (event_id % 2 = 0) AS p, bool_or(event_type = 'purchase') FILTER (event_id % 2 = 1) AS q FROM events GROUP BY 1) SELECT user_id, CASE WHEN p THEN 'regressed' ELSE 'recovered' END AS change FROM a WHERE p <> q")
def changed(x):
    bought = F.col("event_type") == "purchase"
    a = x.events.groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 2 == 0, bought)).alias("p"), F.max(F.when(F.col("event_id") % 2 == 1, bought)).alias("q"))
    return a.where("p <> q").select("user_id", F.when(F.col("p"), "regressed").otherwise("recovered").alias("change"))


@query("w1_priority_dedup", """WITH r AS (SELECT doc_id, source, first_value(source) OVER w AS winner, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, source, doc_id))
SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate_of_' || winner END AS drop_reason FROM r""")
def priority_dedup(x):
    """The winner of equal texts is found by an aggregate, so that a hot text is no window."""
    prio = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    d = x.documents.select("doc_id", "source", F.sha2("text", 256).alias("sha"), prio.alias("prio"))
    best = d.groupBy("sha").agg(F.min(F.struct("prio", "source", "doc_id")).alias("best"))
    return d.join(best, "sha").select("doc_id", F.when(F.col("doc_id") != F.col("best.doc_id"), F.concat(F.lit("duplicate_of_"), "best.source")).alias("drop_reason"))


@query("w3_representative", """WITH d AS (SELECT doc_id, sha256(text) AS sha, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT sha, arg_min(doc_id, struct_pack(q := -q, i := doc_id)) AS representative, count(*) AS n, list_sort(list(doc_id)) AS members FROM d GROUP BY 1 HAVING count(*) > 1""")
def representative(x):
    """Of equal texts the best scored, then the first; all of them are listed, which is the feature."""
    d = x.documents.select("doc_id", F.sha2("text", 256).alias("sha")).join(x.labels.select("doc_id", "quality"), "doc_id", "left")
    best = F.min(F.struct(-F.coalesce("quality", F.lit(0)), "doc_id")).alias("b")
    return d.groupBy("sha").agg(best, F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("members")).where("n > 1").select("sha", F.col("b.doc_id").alias("representative"), "n", "members")


@query("w8_sessions", """WITH e AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM events)
SELECT a.event_id, coalesce(CASE WHEN b.event_type = 'purchase' THEN 'assigned' ELSE 'abandoned' END, 'unfinished') AS state FROM e a LEFT JOIN events b ON a.m = b.event_id WHERE a.event_type NOT IN ('purchase', 'error')""".replace("coalesce(CASE WHEN b.event_type = 'purchase' THEN 'assigned' ELSE 'abandoned' END, 'unfinished')", "CASE WHEN b.event_id IS NULL THEN 'unfinished' WHEN b.event_type = 'purchase' THEN 'assigned' ELSE 'abandoned' END"))
def sessions(x):
    """Lines belong to the next marker of their log (here: user); one kind of marker discards them."""
    marker = F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type"))
    state = F.when(F.col("marker").isNull(), "unfinished").when(F.col("marker") == "purchase", "assigned").otherwise("abandoned")
    found = next_marker(x.events.select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], marker)
    return found.where(~F.col("event_type").isin("purchase", "error")).select("event_id", state.alias("state"))


@query("w11_tail_split", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, CASE WHEN r < 0.15 * n THEN 'val' ELSE 'train' END AS split FROM r")
def tail_split(x):
    """The last rows of each group, by places that no task makes alone."""
    rows = x.orders.select("o_orderkey", "o_orderpriority")
    sizes = rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    r = numbered(rows, [F.desc("o_orderkey")], "r", ["o_orderpriority"]).join(F.broadcast(sizes), "o_orderpriority")
    return r.select("o_orderkey", F.when(F.col("r") < 0.15 * F.col("n"), "val").otherwise("train").alias("split"))


@query("w12_round_robin", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('0:' || p_partkey)) AS n FROM part) SELECT p_partkey, p_brand, n FROM r ORDER BY n, p_brand LIMIT 100")
def round_robin(x):
    """The i-th of each family in turn, up to a number (the feature): no family gives more, so each task keeps so many of each before it sends them."""
    order = F.sha2(F.concat(F.lit("0:"), F.col("p_partkey").cast("string")), 256)
    first = x.part.select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(order)).alias("n")).where("n <= 100")
    return first.select("p_partkey", "p_brand", F.col("n").cast("long").alias("n")).orderBy("n", "p_brand").limit(100)


@query("w15_batches", "SELECT p_type, floor((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) / 8) AS batch, p_partkey FROM part")
def batches(x):
    """Eight rows of a kind to a batch, in order."""
    placed = numbered(x.part.select("p_type", "p_partkey"), [F.col("p_partkey")], "n", ["p_type"])
    return placed.select("p_type", F.floor(F.col("n") / 8).cast("double").alias("batch"), "p_partkey")


@query("w16_share", "SELECT n_name, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, rank() OVER (ORDER BY count(*) DESC) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def share(x):
    by = x.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(F.broadcast(x.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return by.select("n_name", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("place"))


@query("t2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top(x):
    return x.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("t3_stride", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) SELECT c_custkey FROM r WHERE i % 7 = 0 ORDER BY i LIMIT 50")
def stride(x):
    """Every 7th row, up to 50: so the first 344 rows in order decide."""
    first = x.customer.select("c_custkey").orderBy("c_custkey").limit(7 * 49 + 1)
    return first.withColumn("i", F.row_number().over(Window.orderBy("c_custkey")) - 1).where("i % 7 = 0").select("c_custkey")


@query("t1_sorted_kinds", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS kind FROM events ORDER BY kind, event_id")
def sorted_kinds(x):
    kind = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return x.events.select("event_id", kind.alias("kind")).orderBy("kind", "event_id")


@query("flagship_star", """SELECT n_name, date_trunc('month', o_orderdate) AS month, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2""".replace("date_trunc('month', o_orderdate)", "strftime(o_orderdate, '%Y-%m')"))
def star(x):
    joined = x.lineitem.where("l_returnflag = 'R'").join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(x.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(x.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))
