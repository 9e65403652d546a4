"""Making a training set: decontamination, mixing, samples, copies, the whole assembly; and a cache over a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import curation
from tesserae.plans.registry import query
from tesserae.plans.tables import BEST_MATCH_SQL, best_words
from tesserae.storage import bounded, cut
from tesserae.streaming import cache, runs


def _fill_sql(name: str, where: str, budget: str) -> str:
    """Water-filling over sources as CTEs: {name} has doc_id of the rows that are taken."""
    return f"""{name}_n AS (SELECT source AS g, count(*) AS n FROM rows WHERE {where} GROUP BY 1), {name}_b AS (SELECT {budget} AS b),
{name}_c AS (SELECT coalesce(max(c), 0) AS c FROM (SELECT c, sum(least(n, c)) AS s FROM {name}_n, range(0, coalesce((SELECT max(n) + 1 FROM {name}_n), 1)) AS r(c) GROUP BY c) WHERE s <= (SELECT b FROM {name}_b)),
{name}_t AS (SELECT g, n, least(n, c) AS take, row_number() OVER (ORDER BY n DESC, g) AS place, c FROM {name}_n, {name}_c), {name}_r AS (SELECT (SELECT b FROM {name}_b) - sum(take) AS rest FROM {name}_t),
{name}_q AS (SELECT g, take + CASE WHEN n > c AND place <= rest THEN 1 ELSE 0 END AS quota FROM {name}_t, {name}_r),
{name} AS (SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id)) AS r FROM rows WHERE {where}) d JOIN {name}_q ON g = source WHERE r <= quota)"""


CORE, REPAIR = "source IN ('src0', 'src1') AND lang <> 'es'", "lang = 'es'"
GENERIC = "source NOT IN ('src0', 'src1') AND lang <> 'es'"
MIX_SQL = f"""k AS (SELECT count(*) // 2 AS target, count(*) FILTER ({CORE}) AS nc, count(*) FILTER ({GENERIC}) AS ng, count(*) FILTER ({REPAIR}) AS nr FROM rows),
k1 AS (SELECT *, least(nc, target) AS core FROM k), k2 AS (SELECT *, least(ng, greatest(0, least(target - core, CAST(floor(core * 0.4e0 / (1 - 0.4e0)) AS BIGINT)))) AS generic FROM k1),
k3 AS (SELECT *, least(nr, CAST(floor((core + generic) * 0.1e0 / (1 - 0.1e0)) AS BIGINT)) AS repair FROM k2),
{_fill_sql("mc", CORE, "(SELECT core FROM k3)")}, {_fill_sql("mg", GENERIC, "(SELECT generic FROM k3)")}, {_fill_sql("mr", REPAIR, "(SELECT repair FROM k3)")},
mixed AS (SELECT doc_id, 'core' AS part FROM mc UNION ALL SELECT doc_id, 'generic' FROM mg UNION ALL SELECT doc_id, 'repair' FROM mr)"""


def mixed(rows):
    target = F.floor(F.col("n") / 2)
    return curation.mix(rows, "source", "doc_id", F.col("source").isin("src0", "src1"), F.col("lang") == "es", target, 0.4, 0.1)


@query("m1_mix", f"WITH rows AS (SELECT doc_id, source, lang FROM documents), {MIX_SQL} SELECT doc_id, part FROM mixed")
def mix(x):
    return mixed(x.documents.select("doc_id", "source", "lang")).select("doc_id", "part")


@query("w13_stratified_dev", """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, sha256('0:' || doc_id)) - 1 AS i, count(*) OVER (PARTITION BY sha256(text)) = 1 AS own FROM documents),
n AS (SELECT i, min(CASE WHEN own THEN i END) OVER (PARTITION BY lang ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS next FROM r)
SELECT doc_id, lang FROM r WHERE i IN (SELECT next FROM n WHERE i % 20 = 3)""")
def dev(x):
    rows = x.documents.select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return curation.systematic_sample(rows, "lang", "doc_id", 20, 3, unique="sha").select("doc_id", "lang")


@query("m2_upsample", """WITH n AS (SELECT source, least(3, CAST(ceil(150 / count(*)) AS INTEGER)) AS f FROM documents GROUP BY 1)
SELECT CASE WHEN i = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '#dup' || i END AS id FROM documents JOIN n USING (source), range(3) AS r(i) WHERE i < f""")
def upsample(x):
    """Rows of scarce sources up to three times."""
    docs = x.documents.select("doc_id", "source")
    copies = docs.groupBy("source").agg(curation.scarce_copies(F.count("*")).alias("f"))
    return curation.upsample(docs.join(F.broadcast(copies), "source"), "doc_id", F.col("f")).select("id")


#: near: half of an item's own sentences and two of them at least, or its whole text, white space and case aside.
CONTAMINATION_SQL = """cr AS (SELECT DISTINCT item_id, lower(trim(unnest(string_split(replace(text, chr(10), '. '), '. ')))) AS s FROM benchmark), cf AS (SELECT s, count(*) AS df FROM cr GROUP BY 1),
cb AS (SELECT item_id, cr.s FROM cr JOIN cf ON cf.s = cr.s WHERE length(cr.s) >= 20 AND df < greatest(2, 0.05 * (SELECT count(*) FROM benchmark))), cn AS (SELECT item_id, count(*) AS n FROM cb GROUP BY 1),
cd AS (SELECT DISTINCT doc_id, lower(trim(unnest(string_split(replace(text, chr(10), '. '), '. ')))) AS s FROM documents), dn AS (SELECT doc_id, count(*) AS nd FROM cd WHERE length(s) >= 20 GROUP BY 1),
ce AS (SELECT doc_id, item_id FROM documents d JOIN benchmark i ON lower(trim(regexp_replace(d.text, '[ \t\r\n]+', ' ', 'g'))) = lower(trim(regexp_replace(i.text, '[ \t\r\n]+', ' ', 'g')))),
cs AS (SELECT doc_id, item_id, count(*) AS shared FROM cd JOIN cb USING (s) GROUP BY ALL),
cm AS (SELECT coalesce(cs.doc_id, ce.doc_id) AS doc_id, coalesce(cs.item_id, ce.item_id) AS item_id, coalesce(shared, 0) AS shared, ce.doc_id IS NOT NULL AS equal FROM cs FULL JOIN ce ON cs.doc_id = ce.doc_id AND cs.item_id = ce.item_id),
best AS (SELECT doc_id, max(struct_pack(near := equal OR (shared / coalesce(n, 1) >= 0.5 AND shared >= 2), e := equal, o := shared / coalesce(n, 1), s := shared, k := -item_id)) AS b,
  max(CASE WHEN shared > 0 THEN struct_pack(j := shared / (n + nd - shared), k := -item_id) END) AS c FROM cm LEFT JOIN cn USING (item_id) LEFT JOIN dn USING (doc_id) GROUP BY 1)"""


def contamination(documents, benchmark, near: float = 0.5, least_shared: int = 2):
    """(doc_id, b, c) of the documents that share an own sentence or the whole text with an item: the best by nearness, equality and share, and by Jaccard similarity.

    Sentences that many items share are no item's own.  The texts are read once: sentences and the whole are elements
    of two kinds, and only those that an item has leave a document.
    """

    def elements(df, key):
        parts = F.split(F.regexp_replace("text", "\n", ". "), r"\. ")
        sentences = F.array_distinct(F.transform(parts, lambda s: F.lower(F.trim(s))))
        whole = F.lower(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")))
        kinds = F.concat(F.transform(F.filter(sentences, lambda s: F.length(s) >= 20), lambda s: F.struct(F.lit(False).alias("whole"), s.alias("s"))), F.array(F.struct(F.lit(True).alias("whole"), F.sha2(whole, 256).alias("s"))))
        # what stands beside a generator is computed for each of its rows, so the count is taken before; the array is never empty
        sized = df.select(key, kinds.alias("kinds")).select(key, (F.size("kinds") - 1).alias("nd"), "kinds")
        return sized.select(key, "nd", F.explode_outer("kinds").alias("e")).where("e IS NOT NULL").select(key, "nd", "e.*")

    items = elements(benchmark, "item_id").drop("nd").distinct()
    common = benchmark.agg(F.greatest(F.lit(2.0), 0.05 * F.count("*")).alias("least"))
    own = items.groupBy("whole", "s").agg(F.count("*").alias("df")).crossJoin(F.broadcast(common)).where("whole OR df < least").select("whole", "s")
    items = bounded(items.join(own, ["whole", "s"]))
    sizes = bounded(items.where("NOT whole").groupBy("item_id").agg(F.count("*").alias("n")))
    shared = elements(documents, "doc_id").join(items, ["whole", "s"]).groupBy("doc_id", "item_id").agg(F.count_if(~F.col("whole")).alias("shared"), F.max("whole").alias("equal"), F.max("nd").alias("nd"))
    overlap, first = F.col("shared") / F.coalesce("n", F.lit(1)), (-F.col("item_id")).alias("k")
    is_near = F.col("equal") | ((overlap >= near) & (F.col("shared") >= least_shared))
    jaccard = F.when(F.col("shared") > 0, F.struct((F.col("shared") / (F.col("n") + F.col("nd") - F.col("shared"))).alias("j"), first))
    best = shared.join(sizes, "item_id", "left").groupBy("doc_id")
    return best.agg(F.max(F.struct(is_near.alias("near"), F.col("equal").alias("e"), overlap.alias("o"), F.col("shared").alias("s"), first)).alias("b"), F.max(jaccard).alias("c"))


def _families(column: str) -> str:
    tags = ", ".join("CASE WHEN regexp_matches(" + column + ", '" + p.replace("'", "''") + f"') THEN '{t}' END" for t, p in text.FAMILY_PATTERNS)
    return f"list_filter([{tags}], lambda t: t IS NOT NULL)"


@query("m3_decontaminate", f"""WITH {CONTAMINATION_SQL}, w AS ({BEST_MATCH_SQL}), vf AS (SELECT list(DISTINCT f) AS v FROM (SELECT unnest({_families("text")}) AS f FROM benchmark))
SELECT d.doc_id, coalesce((b).near, false) AND source <> 'src0' AS contaminated, CASE WHEN source = 'src0' THEN 'exempt source' END AS skipped, coalesce((b).e, false) AS equal, -(b).k AS item_id, coalesce((b).o, 0) AS overlap, coalesce((b).s, 0) AS shared,
  -(c).k AS jaccard_item, coalesce((c).j, 0) AS jaccard, w.item_id AS words_item, w.score AS words_score, w.near AS words_near, list_sort(list_filter({_families("d.text")}, lambda f: list_contains(coalesce(v, []), f))) AS families
FROM documents d LEFT JOIN best USING (doc_id) JOIN w ON w.doc_id = d.doc_id, vf""")
def decontaminate(x):
    """Documents that hold an item or much of it; sentences that many items share don't count, one source is exempt.  Beside it what doesn't drop a document: the most similar item by words, and the families that items have too."""
    tags = lambda c: F.filter(text.families(c), lambda f: f != "other")
    known = x.benchmark.select(F.explode(tags(F.col("text"))).alias("f")).agg(F.collect_set("f").alias("known"))  # one row, of a fixed list of families
    found = x.documents.select("doc_id", "source", tags(F.col("text")).alias("own")).crossJoin(F.broadcast(known)).join(contamination(x.documents, x.benchmark), "doc_id", "left")
    words = best_words(x).select("doc_id", F.col("item_id").alias("words_item"), F.col("score").alias("words_score"), F.col("near").alias("words_near"))
    exempt = F.col("source") == "src0"
    return found.join(words, "doc_id").select(
        "doc_id", (F.coalesce("b.near", F.lit(False)) & ~exempt).alias("contaminated"), F.when(exempt, "exempt source").alias("skipped"), F.coalesce("b.e", F.lit(False)).alias("equal"), (-F.col("b.k")).alias("item_id"), F.coalesce("b.o", F.lit(0.0)).alias("overlap"), F.coalesce("b.s", F.lit(0)).alias("shared"),
        (-F.col("c.k")).alias("jaccard_item"), F.coalesce("c.j", F.lit(0.0)).alias("jaccard"), "words_item", "words_score", "words_near", F.sort_array(F.array_intersect("own", "known")).alias("families"),
    )


ASSEMBLE_SQL = f"""{CONTAMINATION_SQL}, d AS (SELECT doc_id, source, lang, text, sha256(text) AS sha, length(text) / 3.5 AS tokens, quality, coalesce((b).near, false) AND source <> 'src0' AS contaminated, length(text) - length(replace(text, chr(10), '')) AS n FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)),
g AS (SELECT *, CASE WHEN (quality = 1) = false THEN 'quality' WHEN contaminated THEN 'contaminated' WHEN contains(text, '```') THEN 'format' END AS early FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, sha ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS place FROM g),
a AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN place > 1 THEN 'duplicate' WHEN tokens > 2000 THEN 'too_long' END AS reason FROM f),
rows AS (SELECT doc_id, source, lang FROM a WHERE reason IS NULL), {MIX_SQL},
o AS (SELECT doc_id, lang, source, part, row_number() OVER (ORDER BY lang, sha256('0:' || doc_id)) - 1 AS i FROM mixed JOIN rows USING (doc_id)),
c AS (SELECT source, least(3, CAST(ceil(150 / count(*)) AS INTEGER)) AS f FROM o WHERE i % 20 <> 3 GROUP BY 1)"""


@query("m4_assemble", f"""WITH {ASSEMBLE_SQL} SELECT a.doc_id, coalesce(reason, CASE WHEN i IS NULL THEN 'mixed_out' WHEN i % 20 = 3 THEN 'dev' ELSE 'train' END) AS outcome, CASE WHEN i % 20 <> 3 THEN f ELSE CASE WHEN i IS NULL THEN 0 ELSE 1 END END AS copies,
  CASE WHEN i IS NOT NULL THEN CASE WHEN part = 'repair' THEN 'Fixed Triton ' ELSE 'Triton ' END || a.lang || CASE WHEN n > 0 THEN ' (' || n || ' @triton.jit kernel' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ')' ELSE '' END || CASE WHEN part = 'repair' THEN ' for the bench failure above' ELSE '' END || '; full file with ModelNew below.' END AS lead
FROM a LEFT JOIN o USING (doc_id) LEFT JOIN c ON c.source = o.source""")
def assemble(x):
    """Every document's way through the assembly: why it was dropped, or its split, how often it is taken and what leads it in.

    Known bad ones go, then those that hold benchmark items, those with fences, later copies (one language first), long
    ones, what the mix leaves out; of the rest every 20th is held out, and scarce sources of the others are repeated.
    What is judged and what is taken are written once each; all counts and samples read those.
    """
    d = x.documents.select(
        "doc_id", "source", "lang", F.sha2("text", 256).alias("sha"), text.token_estimate(F.col("text")).alias("tokens"), F.col("text").contains("```").alias("fenced"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n"),
    )
    held = contamination(x.documents, x.benchmark).where("b.near").select("doc_id", F.lit(True).alias("near"))
    d = cut(d.join(x.labels.select("doc_id", "quality"), "doc_id", "left").join(held, "doc_id", "left"))
    contaminated = F.coalesce("near", F.lit(False)) & (F.col("source") != "src0")
    d = d.withColumn("early", F.when((F.col("quality") == 1).eqNullSafe(False), "quality").when(contaminated, "contaminated").when(F.col("fenced"), "format"))
    order = F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), "doc_id")
    first = d.where("early IS NULL").groupBy("sha").agg(F.min(order).alias("first"))
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("doc_id") != F.col("first.doc_id"), "duplicate").when(F.col("tokens") > 2000, "too_long")
    judged = cut(d.join(first, "sha", "left").select("doc_id", "source", "lang", "n", reason.alias("reason")))
    taken = cut(mixed(judged.where("reason IS NULL").select("doc_id", "source", "lang")))
    dev = curation.systematic_sample(taken, "lang", "doc_id", 20, 3).select("doc_id", F.lit("dev").alias("split"))
    split = cut(taken.join(dev, "doc_id", "left").select("doc_id", "source", "part", F.coalesce("split", F.lit("train")).alias("split")))
    copies = split.where("split = 'train'").groupBy("source").agg(curation.scarce_copies(F.count("*")).alias("f"))
    split = split.join(bounded(copies), "source", "left").select("doc_id", "part", "split", F.when(F.col("split") == "train", F.col("f")).otherwise(1).alias("copies"))
    out = judged.join(split, "doc_id", "left")
    lead = F.when(F.col("split").isNotNull(), text.lead_in(F.col("lang"), F.col("n"), F.col("part") == "repair"))
    return out.select("doc_id", F.coalesce("reason", "split", F.lit("mixed_out")).alias("outcome"), F.coalesce("copies", F.lit(0)).alias("copies"), lead.alias("lead"))


#: A result is stored at an event if none stored before still lives.
STORED_SQL = """e AS (SELECT event_id, ts, sha256(event_type || chr(0) || props) AS key FROM events),
stored(key, ts, event_id) AS (SELECT key, min(ts), arg_min(event_id, ts) FROM e GROUP BY key UNION ALL SELECT e.key, min(e.ts), arg_min(e.event_id, e.ts) FROM stored s JOIN e ON e.key = s.key AND e.ts > s.ts + INTERVAL 7 DAY GROUP BY e.key)"""


@query("r1_cache_replies", f"WITH RECURSIVE {STORED_SQL} SELECT e.event_id, s.event_id <> e.event_id AS hit, s.event_id AS stored_id FROM e ASOF JOIN stored s ON e.key = s.key AND e.ts >= s.ts")
def cache_replies(x):
    """Each event's reply: served from the cache while the stored result lives, computed and stored otherwise."""
    return cache.replies(x.spark, x.events).select("event_id", "hit", "stored_id")


@query("r3_late_results", """WITH w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_id % 2 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events))
SELECT event_id FROM events, w WHERE event_id % 2 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) OR NOT (event_id % 2 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)) AND ts > mark""")
def late_results(x):
    """Results of a first batch, and those of a second one that don't come too late."""
    half = x.events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.unix_micros(F.col("a").cast("timestamp")) + (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 2).alias("half"))
    told = x.events.crossJoin(F.broadcast(half)).withColumn("early", (F.col("event_id") % 2 == 0) & (F.unix_micros(F.col("ts").cast("timestamp")) < F.col("half")))
    return cache.in_time(x.spark, [told.where("early"), told.where("NOT early")], "2 days").select("event_id")


@query("r4_counters", f"WITH RECURSIVE {STORED_SQL} SELECT (SELECT count(*) FROM e) AS enqueued, (SELECT count(*) FROM e) - (SELECT count(*) FROM stored) AS hits, 1 - (SELECT count(*) FROM stored) / (SELECT count(*) FROM e) AS hit_rate, (SELECT count(DISTINCT key) FROM e) AS n_keys")
def counters(x):
    return cache.counters(x.spark, cache.replies(x.spark, x.events))


@query("r5_stream_append", "SELECT event_id, user_id, value FROM events")
def stream_append(x):
    """Every event once, though half of them come twice, in files of different batches, and the stream is run again when more have come."""
    source, path, state = (runs.folder(x.spark, n) for n in ("source", "table", "state"))
    schema, rows = "event_id long, user_id long, value double", x.events.select("event_id", "user_id", "value")
    for part in (rows.where("event_id % 3 <> 0"), rows.where("event_id % 2 = 0"), rows):
        part.write.mode("append").parquet(source)
        cache.resumed(x.spark, source, schema, "event_id", path, state)
    return runs.appended(x.spark, path, schema)
