"""Sources and sinks: each query writes a table to the shared folder in a format and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import reports, stats
from tesserae.plans.registry import query
from tesserae.sources import files, jsonl, lines
from tesserae.storage import cut, shared_dir


def _folder(x) -> str:
    return f"{shared_dir(x.spark)}/files-{uuid.uuid4().hex}"


def _documents(x):
    return x.documents.select("doc_id", "lang", "source", "text")


DOCUMENT = "doc_id long, lang string, source string, text string"


@query("k1_jsonl_sink", "SELECT doc_id, lang, source, length(text) AS n_chars FROM documents")
def jsonl_sink(x):
    """Texts become their lengths on the way out; a second write replaces the first."""
    path = _folder(x)
    _documents(x).limit(0).write.mode("overwrite").json(path)
    x.documents.select("doc_id", "lang", "source", F.length("text").alias("n_chars")).write.mode("overwrite").json(path)
    return x.spark.read.schema("doc_id long, lang string, source string, n_chars long").json(path)


@query("s1_jsonl_scan", "SELECT doc_id, lang, source, text FROM documents")
def jsonl_scan(x):
    path = _folder(x)
    _documents(x).write.json(path)
    return jsonl.good(jsonl.read(x.spark, path, jsonl.schema_of(DOCUMENT)))


@query("s2_jsonl_tolerant", """SELECT count(*) FILTER (doc_id % 7 <> 0) AS n_good, count(*) FILTER (doc_id % 7 = 0) AS n_bad, true AS found, sum(doc_id) FILTER (doc_id % 7 <> 0) AS ids FROM documents""")
def jsonl_tolerant(x):
    """Blank lines are skipped, cut ones counted; a missing file is no error."""
    path = _folder(x)
    row = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    cut = F.when(F.col("doc_id") % 7 == 0, F.substring(row, 1, 8)).otherwise(row)
    x.documents.select(F.explode(F.array(cut, F.lit(""))).alias("value")).write.text(path)
    rows = jsonl.read_if_there(x.spark, path, jsonl.schema_of(DOCUMENT))
    none = jsonl.read_if_there(x.spark, f"{path}-missing", jsonl.schema_of(DOCUMENT))
    counts = rows.agg(F.count_if(F.col(jsonl.BAD).isNull()).alias("n_good"), F.count_if(F.col(jsonl.BAD).isNotNull()).alias("n_bad"), F.sum(F.when(F.col(jsonl.BAD).isNull(), F.col("doc_id"))).alias("ids"))
    return counts.crossJoin(none.agg((F.count("*") == 0).alias("found")))


def _logs(rows, path: str, order: list[str]) -> None:
    """Writes (log, *order, lines): a folder for each log, whose files hold its lines in order, one range of them after another."""
    dealt = rows.repartitionByRange("log", *order).sortWithinPartitions("log", *order)
    dealt.select("log", F.explode("lines").alias("value")).write.partitionBy("log").text(path)


@query("s4_glob_scan", "SELECT lang AS dir, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line_no, doc_id FROM documents")
def glob_scan(x):
    """Folder and line number of each row, over files that hold a range of the folder's rows each."""
    path = _folder(x)
    rows = x.documents.select(F.col("lang").alias("log"), "doc_id", F.array(F.to_json(F.struct("doc_id", "source"))).alias("lines"))
    _logs(rows, path, ["doc_id"])
    found = files.lines_with_paths(x.spark, f"{path}/*/*.txt")
    return found.select("dir", "line_no", F.get_json_object("line", "$.doc_id").cast("long").alias("doc_id"))


@query("s5_log_rows", """SELECT 'turns' AS log, 2 * (row_number() OVER (ORDER BY conv_id, turn) - 1) AS line_no, 'turn' AS kind, turn AS n, role AS name, CAST(length(text) AS DOUBLE) AS value FROM conversations
UNION ALL SELECT 'steps', row_number() OVER (ORDER BY event_id) - 1, 'step', event_id, event_type, value FROM events""")
def log_scan(x):
    """Rows out of two logs with their places, noise between them."""
    path, b = _folder(x), F.lit(0).cast("long")
    turns = x.conversations.select(F.lit("turns").alias("log"), F.col("conv_id").alias("a"), F.col("turn").cast("long").alias("b"), F.array(F.format_string("[turn %d] %s: %d chars", "turn", "role", F.length("text")), F.lit("saving the model")).alias("lines"))
    step = F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(": "), "event_type", F.lit("="), F.col("value").cast("string"))
    _logs(turns.unionByName(x.events.select(F.lit("steps").alias("log"), F.col("event_id").alias("a"), b.alias("b"), F.array(step).alias("lines"))), path, ["a", "b"])
    return lines.log_rows(lines.numbered(x.spark, f"{path}/*/*.txt", files.path_part(1)))


@query("a27_time_breakdown", """WITH e AS (SELECT event_id, event_type AS t, CAST((day(ts) - 1) // 7 AS VARCHAR) AS log, row_number() OVER (PARTITION BY (day(ts) - 1) // 7 ORDER BY ts, event_id) AS i, CAST(floor(value) AS BIGINT) AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT *, min(CASE WHEN t IN ('purchase', 'error') THEN i END) OVER (PARTITION BY log ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM e),
l AS (SELECT n.*, m.t AS marker, m.event_id AS step, 2 * m.s AS roll, m.k AS train FROM n LEFT JOIN e m ON m.log = n.log AND m.i = n.j WHERE n.t IN ('view', 'click')),
p AS (SELECT step, sum(s) AS gen, sum(k) AS bench, max(roll) AS roll, max(train) AS train, min(s) AS gen_low, max(s) AS gen_high, min(k) AS bench_low, max(k) AS bench_high FROM l WHERE marker = 'purchase' GROUP BY step HAVING count(*) = 4)
SELECT count(*) AS n_steps, avg(gen) AS mean_gen, avg(bench) AS mean_bench, avg(roll - gen - bench) AS mean_other, avg(train) AS mean_update, 100 * sum(gen) / CAST(sum(roll + train) AS DOUBLE) AS gen_share, 100 * sum(bench) / CAST(sum(roll + train) AS DOUBLE) AS bench_share,
  100 * sum(roll) / CAST(sum(roll + train) AS DOUBLE) AS rollout_share, min(gen_low) AS gen_low, max(gen_high) AS gen_high, min(bench_low) AS bench_low, max(bench_high) AS bench_high,
  (SELECT count(*) FROM l WHERE marker = 'error') AS n_abandoned, (SELECT count(*) FROM l WHERE marker IS NULL) AS n_unfinished FROM p""")
def time_breakdown(x):
    """Where the time of training steps goes, from a log of each week: turns belong to the step line behind them, and only steps with exactly four turns count."""
    path, clock = _folder(x), F.date_format("ts", "'['HH:mm:ss'] '")
    k, seconds = F.get_json_object("props", "$.k").cast("long"), F.floor("value")
    turn = F.format_string("turn %d: %d active, gen %ds, bench %ds, PASS %d", "user_id", "event_id", seconds, k, F.col("event_id") % 7)
    step = F.format_string("step %d/9 loss 0.1 roll %ds train %ds", "event_id", 2 * seconds, k)
    line = F.when(F.col("event_type").isin("view", "click"), F.concat(clock, turn)).when(F.col("event_type") == "purchase", F.concat(clock, step))
    line = line.when(F.col("event_type") == "error", F.concat(F.lit("resumed from step "), F.col("event_id").cast("string"))).otherwise("saving the model")
    _logs(x.events.select(F.floor((F.dayofmonth("ts") - 1) / 7).cast("string").alias("log"), "ts", "event_id", F.array(line).alias("lines")), path, ["ts", "event_id"])
    turns = cut(lines.sessions(lines.numbered(x.spark, f"{path}/*/*.txt", files.path_part(1))))
    whole = turns.where("state = 'finished'").groupBy("log", "step").agg(
        F.count("*").alias("n"), F.sum("gen").alias("gen"), F.sum("bench").alias("bench"), F.max("roll").alias("roll"), F.max("train").alias("train"),
        *[f(c).alias(f"{c}_{n}") for c in ("gen", "bench") for f, n in ((F.min, "low"), (F.max, "high"))],
    ).where("n = 4")
    all_time = F.sum(F.col("roll") + F.col("train"))
    share = lambda c: stats.ratio(100 * F.sum(c), all_time)
    found = whole.agg(
        F.count("*").alias("n_steps"), F.avg("gen").alias("mean_gen"), F.avg("bench").alias("mean_bench"), F.avg(F.col("roll") - F.col("gen") - F.col("bench")).alias("mean_other"), F.avg("train").alias("mean_update"),
        share("gen").alias("gen_share"), share("bench").alias("bench_share"), share("roll").alias("rollout_share"), F.min("gen_low").alias("gen_low"), F.max("gen_high").alias("gen_high"), F.min("bench_low").alias("bench_low"), F.max("bench_high").alias("bench_high"),
    )
    rest = turns.agg(F.count_if(F.col("state") == "abandoned").alias("n_abandoned"), F.count_if(F.col("state") == "unfinished").alias("n_unfinished"))
    return found.crossJoin(rest)  # one row each


@query("s6_key_values", """SELECT event_id, event_type AS kernel, value AS speedup, CAST(user_id AS DOUBLE) AS share, CAST(NULL AS DOUBLE) AS missing FROM events""")
def key_values(x):
    out = F.concat(F.lit("kernel: first\nspeedup: "), F.col("value").cast("string"), F.lit("x\nshare: "), F.col("user_id").cast("string"), F.lit("%\nnoise\nkernel: "), "event_type", F.lit("\n"))
    found = lines.values(F.col("out"), ["kernel", "speedup", "share", "missing"])
    kept = x.events.select("event_id", out.alias("out"))
    return kept.select("event_id", found["kernel"].alias("kernel"), *[lines.number(found[k]).alias(k) for k in ("speedup", "share", "missing")])


@query("s7_last_row", """SELECT o_orderpriority AS dir, coalesce(arg_max(o_totalprice, o_orderkey), 0) AS price, CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM orders GROUP BY 1
UNION ALL SELECT 'empty', 0, 'CRASH'""")
def last_row(x):
    """The last record of each folder's table; a folder without any crashed."""
    path = _folder(x)
    rows = x.orders.select(F.col("o_orderpriority").alias("p"), "o_orderkey", "o_totalprice", "o_orderstatus")
    rows.write.partitionBy("p").option("sep", "\t").option("header", True).csv(path)
    last = files.last_rows(x.spark, f"{path}/*/*.csv", "o_orderkey long, o_totalprice double, o_orderstatus string", "o_orderkey")
    wanted = rows.select(F.col("p").alias("dir")).distinct().unionByName(x.region.limit(1).select(F.lit("empty").alias("dir")))
    verdict = F.when(F.col("o_orderstatus").isNull(), "CRASH").when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL")
    return wanted.join(last, "dir", "left").select("dir", F.coalesce("o_totalprice", F.lit(0.0)).alias("price"), verdict.alias("verdict"))


@query("s8_json_documents", "SELECT n_nationkey AS key, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_documents(x):
    path = _folder(x)
    joined = x.nation.join(F.broadcast(x.region), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"), F.struct(F.col("r_name").alias("name")).alias("region")), {"pretty": "true"})
    joined.select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(path)
    found = files.json_documents(x.spark, f"{path}/*/*.txt", "nation struct<key:int,name:string>, region struct<name:string>")
    return found.select("nation.key", "nation.name", F.col("region.name").alias("region"))


@query("s9_folder_of_files", "SELECT r_name AS dir, 'def region():' || chr(10) || '    return ' || r_regionkey || chr(10) AS text FROM region")
def folder_of_files(x):
    path = _folder(x)
    x.region.select(F.col("r_name").alias("name"), F.format_string("def region():\n    return %d", "r_regionkey").alias("value")).write.partitionBy("name").text(path)
    return files.folder_of_texts(x.spark, f"{path}/*/*.txt")


@query("s10_front_matter", r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '---' || chr(10) || 'lang: ' || lang || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || text END AS t FROM documents),
p AS (SELECT doc_id, t, CASE WHEN starts_with(t, '---' || chr(10)) THEN strpos(substr(t, 4), chr(10) || '---' || chr(10)) ELSE 0 END AS e FROM t), h AS (SELECT doc_id, t, e, string_split(substr(t, 5, greatest(0, e - 2)), chr(10)) AS head FROM p)
SELECT doc_id, list_filter(head, lambda l: starts_with(l, 'lang: '))[1][7:] AS lang, list_filter(head, lambda l: starts_with(l, 'title: '))[1][8:] AS title, sha256(CASE WHEN e > 1 THEN substr(t, e + 8) ELSE t END) AS body, CASE WHEN e > 1 THEN len(head) ELSE 0 END AS n_keys FROM h""")
def front_matter(x):
    """Keys and body of all texts: of those that got front matter, and of those that begin as they will."""
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\ntitle: "), "source", F.lit("\n---\n"))
    made = x.documents.select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(head), "text").alias("t"))
    m = made.select("doc_id", files.front_matter(F.col("t")).alias("m"), F.sha2(files.body(F.col("t")), 256).alias("body"))
    return m.select("doc_id", F.try_element_at("m", F.lit("lang")).alias("lang"), F.try_element_at("m", F.lit("title")).alias("title"), "body", F.size("m").alias("n_keys"))


@query("k2_resumed_append", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS n_writes, CASE WHEN doc_id % 4 = 0 THEN 'corrected' WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def resumed_append(x):
    """A second run appends only what the first has not written; a third finds nothing to do; then some rows are written again.  The last write of a key wins, by the time of its file."""
    path, docs = _folder(x), x.documents.select("doc_id")
    schema = "doc_id long, run string"
    jsonl.append_new(docs.where("doc_id % 2 = 0").withColumn("run", F.lit("first")), path, "doc_id", None)
    for run in ("second", "third"):
        jsonl.append_new(docs.withColumn("run", F.lit(run)), path, "doc_id", x.spark.read.schema(schema).json(path))
    jsonl.append_new(docs.where("doc_id % 4 = 0").withColumn("run", F.lit("corrected")), path, "doc_id", None)
    written = x.spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_modification_time").alias("at"))
    return jsonl.last_write(written, "doc_id", "at").join(written.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_writes")), "doc_id").select("doc_id", "n_writes", "run")


@query("k3_parquet_splits", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def parquet_splits(x):
    path = _folder(x)
    x.documents.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train")).write.partitionBy("split").parquet(path)
    return x.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("k4_markdown_report", """SELECT 0 AS line_no, '| event_type | n | mean |' AS line UNION ALL SELECT 1, '|-|-|-|' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY event_type), '| ' || event_type || ' | ' || count(*) || ' | ' || printf('%.2f', avg(value)) || ' |' FROM events GROUP BY event_type""")
def markdown_report(x):
    """A report of a few aggregates, written as one file and read again line by line."""
    path = _folder(x)
    table = x.events.groupBy("event_type").agg(F.count("*").alias("n"), F.format_string("%.2f", F.avg("value")).alias("mean"))
    reports.markdown(table.select("event_type", F.col("n").cast("string").alias("n"), "mean"), "event_type").write.text(path)
    whole = x.spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", r"\n$", "")), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query("k6_summary_history", "SELECT run, n FROM (SELECT 'first' AS run, count(*) AS n FROM documents UNION ALL SELECT 'second', count(*) FROM labels)")
def summary_history(x):
    """Each run appends its summary; earlier ones stay."""
    path = _folder(x)
    for run, table in (("first", x.documents), ("second", x.labels)):
        table.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), "n").write.mode("append").json(path)
    return x.spark.read.schema("run string, n long").json(path)


@query("k5_html", r"""WITH h AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<table', '<div class="wide"><table', 'g'), '</table>', '</table></div>', 'g') AS wrapped FROM pages)
SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1))) AS links, CAST(len(list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+'), lambda w: w <> '')) AS BIGINT) AS n_words,
  sha256(wrapped) AS wrapped, list_transform(list_filter(string_split(html, chr(10)), lambda l: left(l, 1) IN ('+', '-')), lambda l: '<span class="' || CASE WHEN left(l, 1) = '+' THEN 'added' ELSE 'removed' END || '">' || l || '</span>') AS coloured FROM h""")
def html(x):
    """Links, words, tables in a wrapper, and lines of a diff with their colour."""
    found = reports.html_parts(F.col("html"))
    return x.pages.select("page_id", *[c.alias(n) for n, c in found.items()])
