"""Operators on small tables made by hand, against results told by the definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import code, scores, text
from tesserae.operators import curation
from tesserae.plans import catalog
from tesserae.plans.registry import Tables
from tesserae.sources import files, jsonl, lines


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


class Made(Tables):
    """Tables given by name instead of a folder."""

    def __init__(self, spark, **tables):
        self.spark, self.tables = spark, tables

    def __getattr__(self, name):
        return self.tables[name]


def test_decontamination_cases(spark):
    """A copy of an item, half of one, a shared common sentence only, and an exempt source."""
    from tesserae.plans.curating import decontaminate

    item = "The first sentence of the item. The second sentence of the item. A third one that is long enough. The fourth closes the whole item"
    half = "The first sentence of the item. The second sentence of the item. Something else that was written"
    common = "This line stands in every single item"
    items = spark.createDataFrame([(0, f"{item}. {common}"), (1, f"Quite another text of some length. {common}"), (2, f"And one more text of some length. {common}")], "item_id long, text string")
    rows = [(0, item, "src1"), (1, half, "src1"), (2, common, "src1"), (3, item, "src0"), (4, "nothing of the kind at all in this one", "src2"), (5, None, "src2"), (6, item.upper(), "src3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in decontaminate(Made(spark, documents=docs, benchmark=items)).collect()}
    assert {k: r["contaminated"] for k, r in got.items()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert got[0]["overlap"] == 1.0 and got[0]["jaccard"] == 1.0 and got[1]["overlap"] == 0.5 and got[1]["item_id"] == 0
    assert got[2]["overlap"] == 0.0 and got[3]["overlap"] == 1.0 and got[6]["equal"] is False and got[0]["shared"] == 4 and got[3]["skipped"]


def test_mix_keeps_its_shares(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("source"))
    core, repair = F.col("source").isin("g0", "g1"), F.col("source") == "g6"
    got = {r["part"]: r["count"] for r in curation.mix(rows, "source", "doc_id", core, repair, 10_000, 0.4, 0.1).groupBy("part").count().collect()}
    n_core = sum(i % 7 < 2 for i in range(1000))
    assert got == {"core": n_core, "generic": int(n_core * 0.4 / 0.6), "repair": int((n_core + int(n_core * 0.4 / 0.6)) * 0.1 / 0.9)}
    small = curation.mix(rows, "source", "doc_id", core, repair, 100, 0.4, 0.1)
    by = {r["source"]: r["count"] for r in small.where("part = 'core'").groupBy("source").count().collect()}
    assert by == {"g0": 50, "g1": 50} and small.where("part = 'generic'").count() == 0


def test_sample_takes_the_next_unique(spark):
    rows = spark.createDataFrame([(i, "a", f"v{i // 2}" if i < 6 else f"u{i}") for i in range(12)], "k long, s string, v string")
    order = [r["k"] for r in rows.orderBy(text.hash_order(0, F.col("k"))).collect()]
    want = set()
    for at in range(1, 12, 4):
        after = [order[j] for j in range(at, min(12, at + 4)) if order[j] >= 6]
        want |= set(after[:1])
    assert {r["k"] for r in curation.systematic_sample(rows, "s", "k", 4, 1, unique="v").collect()} == want


def test_lines_of_logs(spark):
    assert one(spark, text.failure_lines(F.lit("ok\r\n\tError: a \r\nPASS Error: b\x0b FAIL: c\n\tError: a")).alias("l"))["l"] == ["Error: a", "FAIL: c"]
    rows = spark.createDataFrame([("a", 0, "[turn 3] user: 12 chars"), ("a", 1, "step 5: loss=-1.5e-3"), ("a", 2, "[turn x] user: 1 chars"), ("a", 3, "")], "log string, line_no long, line string")
    assert [tuple(r) for r in lines.log_rows(rows).orderBy("kind").collect()] == [("a", 1, "step", 5, "loss", -0.0015), ("a", 0, "turn", 3, "user", 12.0)]
    found = lines.values(F.lit("a: 1\nb: 2x\na: 3%\n c: 4"), ["a", "b", "c"])
    assert tuple(one(spark, lines.number(found["a"]), lines.number(found["b"]), found["c"])) == (3.0, 2.0, None)


def test_texts(spark):
    blocks = F.lit("x\n```python\ndef f(): pass\n```\ny\n```py\nclass ModelNew: pass\n\n```\nz\n```\nlast\n```\n")
    found = text.code_block_preferring(blocks, "ModelNew")
    assert tuple(one(spark, text.last_code_block(blocks), found["code"], found["n_blocks"], text.last_code_block(F.lit("none")))) == ("last\n", "class ModelNew: pass\n", 3, None)
    assert one(spark, text.field(F.lit('{\n "a": "x",\n "p": "{\\"b\\": 2}"\n}'), "b").alias("v"))["v"].strip() == "2"
    assert [one(spark, text.exception_place(F.lit(p)).alias("p"))["p"] for p in ("a/triton/language/x", "a/triton/ops/x", "x.py")] == ["triton_compile", "triton_runtime", "python"]
    assert tuple(one(spark, files.front_matter(F.lit("---\na: 1\nb: x\n---\nrest")), files.body(F.lit("---\na: 1\n---\nrest")), files.front_matter(F.lit("rest")))) == ({"a": "1", "b": "x"}, "rest", {})


def plainly_shortened(t: str, limit: int) -> str:
    if len(t) <= limit:
        return t
    own = t.split("\n")
    size = lambda: sum(map(len, own)) + len(own) - 1
    while size() > limit:
        longest = max(own, key=len)
        if len(longest) <= 640:
            break
        at, tail = own.index(longest), 450 + max(0, max(640, len(longest) - (size() - limit)) - 640)
        own[at] = f"{longest[:150]} ...[{len(longest) - 150 - tail} chars truncated]... {longest[len(longest) - tail :]}"
    out = "\n".join(own)
    return out if len(out) <= limit + 300 else out[: limit // 2] + "\n...[truncated]...\n" + out[-(limit // 2) :]


def test_shortened(spark):
    """Step by step against the one pass, with ties between equal lines, lines at the bounds, and texts that can't fit."""
    import random

    rng = random.Random(8)
    made = ["", "a" * 1500, "a" * 1501, "\n" * 1600, *["\n".join(chr(97 + i % 26) * rng.choice([0, 5, 100, 639, 640, 641, 650, 700, 700, 900, 2000, 60_000]) for i in range(rng.randrange(1, 9))) for _ in range(300)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i long, t string")
    for limit in (1500, 2500):
        got = {r["i"]: r["s"] for r in df.select("i", text.shortened(F.col("t"), limit).alias("s")).collect()}
        assert got == {i: plainly_shortened(t, limit) for i, t in enumerate(made)}


def test_verdicts(spark):
    ok = lambda *c: F.array(*[F.struct(F.lit(a).cast("boolean").alias("ok"), F.lit(r).alias("reason")) for a, r in c])
    t, f = F.lit(True), F.lit(False)
    got = one(
        spark, scores.bench_verdict(f, ok((True, "")), F.lit(1), t), scores.bench_verdict(f, ok((False, "EXC x")), F.lit(1), t), scores.bench_verdict(f, ok((True, ""), (False, "tol")), F.lit(2), t),
        scores.bench_verdict(f, ok((True, "")), F.lit(2), t), scores.bench_verdict(t, ok((True, "")), F.lit(1), t),
    )
    assert tuple(got) == ("PASS", "CRASH", "FAIL", "FAIL", "CRASH")


def test_python_sources():
    source = 'import triton as tr\n@tr.jit\ndef k(x):\n    """doc"""\n    return tl.load(x)\ndef run(x):\n    k[(1,)](x)\n'
    assert code.check(source, "run", ["eval"], True)[1:3] == (["k"], ["k"]) and code.check(source, "run", ["eval"], True)[-1]
    assert code.check(source, "run", [], False)[1] == []
    assert code.check("def f(:", "f", [], False)[-2:] == (["syntax"], False) and code.check(None, "f", [], False)[0]
    assert code.rename("a = b.a + aa  # a\nx('a', a=a)\n", {"a": "c"}) == "c = b.a + aa  # a\nx('a', c=c)\n"
    assert code.rename("def (", {"def": "x"}) in ("def (", "x (") and code.rename(None, {}) is None
    plain, doc = code.view("def f():\n    return 1  # one\n"), code.view('def f():\n    "doc"\n    return 1\n')
    assert plain[2] == doc[2] and plain[0] == ["def f():", "return 1"]


def test_jsonl(spark, tmp_path):
    schema = jsonl.schema_of("a long, b string")
    spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2',), ("",), ("  ",)], "value string").write.text(f"{tmp_path}/in")
    rows = jsonl.read_if_there(spark, f"{tmp_path}/in", schema)
    assert [tuple(r) for r in jsonl.good(rows).collect()] == [(1, "x")] and jsonl.bad_count(rows).first()[0] == 1
    assert jsonl.read_if_there(spark, f"{tmp_path}/none", schema).count() == 0


def test_names_are_those_of_the_survey():
    """Every item has a query under its name, but for those that another item's query gives, and those that are left out."""
    counts = {"s": 10, "k": 6, "p": 11, "j": 14, "a": 31, "w": 16, "t": 6, "u": 5, "f": 38, "x": 9, "r": 8, "m": 10}
    within = {"f8": "f7", "f10": "f23", "f12": "f3", "f15": "f34", "f24": "f23", "f26": "f25", "f27": "f25", "f28": "f25", "f30": "f34", "f35": "f34", "s3": "k3", "u2": "u3", "x4": "x3"}
    left_out = {"f17", "r2", "r8"}
    names = {n.split("_")[0] for n in catalog.QUERIES}
    missing = {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)} - names
    assert missing == set(within) | left_out and set(within.values()) <= names
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_erf(spark):
    import math

    from tesserae.functions import arrays

    made = [0.0, -0.0, 1e-300, 1e-8, 0.1, -0.5, 1.0, 2.5, -4.0, 5.9, 6.0, 50.0, float("inf"), float("-inf")] + [i / 97 for i in range(-600, 600, 7)]
    for r in spark.createDataFrame([(v,) for v in made], "v double").select("v", arrays.erf(F.col("v")).alias("e")).collect():
        assert math.isclose(r["e"], math.erf(r["v"]), rel_tol=1e-12, abs_tol=0.0), r
    assert math.isnan(one(spark, arrays.erf(F.lit(float("nan"))).alias("e"))["e"])


def test_poison_rows(spark):
    """Rows that raise alone or with others; a function that returns too few; every other row has its result, in bounded tries."""
    from tesserae.operators import poison

    def halves(rows):
        if any(r["k"] % 50 == 7 for r in rows):
            raise KeyError("poison")
        return [{"half": r["k"] / 2} for r in rows][: None if all(r["k"] != 400 for r in rows) else -1]

    found = poison.guarded(spark.range(1000).withColumnRenamed("id", "k").repartition(3), ["k"], halves, "half double", 64)
    rows = found.collect()
    bad = {k for k in range(1000) if k % 50 == 7} | {400}
    assert len(rows) == 1000 and {r["k"] for r in rows if r["error"]} == bad
    assert all(r["half"] == r["k"] / 2 for r in rows if not r["error"]) and max(r["tries"] for r in rows) <= 7
    assert {r["kind"]: r["n"] for r in poison.errors_by_kind(found).collect()} == {"KeyError": 20, "ValueError": 1}
    assert poison.good(found).columns == ["k", "half"] and poison.good(found).count() == 979
    assert poison.guarded(spark.range(0).withColumnRenamed("id", "k"), ["k"], halves, "half double").count() == 0
