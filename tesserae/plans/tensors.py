"""Array maths over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import arrays, scores
from tesserae.plans.registry import query

V_SQL = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings)"


def vectors(x):
    return x.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def by_place(df, *names):
    """One row for each component, so that values compare as numbers."""
    return df.select("vec_id", F.posexplode(F.arrays_zip(*names)).alias("i", "e")).select("vec_id", F.col("i").cast("long").alias("i"), *[f"e.{n}" for n in names])


@query("x2_softmax", f"WITH {V_SQL}, s AS (SELECT vec_id, x, list_max(x) AS m FROM v), e AS (SELECT vec_id, list_transform(x, lambda e: exp(e - m)) AS e FROM s) SELECT vec_id, unnest(range(len(e))) AS i, unnest(list_transform(e, lambda y: y / list_sum(e))) AS y FROM e")
def softmax(t):
    return by_place(vectors(t).select("vec_id", arrays.softmax(F.col("x")).alias("y")), "y")


@query("x3_norms", f"""WITH {V_SQL}, s AS (SELECT vec_id, x, list_avg(x) AS m, list_var_pop(x) AS v2, list_avg(list_transform(x, lambda e: e * e)) AS ms FROM v)
SELECT vec_id, unnest(range(len(x))) AS i, unnest(list_transform(x, lambda e: (e - m) / sqrt(v2 + 1e-5))) AS layer, unnest(list_transform(x, lambda e, i: (e - m) / sqrt(v2 + 1e-5) * (i / 64.0) + 0.5)) AS affine,
  unnest(list_transform(x, lambda e: e / sqrt(ms + 1e-6))) AS rms FROM s""")
def norms(t):
    weight, bias = F.transform("x", lambda v, i: (i + 1) / 64.0), F.transform("x", lambda v: F.lit(0.5))
    found = vectors(t).select("vec_id", arrays.layernorm(F.col("x")).alias("layer"), arrays.layernorm(F.col("x"), weight, bias).alias("affine"), arrays.rmsnorm(F.col("x")).alias("rms"))
    return by_place(found, "layer", "affine", "rms")


@query("x7_cross_entropy", f"WITH {V_SQL}, s AS (SELECT x, label, list_max(x) AS m FROM v) SELECT avg(m + ln(list_sum(list_transform(x, lambda e: exp(e - m)))) - x[label + 1]) AS loss FROM s")
def cross_entropy(t):
    return vectors(t).agg(F.avg(arrays.cross_entropy(F.col("x"), F.col("label"))).alias("loss"))


@query("x8_rotary", f"""WITH {V_SQL} SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(range(64), lambda i: x[i + 1] * cos(label / power(10000.0, (i - i % 2) / 64.0)) + CASE WHEN i % 2 = 0 THEN -x[i + 2] ELSE x[i] END * sin(label / power(10000.0, (i - i % 2) / 64.0)))) AS y FROM v""")
def rotary(t):
    return by_place(vectors(t).select("vec_id", arrays.rotary(F.col("x"), F.col("label")).alias("y")), "y")


@query("x9_reductions", f"WITH {V_SQL} SELECT vec_id, list_sum(x) AS total, list_max(x) AS high FROM v")
def reductions(t):
    return vectors(t).select("vec_id", arrays.total(F.col("x")).alias("total"), F.array_max("x").alias("high"))


#: The series by the gamma function, another way than the nested one.
ERF_SQL = "exp(-e * e / 2) * list_sum(list_transform(range(0, 110), lambda n: exp((2 * n + 1) * ln(greatest(abs(e) / sqrt(2.0), 1e-300)) - lgamma(n + 1.5))))"
GELU_SQL = f"0.5 * e * (1 + sign(e) * CASE WHEN abs(e) / sqrt(2.0) >= 6 THEN 1.0 ELSE {ERF_SQL} END)"


@query("x6_gated_mlp", f"""WITH {V_SQL} SELECT vec_id, unnest(range(len(x))) AS i, unnest(list_transform(x, lambda e: e / (1 + exp(-e)) * e)) AS gated, unnest(list_transform(x, lambda e: {GELU_SQL})) AS gelu,
  unnest(list_transform(x, lambda e: greatest(e, 0) * greatest(e, 0))) AS squared FROM v""")
def mlp(t):
    found = vectors(t).select("vec_id", arrays.gated(F.col("x"), F.col("x")).alias("gated"), arrays.gelu(F.col("x")).alias("gelu"), arrays.squared_relu(F.col("x")).alias("squared"))
    return by_place(found, "gated", "gelu", "squared")


@query("x1_gram_by_label", f"""WITH {V_SQL}, e AS (SELECT label, vec_id, unnest(x) AS v, unnest(range(64)) AS k FROM v), m AS (SELECT label, k, sum(v) AS s FROM e GROUP BY ALL)
SELECT a.label AS i, b.label AS j, sum(a.s * b.s) AS product FROM m a JOIN m b USING (k) GROUP BY ALL""")
def gram(t):
    """Label sums as a matrix, times its transpose: a join on the inner index."""
    m = vectors(t).select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("s"))
    a, b = m.select(F.col("label").alias("i"), "k", F.col("s").alias("a")), m.select(F.col("label").alias("j"), "k", F.col("s").alias("b"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("product"))


@query("x5_causal_attention", f"""WITH {V_SQL}, p AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, x FROM v), s AS (SELECT q.seq, q.pos, k.x AS value, list_dot_product(q.x, k.x) / 8.0 AS s FROM p q JOIN p k ON q.seq = k.seq AND k.pos <= q.pos),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos)) AS w FROM s), e AS (SELECT seq, pos, w, unnest(range(64)) AS i, unnest(value) AS value FROM w)
SELECT seq, pos, i, sum(w * value) / sum(w) AS y FROM e GROUP BY seq, pos, i""")
def attention(t):
    """Sequences of 16 neighbours, each vector query, key and value at once; scores over the root of the length, no later place is seen."""
    p = vectors(t).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("pos"), "x")
    k = p.select("seq", F.col("pos").alias("k"), F.col("x").alias("kx"))
    s = p.join(k, "seq").where("k <= pos").select("seq", "pos", "kx", (arrays.dot(F.col("x"), F.col("kx")) / F.sqrt(F.size("x"))).alias("s"))
    w = s.withColumn("w", F.exp(F.col("s") - F.max("s").over(Window.partitionBy("seq", "pos"))))
    e = w.select("seq", "pos", "w", F.posexplode("kx").alias("i", "value"))
    return e.groupBy("seq", "pos", F.col("i").cast("long").alias("i")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("y"))


@query("f29_tolerance", f"""WITH {V_SQL}, p AS (SELECT vec_id, x AS g, list_transform(x, lambda e: e + CASE WHEN vec_id % 3 = 0 THEN 0.01 * e ELSE 0.0005 END) AS o FROM v),
z AS (SELECT vec_id, list_transform(list_zip(o, g), lambda t: abs(t[1] - t[2])) AS d, list_transform(list_zip(o, g), lambda t: abs(t[1] - t[2]) > 0.001 + 0.001 * abs(t[2])) AS bad FROM p)
SELECT vec_id, CAST(len(list_filter(bad, lambda b: b)) AS BIGINT) AS n_viol, list_max(d) AS max_abs_err, len(list_filter(bad, lambda b: b)) = 0 AS ok FROM z""")
def tolerance(t):
    o = F.transform("x", lambda e: e + F.when(F.col("vec_id") % 3 == 0, 0.01 * e).otherwise(F.lit(0.0005)))
    found = scores.tolerance_check(o, F.col("x"), F.lit(0.001), F.lit(0.001))
    return vectors(t).select("vec_id", *[found[n].alias(n) for n in ("n_viol", "max_abs_err", "ok")])


ODD_SQL = """o AS (SELECT vec_id, list_transform(x, lambda e, i: CASE WHEN vec_id % 7 = 0 AND i = 1 THEN 'inf'::DOUBLE WHEN vec_id % 7 = 1 AND i = 2 THEN 'nan'::DOUBLE WHEN vec_id % 7 = 2 AND i <= 8 THEN 0.0 ELSE e END) AS g,
  list_transform(x, lambda e, i: CASE WHEN vec_id % 7 = 0 AND i = 1 THEN CASE WHEN vec_id % 2 = 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END WHEN vec_id % 7 = 1 AND i = 2 AND vec_id % 2 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 7 = 3 AND i = 3 THEN 'nan'::DOUBLE
    WHEN vec_id % 5 = 1 AND i BETWEEN 9 AND 16 THEN 0.0 ELSE e + e * (vec_id % 11) / 1000 END) AS o FROM v),
p AS (SELECT vec_id, o, g, list_transform(list_zip(o, g), lambda t: {'o': t[1], 'g': t[2], 'of': isfinite(t[1]), 'gf': isfinite(t[2]), 'd': abs(t[1] - t[2])}) AS p FROM o),
c AS (SELECT vec_id, o, g, p, CAST(len(list_filter(p, lambda t: t.gf AND NOT t.of)) AS BIGINT) AS lost, CAST(len(list_filter(p, lambda t: NOT t.gf AND NOT (CASE WHEN isnan(t.g) THEN isnan(t.o) ELSE t.o = t.g END))) AS BIGINT) AS other,
  CAST(len(list_filter(p, lambda t: t.gf AND t.of AND t.d > 0.002 + 0.002 * abs(t.g))) AS BIGINT) AS far, CAST(len(list_filter(p, lambda t: t.gf AND t.of AND t.d > 0.005 + 0.005 * abs(t.g))) AS BIGINT) AS loose_far,
  len(list_filter(p, lambda t: isnan(t.o) <> isnan(t.g))) = 0 AS same, coalesce(list_max(list_transform(list_filter(p, lambda t: t.of AND t.gf), lambda t: t.d)), 0) AS most,
  CAST(len(list_filter(p, lambda t: NOT isnan(t.g) AND NOT (t.o = t.g OR (t.of AND t.gf AND t.d <= 0.002 + 0.002 * abs(t.g))))) AS BIGINT) AS bad, len(list_filter(p, lambda t: NOT isnan(t.g) AND NOT (t.o = t.g OR (t.of AND t.gf AND t.d <= 0.0005 + 0.0005 * abs(t.g))))) AS strict_bad FROM p)"""


@query("f29_variants", f"""WITH {V_SQL}, {ODD_SQL} SELECT vec_id, far + lost + other AS n_viol, far + lost + other = 0 AS ok, loose_far + lost + other = 0 AS loose_ok, lost AS n_nonfinite, lost = 0 AS finite_only_ok, most AS max_abs,
  same AND bad = 0 AS match, same AND strict_bad = 0 AS strict, CASE WHEN same THEN bad END AS n_bad, CASE WHEN same THEN most END AS max_diff,
  CAST(len(list_filter(range(0, len(o) // 8), lambda r: len(list_filter(list_slice(o, r * 8 + 1, r * 8 + 8), lambda e: e <> 0)) = 0 AND len(list_filter(list_slice(g, r * 8 + 1, r * 8 + 8), lambda e: e <> 0)) > 0)) AS BIGINT) AS zero_rows FROM c""")
def tolerance_variants(t):
    """Strict and loose bounds with non-finite golden values, NaN patterns, and rows of zeros, over vectors with planted faults."""
    k, inf, nan = F.col("vec_id"), F.lit(float("inf")), F.lit(float("nan"))
    golden = F.transform("x", lambda e, i: F.when((k % 7 == 0) & (i == 0), inf).when((k % 7 == 1) & (i == 1), nan).when((k % 7 == 2) & (i < 8), 0.0).otherwise(e))
    sign = F.when(k % 2 == 0, inf).otherwise(-inf)
    out = F.transform("x", lambda e, i: F.when((k % 7 == 0) & (i == 0), sign).when((k % 7 == 1) & (i == 1) & (k % 2 == 0), nan).when((k % 7 == 3) & (i == 2), nan).when((k % 5 == 1) & i.between(8, 15), 0.0).otherwise(e + e * (k % 11) / 1000))
    rows = vectors(t).select("vec_id", golden.alias("g"), out.alias("o"))
    found = scores.loose_check(F.col("o"), F.col("g"), 0.002, 0.005) | scores.pattern_check(F.col("o"), F.col("g"), 0.002, 0.0005) | {"zero_rows": scores.zero_rows(F.col("o"), F.col("g"), 8)}
    return rows.select("vec_id", *[c.alias(n) for n, c in found.items()])


@query("f31_roofline", """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 1e9 / (l_quantity * 1e-3) / 1e12 AS tflops, l_quantity * 1e6 / (l_quantity * 1e-3) / 1e9 AS gbs, l_extendedprice * 1e9 / (l_quantity * 1e6) AS intensity FROM lineitem)
SELECT l_orderkey, l_linenumber, tflops, gbs, intensity, CASE WHEN intensity < 120e12 / 300e9 THEN 'memory' ELSE 'compute' END AS bound, CASE WHEN intensity < 120e12 / 300e9 THEN 100 * gbs / 300 ELSE 100 * tflops / 120 END AS pct_peak FROM r""")
def roofline(t):
    found = scores.roofline(F.col("l_extendedprice") * 1e9, F.col("l_quantity") * 1e6, F.col("l_quantity") * 1e-3, 120.0, 300.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in found.items()])
