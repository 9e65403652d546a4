"""Work on a text grows with its length: what its lines or sentences share is computed once."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.plans import curating, tables
from tesserae.plans.registry import Tables
from tests.test_small import plainly_shortened


def test_shortening_of_many_lines(spark):
    made = "\n".join(f"{i} " + "x" * (700 if i % 40 == 0 else 5) for i in range(12_000))
    df = spark.createDataFrame([(made,)], "t string").select(text.shortened(F.col("t"), 200_000).alias("s"))
    began = time.time()
    assert df.first()["s"] == plainly_shortened(made, 200_000) != made
    assert time.time() - began < 15


def above_generator(df) -> str:
    """The plan of what is computed for each row that the documents' generator makes."""
    return df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]


def test_sentences_are_split_before_they_are_rows(spark, sf_dir):
    assert "regexp_replace" not in above_generator(tables.containment(Tables(spark, sf_dir)))


def test_decontamination_sizes_come_before_rows(spark, sf_dir):
    x = Tables(spark, sf_dir)
    assert "regexp_replace" not in above_generator(curating.contamination(x.documents, x.benchmark)).split("Generate")[0]


#: Words that the patterns of families find, each once or more.
FAMILY_WORDS = """softmax Softmax layer_norm LayerNorm layernorm Layernorm rms_norm RMSNorm RmsNorm rmsnorm rms rsqrt(x.pow(2).mean pow(2).mean(x)rsqrt cross_entropy CrossEntropy CrossEntropyLoss nll_loss NLLLoss log_softmax(x).gather
rotary Rotary rope RoPE apply_rotary rotate_half freqs_cis attention Attention scaled_dot_product scaled_dot_product_attention MultiheadAttention attn MLP Mlp FeedForward FeedFoward FFN mlp SwiGLU GEGLU GLU feedforward feed_forward Feed_Forward ffn gate_proj up_proj down_proj
torch.matmul torch.mm torch.bmm x.matmul( x.mm( x.bmm( nn.Linear F.linear einsum matmul mm( bmm( Linear( addmm baddbmm a@b conv1d Conv2d conv3d conv_transpose ConvTranspose F.conv torch.sum( x.mean( x.argmax( torch.cumsum( x.all(
relu ReLU gelu GELU silu SiLU sigmoid Sigmoid tanh Tanh elu ELU leaky Leaky softplus Softplus hardswish Hardswish mish Mish swish Swish hardtanh Hardtanh selu SELU celu CELU glu hardsigmoid Hardsigmoid""".split() + ["a @ b", "a\n@ b"]


def test_stems_of_families(spark):
    """Where a pattern is found, a stem is: of the words, each alone and two together."""
    tables_ = [*text.FAMILY_PATTERNS, *text.SECOND_PATTERNS, ("mlp", text.MLP_NAME)]
    made = [*FAMILY_WORDS, *[f"{a}_x {b}" for a, b in zip(FAMILY_WORDS, FAMILY_WORDS[7:], strict=False)], "nothing", ""]
    rows = spark.createDataFrame(list(enumerate(made)), "i long, t string")
    both = rows.select("t", *[F.struct(F.col("t").rlike(p).alias("plain"), text.holds_family(F.col("t"), n, p).alias("stem")).alias(f"c{i}") for i, (n, p) in enumerate(tables_)]).collect()
    for i, (name, pattern) in enumerate(tables_):
        assert all(r[f"c{i}"]["plain"] == r[f"c{i}"]["stem"] for r in both) and any(r[f"c{i}"]["plain"] for r in both), (name, pattern)
    assert rows.select(text.holds_family(F.col("t"), "softmax", "noth").alias("h")).where("h").count() == 1  # no stems for other patterns


def test_families_are_looked_for_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(text.families(F.col("t")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("softmax|Softmax") <= 1
