"""Text columns: code blocks, failure lines, categories, families, templates, hashes."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a line of a log as a reason of failure.
FAIL_MARKS = ["FAIL:", "FAIL --", "Trial ", "exceeds tol", "Error:", "Error ", "OutOfResources", "error:", "FATAL", "illegal memory", "WARNING: bench"]

#: Families by pattern, and the order in which one is chosen as primary.
FAMILY_PATTERNS = [
    ("softmax", r"softmax|Softmax"),
    ("layernorm", r"layer_norm|LayerNorm|layernorm|Layernorm"),
    ("rmsnorm", r"rms_norm|RMSNorm|RmsNorm|rmsnorm|\brms\b"),
    ("cross_entropy", r"cross_entropy|CrossEntropy|nll_loss|NLLLoss|log_softmax.*gather"),
    ("rotary", r"rotary|Rotary|\brope\b|RoPE|apply_rotary|rotate_half"),
    ("attention", r"[Aa]ttention|scaled_dot_product|MultiheadAttention|\battn\b"),
    ("mlp", r"\bMLP\b|Mlp|FeedForward|FeedFoward|FFN|\bmlp\b|SwiGLU|GEGLU|GLU\b"),
    ("matmul", r"torch\.matmul|torch\.mm\b|torch\.bmm|\.matmul\(|\.mm\(|\.bmm\(|\s@\s|nn\.Linear|F\.linear|einsum"),
    ("conv", r"[Cc]onv[123]d|conv_transpose|ConvTranspose|F\.conv"),
    ("reduce", r"torch\.(sum|mean|amax|amin|prod|logsumexp|var|std|norm|max|min)\(|\.(sum|mean|amax|amin|prod|logsumexp|var|std|norm)\("),
    ("activation", r"relu|ReLU|gelu|GELU|silu|SiLU|sigmoid|Sigmoid|tanh|Tanh|\belu\b|ELU|leaky|Leaky|softplus|Softplus|hardswish|Hardswish|mish|Mish|swish|Swish|hardtanh|Hardtanh|selu|SELU|celu|CELU"),
]
#: The second table, for sources without comments; the mlp family has a rule of its own.
SECOND_PATTERNS = [
    ("softmax", r"softmax|Softmax"),
    ("layernorm", r"layer_norm|LayerNorm"),
    ("rmsnorm", r"rms_norm|RMSNorm|RmsNorm|\brms\b|rsqrt\([^\n]*pow\(2\)[^\n]*mean|pow\(2\)\.mean\([^\n]*rsqrt"),
    ("cross_entropy", r"cross_entropy|CrossEntropyLoss|nll_loss|NLLLoss"),
    ("rotary", r"rotary|Rotary|\brope\b|RoPE|rotate_half|freqs_cis|apply_rotary"),
    ("attention", r"scaled_dot_product_attention|MultiheadAttention|[Aa]ttention|\battn\b"),
    ("matmul", r"matmul|\bmm\(|\bbmm\(|einsum|nn\.Linear|\bLinear\(|F\.linear|addmm|baddbmm|\S\s*@\s*\S"),
    ("activation", r"relu|ReLU|gelu|GELU|silu|SiLU|sigmoid|Sigmoid|tanh|Tanh|swish|mish|Mish|\belu\b|ELU|hardswish|Hardswish|softplus|Softplus|hardtanh|Hardtanh|selu|SELU|\bglu\b|GLU|hardsigmoid|Hardsigmoid"),
    ("conv", r"conv[123]d|Conv[123]d|conv_transpose|ConvTranspose"),
    ("reduce", r"\.(sum|mean|amax|amin|max|min|prod|argmax|argmin|norm|var|std|logsumexp|cumsum|cumprod|all|any)\(|torch\.(sum|mean|amax|amin|max|min|prod|argmax|argmin|norm|var|std|logsumexp|cumsum|cumprod)\("),
]
#: Every match of a family's pattern, in either table or by name of an mlp, holds one of these.  Looking for them is far cheaper than the patterns, which then are only tried where one is found.
FAMILY_STEMS = {
    "softmax": ["oftmax"],
    "layernorm": ["ayer_norm", "ayerNorm", "ayernorm"],
    "rmsnorm": ["rms", "RMSNorm", "RmsNorm", "rsqrt"],
    "cross_entropy": ["cross_entropy", "CrossEntropy", "nll_loss", "NLLLoss", "log_softmax"],
    "rotary": ["otary", "rope", "RoPE", "rotate_half", "freqs_cis"],
    "attention": ["ttention", "scaled_dot_product", "attn"],
    "mlp": ["MLP", "Mlp", "mlp", "orward", "oward", "FFN", "ffn", "GLU", "_proj"],
    "matmul": ["@", "matmul", "mm(", ".mm", ".bmm", "addmm", "addbmm", "Linear", "F.linear", "einsum"],
    "conv": ["onv1d", "onv2d", "onv3d", "onv_transpose", "onvTranspose", "F.conv"],
    "reduce": ["("],
    "activation": ["elu", "eLU", "ELU", "silu", "SiLU", "igmoid", "tanh", "Tanh", "eaky", "oftplus", "wish", "mish", "Mish", "glu", "GLU"],
}
MLP_NAME = r"\bmlp\b|MLP|[Ff]eed[_]?[Ff]orward|\bffn\b|FFN|gate_proj|up_proj|down_proj"
LINEAR_CALL = r"nn\.Linear\(|\bLinear\(|F\.linear\("
FAMILY_ORDER = ["rotary", "attention", "mlp", "matmul", "cross_entropy", "rmsnorm", "layernorm", "softmax", "reduce", "activation", "conv", "other"]


def once(value: Column, told: Callable[[Column], Column]) -> Column:
    """What `told` makes of a value that is computed once, however often it is used; in a lambda, where it would be computed for each element."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def last_code_block(text: Column, tags: str = "python|py", spaces: str = r"\s*") -> Column:
    """The last fenced block, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```(?:{tags})?{spaces}\n(.*?)```"), 1), F.lit(-1))


def code_block_preferring(text: Column, needle: str) -> dict[str, Column]:
    """The last block that holds `needle`, else the last, without outer line feeds, one behind it; and how many blocks there are."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py|Python)?[ \t]*\n(.*?)```"), 1)
    chosen = F.coalesce(F.try_element_at(F.filter(blocks, lambda b: b.contains(needle)), F.lit(-1)), F.try_element_at(blocks, F.lit(-1)))
    return {"code": F.concat(F.regexp_replace(chosen, r"^\n+|\n+$", ""), F.lit("\n")), "n_blocks": F.size(blocks).cast("long")}


def failure_lines(log: Column, most: int = 12, width: int = 300) -> Column:
    """Stripped lines with a mark and no PASS in front, each once, in order."""
    marks = [lambda s, m=m: s.contains(m) for m in FAIL_MARKS]

    def keep(s):
        hit = marks[0](s)
        for m in marks[1:]:
            hit = hit | m(s)
        return (s != "") & hit & ~F.substring(s, 1, 6).contains("PASS")

    # all line ends and all white space, as Python's splitlines and strip take them
    lines = F.filter(F.transform(F.split(log, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda s: F.regexp_replace(s, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")), keep)
    return F.transform(F.slice(F.array_distinct(lines), 1, most), lambda s: F.substring(s, 1, width))


def failure_category(verdict: Column, log: Column, smoke: Column, stability: Column) -> Column:
    """The first of twelve that applies; null for a pass."""
    has = log.contains
    low = F.lower(log)
    return (
        F.when(verdict == "PASS", None)
        .when(has("no ```python"), "no code block")
        .when(verdict == "TIMEOUT", "timeout")
        .when(has("instantiation failed"), "wrong ModelNew signature")
        .when(has("OutOfResources") | has("shared memory"), "out of shared memory")
        .when(has("CompilationError") | (low.contains("triton") & has("Error")), "Triton API / compile error")
        .when(has("exceeds tol") | has("max_abs_error"), "numerical mismatch")
        .when(has("numerical_stability") | low.contains("nan") | F.coalesce(stability.startswith("FAIL"), F.lit(False)), "numerical stability")
        .when(F.coalesce(smoke.startswith("FAIL"), F.lit(False)), "smoke test mismatch")
        .when(has("SyntaxError") | has("IndentationError"), "syntax error")
        .when(has("AttributeError") | has("NameError") | has("ImportError"), "API/name error")
        .when(low.contains("illegal memory") | has("CUDA error"), "illegal memory access")
        .otherwise("other FAIL/CRASH")
    )


def outcome_category(code: Column, verdict: Column, reason: Column, reasons: Column, exc_type: Column, exc_where: Column) -> Column:
    """One of ten: the first class whose condition holds."""
    said = lambda c: F.coalesce(c, F.lit(""))
    why, notes, raised, place = said(reason), said(reasons), said(exc_type), said(exc_where)
    any_of = lambda c, *marks: F.lit(False) if not marks else c.contains(marks[0]) | any_of(c, *marks[1:])
    crashed, late = verdict == "CRASH", notes.contains("EXC ")
    classes = [
        ("format", F.trim(said(code)) == ""),
        ("pass", verdict == "PASS"),
        ("timeout", (verdict == "TIMEOUT") | notes.contains("TIMEOUT")),
        ("infra", verdict == "INFRA_ERROR"),
        ("python", crashed & why.startswith("import:")),
        ("runtime_resources", crashed & ((raised == "OutOfResources") | any_of(why, "OutOfResources"))),
        ("runtime", crashed & any_of(why, "fatal CUDA", "illegal memory", "CUDA error")),
        ("compile", crashed & ((raised == "CompilationError") | (place == "triton_compile"))),
        ("python", crashed),
        ("no_triton", any_of(notes, "no Triton kernel launched")),
        ("runtime_resources", late & any_of(notes, "OutOfResources")),
        ("compile", late & any_of(notes, "CompilationError")),
        ("runtime", late & any_of(notes, "CUDA error", "illegal memory")),
        ("python", late),
    ]
    return F.coalesce(*[F.when(condition, name) for name, condition in classes], F.lit("numerics"))


def normal_message(category: Column, message: Column) -> Column:
    """Category, and the message's end without its numbers; numerics and passes are their category."""
    cut = F.element_at(F.split(message, r" \[\.\.\.\] "), -1)
    return F.when(category.isin("numerics", "pass"), category).otherwise(F.concat(category, F.lit("|"), F.right(F.regexp_replace(cut, r"\d+", "N"), F.lit(200))))


def holds_family(source: Column, family: str, pattern: str) -> Column:
    """Whether the pattern is found; one of the fixed tables only where a stem is."""
    if (family, pattern) not in [*FAMILY_PATTERNS, *SECOND_PATTERNS, ("mlp", MLP_NAME)]:
        return source.rlike(pattern)
    stems = [source.contains(stem) for stem in FAMILY_STEMS[family]]
    return reduce(operator.or_, stems) & source.rlike(pattern)


def _tags(source: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(holds_family(source, t, p), t) for t, p in patterns]))


def families(source: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """All families whose pattern is found, or `other`."""
    tags = once(source, lambda source: _tags(source, patterns or FAMILY_PATTERNS))
    return once(tags, lambda tags: F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags))


def source_families(source: Column) -> Column:
    """By the second table, over a source without comments and docstrings; an mlp by its name, or by two linear layers and an activation."""

    def told(plain: Column) -> Column:
        linear = plain.contains("inear(") & (F.size(F.regexp_extract_all(plain, F.lit(LINEAR_CALL), 0)) >= 2)
        mlp = lambda tags: holds_family(plain, "mlp", MLP_NAME) | (F.array_contains(tags, "activation") & linear)
        found = once(_tags(plain, SECOND_PATTERNS), lambda tags: F.when(mlp(tags), F.array_append(tags, "mlp")).otherwise(tags))
        return once(found, lambda tags: F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags))

    return once(strip_comments(source), told)


def primary_family(tags: Column, order: list[str] | None = None) -> Column:
    wanted = F.array(*[F.lit(x) for x in order or FAMILY_ORDER])
    return F.coalesce(F.try_element_at(F.array_intersect(wanted, tags), F.lit(1)), F.lit("other"))


def strip_comments(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source, r"(?s)(\"\"\"|''')(.*?)\1", ""), r"#[^\n]*", "")


def head_tail(text: Column, most: int = 800, head: int = 300) -> Column:
    """A text over `most` characters keeps its head and its tail."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(most - head - 5)))).otherwise(text)


#: What a shortened line keeps of its head and its tail, and the length from which on lines are shortened.
LINE_HEAD, LINE_TAIL, LONG_LINE = 150, 450, 640


def shortened(text: Column, limit: int = 1500) -> Column:
    """A text over `limit` characters, its longest lines cut in the middle until it fits; its head and tail where that isn't enough.

    Longest lines go first, of equal ones the first.  Each but the last gives all it can, so what a line has to give is
    the excess less the sum over the longer ones: one pass over the long lines in that order tells the last line that
    is cut and its tail.  A line is cut if it doesn't come behind that one.
    """
    marker = lambda cut: F.concat(F.lit(" ...["), cut.cast("string"), F.lit(" chars truncated]... "))
    # behind no line: none is cut
    start = F.struct((F.length(text) - limit).alias("excess"), F.lit(-(1 << 31)).cast("int").alias("less"), F.lit(0).alias("i"), F.lit(0).alias("tail"))

    def take(state, x):
        size = -x["less"]
        kept = F.lit(LINE_TAIL) + F.greatest(F.lit(0), size - state["excess"] - LONG_LINE)
        cut = size - LINE_HEAD - kept
        taken = F.struct((state["excess"] - cut + F.length(marker(cut))).alias("excess"), x["less"].alias("less"), x["i"].alias("i"), kept.alias("tail"))
        return F.when(state["excess"] > 0, taken).otherwise(state)

    def last_cut(lines):
        long = F.filter(F.transform(lines, lambda line, i: F.struct((-F.length(line)).alias("less"), i.alias("i"))), lambda x: -x["less"] > LONG_LINE)
        return F.aggregate(F.array_sort(long), start, take)

    def short(line, i, last):
        less = -F.length(line)
        is_last = (less == last["less"]) & (i == last["i"])
        kept = F.when(is_last, last["tail"]).otherwise(LINE_TAIL)
        goes = (-less > LONG_LINE) & ((less < last["less"]) | ((less == last["less"]) & (i <= last["i"])))
        return F.when(goes, F.concat(F.substring(line, 1, LINE_HEAD), marker(F.length(line) - LINE_HEAD - kept), F.right(line, kept))).otherwise(line)

    joined = once(F.split(text, "\n"), lambda lines: once(last_cut(lines), lambda last: F.array_join(F.transform(lines, lambda line, i: short(line, i, last)), "\n")))
    ends = lambda out: F.concat(F.substring(out, 1, limit // 2), F.lit("\n...[truncated]...\n"), F.right(out, F.lit(limit // 2)))
    return F.when(F.length(text) <= limit, text).otherwise(once(joined, lambda out: F.when(F.length(out) > limit + 300, ends(out)).otherwise(out)))


def kernel_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(r"(?m)^\s*@triton\.jit")).cast("long")


def lead_in(label: Column, n: Column, fixed: Column) -> Column:
    kernels = F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(" @triton.jit kernel"), F.when(n != 1, "s").otherwise(""), F.lit(")"))).otherwise("")
    return F.concat(F.when(fixed, "Fixed Triton ").otherwise("Triton "), label, kernels, F.when(fixed, " for the bench failure above").otherwise(""), F.lit("; full file with ModelNew below."))


def token_estimate(text: Column) -> Column:
    """Characters over 3.5."""
    return F.length(text) / F.lit(3.5)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a NUL between."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def stable_int(text: Column) -> Column:
    """48 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def hash_order(seed: int, key: Column) -> Column:
    """A deterministic order in place of a seeded shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def field(text: Column, name: str) -> Column:
    """The first top-level `"name": value` line, else the one in a nested payload."""
    pattern = rf'(?m)^\s*"{name}":\s*"?([^",\n]*)"?,?\s*$'
    nested = rf'\\"{name}\\":\s*(?:\\")?([^,\\}}]*)'
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(text, nested, 1), F.lit("")))


def exception_place(trace: Column) -> Column:
    """Where a trace ended: in the compiler or its language, elsewhere in the library, or in Python."""
    compiled = trace.contains("/triton/compiler/") | trace.contains("/triton/language/")
    return F.when(compiled, "triton_compile").when(trace.contains("/triton/"), "triton_runtime").otherwise("python")


def exception_text(message: Column, head: int = 300, tail: int = 600) -> Column:
    """A long message keeps its head and its tail."""
    return F.when(F.length(message) > head + tail, F.concat(F.substring(message, 1, head), F.lit(" [...] "), F.right(message, F.lit(tail)))).otherwise(message)
