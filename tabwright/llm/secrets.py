"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import text_or_empty

#: The patterns of the base kinds, in order, and the least length of what they must match.
#: (The look-ahead only names the first letters of the keywords, so that other places are passed quickly.)
ASSIGN = r"""(?=[PpSsTtAa])(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "random"]

#: Tokens the battery looks at: whole runs of these characters.
SYMBOLS = "A-Za-z0-9+/_=-"
LEAST_TOKEN = 20
TOKEN = rf"(?<![{SYMBOLS}])[{SYMBOLS}]{{{LEAST_TOKEN},}}+"
#: Lengths from which a stratum of its own begins, and how many of the corpus's words the model of words counts for.
STRATA = [24, 32, 48, 96]
MODEL_WORDS = 200
#: The model of words: per stratum the highest bin that a share of words does not exceed (-1: none). Simulated once
#: (tests/llm/secret_models.py) from some 400,000 words of the stratum's least length: independent letters of English frequencies, nine tenths of
#: the weight on lower case (alphabet 62) and one on upper case (alphabet 32). Between two bins the larger share holds.
MODEL_SHARES = [0.0001, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3]
MODEL_BINS = [
    [-1, 3, 6, 12, 22, 41, 80], [1, 6, 11, 20, 33, 61, 120], [6, 15, 22, 37, 63, 126, 252], [24, 44, 61, 92, 155, 399, 399],
    [231, 362, 399, 399, 399, 399, 399],
]
#: Tokens of letters only are read as a 26-letter alphabet, vowels against consonants. Left out as ordinary are those that
#: read like words: at most five consonants in a row and a vowel (or y) in four letters. Their model: letters of English
#: frequencies where a vowel follows a consonant with 0.54 and a vowel with 0.13; shares count the model's words that do
#: not read like words, of all. (Digits only, from 24 on, are base spans already.)
LETTER_STRATA = [24, 32, 40, 48, 64, 96]
LETTER_SHARES = [0.0001, 0.001, 0.003, 0.005, 0.006, 0.007, 0.008, 0.009, 0.01]
LETTER_BINS = [
    [0, 3, 5, 7, 8, 9, 9, 10, 11], [0, 4, 7, 9, 10, 11, 12, 13, 13], [2, 8, 13, 16, 17, 18, 19, 20, 21], [6, 15, 21, 24, 26, 27, 28, 29, 30],
    [12, 22, 30, 35, 36, 38, 40, 41, 42], [29, 45, 56, 62, 65, 67, 69, 71, 73], [81, 116, 139, 152, 157, 162, 166, 170, 173],
]
#: A stratum is numbered by its kind of token (mixed, letters) and its length.
KIND_STEP = 10
ALL_BINS = {
    kind * KIND_STEP + i: list(zip(shares, row))
    for kind, (shares, rows) in enumerate(((MODEL_SHARES, MODEL_BINS), (LETTER_SHARES, LETTER_BINS))) for i, row in enumerate(rows)
}
VOWELS = [0.0, 4.0, 8.0, 14.0, 20.0, 24.0]
FALSE_DISCOVERIES = 0.01
STEPS_PER_UNIT = 4
TOP_BIN = 400
_STEP = 128


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _before(steps: Column) -> Column:
    """Running totals before each element; sums of blocks come first, so that long arrays stay cheap."""
    n = F.size(steps)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(_STEP)).cast("int")), lambda b: _total(F.slice(steps, b * _STEP + 1, _STEP)))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    ahead = F.aggregate(sums, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all")))["all"]
    paired = F.struct(ahead.alias("ahead"), steps.alias("steps"))
    return F.element_at(F.transform(F.array(paired), lambda p: F.transform(p["steps"], lambda _, i: (
        F.element_at(p["ahead"], F.floor(i / F.lit(_STEP)).cast("int") + 1)
        + _total(F.slice(p["steps"], F.floor(i / F.lit(_STEP)).cast("int") * _STEP + 1, i % _STEP))))), 1)


def _places(df: DataFrame, pattern: str, name: str, group: int = 0) -> DataFrame:
    """Add array ``name`` of (start, end, value): leftmost non-overlapping matches, in code points."""
    raw, gap = f"_{name}_raw", f"_{name}_gap"
    df = df.withColumn(raw, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    some = F.size(raw) > 0
    df = df.withColumn(gap, F.when(some, F.split("_text", pattern, -1)))
    if group:
        df = df.withColumn(f"{raw}_value", F.when(some, F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))))
    gaps = F.transform(F.slice(gap, 1, F.size(raw)), lambda g: F.length(g).cast("bigint"))
    sizes = F.transform(raw, lambda m: F.length(m).cast("bigint"))
    df = df.withColumn(f"{gap}_n", F.when(some, gaps)).withColumn(f"{raw}_n", F.when(some, sizes))
    df = df.withColumn(f"{raw}_sum", F.when(some, F.zip_with(f"{gap}_n", f"{raw}_n", lambda a, b: a + b)))
    df = df.withColumn(f"{raw}_before", F.when(some, _before(F.col(f"{raw}_sum"))))
    whole = F.arrays_zip(
        F.col(f"{raw}_before").alias("before"), F.col(f"{gap}_n").alias("gap"), F.col(f"{raw}_n").alias("n"),
        F.col(f"{raw}_value" if group else raw).alias("value"))
    found = F.transform(whole, lambda m: F.struct(
        (m["before"] + m["gap"]).alias("start"), (m["before"] + m["gap"] + m["n"]).alias("end"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return df.withColumn(name, F.when(some, found).otherwise(empty)).drop(
        raw, gap, f"{gap}_n", f"{raw}_n", f"{raw}_sum", f"{raw}_before", f"{raw}_value")


def _two_sided(z: Column) -> Column:
    """-2 ln of the two-sided normal tail, by a logistic approximation of the normal distribution."""
    x = F.abs(z)
    odds = F.lit(1.5976) * x + F.lit(0.070565992) * x * x * x
    return F.lit(2.0) * F.when(odds > 30, odds).otherwise(F.log(F.lit(1.0) + F.exp(odds))) - F.lit(2.0) * F.log(F.lit(2.0))


def _battery(tokens: Column) -> Column:
    """(start, end, ordinary, stratum, bin) of each token; bin grows with the evidence against randomness.

    The inferred encoding sets the alphabet: hex 16, base32 32, letters and digits 62, base64 64 (padding is left
    out), letters only 26. The statistics are chi-squared of the symbol counts, runs above and below
    the median (of vowels and consonants in letters), and serial correlation; each becomes a normal deviate, and their
    two-sided p-values are combined by Fisher's sum. Tested are tokens that mix letters and digits, and letters that do
    not read like words; words of one case are ``ordinary``."""
    size = lambda a: F.size(a).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def read(t: Column) -> Column:
        value = t["value"]
        letters = value.rlike("^[A-Za-z]+$")
        vowels = F.length(F.regexp_replace(value, "(?i)[^aeiouy]", ""))
        word = ~value.rlike("(?i)[b-df-hj-np-tvwxz]{6,}") & (vowels >= 0.25 * F.length(value))
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        ordinary = word & value.rlike("^([A-Za-z]?[a-z]+|[A-Z]+)$")
        kind = F.when(mixed | ordinary, 0).when(letters & ~word, 1)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), value.alias("value"), ordinary.alias("ordinary"), kind.alias("kind"))

    kinds = F.filter(F.transform(tokens, read), lambda t: t["kind"].isNotNull())
    symbols = F.transform(kinds, lambda t: F.struct(
        *(t[c].alias(c) for c in ("start", "end", "value", "ordinary", "kind")),
        F.transform(F.filter(F.split(F.when(t["kind"] == 1, F.lower(t["value"])).otherwise(t["value"]), ""), lambda c: (c != "") & (c != "=")),
                    lambda c: F.ascii(c).cast("double") - F.when(t["kind"] == 1, 97.0).otherwise(0.0)).alias("v"),
        F.when(t["kind"] == 1, 26.0)
        .when(t["value"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(t["value"].rlike("^[A-Z2-7]+=*$"), 32.0)
        .when(t["value"].rlike("^[A-Za-z0-9]+$"), 62.0).otherwise(64.0).alias("alphabet")))
    halves = F.transform(F.filter(symbols, lambda t: F.size(t["v"]) >= LEAST_TOKEN // 2), lambda t: F.struct(
        *(t[c].alias(c) for c in ("start", "end", "ordinary", "kind", "alphabet", "v")),
        F.element_at(F.array_sort(t["v"]), F.floor(F.size(t["v"]) / F.lit(2)).cast("int") + 1).alias("median")))
    moments = F.transform(halves, lambda t: F.struct(
        *(t[c].alias(c) for c in ("start", "end", "ordinary", "kind", "alphabet", "v")), size(t["v"]).alias("n"),
        (total(t["v"]) / size(t["v"])).alias("mean"),
        F.transform(t["v"], lambda x: F.when(t["kind"] == 1, x.isin(VOWELS)).otherwise(x >= t["median"])).alias("high"),
        total(F.transform(F.transform(F.array_distinct(t["v"]), lambda s: size(F.filter(t["v"], lambda x: x == s))), lambda c: c * c)).alias("squares")))
    sums = F.transform(moments, lambda t: F.struct(
        *(t[c].alias(c) for c in ("start", "end", "alphabet", "ordinary", "kind", "n", "squares")),
        size(F.filter(t["high"], lambda x: x)).alias("high"),
        (total(F.zip_with(F.slice(t["high"], 1, F.size(t["v"]) - 1), F.slice(t["high"], 2, F.size(t["v"]) - 1),
                          lambda a, b: F.when(a != b, 1.0).otherwise(0.0))) + 1.0).alias("runs"),
        total(F.zip_with(F.slice(t["v"], 1, F.size(t["v"]) - 1), F.slice(t["v"], 2, F.size(t["v"]) - 1), lambda a, b: (a - t["mean"]) * (b - t["mean"]))).alias("serial"),
        total(F.transform(t["v"], lambda a: (a - t["mean"]) * (a - t["mean"]))).alias("spread")))

    def statistic(t: Column) -> Column:
        freedom = t["alphabet"] - 1.0
        chi = (t["squares"] * t["alphabet"] / t["n"] - t["n"] - freedom) / F.sqrt(2.0 * freedom)
        wanted = 2.0 * t["high"] * (t["n"] - t["high"]) / t["n"] + 1.0
        spread = (wanted - 1.0) * (wanted - 2.0) / (t["n"] - 1.0)
        runs = F.when(spread > 0, (t["runs"] - wanted) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(9.0)
        serial = F.when(t["spread"] > 0, (t["serial"] / F.greatest(t["spread"], F.lit(1e-9)) + 1.0 / t["n"]) * F.sqrt(t["n"])).otherwise(9.0)
        return _two_sided(F.greatest(chi, F.lit(0.0))) + _two_sided(runs) + _two_sided(serial)

    def stratum(t: Column) -> Column:
        length = t["end"] - t["start"]
        place = lambda bounds: sum(((length >= n).cast("int") for n in bounds), F.lit(0))
        return t["kind"] * KIND_STEP + F.when(t["kind"] == 1, place(LETTER_STRATA)).otherwise(place(STRATA))

    return F.transform(sums, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["ordinary"].alias("ordinary"), stratum(t).alias("stratum"),
        F.least(F.floor(statistic(t) * STEPS_PER_UNIT), F.lit(TOP_BIN)).cast("int").alias("bin")))


def _tested(docs: DataFrame) -> DataFrame:
    return _places(docs, TOKEN, "_tokens").withColumn("_tested", _battery(F.col("_tokens"))).drop("_tokens")


def _model_share(own: Column, bin_: Column) -> Column:
    """Share of the model's words of stratum ``own`` at or below a bin, rounded up."""
    shares = [F.when(own == i, F.coalesce(*(F.when(bin_ <= b, F.lit(p)) for p, b in row), F.lit(1.0))) for i, row in ALL_BINS.items()]
    return F.coalesce(*shares)


def random_limits(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per length stratum the highest bin at which a token still counts as random.

    Words (letters of one case) of the same stratum, counted over all texts, say how often ordinary tokens look that
    random, together with a fixed model that counts for ``MODEL_WORDS`` words: so a corpus without long words has
    limits too, and one with many goes by its own. Tokens of letters alone go by their fixed model. The
    Benjamini-Hochberg rule then bounds the share of false discoveries among the tested tokens of the stratum. Counts per bin are summed by Spark, and
    one number per stratum reaches the driver.
    """
    tokens = _tested(docs.select(text_or_empty().alias("_text"))).select(F.explode("_tested").alias("t")).select("t.*")
    bins = tokens.groupBy("stratum", "bin").agg(
        F.sum(F.col("ordinary").cast("bigint")).alias("words"), F.sum((~F.col("ordinary")).cast("bigint")).alias("tokens"))
    upto = Window.partitionBy("own").orderBy("bin")
    whole = Window.partitionBy("own")
    grid = bins.withColumnRenamed("stratum", "own")
    p = (F.sum("words").over(upto) + MODEL_WORDS * _model_share(F.col("own"), F.col("bin"))) / (F.sum("words").over(whole) + MODEL_WORDS)
    found = grid.withColumn("p", p).withColumn("found", F.sum("tokens").over(upto)).withColumn("m", F.sum("tokens").over(whole))
    rows = found.where((F.col("p") * F.col("m") <= F.lit(rate) * F.col("found")) & (F.col("found") > 0)).groupBy("own").agg(F.max("bin").alias("bin")).collect()
    return {r["own"]: r["bin"] for r in rows}


def secret_spans(docs: DataFrame, limits: dict[int, int]) -> DataFrame:
    """``docs`` with array ``secret_spans`` of (start, kind, end): kind numbers KINDS, positions are code points.

    Null text counts as empty and has none. A random token that overlaps a base span adds none.
    """
    d = docs.withColumn("_text", text_or_empty())
    for name, pattern, group in (("_assign", ASSIGN, 2), ("_access", ACCESS, 0), ("_hex", HEX, 0)):
        d = _places(d, pattern, name, group)
    d = d.withColumn("_assign", F.filter("_assign", lambda m: F.length(m["value"]) >= LEAST_VALUE))
    d = _tested(d)
    span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    d = d.withColumn("_base", F.concat(*(F.transform(f"_{k}", span(i)) for i, k in enumerate(KINDS[:3]))))
    random = F.filter("_tested", lambda t: ~t["ordinary"] & F.coalesce(
        t["bin"] <= F.coalesce(*(F.when(t["stratum"] == s, F.lit(b)) for s, b in limits.items()), F.lit(-1)), F.lit(False))
        & ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return d.withColumn("secret_spans", F.array_sort(F.concat("_base", F.transform(random, span(3))))).drop(
        "_text", "_assign", "_access", "_hex", "_tested", "_base")


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and secret_spans of every row; limits come from all texts of ``docs``. Other columns are ignored."""
    return secret_spans(docs.select("doc_id", "text"), random_limits(docs))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` in text; overlapping spans become one mark, null stays null."""
    found = secret_spans(docs.select(F.struct("*").alias("_row"), "text"), random_limits(docs))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<string>").alias("parts"))
    text = F.col("_row.text")
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate("secret_spans", start, lambda s, x: F.when(
        (x["start"] >= s["upto"]), F.struct(x["end"].alias("upto"), F.concat(s["parts"], F.array(cut(s["upto"], x["start"]), F.lit(mark))).alias("parts"))
    ).otherwise(F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), s["parts"].alias("parts"))))
    rows = found.withColumn("_done", F.when(F.size("secret_spans") > 0, done))
    rest = F.substring(text, (F.col("_done.upto") + 1).cast("int"), F.length(text))
    changed = F.when(F.col("_done").isNull(), text).otherwise(F.concat(F.array_join("_done.parts", ""), rest))
    return rows.select(*(changed.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
