"""Document quality rules with host verdicts, in DataFrame expressions only.

Words are runs of anything but space and the controls 0x09-0x0D. A document fails a rule by
its own counts; the failures of each host (``host`` column, null is a host too) are
aggregated, each host's failure rate is shrunk towards the mean with a beta prior fitted to
all hosts by moments, and the host's verdict goes back to its documents.

Nulls and empty texts have no words and fail ``few_words``. Rows are judged one by one, so
repeated rows and repeated ids give repeated results; other columns than those named are
left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import SPACE, WORD, materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A host is rejected where its shrunk rate of failed documents is above this.
MAX_HOST_RATE = 0.5
#: Rejected hosts that are broadcast to the documents.
MAX_BROADCAST_HOSTS = 100_000
_POSITION_BITS = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _window_hashes(words: Column) -> Column:
    n = F.size(words)
    first = F.slice(words, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(w, *(words[i + j] for j in range(1, WINDOW))))


def _repeated_positions(hashes: Column, ordered: Column, high, position) -> Column:
    """Positions of windows that have an equal one. ``ordered``: entries by hash, then position; equal upper hash bits are confirmed on the whole hash."""

    def same(a, b):
        return (high(a) == high(b)) & (hashes[position(a)] == hashes[position(b)])

    n = F.size(ordered)
    found = F.filter(ordered, lambda x, i: F.when(i > 0, same(x, ordered[i - 1])).otherwise(False) | F.when(i < n - 1, same(x, ordered[i + 1])).otherwise(False))
    return F.sort_array(F.transform(found, position))


def _covered(positions: Column) -> Column:
    """Words under windows of WINDOW words that start at these ascending positions."""
    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda s: s["n"])


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) from the whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    low = (1 << _POSITION_BITS) - 1
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    staged = documents.withColumn("__words", words_of(F.col(text))).withColumn("__lines", lines).withColumn("__hashes", _window_hashes(F.col("__words")))
    packed = F.transform("__hashes", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    pairs = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
    fits = F.size("__hashes") <= low
    staged = staged.withColumn("__packed", F.when(fits, F.sort_array(packed))).withColumn("__pairs", F.when(~fits, F.sort_array(pairs)))
    short = _repeated_positions(F.col("__hashes"), F.col("__packed"), lambda x: F.shiftright(x, _POSITION_BITS), lambda x: x.bitwiseAND(F.lit(low)))
    long = _repeated_positions(F.col("__hashes"), F.col("__pairs"), lambda x: x["h"], lambda x: x["i"])
    staged = staged.withColumn("__positions", F.coalesce(short, long))
    return staged.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _covered(F.col("__positions")),
        }
    ).drop("__words", "__lines", "__hashes", "__packed", "__pairs", "__positions")


def host_verdicts(failures: DataFrame, host: str, rules: list[str], max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: n_docs, n_docs_failed, a count by rule, prior_a, prior_b, the shrunk ``host_rate`` and ``host_kept``.

    The prior's mean is the overall rate; its strength matches the variance of the hosts'
    rates (at least 1; one host or equal rates: 100).
    """
    hosts = failures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.greatest(*(F.col(r).cast("long") for r in rules), F.lit(0).cast("long"))).alias("n_docs_failed"),
        *(F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in rules),
    )
    rate = F.col("n_docs_failed") / F.col("n_docs")
    m = hosts.agg((F.sum("n_docs_failed") / F.sum("n_docs")).alias("mean"), F.var_samp(rate).alias("var")).first()  # two numbers
    mean = m["mean"] or 0.0
    strength = max(mean * (1 - mean) / m["var"] - 1, 1.0) if m["var"] else 100.0
    a, b = mean * strength, (1 - mean) * strength
    shrunk = (F.col("n_docs_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.withColumns({"prior_a": F.lit(a), "prior_b": F.lit(b), "host_rate": shrunk, "host_kept": shrunk <= max_rate})


def judge(documents: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, host, the counts of measure(), few_words, repetitive, base_failed, host_rate and kept."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = measure(source).drop("text")
    few = F.col("n_words") < MIN_WORDS
    repetitive = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    counted = counted.withColumn("few_words", few).withColumn("repetitive", repetitive).withColumn("base_failed", F.col("few_words") | F.col("repetitive"))
    counted = materialize(counted)
    verdicts = host_verdicts(counted, "host", ["few_words", "repetitive"]).select(F.col("host").alias("__host"), "host_rate", "host_kept")
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))
    return joined.withColumn("kept", kept).drop("__host", "host_kept")


def keep(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that pass the rules and whose host is not rejected, with all their columns."""
    columns = documents.columns
    row = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(text).alias("__text"), F.col(host).alias("__host"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counted = materialize(measure(row, "__text").select("__row", "__host", failed.alias("__failed")))
    rejected = materialize(host_verdicts(counted.select("__host", "__failed"), "__host", ["__failed"]).where("not host_kept").select(F.col("__host").alias("__bad_host")))
    n_rejected = rejected.count()
    passed = counted.where("not __failed")
    if not n_rejected:
        return passed.select("__row.*")
    if n_rejected <= MAX_BROADCAST_HOSTS:  # else the texts are dealt by host
        rejected = F.broadcast(rejected)
    return passed.join(rejected, F.col("__host").eqNullSafe(F.col("__bad_host")), "left_anti").select("__row.*")
