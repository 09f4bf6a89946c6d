"""Quality rules: word and line counts by document, and verdicts by host. DataFrame functions only.

A document fails the base rule when it has fewer than MIN_WORDS words, or when more than a fifth of its
words lie in five-word windows that the text holds twice or more. Rules beyond that one are judged by
host: failures are summed by host, each host's rate is shrunk towards the rate of all hosts with a beta
prior fitted to them, and a host whose shrunk rate passes the rule's limit is rejected with all its
documents.

Defined results: a null text has no words (and fails). A null host belongs to no host, so only the base
rule counts. Ties and repeated rows are judged row by row. An empty table gives an empty table. Columns
of the input are kept; a column of the input with the name of a result is replaced by it.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.work import let, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20

#: Rules judged by host, each a predicate over the counts, and the shrunk failure rate above which a host is rejected.
HOST_RULES: Mapping[str, tuple[str, float]] = {
    "base": ("base_failed", 0.5),
    "symbols": ("n_symbols > n_words", 0.5),
    "duplicate_lines": ("n_dup_lines > 0 and 2 * n_dup_lines > n_lines", 0.5),
    "word_length": ("n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)", 0.5),
}
#: A verdict table of so many hosts at most is broadcast (host names of ordinary length: a few MB); a larger one is joined by shuffle.
BROADCAST_HOSTS = 50_000


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more.

    Window hashes all distinct settle most texts. The others sort their windows as strings (words hold no
    space, so joining them by one is exact); a window equal to its neighbour in that order is a repeat, and
    the starts of repeats, in text order, cover least(WINDOW, gap to the next start) words each.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - WINDOW + 1), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))))
    texts = F.transform(F.slice(words, 1, F.size(words) - WINDOW + 1), lambda _, i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    same = lambda s, j, e: F.coalesce(F.get(s, j)["w"] == e["w"], F.lit(False))
    starts = let(F.sort_array(texts), lambda s: F.sort_array(F.filter(F.transform(s, lambda e, j: F.when(same(s, j - 1, e) | same(s, j + 1, e), e["i"])), lambda i: i.isNotNull())))
    covered = let(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))
    return F.when(F.size(words) <= WINDOW, 0).when(let(windows, lambda h: F.size(F.array_distinct(h)) == F.size(h)), 0).otherwise(covered)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn("__c", let(F.struct(words.alias("w"), lines.alias("l")), lambda x: counts(x["w"], x["l"])))
    out = counted.withColumns({n: F.col(f"__c.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}).drop("__c")
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def host_verdicts(counted: DataFrame, host: str = "source", rules: Mapping[str, tuple[str, float]] = HOST_RULES) -> DataFrame:
    """(host, n, rate_<rule> ..., host_ok): failure rates shrunk by a beta prior, and the verdict.

    The prior's mean is the failure rate of all documents; its strength comes from the variance of the
    hosts' rates, weighted by documents and less what sampling alone would give (method of moments).
    """
    fails = {r: F.sum(F.expr(f"cast({p} as int)")).cast("double").alias(f"f_{r}") for r, (p, _) in rules.items()}
    sums = counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *fails.values())
    sums = written(sums, "hosts")
    moments = []
    for r in rules:
        moments += [F.sum(f"f_{r}").alias(f"s_{r}"), F.sum(F.expr(f"f_{r} * f_{r} / n")).alias(f"q_{r}")]
    m = sums.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.expr("cast(n as double) * n")).alias("nn"), *moments).first()
    out, ok = sums, F.lit(True)
    for r, (_, limit) in rules.items():
        a, b = beta_prior(m["hosts"], m["n"] or 0, m["nn"] or 0.0, m[f"s_{r}"] or 0.0, m[f"q_{r}"] or 0.0)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
        ok = ok & (F.col(f"rate_{r}") <= F.lit(limit))
    return out.withColumn("host_ok", ok).select("host", "n", *(f"rate_{r}" for r in rules), "host_ok")


def beta_prior(hosts: int, n: int, nn: float, fails: float, weighted: float) -> tuple[float, float]:
    """Parameters of the prior from sums over hosts: n, n squared, failures, failures squared by n.

    With one host, or rates no more spread than sampling explains, hosts are alike and the prior is as
    strong as all documents together.
    """
    if not n:
        return 1.0, 1.0
    mean = min(max(fails / n, 1e-6), 1 - 1e-6)
    spread = weighted - n * mean * mean  # sum of n_i (rate_i - mean)^2
    scale = n - nn / n
    between = (spread - (hosts - 1) * mean * (1 - mean)) / scale if hosts > 1 and scale > 0 else 0.0
    strength = mean * (1 - mean) / between - 1 if between > 0 else float(n)
    strength = min(max(strength, 1.0), float(max(n, 1)))
    return mean * strength, (1 - mean) * strength


def judge(counted: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Adds kept: the base rule passed, and the host's verdict is not a rejection.

    Only rejected hosts are joined. Their number is checked: a small table is broadcast, a larger one is
    joined by shuffle, where adaptive execution splits a hot host.
    """
    bad = written(hosts.where(~F.col("host_ok")).select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "rejected")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = counted.join(bad, F.col(host) == F.col("__host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad")
