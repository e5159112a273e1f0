"""Quality rules judged by host: failures by domain, shrunk by an empirical beta prior. Native: Catalyst only.

Rules of a document: fewer than ``min_words`` words; over ``max_repeat_pct`` % of its words in 3-word windows
that the text repeats; over ``max_symbol_pct`` symbols for 100 words; over ``max_dup_line_pct`` % lines equal
to an earlier one. The first two reject the document itself. A host's rate is the share of its documents that
break any rule. Rates of small hosts say little, so each is shrunk towards the rate of all documents: the prior
Beta(a, b) has the mean of all documents, and a + b comes from the spread of host rates by moments (the
document-weighted variance between hosts less what binomial noise explains). A host loses all its documents if it is
surely worse than the corpus: if the low end of its rate (posterior mean less ``sureness`` posterior deviations; 1.645
leaves 5 %) has odds over ``odds_factor`` times those of all documents. The bar follows the corpus: hosts that are all
alike, good or bad, are judged alike by the document rules only.

Null text counts as empty (no words: rejected). Null hosts form one host. Repeated rows count each. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved

WS = "[ \\t-\\r]+"
BLANKS = " \t\n\x0b\f\r"
#: A host's verdict is copied so often, and its documents dealt over the copies.
SALTS = 32


def _words(text: Column) -> Column:
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS))


def _covered(starts: Column) -> Column:
    """Words under 3-word windows that begin at the sorted ``starts``."""
    gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def _repeated_starts(words: Column) -> Column:
    """Starts of the 3-word windows that occur twice or more: windows sorted, neighbours compared."""
    n = F.size(words)
    tail = lambda k: F.slice(words, F.lit(k + 1), n - 2)
    windows = F.arrays_zip(F.slice(words, F.lit(1), n - 2).alias("a"), tail(1).alias("b"), tail(2).alias("c"), F.sequence(F.lit(1), n - 2).alias("i"))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def starts(s: Column) -> Column:
        after = F.concat(F.slice(s, F.lit(2), n - 3), F.array(F.lit(None)))
        again = F.zip_with(s, after, lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(same(x, y), F.lit(False)).alias("eq")))
        before = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(False).alias("eq"))), F.slice(again, F.lit(1), n - 3))
        marked = F.zip_with(again, before, lambda x, y: F.when(x["eq"] | y["eq"], x["i"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    return let(F.sort_array(windows), starts)


def _n_repeat_words(words: Column) -> Column:
    n = F.size(words)
    hashes = F.zip_with(
        F.zip_with(F.slice(words, F.lit(1), n - 2), F.slice(words, F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b)),
        F.slice(words, F.lit(3), n - 2),
        lambda ab, c: F.xxhash64(ab, c),
    )
    # no hash twice means no window twice; only other texts sort their windows
    unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(n < 4, 0).when(unique, 0).otherwise(let(_repeated_starts(words), _covered)).cast("long")


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """The counts that the rules look at, one row per row of ``docs``, computed in one scan without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _n_repeat_words(words).alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        let(_words(text), counts).alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, line_counts).alias("l"),
    )
    return out.select("doc_id", "host", "w.*", "n_symbols", "l.*")


def beta_prior(failed: int, docs: int, hosts: int, weighted_squares: float) -> tuple[float, float]:
    """Mean and strength (a + b) of the prior, by moments: from all failures and documents, the number of hosts, and the
    sum over hosts of documents times squared rate."""
    if not docs:
        return 0.0, 1.0
    mean = failed / docs
    between = weighted_squares / docs - mean * mean
    noise = mean * (1 - mean) * hosts / docs  # what the binomial alone adds to it
    return mean, max(1.0, min(1e6, mean * (1 - mean) / max(between - noise, 1e-9) - 1))


def judge(
    docs: DataFrame, *, min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 20, max_dup_line_pct: int = 30,
    odds_factor: float = 3.0, sureness: float = 1.645, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, rule_failed, the host's documents, failures and
    shrunk rate, the low end of it, host_failing (whether the host is rejected), and ``kept``."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rules = base | (100 * F.col("n_symbols") > max_symbol_pct * F.col("n_words")) | (100 * F.col("n_dup_lines") > max_dup_line_pct * F.col("n_lines"))
    rows = saved(features(docs, text_col, id_col, host_col).withColumns({"base_failed": base, "rule_failed": rules}), "host-features")

    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    share, n = F.col("host_failed") / F.col("host_docs"), F.col("host_docs")
    t = hosts.agg(F.sum("host_failed").alias("f"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n * share * share).alias("npp")).first()  # one row
    mean, strength = beta_prior(t["f"] or 0, t["n"] or 0, t["k"], t["npp"] or 0.0)
    rate = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    deviation = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + F.lit(strength) + 1))
    low = F.greatest(F.lit(0.0), rate - F.lit(sureness) * deviation)
    # odds(low) > odds_factor * odds(mean), without a division that a rate of 1 would break
    failing = low * F.lit(1 - mean) > F.lit(odds_factor * mean) * (1 - low)
    verdicts = hosts.select("host", "host_docs", "host_failed", rate.alias("host_rate"), low.alias("host_low"), failing.alias("host_failing"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    v = verdicts.select(F.col("host").alias("v_host"), F.col("salt").alias("v_salt"), "host_docs", "host_failed", "host_rate", "host_low", "host_failing")
    both = dealt.join(v, F.col("host").eqNullSafe(F.col("v_host")) & (F.col("salt") == F.col("v_salt")))
    return both.select(*rows.columns, "host_docs", "host_failed", "host_rate", "host_low", "host_failing", (~F.col("base_failed") & ~F.col("host_failing")).alias("kept"))
