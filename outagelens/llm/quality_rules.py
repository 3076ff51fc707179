"""Quality rules: a decision list learned by sequential covering, emitted as an ordered conditional expression."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import SPACES, let, stored, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: The base rules: fewer words, or a larger share (in percent) of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Labelled rows that a list is learned from: the first by hashed id. Rules count on all of them.
LEARN_ROWS = 20_000
#: Candidate thresholds for each feature and class.
CUTS = 12
MOST_RULES, MOST_LITERALS = 12, 4
#: A rule stays if it is right so often on the pruning rows, and covers so many growing rows.
LEAST_PRECISION, LEAST_COVER = 0.9, 5

FEATURES = ("n_words", "word_length", "symbol_share", "capital_share", "dup_lines", "repeat_share", "distinct_share")


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text, all long; zeros for null or empty text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier one),
    n_repeat_words (words in 5-word windows found twice or more in the text, first included), n_distinct, n_capitals.
    Windows are compared by 64-bit hashes of their words' 64-bit hashes, within one text.
    """
    text = F.coalesce(text, F.lit(""))
    without = lambda dropped: F.length(F.translate(text, dropped, ""))
    worded = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counted = let(words_of(text), lambda words: F.struct(
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        _repeated(words).alias("n_repeat_words")))
    values = {
        "word_chars": without(SPACES), "n_symbols": F.length(text) - without(SYMBOLS),
        "n_capitals": F.length(text) - without(CAPITALS),
        "n_dup_lines": let(worded, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
    }
    longs = [v.cast("long").alias(k) for k, v in values.items()]
    return let(counted, lambda c: F.struct(
        *[c[k].cast("long").alias(k) for k in ("n_words", "n_distinct", "n_repeat_words")], *longs))


def _repeated(words: Column) -> Column:
    """How many words lie in a window that the text holds twice or more."""
    def windows(hashes):
        last = F.size(hashes) - WINDOW
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    def covered(found):
        ordered = F.sort_array(F.transform(found, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))
        twice = let(ordered, lambda s: F.filter(
            s, lambda x, i: (F.get(s, i - 1)["key"] == x["key"]) | (F.get(s, i + 1)["key"] == x["key"])))
        places = F.sort_array(F.transform(twice, lambda x: x["at"]))
        start = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda acc, at: F.struct(
            (acc["words"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("words"), at.alias("last")), lambda acc: acc["words"])

    def of(found):
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), of)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


def feature(stats: Column, name: str) -> Column:
    """A statistic that rules may bound, as a double; shares of texts without words are 0."""
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return {
        "n_words": stats["n_words"].cast("double"),
        "word_length": share(stats["word_chars"], stats["n_words"]),
        "symbol_share": share(stats["n_symbols"], stats["word_chars"]),
        "capital_share": share(stats["n_capitals"], stats["word_chars"]),
        "dup_lines": stats["n_dup_lines"].cast("double"),
        "repeat_share": share(stats["n_repeat_words"], stats["n_words"]),
        "distinct_share": share(stats["n_distinct"], stats["n_words"]),
    }[name]


@dataclass(frozen=True)
class Literal:
    """A bound on one feature: above the threshold, or up to it."""
    name: str
    above: bool
    threshold: float

    def holds(self, stats: Column) -> Column:
        value = feature(stats, self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def matches(rule: Rule, stats: Column) -> Column:
    held = F.lit(True)
    for literal in rule:
        held = held & literal.holds(stats)
    return held


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The decision list as one conditional: the number of the first rule that rejects, from 1; 0 where none does."""
    chain = F
    for number, rule in enumerate(rules, 1):
        chain = chain.when(matches(rule, stats), F.lit(number))
    return chain.otherwise(F.lit(0)) if rules else F.lit(0)


def learning_rows(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """stats, bad (quality is 0) and grow (two thirds, by hashed id) of `rows` labelled documents, stored.

    Only ids that docs has are chosen. They are at most `rows`, a proven bound, so they are broadcast: no text is shuffled.
    """
    graded = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    there = graded.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(found.select(
        statistics(F.col("text")).alias("stats"), (F.col("quality") == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).alias("grow")), "learning")


def thresholds(sample: DataFrame) -> dict[str, list[float]]:
    """For each feature, the quantiles of the bad and of the good rows: CUTS of each class, sorted."""
    at = [(k + 0.5) / CUTS for k in range(CUTS)]
    row = sample.filter("grow").agg(*[
        F.percentile_approx(F.when(F.col("bad") == bad, feature(F.col("stats"), name)), at, 10_000).alias(f"{name}_{bad}")
        for name in FEATURES for bad in (True, False)]).first()
    return {name: sorted({v for bad in (True, False) for v in row[f"{name}_{bad}"] or []}) for name in FEATURES}


def learn(sample: DataFrame) -> list[Rule]:
    """The rules that reject, in order, by sequential covering.

    A rule grows on the growing rows that no earlier rule covers: the literal with the largest FOIL gain is added
    until no good row is covered or none gains. It is pruned on the other rows to the prefix with the best
    (bad - good) / (bad + good). Learning ends when a pruned rule falls short, or no bad row is left. Each step is
    one aggregation: rows by feature and threshold, a table whose size does not depend on the rows.
    No labelled rows, or rows of one class only: no rules.
    """
    cuts = thresholds(sample)
    binned = stored(sample.withColumn("bins", F.array(*[_bin(name, cuts[name]) for name in FEATURES])), "binned")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = binned.filter(verdict(rules, F.col("stats")) == 0)
        rule = _pruned(_grown(left.filter("grow"), cuts), left.filter(~F.col("grow")))
        if rule is None:
            break
        rules.append(rule)
    return rules


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the thresholds the feature exceeds."""
    value = feature(F.col("stats"), name)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda cut: value > cut))


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_LITERALS:
        held = rows.filter(matches(rule, F.col("stats")))
        counts = held.select("bad", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
            F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        literal = _best(counts, cuts)
        if literal is None:
            break
        rule += (literal,)
    return rule


def _best(counts, cuts) -> Literal | None:
    """The literal with the largest gain over the rows that `counts` (feature, bin, bad, good) sums up."""
    best, most = None, 1e-9
    for at, name in enumerate(FEATURES):
        own = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["feature"] == at}
        bad, good = (sum(v[k] for v in own.values()) for k in (0, 1))
        if not bad or not good:
            return None
        under = [0, 0]
        for number, cut in enumerate(cuts[name]):
            under = [under[k] + own.get(number, (0, 0))[k] for k in (0, 1)]
            for above, (p, n) in ((True, (bad - under[0], good - under[1])), (False, tuple(under))):
                if p >= LEAST_COVER and (gain := p * (log2(p / (p + n)) - log2(bad / (bad + good)))) > most:
                    best, most = Literal(name, above, cut), gain
    return best


def _pruned(rule: Rule, rows: DataFrame) -> Rule | None:
    if not rule:
        return None
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    found = rows.agg(*[F.count_if(matches(p, F.col("stats")) & (F.col("bad") == bad)) for p in prefixes for bad in (True, False)]).first()
    scored = [((p - n) / (p + n), p / (p + n), prefix)
              for prefix, p, n in zip(prefixes, found[::2], found[1::2], strict=True) if p + n]
    if not scored:
        return None
    _, precision, prefix = max(scored, key=lambda s: (s[0], -len(s[2])))
    return prefix if precision >= LEAST_PRECISION else None


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """row (all columns of docs), stats, base_failed, rule (number of the rejecting rule, 0 for none) and kept.

    The text is read once: the one-element explode keeps Spark from repeating the statistics for each use.
    Null text has no words and fails the base rules; repeated rows are judged alike; an empty table gives an empty one.
    """
    counted = docs.select(F.struct("*").alias("row"), F.explode(F.array(statistics(F.col("text")))).alias("stats"))
    ruled = counted.select("row", "stats", base_failed(F.col("stats")).alias("base_failed"), verdict(rules, F.col("stats")).cast("long").alias("rule"))
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base rules nor the list reject, in the columns of docs."""
    return judged(docs, rules).filter("kept").select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(learning_rows(docs, labels))
    return judged(docs.select("doc_id", "text"), rules).select(
        "row.doc_id", *[F.col("stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", "rule")
