"""Quality rules as a learned decision list, in DataFrame functions only.

`features` measures every whole text by built-in functions. `learn` runs sequential covering over the labelled rows: a rule
grows by the threshold test that most raises its smoothed precision for low quality, is pruned by dropping tests that
don't pay on a held-back third of the labels, and then the rows that it covers are set aside; this repeats until no rule is
precise enough. Candidate tests are thresholds of every measure among the rows that no rule covers yet: zero, the least positive
value and quantiles of what isn't zero, finer in the tails. One aggregation over the labelled rows counts
all of them at once, so only counts reach the driver. `verdict` is the ordered list as one Spark conditional expression.

Nulls: a null text has no words (all measures 0). A null measure can't occur; labels that are null or not 0/1 are left out.
Without usable labels (an empty table, one class only) the list is empty and every text passes. Extra columns of the
input are ignored but for the key; repeated keys give a row each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.llm.common import BLANKS, WORD_SPLIT

#: Fixed values of the base measures.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: What rules may test: share measures derived from the counts.
MEASURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "line_words", "distinct_share")


def _without(col: Column, characters: str) -> Column:
    return F.length(F.translate(col, characters, ""))


def _repeated_words(hashes: Column, window: int) -> Column:
    """Words inside windows found twice or more. Windows are sorted by (hash, place); the marked places then add min(window, next place - place) words each."""
    n = F.size(hashes) - (window - 1)
    keys = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))

    def of(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            near = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]), x["p"]))
            return F.array_sort(F.filter(near, lambda p: p.isNotNull()))

        def covered(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return _let(_let(pairs, marked), covered)

    # Most texts repeat no window: a hash set over the keys settles those without a sort.
    return F.when(n < 2, F.lit(0)).otherwise(_let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(of(k))))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, the base counts of the contract and the measures that rules may test."""
    t = F.coalesce(docs[text], F.lit(""))
    words = F.filter(F.split(t, WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = docs.select(
        docs[key].alias("key"),
        F.length(t).alias("chars"),
        (F.length(t) - _without(t, BLANKS)).alias("blanks"),
        (F.length(t) - _without(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("uppers"),
        (F.length(t) - _without(t, "!")).alias("bangs"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("line"),
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), F.size(F.array_distinct(h)).alias("distinct"), _repeated_words(h, WINDOW).alias("repeat"))).alias("word"),
    )
    n, chars = F.col("word.n"), (F.col("chars") - F.col("blanks"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    return counted.select(
        F.col("key").alias(key),
        n.cast("bigint").alias("n_words"),
        chars.cast("bigint").alias("word_chars"),
        "n_symbols",
        F.col("line.dup").cast("bigint").alias("n_dup_lines"),
        F.col("word.repeat").cast("bigint").alias("n_repeat_words"),
        share(chars, n).alias("mean_word"),
        share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(F.col("line.dup"), F.col("line.n")).alias("dup_line_share"),
        share(F.col("word.repeat"), n).alias("repeat_share"),
        share(F.col("uppers"), chars).alias("upper_share"),
        share(F.col("bangs"), chars).alias("bang_share"),
        share(n, F.col("line.n")).alias("line_words"),
        share(F.col("word.distinct"), n).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """measure >= value, or measure < value."""

    measure: str
    at_least: bool
    value: float

    def column(self) -> Column:
        return F.col(self.measure) >= F.lit(self.value) if self.at_least else F.col(self.measure) < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (t.column() for t in rule), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """false where a rule of the list fires; the first that fires decides."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(covers(rule), F.lit(False)).otherwise(out)
    return out


def fired(rules: list[Rule]) -> Column:
    """The text of the first rule that fires, or null."""
    return F.coalesce(*(F.when(covers(r), F.lit(" and ".join(map(str, r)))) for r in rules), F.lit(None).cast("string"))


def learn(
    rows: DataFrame,
    label: str = "bad",
    measures: tuple[str, ...] = MEASURES,
    precision: float = 0.9,
    least: int = 10,
    most_rules: int | None = None,
    most_tests: int = 3,
    quantiles: int = 20,
) -> list[Rule]:
    """Sequential covering over `rows`: the measures, boolean `label` and boolean `held` (the pruning part).

    Counts are smoothed by one row of the base rate. Each step is one aggregation: rows that the rule so far covers are
    counted by (measure, number of cuts at or below the value), and running sums over those counts give every threshold
    test. The driver gets a few hundred counts a step, whatever the size of the labels. Without `most_rules`, precision and support
    alone end the list: each rule takes `least` bad rows at least from what is left."""
    tails = [0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03]
    levels = sorted({*tails, *(i / quantiles for i in range(1, quantiles)), *(1 - t for t in tails)})
    rules: list[Rule] = []

    def left(held: bool) -> DataFrame:
        return reduce(lambda d, r: d.filter(~covers(r)), rules, rows.filter(F.col("held") == held))

    def thresholds() -> dict[str, list[float]]:
        """Cuts of each measure, from the rows that no rule covers yet."""
        some = lambda m: F.percentile_approx(F.when(F.col(m) != 0, F.col(m)), levels, 10_000)
        found = left(False).agg(*(x for m in measures for x in (some(m).alias(m), F.min(F.when(F.col(m) > 0, F.col(m))).alias(f"least_{m}")))).first()
        return {m: sorted({0.0, *(float(v) for v in (*(found[m] or ()), found[f"least_{m}"]) if v is not None)}) for m in measures}

    def count(held: bool, *options: Rule) -> list[tuple[int, int]]:
        """(bad, all) of each of a few rules among the rows that no earlier rule covers."""
        got = left(held).agg(*(x for i, r in enumerate(options) for x in (F.count_if(covers(r) & F.col(label)).alias(f"b{i}"), F.count_if(covers(r)).alias(f"n{i}")))).first()
        return [(got[f"b{i}"], got[f"n{i}"]) for i in range(len(options))]

    def extensions(rule: Rule) -> list[tuple[Test, int, int]]:
        """Every threshold test that could join the rule, with (bad, all) of the rule joined by it."""
        below = F.array(*(F.struct(F.lit(m).alias("m"), reduce(lambda a, b: a + b, ((F.col(m) >= F.lit(v)).cast("int") for v in cuts[m]), F.lit(0)).alias("cut")) for m in measures))
        by = left(False).filter(covers(rule)).select(F.explode(below).alias("x"), label).groupBy("x.m", "x.cut").agg(F.count_if(label).alias("b"), F.count("*").alias("n")).collect()
        out = []
        for m in measures:
            own = {r["cut"]: (r["b"], r["n"]) for r in by if r["m"] == m}
            whole = [sum(v[k] for v in own.values()) for k in (0, 1)]
            for j, v in enumerate(cuts[m], 1):
                up = [sum(x[k] for cut, x in own.items() if cut >= j) for k in (0, 1)]
                out += [(Test(m, True, v), *up), (Test(m, False, v), whole[0] - up[0], whole[1] - up[1])]
        return out

    def precise(bad: int, n: int, rate: float) -> float:
        return (bad + rate) / (n + 1)

    while most_rules is None or len(rules) < most_rules:
        ((bad, n),) = count(False, ())
        if bad < least or bad == n:
            break
        rate, rule, best = bad / n, (), bad / n
        cuts = thresholds()
        while len(rule) < most_tests and best < 0.995:
            options = [(precise(b, k, rate), b, t) for t, b, k in extensions(rule) if b >= least]
            top = max((p for p, _, _ in options), default=0)
            if top <= best + 0.002:
                break
            # Among options of nearly the same precision, the one that covers most.
            best, _, test = max((x for x in options if x[0] >= top - 0.005), key=lambda x: (x[1], x[0], str(x[2])))
            rule = (*rule, test)
        # Prune on the held-back labels: a test goes if the rule without it is as precise there.
        while len(rule) > 1:
            options = [rule, *(rule[:i] + rule[i + 1 :] for i in range(len(rule)))]
            scores = [precise(b, k, rate) for b, k in count(True, *options)]
            i = max(range(1, len(options)), key=lambda j: scores[j])
            if scores[i] < scores[0]:
                break
            rule = options[i]
        if not rule:
            break
        (b, k), (hb, hk) = *count(False, rule), *count(True, rule)
        if precise(b + hb, k + hk, rate) < precision:
            break
        rules.append(rule)
    return rules


def labelled(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Measures of the labelled rows with `bad` and `held`. A key with contradicting labels is left out."""
    truth = labels.groupBy(labels[key].alias("key")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter(F.col("lo").isin(0, 1) & (F.col("lo") == F.col("hi")))
    return (
        measured.join(truth, measured[key] == truth["key"])
        .select(measured["*"], (F.col("lo") == 0).alias("bad"), (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).alias("held"))
    )
