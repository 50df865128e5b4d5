"""Quality scores by co-training of a text-content and a page-metadata classifier.

Two views of a document: what its text is like (shares of symbols, repeats, capitals, words of a kind) and what is known about
it (source, language, lengths and lines). Each view has its own logistic regression, fitted on the labelled rows. In each
round either classifier scores all rows without labels, and the ones it is surest of, per class in the proportion of the
labels, become pseudo-labels for the other; then both are fitted again. The share that is exchanged grows from round to round, and
each round's pseudo-labels replace those before, so that one given in error can be taken back. At the end each view's log-odds
are calibrated on held-back labels by a logistic curve of its own, and the combined score is the logistic of a weighted sum of the calibrated
log-odds, with weights by how well each did there. No slope and no weight is negative: a view that says nothing weighs nothing.

Labels are held back within each class: a quarter by a hash of the key, but always at least one key of the class, and never its last. A class with a
single key has it in both parts. So both classes teach and calibrate whenever both are among the labels.

Labelled rows beyond `most_labels` are sampled down to it, in expectation, but a class keeps `LEAST_OF_CLASS` rows in expectation, which then
weigh less; no other row is ever left out: quantiles and pseudo-labels come from all unlabelled rows, scores are of all documents. Measures come from built-in functions over every whole
text; they are written once and read by each round.

A null or empty text has measures of 0 and is scored like any other; null metadata is a category of its own. Rows with a null key
are scored and have no label; rows that repeat a key share its label. Without both
classes among the labels (an empty table too) every score is null and all documents are kept. Labels other than 0 and 1, null
labels and keys with contradicting labels are left out. Extra columns don't pass.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.llm import rules
from chronoplate.llm.common import dropped, few, written

TEXT_VIEW = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share", "log_words", "log_mean_word", "flat_share", "squeezed")
SLOTS = 32
#: Labels (two numbers each) that may be broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Rows of a rare class that sampling keeps, in expectation.
LEAST_OF_CLASS = 1_000


def measured(docs: DataFrame, key: str, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    """`key`, the measures of the text view, and the metadata view: one-hot slots of source and language, length and its roundness."""
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[source].cast("string").alias("source"), docs[lang].cast("string").alias("lang"), docs[n_chars].cast("double").alias("chars"))
    # The metadata rides along with the key, so that the text is measured in one pass and nothing is joined.
    both = rules.features(plain.select(F.struct("key", "source", "lang", "chars").alias("key"), "text"), "key", "text")
    slot = lambda c, seed: F.pmod(F.xxhash64(F.coalesce(F.col(f"key.{c}"), F.lit("\0")), F.lit(seed)), F.lit(SLOTS))
    hot = lambda at, i: F.when(at == i, F.lit(1.0)).otherwise(F.lit(0.0))
    length = F.log1p(F.greatest(F.coalesce(F.col("key.chars"), F.lit(0.0)), F.lit(0.0)))
    meta = [hot(slot(c, s), i).alias(f"{c}_{i}") for s, c in enumerate(("source", "lang")) for i in range(SLOTS)]
    return both.select(
        F.col("key.key").alias("key"),
        *TEXT_VIEW[:6],
        F.log1p("n_words").alias("log_words"),
        F.log1p("mean_word").alias("log_mean_word"),
        F.when(F.col("distinct_share") < 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("flat_share"),
        F.sqrt("symbol_share").alias("squeezed"),
        *meta,
        length.alias("length"),
        (length * length).alias("length2"),
        F.when(F.col("key.chars").isNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("no_length"),
    )


META_VIEW = (*(f"{c}_{i}" for c in ("source", "lang") for i in range(SLOTS)), "length", "length2", "no_length")


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    """`rows` has the view's vector, label 0/1 and weight."""
    return LogisticRegression(featuresCol=view, labelCol="label", weightCol="weight", maxIter=30, regParam=1e-3, aggregationDepth=2).fit(rows)


def _weighed(rows: DataFrame, *odds: str) -> Column:
    """Log-odds as a weighted sum of the columns `odds`, fitted to label and weight with weights of zero or more."""
    least = Matrices.dense(1, len(odds), [0.0] * len(odds))
    logistic = LogisticRegression(featuresCol="odds", labelCol="label", weightCol="weight", maxIter=30, regParam=1e-3, lowerBoundsOnCoefficients=least)
    model = logistic.fit(VectorAssembler(inputCols=list(odds), outputCol="odds").transform(rows))
    return sum((F.col(c) * float(w) for c, w in zip(odds, model.coefficients, strict=True)), F.lit(float(model.intercept)))


def dealt(labelled: DataFrame, most_labels: int) -> tuple[DataFrame, dict[float, int]]:
    """The labelled rows that teach, with `weight` and the flags `known` and `held` (one of them, or both for the sole key of a class), and the number of labelled rows of each class."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, most_labels / max(sum(counts.values()), 1))
    shares = {x: max(share, min(1.0, LEAST_OF_CLASS / n)) if share < 1 else 1.0 for x, n in counts.items()}
    part = F.coalesce(*(F.when(F.col("label") == x, F.lit(y)) for x, y in shares.items()), F.lit(1.0))
    drawn = labelled.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < part * (1 << 30)).withColumn("weight", share / part)
    by_hash = drawn.withColumn("draw", F.struct(F.xxhash64("key", F.lit(11)).alias("h"), "key"))
    # Two rows: the first and the last key of each class in the order of the hash.
    ends = by_hash.groupBy(F.col("label").alias("of")).agg(F.min("draw").alias("first"), F.max("draw").alias("last"))
    flags = by_hash.join(F.broadcast(ends), F.col("label") == F.col("of"))
    last = F.col("draw") == F.col("last")
    held = (F.col("draw") == F.col("first")) | ((F.pmod(F.col("draw.h"), F.lit(4)) == 0) & ~last)
    return flags.withColumn("held", held).withColumn("known", ~held | last).drop("draw", "of", "first", "last"), counts


def _odds(model: LogisticRegressionModel, rows: DataFrame, view: str, name: str) -> DataFrame:
    """Log-odds of good quality by one view, as a column."""
    done = model.setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("_prob").setPredictionCol("_pred").transform(rows)
    return done.withColumn(name, F.get(vector_to_array("_raw"), F.lit(1))).drop("_raw", "_prob", "_pred")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cotrain(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    label: str = "quality",
    rounds: int = 3,
    exchanged: float = 0.05,
    threshold: float = 0.5,
    most_labels: int = 50_000,
) -> DataFrame:
    """`key`, `p_text`, `p_meta`, `score` (probability of good quality) and `kept` (score >= threshold or null) of every row.

    `exchanged` is the share of the unlabelled rows that each view labels for the other in the first round; in round r it is r times that."""
    rows = measured(docs, key, text, source, lang, n_chars)
    assemble = lambda df: VectorAssembler(inputCols=list(META_VIEW), outputCol="meta").transform(VectorAssembler(inputCols=list(TEXT_VIEW), outputCol="view").transform(df)).select("key", "view", "meta")
    truth = labels.groupBy(labels[key].alias("lkey")).agg(F.min(label).alias("label"), F.max(label).alias("hi")).filter(F.col("label").isin(0, 1) & (F.col("label") == F.col("hi"))).select("lkey", F.col("label").cast("double").alias("label"))
    truth = few(written(truth.filter("lkey is not null"), "truth"), BROADCAST_LABELS)
    views = assemble(rows)
    rows = written(views.join(truth, views["key"] == truth["lkey"], "left").drop("lkey"), "views")
    labelled = rows.filter("label is not null")
    drawn, counts = dealt(labelled, most_labels)
    if len(counts) < 2:
        none = F.lit(None).cast("double")
        return rows.select(F.col("key").alias(key), none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("kept"))
    sample = written(drawn, "sample")
    known = sample.filter("known").select("view", "meta", "label", "weight")
    good = counts[1.0] / (counts[0.0] + counts[1.0])
    open_ = rows.filter("label is null").select("view", "meta")
    both = lambda models, df: _odds(models["meta"], _odds(models["view"], df, "view", "a"), "meta", "b")
    models = {v: _fit(known, v) for v in ("view", "meta")}
    for r in range(1, rounds + 1):
        scored = both(models, open_)
        part = min(0.5, r * exchanged)
        ends = F.array(F.lit(part * (1 - good)), F.lit(1 - part * good))
        cut = scored.agg(*(F.percentile_approx(c, ends, 10_000).alias(c) for c in ("a", "b"))).first()
        if cut["a"] is None:
            break
        # Sure means far out among the unlabelled and on the right side; what is given weighs less than a label.
        sure = {c: ((F.col(c) <= cut[c][0]) & (F.col(c) < -1)) | ((F.col(c) >= cut[c][1]) & (F.col(c) > 1)) for c in ("a", "b")}
        gifts = written(scored.filter(sure["a"] | sure["b"]).select("view", "meta", *(F.when(sure[c], (F.col(c) > 0).cast("double")).alias(c) for c in ("a", "b"))), "gifts")
        # What one view (a: text, b: metadata) is sure of is the other's lesson.
        models = {v: _fit(known.union(gifts.filter(f"{c} is not null").select("view", "meta", c, F.lit(0.3))), v) for v, c in (("view", "b"), ("meta", "a"))}
        dropped(gifts)
    held = written(both(models, sample.filter("held")).select("a", "b", "label", "weight"), "held")
    a, b = _weighed(held, "a"), _weighed(held, "b")
    score = _logistic(_weighed(held.select(a.alias("a"), b.alias("b"), "label", "weight"), "a", "b"))
    dropped(sample, held)
    scored = both(models, rows).select("key", a.alias("a"), b.alias("b"))
    return scored.select(F.col("key").alias(key), _logistic(F.col("a")).alias("p_text"), _logistic(F.col("b")).alias("p_meta"), score.alias("score"), (score >= threshold).alias("kept"))
