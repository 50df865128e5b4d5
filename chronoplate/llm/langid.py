"""Language identification by hierarchical discrimination.

A text becomes the relative frequencies of its hashed two- to four-byte grams (lower-cased letters, all else one blank). First
one-versus-rest linear support vector machines choose the language family, then one-versus-one machines vote among the
family's languages. Margins are turned into probabilities by a logistic curve; the score is the family's probability times
that of the winner against its relatives.

Training takes a sample bounded by `per_language` rows of each language in expectation, drawn by a hash, and at most twice that:
keys and hashes of texts are drawn first, and only then are their texts read. Each machine is fitted in a task of its own, on sparse vectors;
a family's machine takes at most `PER_POSITIVE` times its own rows from the other families. Prediction reads every whole text; only the
text is its input.

The `most_languages` languages with the most rows are learnt (ties: the smaller name); rows of others are judged, and teach nothing.

Texts that are null or have no letter are `und` with score 0, as all are if there is nothing to learn from. A single language
gets all others with score 1. Rows with a null key are judged, but neither held out nor learnt from; rows with the same key and text teach
once. Repeated keys are kept. Extra columns don't pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chronoplate.llm.common import arrow_map, few, written

UNKNOWN = "und"
BITS = 12
GRAMS = (2, 3, 4)
PER_POSITIVE = 4

#: Families of common languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl af sv da no nb nn is lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi bn ur mr gu pa ne",
    "semitic": "ar he mt",
    "celtic": "ga cy gd br",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def family(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].lower(), language)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Frequencies of hashed grams scaled to length 1; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint64)
    out, h = np.zeros(1 << BITS, np.float32), raw
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] << np.uint64(8)) | raw[n - 1 :]
        if n in GRAMS:
            slot = ((h + np.uint64(n)) * _MUL) >> np.uint64(64 - BITS)
            out += np.bincount(slot.astype(np.int64), minlength=1 << BITS)
    return out / np.linalg.norm(out)


@dataclass(frozen=True)
class Machine:
    """A linear machine: margin = x·w + b; probability of its first side = logistic(slope · margin + shift)."""

    side: str
    other: str
    w: np.ndarray
    b: float
    slope: float
    shift: float


class Sparse:
    """Rows of a matrix by their places and values, with a last column of ones."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray], width: int):
        sizes = np.array([len(p) for p in places])
        self.width = width + 1
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.at, self.values = np.concatenate(places).astype(np.int64), np.concatenate(values).astype(np.float64)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * w[self.at], self.starts) + w[-1]

    def across(self, g: np.ndarray) -> np.ndarray:
        """The transpose times a vector."""
        out = np.bincount(self.at, weights=self.values * g[self.rows], minlength=self.width)
        out[-1] = g.sum()
        return out


def fit(x: Sparse, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float, float, float]:
    """Squared-hinge linear machine by accelerated gradient, and its logistic curve; y is ±1, classes count alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = v = np.zeros(x.width)
    step = 1 / (penalty + 4)
    for i in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * x.across(weight * y * gap))
        w, v = new, new + i / (i + 3) * (new - w)
    margin = x @ w
    slope, shift = 1.0, 0.0
    for _ in range(100):  # logistic regression on the margin, slightly shrunk
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = weight * (p - (y > 0) * 0.98 - 0.01)
        h = weight * p * (1 - p) + 1e-9
        a = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-4]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(a, [(g * margin).sum(), g.sum()]), -2, 2)
    return w[:-1], float(w[-1]), float(slope), float(shift)


def learn(rows: DataFrame, per_language: int = 500, most_languages: int = 200) -> list[Machine]:
    """Machines from `rows` (key, text, lang), none of which is null; a hash of key and text draws the sample."""
    rows = rows.filter("key is not null and text is not null and lang is not null").withColumn("th", F.xxhash64("text"))
    named = rows.select("key", "th", "lang")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if len(sizes) < 2:
        return [_sole(x) for x in sizes]
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, per_language / n))) for x, n in sizes.items()))
    draw = F.xxhash64("key", "th")
    drawn = named.filter(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30)).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "key", "th"))
    drawn = written(drawn.withColumn("nth", nth).filter(F.col("nth") <= 2 * per_language).select("key", "th", "lang"), "drawn")
    texts = rows.join(few(drawn, 1_000_000), ["key", "th", "lang"], "left_semi")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [(k, th, lang, v) for k, th, t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (v := gram_counts(t)) is not None]
        at = [np.flatnonzero(v) for *_, v in got]
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, *_ in got], batch.schema.field(0).type), pa.array([th for _, th, *_ in got], pa.int64()), pa.array([x for *_, x, _ in got], pa.string()),
            pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([v[a].tolist() for (*_, v), a in zip(got, at, strict=True)], pa.list_(pa.float32())),
        ], names=["key", "th", "lang", "at", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    sample = written(arrow_map(texts.select("key", "th", "text", "lang"), "text", f"key {kind}, th bigint, lang string, at array<int>, x array<float>", vectors, 4_000_000), "sample")
    sample = sample.dropDuplicates(["key", "th", "lang"])
    langs = sorted(sizes)
    families = sorted({family(x) for x in langs})
    jobs = [("family", f, "") for f in families] if len(families) > 1 else []
    jobs += [("pair", a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    # For each language, the jobs that take its rows and the share of the rows that they take.
    drawn_of = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    of_family = {f: sum(n for x, n in drawn_of.items() if family(x) == f) for f in families}
    total = sum(drawn_of.values())
    some = lambda f: min(1.0, PER_POSITIVE * of_family[f] / max(total - of_family[f], 1))
    taken = {x: [(j, 1.0 if kind == "pair" or family(x) == a else some(a)) for j, (kind, a, b) in enumerate(jobs) if kind == "family" or x in (a, b)] for x in langs}
    as_jobs = lambda got: F.array(*(F.struct(F.lit(j).alias("job"), F.lit(float(part)).alias("part")) for j, part in got)) if got else F.array().cast("array<struct<job: int, part: double>>")
    by = F.coalesce(*(F.when(F.col("lang") == x, as_jobs(taken[x])) for x in langs))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        kind, a, _ = jobs[int(rows["job"].iloc[0])]
        y = np.array([1.0 if (family(x) if kind == "family" else x) == a else -1.0 for x in rows["lang"]])
        w, b, slope, shift = fit(Sparse(rows["at"].tolist(), rows["x"].tolist(), 1 << BITS), y)
        return pd.DataFrame({"job": [int(rows["job"].iloc[0])], "w": [w.tolist()], "b": [b], "slope": [slope], "shift": [shift]})

    dealt = sample.withColumn("by", F.explode(by)).filter(F.pmod(F.xxhash64("key", "th", "by.job"), F.lit(1 << 20)) < F.col("by.part") * (1 << 20))
    fitted = dealt.select("lang", "at", "x", F.col("by.job").alias("job")).groupBy("job").applyInPandas(train, "job int, w array<float>, b double, slope double, shift double").collect()
    out = []
    for r in sorted(fitted):
        kind, a, b = jobs[r["job"]]
        out.append(Machine(f"family:{a}" if kind == "family" else a, b, np.array(r["w"], np.float32), r["b"], r["slope"], r["shift"]))
    return out + [_sole(x) for x in langs if sum(family(x) == family(y) for y in langs) == 1]


def _sole(language: str) -> Machine:
    """Stands for a language without relatives: always chosen in its family."""
    return Machine(language, language, np.zeros(1 << BITS, np.float32), 0.0, 0.0, 30.0)


class Judge:
    """Prediction by the machines of learn()."""

    def __init__(self, machines: list[Machine]):
        self.machines = machines
        self.w = np.stack([m.w for m in machines]).T if machines else None
        self.b, self.slope, self.shift = (np.array([getattr(m, k) for m in machines]) for k in ("b", "slope", "shift"))
        self.families = [(i, m.side.removeprefix("family:")) for i, m in enumerate(machines) if m.side.startswith("family:")]
        self.pairs: dict[str, list[tuple[int, str, str]]] = {}
        for i, m in enumerate(machines):
            if not m.side.startswith("family:"):
                self.pairs.setdefault(family(m.side), []).append((i, m.side, m.other))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.machines:
            return [(UNKNOWN, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for t in texts:
            x = gram_counts(t)
            if x is None:
                out.append((UNKNOWN, 0.0))
                continue
            p = 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.w + self.b) + self.shift, -30, 30)))
            score, chosen = 1.0, next(iter(self.pairs))
            if self.families:
                i, chosen = max(self.families, key=lambda f: p[f[0]])
                score = p[i]
            votes: dict[str, list[float]] = {}
            for i, a, b in self.pairs[chosen]:
                votes.setdefault(a, []).append(p[i])
                if b != a:
                    votes.setdefault(b, []).append(1 - p[i])
            best = max(sorted(votes), key=lambda v: (sum(q > 0.5 for q in votes[v]), sum(votes[v])))
            out.append((best, float(min(1.0, max(0.0, score * min(votes[best]))))))
        return out


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the key's decimal text modulo 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _machines(rows: DataFrame, per_language: int) -> list[Machine]:
    """`rows` has (key, text, lang)."""
    return learn(rows.filter(~held_out(F.col("key"))).select("key", "text", "lang"), per_language)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500) -> DataFrame:
    """`key`, `held_out`, `lang_pred`, `score` of every row; learns from the rows that aren't held out."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")).withColumn("held_out", held_out(F.col("key")))
    machines = _machines(rows, per_language)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Judge(machines)(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["key", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(rows.select("key", "held_out", "text"), "text", f"key {kind}, held_out boolean, lang_pred string, score double", work).withColumnRenamed("key", key)


def with_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500) -> DataFrame:
    """All columns of `docs` and `language` struct<pred, score>, for a stage that passes documents on; the columns may not hold a `language`."""
    machines = _machines(docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")), per_language)
    names = [*docs.columns, "language"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Judge(machines)(batch.column(text).to_pylist())
        judged = pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["pred", "score"])
        return pa.RecordBatch.from_arrays([*batch.columns, judged], names=names)

    # One pass that a filter on its result can't repeat, as it would a UDF column.
    schema = StructType([*docs.schema.fields, StructField("language", StructType.fromDDL("pred string, score double"))])
    return arrow_map(docs, text, schema, work)
