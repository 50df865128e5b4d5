"""The registered queries of the training-text operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.llm import bpe, cotrain, decontaminate, langid, license_scan, merkle, minhash, rules, runs, suffix_dedup, topk, url_filter, wordpiece
from chronoplate.llm.common import WORD_SPLIT, ascii_lower_col, fresh, table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no file names, so a tree is laid out by their columns: source/thousands/hundreds/doc_id. Documents whose
    id is divisible by 10 and that state a licence stand for licence files of their directory."""
    docs = table(spark, sf_dir, "documents")
    step = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), step(10_000), step(1_000), F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan.scan(files, key="doc_id", is_license=F.col("doc_id") % 10 == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(rules.features(table(spark, sf_dir, "documents")), "measures")
    learned = rules.learn(written(rules.labelled(measured, table(spark, sf_dir, "labels")), "labelled"))
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rules.base_failed().alias("base_failed"),
        (~rules.base_failed() & rules.verdict(learned)).alias("kept"),
        rules.fired(learned).alias("rule"),
    )


#: The rules of the query.
URL_RULES = [
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """The documents of op11: where the crc32 h of the id is divisible by 10, the words from a on repeat the first p of them, with
    a = g % n, p = 1 + floor((n - a) / (3 + g % 8)) and g = floor(h / 10). A null id leaves the text as it is."""
    h, words, a, p = fresh(docs, "h", "words", "a", "p")
    chosen = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn(
        words, F.when(F.col(h) % 10 == 0, F.filter(F.split("text", WORD_SPLIT), lambda w: w != ""))
    )
    g, n = F.floor(F.col(h) / 10), F.size(words)
    placed = chosen.withColumn(a, F.when(n > 0, g % n).cast("int")).withColumn(p, F.expr(f"int(1 + (size(`{words}`) - `{a}`) div (3 + floor(`{h}` / 10) % 8))"))
    rest = n - F.col(a)
    period = F.slice(words, F.col(a) + 1, F.col(p))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col(p)).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), F.col(a)), tail), " ")
    return placed.withColumn("text", F.when(F.col(a).isNotNull(), made).otherwise(F.col("text"))).drop(h, words, a, p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(with_periodic_ends(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start, then period: the first of the greatest length/period stays.
    better = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double"))
    finite = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", finite.alias("embedding")).withColumn("embedding", whole)
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(*known, ascii_lower_col(F.col("text"))))
    proved = merkle.manifest(docs, merkle.leaf(*known, F.col("text")), F.col("lang"), [F.col("doc_id")], [F.col("doc_id"), tampered.alias("tampered")])
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op5, which SQL can give."""
    return rules.features(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"))


def url_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op6 without the tree."""
    url = F.col("url")
    urls = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("key"), url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    return url_filter.ruled(urls, URL_RULES).select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("verdict"))


def language_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents op10 keeps from learning."""
    return table(spark, sf_dir, "documents").select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_cotrained_quality": op2_cotrained_quality,
        "op3_license_scan": op3_license_scan,
        "op4_decontamination": op4_decontamination,
        "op5_quality_rules": op5_quality_rules,
        "op6_url_filter": op6_url_filter,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_language_id": op10_language_id,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_top_k": op12_top_k,
        "op13_merkle_manifest": op13_merkle_manifest,
        "quality_base_counts": quality_base_counts,
        "url_rule_matches": url_rule_matches,
        "language_held_out": language_held_out,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_suffix_dedup": OP8_SQL,
        "op9_near_duplicates": OP9_SQL,
        "op12_top_k": OP12_SQL,
        "op13_merkle_manifest": _merkle_sql(),
        "quality_base_counts": BASE_SQL,
        "url_rule_matches": RULES_SQL,
        "language_held_out": HELD_OUT_SQL,
    }


BASE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)
), twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows JOIN twice USING (doc_id, g)) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN inside USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""

RULES_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS domain, rule[strpos(rule, '/'):] AS start FROM (VALUES """ + ", ".join(f"('{r.verdict}', '{r.rule}')" for r in URL_RULES) + """) t(verdict, rule))
SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, verdict DESC) = 1
"""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _crc(column: str) -> str:
    """SQL for the unsigned crc32 of a number's decimal text (null: null)."""
    step = "xor(list_extract(tab, (xor(c, b) & 255) + 1), c >> 8)"
    of = f"list_prepend(4294967295::BIGINT, list_transform(string_split({column}::VARCHAR, ''), lambda x: ascii(x)::BIGINT))"
    return f"(SELECT xor(list_reduce({of}, lambda c, b: {step}), 4294967295::BIGINT) FROM (SELECT {_crc_table()}::BIGINT[] AS tab))"


HELD_OUT_SQL = f"SELECT doc_id, {_crc('doc_id')} % 4 = 2 AS held_out FROM documents"

#: Levels that the SQL of op13 unrolls: a language may have eight to the power of it documents.
SQL_LEVELS = 9


def _merkle_sql() -> str:
    """Levels n0 to n9 of the languages' trees and t0 to t9 of the tree of their roots; then the documents c0 to c9 and d0 to d9 go up
    them, with f the digest so far and p the proof so far. A tree of one node has no siblings left, and one that ended has no row."""

    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))

    def level(name: str, k: int) -> str:
        if k == 0:
            nodes = {"n": "SELECT tree, i, h FROM leaves", "t": "SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM subroots"}[name]
        else:
            nodes = f"SELECT tree, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, i // 8"
        run = "string_agg(h, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        return f"{name}{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n, {run} UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM ({nodes}))"

    def climb(name: str, levels: str, tree: str, k: int) -> str:
        up = "CASE WHEN n > 1 THEN sha256(coalesce(a, '') || f || coalesce(b, '')) ELSE f END AS f, p || coalesce(a, '') || coalesce(b, '') AS p"
        return f"{name}{k} AS MATERIALIZED (SELECT c.* REPLACE ({up}) FROM {name}{k - 1} c LEFT JOIN {levels}{k - 1} s ON s.tree = {tree} AND s.i = c.i // {8 ** (k - 1)})"

    steps = range(SQL_LEVELS + 1)
    roots = lambda name: " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in steps)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"raw AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({fields('text')}) AS h, CASE WHEN {_crc('doc_id')} % 3 = 0 THEN sha256({fields(low)}) END AS low FROM documents)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM raw)",
        *(level("n", k) for k in steps),
        f"subroots AS MATERIALIZED ({roots('n')})",
        *(level("t", k) for k in steps),
        f"root AS MATERIALIZED ({roots('t')})",
        "c0 AS (SELECT *, coalesce(low, h) AS f, '' AS p FROM leaves)",
        *(climb("c", "n", "c.tree", k) for k in steps[1:]),
        f"d0 AS (SELECT c.* REPLACE (t.i AS i), s.h AS subroot FROM c{SQL_LEVELS} c JOIN subroots s USING (tree) JOIN t0 t ON t.i = (SELECT count(*) FROM subroots o WHERE o.tree < s.tree))",
        *(climb("d", "t", "0", k) for k in steps[1:]),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, d.h AS leaf, subroot, root.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM d{SQL_LEVELS} d, root"


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, p, least(1000, n - 199 - p) AS k, substr(h, 2 * p + 1, 2398) AS h FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2 - 199, 1000)) AS p FROM d WHERE length(h) >= 400)),
w AS (SELECT doc_id, p + j AS i, md5(substr(h, 2 * j + 1, 400)) AS s FROM (SELECT doc_id, p, h, unnest(range(0, k)) AS j FROM piece)),
rep AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM rep),
span AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
edge AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM span),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM edge JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, (row_number() OVER best)::INT AS rank, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r
WINDOW best AS (PARTITION BY q.r ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) QUALIFY row_number() OVER best <= 20
"""

OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, linked.b FROM reach JOIN linked ON linked.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.b AS component_id, d.doc_id = c.b AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
