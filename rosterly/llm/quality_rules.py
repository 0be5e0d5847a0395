"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger holds one bit per failed rule and the measurements the rules
read. A policy is a version and the mask of the rules that reject, so changing a policy or asking what a rule alone
rejects needs only bitwise work on the ledger, never the texts. DataFrame functions only: no Python in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, table, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule -> (bit, whether a document fails it). Integer arithmetic, so that any engine gives the same verdict.
RULES = {
    "few_words": (0, lambda m: m["n_words"] < 50),
    "repeated_windows": (1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    "symbols": (2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    "duplicate_lines": (3, lambda m: (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),
    "short_words": (4, lambda m: (m["n_words"] > 0) & (m["word_chars"] < 2 * m["n_words"])),
    "long_words": (5, lambda m: m["word_chars"] > 15 * m["n_words"]),
}
BASE = ("few_words", "repeated_windows")
#: Policy version -> rules that reject.
POLICIES = {"base": BASE, "v1": tuple(RULES)}


def mask(rules) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hashes of their words; the
    hashes of one document are sorted with their places, those equal to a neighbour are put back in order, and the
    union of their windows is measured. Time grows as n log n, memory as n."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = let(pairs, lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    return F.when(F.size(w) < 3, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def measured(text: Column) -> Column:
    """A struct of the measurements; null counts as empty. A line with a word that equals an earlier line is a
    duplicate line; lines are split at \\n alone and compared unchanged."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = lambda c, name: c.cast("bigint").alias(name)
    by_words = let(words(t), lambda w: F.struct(n(F.size(w), "n_words"), n(F.length(F.array_join(w, "")), "word_chars"), n(_repeat_words(w), "n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(n(F.size(x), "n_lines"), n(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))
    return let(F.struct(by_words.alias("w"), by_lines.alias("l")), lambda s: F.struct(s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), n(symbols, "n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"), s["l"]["n_lines"].alias("n_lines")))


def bits(m: Column) -> Column:
    """The bits of failed rules, given the struct of measurements."""
    out = F.lit(0).cast("bigint")
    for bit, fails in RULES.values():
        out = out.bitwiseOR(F.when(fails(m), F.lit(1 << bit)).otherwise(0).cast("bigint"))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of failed rules; one row per row of docs.

    A null or empty text has no words and so fails few_words; a null id stays null; repeated rows each give a row; an
    empty table gives an empty result; other columns are ignored whatever their names.
    """
    m = F.col("m")
    return docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col)).alias("m")).select("doc_id", "m.*", bits(m).alias("failed"))


def rejected_by(policy: str, failed: Column) -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that it alone rejects under the policy. One pass over the
    ledger with partial aggregation; the result has one row per rule."""
    m = mask(POLICIES[policy])
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("bigint").alias("bit")) for r in POLICIES[policy]))
    own = F.col("failed").bitwiseAND(F.lit(m))
    return (
        book.groupBy(own.alias("own")).agg(F.count("*").alias("n"))
        .withColumn("r", F.explode(rules))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("own").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("own") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"))
    )


def accepted(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns of docs."""
    return docs.where(~let(measured(F.col(text_col)), lambda m: rejected_by(policy, bits(m))))


def op10_quality_rules(spark, sf_dir):
    book = ledger(table(spark, sf_dir, "documents"))
    base, verdict = rejected_by("base", F.col("failed")), rejected_by("v1", F.col("failed"))
    return book.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & ~verdict).alias("kept"), F.col("failed").alias("failed_bits"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
             list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
      FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""
