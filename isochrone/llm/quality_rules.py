"""Rule bitmask ledger: every rule is evaluated once per document, policies are applied to the bits.

``measure`` counts what the rules look at, ``ledger`` turns the counts into one failure bit per rule.
A policy is a set of rules in force: a document is kept when none of their bits is set. Changing the
policy, comparing versions or leaving rules out reads the ledger, never the texts.

Everything is a narrow expression of one row: no shuffle, so a hot source or a group of copies costs
what its rows cost. A long document costs n log n of its own words.

Defined results: a NULL text counts as empty (no words, so ``few_words`` fails); a NULL ``doc_id`` and
repeated rows are rows like any other; an empty table gives an empty ledger; other columns of the input
are ignored by ``measure`` and never clash, because only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, carried, require, split_words, text_of

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: The position of a rule is its bit. Append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_windows")

#: Versioned policies: the rules in force.
POLICIES = {
    "base-1": BASE,
    "prose-1": (*BASE, "symbols", "capitals"),
    "prose-2": tuple(r.name for r in RULES),
}
POLICY = "prose-1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(names) -> int:
    """The bits of some rules."""
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    unknown = [n for n in names if n not in bits]
    if unknown:
        raise ValueError(f"no such rules: {unknown}")
    return sum(bits[n] for n in set(names))


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``words``: words inside a window that occurs twice or more.

    Hashes of the windows tell whether any can repeat; only then are the windows themselves sorted
    and compared, so a collision of hashes changes nothing.
    """
    at = ", ".join(f"words[i + {k}]" for k in range(WINDOW))
    df = df.withColumn("hashes", F.expr(
        f"CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({at})) ELSE array() END"
    ))
    df = df.withColumn("windows", F.expr(
        f"""CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN
              sort_array(transform(sequence(0, size(words) - {WINDOW}), i -> struct(concat_ws(' ', {at}) AS w, i AS i)))
            END"""
    )).drop("hashes")
    df = df.withColumn("starts", F.expr(
        """sort_array(transform(filter(transform(windows, (x, k) -> struct(
             (k > 0 AND windows[k - 1].w = x.w) OR (k < size(windows) - 1 AND windows[k + 1].w = x.w) AS twice, x.i AS i)),
             y -> y.twice), y -> y.i))"""
    )).drop("windows")
    return df.withColumn("n_repeat_words", F.expr(
        f"""coalesce(aggregate(transform(starts, (s, k) -> CASE WHEN k < size(starts) - 1 THEN least({WINDOW}, starts[k + 1] - s) ELSE {WINDOW} END),
             0L, (a, x) -> a + x), 0L)"""
    )).drop("starts")


def _characters(text: Column, pattern: str) -> Column:
    """How many characters are in a class, written as the negation of the class."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements (all long) of every document."""
    require(docs, "text", *keep)
    rows = docs.select(*[F.col(c).alias(f"key_{i}") for i, c in enumerate(keep)], text_of().alias("text"))
    rows = rows.withColumn("words", split_words(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    rows = _repeat_words(rows)
    return rows.select(
        *[F.col(f"key_{i}").alias(c) for i, c in enumerate(keep)],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _characters(F.col("text"), "[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _characters(F.col("text"), "[^A-Z]+").alias("n_capitals"),
    )


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failed``, one bit per rule."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total.cast("long"))


def kept(policy: str = POLICY, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(recorded: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: ``failing`` documents, those failing this rule alone (``only_this``, what
    leaving it out would bring back), and ``kept_without``, what the policy keeps then.

    One aggregation over the distinct failure masks, at most one row per combination of rules.
    """
    names = POLICIES[policy]
    full = mask(names)
    masks = recorded.groupBy(F.col("failed").bitwiseAND(F.lit(full)).alias("m")).agg(F.count("*").alias("n"))
    sums = []
    for n in names:
        bit, rest = mask([n]), full & ~mask([n])
        hit = F.col("m").bitwiseAND(F.lit(bit)) != 0
        sums.append(F.struct(
            F.lit(n).alias("rule"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failing"),
            F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), F.lit(0)).alias("only_this"),
            F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(rest)) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        ))
    return masks.agg(F.array(*sums).alias("rules")).select(F.explode("rules").alias("r")).select(F.lit(policy).alias("policy"), "r.*")


def filter_documents(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that pass a policy, with their columns as they were; one pass, no join."""
    recorded = ledger(measure(docs.select(carried(docs), "text"), keep=("row",)))
    # a filter would be pushed below the measurements and repeat them; a generator evaluates them once
    return recorded.select(F.inline(F.when(kept(policy), F.array("row"))))
