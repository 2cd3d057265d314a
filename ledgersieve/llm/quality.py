"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per
failed rule; policies are versioned masks over these bits, so a new policy or an ablation reads
the ledger and never the text.

Defined results: a null or empty text has no words and fails ``few_words`` only; ties do not
arise; repeated rows give repeated ledger rows; an empty table gives an empty ledger; columns
of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import words

SYMBOLS = "[#*$%&|<>]"
#: Rule name -> condition that fails a document, in bit order.  New rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: Version -> rules that it enforces.  A published version never changes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "strict-1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeated_words(tokens: Column, n: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash within one document; equal hashes are brought side by
    side by sorting, and overlapping windows count their words once.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(starts) - 1), F.lit(3),
            lambda total, i: total + F.least(F.lit(3), F.get(starts, i) - F.get(starts, i - 1)),
        )

    def same(left: Column, right: Column) -> Column:
        return F.coalesce(left["h"] == right["h"], F.lit(False))

    def starts_of(ordered: Column) -> Column:
        repeated = F.filter(
            ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1))
        )
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def with_ties(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(ordered, lambda s: _let(starts_of(s), covered))

    return F.when(
        n >= 3,
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(with_ties(h))),
    ).otherwise(F.lit(0)).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, by a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and the measurements of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens, lines = F.col("tokens"), F.col("lines")
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("body"))
        .select("doc_id", "body", words(F.col("body")).alias("tokens"))
        .select(
            "doc_id", "tokens",
            F.size("tokens").alias("n"),
            F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        )
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            "n_symbols",
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(tokens, F.col("n")).alias("n_repeat_words"),
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed_bits`` of every document."""
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs, id_col, text_col).withColumn("failed_bits", failed.cast("long"))


def fails(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def verdicts(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` under the policy, and the version that decided."""
    return rows.withColumns({
        "base_failed": fails("base-1"),
        "kept": ~(fails("base-1") | fails(policy)),
        "policy": F.lit(policy),
    })


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first counted by its bit pattern (at most two to the number of rules), so the
    rest does not depend on the number of documents.
    """
    active = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    patterns = rows.groupBy(active.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]
    ])
    each = patterns.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
