"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text.  The ledger holds one row
per blob and rule version: the spans that the rules found.  A run reads the ledger, scans only the
pairs of blob and rule version that it does not hold, each once, however many paths share the
blob, and joins the findings back to all paths.

Defined results: a null text is the empty blob; blobs without findings have a row with no spans,
so they are not scanned again; spans of one kind never overlap, spans of two kinds may; ties in
start go by kind as listed; repeated rows and copies get the same findings; an empty table adds
nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import stored
from ledgersieve.llm.spans import matches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length of the part that is measured, and which group that is.
    least: int = 1
    group: int = 0


#: Rule version -> rules, in order of listing.  A published version never changes.
RULES: dict[str, tuple[Rule, ...]] = {
    "2": (
        Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        Rule("access", r"AKIA[A-Z0-9]+", 16),
        # Runs of 32 or more: the same matches as all runs without the shorter ones.
        Rule("hex", r"[0-9a-f]{32,}", 32),
        Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
        Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
        Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    ),
}
CURRENT = "2"
BASE = ("assign", "access", "hex")


def addressed(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``path``, ``blob`` and ``content`` of every version."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), F.sha2(content.cast("binary"), 256).alias("blob"), content.alias("content"))


def _by(rule: Rule, place: int) -> Column:
    def long_enough(span: Column) -> Column:
        part = F.regexp_extract(span["found"], rule.pattern, rule.group) if rule.group else span["found"]
        return F.length(part) >= rule.least

    def named(span: Column) -> Column:
        return F.struct(
            span["start"].alias("start"), F.lit(place).alias("place"), span["end"].alias("end"), F.lit(rule.kind).alias("kind")
        )

    return F.transform(F.filter(matches(F.col("content"), rule.pattern), long_enough), named)


def _found(version: str) -> Column:
    return F.sort_array(F.concat(*[_by(rule, place) for place, rule in enumerate(RULES[version])]))


def scan(versions: DataFrame, ledger: DataFrame | None = None, version: str = CURRENT) -> DataFrame:
    """New ledger rows (``blob, rules, spans``) for the blobs that the ledger lacks under these rules."""
    unseen = versions.select("blob", "content")
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rules") == version).select("blob"), "blob", "left_anti")
    once = unseen.groupBy("blob").agg(F.first("content").alias("content"))
    return once.select("blob", F.lit(version).alias("rules"), _found(version).alias("spans"))


def updated(docs: DataFrame, ledger: DataFrame | None = None, version: str = CURRENT, **columns) -> DataFrame:
    """The ledger with this run's rows, read from the shared folder."""
    fresh = stored(scan(addressed(docs, **columns), ledger, version), "secret-ledger")
    return fresh if ledger is None else ledger.unionByName(fresh)


def findings(docs: DataFrame, ledger: DataFrame, version: str = CURRENT, **columns) -> DataFrame:
    """``path, blob, spans`` of every version; only blobs with findings take part in the join."""
    hit = ledger.filter((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans")
    paths = addressed(docs, **columns).select("path", "blob")
    none = F.array().cast(ledger.schema["spans"].dataType)
    return paths.join(hit, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
