"""Best similar value from another list, exact at the threshold and without comparing all pairs.

Two texts whose indel ratio reaches the threshold share enough character grams
(blank-padded pairs of characters; single characters below two thirds).  With
grams ordered rarest first, they must agree on one of the first few: that prefix
is the join key.  A length test and Spark's own bounded ``levenshtein`` (never
above the indel distance) thin the candidates before any score is computed.
Where many values share a key, they are searched instead of paired.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.similarity import Nearest, plain, similarity, sorted_tokens


def _grams(text: Column, size: int) -> Column:
    """Numbered grams, so a repeated gram counts as often as it occurs."""
    if size == 2:
        text = F.concat(F.lit(" "), text, F.lit(" "))
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))),
        lambda i: text.substr(i, F.lit(size)),
    )
    return F.transform(
        cut,
        lambda g, i: F.concat(
            g, F.lit("#"), F.size(F.filter(F.slice(cut, 1, i + 1), lambda h: h == g)).cast("string")
        ),
    )


def _prefix_length(n: Column, threshold: float, size: int) -> Column:
    """Grams to keep of a text of length n so that a partner at the threshold must share one."""
    t = threshold / 100.0
    if size == 2:
        grams, needed = n + 1, F.ceil((1.5 * t - 1) * 2 * n / (2 - t) + 1 - 1e-9)
    else:
        grams, needed = n, F.ceil(t * n / (2 - t) - 1e-9)
    return F.greatest(F.lit(1), grams - F.greatest(needed, F.lit(1)) + 1).cast("int")


def signatures(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``scope, text, match, length, gram`` of both sides, named by ``l`` and ``r``: the grams of which a partner must share one.

    ``left`` and ``right`` hold distinct ``scope, text, match`` rows: the value, and
    the form of it that is compared.
    """
    size = 2 if threshold >= 200 / 3 else 1

    def signed(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "scope", F.col("text").alias(name), F.col("match").alias(f"{name}_match"),
            F.length("match").alias(f"{name}_len"), F.explode(_grams(F.col("match"), size)).alias("gram"),
        )

    grams_left, grams_right = signed(left, "l"), signed(right, "r")
    rarity = grams_right.groupBy("scope", "gram").agg(F.count("*").alias("rarity"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        """Rank the grams inside each text: as many rows as the text has characters."""
        ranked = df.join(rarity, ["scope", "gram"], "left").groupBy(
            "scope", name, f"{name}_match", f"{name}_len"
        ).agg(
            F.array_sort(
                F.collect_list(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), F.col("gram")))
            ).alias("grams")
        )
        kept = F.slice("grams", F.lit(1), _prefix_length(F.col(f"{name}_len"), threshold, size))
        first = F.transform(kept, lambda g: g["gram"])
        return ranked.select("scope", name, f"{name}_match", f"{name}_len", F.explode(first).alias("gram"))

    return prefix(grams_left, "l"), prefix(grams_right, "r")


def candidate_pairs(signed_left: DataFrame, signed_right: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``scope, l, r`` that share a signature and can reach the threshold; only values of the same scope are paired."""
    close = 200.0 * F.least("l_len", "r_len") >= threshold * (F.col("l_len") + F.col("r_len"))
    pairs = (
        signed_left.join(signed_right, ["scope", "gram"])
        .where(close)
        .groupBy("scope", "l", "r").agg(F.first("l_match").alias("l_match"), F.first("r_match").alias("r_match"))
    )
    total = F.length("l_match") + F.length("r_match")
    distance = F.floor((100.0 - threshold) / 100.0 * total + 1e-9).cast("int")
    return pairs.where(F.levenshtein("l_match", "r_match") <= distance)


# Signatures that many right texts share are searched instead of paired: no row per pair is made.

CROWDED = 200  # right texts with one gram, above which they are searched
SEARCHED_RIGHT, SEARCHED_LEFT = 20_000, 5_000  # texts of either side in one search


def _crowds(signed_right: DataFrame) -> DataFrame:
    """``scope, gram, rights`` of the grams that many right texts have as signature."""
    return signed_right.groupBy("scope", "gram").agg(F.count("*").alias("rights")).where(F.col("rights") > CROWDED)


def search_crowds(signed_left: DataFrame, signed_right: DataFrame, crowds: DataFrame, threshold: float) -> DataFrame:
    """``scope, l, r, score``: the best partner of every left text in every crowd that it has to look through.

    The right texts of a gram are cut into parts of bounded size, and so are the left texts that
    come for them.  A right text's first crowd, its largest, finds it for all left texts that share this
    gram, so a left text leaves out a crowd whose members it meets in their first ones.
    """
    in_crowd = ["scope", "gram"]
    right, left = signed_right.join(crowds, in_crowd), signed_left.join(crowds, in_crowd)
    firsts = right.groupBy("scope", "r").agg(F.max_by("gram", F.struct("rights", "gram")).alias("first"))
    met = right.select("scope", "gram", "r").join(firsts, ["scope", "r"]).groupBy("scope", "gram").agg(F.collect_set("first").alias("firsts"))  # of grams
    own = left.groupBy("scope", "l").agg(F.collect_set("gram").alias("own"))  # a text's
    coming = left.join(own, ["scope", "l"]).join(met, in_crowd).where(
        F.exists("firsts", lambda f: (f == F.col("gram")) | ~F.array_contains("own", f))
    )
    lefts = coming.groupBy("scope", "gram").agg(F.count("*").alias("lefts"))

    def parts(count: str, size: int) -> Column:
        return F.ceil(F.col(count) / size).cast("int")

    def dealt(df: DataFrame, name: str, own_part: str, own_parts: Column, other_part: str, other_parts: Column) -> DataFrame:
        placed = df.select(*in_crowd, name, f"{name}_match", F.pmod(F.xxhash64(name), own_parts).cast("int").alias(own_part), other_parts.alias("n"))
        return placed.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    cuts = (parts("rights", SEARCHED_RIGHT), parts("lefts", SEARCHED_LEFT))
    sides = [
        dealt(coming.join(lefts, in_crowd), "l", "left_part", cuts[1], "right_part", cuts[0]),
        dealt(right.join(lefts, in_crowd), "r", "right_part", cuts[0], "left_part", cuts[1]),
    ]
    by = [*in_crowd, "right_part", "left_part"]
    tasks = int(signed_left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be merged

    def search(wanted: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        tree = Nearest(list(zip(known["r_match"], known["r"])), threshold) if len(wanted) and len(known) else None
        found = [(s, t, *best) for s, t, m in zip(wanted["scope"], wanted["l"], wanted["l_match"]) if tree and (best := tree.best(m))]
        return pd.DataFrame(found, columns=["scope", "l", "r", "score"])

    left_groups, right_groups = (side.repartition(tasks, *by).groupBy(*by) for side in sides)
    return left_groups.cogroup(right_groups).applyInPandas(search, "scope string, l string, r string, score double")


# The composite score.  Every text gives keys of several kinds, and two texts are compared that share a key of one kind.

_TOKENS = "filter(split({0}, '\\\\s+'), t -> t <> '')"
_SORTED = f"array_join(array_sort({_TOKENS}), ' ')"
_UNIQUE = f"array_sort(array_distinct({_TOKENS}))"


def _forms(df: DataFrame) -> DataFrame:
    """``scope, text, whole, sorted, tokens, once``: the plain form, its tokens in order, and each token once."""
    rows = df.where("length(match) > 0").selectExpr("scope", "text", "match AS whole", f"{_SORTED.format('match')} AS sorted", f"{_UNIQUE.format('match')} AS tokens")
    return rows.withColumn("once", F.array_join("tokens", " "))


def _ranked_keys(left: DataFrame, right: DataFrame, grams: dict[str, float], tokens: float | None) -> list[DataFrame]:
    """``kind, key`` of both sides for the scores that compare whole texts.

    Of the grams of a form, rarest first, as many are keys as a partner at the threshold cannot all
    lack.  Of the tokens, a side looks up the rarest ones that together take up more than it may
    miss, among all tokens of the other side: the shared ones make up ``t / (200 - t)`` of a side
    wherever they lift the score to ``t``.
    """
    size = {form: 2 if t >= 200 / 3 else 1 for form, t in grams.items()}

    def of_kind(kind: str, texts: Column | str) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("item")))

    def items(df: DataFrame) -> DataFrame:
        parts = [of_kind(form, _grams(F.col(form), size[form])) for form in grams] + ([of_kind("token", "tokens")] if tokens else [])
        return df.select("*", F.explode(F.concat(*parts)).alias("i")).select(*df.columns, "i.kind", "i.item")

    sides = [items(left), items(right)]
    rarity = sides[1].groupBy("scope", "kind", "item").agg(F.count("*").alias("rarity"))
    length = reduce(lambda rest, form: F.when(F.col("kind") == form, _prefix_length(F.length(form), grams[form], size[form])).otherwise(rest), grams, F.lit(0))
    out = []
    for own, other, rows in (("l", "r", sides[0]), ("r", "l", sides[1])):
        texts = [c for c in rows.columns if c not in ("kind", "item")]
        ranked = rows.join(rarity, ["scope", "kind", "item"], "left").groupBy(*texts, "kind").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "item"))).alias("items")  # a text's own
        )
        first = F.transform(F.slice("items", F.lit(1), length), lambda i: F.struct(F.col("kind").alias("kind"), i["item"].alias("key")))
        if tokens:
            share = tokens / (200.0 - tokens)
            slack = F.length("once") * (1 - share) + 1e-9
            before = lambda n: F.aggregate(F.slice("items", 1, n), F.lit(0), lambda a, u: a + F.length(u["item"]) + 1)
            looked = F.filter("items", lambda i, n: before(n) <= slack)
            tagged = lambda array, tag: F.transform(array, lambda i: F.struct(F.lit(f"token_{tag}").alias("kind"), i["item"].alias("key")))
            first = F.when(F.col("kind") == "token", F.concat(tagged(looked, own), tagged(F.col("items"), other))).otherwise(first)
        out.append(ranked.select(*texts, F.explode(first).alias("k")).select(*texts, "k.kind", "k.key"))
    return out


def _segment_keys(df: DataFrame, own: str, other: str, kind: str, form: str, threshold: float) -> DataFrame:
    """``kind, key`` for a part of the longer form against the shorter form.

    At the threshold the shorter form, of ``m`` characters, and the best part differ by at most
    ``k = 2 m (100 - threshold) / 100`` insertions and deletions.  Cut into ``k + 1`` segments, one
    of them is untouched, so it stands in the longer form: a text gives its segments, as the shorter
    one, and its substrings of the sizes that segments have, as the longer one.
    """
    cuts = lambda m: f"CAST(least(floor({m} * {2.0 * (100.0 - threshold) / 100.0!r}D + 1e-9D) + 1, {m}) AS INT)"
    m, n = f"length({form})", cuts(f"length({form})")
    start = lambda i: f"CAST(floor({i} * {m} / {n}) AS INT)"
    segments = f"transform(sequence(0, {n} - 1), i -> substr({form}, {start('i')} + 1, {start('(i + 1)')} - {start('i')}))"
    sizes = f"array_distinct(flatten(transform(sequence(1, {m}), m -> array(CAST(floor(m / {cuts('m')}) AS INT), CAST(ceil(m / {cuts('m')}) AS INT)))))"
    substrings = f"flatten(transform({sizes}, s -> transform(sequence(1, {m} - s + 1), i -> substr({form}, i, s))))"
    keys = [f"transform(array_distinct({texts}), x -> named_struct('kind', '{kind}_{tag}', 'key', x))" for texts, tag in ((segments, own), (substrings, other))]
    columns = df.columns
    return df.where(f"length({form}) > 0").selectExpr("*", f"explode(concat({keys[0]}, {keys[1]})) AS k").select(*columns, "k.kind", "k.key")


def _first_sharing_a_token(left: DataFrame, right: DataFrame, lo: float, hi: float) -> DataFrame:
    """Per left text the first right text, in order, that shares a token and is ``lo`` to ``hi`` times as long or short.

    A shared token gives all such pairs one and the same score, so only the first can be the best
    by it; right texts are folded by token and length, and no pair of them is ever made.
    """
    folded = right.selectExpr("scope", "text AS r", "length(whole) AS r_len", "explode(tokens) AS token").groupBy("scope", "token", "r_len").agg(F.min("r").alias("r"))
    wanted = left.selectExpr("scope", "text AS l", "length(whole) AS l_len", "explode(tokens) AS token")
    return wanted.join(folded, ["scope", "token"]).where(_apart("l_len", "r_len", lo, hi)).groupBy("scope", "l").agg(F.min("r").alias("r"))


def _apart(a: str, b: str, lo: float, hi: float) -> str:
    """Whether one length is ``lo`` to ``hi`` times the other; ``lo`` itself counts for the first step only."""
    longer = f"greatest({a}, {b}) / least({a}, {b})"
    return f"{longer} {'>=' if lo == rules.PARTIAL_FROM else '>'} {lo!r}D" + (f" AND {longer} <= {hi!r}D" if hi != float("inf") else "")


def composite_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs among which the best composite match at the threshold is, for every left text.

    Each part of the score has keys of its own that lose none of the pairs for which that part
    reaches the threshold: whole texts and sorted tokens by grams, shared tokens by their share of
    a side, parts of longer texts by segments.  Only pairs whose sole merit is a shared token, which
    all score the same, are represented by the first of them.
    """
    left, right = _forms(left), _forms(right)
    by_token = threshold / rules.TOKEN_WEIGHT
    whole = by_token <= 100
    keys = _ranked_keys(left, right, {"whole": threshold} | ({"sorted": by_token, "once": by_token} if whole else {}), by_token if whole else None)
    near = f"greatest(length(l.whole), length(r.whole)) < {rules.PARTIAL_FROM!r}D * least(length(l.whole), length(r.whole))"

    def within(a: str, b: str, limit: float) -> str:
        total = f"(length({a}) + length({b}))"
        close = f"200.0D * least(length({a}), length({b})) >= {limit!r}D * {total}"
        return f"{close} AND levenshtein({a}, {b}) <= CAST(floor({(100.0 - limit) / 100.0!r}D * {total} + 1e-9D) AS INT)"

    common = "array_intersect(l.tokens, r.tokens)"
    in_front = [f"array_join(concat({common}, array_except({side}.tokens, {common})), ' ')" for side in ("l", "r")]
    tests = {"whole": within("l.whole", "r.whole", threshold)}
    if whole:
        share = by_token / (200.0 - by_token)
        tests |= {"sorted": f"{near} AND {within('l.sorted', 'r.sorted', by_token)}", "once": f"{near} AND {within(*in_front, by_token)}"}
        tests |= {f"token_{s}": f"{near} AND length(array_join({common}, ' ')) >= length({s}.once) * {share!r}D - 1e-9D" for s in ("l", "r")}
    shared = []
    for i, (lo, hi, weight) in enumerate(rules.PARTIAL_WEIGHTS):
        for form, needed in (("whole", threshold / weight), ("sorted", by_token / weight)):
            if needed <= 100:
                keys = [k.unionByName(_segment_keys(df, own, other, f"{form}_{i}", form, needed)) for k, df, own, other in ((keys[0], left, "l", "r"), (keys[1], right, "r", "l"))]
                apart = _apart("length(l.whole)", "length(r.whole)", lo, hi)
                tests |= {f"{form}_{i}_{a}": f"length({a}.{form}) <= length({b}.{form}) AND {apart}" for a, b in (("l", "r"), ("r", "l"))}
        if by_token / weight <= 100:
            shared.append(_first_sharing_a_token(left, right, lo, hi))
    test = " ".join(f"WHEN '{kind}' THEN {condition}" for kind, condition in tests.items())
    met = keys[0].alias("l").join(keys[1].alias("r"), ["scope", "kind", "key"]).where(F.expr(f"CASE kind {test} END"))
    pairs = met.groupBy("scope", F.col("l.text").alias("l"), F.col("r.text").alias("r")).agg(F.first("l.whole").alias("l_match"), F.first("r.whole").alias("r_match"))
    for firsts in shared:
        named = firsts.join(left.selectExpr("scope", "text AS l", "whole AS l_match"), ["scope", "l"]).join(right.selectExpr("scope", "text AS r", "whole AS r_match"), ["scope", "r"])
        pairs = pairs.unionByName(named)
    return pairs


def best_match(left: DataFrame, right: DataFrame, threshold: float, scorer: str = "token_sort") -> DataFrame:
    """``scope, text, best, score`` for every left text whose best score reaches the threshold.

    ``left`` and ``right`` have ``text`` and may have ``scope``.  Ties go to the
    first right text in order.  ``token_sort`` compares trimmed lower-case tokens in order,
    ``ratio`` the text as it is, ``composite`` the plain form.
    """

    def prepare(df: DataFrame) -> DataFrame:
        if "scope" not in df.columns:
            df = df.withColumn("scope", F.lit(""))
        form = {"ratio": F.col, "token_sort": sorted_tokens, "composite": plain}[scorer]
        return df.select("scope", "text").distinct().withColumn("match", form("text"))

    left, right = prepare(left), prepare(right)
    if scorer == "composite":
        pairs = composite_pairs(left, right, threshold)
    else:
        signed_left, signed_right = signatures(left, right, threshold)
        crowds = _crowds(signed_right)
        pairs = candidate_pairs(signed_left, signed_right.join(crowds, ["scope", "gram"], "left_anti"), threshold)
    score = similarity("l_match", "r_match", "composite" if scorer == "composite" else "ratio")
    scored = pairs.select("scope", "l", "r", score.alias("score")).where(F.col("score") >= threshold)
    if scorer != "composite":
        scored = scored.unionByName(search_crowds(signed_left, signed_right, crowds, threshold))
    return (
        scored.groupBy("scope", F.col("l").alias("text"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("r").alias("r"))).alias("top"))
        .select("scope", "text", F.col("top.r").alias("best"), (-F.col("top.s")).alias("score"))
    )
