"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Documents are counted into cells of source, language and topic. The tokens asked of the cells, in the beginning a share
of their own, are raked to each marginal in turn, by a grouped sum over the cells of each value, ROUNDS times over. No
cell gives more tokens than it has: what full cells can't give is asked of the value's other cells, so a target is met
wherever its value has the tokens. At the end one scale for all cells makes the expected tokens the budget, and each
cell's documents are kept with probability min(1, asked / tokens). Only cells are raked, and a document's draw is a hash
of its id, so nothing depends on how rows are dealt, and no row is moved for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import WORD, checkpoint, text_of

DIMS = ("source", "lang", "topic")
#: Targets: shares by value, or the power of its tokens that a value's share is in proportion to.
MARGINALS: dict[str, dict[str, float] | float] = {
    "source": 0.5,
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13},
    "topic": {"prose": 0.8, "lines": 0.1, "short": 0.04, "table": 0.03, "symbols": 0.02, "capitals": 0.01},
}
BUDGET = 0.6
ROUNDS, SCALINGS = 8, 6
#: Cells up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """The form of a text: short, table, symbols, capitals, lines or prose."""
    count = lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c)))
    symbols = count("#") + count("$") + count("%") + count("&") + count("*")
    return (
        F.when(words < 50, "short")
        .when(count("|") * 5 > words, "table")
        .when(symbols * 4 > words, "symbols")
        .when(~text.rlike("[a-z]"), "capitals")
        .when(count("\n") * 8 > words, "lines")
        .otherwise("prose")
    )


def _target(cells: DataFrame, dim: str, rule: dict[str, float] | float) -> DataFrame:
    """(dim, target): shares of the values present, which add up to 1; values a rule doesn't list keep their own share."""
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("own"))
    if isinstance(rule, (int, float)):
        raw = F.pow(F.col("own").cast("double"), F.lit(float(rule)))
        total = by.agg(F.sum(raw)).first()[0] or 1.0
        return by.select(dim, (raw / total).alias("target"))
    total = by.agg(F.sum("own")).first()[0] or 1
    listed = F.lit(None).cast("double")
    for value, share in sorted(rule.items()):
        listed = F.when(F.col(dim) == value, F.lit(float(share))).otherwise(listed)
    sums = by.where(F.col("own") > 0).agg(F.sum(listed), F.sum(F.when(listed.isNull(), F.col("own")))).first()
    rest = float(sums[1] or 0) / total
    return by.select(dim, F.coalesce(listed / (sums[0] or 1.0) * (1 - rest), F.col("own") / total).alias("target"))


def rake(cells: DataFrame, marginals: dict[str, dict[str, float] | float], budget: float, rounds: int = ROUNDS) -> DataFrame:
    """Cells with `asked`: tokens whose lesser with the cell's own, added up by value, come to the targets of the budget.

    A turn is a sum by value, combined before its shuffle, which all cells of the value then get. Its factor is one step
    of Newton's method for the sum of min(tokens, factor * asked), which is concave in the factor; it is never less than
    the factor that would do if no cell were full. Of a value with fewer tokens than its target all cells are asked for
    twice what they have, or more. An empty table of cells gives an empty one; cells without tokens are asked for none.
    """
    row = cells.agg(F.sum("tokens"), *[F.count_distinct(d) for d in marginals]).first()
    need = F.lit(budget * float(row[0] or 0))
    few = {d: n <= BROADCAST_CELLS for d, n in zip(marginals, row[1:], strict=True)}
    small = lambda by, dim: F.broadcast(by) if few[dim] else by
    for dim, rule in marginals.items():
        cells = cells.join(small(_target(cells.select(dim, "tokens"), dim, rule).withColumnRenamed("target", f"target_{dim}"), dim), dim)
    asked, full = F.col("asked"), F.col("asked") >= F.col("tokens")
    cells = checkpoint(cells.withColumn("asked", F.col("tokens") * F.lit(float(budget))))
    for _ in range(rounds):
        for dim in marginals:
            by = cells.groupBy(dim).agg(
                (F.max(f"target_{dim}") * need).alias("target"),
                F.sum("tokens").alias("own"),
                F.sum("asked").alias("all"),
                F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("taken"),
                F.sum(F.when(~full, asked)).alias("open"),
                F.max(F.try_divide(F.col("tokens"), asked)).alias("most"),
            )
            step = F.greatest(F.try_divide(F.col("target") - F.col("taken"), F.col("open")), F.try_divide(F.col("target"), F.col("all")), F.lit(0.0))
            by = by.select(dim, F.when(F.col("target") >= F.col("own"), F.coalesce(F.col("most") * 2, F.lit(0.0))).otherwise(step).alias("factor"))
            cells = checkpoint(cells.join(small(by, dim), dim).withColumn("asked", asked * F.col("factor")).drop("factor"))
    return cells


def probabilities(cells: DataFrame, budget: float, scalings: int = SCALINGS) -> DataFrame:
    """Raked cells with `prob`, and `weight`, the cell's share of the kept tokens.

    All cells are scaled alike until they give the budget, by as many steps of the same method. Cells without tokens have
    probability 1, and so have all if the budget is all tokens.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    need, scale = budget * total, 1.0
    for _ in range(scalings):
        asked = F.col("asked") * scale
        full = asked >= F.col("tokens")
        taken, open_, whole = (float(x or 0) for x in cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, asked)), F.sum(asked)).first())
        if whole:
            scale *= max((need - taken) / open_ if open_ else 0.0, need / whole)
    given = F.col("tokens") if budget >= 1 else F.least(F.col("asked") * scale, F.col("tokens"))
    prob = F.when(F.col("tokens") > 0, given / F.col("tokens")).otherwise(F.lit(1.0))
    return cells.withColumn("prob", prob).withColumn("weight", given / F.lit(need or 1.0))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, marginals: dict[str, dict[str, float] | float] = MARGINALS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with doc_id, source, lang, topic, n_tokens, weight (of its cell), prob, kept, and `keep`.

    `budget` is the share of all tokens to keep in expectation, `weight` the cell's share of these. Values with tokens
    enough have their targets; what the others lack is shared out over all cells. Null sources and languages are the empty
    string, null texts have no tokens; documents of a cell without tokens are kept. Rows of one id are drawn alike; an
    empty table gives an empty one; columns not in `keep` are left out.
    """
    text = text_of("text")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select("doc_id", name("source"), name("lang"), text.alias("body"), n_words(text).alias("n_tokens"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    base = base.select("*", topic_of(F.col("body"), F.col("n_tokens")).alias("topic")).drop("body")
    cells = checkpoint(base.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    cells = checkpoint(probabilities(rake(cells, {d: marginals[d] for d in DIMS}, budget, rounds), budget).select(*DIMS, "weight", "prob"))
    joined = base.join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, list(DIMS))
    return joined.select("doc_id", *DIMS, "n_tokens", "weight", "prob", (draw(F.col("doc_id"), seed) < F.col("prob")).alias("kept"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def _oracle() -> str:
    count = lambda c: f"(length(body) - length(replace(body, {c}, '')))"
    symbols = " + ".join(count(f"'{c}'") for c in "#$%&*")
    parts = [
        rf"d AS (SELECT *, CASE WHEN n_tokens < 50 THEN 'short' WHEN {count("'|'")} * 5 > n_tokens THEN 'table' WHEN ({symbols}) * 4 > n_tokens THEN 'symbols' WHEN NOT regexp_matches(body, '[a-z]') THEN 'capitals' WHEN {count('chr(10)')} * 8 > n_tokens THEN 'lines' ELSE 'prose' END AS topic"
        rf" FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS body, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents))",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, rule in MARGINALS.items():
        by = f"(SELECT {dim}, sum(tokens) AS own FROM c GROUP BY {dim})"
        if isinstance(rule, float):
            parts.append(f"t_{dim} AS (SELECT {dim}, pow(own, {rule}) / sum(pow(own, {rule})) OVER () AS target FROM {by})")
        else:
            listed = "CASE " + " ".join(f"WHEN {dim} = '{v}' THEN {s}::DOUBLE" for v, s in rule.items()) + " END"
            parts.append(f"t_{dim} AS (SELECT {dim}, coalesce(l / (sum(l) OVER ()) * (1 - coalesce(sum(own) FILTER (WHERE l IS NULL) OVER (), 0) / sum(own) OVER ()), own / sum(own) OVER ()) AS target FROM (SELECT *, {listed} AS l FROM {by}))")
    parts.append(f"k0 AS MATERIALIZED (SELECT c.*, t_source.target AS target_source, t_lang.target AS target_lang, t_topic.target AS target_topic, tokens * {BUDGET} AS asked, {BUDGET} * sum(tokens) OVER () AS need FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    step = "greatest((target - taken) / nullif(free, 0), target / nullif(whole, 0), 0)"
    n = 0
    for _ in range(ROUNDS):
        for dim in DIMS:
            by = f"SELECT {dim}, max(target_{dim} * need) AS target, sum(tokens) AS own, sum(asked) AS whole, sum(CASE WHEN asked >= tokens THEN tokens ELSE 0 END) AS taken, sum(asked) FILTER (WHERE asked < tokens) AS free, max(tokens / nullif(asked, 0)) AS most FROM k{n} GROUP BY {dim}"
            factor = f"SELECT {dim}, CASE WHEN target >= own THEN coalesce(most * 2, 0) ELSE {step} END AS factor FROM ({by})"
            parts.append(f"k{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (factor) REPLACE (asked * factor AS asked) FROM k{n} JOIN ({factor}) USING ({dim}))")
            n += 1
    parts.append("s0 AS (SELECT 1::DOUBLE AS scale)")
    for i in range(SCALINGS):
        by = f"SELECT any_value(scale) AS scale, any_value(need) AS target, coalesce(sum(tokens) FILTER (WHERE asked * scale >= tokens), 0) AS taken, sum(asked * scale) FILTER (WHERE asked * scale < tokens) AS free, sum(asked * scale) AS whole FROM k{n}, s{i}"
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT CASE WHEN whole > 0 THEN scale * {step} ELSE scale END AS scale FROM ({by}))")
    parts.append(f"p AS (SELECT source, lang, topic, least(asked * scale, tokens) / CASE WHEN need > 0 THEN need ELSE 1 END AS weight, CASE WHEN tokens > 0 THEN least(asked * scale, tokens) / tokens ELSE 1.0 END AS prob FROM k{n}, s{SCALINGS})")
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(prob, 9) AS prob, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < prob AS kept FROM d JOIN p USING (source, lang, topic)"


ORACLE = _oracle()


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *DIMS, "n_tokens", F.round("weight", 9).alias("weight"), F.round("prob", 9).alias("prob"), "kept")
