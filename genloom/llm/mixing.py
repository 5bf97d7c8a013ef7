"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domains, languages and sources. A node's budget is shared among its children by weight, each
child capped by what its leaves can give in MAX_EPOCHS passes; what capped children can't use goes to their siblings by
weight, and only what no sibling can use is left to the ancestor's other children, because a node's cap is the sum of its
leaves'. A leaf's budget is so many whole epochs and a prefix of one more: the documents in the order of a hash seeded by
the epoch, as long as their tokens fit.

Shares are found in closed form from running sums over a parent's children, so the tree is never walked on the driver; the
children of one parent are sorted by one task. The prefix needs no sort of a leaf: tokens are summed by leaf and the leading
digits of the hash, running sums over these buckets find the one that a prefix ends in, a second round does the same inside
it with more digits, and only the documents of that last bucket are sorted. A hot source is spread over all tasks. Words are
counted once, into a narrow table; the documents themselves are read again for the result alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.runtime import materialize, scratch, small_or_not, table

LEAF = ["domain", "language", "source"]
#: Hexadecimal digits of the seeded hash that make a bucket, in each round.
DIGITS = (2, 4)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weights(given: dict[tuple[str, ...], int], cols: list[str]) -> Column:
    """The weight of a node, 1 where none is given; keys are paths from the root."""
    out = F.lit(1)
    for path, weight in given.items():
        if len(path) == len(cols):
            same = F.lit(True)
            for c, v in zip(cols, path, strict=True):
                same = same & (F.col(c) == F.lit(v))
            out = F.when(same, F.lit(int(weight))).otherwise(out)
    return out.cast("double")


def _share(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds alloc: the parent's budget shared by weight under caps. A child is full if the level at which it fills up is
    reached within the budget: caps of those filling earlier plus that level times the weights of the others."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    upto = by.orderBy("level", key).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = nodes.withColumn("level", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    out = out.withColumn("caps", F.sum("cap").over(upto)).withColumn("rest", F.sum("weight").over(by) - F.sum("weight").over(upto))
    full = (F.col("weight") > 0) & (F.col("caps") + F.when(F.col("rest") > 0, F.col("level") * F.col("rest")).otherwise(0.0) <= F.col("budget"))
    out = out.withColumn("full", full)
    used, open_ = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(by), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(by)
    out = out.withColumn("used", used).withColumn("open", open_)
    part = F.when(F.col("full"), F.col("cap")).when(F.col("open") > 0, F.floor((F.col("budget") - F.col("used")) * F.col("weight") / F.col("open"))).otherwise(0.0)
    return out.withColumn("alloc", F.least(part.cast("double"), F.col("cap"))).drop("level", "caps", "rest", "full", "used", "open", "budget", "weight")


def budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], percent: int, max_epochs: int) -> DataFrame:
    """leaves (domain, language, source, tokens) with alloc, the tokens that each is to give; percent is of all tokens."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    alloc = None
    for depth in range(1, len(LEAF) + 1):
        cols = LEAF[:depth]
        nodes = leaves.groupBy(*cols).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weights(weights, cols))
        if alloc is None:
            nodes = nodes.withColumn("budget", F.floor(F.sum("tokens").over(W.partitionBy(F.lit(0))) * percent / 100).cast("double"))
        else:
            nodes = nodes.join(alloc, cols[:-1])
        alloc = _share(nodes, cols[:-1], cols[-1]).select(*cols, F.col("alloc").alias("budget"), "tokens")
        alloc = materialize(alloc, "budgets")
        if depth < len(LEAF):
            alloc = alloc.drop("tokens")
    return alloc.select(*LEAF, "tokens", F.col("budget").cast("long").alias("alloc"))


def mix(docs: DataFrame, domain: Column, language: Column, source: Column, weights: dict[tuple[str, ...], int], percent: int = 100, max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """(row, doc_id, domain, language, source, tokens, epoch): a row for each document and epoch that it is taken in.

    row is a struct of the input's columns. Null branch values count as ''. A document without tokens is taken in every
    whole epoch and in a prefix that reaches it. Rows with equal id share a place in the order: all are taken or none. A
    branch of weight 0 gives nothing. An empty table gives no rows; other columns may have any names.
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    leaf = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip((domain, language, source), LEAF, strict=True)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    with scratch(docs.sparkSession) as made:
        narrow = materialize(docs.select(F.col(id_col).alias("doc_id"), *leaf, tokens.cast("long").alias("tokens")), "counted")
        sums = materialize(narrow.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), "leaves")
        plan = budgets(sums, weights, percent, max_epochs)
        whole = F.when(F.col("tokens") > 0, F.expr("alloc DIV tokens")).otherwise(F.lit(0))
        plan = plan.withColumn("whole", whole.cast("long")).withColumn("left", F.col("alloc") - F.col("whole") * F.col("tokens")).select(*LEAF, "whole", "left")
        plan = materialize(plan, "plan")
        placed = narrow.join(small_or_not(plan), LEAF).withColumn("o", place)
        ends = _ends(placed)
        last = F.substring("o", 1, DIGITS[-1])
        edge = placed.join(small_or_not(ends), LEAF).filter((last == F.col("last")) & (F.col("left") > 0))
        running = F.sum("tokens").over(W.partitionBy(*LEAF).orderBy("o").rangeBetween(W.unboundedPreceding, W.currentRow))
        reached = edge.withColumn("run", running).filter(F.col("before") + F.col("run") <= F.col("left"))
        reached = materialize(reached.select(*LEAF, "o").distinct().withColumn("reached", F.lit(True)), "reached")
        made.keep(plan, ends, reached)
    rows = docs.select(row, F.col(id_col).alias("doc_id"), *leaf, tokens.cast("long").alias("tokens"))
    rows = rows.join(small_or_not(plan), LEAF).withColumn("o", place).join(small_or_not(ends), LEAF, "left").join(small_or_not(reached), [*LEAF, "o"], "left")
    more = (F.col("left") > 0) & (F.col("last").isNull() | (last < F.col("last")) | F.coalesce("reached", F.lit(False)))
    epochs = F.slice(F.sequence(F.lit(0).cast("long"), F.col("whole")), F.lit(1), (F.col("whole") + more.cast("long")).cast("int"))
    return rows.select("row", "doc_id", *LEAF, "tokens", F.explode(epochs).alias("epoch"))


def _ends(placed: DataFrame) -> DataFrame:
    """(domain, language, source, last, before): the bucket of DIGITS[-1] digits that a leaf's prefix ends in and the tokens
    before it; leaves whose prefix is all of them are left out."""
    ends = None
    for digits in DIGITS:
        some = placed if ends is None else placed.join(small_or_not(ends), LEAF).filter(F.col("o").startswith(F.col("last")))
        start = F.lit(0).cast("long") if ends is None else F.col("before")
        held = some.groupBy(*LEAF, "left", start.alias("start"), F.substring("o", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("t"))
        upto = W.partitionBy(*LEAF).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        over = held.withColumn("upto", F.col("start") + F.sum("t").over(upto)).filter(F.col("upto") > F.col("left"))
        first = over.groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
        ends = materialize(first.select(*LEAF, F.col("e.bucket").alias("last"), F.col("e.before").alias("before")), "ends")
    return ends


#: The example tree: sources whose name ends in 0 to 4 are web, the others are books.
DOMAIN_SQL = "CASE WHEN right(source, 1) BETWEEN '0' AND '4' THEN 'web' ELSE 'books' END"
WEIGHTS = {("web",): 2, ("books",): 3, ("web", "en"): 4, ("web", "de"): 2, ("books", "en"): 5, ("books", "fr"): 3, ("web", "en", "src0"): 2}


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.expr(DOMAIN_SQL), F.col("lang"), F.col("source"), WEIGHTS, percent=100, max_epochs=2).drop("row")


def _case(depth: int) -> str:
    cols = LEAF[:depth]
    lines = [f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(cols, path))} THEN {w}" for path, w in reversed(WEIGHTS.items()) if len(path) == depth]
    return f"CASE {' '.join(lines)} ELSE 1 END"


def mixing_sql(docs: str, percent: int, max_epochs: int, seed: int = 1) -> str:
    """CTEs base, b0 to b3 and taken (r, epoch) of the mix of a relation that has r (a row number) and documents' columns."""
    out = [
        f"base AS (SELECT r, doc_id, coalesce({DOMAIN_SQL}, '') AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {docs})",
        f"b0 AS (SELECT floor(sum(tokens) * {percent} / 100)::DOUBLE AS budget FROM base)",
    ]
    for d in range(1, 4):
        cols, parent = ", ".join(LEAF[:d]), ", ".join(LEAF[: d - 1])
        by = f"PARTITION BY {parent}" if parent else ""
        out.append(
            f"""b{d} AS (SELECT {cols}, tokens, least(CASE WHEN is_full THEN cap WHEN opened > 0 THEN floor((budget - used) * weight / opened) ELSE 0.0 END, cap) AS budget FROM (
                SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ({by}) AS used, sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER ({by}) AS opened FROM (
                SELECT *, caps + CASE WHEN rest > 0 THEN cap / weight * rest ELSE 0.0 END <= budget AS is_full FROM (
                SELECT *, sum(cap) OVER (u ROWS UNBOUNDED PRECEDING) AS caps, sum(weight) OVER ({by}) - sum(weight) OVER (u ROWS UNBOUNDED PRECEDING) AS rest FROM (
                SELECT n.*, {"b0.budget" if d == 1 else f"b{d - 1}.budget"} FROM (SELECT {cols}, (sum(tokens) * {max_epochs})::DOUBLE AS cap, sum(tokens) AS tokens, ({_case(d)})::DOUBLE AS weight FROM base GROUP BY {cols}) n
                {"CROSS JOIN b0" if d == 1 else f"JOIN b{d - 1} USING ({parent})"}) WINDOW u AS ({by} ORDER BY cap / weight, {LEAF[d - 1]})))))"""
        )
    out.append(
        f"""plan AS (SELECT {", ".join(LEAF)}, whole, alloc - whole * tokens AS rem FROM (SELECT *, budget::BIGINT AS alloc, CASE WHEN tokens > 0 THEN budget::BIGINT // tokens::BIGINT ELSE 0 END AS whole FROM b3)),
        placed AS (SELECT *, md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM base JOIN plan USING ({", ".join(LEAF)})),
        taken AS (SELECT r, doc_id, {", ".join(LEAF)}, tokens, whole AS epoch FROM (SELECT *, sum(tokens) OVER (PARTITION BY {", ".join(LEAF)} ORDER BY o) AS run FROM placed) WHERE rem > 0 AND run <= rem
                  UNION ALL SELECT r, doc_id, {", ".join(LEAF)}, tokens, unnest(range(0, whole)) AS epoch FROM placed)"""
    )
    return ",\n".join(out)


QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": f"WITH docs AS (SELECT row_number() OVER () AS r, * FROM documents), {mixing_sql('docs', 100, 2)} SELECT doc_id, {', '.join(LEAF)}, tokens, epoch FROM taken"}
