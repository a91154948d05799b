"""Temperature mixing of sources to target weights.

``plan``     documents -> a row a source: its token share p, its weight
             p^a / sum(p^a), the tokens it is to give, and how that is realised:
             ``full`` whole passes and, of one more pass, the documents whose
             permutation key is at most ``cut``
``realise``  documents and plan -> a row for each use of a document: ``epoch``
             and ``position`` in the stream

The exponent a in [0, 1] is found by section search, a job a step over one row a
source, in fixed-point sums (the result doesn't depend on the order of
addition). It is the smallest a that keeps every source at or under
``repetition_limit`` passes and at or under ``target_entropy`` (a share of the
entropy of equal weights), so the flattest mix that the limits allow; a = 1, the
sources' own shares, if nothing else does.

``budget`` is in tokens. Without one, the budget is the least for which every
document is used: the source with the fewest passes gets exactly one.

Each pass is a permutation of a source's documents by a hash of the document
and the pass. The last, unfinished pass is realised in blocks: key ranges of a
bounded number of tokens. Sums of blocks find the block in which the budget
ends, and only that block's rows are ordered. No source's documents ever meet in
one task, so a source may hold any part of all rows.

Defined results: a null source is the source ''; a null text has no tokens; rows
without tokens are used as often as their source's others; repeated rows (equal
id and text) are used alike, so a budget may be missed by their number; a table without tokens is used once, each source weighing its share
of rows; an empty table gives no row. ``realise`` keeps all columns of
documents; columns named epoch or position are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Numbered, pick, stored

REPETITION_LIMIT = 2.0
BLOCK_TOKENS = 1 << 20
SEED = 41
STEPS, WIDTH = 4, 32
#: Fixed-point unit of sums of powers.
ONE = 1 << 36
KEY_BITS = 62
#: Plans of at most so many sources (about 100 bytes each) are broadcast.
BROADCAST_SOURCES = 100_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """What a document's places are drawn from: its id and text, so that
    documents without ids, or with equal ones, have places of their own."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def key_of(row: Column, epoch: Column, seed: int = SEED) -> Column:
    """A document's place in the permutation of a pass: 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(row, epoch.cast("int"), F.lit(seed)), 64 - KEY_BITS)


def _section(shares: DataFrame, fits) -> float:
    """The smallest exponent in [0, 1] that fits (1.0 if none does; what fits
    stays so for larger exponents). ``fits(a, z, h)`` gets the sum of powers and
    the sum of -p^a * ln(p^a)."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        tried = [low + (high - low) * k / WIDTH for k in range(WIDTH + 1)]
        grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(tried)]))
        power = F.pow("p", F.col("g.a"))
        sums = shares.where("p > 0").select("p", grid.alias("g")).groupBy("g.k").agg(F.sum((power * ONE).cast("long")).alias("z"), F.sum((-power * F.col("g.a") * F.ln("p") * ONE).cast("long")).alias("h")).collect()
        good = {r.k for r in sums if fits(tried[r.k], r.z / ONE, r.h / ONE)}
        if not good:
            return 1.0
        first = min(good)
        if first == 0:
            return tried[0]
        low, high = tried[first - 1], tried[first]
    return high


def plan(docs: DataFrame, budget: int | None = None, repetition_limit: float = REPETITION_LIMIT, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """A row a source: source, n_docs, tokens, share, weight, target, passes,
    full, cut. The exponent is the same in each row (``exponent``)."""
    named = pick(docs, doc_id="long", source="string", text="string")
    rows = stored(named.select(row_hash(F.col("doc_id"), F.col("text")).alias("row"), F.coalesce("source", F.lit("")).alias("source"), tokens_of(F.col("text")).alias("n")), "mixing")
    sums = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"))
    total = sums.agg(F.sum("tokens"), F.sum("n_docs"), F.count("*")).first()
    all_tokens, all_docs, n_sources = (int(x or 0) for x in total)
    amount = F.col("tokens") if all_tokens else F.col("n_docs")
    whole = all_tokens or all_docs
    sums = stored(sums.withColumn("p", amount / F.lit(float(whole or 1))), "shares")
    if not whole:
        a, z, spent = 1.0, 1.0, 0.0
    else:
        least, most = sums.where("p > 0").agg(F.min("p"), F.max("p")).first()

        def fits(a: float, z: float, h: float) -> bool:
            spent = budget if budget is not None else whole * z * most ** (1 - a)
            entropy = h / z + math.log(z)
            return spent / whole * least ** (a - 1) / z <= repetition_limit * (1 + 1e-9) and (target_entropy is None or n_sources < 2 or entropy <= target_entropy * math.log(n_sources) + 1e-9)

        a = _section(sums, fits)
        z = sums.where("p > 0").agg(F.sum((F.pow("p", F.lit(a)) * ONE).cast("long"))).first()[0] / ONE
        spent = budget if budget is not None else whole * z * most ** (1 - a)

    weight = F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(0.0)
    aims = sums.withColumn("weight", weight).withColumn("target", F.round(F.col("weight") * F.lit(float(spent))).cast("long"))
    if budget is None:
        aims = aims.withColumn("target", F.greatest("target", amount))  # one pass at least, whatever rounding does
    aims = aims.withColumn("passes", F.when(amount > 0, F.col("target") / amount).otherwise(1.0))
    aims = aims.withColumn("full", F.floor("passes").cast("int"))
    aims = aims.withColumn("rest", F.when(amount > 0, F.col("target") - F.col("full") * amount).otherwise(0).cast("long"))
    aims = aims.withColumn("shift", (KEY_BITS - F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("tokens") / F.lit(float(block_tokens)))))).cast("int"))
    aims = stored(aims.withColumn("exponent", F.lit(a)), "aims")

    # where the last pass ends: block sums, then the rows of one block a source
    unit = F.col("n") if all_tokens else F.lit(1).cast("long")
    open_rows = rows.join(_small(aims, n_sources).where("rest > 0").select("source", "full", "rest", "shift"), "source")
    keyed = open_rows.select("source", unit.alias("n"), "rest", "shift", key_of(F.col("row"), F.col("full"), seed).alias("key")).withColumn("block", F.expr("shiftrightunsigned(key, shift)")).drop("shift")
    blocks = keyed.groupBy("source", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    ordered = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.withColumn("before", F.coalesce(F.sum("n").over(ordered), F.lit(0))).where("before < rest and before + n >= rest").select("source", "block", "before")
    # ``ends`` has a row a source; the block's rows are at most about a block
    inside = keyed.join(_small(stored(ends, "ends"), n_sources), ["source", "block"])
    running = Window.partitionBy("source").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, -1)
    cuts = inside.withColumn("done", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0))).where("done < rest").groupBy("source").agg(F.max("key").alias("cut"))
    out = aims.join(cuts, "source", "left").select("source", "n_docs", "tokens", F.col("p").alias("share"), "weight", "target", "passes", "full", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"), "exponent")
    return stored(out, "plan")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of ``rows`` rows if that is few; else leave the join,
    whose both sides come from stored tables, to adaptive execution, which
    splits hot sources."""
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def realise(docs: DataFrame, mix: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents' rows, one for each use, with epoch and position in [0, 1)."""
    own = Numbered(docs)
    columns = [(n, c) for n, c in zip(own.names, own.own, strict=True) if c.lower() not in ("epoch", "position")]
    short = mix.select(F.col("source").alias("mix_source"), "full", "cut", "passes")
    rows = own.rows.withColumn("row", row_hash(own.column("doc_id", "long"), own.column("text", "string"))).withColumn("own_source", F.coalesce(own.column("source", "string"), F.lit("")))
    joined = rows.join(_small(short, mix.count()), F.col("own_source") == F.col("mix_source"))
    uses = F.col("full") + (key_of(F.col("row"), F.col("full"), seed) <= F.col("cut")).cast("int")
    used = joined.withColumn("epoch", F.explode(F.when(uses > 0, F.sequence(F.lit(0), uses - 1)).otherwise(F.expr("cast(array() as array<int>)"))))
    # positions of a pass spread over that pass's part of the stream
    position = (F.col("epoch") + key_of(F.col("row"), F.col("epoch"), seed) / F.lit(float(1 << KEY_BITS))) / F.greatest(F.col("passes"), F.col("epoch") + 1.0)
    return used.select(*[n for n, _ in columns], "epoch", position.alias("position")).toDF(*[c for _, c in columns], "epoch", "position")
