"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents, in order of shard and id, are a stream of tokens that is
cut into blocks of ``block_tokens``. A document lies in the block where it
starts, and a block that a long document fills beyond its end counts as many
seats as it covers, so every seat stands for the same number of tokens. A
source's k-th seat (k = 0, 1, ...) has the quotient weight / (2k + 1), and the
highest quotients over all sources win, up to the first seat that a source named
in the weights can't fill: that many seats the supply allows. Each source's
quota is then split over shards by the same rule, in proportion to the seats
the shards hold, and each shard picks its blocks in a seeded order.

Only (id, source, tokens) take part. Places in the streams are a prefix sum over
ranges of all rows, so a source that holds a third of them is no task's work
alone; the driver sees one row per source and shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, few, free_names, materialise

BLOCK_TOKENS = 4096
SHARDS = 16
NO_SOURCE = ""


def sainte_lague(weights: list[float], available: list[int], seats: int) -> list[int]:
    """Seats per party by highest quotients weight / (2k + 1), at most ``available``.

    Ties go to the party that comes first. A divisor close below the last
    winning quotient hands out nearly all seats at once; a heap the rest.
    """
    seats = min(seats, sum(a for a, w in zip(available, weights) if w > 0))
    if seats <= 0:
        return [0] * len(weights)

    def handed(cut: float) -> list[int]:
        # quotients strictly above cut: 2k + 1 < w / cut
        return [min(a, max(0, int(-(-(w / cut - 1) // 2)))) if w > 0 else 0 for w, a in zip(weights, available)]

    low, high = 0.0, max(weights) * 2
    for _ in range(80):
        mid = (low + high) / 2
        if mid > 0 and sum(handed(mid)) <= seats:
            high = mid
        else:
            low = mid
    # step back so that rounding in w / cut can't have given a seat too many
    got = [max(0, g - 1) for g in handed(high)]
    heap = [(-w / (2 * g + 1), i) for i, (w, a, g) in enumerate(zip(weights, available, got)) if w > 0 and g < a]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < available[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def reachable(weights: list[float], available: list[int], limits: list[bool]) -> int:
    """Seats handed out before the first one that a limiting party can't fill.

    Without limiting parties that is all of them. Parties that don't limit pass
    over the seats that they lack.
    """
    missing = [(-w / (2 * a + 1), i) for i, (w, a, on) in enumerate(zip(weights, available, limits)) if on and w > 0]
    if not missing:
        return sum(a for a, w in zip(available, weights) if w > 0)
    cut, first = min(missing)
    total = 0
    for i, (w, a) in enumerate(zip(weights, available)):
        if w <= 0:
            continue
        before = lambda k: (-w / (2 * k + 1), i) < (cut, first)  # noqa: B023, E731
        k = min(a, max(0, int((w / -cut - 1) // 2)))
        # rounding in w / cut may be one off either way
        while k < a and before(k):
            k += 1
        while k > 0 and not before(k - 1):
            k -= 1
        total += k
    return total


def token_count() -> Column:
    """Stretches between single white-space characters: 0 for an empty text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.translate(t, " \n\t", "")) + 1)


def blocks(docs: DataFrame, block_tokens: int, shards: int) -> DataFrame:
    """(doc_id, source, tokens, shard, before, block): where each document lies.

    ``before`` counts the source's tokens ahead of it. The result is a written
    table.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), token_count().cast("long").alias("tokens"))
    slim = slim.withColumn("shard", F.coalesce(F.pmod("doc_id", F.lit(shards)), F.lit(0)).cast("int"))
    place = ["shard", F.col("doc_id").asc_nulls_first(), "tokens"]
    # ranges of all rows in the streams' order; equal rows are in one range
    ranges = materialise(slim.repartitionByRange("source", *place).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    ahead = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
    offsets = totals.select("source", "part", ahead.alias("ahead"))
    run = Window.partitionBy("source", "part").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranges.withColumn("inside", F.sum("tokens").over(run) - F.col("tokens")).join(offsets, ["source", "part"])
    placed = inside.select("doc_id", "source", "tokens", "shard", (F.col("ahead") + F.col("inside")).alias("before"))
    found = materialise(placed.withColumn("block", F.floor(F.col("before") / F.lit(block_tokens)).cast("long")), "blocks")
    drop_tables(ranges)
    return found


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shards: int = SHARDS,
    seed: int = 17,
    default_weight: float = 1.0,
    seats: int | None = None,
) -> DataFrame:
    """(doc_id, source, tokens, shard, block, source_share, target_share).

    The documents of the mixture, each with its source's share of the mixture's
    tokens and the share that the weights ask for. As many seats are handed out
    as the sources named in ``weights`` (all of them, if it names none) can fill
    at their weights; ``seats`` asks for fewer. Sources that ``weights`` doesn't
    name have ``default_weight`` and give all they have where that is less than
    their part; weight 0 leaves a source out.

    Defined cases: null sources are the source ''; null ids are in shard 0;
    null and empty texts count 0 tokens and lie in the block that is open where
    they come; a source without tokens limits nothing; a long document counts
    the seats it covers, and is taken if its middle lies within what is left of
    the quota; rows that repeat an id are counted each; ties between quotients
    go to the lesser source name, then the lesser shard; an empty table gives
    an empty mixture; other columns are not read.
    """
    spark = docs.sparkSession
    weights = dict(weights or {})
    placed = blocks(docs, block_tokens, shards)
    cut = placed.groupBy("source", "block").agg(F.min("shard").alias("shard"), F.sum("tokens").alias("held"), F.max(F.col("before") + F.col("tokens")).alias("end"))
    totals = placed.groupBy("source").agg(F.sum("tokens").alias("total"))
    # a source's last block is a seat though it isn't full
    covered = F.when(F.col("end") == F.col("total"), F.ceil(F.col("end") / F.lit(block_tokens))).otherwise(F.floor(F.col("end") / F.lit(block_tokens)))
    sized = materialise(cut.join(totals, "source").select("source", "shard", "block", "held", F.greatest(covered - F.col("block"), F.lit(1)).cast("long").alias("seats")), "seats")
    # one row per (source, shard): bounded by sources, not by documents
    held: dict[str, dict[int, int]] = {}
    tokens: dict[str, int] = {}
    for row in sized.groupBy("source", "shard").agg(F.sum("seats").alias("n"), F.sum("held").alias("tokens")).toLocalIterator():
        held.setdefault(row["source"], {})[row["shard"]] = row["n"]
        tokens[row["source"]] = tokens.get(row["source"], 0) + row["tokens"]
    sources = sorted(held, key=lambda s: s.encode())
    weight = [float(weights.get(s, default_weight)) for s in sources]
    available = [sum(held[s].values()) for s in sources]
    limits = [tokens[s] > 0 and (s in weights or not weights) for s in sources]
    most = reachable(weight, available, limits)
    quota = sainte_lague(weight, available, most if seats is None else min(seats, most))
    rows = []
    for source, w, total in zip(sources, weight, quota):
        own = sorted(held[source])
        stock = [held[source][k] for k in own]
        asked = w / (sum(x for x in weight if x > 0) or 1)
        rows += [(source, k, q, asked) for k, q in zip(own, sainte_lague([float(x) for x in stock], stock, total))]
    quotas = spark.createDataFrame(rows, "source string, shard int, quota long, asked double")
    drawn = Window.partitionBy("source", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "block")), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * F.sum("seats").over(drawn) - F.col("seats")
    chosen = materialise(sized.withColumn("middle", middle).join(F.broadcast(quotas), ["source", "shard"]).where("middle <= 2 * quota").select("source", "block", "held", "asked"), "chosen")
    reached = chosen.groupBy("source").agg(F.sum("held").alias("got"), F.first("asked").alias("asked")).withColumn("all", F.sum("got").over(Window.partitionBy(F.lit(0))))
    shares = reached.select("source", F.round(F.col("got") / F.greatest("all", F.lit(1)), 6).alias("source_share"), F.round("asked", 6).alias("target_share"))
    picked = placed.join(chosen.select("source", "block"), ["source", "block"], "left_semi").join(F.broadcast(shares), "source")
    found = materialise(picked.select("doc_id", "source", "tokens", "shard", "block", "source_share", "target_share"), "mixture")
    drop_tables(placed, sized, chosen)
    return found


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` whose documents are in the mixture, all columns kept.

    A row stays if a row of its id is in the mixture; null ids stay if any did.
    """
    (name,) = free_names(docs, "_chosen")
    mixture = mix(docs, **options)
    ids = materialise(mixture.select(F.col("doc_id").alias(name)).distinct(), "chosen")
    drop_tables(mixture)
    # texts stay where they lie while the ids can be sent to them
    return docs.join(few(ids), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


def mix_sql(source: str, columns: str = "doc_id, source, tokens, shard, block, source_share, target_share") -> str:
    """DuckDB: list every seat's quotient, and take them up to the first that isn't there."""
    named = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items())
    names = ", ".join(f"'{k}'" for k in WEIGHTS)
    return f"""
    with slim as (select doc_id, coalesce(source, '') as source, (case when length(coalesce(text, '')) = 0 then 0
        else length(text) - length(translate(text, chr(32) || chr(10) || chr(9), '')) + 1 end)::bigint as tokens, coalesce(doc_id % {SHARDS}, 0)::int as shard from {source}),
    streams as (select *, (sum(tokens) over (partition by source order by shard, doc_id nulls first, tokens rows unbounded preceding) - tokens)::bigint as before,
        (sum(tokens) over (partition by source))::bigint as total from slim),
    placed as (select *, (before // {BLOCK_TOKENS})::bigint as block from streams),
    sized as (select source, block, min(shard) as shard, sum(tokens)::bigint as held, greatest(1,
        (case when max(before + tokens) = max(total) then (max(total) + {BLOCK_TOKENS} - 1) // {BLOCK_TOKENS} else max(before + tokens) // {BLOCK_TOKENS} end) - block)::bigint as seats
        from placed group by source, block),
    stock as (select source, shard, sum(seats)::bigint as n from sized group by all),
    whole as (select source, sum(n)::bigint as n, (case source {named} else 1.0 end)::double as weight from stock group by source),
    offers as (select source, k, n, weight / (2 * k + 1) as q from (select source, weight, n, unnest(range(n + 1)) as k from whole)),
    ordered as (select *, row_number() over (order by q desc, source) as place from offers),
    lacking as (select coalesce(min(place), 9223372036854775807) as place from ordered join (select source, max(total) as total from placed group by source) using (source)
        where k = n and total > 0 and source in ({names})),
    won as (select source, count(*) as quota from ordered where k < n and place < (select place from lacking) group by source),
    split as (select source, shard, row_number() over (partition by source order by n / (2 * k + 1)::double desc, shard) as place
        from (select source, shard, n, unnest(range(n)) as k from stock)),
    quotas as (select source, shard, count(*) as quota from split join won using (source) where place <= quota group by all),
    drawn as (select source, shard, block, held, 2 * sum(seats) over (partition by source, shard order by md5(concat_ws(':', '17', source, block)), block rows unbounded preceding) - seats as middle from sized),
    chosen as (select source, block, held from drawn join quotas using (source, shard) where middle <= 2 * quota),
    shares as (select source, round(sum(held) / greatest((select sum(held) from chosen), 1), 6) as source_share, round(max(weight) / (select sum(weight) from whole), 6) as target_share
        from chosen join whole using (source) group by source)
    select {columns} from placed join shares using (source) semi join chosen using (source, block)"""


ORACLE = mix_sql("documents")
