"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a permuted order (by digest of the identifier)
and form one stream of words; a stream is passed up to three times.  The stream
is cut into blocks of equally many words, a document belongs to the block in
which it starts, and a source's quota is the number of blocks that its target
needs (the last document is cut so that the words are exact).  A binary tree
splits the quotas of all sources among the output shards: at each node the left
half's share is a multivariate-hypergeometric draw, so every shard gets the same
number of blocks and a random mix of sources.  Each shard then takes its own run
of the source's permuted blocks and orders its documents at random.

Only DataFrame functions are used.  No source is ever gathered in one task: the
order is built in ``GROUPS`` digest ranges per source, whose word totals give the
offsets.  What single tasks hold is one row per source, or one row per tree node.

Defined results: a null text has size 0; a source of size 0 gets target 0; a
null source is a source of its own, ranked last; equal rows are separate rows;
rows without an identifier are ordered by a digest of all their columns; an empty table
gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import SPACE, WORD, materialise, table, text_of, uniform

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
GROUP_DIGITS = 3            # 16**3 digest ranges per source
BLOCKS_PER_SHARD = 64
SHARDS = 64


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: one row per source.

    Shares by weight, none above ``most`` times its source.  With the sources in
    order of cap per weight, those at their cap are a prefix: a source is at its
    cap if the level that would be left for it and all later ones exceeds its own.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    ranked = (sizes.withColumn("weight", weight)
              .withColumn("cap", (F.col("source_size") * most).cast("double"))
              .withColumn("level", F.col("cap") / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
              .withColumn("free", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("share", F.col("free") / F.sum("weight").over(after))
              .withColumn("capped", F.col("level") < F.col("share")))
    # the first source below its cap has the common level; later shares only fall
    level = F.max(F.when(~F.col("capped"), F.col("share"))).over(Window.partitionBy())
    return ranked.withColumn("open_level", level).select(
        "source", "source_size",
        F.when(F.col("capped") | F.col("open_level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("weight") * F.col("open_level"))).alias("target"))


def permuted(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``id, size, source, grp, digest`` per row; ordered by digest a source's rows are permuted."""
    named = F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))
    nameless = F.concat(F.lit(f"{seed}|"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    digest = F.md5(F.coalesce(named, nameless))
    return docs.select(F.col(id_col).alias("id"), word_count(text_col).alias("size"),
                       F.col(source_col).cast("string").alias("source"), digest.alias("digest")
                       ).withColumn("grp", F.substring("digest", 1, GROUP_DIGITS))


def _split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source no, blocks`` to ``source no, shard, blocks``: the leaves of the splitting tree.

    A node is one row with the block counts of all sources.  Its left child gets
    half the blocks: each block in turn goes left with probability (places left)
    / (blocks left), which is a multivariate-hypergeometric draw of the counts.
    """
    node = (quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("no", "blocks"))).alias("list"))
            .select(F.lit(0).alias("node"), F.col("list.no").alias("no"), F.col("list.blocks").alias("counts")))
    for depth in range(int(math.log2(shards))):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        state = F.struct(((F.col("total") + 1) / 2).cast("long").alias("places"), F.col("total").alias("left"),
                         F.array().cast("array<bigint>").alias("drawn"))

        def draw(places, left, count):
            """Blocks of one source that go left, from its ``count`` in turn."""
            turns = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(
                F.array().cast("array<bigint>"))
            return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("n"), places.alias("p"), left.alias("r")),
                               lambda s, i: F.when(
                uniform(F.lit(seed), F.lit(depth), F.col("node"), s["r"]) * s["r"] < s["p"],
                F.struct((s["n"] + 1).alias("n"), (s["p"] - 1).alias("p"), (s["r"] - 1).alias("r"))).otherwise(
                F.struct(s["n"].alias("n"), s["p"].alias("p"), (s["r"] - 1).alias("r"))))

        def step(s, count):
            took = draw(s["places"], s["left"], count)["n"]
            return F.struct((s["places"] - took).alias("places"), (s["left"] - count).alias("left"),
                            F.concat(s["drawn"], F.array(took)).alias("drawn"))

        split = (node.withColumn("total", total)
                 .withColumn("drawn", F.aggregate("counts", state, step)["drawn"]))
        rest = F.zip_with("counts", "drawn", lambda c, d: c - d)
        node = split.select("no", F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("drawn").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("counts")))).alias("half")
        ).select("half.node", "no", "half.counts")
    return node.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("no", "counts")).alias("x")).select(
        F.col("x.no").alias("no"), "shard", F.col("x.counts").alias("blocks"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, shards: int = SHARDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)`` of the mix.

    ``rows``: ``id, size, source, source_size, target, grp, place`` per input row;
    ``(source, grp, place)`` names the row.
    ``pieces``: ``source, grp, place, id, pass, words, block, shard, position``, one
    per document and pass that the mix takes; ``words`` counts from the text's start.
    ``shards`` must be a power of two.  There are about ``BLOCKS_PER_SHARD * shards``
    blocks, whatever the input; only their counts pass through the tree's first task.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    base = materialise(permuted(docs, id_col, text_col, source_col, seed), "mix-sizes")
    groups = base.groupBy("source", "grp").agg(F.sum("size").alias("words"))
    targets = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    targets = (targets.withColumn("quota", F.round("target").cast("long"))
               .withColumn("block_words", F.greatest(F.lit(1), F.ceil(
                   F.sum("source_size").over(Window.partitionBy()) / (BLOCKS_PER_SHARD * shards))).cast("long"))
               .withColumn("blocks", F.ceil(F.col("quota") / F.col("block_words")).cast("long"))
               .withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    targets = materialise(targets, "mix-targets")

    # offsets: word totals of the digest ranges, then the order inside each range
    upto = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    inside = Window.partitionBy("source", "grp").orderBy("digest", "id", "size")
    placed = (base
              .withColumn("place", F.row_number().over(inside))
              .withColumn("ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    s = starts.select(F.col("source").alias("s_source"), F.col("grp").alias("s_grp"), "start")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "quota", "block_words", "no")
    # the group table has at most 16**GROUP_DIGITS rows a source, the target table one
    rows = (placed.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("grp") == F.col("s_grp")))
            .join(t, F.col("source").eqNullSafe(F.col("t_source")))
            .withColumn("first", F.col("start") + F.col("ahead"))
            .drop("s_source", "s_grp", "t_source", "start", "ahead", "digest"))
    rows = materialise(rows, "mix-rows")

    at = F.col("first") + F.col("pass") * F.col("source_size")
    drawn = (rows.where("size > 0")
             .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
             .withColumn("words", F.least(F.col("size"), F.col("quota") - at))
             .where("words > 0")
             .withColumn("block", F.floor(at / F.col("block_words")).cast("long")))

    leaves = _split_tree(targets.select("no", "blocks"), shards, seed)
    runs = (leaves.withColumn("upto", F.sum("blocks").over(Window.partitionBy("no").orderBy("shard")))
            .where("blocks > 0")
            .select("no", "shard", F.explode(F.sequence(F.col("upto") - F.col("blocks"), F.col("upto") - 1)).alias("turn")))
    # a source's blocks in random order: shard runs of that order are disjoint draws
    order = Window.partitionBy("no").orderBy(F.xxhash64(F.lit(seed), "no", "block"), "block")
    blocks = (targets.where("blocks > 0")
              .select("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
              .withColumn("turn", (F.row_number().over(order) - 1).cast("long")))
    homes = blocks.join(runs, ["no", "turn"]).select("no", "block", "shard")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "no", "grp", "place", "pass"), "no", "grp",
                                                   "place", "pass")
    pieces = (drawn.join(homes, ["no", "block"])
              .withColumn("position", F.row_number().over(shuffled))
              .select("source", "grp", "place", "id", "pass", "words", "block", "shard", "position"))
    return rows.drop("first", "quota", "block_words", "no"), pieces


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    by_shard: bool = False, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document appears once per pass that takes it,
    its text cut where its source's target ends inside it, and not at all if no pass takes it.
    Of rows that share identifier, source and size, each gets the passes of one of them.

    With ``by_shard`` there are two more columns, ``mix_shard`` and ``mix_position``, and the rows are dealt by shard and
    sorted by position: written so, each output shard is its own disjoint, locally shuffled part of the mix.
    """
    rows, pieces = mix(docs, id_col, text_col, source_col, **options)
    spot = ["source", "grp", "place"]
    passes = (pieces.groupBy(*spot).agg(F.sort_array(F.collect_list(F.struct("words", "shard", "position")), asc=False).alias("words"),
                                        F.first("id").alias("id")))
    own = (rows.select(*spot, "size").alias("r")
           .join(passes.alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in spot])
           .groupBy("p.id", "p.source", "r.size").agg(F.sort_array(F.collect_list("words")).alias("lists")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(id_col).alias("d_id"), F.col(source_col).cast("string").alias("d_source"),
                        word_count(text_col).alias("d_size"))
    twin = Window.partitionBy("d_id", "d_source", "d_size").orderBy("d_id")
    taken = (whole.join(own, F.col("d_id").eqNullSafe(F.col("id")) & F.col("d_source").eqNullSafe(F.col("source"))
                        & (F.col("d_size") == F.col("size")))
             .withColumn("turn", F.row_number().over(twin) - 1)
             .withColumn("piece", F.explode(F.get("lists", F.col("turn"))))
             .withColumn("words", F.col("piece.words")))
    text = F.col("row").getField(text_col)
    begin = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{SPACE[:-1]}*{WORD}"), F.lit(0)), 1,
                                 F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), begin).otherwise(text)
    made = taken.select(F.col("row").withField(f"`{text_col}`", cut).alias("row"), "piece.shard", "piece.position")
    if not by_shard:
        return made.select("row.*")
    dealt = made.repartition(options.get("shards", SHARDS), "shard").sortWithinPartitions("shard", "position")
    return dealt.select("row.*", F.col("shard").alias("mix_shard"), F.col("position").alias("mix_position"))


def shares(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row ``<id_col>, size, source_size, target, taken, shards, positions``: the words that the mix takes of it, and
    where its passes went in the splitting tree's shards (in order of passes; empty if none takes it)."""
    rows, pieces = mix(docs, id_col, **options)
    spot = ["source", "grp", "place"]
    went = F.array_sort(F.collect_list(F.struct("pass", "shard", "position")))
    taken = pieces.groupBy(*spot).agg(F.sum("words").alias("taken"), went.alias("went"))
    return (rows.alias("r").join(taken.alias("t"), [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in spot], "left")
            .select(F.col("r.id").alias(id_col), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.coalesce(F.col("went.shard"), F.array().cast("array<bigint>")).cast("array<int>").alias("shards"),
                    F.coalesce(F.col("went.position"), F.array().cast("array<int>")).cast("array<bigint>").alias("positions")))


@register("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, the words that the mix takes, and the shards they went to."""
    return shares(table(spark, sf_dir, "documents"))


@register("mix_sources_taken", """
WITH d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5('1:' || doc_id) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
      FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (3.0::DOUBLE * source_size) / weight AS level,
             (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l),
o AS (SELECT *, max(CASE WHEN level >= share THEN share END) OVER () AS open_level FROM r),
t AS (SELECT source, source_size, CASE WHEN level < share OR open_level IS NULL THEN cap
                                       ELSE least(cap, weight * open_level) END AS target FROM o),
p AS (SELECT d.*, t.source_size, t.target,
             (sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - first))
        + greatest(0, least(size, round(target)::BIGINT - first - source_size))
        + greatest(0, least(size, round(target)::BIGINT - first - 2 * source_size)))::BIGINT AS taken
FROM p
""")
def mix_sources_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op9_mix_sources`` that SQL can express: everything but the draws of the tree."""
    return shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
