"""Splits that keep related records together.

Records are related by speaker, however written, and by being delivered again. Spellings and speakers are the vertices of a
graph; Borůvka-style rounds contract every component's least edge, and the edges chosen, a spanning forest, are persisted round
by round. Components' roots are stratified by size band and dealt systematically to the splits.

Null and blank speakers relate nothing: each such utterance is a group of its own. Repeated rows count once. Spellings differ
by case, blanks, widths and other invisible differences only. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.forms import visual_form_column
from voxloom.session import discarded

Store = Callable[[DataFrame, str], DataFrame]
#: Groups of at least this share of all records are dealt one by one, largest first; there are at most 1 / LARGE of them.
LARGE = 0.001
#: Buckets of hashes in which groups of a band are ranked, so that no band is ranked in one task.
BUCKETS = 1024


def speaker_key(speaker: Column) -> Column:
    """The speaker, however written: visual form, no outer blanks, lower case; null for null and blank."""
    key = F.lower(F.trim(visual_form_column(speaker)))
    return F.when(key != "", key)


def spelling_edges(*speakers: DataFrame) -> DataFrame:
    """a, b: an edge from each spelling (column speaker of the tables) to its speaker. Vertices are marked with their kind."""
    names = speakers[0].select("speaker").distinct()
    for more in speakers[1:]:
        names = names.union(more.select("speaker").distinct())
    names = names.where("speaker IS NOT NULL").distinct()
    keyed = names.select(F.concat(F.lit("written "), "speaker").alias("a"), F.concat(F.lit("speaker "), speaker_key(F.col("speaker"))).alias("b"))
    return keyed.where("b IS NOT NULL")


def shared_edges(records: DataFrame) -> DataFrame:
    """a, b: edges between the spellings under which one utterance was delivered; few, for most have one."""
    by = records.where("utterance IS NOT NULL AND speaker IS NOT NULL AND trim(speaker) <> ''").groupBy("utterance")
    least = by.agg(F.min("speaker").alias("a"), F.max("speaker").alias("z")).where("a <> z")
    pairs = records.join(least, "utterance").where("speaker <> a").select("a", F.col("speaker").alias("b")).distinct()
    return pairs.select(*(F.concat(F.lit("written "), c).alias(c) for c in ("a", "b")))


def entity_edges(records: DataFrame, entity: str) -> DataFrame:
    """a, b: edges from each spelling of a speaker to the values of another column (a source, an entity) of its records, which then stay together too."""
    pairs = records.where(f"speaker IS NOT NULL AND trim(speaker) <> '' AND {entity} IS NOT NULL").select("speaker", entity).distinct()
    return pairs.select(F.concat(F.lit("written "), "speaker").alias("a"), F.concat(F.lit(f"{entity} "), F.col(entity).cast("string")).alias("b"))


def spanning_forest(edges: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """node, root of every vertex of edges (a, b), and the forest: the edges (a, b) chosen.

    Each round: every component takes its least edge (edges are ordered by hash and ends, so no cycle can arise but two
    components taking the same edge), trees of taken edges contract to their least vertex. The least edge is found by partial
    aggregation, so a vertex with a third of all edges does no harm. The number of components at least halves each round.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # u, v: the components an edge joins by now; a, b: its own ends
    live = store(both.select("a", "b", F.xxhash64("a", "b").alias("w"), F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    roots = store(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    forest = None
    while live.count():
        ends = live.select("u", "v", "w", "a", "b").union(live.select("v", "u", "w", "a", "b"))
        least = store(ends.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("m")).select("u", "m.*"), "least")
        chosen = least.select("a", "b").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        # two components that took the same edge: the lesser one is the tree's root
        mutual = least.alias("x").join(least.alias("y"), F.expr("x.v = y.u AND y.v = x.u AND x.u < x.v"), "left_semi").select("u")
        parent = least.join(mutual.withColumn("top", F.lit(True)), "u", "left").select("u", F.when(F.col("top"), F.col("u")).otherwise(F.col("v")).alias("p"))
        stored_parent = parent = store(parent, "parent")
        while True:  # pointer jumping: the depth of the trees halves
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            before, stored_parent = stored_parent, store(parent.join(up, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parent")
            discarded(before)
            moved = stored_parent.where("moved").limit(1).count()
            parent = stored_parent.select("u", "p")
            if not moved:
                break
        to = parent.select(F.col("u").alias("root"), F.col("p").alias("top"))
        old_roots, old_live = roots, live
        roots = store(roots.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        moved_u = live.join(to.withColumnRenamed("root", "u"), "u", "left").withColumn("u", F.coalesce("top", "u")).drop("top")
        moved_v = moved_u.join(to.withColumnRenamed("root", "v"), "v", "left").withColumn("v", F.coalesce("top", "v")).drop("top")
        live = store(moved_v.where("u <> v").groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("m.a", "m.b", "m.w", "u", "v"), "edges")
        discarded(old_roots, old_live, stored_parent)
    return roots, forest if forest is not None else both.limit(0)


def torn_speakers(split_rows: DataFrame, roots: DataFrame) -> DataFrame:
    """speaker of those whom split_rows (speaker, split), over all spellings, put in more than one split.

    roots: of the forest over spellings alone. Rows meet at the root of their spelling's tree; a tree with rows of more than one
    split gives the speaker that is among its vertices.
    """
    named = split_rows.where("speaker IS NOT NULL AND split IS NOT NULL").select(F.concat(F.lit("written "), "speaker").alias("node"), "split")
    torn = named.join(roots, "node").groupBy("root").agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x <> y").select("root")
    names = roots.where(F.col("node").startswith("speaker ")).join(torn, "root", "left_semi")
    return names.select(F.expr("substr(node, 9)").alias("speaker"))


def _deal_large(shares: list[tuple[str, float]], total: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["size", "root"], ascending=[False, True], kind="stable")
        left = {name: share * total for name, share in shares}
        out = []
        for root, size in zip(groups["root"], groups["size"], strict=True):
            best = max(left, key=lambda name: (left[name], name))
            left[best] -= size
            out.append(best)
        return pd.DataFrame({"root": groups["root"], "split": out, "size": groups["size"]})

    return run


def assign(records: DataFrame, targets: DataFrame, roots: DataFrame, store: Store) -> DataFrame:
    """utterance, speaker, root, split of every utterance of records (utterance, speaker): whole components to splits.

    targets: split, share_percent. Few large groups go one by one where most room is left. Within a band of sizes (powers of
    two) the others follow a low-discrepancy sequence of their rank by hash, thresholds being the shares still open.
    """
    spark = records.sparkSession
    rows = records.select("utterance", "speaker").distinct()
    node = F.when(F.trim("speaker") != "", F.concat(F.lit("written "), "speaker"))
    keyed = rows.withColumn("node", node).join(roots, "node", "left")
    keyed = store(keyed.select("utterance", "speaker", F.coalesce("root", F.concat(F.lit("alone "), F.coalesce("utterance", F.lit("")))).alias("root")), "rooted")
    groups = store(keyed.groupBy("root").agg(F.count("*").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    wanted = [(r[0], float(r[1])) for r in targets.where("split IS NOT NULL AND share_percent > 0").groupBy("split").agg(F.max("share_percent")).orderBy("split").collect()]  # a few splits
    whole = sum(s for _, s in wanted)
    if not wanted:
        raise ValueError("there are no splits with a share")
    shares = [(n, s / whole) for n, s in wanted]
    big = groups.where(F.col("size") >= max(2.0, LARGE * total))
    dealt = store(big.groupBy(F.lit(0).alias("g")).applyInPandas(lambda g: _deal_large(shares, total)(g), "root string, split string, size long"), "large")
    given = {r[0]: r[1] for r in dealt.groupBy("split").agg(F.sum("size")).collect()}
    open_ = [(n, max(0.0, s * total - given.get(n, 0))) for n, s in shares]
    room = sum(x for _, x in open_) or 1.0
    small = groups.where(F.col("size") < max(2.0, LARGE * total)).select("root", "size", F.floor(F.log2("size")).alias("band"), F.xxhash64("root").alias("h"))
    small = small.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)))
    counts = small.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "root")) + F.coalesce("before", F.lit(0))
    ranked = small.join(before.select("band", "bucket", "before"), ["band", "bucket"]).withColumn("rank", rank)
    at = F.col("rank") * F.lit(0.6180339887498949) + F.col("band") * F.lit(0.4142135623730951)
    at = at - F.floor(at)
    edge, choice = 0.0, F.lit(open_[-1][0])
    bounds = []
    for name, x in open_:
        edge += x / room
        bounds.append((name, edge))
    for name, upto in reversed(bounds[:-1]):
        choice = F.when(at < upto, name).otherwise(choice)
    splits = ranked.select("root", choice.alias("split")).union(dealt.select("root", "split"))
    return keyed.join(splits, "root").select("utterance", "speaker", "root", "split")
