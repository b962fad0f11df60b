"""Problem 9: filling fixed-capacity containers, planned over the histogram of lengths instead of the documents.

Only counts per length reach the planner: at most one row per possible length, so its size is bounded by the capacity
whatever the number of documents. It runs best-fit decreasing over those counts, moving whole groups of equally filled
containers at once, and returns slots (length, ranks from-to, first container). Documents get a rank within their length
and take the slot that holds their rank.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.tokens import token_counts
from presswork.session import read_table, written

#: Parts into which the ranking of one length is split, so that a length with a third of the rows is no single task.
RANK_PARTS = 64


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, rank_from, rank_to, first_container, per_container)], containers used).

    Items of one length with rank in [rank_from, rank_to) go to container first_container + (rank - rank_from) //
    per_container. Lengths are taken in falling order; each item goes to the fullest open container that still holds it,
    a new container is opened only if none does. A group is a run of containers with the same room left; it is split at
    most once per length, so the plan grows with the number of lengths, not of items.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted distinct rooms of the open groups
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first container, containers)]
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room <= 0:
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if length <= 0 or length > capacity:
            raise ValueError("lengths to plan lie between 1 and the capacity")
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                # the fullest container takes items until no more fit, then the next one of its group
                per = room // length
                whole = min(n, left // per)
                if whole:
                    slots.append((length, rank, rank + whole * per, first, per))
                    put(room - per * length, first, whole)
                    rank, left = rank + whole * per, left - whole * per
                if whole < n and left:
                    rest = min(left, per)
                    slots.append((length, rank, rank + rest, first + whole, per))
                    put(room - rest * length, first + whole, 1)
                    rank, left = rank + rest, left - rest
                    whole += 1
                if whole < n:
                    put(room, first + whole, n - whole)
            else:
                per = capacity // length
                n = -(-left // per)
                slots.append((length, rank, rank + left, opened, per))
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * length, opened, full)
                if rest:
                    put(capacity - rest * length, opened + full, 1)
                opened += n
                left = 0
    return slots, opened


def ranked(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank (from 0) within each length, by the columns `order`, without a task per length.

    Rows are ranked within (length, part) and shifted by the counts of the parts before; there are at most lengths x
    RANK_PARTS such counts. The numbering depends on the data only, so a lost task is rerun with the same result.
    """
    parts = items.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(RANK_PARTS)).cast("int"))
    sizes = parts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "part").orderBy(*order)
    local = parts.withColumn("local", F.row_number().over(inside) - 1)
    return local.join(shift, ["length", "part"]).withColumn("rank", F.col("local") + F.col("shift")).drop("part", "local", "shift")


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(doc_id, piece_no, start, length, container_id): every document in a container of the capacity.

    A document that exceeds the capacity is cut into full pieces, each with a container of its own, and a rest that is
    packed like any other item; no other document is cut. Documents of size 0 take no room and all lie in container 0,
    as do those of unknown (NULL) size. Ids must be unique; an empty table gives no rows. Containers are numbered from 0
    without gaps: first the planned ones, then the full pieces in order of their document's rank.
    """
    base = sizes.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    rest = base.withColumn("length", F.when(F.col("size") <= capacity, F.col("size")).otherwise(F.col("size") % capacity))
    # one row for each length up to the capacity: bounded by the parameter, not by the data
    histogram = {int(r[0]): int(r[1]) for r in rest.where("length > 0").groupBy("length").count().collect()}
    slots, used = best_fit_plan(histogram, capacity)
    spark = sizes.sparkSession
    plan = spark.createDataFrame(
        slots or [(-1, 0, 0, 0, 1)], "p_length bigint, rank_from bigint, rank_to bigint, first bigint, per bigint"
    )
    to_rank = ranked(rest.where("length > 0"), ["doc_id"])
    # the plan has a few rows for each length up to the capacity
    cond = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    container = (F.col("first") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per"))).cast("bigint")
    placed = to_rank.join(F.broadcast(plan), cond).select(
        "doc_id",
        F.floor((F.col("size") - F.col("length")) / capacity).cast("int").alias("piece_no"),
        (F.col("size") - F.col("length")).alias("start"),
        "length",
        container.alias("container_id"),
    )
    empty = base.where("size = 0").selectExpr("doc_id", "0 AS piece_no", "0L AS start", "0L AS length", "0L AS container_id")
    long = base.where(F.col("size") > capacity)
    fulls = long.select("doc_id", F.floor(F.col("size") / capacity).cast("bigint").alias("length"))
    # prefix sums over documents longer than the capacity: ranked by their number of full pieces, offsets by histogram
    per_count = fulls.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_count.select(
        F.col("length").alias("o_length"), F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0)).alias("offset")
    )
    numbered = ranked(fulls, ["doc_id"]).join(offsets, F.col("length") == F.col("o_length"))
    pieces = numbered.select(
        "doc_id", "length", (F.col("offset") + F.col("rank") * F.col("length") + F.lit(used)).alias("c0"),
        F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("piece_no"),
    )
    whole = pieces.select(
        "doc_id", "piece_no", (F.col("piece_no") * F.lit(capacity)).cast("bigint").alias("start"),
        F.lit(capacity).cast("bigint").alias("length"), (F.col("c0") + F.col("piece_no")).cast("bigint").alias("container_id"),
    )
    return placed.unionByName(whole).unionByName(empty)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of all documents for every row of container_specs; sizes are counted once per tokenizer."""
    documents = read_table(spark, sf_dir, "documents")
    specs = read_table(spark, sf_dir, "container_specs").orderBy("spec_id").collect()  # a fixed table of 3 rows
    sizes = {t: written(token_counts(documents, t), "sizes") for t in sorted({s["tokenizer"] for s in specs})}
    out = None
    for s in specs:
        one = pack(sizes[s["tokenizer"]], int(s["capacity_tokens"])).withColumn("spec_id", F.lit(int(s["spec_id"])))
        out = one if out is None else out.unionByName(one)
    cols = ["spec_id", "container_id", "doc_id", "piece_no", "start", "length"]
    return out.select(*cols) if out is not None else spark.createDataFrame([], "spec_id int, container_id bigint, doc_id bigint, piece_no int, start bigint, length bigint")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items and unused share of each spec."""
    per = p9_containers(spark, sf_dir).groupBy("spec_id", "container_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("items"))
    specs = F.broadcast(read_table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens"))
    return per.join(specs, "spec_id").groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens")), 6).alias("unused_share"),
    )


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
