"""Walks over link edges, all jobs at once.

A walk numbers pages once and then moves 8-byte numbers instead of addresses. Edges are bucketed by
source and what a walk has visited by number, in as many buckets as a round has shuffle partitions,
so a round moves only its finds: the front meets the edges, and the finds meet the visited pages,
bucket by bucket. :class:`Visited` is the index behind it. The number of buckets follows the edges:
rounds of a small graph do not pay for the tasks and files of a large one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkweave.operators.ordered import numbered_by_range, running
from inkweave.session import setting, shared_dir, sized, stage, width

#: Levels after which the order keys of a crawl, which grow by a place a level, become plain numbers again.
FOLD_EVERY = 16
#: Batches of one tier of the visited index that are merged into one of the next tier.
FAN_IN = 8
#: Fronts of so few pages look up their buckets of edges by number.
SMALL_FRONT = 16
#: Edges of a bucket that a round reads in one task.
BUCKET_EDGES = 262_144
#: Hops of one round of :func:`reachable`, jumps of one round of its contraction.
HOPS, JUMPS = 4, 2


@contextmanager
def bucket_tables(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives a function that writes a table bucketed by its join keys, so that no round of a walk shuffles it again.

    The tables, files included, are dropped at the end of the block.
    """
    base = f"inkweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{shared_dir(spark)}/buckets/{base}'")

    def write(df: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
        name, n = f"{base}.t{uuid.uuid4().hex}", buckets or width(spark)
        # dealt by bucket first: a file a bucket, not one for every task and bucket
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
        return spark.table(name)

    write.base = base
    try:
        yield write
    finally:
        spark.sql(f"DROP DATABASE {base} CASCADE")


class Visited:
    """Rows of a walk by page number, in batches of one bucketed table: every round appends one and reads none but the ids.

    Batches are merged in tiers, so a long walk has a number of files that grows with the logarithm
    of its rounds. A lookup is a merge join bucket by bucket: a bucket without a find is not read.
    """

    def __init__(self, spark: SparkSession, base: str, columns: str):
        self.spark, self.name, self.batches, self.next, self.buckets = spark, f"{base}.v{uuid.uuid4().hex}", [], 0, width(spark)
        spark.sql(f"CREATE TABLE {self.name} (id BIGINT, {columns}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS")
        self.columns = self.spark.table(self.name).columns[:-1]

    def add(self, rows: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Append a batch; the batch as it was written, and aggregates over it that are taken on the way."""
        watch = Observation()
        seen = rows.select(*self.columns).observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()])
        number = self._write(seen)
        self.batches.append((0, number))
        return self.batch(number), watch.get

    def _write(self, rows: DataFrame) -> int:
        number, self.next = self.next, self.next + 1
        rows.withColumn("batch", F.lit(number)).write.mode("append").insertInto(self.name)
        return number

    def batch(self, *numbers: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("batch").isin(*numbers)).drop("batch")

    def replace_last(self, rows: DataFrame) -> DataFrame:
        number = self._write(rows.select(*self.columns).repartition(self.buckets, "id"))
        self.batches[-1] = (0, number)
        return self.batch(number)

    def all(self) -> DataFrame:
        return self.batch(*(number for _, number in self.batches))

    def unseen(self, found: DataFrame) -> DataFrame:
        """Rows of ``found(id, ...)`` whose page is in no batch."""
        return found.join(self.all().select("id").hint("merge"), "id", "left_anti")

    def fold(self) -> None:
        """Merge each full tier, but for the last batch, which is the front."""
        while True:
            tier = next((t for t in range(self.next) if sum(x == t for x, _ in self.batches[:-1]) >= FAN_IN), None)
            if tier is None:
                return
            full = [number for x, number in self.batches[:-1] if x == tier]
            # a task a bucket reads the files of all batches and writes one
            with setting(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
                merged = (tier + 1, self._write(self.batch(*full)))
            at = self.batches.index((tier, full[0]))
            self.batches = [*self.batches[:at], merged, *[b for b in self.batches[at:] if b not in [(tier, n) for n in full]]]


def round_width(edges: DataFrame) -> int:
    """Partitions of a round: a task for every core at least, more as the edges of a walk ask for, up to the session's setting."""
    spark = edges.sparkSession
    return max(1, min(width(spark), max(spark.sparkContext.defaultParallelism, math.ceil(edges.count() / BUCKET_EDGES))))


@dataclass
class Numbered:
    """Pages of jobs with numbers: ``pages(id, job_id, url, ...)`` and ``edges(src, dst, ...)``."""

    pages: DataFrame
    edges: DataFrame


def numbered(edges: DataFrame, seeds: DataFrame, about: DataFrame) -> Numbered:
    """Number the pages that seeds or links name; ``about(url, ...)`` adds what is known of an address.

    Numbers are written with the pages, so all later uses agree.
    """
    names = edges.select("job_id", F.col("dst").alias("url")).unionByName(seeds.select("job_id", "url")).distinct()
    pages = stage(names.join(about, "url", "left").withColumn("id", F.monotonically_increasing_id()))
    source = pages.select(F.col("id").alias("_src"), "job_id", F.col("url").alias("src"))
    target = pages.select(F.col("id").alias("_dst"), "job_id", F.col("url").alias("dst"), *[c for c in about.columns if c != "url"])
    kept = edges.join(source, ["job_id", "src"]).join(target, ["job_id", "dst"]).drop("job_id", "src", "dst")
    return Numbered(pages, kept.withColumnsRenamed({"_src": "src", "_dst": "dst"}))


def _place(number: Column, digits: int) -> Column:
    """A number as bytes whose order is that of the numbers."""
    return F.unhex(F.lpad(F.hex(number), digits, "0"))


def crawl(edges: DataFrame, captured: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """First-in-first-out crawl of every job.

    ``edges(job_id, src, dst, pos)``, ``captured(url, outcome)``, ``seeds(job_id, url, max_pages)``.
    Gives (job_id, url, depth, parent_pos, queue_pos, crawl_pos, state). A URL enters the queue
    once, at its first finder; only ``ok`` pages count against ``max_pages`` and give links; URLs
    behind the limit stay ``queued``. Order inside a depth is finder order, then link order.

    A level is ordered by keys (the finder's key and the place of the link), not by running
    numbers. A job ends with the level that reaches its limit; numbers, the exact cut and states
    are worked out once at the end.
    """
    links = stage(edges.select("job_id", "src", "dst", "pos"))
    spark = edges.sparkSession
    with sized(spark, round_width(links)), bucket_tables(spark) as bucketed:
        return _crawl(bucketed, numbered(links, seeds, captured.select("url", "outcome")), seeds, max_depth)


def _crawl(bucketed: Callable[..., DataFrame], graph: Numbered, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    jobs = stage(seeds.groupBy("job_id").agg(F.max("max_pages").cast("long").alias("max_pages")).withColumn("job", F.monotonically_increasing_id()))
    good = F.coalesce(F.col("outcome") == "ok", F.lit(False))
    links = bucketed(graph.edges.select("src", "dst", "pos", good.alias("ok")), "src")
    visited = Visited(links.sparkSession, bucketed.base, "job BIGINT, key BINARY, ok BOOLEAN, left BIGINT, parent BIGINT, depth INT")
    gives = F.col("ok") & (F.col("left") > 0)
    measures = {"n": F.count_if(gives), "low": F.min(F.when(gives, F.col("id"))), "high": F.max(F.when(gives, F.col("id")))}
    start = seeds.select("job_id", "url").distinct().join(graph.pages, ["job_id", "url"]).join(jobs, "job_id")
    level, seen = visited.add(start.select(
        "id", "job", F.lit(b"").alias("key"), good.alias("ok"), F.col("max_pages").alias("left"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")), **measures)
    depth = 0
    while seen["n"] and (max_depth is None or depth < max_depth):
        depth += 1
        found = _round(level, _near_edges(links, level.where(gives), seen))
        level, seen = visited.add(visited.unseen(found).withColumn("depth", F.lit(depth)), **measures)
        if depth % FOLD_EVERY == 0 and seen["rows"]:
            level = visited.replace_last(numbered_by_range(level, ["job"], ["key"], "place").withColumn("key", _place(F.col("place"), 16)))
        visited.fold()
    return _placed(visited.all(), graph.pages, jobs)


def _near_edges(links: DataFrame, front: DataFrame, seen: dict) -> DataFrame:
    """The edges a front needs: a small one names its pages, so only their buckets and row groups are read."""
    if seen["n"] > SMALL_FRONT:
        return links
    ids = {seen["low"], seen["high"]} if seen["n"] <= 2 else {r["id"] for r in front.select("id").collect()}
    return links.where(F.col("src").isin(*ids))


def _round(level: DataFrame, links: DataFrame) -> DataFrame:
    """Targets of a level, each with its earliest finder and what its job may still crawl."""
    spent = level.groupBy("job").agg(F.count_if("ok").alias("spent"))
    near = level.where(F.col("ok") & (F.col("left") > 0)).join(spent, "job").select(
        F.col("id").alias("src"), "job", "key", (F.col("left") - F.col("spent")).alias("left"))
    finder = F.struct(F.concat("key", _place(F.col("pos"), 8)).alias("key"), F.col("src").alias("parent"))
    found = links.join(near, "src").groupBy(F.col("dst").alias("id")).agg(
        F.max("job").alias("job"), F.min(finder).alias("first"), F.max("ok").alias("ok"), F.max("left").alias("left"))
    return found.select("id", "job", "first.key", "ok", "left", "first.parent")


def _placed(rows: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Dense numbers, the limit and states from the order of levels and keys."""
    cut = stage(rows.select("id", "job", "depth", "key", "ok", "parent").repartitionByRange(width(rows.sparkSession), "job", "depth", "key", "id")
                .withColumn("_part", F.spark_partition_id().cast("long")))
    order = [F.col(c) for c in ("depth", "key", "id")]
    counted = stage(running(cut, ["job"], F.col("_part"), order, sums={"queue_pos": F.lit(1).cast("long"), "hits": F.col("ok").cast("long")})
                    .join(jobs, "job").drop("_part", "job", "key"))
    popped = F.col("hits") - F.col("ok").cast("long") < F.col("max_pages")
    # Finds of pages behind the limit stand last in their job; they were never in its queue.
    finder = counted.select(F.col("id").alias("parent"), F.col("queue_pos").alias("parent_pos"), (F.col("ok") & (F.col("hits") < F.col("max_pages"))).alias("gives"))
    known = counted.join(finder, "parent", "left").where(F.col("parent").isNull() | F.col("gives"))
    return stage(known.join(pages.select("id", "url", F.coalesce("outcome", F.lit("failed")).alias("outcome")), "id").select(
        "job_id", "url", "depth", F.coalesce("parent_pos", F.lit(0).cast("long")).alias("parent_pos"), "queue_pos",
        F.when(popped & F.col("ok"), F.col("hits")).alias("crawl_pos"),
        F.when(~popped, "queued").when(F.col("ok"), "crawled").otherwise(F.col("outcome")).alias("state")))


def reachable(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(job_id, url, depth) of captured nodes that can be reached from the seeds, seeds included.

    ``nodes(url)`` are the keys of the graph: neighbours outside of it are not followed. Pages with
    one way in and one way out are contracted by pointer jumping, so a chain costs the logarithm
    of its length; the rest is walked several hops a round, and a shorter way found later replaces
    a longer one.
    """
    known = nodes.select("url").distinct()
    inside = stage(edges.join(known.withColumnRenamed("url", "dst"), "dst", "left_semi").select("job_id", "src", "dst"))
    starts = seeds.select("job_id", "url").distinct().join(known, "url", "left_semi")
    spark = edges.sparkSession
    with sized(spark, round_width(inside)), bucket_tables(spark) as bucketed:
        graph = numbered(inside, starts, known)
        links = bucketed(graph.edges.where(F.col("src") != F.col("dst")).distinct(), "src")
        first = stage(starts.join(graph.pages, ["job_id", "url"]).select("id"))
        passing = contracted(links, first)
        core = links.join(passing.select(F.col("id").alias("src")), "src", "left_anti").join(passing.select(F.col("id").alias("dst")), "dst", "left_anti")
        tails = passing.join(passing.select(F.col("id").alias("succ")), "succ", "left_anti").select(
            F.col("head").alias("src"), F.col("succ").alias("dst"), (F.col("far") + 1).alias("far"))
        weighted = bucketed(core.select("src", "dst", F.lit(1).cast("long").alias("far")).unionByName(tails), "src")
        near = _nearest(Visited(spark, bucketed.base, "depth BIGINT, hop INT"), weighted, first)
        behind = passing.join(near.select(F.col("id").alias("head"), "depth"), "head").select("id", (F.col("depth") + F.col("far")).alias("depth"))
        return stage(near.unionByName(behind).join(graph.pages, "id").select("job_id", "url", F.col("depth").cast("int").alias("depth")))


def contracted(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages with one way in and one way out: (id, succ, head, far), ``head`` being the page before their chain.

    ``links(src, dst)`` are distinct and no loops; ``seeds(id)`` are never contracted. Each round
    follows the pointer of a pointer, so distances double; cycles that nothing enters are left out.
    """
    one_out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.max("dst").alias("succ")).where("n_out = 1")
    one_in = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.max("src").alias("head")).where("n_in = 1")
    rows = one_in.join(one_out, "id").join(seeds, "id", "left_anti").select("id", "succ", "head", F.lit(1).cast("long").alias("far"))
    watch = Observation()
    table = stage(rows.observe(watch, F.count(F.lit(1)).alias("n")))
    longest, steps = watch.get["n"], 1
    open_rows = longest
    while open_rows and steps <= longest:
        jumped = table.withColumn("moved", F.lit(False))
        for _ in range(JUMPS):
            ahead = jumped.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("far").alias("_far"))
            jumped = jumped.join(ahead, "head", "left").select(
                "id", "succ", F.coalesce("_head", "head").alias("head"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_head").isNotNull().alias("moved"))
            steps *= 2
        watch = Observation()
        table = stage(jumped.observe(watch, F.count_if("moved").alias("n")).drop("moved"))
        open_rows = watch.get["n"]
    if open_rows:  # pointers inside cycles
        table = table.join(table.select(F.col("id").alias("head")), "head", "left_anti")
    return table


def _nearest(visited: Visited, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, depth) of all pages that weighted ``links(src, dst, far)`` reach from the seeds.

    A page whose best way came before the last hop of a round was followed in that round, so only
    those of the last hop are the next front.
    """
    level, seen = visited.add(seeds.select("id", F.lit(0).cast("long").alias("depth"), F.lit(HOPS).alias("hop")), n=F.count(F.lit(1)))
    while seen["n"]:
        hop, found = level.where(F.col("hop") == HOPS), None
        for number in range(1, HOPS + 1):
            hop = links.join(hop.select(F.col("id").alias("src"), "depth"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("depth") + F.col("far")).alias("depth"))
            # depth and hop in one number: the least depth, then the least hop
            coded = hop.select("id", (F.col("depth") * (HOPS + 1) + number).alias("code"))
            found = coded if found is None else found.unionByName(coded)
        best = visited.all().groupBy("id").agg(F.min("depth").alias("_depth"))
        nearer = found.groupBy("id").agg(F.min("code").alias("code")).select("id", F.floor(F.col("code") / (HOPS + 1)).alias("depth"), (F.col("code") % (HOPS + 1)).cast("int").alias("hop")).join(
            best.hint("merge"), "id", "left").where(F.col("_depth").isNull() | (F.col("depth") < F.col("_depth")))
        level, seen = visited.add(nearer, n=F.count_if(F.col("hop") == HOPS))
        visited.fold()
    return stage(visited.all().groupBy("id").agg(F.min("depth").alias("depth")))


def seed_status(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether the seed itself was captured; a walk from a missing one ends at once."""
    known = nodes.select("url", F.lit(True).alias("in_graph"))
    return seeds.join(known, "url", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))


def save_order(reached: DataFrame, discovered: DataFrame, limits: DataFrame, strict: bool = True) -> DataFrame:
    """Pages the command-line profile saves: URL order, within what discovery left of the limit.

    ``discovered(job_id, n_discovered)``, ``limits(job_id, max_pages)``.
    """
    placed = numbered_by_range(reached.select("job_id", "url"), ["job_id"], ["url"], "save_pos")
    sized = placed.join(limits, "job_id").join(discovered, "job_id", "left")
    spent = F.coalesce(F.col("n_discovered"), F.lit(0)) if strict else F.lit(0)
    return sized.where(F.col("save_pos") <= F.greatest(F.lit(0), F.col("max_pages") - spent)).select(
        "job_id", "url", "save_pos")


def navigation_or_discovery(nav: DataFrame, discovery: DataFrame) -> DataFrame:
    """Order list of a job: its navigation links when it has any, else discovery order.

    Both inputs are (job_id, pos, url).
    """
    with_nav = nav.select("job_id").distinct()
    return nav.withColumn("source", F.lit("nav")).unionByName(
        discovery.join(with_nav, "job_id", "left_anti").withColumn("source", F.lit("discovery")))
