"""N-gram Jaccard self-join by token-combination prefixes.

The tokens of a set (hashes of word n-grams) are ordered by the number of sets that hold them. A
set of n tokens can only be linked to sets that share need = ceil(t n) of them, so n - need + 1
tokens must stay without a common signature before a link is impossible. Tokens of one set only
are free. A rare token is a signature by itself and counts one. Frequent tokens are dealt into
parts by hash, two of one part make a signature, and c of them count c - 1; the prefix is
extended until the count is reached. Sets that meet in a signature are verified exactly.

Equal sets are one node. Before all that a screen drops sets that share too little of the first
tokens in hash order with any other: an exact bound, which leaves few sets to count.

Nodes and tokens are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.components import components
from inkweave.llm.text import buckets_for, grams, listed, mix, steps, words
from inkweave.session import stage

NGRAM, PERCENT = 5, 80
#: Sets up to which a token is rare and makes a signature by itself.
RARE = 64
#: Tokens of a cluster of candidates that one task searches; larger clusters are searched in distributed rounds.
CLUSTER_TOKENS = 6_000_000
#: Bits of the fixed-size filter that spares the join most sets (1 MB whatever the data).
FILTER_BITS = 1 << 23


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with a linked one."""
    return -(-n * percent // 100)


def parts(n: int, percent: int) -> list[int]:
    """Numbers of parts for the sizes that a set of n can be linked to; linked sets have one in common."""
    low, high = (max(x, 1).bit_length() - 1 for x in (n, n * 100 // percent))
    return sorted({max(1, (1 << x) // 4) for x in range(low, high + 1)})


def token_sets(text: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each row in ascending order, their numbers, and the node of each row (0: no token)."""
    found = words(text)
    hashes = found.hashes(fold=True)
    tokens, at = grams(hashes, found.rows, ngram)
    rows = found.rows[at]
    few = np.flatnonzero((np.diff(found.first) > 0) & (np.diff(found.first) < ngram))
    if len(few):  # the whole sequence is the only token
        short = []
        for r in few.tolist():
            h = np.full(1, found.first[r + 1] - found.first[r], np.uint64)
            for w in hashes[found.first[r] : found.first[r + 1]]:
                h = mix(h * np.uint64(31) + w)
            short.append(h[0])
        tokens, rows = np.concatenate([tokens, np.array(short, np.uint64)]), np.concatenate([rows, few])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    tokens, rows = tokens[first], rows[first]
    counts = np.bincount(rows, minlength=len(text))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    nodes = mix((total[bounds[1:]] - total[bounds[:-1]]) ^ counts.astype(np.uint64))
    return tokens, counts, np.where(counts > 0, nodes, 0).astype(np.uint64)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


MASK = np.uint64((1 << 48) - 1)


def _screened(docs: DataFrame, ngram: int, percent: int, buckets: int) -> DataFrame:
    """``part`` (48 bits of a node) of the sets that share enough of their first tokens in hash order with others.

    Hashes travel packed, by bucket, with 48 bits; a collision can only keep a set. A token that
    several sets of a step hold is sent once, as held twice, and counted where it was met.
    """
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tokens, counts, nodes = token_sets(batch.column(1), ngram)
            _, once = np.unique(nodes, return_index=True)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            take = np.zeros(len(counts), np.int64)
            take[once] = first_tokens(counts[once], percent)
            place = np.arange(len(tokens)) - np.repeat(bounds[:-1], counts)
            chosen = place < np.repeat(take, counts)
            token, node = tokens[chosen], np.repeat(nodes, counts)[chosen]
            order = np.argsort(token, kind="stable")
            token, node = token[order], node[order]
            heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.append(heads, len(token)))
            met = np.repeat(size > 1, size)
            filled = once[counts[once] > 0]  # in the order of nodes
            local, times = nodes[filled], np.zeros(len(filled), np.int64)
            np.add.at(times, np.searchsorted(local, node[met]), 1)
            wanted = take[filled] - counts[filled] + need(counts[filled], percent)
            token, node = token[heads], np.where(size > 1, 0, node[heads]).astype(np.uint64)
            of = (token % np.uint64(buckets)).astype(np.int64)
            home = (local % np.uint64(buckets)).astype(np.int64)
            order, order2 = np.argsort(of, kind="stable"), np.argsort(home, kind="stable")
            for_bucket, cuts = np.unique(of[order], return_index=True)
            rows = [(int(b), _six(token[x] // np.uint64(buckets)), _six(node[x]), None, None) for b, x in zip(for_bucket, np.split(order, cuts[1:]), strict=True)] if len(order) else []
            home_bucket, cuts = np.unique(home[order2], return_index=True)
            rows += [(int(b), None, _six(local[x]), times[x].tobytes(), wanted[x].astype(np.int64).tobytes()) for b, x in zip(home_bucket, np.split(order2, cuts[1:]), strict=True)] if len(order2) else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "tokens", "nodes", "times", "wanted"])

    def meet(table: pa.Table) -> pa.Table:
        sent = [(t, n) for t, n in zip(table["tokens"].to_pylist(), table["nodes"].to_pylist(), strict=True) if t is not None]
        own = table.filter(pc.is_null(table["tokens"]))
        mine, times, wanted = (b"".join(own[c].to_pylist()) for c in ("nodes", "times", "wanted"))
        token, node = _wide(b"".join(t for t, _ in sent)), _wide(b"".join(n for _, n in sent))
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1]) | (node[1:] == 0)
        token, node = token[new], node[new]
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(token)))
        several = np.repeat((size > 1) | (node[heads] == 0), size) & (node > 0) if len(token) else np.zeros(0, bool)
        part, shared = np.unique(node[several], return_counts=True)
        mine, times, wanted = _wide(mine), np.frombuffer(times, np.int64), np.frombuffer(wanted, np.int64)
        return pa.table({"part": pa.array(np.concatenate([part, mine]).astype(np.int64)), "shared": pa.array(np.concatenate([shared, times]).astype(np.int64)),
                         "wanted": pa.array(np.concatenate([np.zeros(len(part), np.int64), wanted]), mask=np.arange(len(part) + len(mine)) < len(part))})

    sent = docs.select("id", "text").mapInArrow(send, "bucket int, tokens binary, nodes binary, times binary, wanted binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "part long, shared long, wanted long")
    return met.groupBy("part").agg(F.sum("shared").alias("shared"), F.min("wanted").alias("wanted")).where(F.col("shared") >= F.col("wanted")).select("part")


def first_tokens(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of the screen: a tenth more than can differ."""
    return np.minimum(n, n - need(n, percent) + np.maximum(1, -(-n // 10)))


def _sets(docs: DataFrame, ngram: int, percent: int, screened: DataFrame) -> DataFrame:
    """``id``, ``node``, ``n`` of every row and the ``tokens`` of those that may pass the screen, once for each node and step."""
    # a hash filter of fixed size; what it lets through is joined with the exact list later
    spot = F.pmod(F.col("part"), F.lit(FILTER_BITS))
    maps = screened.select(F.bitmap_bucket_number(spot).alias("k"), F.bitmap_bit_position(spot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in maps.collect():  # at most FILTER_BITS / 32768 + 1 maps of 4 KB
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in steps(batches):
            tokens, counts, nodes = token_sets(batch.column(1), ngram)
            part = (nodes & MASK).astype(np.int64) % FILTER_BITS
            # bitmap_bucket_number is 1-based for positive numbers, bit positions are (n - 1) % 32768
            number, bit = np.where(part > 0, 1 + (part - 1) // 32768, 0), np.where(part > 0, (part - 1) % 32768, 0)
            may = (table[number * 4096 + bit // 8] >> (bit % 8) & 1).astype(bool) & (counts > 0)
            _, once = np.unique(nodes, return_index=True)
            carries = np.zeros(len(nodes), bool)
            carries[once] = True
            carries &= may
            sets = listed(tokens[np.repeat(carries, counts)].astype(np.int64), np.where(carries, counts, 0), pa.int64())
            sets = pa.ListArray.from_arrays(sets.offsets, sets.values, mask=pa.array(~carries))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.astype(np.int64)), pa.array(counts, pa.int64()), sets], ["id", "node", "n", "tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, node long, n long, tokens array<long>")


def _signatures(sets: DataFrame, percent: int, rare_up_to: int) -> DataFrame:
    """``sig``, ``node`` from ``node``, ``n``, ``held`` (sorted array of df, token with df above 1)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            held = batch.column(2)
            values, cuts = held.values, held.offsets.to_numpy()
            df_all, token_all = values.field("df").to_numpy(), values.field("token").to_numpy().astype(np.uint64)
            for i, (node, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                df, token = df_all[cuts[i] : cuts[i + 1]], token_all[cuts[i] : cuts[i + 1]]
                left = n - int(need(np.array(n), percent)) + 1 - (n - len(df))
                if left <= 0:
                    continue
                rare = int((df <= rare_up_to).sum())
                sigs = [mix(token[: min(left, rare)])]
                left -= rare
                if left > 0:
                    often = token[rare:]
                    for p in parts(n, percent):
                        sigs.append(_pairs(often, p, left))
                sigs = np.unique(np.concatenate(sigs))
                out.append(sigs)
                of.append(np.full(len(sigs), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64)), pa.array(np.concatenate(of))], ["sig", "node"])

    return sets.select("node", "n", "held").mapInArrow(run, "sig long, node long")


def _pairs(tokens: np.ndarray, parts_: int, left: int) -> np.ndarray:
    """Signatures of two tokens of a part, over the shortest prefix that counts ``left``."""
    part = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts_)
    order = np.argsort(part, kind="stable")
    heads = np.concatenate([[True], part[order][1:] != part[order][:-1]])
    counts = np.ones(len(tokens), np.int64)
    counts[order[heads]] = 0  # the first token of a part counts nothing
    size = int(np.searchsorted(np.cumsum(counts), left)) + 1
    tokens, part = tokens[:size], part[:size]
    out = []
    for p in np.unique(part):
        own = np.sort(tokens[part == p])
        a, b = np.triu_indices(len(own), 1)
        out.append(mix(mix(own[a] + np.uint64(parts_)) * np.uint64(3) + own[b]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    close = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = both.where(close).select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = ta[i].values.to_numpy(), tb[i].values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, rare: int = RARE, cluster_tokens: int = CLUSTER_TOKENS) -> DataFrame:
    """``id_col``, n_shingles, component_id of every row.

    A row's tokens are its distinct ``ngram``-word shingles (A-Z lower-cased); with fewer words
    the whole sequence is one; a null text or one without words has none and is linked with
    nothing. Two rows are linked if 100 * intersection >= percent * union. component_id is the
    least id that links reach, null ids apart (null if there is no other). Repeated rows have equal
    sets and so one component; other columns are ignored; an empty table gives an empty result.

    Signatures that many nodes share never make all pairs. Nodes that signatures connect are a
    cluster; one task searches it breadth first, each set against those not reached yet. A cluster
    of more than ``cluster_tokens`` tokens is searched in rounds over the whole cluster instead.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stage(_screened(named, ngram, percent, buckets_for(named)))
    rows = stage(_sets(named, ngram, percent, found))
    part = F.col("node").bitwiseAND(F.lit(int(MASK)))
    sets = rows.where(F.col("tokens").isNotNull()).withColumn("part", part).join(found, "part", "left_semi")
    sets = stage(sets.dropDuplicates(["node"]).select("node", "n", "tokens"))
    each = sets.select("node", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").cast("int").alias("df")).where(F.col("df") > 1)
    held = each.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    sets_held = held.join(sets.select("node", "n"), "node").where(F.size("held") * 100 >= F.col("n") * percent)
    sigs = stage(_signatures(sets_held, percent, rare))
    label = components(_clustered(sigs, sets, percent, cluster_tokens))
    nodes = rows.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("least"))
    tagged = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = tagged.groupBy("label").agg(F.min("least").alias("component_id"))
    component = tagged.join(least, "label").select("node", "component_id")
    out = rows.select("id", "node", "n").join(component, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("id"))).alias("component_id"))


def _reached(flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(first set, set) of every set that links reach from an earlier first one; sets are given by their tokens, one after another."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[token] > 1
    owner, token = owner[keep], token[keep]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    order = np.argsort(token, kind="stable")
    holders, starts = owner[order], np.searchsorted(token[order], np.arange(len(times) + 1))
    open_ = np.ones(len(sizes), bool)
    indexed, out = len(sizes), []
    for first in range(len(sizes)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            left = int(open_.sum())
            if left < indexed // 2:  # the index keeps only sets that are not reached yet
                stay = open_[holders]
                starts = np.concatenate([[0], np.cumsum(stay)])[starts]
                holders, indexed = holders[stay], left
            mine = token[bounds[x] : bounds[x + 1]]
            count = starts[mine + 1] - starts[mine]
            ends = np.cumsum(count)
            at = np.repeat(starts[mine] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
            same = np.bincount(holders[at], minlength=len(sizes))
            linked = np.flatnonzero(open_ & (same > 0) & (100 * same >= percent * (sizes[x] + sizes - same)))
            open_[linked] = False
            queue += linked.tolist()
            out += [(first, int(y)) for y in linked]
    return out


def _clustered(sigs: DataFrame, sets: DataFrame, percent: int, cluster_tokens: int) -> DataFrame:
    """Pairs (a, b) that have the components of the join."""
    heads = sigs.groupBy("sig").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1").select("sig", "a")
    edges = sigs.join(heads, "sig").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
    cluster = stage(components(edges).join(sets.select("node", "n"), "node"))
    large = cluster.groupBy("label").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > cluster_tokens).select("label")
    small = cluster.join(large, "label", "left_anti").join(sets.select("node", "tokens"), "node").select("label", "node", "tokens")

    def search(table: pa.Table) -> pa.Table:
        lists = table["tokens"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        nodes = table["node"].to_numpy()
        pairs = np.array(_reached(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), percent), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[pairs[:, 0]]), "b": pa.array(nodes[pairs[:, 1]])})

    found = stage(small.groupBy("label").applyInArrow(search, "a long, b long"))
    hard = stage(sigs.join(cluster.join(large, "label", "left_semi").select("node"), "node", "left_semi"))
    return found if hard.isEmpty() else found.unionByName(_links(hard, sets, percent))


def _links(sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs that make the components of the join."""
    spark = sigs.sparkSession
    links = tested = spark.createDataFrame([], "a long, b long")
    rows, turn = sigs.count(), 0
    while True:
        tagged = sigs.withColumn("label", F.col("node"))
        if turn:
            tagged = stage(sigs.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")))
        # pairs of different components in one signature
        sizes = tagged.groupBy("sig", "label").agg(F.count("*").alias("k")).groupBy("sig").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("pairs"))
        if (sizes.agg(F.sum("pairs")).first()[0] or 0) <= 4 * rows:
            break
        order = F.xxhash64("node", F.lit(turn))
        heads = tagged.groupBy("sig").agg(F.min_by(F.struct("node", "label"), order).alias("head"), F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high"))
        pairs = tagged.join(heads, "sig").where(F.col("label") != F.col("head.label"))
        pairs = pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        fresh = stage(pairs.join(tested, ["a", "b"], "left_anti"))
        new = stage(_verified(fresh, sets, percent))
        tested, links, turn = tested.unionByName(fresh), links.unionByName(new), turn + 1
        if new.isEmpty():
            break
    # all that is left, whatever it costs
    one, two = tagged.select("sig", "node", "label"), tagged.select("sig", F.col("node").alias("node2"), F.col("label").alias("label2"))
    cross = one.join(two, "sig").where(F.col("label") < F.col("label2")).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    return links.unionByName(stage(_verified(cross.join(tested, ["a", "b"], "left_anti"), sets, percent)))
