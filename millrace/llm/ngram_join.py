"""Joining documents by the Jaccard similarity of their word n-grams, with PartEnum signatures.

Two sets of similarity num/den or more differ in at most k = floor(s * (den - num) / num) elements, s
the size of the smaller one. The hashed feature domain is cut into equal partitions, each of
``CELLS`` cells. Among more than k / 2 partitions there is one in which the sets differ in at most one
element (``DIFFERING``), so at most one of its cells differs, and the sets agree on some subset of
``CELLS - DIFFERING`` cells. The hash of a set's elements in such a subset is a signature: sufficiently
similar sets share one. Sizes are cut into bands; a set also signs in the band below if
a partner may be there, and within a band all sets use the same partitions.

A set signs its partitions in order until enough of them are *good*: no subset of their cells
is empty. (Empty subsets would match between all documents.) Of two similar sets, the one that
stops first has a good partition with at most one difference, and the other one has signed that
partition too. A set that runs out of partitions signs again with the next seed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import col, discard, fresh_folder, row_key, stored, whole
from millrace.llm.url_filter import bloom_filter, passing

CELLS, DIFFERING = 3, 1
FIRST_BAND, BAND_RATIO = 4, 2
SEEDS = 16
HELD_SIGNATURES = 1_000_000
SKETCH_WORDS = 32
BLOCK_NODES, BLOCK_SHINGLES = 128, 1 << 20
GROUP_NODES, PAIRS_AT_ONCE = 4096, 1 << 16
MEMBER, AWAY = 4 + SKETCH_WORDS, 1 << 50

_P1, _P2, _P3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _P1
    x = (x ^ (x >> np.uint64(27))) * _P2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles as sorted 64-bit hashes; A-Z count as a-z.

    With fewer than n words the whole sequence is the one shingle; without words there is none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    length = min(n, len(w))
    acc = np.full(len(w) - length + 1, length, dtype=np.uint64)
    for k in range(length):
        acc = mix(acc * _P3 + w[k : len(w) - length + 1 + k])
    return np.unique(acc)


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        a, b = mix(h + _P3).sum(dtype=np.uint64), mix(h ^ _P1).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """The parity of the set's elements in each of ``SKETCH_WORDS * 64`` bins. Two sketches differ in
    no more bits than the sets differ in elements."""
    bins = np.bincount((mix(h + _P1) % np.uint64(SKETCH_WORDS * 64)).astype(np.int64), minlength=SKETCH_WORDS * 64)
    return np.packbits((bins & 1).astype(np.uint8)).view(np.int64)


def most_different(size: int, num: int, den: int) -> int:
    """In how many elements a set of this size may differ from a similar one at least as large."""
    return size * (den - num) // num


def _band(size: int) -> int:
    band, top = 0, FIRST_BAND * BAND_RATIO
    while size >= top:
        band, top = band + 1, top * BAND_RATIO
    return band


def _good_needed(k: int) -> int:
    return k // (DIFFERING + 1) + 1


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The set's signatures as distinct signed 64-bit numbers; none if only equal sets are similar."""
    size = len(h)
    if not size or not most_different(size, num, den):
        return np.zeros(0, dtype=np.int64)
    band, out = _band(size), []
    out += _signed(h, band, most_different(size, num, den), num, den)
    below = FIRST_BAND * BAND_RATIO**band - 1  # the largest size of the band below
    if band and below * den >= size * num:
        out += _signed(h, band - 1, most_different(below, num, den), num, den)
    return np.unique(np.concatenate(out)).view(np.int64)


def _signed(h: np.ndarray, band: int, k: int, num: int, den: int) -> list[np.ndarray]:
    top = most_different(FIRST_BAND * BAND_RATIO ** (band + 1) - 1, num, den)
    partitions, needed, out = max(1, _good_needed(top) * 6 // 5), _good_needed(k), []
    for seed in range(SEEDS):
        x = h if not seed else np.sort(mix(h + np.uint64(seed * int(_P3) % 2**64)))
        cell = ((x >> np.uint64(32)) * np.uint64(partitions * CELLS)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sums = np.zeros(partitions * CELLS, dtype=np.uint64)
        filled = np.zeros(partitions * CELLS, dtype=bool)
        at = cell[starts].astype(np.int64)
        sums[at], filled[at] = np.add.reduceat(mix(x + _P2), starts), True
        sums, filled = sums.reshape(partitions, CELLS), filled.reshape(partitions, CELLS)
        good = np.cumsum((~filled).sum(axis=1) < CELLS - DIFFERING)
        enough = good[-1] >= needed
        used = int(np.searchsorted(good, needed)) + 1 if enough else partitions
        place = mix(np.arange(used, dtype=np.uint64) + np.uint64((band * SEEDS + seed) << 40))
        for chosen in itertools.combinations(range(CELLS), CELLS - DIFFERING):
            value = place
            for c in chosen:
                value = mix(value * _P3 + sums[:used, c] + np.uint64(c + 1))
            out.append(value[filled[:used][:, chosen].any(axis=1)])
        if enough:
            return out
    # so many seeds without enough good partitions: sign as a whole band, so that no link is lost
    out.append(mix(np.array([band], dtype=np.uint64) + _P1))
    return out


def _sign_rows(n: int, num: int, den: int):
    """Sets and signatures of documents. Among the rows held at once, a signature that several rows
    have is led by the first of them; only a leader's signature need be compared with other tasks."""

    def flush(held: list[dict], signed: list[np.ndarray]) -> pd.DataFrame:
        of = np.repeat(np.arange(len(held)), [len(s) for s in signed])
        sig = np.concatenate(signed) if signed else np.zeros(0, dtype=np.int64)
        order = np.argsort(sig, kind="stable")
        first = np.concatenate([[True], sig[order][1:] != sig[order][:-1]]) if len(sig) else np.zeros(0, dtype=bool)
        leader = np.empty(len(sig), dtype=np.int64)
        if len(sig):
            leader[order] = of[order][first][np.cumsum(first) - 1]
        rid = np.array([row["rid"] for row in held], dtype=np.int64)
        leads = leader == of
        cuts = np.cumsum([len(s) for s in signed])[:-1]
        own = [s[m] for s, m in zip(np.split(sig, cuts), np.split(leads, cuts), strict=True)]
        more = [s[~m] for s, m in zip(np.split(sig, cuts), np.split(leads, cuts), strict=True)]
        led = [rid[x[~m]] for x, m in zip(np.split(leader, cuts), np.split(leads, cuts), strict=True)]
        return pd.DataFrame(held).assign(own=own, more=more, led_by=led)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, signed, total, known = [], [], 0, set()
        for frame in frames:
            for row in frame.itertuples(index=False):
                h = shingles(row.text, n)
                a, b = fingerprint(h)
                copy = (len(h), a, b) in known  # it is linked through its fingerprint
                known.add((len(h), a, b))
                s = np.zeros(0, dtype=np.int64) if copy else signatures(h, num, den)
                held.append({
                    "rid": row.rid, "k1": row.k1, "k2": row.k2, "n": len(h), "a": a, "b": b, "sketch": sketch(h)
                })
                signed.append(s)
                total += len(s)
                if total > HELD_SIGNATURES or len(held) > 100_000:
                    yield flush(held, signed)
                    held, signed, total, known = [], [], 0, set()
        if held:
            yield flush(held, signed)

    return sign


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): node and component, its least node.

    Large-star and small-star steps in turn, each an aggregate and a join, until the edges are stars.
    No step gathers a node's neighbours; each round is written to the shared folder.
    """
    spark, at = edges.sparkSession, fresh_folder(edges.sparkSession)
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), at)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(smallest, F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        before, at = at, fresh_folder(spark)
        now = stored(small.filter("u <> v").distinct(), at)
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of ``left`` link with which of ``right``, by their whole sets."""
    sizes = np.array([len(s) for s in left + right], dtype=np.int64)
    _, column, holders = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    shared = holders > 1
    at, owner = (np.cumsum(shared) - 1)[column], np.repeat(np.arange(len(sizes)), sizes)
    at, owner = at[shared[column]], owner[shared[column]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for begin in range(0, int(shared.sum()), 4096):
        low, high = np.searchsorted(at, (begin, begin + 4096))
        held = np.zeros((len(sizes), 4096), dtype=np.float32)
        held[owner[low:high], at[low:high] - begin] = 1
        common += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    union = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common * den >= union * num


def _alike(num: int, den: int):
    """Pairs of nodes of different components that can be similar. A row holds a block of a group (its pairs are
    those inside), or two blocks of one group (a node of each); a member is node, component, size, distance to the
    hub (of ``AWAY``, -1 if there is none) and sketch."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = batch.column("one"), batch.column("other")
            lengths = [side.value_lengths().fill_null(0).to_numpy() // MEMBER for side in sides]
            firsts, others = (np.cumsum(n) - n for n in lengths)
            total = int(lengths[0].sum())
            held = np.concatenate([side.flatten().to_numpy() for side in sides]).reshape(-1, MEMBER)
            node, component, size, away = np.ascontiguousarray(held[:, : MEMBER - SKETCH_WORDS].T)
            words = held[:, MEMBER - SKETCH_WORDS :].view(np.uint64)
            # the pairs of the member at ``i`` of a first block are with all from begin[i] up to end[i]
            row = np.repeat(np.arange(len(firsts)), lengths[0])
            inside = sides[1].is_null().to_numpy(zero_copy_only=False)[row]
            begin = np.where(inside, np.arange(total) + 1, total + others[row])
            end = np.where(inside, (firsts + lengths[0])[row], total + (others + lengths[1])[row])
            upto = np.cumsum(end - begin)
            at, found = 0, []
            while at < total:
                done = upto[at - 1] if at else 0
                last = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
                many = end[at:last] - begin[at:last]
                x = np.repeat(np.arange(at, last), many)
                y = np.arange(len(x)) + np.repeat(begin[at:last] - (np.cumsum(many) - many), many)
                at = last
                may = component[x] != component[y]
                x, y = x[may], y[may]
                may = np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num
                may &= (np.minimum(away[x], away[y]) < 0) | (np.abs(away[x] - away[y]) * den <= ((den - num) + 1e-6) * AWAY)
                x, y = x[may], y[may]
                bits = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
                may = bits * (den + num) <= (size[x] + size[y]) * (den - num)
                x, y = x[may], y[may]
                swap = node[x] > node[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                found.append(np.stack([node[x], node[y], size[x], size[y]], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], ["x", "y", "n_x", "n_y"])

    return alike


def _count_rows(num: int, den: int):
    """Links of each node, of rows that come sorted by the pair of blocks they are to be compared in."""

    def counted(held: dict) -> pd.DataFrame:
        low = min(block for block, *_ in held.values())
        x = [node for node, (block, *_) in held.items() if block == low]
        y = [node for node, (block, *_) in held.items() if block != low] or x
        copies = {node: many for node, (_, many, _) in held.items()}
        linked = linked_pairs([held[i][2] for i in x], [held[i][2] for i in y], num, den)
        if x is y:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"node": x, "n_links": linked @ np.array([copies[i] for i in y], dtype=np.int64)})
        return pd.DataFrame({"node": x + y, "n_links": np.concatenate([
            linked @ np.array([copies[i] for i in y], dtype=np.int64),
            linked.T @ np.array([copies[i] for i in x], dtype=np.int64),
        ])})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, held, made = None, {}, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.component, row.low, row.high) != of:
                    if held and (of[1] == of[2] or len({block for block, *_ in held.values()}) > 1):
                        made.append(counted(held))
                    of, held = (row.component, row.low, row.high), {}
                held[row.node] = (row.block, row.copies, row.held)
            if made:
                yield pd.concat(made)
                made = []
        if held and (of[1] == of[2] or len({block for block, *_ in held.values()}) > 1):
            yield counted(held)

    return count


def ngram_join(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text",
    count_links: bool = True,
) -> DataFrame:
    """For each document: its key, ``n_shingles``, ``component_id``, the least key reachable by links,
    and with ``count_links`` ``n_links``, with how many documents that have another set it links.

    Two documents link if den * intersection >= num * union of their distinct n-word shingles (A-Z as
    a-z; the whole sequence if there are fewer words). NULL, '' and blank texts have no shingles and
    link with nothing. Repeated rows have equal sets and so one component; a NULL key is never the
    least unless all are NULL; for a row without links the component is its own key. An empty table
    gives an empty result.

    1. One pass over the texts computes each set's fingerprint, signatures and sketch; equal sets
       are one node from there on, whatever their number.
    2. Signatures are grouped; rows of one task are grouped before the shuffle. Each group is a star
       around the node that shares most signatures, in a family of near copies the original if it
       is there; the star's pairs are checked exactly on their whole sets.
    3. Links give components. Only groups that still hold several components are looked at again:
       pairs of nodes of different components go on if they can be similar by their sizes, by their
       distances to the group's hub (Jaccard distance obeys the triangle inequality) and by their
       sketches, all of which a similar pair passes; they are checked exactly too. Groups are cut into
       blocks of bounded size, whose pairs are looked at as arrays: only what passes becomes a row.
    So every group is either one component or has had all its possible pairs checked: no link
    between components is lost, and groups of copies are never expanded into pairs.
    4. To count links, the distinct sets of each component are dealt into blocks of bounded size, and
    each pair of blocks is compared set by set, exactly. A linked set counts as often as there are
    documents with it, repeated rows being one document. No pair becomes a row.
    """
    found = _joined(docs, n, num, den, key, text, count_links)
    least = found.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc").alias("least"))
    return found.join(least, "component", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"),
        *(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links") for _ in range(count_links)),
    )


def one_of_each(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The ``row_key`` of key and text (``k1``, ``k2``) of one document of each component: the one of the
    least key, a NULL key last, and among equal keys of the least row key. Each document without shingles
    is one of its own. ``rows`` tells how many equal rows of it there are.
    """
    found = _joined(docs, n, num, den, key, text, False)
    each = found.groupBy("k1", "k2").agg(
        F.min("doc").alias("doc"), F.min("component").alias("component"), F.count(F.lit(1)).alias("rows")
    )
    order = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "k1", "k2", "rows")
    first = each.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("kept"))
    return first.select("kept.k1", "kept.k2", "kept.rows").unionByName(
        each.filter("component IS NULL").select("k1", "k2", "rows")
    )


def _joined(docs: DataFrame, n: int, num: int, den: int, key: str, text: str, count_links: bool) -> DataFrame:
    """Each row's ``doc``, row key ``k1``, ``k2``, shingles ``n``, ``component`` (a number that only it has; NULL
    without shingles), and ``n_links``."""
    k1, k2 = row_key(col(key), col(text))
    keyed = docs.select(col(key).alias("doc"), col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    spark = docs.sparkSession
    signatures_at = fresh_folder(spark)
    signed = stored(
        keyed.select(F.monotonically_increasing_id().alias("rid"), "k1", "k2", whole(F.col("text")).alias("text"))
        .mapInPandas(
            _sign_rows(n, num, den),
            "rid long, k1 long, k2 long, n long, a long, b long, sketch array<long>, own array<long>, more array<long>, "
            "led_by array<long>",
        ),
        signatures_at,
    )
    about = stored(signed.select("rid", "k1", "k2", "n", "a", "b", "sketch"))
    rows = about.drop("sketch")
    nodes = stored(rows.filter("n > 0").groupBy("n", "a", "b").agg(F.min("rid").alias("node")))
    node_of = stored(rows.select("rid", "n", "a", "b").join(nodes, ["n", "a", "b"]).select("rid", "node", "n"))

    by_signature = Window.partitionBy("sig")
    led = signed.select("rid", F.explode("own").alias("sig")).withColumn(
        "rows", F.count(F.lit(1)).over(by_signature)
    ).filter("rows > 1").select("sig", "rid")
    local = signed.select("rid", F.explode(F.arrays_zip("more", "led_by")).alias("x"))
    shared = led.unionByName(local.select(F.col("x.more").alias("sig"), "rid")).unionByName(
        local.select(F.col("x.more").alias("sig"), F.col("x.led_by").alias("rid"))
    )
    member_at, starred_at, left_at = (fresh_folder(spark) for _ in range(3))
    member = stored(shared.join(node_of, "rid").select("sig", "node", "n").distinct(), member_at)
    discard(signatures_at)  # most are of one set alone; the others are members now
    shares = member.groupBy("sig").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    popular = member.join(shares, "sig").groupBy("node").agg(F.sum("others").alias("shared"))
    hubs = member.join(popular, "node").groupBy("sig").agg(
        F.max(F.struct("shared", (-F.col("node")).alias("node"), "n")).alias("hub")
    ).select("sig", (-F.col("hub.node")).alias("hub"), F.col("hub.n").alias("n_hub"))
    starred = stored(member.join(hubs, "sig"), starred_at)
    discard(member_at)

    def pair(a: str, n_a: str, b: str, n_b: str) -> list[Column]:
        """Two nodes and their sizes, the lower node first."""
        swap = F.col(a) > F.col(b)
        return [
            F.least(a, b).alias("x"), F.greatest(a, b).alias("y"),
            F.when(swap, F.col(n_b)).otherwise(F.col(n_a)).alias("n_x"), F.when(swap, F.col(n_a)).otherwise(F.col(n_b)).alias("n_y"),
        ]

    may = F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num  # as far as sizes tell

    def sets_of(ids: DataFrame) -> DataFrame:
        """The shingles of nodes. A Bloom filter of their rows keeps most other texts from being shuffled."""
        wanted = stored(rows.select(F.col("rid").alias("node"), "k1", "k2").join(ids, "node"))
        place = F.concat_ws(",", "k1", "k2")
        bloom, n_words = bloom_filter(wanted.select(place.alias("place")), "place")
        likely = passing(keyed.select("text", "k1", "k2", place.alias("place")), "place", bloom, n_words).drop("place")

        def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = [shingles(t, n).view(np.int64) for t in frame["text"]]
                yield pd.DataFrame({"node": frame["node"], "held": made})

        # repeated rows go before the join, by its key: texts are shuffled once and sets, which are larger, not at all
        found = likely.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("node", whole(F.col("text")).alias("text"))
        return found.mapInPandas(sets, "node long, held array<long>")

    def checked(pairs: DataFrame) -> DataFrame:
        """Pairs with their distance and whether they link, on whole sets."""
        pairs_at, sets_at = fresh_folder(spark), fresh_folder(spark)
        pairs = stored(pairs, pairs_at)
        ids = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        sets = stored(sets_of(ids), sets_at)
        both = pairs.join(sets.toDF("x", "s_x"), "x").join(sets.toDF("y", "s_y"), "y")
        both = both.select("x", "y", "n_x", "n_y", F.size(F.array_intersect("s_x", "s_y")).cast("long").alias("common"))
        union = F.col("n_x") + F.col("n_y") - F.col("common")
        found = stored(both.select(
            "x", "y", (F.col("common") * den >= union * num).alias("link"), (1 - F.col("common") / union).alias("distance"),
        ))
        discard(sets_at)
        discard(pairs_at)
        return found

    spokes = starred.filter("node <> hub").select(*pair("node", "n", "hub", "n_hub")).filter(may)
    first = checked(spokes.distinct())
    links = first.filter("link").select(F.col("x").alias("u"), F.col("y").alias("v"))
    so_far = components(links)

    # groups that still hold several components
    placed = starred.drop("n", "n_hub").join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("sig").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / GROUP_NODES).alias("blocks")
    )
    mixed = mixed.filter("low <> high").select("sig", "blocks")
    known = first.select("x", "y", "distance")
    to_hub = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance"))
    sketched = about.select(F.col("rid").alias("node"), F.col("n").alias("size"), "sketch")
    told = placed.join(mixed, "sig").join(to_hub.toDF("node", "hub", "away"), ["node", "hub"], "left").join(sketched, "node")
    # a group is one block or, if it is large, several of bounded size, which meet as aliases of one table that Spark shuffles once
    # one array a block, so that little code is generated to pass it on
    away = F.coalesce(F.round(F.col("away") * AWAY).cast("long"), F.lit(-1).cast("long"))
    packed = F.concat(F.array("node", "component", "size", away), "sketch")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    left = stored(told.select("sig", "blocks", block, packed.alias("member")).groupBy("sig", "blocks", "block").agg(
        F.flatten(F.collect_list("member")).alias("held")
    ), left_at)
    several = left.filter("blocks > 1")
    met = several.alias("one").join(several.alias("other"), (
        (F.col("one.sig") == F.col("other.sig")) & (F.col("one.block") <= F.col("other.block"))
    )).select(F.col("one.held").alias("one"), F.when(F.col("one.block") < F.col("other.block"), F.col("other.held")).alias("other"))
    alone = left.filter("blocks = 1").select(F.col("held").alias("one"), F.lit(None).cast("array<long>").alias("other"))
    discard(starred_at)
    possible = met.unionByName(alone).mapInArrow(_alike(num, den), "x long, y long, n_x long, n_y long").distinct()
    second = checked(possible.join(first.select("x", "y"), ["x", "y"], "left_anti"))
    discard(left_at)
    more = second.filter("link").select(F.col("x").alias("u"), F.col("y").alias("v"))
    links = links.unionByName(more)
    linked = components(links)

    def degrees() -> DataFrame:
        """Nodes and their links: of all pairs inside a component, as no link leaves it."""
        copies = rows.filter("n > 0").select("k1", "k2", "n", "a", "b").distinct().groupBy("n", "a", "b").agg(
            F.count(F.lit(1)).alias("copies")
        )
        inside = stored(nodes.join(copies, ["n", "a", "b"]).join(linked, "node").select("node", "component", "n", "copies"))
        of = inside.groupBy("component").agg(
            F.count(F.lit(1)).alias("members"), F.sum("n").alias("held"), F.sum("copies").alias("all")
        )
        blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("held") / BLOCK_SHINGLES))
        inside = stored(inside.join(of.withColumn("blocks", blocks).drop("held"), "component"))
        couples = inside.filter("members = 2").select("node", (F.col("all") - F.col("copies")).alias("n_links"))
        larger = inside.filter("members > 2").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        dealt = larger.select("node", "component", "block", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("node", "component", "block", "copies", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        together = dealt.join(sets_of(larger.select("node")), "node").repartition("component", "low", "high")
        counted = together.sortWithinPartitions("component", "low", "high").mapInPandas(
            _count_rows(num, den), "node long, n_links long"
        )
        return couples.unionByName(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")))

    grouped = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if count_links:
        grouped = grouped.join(degrees(), "node", "left")
    grouped = grouped.drop("node")
    # the keys come from the table: the stored rows hold only what stands for a row
    named = rows.select("k1", "k2", "n", "a", "b").distinct().join(grouped, ["n", "a", "b"], "left").drop("a", "b")
    counts = ["n_links"] if count_links else []
    return stored(keyed.select("doc", "k1", "k2").join(named, ["k1", "k2"]).select("doc", "k1", "k2", "n", "component", *counts))
