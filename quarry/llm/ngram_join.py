"""N-gram Jaccard join by prefix trees, and the components of its links.

Every distinct text is a set of hashed word n-grams. How many texts hold an
n-gram is counted exactly (fingerprint exchange), which gives one global order,
rare n-grams first. Two sets that reach the threshold share an n-gram in their
prefixes, so a set whose prefix holds only n-grams of its own is done. The
others (with sizes that fit) form candidate clusters, connected by shared prefix
n-grams in runs of fitting size, and only they move as whole sets.

Within a cluster's cell a path-compressed trie stores the sets in the global
order, frequent n-grams first, so that near copies share long paths. A probe
walks the trie level by level: overlaps are counted once per shared edge, and a
subtree ends when its overlap so far and the shorter remaining length can't
reach the threshold any more, or when all its sets are connected to the probe
already. Large clusters are cut into blocks, every two of which meet in a cell
of bounded size; cells give spanning forests of the links they find, so that no
pair of different texts goes unconnected and no quadratic number is written.
"""

from __future__ import annotations

import math
import secrets
import string
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import trimmed, written
from quarry.llm.components import Sets, components
from quarry.llm.exchange import NO_ID, Group, answered, grouped, key_of, opened, send, slices, totals

LONG = 64  #: bytes of a word that are hashed in steps for all words at once
BLOCK = 1024  #: sets on either side of a cell
BATCH = 8 << 20  #: bytes of groups that a worker takes at once


@contextmanager
def small_batches(spark):
    """Workers get a few groups at a time, as both they and Spark hold a batch as a whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@cache
def lowered() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for c in string.ascii_uppercase:
        out[ord(c)] = ord(c.lower())
    return out


@cache
def blanks() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(30)


@dataclass(frozen=True)
class Keys:
    """Numbers drawn for one job, so that no text can be made to collide with another."""

    words: np.ndarray  #: two rows of multipliers
    places: np.ndarray  #: odd multipliers by place in an n-gram
    long: bytes

    @staticmethod
    def drawn(n: int) -> Keys:
        numbers = lambda *shape: np.frombuffer(secrets.token_bytes(8 * math.prod(shape)), np.uint64).reshape(shape)
        return Keys(numbers(2, LONG // 4 + 2), numbers(n) | np.uint64(1), secrets.token_bytes(32))


def hashes(raw: np.ndarray, at: np.ndarray, size: np.ndarray, keys: Keys) -> np.ndarray:
    """64 bits of each word: the upper halves of two sums of its length and four-byte pieces by the job's multipliers.

    Any two words of up to LONG bytes share a hash with a chance of 2^-64, over
    the draw of the keys; longer words have a keyed BLAKE2b.
    """
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    half = np.uint64(32)
    sums = [k[0] + k[1] * size.astype(np.uint64) for k in keys.words]
    left = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        spare = np.maximum(8 - (size[left] - k), 0).astype(np.uint64) << np.uint64(3)
        block = eight[at[left] + k] << spare >> spare
        low, high = block & np.uint64(0xFFFFFFFF), block >> half
        for total, key in zip(sums, keys.words):
            total[left] += low * key[2 + k // 4] + high * key[3 + k // 4]
    h = sums[0] >> half << half | sums[1] >> half
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(blake2b(raw[at[k] : at[k] + size[k]].tobytes(), digest_size=8, key=keys.long).digest(), "little")
    return h


def shingles(g: Group, n: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, n-gram) of a group, in order; a text with fewer words is one n-gram.

    An n-gram is 64 bits of its words' hashes, mixed in sequence with the job's
    multipliers. Only a collision between two sets that meet can change a verdict:
    for sets of a thousand n-grams that is a chance of 10^-13 a pair, whatever
    they hold, as nobody knows the keys.
    """
    raw = lowered()[g.raw]
    word = ~blanks()[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[g.starts[g.starts < len(raw)]] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    stop = edge[1:].copy()
    stop[-1:] = True
    last = np.flatnonzero(word & (stop | ~np.r_[word[1:], False])) + 1
    del word, edge, stop
    words = hashes(raw, first, last - first, keys)
    del raw
    text = np.searchsorted(g.ends, first, "right")
    count = np.bincount(text, minlength=len(g.ends))
    parts_t, parts_h = [], []
    for size in range(1, n + 1):  # shorter texts as one sequence of their own length
        at = np.arange(len(words) - size + 1) if len(words) >= size else np.zeros(0, np.int64)
        at = at[(text[at] == text[at + size - 1]) & ((count[text[at]] == size) if size < n else True)]
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = mix(h * keys.places[k] + words[at + k])
        parts_t.append(text[at])
        parts_h.append(h)
    t, h = np.concatenate(parts_t), np.concatenate(parts_h)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    keep = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])] if len(t) else np.zeros(0, bool)
    return t[keep], h[keep]


def needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b at which they link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix(n, percent: int):
    """How many n-grams, the first in any global order, a set of size n shares one of with each linked set."""
    return n - -((-percent * n) // 100) + 1


class Trie:
    """Path-compressed trie over sets of ranks, as arrays; a node spans sets lo..hi in order."""

    def __init__(self, sets: list[np.ndarray]):
        packed = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=packed.__getitem__), np.int64)
        ranked = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in ranked], np.int64)
        common = [0]
        for a, b in zip(ranked, ranked[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        # inner nodes where neighbours part, leaves at each set's end
        parent, depth, lo, hi, rep = [-1], [0], [0], [len(ranked)], [0]
        stack = [0]
        for i, s in enumerate(ranked):
            d = common[i]
            last = -1
            while depth[stack[-1]] > d:
                last = stack.pop()
                hi[last] = i
            if depth[stack[-1]] < d:
                parent.append(stack[-1])
                depth.append(d)
                lo.append(lo[last])
                hi.append(-1)
                rep.append(i)
                parent[last] = len(parent) - 1
                stack.append(len(parent) - 1)
            parent.append(stack[-1])
            depth.append(len(s))
            lo.append(i)
            hi.append(i + 1)
            rep.append(i)
            stack.append(len(parent) - 1)
        for k in stack[1:]:
            hi[k] = len(ranked)
        parent, depth = np.array(parent), np.array(depth)
        self.depth, self.lo, self.hi = depth, np.array(lo), np.array(hi)
        above = np.where(parent < 0, 0, depth[parent])
        self.edges = [ranked[r][a:d] for r, a, d in zip(rep, above, depth)]
        length = np.array([len(e) for e in self.edges])
        self.tokens = np.concatenate(self.edges) if len(self.edges) else np.zeros(0, np.int64)
        self.start, self.length = np.r_[0, np.cumsum(length)[:-1]], length
        self.last = np.array([e[-1] if len(e) else -1 for e in self.edges])
        self.last[0] = -1
        children: dict[int, list[int]] = {}
        for k, p in enumerate(parent.tolist()):
            children.setdefault(p, []).append(k)
        kids = [children.get(k, []) for k in range(len(parent))]
        self.kid = np.array([c for ks in kids for c in ks], np.int64)
        self.kids = np.array([len(ks) for ks in kids])
        self.kid_at = np.r_[0, np.cumsum(self.kids)[:-1]]
        self.short = np.minimum.reduceat(np.r_[self.size, 1 << 60], np.stack([self.lo, self.hi], 1).ravel())[::2] if len(ranked) else np.zeros(1)
        self.long = np.maximum.reduceat(np.r_[self.size, 0], np.stack([self.lo, self.hi], 1).ravel())[::2] if len(ranked) else np.zeros(1)
        # a set may end where a longer one goes on
        self.ends = self.depth == self.size[self.lo] if len(ranked) else np.zeros(1, bool)

    def linked(self, probe: np.ndarray, mark: np.ndarray, wanted: np.ndarray, percent: int) -> np.ndarray:
        """Places (in order) of wanted sets that link to the probe; mark: a scratch array over ranks, False."""
        n = len(probe)
        mark[probe] = True
        left = np.r_[0, np.cumsum(wanted)]
        node, over = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = []
        while len(node):
            # children of the frontier
            many = self.kids[node]
            at = np.repeat(self.kid_at[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            over = np.repeat(over, many)
            node = self.kid[at]
            least = needed(n, self.short[node], percent)
            fits = (left[self.hi[node]] > left[self.lo[node]]) & (np.minimum(n, self.long[node]) >= least)
            node, over = node[fits], over[fits]
            if not len(node):
                break
            # overlaps along their edges
            size = self.length[node]
            at = np.repeat(self.start[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            hits = np.r_[0, np.cumsum(mark[self.tokens[at]])]
            ends = np.cumsum(size)
            over = over + hits[ends] - hits[ends - size]
            rest = n - np.searchsorted(probe, self.last[node], "right")
            best = over + np.minimum(rest, self.long[node] - self.depth[node])
            alive = best >= needed(n, self.short[node], percent)
            node, over = node[alive], over[alive]
            whole = self.ends[node]
            place = self.lo[node[whole]]
            size = self.size[place]
            found.append(place[(over[whole] >= needed(n, size, percent)) & wanted[place]])
            deeper = self.kids[node] > 0
            node, over = node[deeper], over[deeper]
        mark[probe] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def spanning(ids: list[int], tokens: list[np.ndarray], classes: list[np.ndarray], stored: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links of a cell connect: stored sets with each other if all are, else stored with others."""
    flat, kind = np.concatenate(tokens), np.concatenate(classes)
    unique, at, back = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(unique), np.int64)
    rank[np.lexsort((unique, -kind[at].astype(np.int64)))] = np.arange(len(unique))
    ranks = np.split(rank[back], np.cumsum([len(t) for t in tokens])[:-1])
    ranks = [np.sort(r) for r in ranks]
    inside = np.flatnonzero(stored)
    trie = Trie([ranks[i] for i in inside])
    mark = np.zeros(len(unique), bool)
    sets = Sets()
    owner = inside[trie.order]  # item by place
    label = np.arange(len(ids))
    members = [[k] for k in range(len(ids))]
    out = []
    for i in range(len(ids)) if stored.all() else np.flatnonzero(~stored).tolist():
        wanted = label[owner] != label[i]
        if not wanted.any():
            continue
        for place in trie.linked(ranks[i], mark, wanted, percent).tolist():
            j = int(owner[place])
            if label[i] != label[j]:
                a, b = sorted((int(label[i]), int(label[j])), key=lambda x: len(members[x]))  # the smaller side is renamed
                label[members[a]] = b
                members[b] += members[a]
                members[a] = []
                if sets.join(ids[i], ids[j]):
                    out.append((ids[i], ids[j]))
    return out


POSTINGS = 1 << 18  #: prefix n-grams that a task looks at together


def run_ends(sizes: list[int], tids: list[int], percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Sets of one n-gram, by size: (set, hub) of every run of fitting sizes, and where in the list runs begin and end.

    Two sets that fit lie in one run or between the ends of two, so that runs
    of several tasks connect through their ends.
    """
    pairs, ends, hub = [], [0], 0
    for k in range(1, len(sizes)):
        if 100 * sizes[hub] >= percent * sizes[k]:
            pairs.append((tids[k], tids[hub]))
        else:
            if 100 * sizes[k - 1] >= percent * sizes[k]:
                pairs.append((tids[k], tids[k - 1]))
            ends += [k - 1] * (k - 1 > hub) + [k]
            hub = k
    return pairs, ends + [len(sizes) - 1] * (len(sizes) - 1 > hub)


def combined(held: list[tuple], percent: int):
    """Rows (gram, n, tid, null) that other tasks' sets may join, and (null, null, tid, hub) of joined ones."""
    gram, n, tid = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((tid, n, gram))
    gram, n, tid = gram[order], n[order], tid[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    stop = np.r_[first[1:], len(gram)].astype(np.int64)
    keep = np.zeros(len(gram), bool)
    keep[first[stop - first == 1]] = True
    pairs: set[tuple[int, int]] = set()
    for a, b in zip(first[stop - first > 1].tolist(), stop[stop - first > 1].tolist()):
        found, ends = run_ends(n[a:b].tolist(), tid[a:b].tolist(), percent)
        pairs.update(found)
        keep[np.array(ends) + a] = True
    names = ["gram", "n", "tid", "hub"]
    yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(n[keep]), pa.array(tid[keep]), pa.nulls(int(keep.sum()), pa.int64())], names)
    u, v = zip(*pairs) if pairs else ((), ())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names)


def links(groups: DataFrame, buckets: int, n: int, percent: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(texts: tid, key, first, copies, n_shingles) and (edges: u, v between tids) of all groups."""

    keys = Keys.drawn(n)

    def counts(g: Group, batch, k):
        unique, number = np.unique(shingles(g, n, keys)[1], return_counts=True)
        return unique, number

    with small_batches(groups.sparkSession):
        counted = written(answered(send(groups, counts, buckets)))

    def candidates(batches):
        for batch in batches:
            for k, g in enumerate(opened(batch)):
                text, gram = shingles(g, n, keys)
                unique, back = np.unique(gram, return_inverse=True)
                total = totals(unique, batch.column("answers")[k].as_py() or [], buckets)
                kind = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)[back]
                size = np.bincount(text, minlength=len(g.ends))
                order = np.lexsort((gram, kind, text))
                gram, kind = gram[order], kind[order]
                start = np.r_[0, np.cumsum(size)[:-1]]
                take = prefix(size, percent)
                # the prefix's last n-gram is its most frequent
                shared = np.flatnonzero((size > 0) & (kind[np.minimum(start + take - 1, max(len(kind) - 1, 0))] > 0)) if len(kind) else np.zeros(0, np.int64)
                keep = np.zeros(len(g.ends), bool)
                keep[shared] = True
                cells = [[], []]
                for i in range(len(g.ends)):
                    a, b = start[i], start[i] + size[i]
                    cells[0].append(gram[a:b].tobytes() if keep[i] else None)
                    cells[1].append(kind[a:b].tobytes() if keep[i] else None)
                tid = (g.number << 20) + np.arange(len(g.ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tid), pa.array(g.keys, pa.binary()), pa.array(g.first), pa.array(g.copies), pa.array(size.astype(np.int32)), pa.array(take.astype(np.int32)), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())],
                    ["tid", "key", "first", "copies", "n", "prefix", "tokens", "classes"],
                )

    with small_batches(groups.sparkSession):
        texts = written(groups.join(counted, "grp", "left").mapInArrow(trimmed(candidates), "tid long, key binary, first long, copies long, n int, prefix int, tokens binary, classes binary"))
    moving = texts.where("tokens is not null")

    def postings(batches):
        """Prefix n-grams of a task's sets; of one that several of them share only the ends of its runs, and the pairs within."""
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for tid, n, take, tokens, classes in zip(*(c.to_pylist() for c in batch.columns)):
                grams = np.frombuffer(tokens, np.int64, take)[np.frombuffer(classes, np.uint8, take) > 0]
                held.append((grams, np.full(len(grams), n, np.int32), np.full(len(grams), tid)))
                count += len(grams)
            if count >= POSTINGS:
                yield from combined(held, percent)
                held, count = [], 0
        if held:
            yield from combined(held, percent)

    local = written(moving.select("tid", "n", "prefix", "tokens", "classes").mapInArrow(trimmed(postings), "gram long, n int, tid long, hub long"))
    posted = local.where("hub is null").select("gram", "n", "tid").repartition(partitions, "gram").sortWithinPartitions("gram", "n", "tid")

    def chained(batches):
        """Neighbours within a run of one n-gram and fitting sizes; a run's first set is the hub."""
        gram = hub = hub_n = before = before_n = None
        pairs: set[tuple[int, int]] = set()
        for batch in batches:
            for g, n, tid in zip(*(c.to_pylist() for c in batch.columns)):
                if g != gram:
                    gram, hub, hub_n = g, tid, n
                elif 100 * hub_n >= percent * n:
                    pairs.add((tid, hub))
                else:
                    if 100 * before_n >= percent * n:
                        pairs.add((tid, before))
                    hub, hub_n = tid, n
                before, before_n = tid, n
            if len(pairs) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])
                pairs = set()
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    near = posted.mapInArrow(chained, "u long, v long").unionByName(local.where("hub is not null").select(F.col("tid").alias("u"), F.col("hub").alias("v")))
    cluster = components(near)
    sizes = cluster.groupBy("component").agg(F.count("node").alias("m"))
    blocks = F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / BLOCK)).otherwise(0)
    sized = written(cluster.join(sizes.select("component", blocks.cast("int").alias("blocks")), "component").withColumnRenamed("node", "tid"))
    small = max(1, -(-(sized.where("blocks = 0").count()) // BLOCK))
    block = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("c"), F.pmod(F.xxhash64("component"), F.lit(small)).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("stored")))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("component").alias("c"), F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j"), (F.col("b") <= o).alias("stored")))
    placed = sized.withColumn("b", F.when(F.col("blocks") > 0, block)).select("tid", F.explode(F.when(F.col("blocks") > 0, cut).otherwise(whole)).alias("cell")).select("tid", "cell.*")
    filled = placed.join(moving.select("tid", "tokens", "classes"), "tid")

    def joined(t: pa.Table) -> pa.Table:
        ids = t.column("tid").to_pylist()
        tokens = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        classes = [np.frombuffer(x, np.uint8) for x in t.column("classes").to_pylist()]
        found = spanning(ids, tokens, classes, t.column("stored").to_numpy(), percent)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    edges = filled.groupBy("c", "i", "j").applyInArrow(joined, "u long, v long")
    return texts.select("tid", "key", "first", "copies", F.col("n").alias("n_shingles")), edges


def components_of_texts(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, first, n_shingles, c) of the distinct texts of ``rows`` (id, text): c names a text's component."""
    with grouped(rows, 1) as groups:
        texts, edges = links(groups.table, slices(groups.n_bytes, 1.2), n, percent, slices(groups.n_bytes, 0.5))
        linked = components(edges).select(F.col("node").alias("tid"), "component")
        return written(texts.join(linked, "tid", "left").select("key", "first", "n_shingles", F.coalesce("component", "tid").alias("c")))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of every component.

    It is the one with the smallest id (without any id: one of the smallest
    text key). Texts without words, null ones too, link with nothing and stay.
    Repeated rows and copies under one id leave one row, ties fall to the
    smaller id, a text of any length is compared as a whole, an empty table
    gives no rows, and columns of any name ride along.
    """
    body = F.coalesce(docs[text], F.lit(""))
    held = components_of_texts(docs.select(docs[id_column].cast("long").alias("id"), body.alias("text")), n, percent).where("n_shingles > 0")
    chosen = held.groupBy("c").agg(F.min(F.struct((F.col("first") == NO_ID).alias("none"), "first", "key")).alias("x"))
    chosen = chosen.select(F.col("x.key").alias("key"), F.when(~F.col("x.none"), F.col("x.first")).alias("first"))
    # the row itself goes into one column, so that no name of docs can clash
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key_of(body).alias("key"), docs[id_column].cast("long").alias("id"), (~body.rlike("[^\\x20\\x09-\\x0D]")).alias("wordless"))
    kept = whole.where("not wordless").join(chosen.withColumnRenamed("key", "chosen_key"), (F.col("key") == F.col("chosen_key")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    return kept.dropDuplicates(["key"]).select("row.*").unionByName(whole.where("wordless").select("row.*"))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id that links reach).

    Two texts link when 100 * intersection >= percent * union of their sets of
    n-grams of words (A-Z in lower case). A text with fewer words is one n-gram;
    null texts and texts without words have none, link with nothing, and are
    their own component. Rows with a null id take part with their text and get
    its component; a component of such rows only is null. Repeated rows and
    copies are one text. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    held = components_of_texts(rows, n, percent)
    named = held.groupBy("c").agg(F.min(F.when(F.col("first") != NO_ID, F.col("first"))).alias("component_id"))
    result = held.join(named, "c").select("key", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
    keyed = rows.select("id", key_of(F.col("text")).alias("key"))
    found = keyed.join(result, "key", "left").withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("long")))
    return found.select(F.col("id").alias(id_column), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
