"""A Merkle manifest of a table: one leaf per row, a tree per source, a tree of the sources.

Leaves are sorted by source and id into ranges, which a checkpoint keeps: every
later pass meets the same partitions, whatever is lost meanwhile. Each partition
gives one row to the driver, from which prefix sums tell where its first source
goes on and how many leaves its first and last source have. With these offsets a
partition builds every subtree whose leaves it holds, without another exchange.
What is left are the ragged nodes at its two ends, a few per level: they are
shuffled by the coordinate of the ancestor above them, finish the upper levels
there and then by source, and give each ragged node the steps from it to the
subroot. Sources that lie within one partition never leave it.

The subroots are the leaves of one more tree, built by the same steps. At last the
leaves of a partition meet the steps of the sources in it, in one sorted exchange
of ids and digests, and every row gets its proof, its root recomputed from the
row as it is found, and the verdict.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import dropped, native_count, shared_dir, trimmed, written

ARITY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ROWS, MOST = 1 << 14, 1 << 15  #: rows of a range, and ranges at most; beyond that ranges grow
STEP = "array<struct<left: string, right: string>>"
STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hash of a row: each field as ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    framed = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.encode(F.concat(*framed), "UTF-8"), 256)


def up(n: int) -> int:
    return -(-n // ARITY)


class Subtrees:
    """Every node whose leaves all lie in the stretch [start, start + len(leaves)) of a tree of ``total`` leaves.

    levels: (first index, digests) from the leaves up, as far as the stretch holds any.
    """

    def __init__(self, leaves: list[str], start: int, total: int):
        self.levels = [(start, leaves)]
        self.size = [total]
        while self.size[-1] > 1:
            first, nodes = self.levels[-1]
            end, n = first + len(nodes), self.size[-1]
            a, b = up(first), up(n) if end == n else end // ARITY
            if a >= b:
                break
            text = "".join(nodes)
            width = 64 * ARITY
            at = 64 * (ARITY * a - first)
            self.levels.append((a, [sha256(text[at + width * k : at + width * (k + 1)].encode()).hexdigest() for k in range(b - a)]))
            self.size.append(up(n))

    def holds(self, level: int, index: int) -> bool:
        return level < len(self.levels) and self.levels[level][0] <= index < self.levels[level][0] + len(self.levels[level][1])

    def ragged(self):
        """(level, index, digest, root) of the nodes whose parents reach beyond the stretch; the root has none."""
        for level, (first, nodes) in enumerate(self.levels):
            # those with a parent in the stretch are one run in the middle
            above = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            inner = (ARITY * above[0] - first, ARITY * (above[0] + len(above[1])) - first) if above[1] else (0, 0)
            for k in [*range(0, min(inner[0], len(nodes))), *range(max(inner[1], 0), len(nodes))] if above[1] else range(len(nodes)):
                yield level, first + k, nodes[k], self.size[level] == 1

    def step(self, level: int, index: int) -> tuple[str, str]:
        """Digests left and right of a node in its run."""
        first, nodes = self.levels[level]
        run = ARITY * (index // ARITY)
        return "".join(nodes[run - first : index - first]), "".join(nodes[index - first + 1 : run - first + ARITY])

    def climb(self, index: int) -> tuple[list[tuple[str, str]], int, int]:
        """Steps from a leaf up to its ragged node, and that node's level and index."""
        steps, level = [], 0
        while self.size[level] > 1 and self.holds(level + 1, index // ARITY):
            steps.append(self.step(level, index))
            level, index = level + 1, index // ARITY
        return steps, level, index


def joined(nodes: dict[tuple[int, int], str], total: int, until: int | None) -> tuple[dict[tuple[int, int], str], int]:
    """All nodes that follow from ``nodes`` of mixed levels, up to level ``until`` or the root, and the level reached."""
    size, level, have = total, 0, dict(nodes)
    by_level: dict[int, dict[int, str]] = {}
    for (lv, i), d in nodes.items():
        by_level.setdefault(lv, {})[i] = d
    while size > 1 and (until is None or level < until):
        here = by_level.get(level, {})
        for j in sorted({i // ARITY for i in here}):
            run = [here.get(i) for i in range(ARITY * j, min(ARITY * (j + 1), size))]
            if None not in run:
                by_level.setdefault(level + 1, {})[j] = have[level + 1, j] = digest(*run)
        size, level = up(size), level + 1
    return have, level


def finished(t: pa.Table, until: int | None) -> list[tuple]:
    """(level, index, steps, level reached, index there, digest there) for the ragged nodes of one group."""
    total = t.column("total")[0].as_py()
    given = {(lv, i): d for lv, i, d in zip(t.column("level").to_pylist(), t.column("at").to_pylist(), t.column("digest").to_pylist())}
    have, top = joined(given, total, until)
    size = [total]
    for _ in range(top):
        size.append(up(size[-1]))
    out = []
    for (level, i), d in given.items():
        steps, lv, k = [], level, i
        while lv < top:
            run = ARITY * (k // ARITY)
            side = lambda a, b: "".join(have[lv, j] for j in range(a, b))  # noqa: B023, E731
            steps.append({"left": side(run, k), "right": side(k + 1, min(run + ARITY, size[lv]))})
            lv, k = lv + 1, k // ARITY
        out.append((level, i, steps, lv, k, have[lv, k]))
    return out


def ranged(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (grp, id, leaf, ...) sorted by group, id and leaf into ranges that stay as they are from now on, numbered as ``part``."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # a local session without one; on a cluster shared_dir asks for it
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.drop("tie").withColumn("part", F.spark_partition_id()).checkpoint()


def runs_of(keys: list) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal neighbours."""
    n = len(keys)
    cuts = [0, *(k for k in range(1, n) if keys[k] != keys[k - 1]), n] if n else [0]
    return list(zip(cuts[:-1], cuts[1:]))


EDGE = "part int, first string, last string, n_first long, n_last long"
EDGES = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("n_first", pa.int64()), ("n_last", pa.int64())])


def edges(sorted_rows: DataFrame) -> list:
    """One row per partition that has rows: its first and last group and how many rows of each it holds."""

    def run(batches):
        found: dict = {}
        for batch in batches:
            parts, names = batch.column(0), batch.column(1).to_pylist()
            for a, b in runs_of(names):
                if not found:
                    found = {"part": parts[0].as_py(), "first": names[a], "last": names[a], "n_first": 0, "n_last": 0, "one": True}
                if names[a] != found["last"]:
                    found |= {"last": names[a], "n_last": 0, "one": False}
                found["n_last"] += b - a
                found["n_first"] += (b - a) * found["one"]
        if found:
            yield pa.RecordBatch.from_pylist([found], EDGES)

    return sorted(sorted_rows.select("part", "grp").mapInArrow(run, EDGE).collect(), key=lambda r: r["part"])


def offsets(rows: list) -> dict[int, tuple[int, int, int]]:
    """By partition: where its first group goes on, and the whole sizes of its first and of its last group."""
    out: dict[int, list[int]] = {}
    chain: list[tuple[int, int, int]] = []  # of one group: partition, rows there, and which of the two sizes it is

    def close():
        for part, _, side in chain:
            out[part][side] = sum(n for _, n, _ in chain)
        chain.clear()

    before = None
    for r in rows:
        if before is None or before["last"] != r["first"]:
            close()
        out[r["part"]] = [sum(n for _, n, _ in chain), 0, 0]
        chain.append((r["part"], r["n_first"], 1))
        if r["first"] != r["last"]:
            close()
            chain.append((r["part"], r["n_last"], 2))
        else:
            chain.append((r["part"], 0, 2))
        before = r
    close()
    return {part: tuple(x) for part, x in out.items()}


def stretches_of(batches, places: dict, part: int, grp: int):
    """(rows, start, total) of each group of a partition, one at a time; part, grp: where these columns are."""
    held: list[pa.RecordBatch] = []
    state = {"first": True, "name": None}

    def close(last: bool):
        t = pa.Table.from_batches(held)
        offset, first_total, last_total = places[t.column(part)[0].as_py()]
        total = first_total if state["first"] else last_total if last else t.num_rows
        start = offset if state["first"] else 0
        state["first"] = False
        held.clear()
        return t, start, total

    for batch in batches:
        names = batch.column(grp).to_pylist()
        for a, b in runs_of(names):
            if held and names[a] != state["name"]:
                yield close(False)
            state["name"] = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield close(True)


NODE = "part int, grp string, level int, at long, digest string, root boolean, total long"
NODES = pa.schema([("part", pa.int32()), ("grp", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("root", pa.bool_()), ("total", pa.int64())])
REACHED = f"part int, grp string, level int, at long, steps {STEP}, to_level int, to long, digest string, total long"
REACH = pa.schema([("part", pa.int32()), ("grp", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("steps", STEPS), ("to_level", pa.int32()), ("to", pa.int64()), ("digest", pa.string()), ("total", pa.int64())])
TOPPED = f"grp string, to_level int, to long, more {STEP}, top string"
TOPS = pa.schema([("grp", pa.string()), ("to_level", pa.int32()), ("to", pa.int64()), ("more", STEPS), ("top", pa.string())])


def upper(sorted_rows: DataFrame, places: dict, reach: int, apart: bool) -> DataFrame:
    """(part, grp, level, at, steps, top): every ragged node's steps to its group's root, and that root; apart: no group is in two partitions."""

    def local(batches):
        for t, start, total in stretches_of(batches, places, 0, 1):
            same = {"part": t.column(0)[0].as_py(), "grp": t.column(1)[0].as_py(), "total": total}
            found = Subtrees(t.column(2).to_pylist(), start, total).ragged()
            yield pa.RecordBatch.from_pylist([same | {"level": lv, "at": i, "digest": d, "root": r} for lv, i, d, r in found], NODES)

    nodes = written(sorted_rows.select("part", "grp", "leaf").mapInArrow(trimmed(local), NODE), tidy=False)
    whole = nodes.where("root").select("part", "grp", "level", "at", F.array().cast(STEP).alias("steps"), F.col("digest").alias("top"))
    if apart:
        return whole
    rest = nodes.where("not root")

    def first(t: pa.Table) -> pa.Table:
        where = dict(zip(zip(t.column("level").to_pylist(), t.column("at").to_pylist()), t.column("part").to_pylist()))
        same = {"grp": t.column("grp")[0].as_py(), "total": t.column("total")[0].as_py()}
        found = finished(t, reach)
        return pa.Table.from_pylist([same | {"part": where[a, b], "level": a, "at": b, "steps": s, "to_level": c, "to": d, "digest": e} for a, b, s, c, d, e in found], REACH)

    below = F.pow(F.lit(float(ARITY)), F.lit(reach) - F.col("level")).cast("long")
    low = rest.where(F.col("level") < reach).withColumn("under", F.floor(F.col("at") / below).cast("long"))
    met_low = low.groupBy("grp", "under").applyInArrow(first, REACHED)
    high = rest.where(F.col("level") >= reach).select("part", "grp", "level", "at", F.array().cast(STEP).alias("steps"), F.col("level").alias("to_level"), F.col("at").alias("to"), "digest", "total")
    reached = met_low.unionByName(high)

    def last(t: pa.Table) -> pa.Table:
        g = t.column("grp")[0].as_py()
        return pa.Table.from_pylist([{"grp": g, "to_level": a, "to": b, "more": s, "top": e} for a, b, s, _, _, e in finished(t, None)], TOPS)

    heads = reached.select("grp", F.col("to_level").alias("level"), F.col("to").alias("at"), "digest", "total").distinct()
    topped = heads.groupBy("grp").applyInArrow(last, TOPPED)
    same = F.col("r.grp").eqNullSafe(F.col("t.grp")) & (F.col("r.to_level") == F.col("t.to_level")) & (F.col("r.to") == F.col("t.to"))
    linked = reached.alias("r").join(topped.alias("t"), same).select("part", "r.grp", "level", "at", F.concat("steps", "more").alias("steps"), "top")
    found = written(whole.unionByName(linked), tidy=False)
    dropped(nodes)
    return found


def built(rows: DataFrame, n: int, per: int) -> tuple[DataFrame, DataFrame, dict, int]:
    """Sorted rows, the steps of their ragged nodes, the offsets of the partitions, and the number of partitions.

    The nodes of one group above ``reach`` are about three for each partition of it.
    """
    parts = max(1, min(MOST, -(-n // per)))
    sorted_rows = ranged(rows, parts)
    ends = edges(sorted_rows)
    apart = all(a["last"] != b["first"] for a, b in zip(ends, ends[1:]))
    places, reach = offsets(ends), 0
    while ARITY**reach * max(len(ends), 1) < n:
        reach += 1
    return sorted_rows, upper(sorted_rows, places, reach, apart), places, parts


def met(sorted_rows: DataFrame, steps: DataFrame, places: dict, parts: int, values: list[str]) -> DataFrame:
    """Rows of every partition and group behind the steps of its ragged nodes, sorted so that they can be read as a stream.

    Columns: part, grp, kind (0: a node's steps, 1: a row), at and total of a
    row's tree, ``values`` of a row, and the columns of ``steps``.
    """
    names = ["part", "grp", *values]
    fields = ", ".join(f"{c} {sorted_rows.schema[c].dataType.simpleString()}" for c in names)

    def numbered(batches):
        for t, start, total in stretches_of(batches, places, 0, 1):
            n = t.num_rows
            yield from t.append_column("at", pa.array(np.arange(start, start + n))).append_column("total", pa.array(np.full(n, total))).to_batches()

    rows = sorted_rows.select(*names).mapInArrow(numbered, f"{fields}, at long, total long").withColumn("kind", F.lit(1))
    both = steps.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    first = ["part", "grp", "kind", "at"]
    both = both.select(*first, *(c for c in both.columns if c not in first))
    return both.repartitionByRange(parts, "part").sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in first))


def groups(batches):
    """(steps by ragged node, rows as a table) for every partition and group of :func:`met`, one at a time."""
    held: list[pa.RecordBatch] = []
    key = None

    def close():
        t = pa.Table.from_batches(held)
        held.clear()
        mine = t.column("kind").to_numpy() == 1
        steps = t.filter(pa.array(~mine)).to_pylist()
        return {(s["level"], s["at"]): s for s in steps}, t.filter(pa.array(mine))

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for a, b in runs_of(keys):
            if held and keys[a] != key:
                yield close()
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield close()


def tree_of(rows: pa.Table) -> tuple[Subtrees, int]:
    start = rows.column("at")[0].as_py()
    return Subtrees(rows.column("leaf").to_pylist(), start, rows.column("total")[0].as_py()), start


CLIMBED = f"id string, steps {STEP}, root string"
CLIMB = pa.schema([("id", pa.string()), ("steps", STEPS), ("root", pa.string())])


def climbed(sorted_rows: DataFrame, steps: DataFrame, places: dict, parts: int) -> DataFrame:
    """(id, steps, root): the steps of every row of a tree to its root."""

    def run(batches):
        for info, rows in groups(batches):
            tree, start = tree_of(rows)
            out = []
            for k, name in enumerate(rows.column("id").to_pylist()):
                own, level, at = tree.climb(start + k)
                node = info[level, at]
                out.append({"id": name, "steps": [*({"left": a, "right": b} for a, b in own), *node["steps"]], "root": node["top"]})
            yield from pa.Table.from_pylist(out, CLIMB).to_batches()

    return met(sorted_rows, steps, places, parts, ["id", "leaf"]).mapInArrow(run, CLIMBED)


def folded(value: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        value = digest(left, value, right)
    return value


PROVED = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "place"]


def proved(sorted_rows: DataFrame, info: DataFrame, places: dict, parts: int) -> DataFrame:
    """The result rows: each row's steps in its partition, then those of its ragged node."""

    def run(batches):
        for nodes, rows in groups(batches):
            tree, start = tree_of(rows)
            leaves, others = rows.column("leaf").to_pylist(), rows.column("other").to_pylist()
            above = {at: [(s["left"], s["right"]) for s in node["steps"]] for at, node in nodes.items()}
            ends = {at: "".join(a + b for a, b in steps) for at, steps in above.items()}
            ids = rows.column("id").combine_chunks()
            for a in range(0, len(leaves), 4096):
                out = []
                for k in range(a, min(a + 4096, len(leaves))):
                    own, *at = tree.climb(start + k)
                    at = tuple(at)
                    found = folded(leaves[k] if others[k] is None else others[k], own + above[at])
                    root = nodes[at]["root"]
                    out.append((leaves[k], nodes[at]["subroot"], root, digest(*(x + y for x, y in own), ends[at]), found, found == root, start + k))
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(out)), *(pa.array(c) for c in zip(*out))], PROVED)

    kind = sorted_rows.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, place long"
    return met(sorted_rows, info, places, parts, ["id", "leaf", "other"]).mapInArrow(trimmed(run), schema)


def manifest(docs: DataFrame, tampered: Column | None = None, per: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and place in its source.

    tampered: the text as it is found at verification, a column of ``docs``; by
    default the text itself. The proof of a row is the run of digests beside its
    path, from its leaf to the root; ``folded_root`` is what the found row gives
    with them, ``verified`` whether that is the root.

    Hashed are doc_id, source, lang, n_chars and text; any of them may be null,
    and null differs from empty. Null sources are one source, the first; rows
    without id come first in their source. Rows that repeat an id are ordered by
    their leaf, so that equal rows are neighbours, whichever comes first. Texts of
    any length are hashed whole, other columns are not read, and an empty table
    gives no rows. per: about how many rows are one range, which one task holds.
    """
    picked = docs.select(*(docs[c] for c in FIELDS), (docs["text"] if tampered is None else tampered).alias("now"))
    own, other = leaf([F.col(c) for c in FIELDS]), leaf([*(F.col(c) for c in FIELDS[:-1]), F.col("now")])
    differs = F.when(~F.col("text").eqNullSafe(F.col("now")), other)
    rows = picked.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), own.alias("leaf"), differs.alias("other"))
    sorted_rows, steps, places, parts = built(rows, native_count(docs), per)
    subroots = steps.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("top").alias("leaf")).distinct()
    tops = climbed(*built(subroots, native_count(subroots), per))
    to_root = F.col("o.grp").eqNullSafe(F.col("t.id"))
    info = steps.alias("o").join(tops.alias("t"), to_root).select("part", "grp", "level", "at", F.concat("o.steps", "t.steps").alias("steps"), F.col("top").alias("subroot"), "root")
    return proved(sorted_rows, info, places, parts)


#: Parity of crc32 by its definition; trees level by level; steps joined by coordinate; the found leaf folded step by step.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rn,
    CASE WHEN (list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) % 2) = 1
      THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
f AS (SELECT *, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d),
l AS (SELECT rn, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS other FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
t AS (SELECT s, 0 AS lv, pos AS i, leaf AS h, n FROM o
    UNION ALL SELECT s, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY s, lv, i // 3, n),
r AS (SELECT s AS i, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, i, h, (SELECT count(*) FROM r) AS n FROM r
    UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, i // 3, n),
a AS (SELECT s, lv, i, n, h FROM t UNION ALL SELECT -1, lv, i, n, h FROM u),
b AS (SELECT x.s, x.lv, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS lft, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS rgt
    FROM a x JOIN a y ON x.s = y.s AND x.lv = y.lv AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY x.s, x.lv, x.i),
p AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY stage, lv) AS k, lft, rgt FROM (
    SELECT o.rn, 0 AS stage, b.lv, lft, rgt FROM o JOIN b ON b.s = o.s AND b.i = o.pos // (3 ** b.lv)::BIGINT
    UNION ALL SELECT o.rn, 1, b.lv, lft, rgt FROM o JOIN b ON b.s = -1 AND b.i = o.s // (3 ** b.lv)::BIGINT)),
g AS (SELECT rn, 0 AS k, other AS v FROM o UNION ALL SELECT g.rn, g.k + 1, sha256(lft || v || rgt) FROM g JOIN p ON p.rn = g.rn AND p.k = g.k + 1),
z AS (SELECT rn, arg_max(v, k) AS folded_root FROM g GROUP BY rn),
q AS (SELECT rn, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM p GROUP BY rn)
SELECT doc_id, leaf, r.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT h FROM u WHERE n = 1) AS verified, pos AS place
FROM o JOIN r ON r.i = o.s JOIN z USING (rn) LEFT JOIN q USING (rn)
"""
