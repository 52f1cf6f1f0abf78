"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct k-word shingles; documents with equal sets form a class at once (digest
of the set), so copies are never compared. Each class has POSITIONS minhash values. A tree branches the
classes: at its root by one chosen minwise value, below, in every node with more than ``leaf`` classes, by
two values chosen from the node's own hash, down to ``depth``. Small nodes are compared exhaustively by
their minhash values; a large node most of whose members look like its first counts as one group. Nodes that are
still large at ``depth`` are split further while their pairs outgrow the table, down to DEEPEST, and what is large
then is compared exhaustively too, in pairs of blocks of at most about BLOCK members. Trees are
independent and repeated until the chance to part a pair at the threshold in all of them is below 1e-6.

What shares a node and looks alike forms loose components; every true link lies inside one. Links are
then confirmed on the full sets of whole texts: a component up to ``block`` classes in one task, a larger
one dealt to blocks that each also see a few common hubs. Where a large component is then still in
several parts, every class outside its largest part meets every block (the exact way for the rest).
A comparison is skipped only if both sides are linked already, so no link between parts is lost, and
no group ever emits all its pairs. Components follow by alternating star contractions of the links.

No key is hot: rows of a node or root with over a thousandth of all rows stay where they are and get its facts by
broadcast (``common.join_facts``); at most a thousand keys can have that many.

Cases: null or word-less texts have an empty set and stay alone; texts with fewer than k words are one
shingle; repeated rows and equal sets share a class; a class is known by its digest and its own number, so rows that
share a doc_id but not their text are compared each with its own text; ties go to the smaller doc_id; rows with
null doc_id are kept and linked with nothing; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

POSITIONS, TREES, LEAF, DEPTH, BLOCK, HUBS = 64, 10, 48, 2, 768, 4
#: Levels at most; pairs in large nodes, for each member of a node at the roots, up to which no more levels are added.
DEEPEST, PAIRS = 5, 64
_MULT = np.random.default_rng(977).integers(1, 2**63, POSITIONS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(978).integers(0, 2**63, POSITIONS, dtype=np.uint64)


def alike_least(num: int, den: int) -> int:
    """Equal minhash values below which a pair is not alike: five deviations under a pair at the threshold."""
    t = num / den
    return max(1, int(POSITIONS * t - 5 * (POSITIONS * t * (1 - t)) ** 0.5))


def minhash(h: np.ndarray) -> np.ndarray:
    """POSITIONS 32-bit minhash values of a set of 64-bit hashes."""
    out = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        np.minimum(out, (part[None, :] * _MULT[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), digest of the set, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digest, sketch = [], [], []
                for text in part.column(1).to_pylist():
                    h = common.shingle_hashes(text.encode("utf-8", "replace"), k) if text else ()
                    n.append(len(h))
                    digest.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                    sketch.append(minhash(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "t", "n", "digest", "sketch"])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n long, digest binary, sketch binary")


def _value(position):
    """The sketch's 4 bytes at a position, as a hash input."""
    return F.substring(F.col("sketch"), position * 4 + 1, 4)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; a group may span batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        keys = t.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = [t.slice(cut)]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held)


def _stars(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, its group's first) of the groups that a symmetric matrix links."""
    m = len(ok)
    label = np.arange(m)
    while True:
        low = np.minimum(np.where(ok, label[None, :], m).min(axis=1), label)
        if (low == label).all():
            break
        label = low
    far = np.flatnonzero(label != np.arange(m))
    return far, label[far]


def alike(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Star edges (u, v) of the groups of alike members inside each small node (node, id, n, sketch)."""
    least = alike_least(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "node"):
            node, ids, size = (table.column(c).to_numpy() for c in ("node", "id", "n"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int32).reshape(-1, POSITIONS)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            us, vs = [], []
            for a, b in zip(start, np.append(start[1:], len(node)), strict=True):
                m = b - a
                if m < 2:
                    continue
                s, n = sketch[a:b], size[a:b]
                if m == 2:  # most nodes
                    if (s[0] == s[1]).sum() >= least and den * n.min() >= num * n.max():
                        us.append(ids[a + 1 : b])
                        vs.append(ids[a : a + 1])
                    continue
                ok = (s[:, None, :] == s[None, :, :]).sum(axis=2) >= least
                ok &= den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])
                far, first = _stars(ok)
                us.append(ids[a + far])
                vs.append(ids[a + first])
            u, v = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return nodes.mapInArrow(run, "u long, v long")


def alike_large(nodes: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Star edges (u, v) of the alike members of large nodes (node, id, n, sketch, c: the node's members).

    A node is dealt to blocks; every pair of blocks is one group, compared across, a block with itself inside."""
    least = alike_least(num, den)
    of = F.ceil(F.col("c") / block).cast("int")
    dealt = nodes.withColumn("_of", of).withColumn("_b", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("_of")).cast("int"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    pair = F.xxhash64(F.lit(4), "node", F.least("_b", "_o"), F.greatest("_b", "_o"))
    asked = met.select(pair.alias("node"), "id", "n", "sketch", F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "node"):
            node, all_ids, size, sides = (table.column(c).to_numpy() for c in ("node", "id", "n", "side"))
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            us, vs = [], []
            for a, b in zip(start, np.append(start[1:], len(node)), strict=True):
                sketch = np.frombuffer(b"".join(table.column("sketch").slice(a, b - a).to_pylist()), np.int32).reshape(-1, POSITIONS)
                ids, n, side = all_ids[a:b], size[a:b], sides[a:b]
                left, right = (np.arange(b - a),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
                at, to = (np.ascontiguousarray(sketch[x].T) for x in (left, right))
                equal = np.zeros((len(left), len(right)), np.uint8)
                for p in range(POSITIONS):
                    equal += at[p][:, None] == to[p][None, :]
                x, y = n[left][:, None], n[right][None, :]
                near = (equal >= least) & (den * np.minimum(x, y) >= num * np.maximum(x, y))
                linked = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                members = np.unique(np.concatenate([left[linked[0]], right[linked[1]]]))
                if not len(members):
                    continue
                place = np.full(b - a, -1)
                place[members] = np.arange(len(members))
                ok = np.zeros((len(members), len(members)), bool)
                ok[np.ix_(place[left[linked[0]]], place[right[linked[1]]])] = near[np.ix_(*linked)]
                far, first = _stars(ok | ok.T)
                us.append(ids[members[far]])
                vs.append(ids[members[first]])
            u, v = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return asked.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "u long, v long")


def _agreements(a: str, b: str):
    """Equal minhash values of two sketches."""
    values = [F.substring(F.col(a), 4 * i + 1, 4) == F.substring(F.col(b), 4 * i + 1, 4) for i in range(POSITIONS)]
    total = F.lit(0)
    for v in values:
        total = total + v.cast("int")
    return total


def loose_edges(classes: DataFrame, num: int, den: int, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Edges between classes (id, n, sketch) that share a node and look alike.

    Nodes are told apart on (node, id) alone; sketches go only to members of nodes of two and more. A large
    node most of whose members look like its first is one group: all its members are linked to it. No other node is
    linked as a whole, so groups do not grow with the number of sets that happen to share some values."""
    seeds = np.random.default_rng(31).permutation(POSITIONS)[:trees]
    nodes = classes.select("id", F.explode(F.array(*[F.xxhash64(F.lit(t), _value(int(p))) for t, p in enumerate(seeds)])).alias("node"))
    pool, found, at_roots = classes, [], 0
    deepest = max(depth, DEEPEST)
    for level in range(deepest + 1):
        counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first")).where("m > 1")
        counts, most, total = common.stored_facts(counts, "counts", "m")
        at_roots = at_roots or total
        members = common.join_facts(nodes, counts, "node", "m", total, most).select("node", "id", "m", "first")
        # one join hands out the sketches; a class in many nodes has them side by side, which files keep small
        held = common.stored(members.join(pool.hint("merge"), "id").select("node", "id", "m", "first", "n", "sketch"), "members")
        small = held.where(F.col("m") <= leaf).select("node", "id", "n", "sketch")
        found.append(common.stored(alike(small.repartition("node").sortWithinPartitions("node", "id"), num, den).distinct(), "alike"))
        large = held.where(F.col("m") > leaf)
        to_first = large.where("id <> first").select("node", F.col("id").alias("u"), F.col("first").alias("v"))
        if most <= leaf:
            break
        firsts = large.where("id = first").select("node", F.col("sketch").alias("_of"), F.col("m").alias("c"))
        compared = common.join_facts(large.select("node", "sketch"), firsts, "node", "c", total, most)
        near = compared.groupBy("node").agg(F.avg((_agreements("sketch", "_of") >= alike_least(num, den)).cast("int")).alias("near"), F.first("c").alias("c"))
        near = common.stored(near.select("node", "c", (F.col("near") >= 0.8).alias("one")), "near")
        found.append(common.join_facts(to_first, near.where("one"), "node", "c", total, most).select("u", "v"))
        if level >= depth:
            pairs = near.where("not one").agg(F.sum(F.col("c") * F.col("c")).alias("p")).first()["p"] or 0
            if level == deepest or pairs <= PAIRS * at_roots:
                rest = common.join_facts(large.select("node", "id", "n", "sketch"), near.where("not one"), "node", "c", total, most)
                found.append(common.stored(alike_large(rest, num, den).distinct(), "alike"))
                break
        chosen = [F.pmod(F.xxhash64(F.lit(level * 2 + i), "node"), F.lit(POSITIONS)).cast("int") for i in range(2)]
        rest = common.join_facts(large.select("node", "id", "n", "sketch"), near.where("not one"), "node", "c", total, most)
        split = common.stored(rest.select("id", "n", "sketch", F.explode(F.array(*[F.xxhash64("node", F.lit(i), _value(c)) for i, c in enumerate(chosen)])).alias("node")), "level")
        nodes, pool = split.select("id", "node"), split.select("id", "n", "sketch").dropDuplicates(["id"])
    out = found[0]
    for edges in found[1:]:
        out = out.unionByName(edges)
    return out


def _links(table: pa.Table, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the parts of one task's classes (id, part, side, text)."""
    ids, part, side = (table.column(c).to_pylist() for c in ("id", "part", "side"))
    texts = table.column("text")
    order = sorted(range(len(ids)), key=lambda i: (ids[i], side[i]))
    order = [i for n, i in enumerate(order) if not n or (ids[order[n - 1]], side[order[n - 1]]) != (ids[i], side[i])]
    top = list(range(len(order)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    by_part: dict[int, int] = {}
    for x, i in enumerate(order):
        top[x] = by_part.setdefault(part[i], x)
    sets = [common.shingle_hashes(texts[i].as_py().encode("utf-8", "replace"), k) for i in order]
    n, least = np.array([len(x) for x in sets]), alike_least(num, den)
    sketch = np.array([minhash(x) for x in sets])
    sides = np.array([side[i] for i in order])
    out = []
    for y in range(1, len(order)):
        equal = (sketch[:y] == sketch[y]).sum(axis=1)
        near = (equal >= least) & (den * np.minimum(n[:y], n[y]) >= num * np.maximum(n[:y], n[y]))
        if sides[y]:
            near &= sides[:y] != sides[y]
        b, asked = sets[y], np.flatnonzero(near)
        for x in asked[np.argsort(-equal[asked], kind="stable")].tolist():  # the likeliest first: once linked, its part is done
            if root(x) == root(y):
                continue
            a = sets[x]
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            if den * both >= num * (len(a) + len(b) - both):
                out.append((ids[order[x]], ids[order[y]]))
                top[root(y)] = root(x)
    return out


def confirm(tasks: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (u, v) found in tasks (task, id, part, side); classes of one side other than 0 are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "task"):
            task = table.column("task").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            out: list[tuple[int, int]] = []
            for a, b in zip(start, np.append(start[1:], len(task)), strict=True):
                out += _links(table.slice(a, b - a), k, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    full = tasks.join(texts, "id").select("task", "id", "part", "side", "text")
    return full.repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    with common.tidy(docs.sparkSession) as keep:
        sketched = keep(common.stored(sketches(docs, k), "sketches"))
        of_class = keep(_classes(docs, sketched, k, num, den, block))
    return sketched.join(of_class, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _classes(docs: DataFrame, sketched: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame:
    """digest, component (smallest doc_id reachable) of every class."""
    member = sketched.where("n > 0 and doc_id is not null")
    grouped = member.groupBy("digest").agg(F.min_by(F.struct("n", "sketch", "doc_id", "t"), F.struct("doc_id", "t")).alias("s"))
    classes = common.stored(grouped.select("digest", F.monotonically_increasing_id().alias("id"), "s.n", "s.sketch", "s.doc_id", "s.t"), "classes")
    loose = common.components(loose_edges(classes.select("id", "n", "sketch"), num, den), "loose")
    count, widest, total = common.stored_facts(loose.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "loose-sizes", "m")
    dealt = common.stored(common.join_facts(loose, count, "component", "m", total, widest).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / block).cast("long"))), "dealt")
    # the one time whole texts move: those of loose components, for both rounds
    wanted = classes.select("id", "doc_id", "t").join(dealt.select("id"), "id", "left_semi")
    whole = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    texts = common.stored(whole.join(wanted.hint("merge"), ["doc_id", "t"]).select("id", "text"), "texts")
    task = F.xxhash64("component", "block")
    base = dealt.select(task.alias("task"), "id", F.col("id").alias("part"), F.lit(0).alias("side"))
    large = dealt.where(F.col("m") > block)
    hubs = large.where("block = 0").groupBy("component").agg(F.slice(F.array_sort(F.collect_set("id")), 1, HUBS).alias("hubs"))
    blocks = large.select("component", "block").distinct()
    first = base if widest <= block else base.unionByName(hubs.join(blocks, "component").select(task.alias("task"), F.explode("hubs").alias("id")).select("task", "id", F.col("id").alias("part"), F.lit(0).alias("side")))
    links = common.stored(confirm(first, texts, k, num, den), "links")
    found = common.components(links, "linked")
    outside_of = None
    if widest > block:
        parts = large.join(found.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
        sizes = common.stored(parts.groupBy("component", "part").agg(F.count(F.lit(1)).alias("c")), "parts")
        most = sizes.groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        outside_of, _, still_split = common.stored_facts(most, "most", "c")
    if outside_of is not None and still_split:
        split = common.join_facts(parts, outside_of, "component", "c", total, widest)
        outside = split.where("part <> main").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "id"), F.ceil(F.col("m") / block).cast("long")))
        chunks = common.stored(outside.groupBy("component", "chunk").agg(F.count(F.lit(1)).alias("c")), "chunks")
        pairs = chunks.select("component", "chunk").join(blocks, "component")
        key = F.xxhash64(F.lit(2), "component", "chunk", "block")
        asked = outside.select("component", "chunk", "id", "part").join(blocks, "component").select(key.alias("task"), "id", "part", F.lit(1).alias("side"))
        met = split.select("component", "block", "id", "part").join(pairs, ["component", "block"]).select(key.alias("task"), "id", "part", F.lit(2).alias("side"))
        links = links.unionByName(common.stored(confirm(asked.unionByName(met), texts, k, num, den), "links"))
        found = common.components(links, "linked")
    # components go by class numbers; each is named by its smallest doc_id
    ids = found.join(classes.select("id", "doc_id"), "id")
    names, most_ids, total = common.stored_facts(ids.groupBy("component").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("c")), "names", "c")
    named = common.join_facts(found, names, "component", "c", total, most_ids).select("id", "name")
    return common.stored(classes.select("digest", "id", "doc_id").join(named, "id", "left").select("digest", F.coalesce("name", "doc_id").alias("component")), "of-class")


def op10_chosen_path(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.tables(spark, sf_dir, "documents"), 3, 85, 100)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Brute force: all pairs that share a shingle, then everything reachable.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id"""
