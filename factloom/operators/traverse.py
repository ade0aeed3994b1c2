"""Traversals: bounded breadth-first search, closures, paths and cycles.

The driver only counts levels; each level is one join of the frontier with the edges, written to the shared folder, so a
lost executor costs a level at most and plans don't grow. With a limit, admission follows the queue's order exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factloom.functions.paths import path_from_id
from factloom.operators.select import edges_between
from factloom.plans.durable import written

IMPORTS = ("IMPORTS_FROM", "DEPENDS_ON")
#: Edge kinds, and whether edges are followed from source to target.
NAMED = {
    "callers_of": (("CALLS",), False),
    "callees_of": (("CALLS",), True),
    "importers_of": (IMPORTS, False),
    "imports_of": (IMPORTS, True),
    "inheritors_of": (("INHERITS",), False),
    "children_of": (("CONTAINS",), True),
}


def _steps(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] | None, outward: bool) -> DataFrame:
    """Edges as steps a -> b to nodes that exist, with the edge's sort key."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(list(kinds)))
    a, b = ("src", "dst") if outward else ("dst", "src")
    steps = e.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct("kind", "src", "dst", "id").alias("edge"))
    return steps.join(nodes.select(F.col("id").alias("b")), "b", "left_semi")


#: Ids of a level, and bytes in them, up to which they are sent to all tasks.
FEW_IDS, FEW_BYTES = 200_000, 16 << 20


def _counted(df: DataFrame, *more: Column) -> tuple[DataFrame, Row]:
    """A written table of ids, to go to all tasks if it is counted few; and its count, bytes and `more` of it."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((F.octet_length(c) for c in df.columns), F.lit(0))), F.lit(0)).alias("size"), *more).first()
    return (F.broadcast(df) if row["n"] <= FEW_IDS and row["size"] <= FEW_BYTES else df), row


def existing(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id) of a written table of distinct ids whose nodes exist. Few ids go to the nodes, which then aren't shuffled."""
    ids, row = _counted(found.select("id"))
    if row["n"] <= FEW_IDS and row["size"] <= FEW_BYTES:
        return nodes.select("id").join(ids, "id", "left_semi").distinct()
    return found.select("id").join(nodes.select("id"), "id", "left_semi")


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame, kinds: Sequence[str] | None, outward: bool, max_depth: int | None) -> DataFrame:
    """(id, depth) of nodes within `max_depth` steps of the starts (id); None: as far as it goes."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(list(kinds)))
    a, b = ("src", "dst") if outward else ("dst", "src")
    steps = e.select(F.col(a).alias("a"), F.col(b).alias("b"))
    front = written(existing(nodes, written(starts.select("id").distinct(), "starts")).select("id", F.lit(0).alias("depth")), "reach")
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        # The frontier meets the edges first: what is made distinct and looked up is only what a level finds.
        new = front.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        new = written(new.join(seen.select("id"), "id", "left_anti"), "found")
        front = written(existing(nodes, new).select("id", F.lit(depth).alias("depth")), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reached_edges(nodes: DataFrame, edges: DataFrame, reached: DataFrame, kinds: Sequence[str] | None, outward: bool, max_depth: int) -> DataFrame:
    """Edges scanned while expanding a node above the last level, with both ends reached."""
    open_ = reached.where(F.col("depth") < max_depth).select(F.col("id").alias("src" if outward else "dst"))
    e = edges if kinds is None else edges.where(F.col("kind").isin(list(kinds)))
    return edges_between(e.join(open_, "src" if outward else "dst", "left_semi").select(*edges.columns), reached)


def reach_limited(nodes: DataFrame, edges: DataFrame, starts: DataFrame, kinds: Sequence[str] | None, outward: bool, max_depth: int, limit: int) -> tuple[DataFrame, bool]:
    """(id, depth, pos) in the order in which a queue would admit nodes, at most `limit`; whether any node was turned away.

    starts: (id, pos). A level's candidates come by the parent's place, then by edge; the first time a node comes counts.
    """
    steps = _steps(nodes, edges, kinds, outward)
    known = nodes.select("id").distinct()
    order = written(starts.groupBy("id").agg(F.min("pos").alias("pos")).join(known, "id", "left_semi"), "queue")
    taken, truncated, depth, seen, front = 0, False, 0, None, None
    candidates = order.select("id", F.struct(F.col("pos")).alias("key"))
    while True:
        best = candidates.orderBy("key").limit(limit - taken + 1)
        ranked = best.withColumn("pos", F.row_number().over(Window.orderBy("key")) + taken).select("id", F.lit(depth).alias("depth"), "pos")
        front = written(ranked, "queue")
        n = front.count()
        if n > limit - taken:
            truncated = True
            front = front.where(F.col("pos") <= limit)
            n = limit - taken
        taken += n
        seen = front if seen is None else seen.unionByName(front)
        if not n or depth >= max_depth:
            return seen, truncated
        depth += 1
        new = front.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.struct("pos", "edge").alias("key"))
        candidates = new.groupBy("id").agg(F.min("key").alias("key")).join(seen.select("id"), "id", "left_anti")
        if taken >= limit:
            return seen, truncated or not candidates.isEmpty()


def contained(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of all that CONTAINS edges reach; a root only if it lies on a cycle."""
    below = reach(nodes, edges, roots, ("CONTAINS",), True, None)
    again = _steps(nodes, edges, ("CONTAINS",), True).join(below.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    return below.where("depth > 0").select("id").unionByName(again.join(below.where("depth = 0"), "id", "left_semi")).distinct()


def resolve_targets(nodes: DataFrame, edges: DataFrame, target: str, expand_files: bool) -> DataFrame:
    """(id, pos): the node with this id, else the file with this path; for callers, callees and tests of a file also all it contains."""
    from factloom.functions.paths import normalize_path

    path = target.removeprefix("./")
    own = nodes.where((F.col("id") == target) | ((F.col("kind") == "File") & (F.col("path") == normalize_path(F.lit(path)))))
    own = own.orderBy((F.col("id") != target).cast("int"), "id").limit(1).select("id")
    if not expand_files:
        return own.select("id", F.lit(0).alias("pos"))
    roots = own.where(F.col("id").startswith("file:"))
    below = contained(nodes, edges, roots).join(own, "id", "left_anti")
    ranked = below.withColumn("pos", F.row_number().over(Window.orderBy("id")))
    return own.select("id", F.lit(0).alias("pos")).unionByName(ranked)


def tests_for(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): the starts, their tests by one TESTED_BY step, and the tests' files."""
    tests = _steps(nodes, edges, ("TESTED_BY",), True).join(starts.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    paths = nodes.join(tests, "id", "left_semi").select(F.coalesce("path", path_from_id(F.col("id"))).alias("path")).distinct()
    files = nodes.where("kind = 'File'").join(paths, "path", "left_semi").select("id")
    own = starts.select("id").join(nodes.select("id"), "id", "left_semi")
    return own.unionByName(tests).unionByName(files).distinct()


def file_summary(nodes: DataFrame, edges: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges: all a file contains, then its imports one step both ways."""
    start = resolve_targets(nodes, edges, target, False).select("id")
    inside = start.unionByName(contained(nodes, edges, start)).distinct()
    both = [_steps(nodes, edges, IMPORTS, o).join(start.select(F.col("id").alias("a")), "a", "left_semi") for o in (True, False)]
    near = both[0].unionByName(both[1])
    all_nodes = inside.unionByName(near.select(F.col("b").alias("id"))).distinct()
    kept = edges_between(edges.where("kind = 'CONTAINS'"), all_nodes).unionByName(near.select("edge.*").select(*edges.columns))
    return all_nodes, kept.distinct()


def dependents(before: DataFrame, after: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): files that import the roots (id), directly or not, in either graph; without the roots."""
    e = before.unionByName(after).where(F.col("kind").isin(*IMPORTS) & F.col("src").startswith("file:") & F.col("dst").startswith("file:"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(roots.select("id")).distinct()
    return reach(nodes, e, roots, IMPORTS, False, None).where("depth > 0").select("id").join(roots, "id", "left_anti")


def reachable_symbols(nodes: DataFrame, edges: DataFrame, entry_files: DataFrame) -> DataFrame:
    """(id): files by imports from the entry files, then symbols in them and all they call, inherit or implement."""
    files = reach(nodes, edges, entry_files, ("IMPORTS_FROM",), True, None).select("id")
    roots = _steps(nodes, edges, ("CONTAINS",), True).join(files.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    symbols = reach(nodes, edges, roots.distinct(), ("CALLS", "INHERITS", "IMPLEMENTS"), True, None).select("id")
    return files.unionByName(symbols).distinct()


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, kinds: Sequence[str], max_depth: int = 64) -> DataFrame:
    """(step, id, edge_kind) of a shortest path; among equal ones the parent with the smallest edge key. Empty if none."""
    steps = written(_steps(nodes, edges, kinds, True), "steps")
    front = written(nodes.where(F.col("id") == source).select("id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("step")), "path")
    levels, depth = [front], 0
    while depth < max_depth and not front.isEmpty() and front.where(F.col("id") == target).isEmpty():
        depth += 1
        seen = reduce(DataFrame.unionByName, (x.select("id") for x in levels))
        new = front.select("id").join(steps, F.col("id") == F.col("a")).groupBy("b").agg(F.min("edge").alias("edge"))
        new = new.select(F.col("b").alias("id"), F.col("edge.src").alias("parent"), F.col("edge.kind").alias("kind")).join(seen, "id", "left_anti")
        front = written(new.withColumn("step", F.lit(depth)), "path")
        levels.append(front)
    # Back along parents: one row a level.
    rows, at = [], target
    for level in reversed(levels):
        row = level.where(F.col("id") == at).first()
        if row is None:
            break
        rows.append((row["step"], row["id"], row["kind"]))
        at = row["parent"]
    return nodes.sparkSession.createDataFrame(rows, "step int, id string, edge_kind string")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(src, dst): edges left after nodes without an edge in or out are trimmed, again and again."""
    e = written(edges.select("src", "dst").where("src <> dst").distinct(), "core")
    while True:
        ends = e.select(F.col("src").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(e.select("dst", F.lit(0), F.lit(1))).groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        lost, row = _counted(written(ends.where("a + b < 2").select("id"), "lost"))
        if not row["n"]:
            return e
        e = written(e.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "core")


def strong_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): nodes of strongly connected components of two or more; the component's name is its smallest node.

    Each round colours nodes by the smallest node that reaches them; those that reach their colour back are its component.
    """
    left, out = cyclic_core(edges), None
    for _ in range(rounds):
        if left.isEmpty():
            break
        colour = written(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")), "scc")
        own, changed = _counted(colour)[0], 1
        while changed:
            better = left.join(own.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.min("c").alias("m"))
            new = written(colour.join(better, F.col("id") == F.col("dst"), "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("less")), "scc")
            changed, colour = new.where("less").count(), new.select("id", "c")
            own = _counted(colour)[0]
        inner = left.join(own.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(own.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inner = written(inner.select("src", "dst", F.col("cs").alias("c")), "scc")
        back = written(inner.select(F.col("c").alias("id"), "c").distinct(), "scc")
        front, row = _counted(back)
        while row["n"]:
            new = written(inner.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "c").distinct().join(back, ["id", "c"], "left_anti"), "scc")
            front, row = _counted(new)
            back = back.unionByName(new)
        found = written(back.join(inner.select("c").distinct(), "c", "left_semi").select("id", F.col("c").alias("component")), "scc")
        sized = found.groupBy("component").count().where("count > 1").select("component")
        found = found.join(sized, "component", "left_semi").select("id", "component")
        out = found if out is None else out.unionByName(found)
        rest = left.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = cyclic_core(rest.select("src", "dst"))
    else:
        raise RuntimeError("strong components did not settle")
    return out if out is not None else edges.sparkSession.createDataFrame([], "id string, component string")


def cycles_of(adjacency: dict[str, list[str]], *, rotate: bool = True, dedupe: bool = True) -> list[list[str]]:
    """Cycles by depth-first back edges over sorted neighbours; rotated to the smallest node and named once each.

    `rotate=False` keeps a cycle as found, still compared by rotation if `dedupe`.
    """
    found, keys, done = [], set(), set()
    for root in sorted(adjacency):
        if root in done:
            continue
        path, on_path, stack = [root], {root: 0}, [iter(sorted(adjacency.get(root, ())))]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                last = path.pop()
                done.add(last)
                del on_path[last]
            elif nxt in on_path:
                cycle = path[on_path[nxt] :]
                at = cycle.index(min(cycle))
                turned = cycle[at:] + cycle[:at]
                if not dedupe or tuple(turned) not in keys:
                    keys.add(tuple(turned))
                    found.append(turned if rotate else cycle)
            elif nxt not in done:
                on_path[nxt] = len(path)
                path.append(nxt)
                stack.append(iter(sorted(adjacency.get(nxt, ()))))
    return found


#: Text of cycles in a block, at least; and text in a batch of rows, about.
BLOCK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Partitions that components are dealt to, at least: so many that large components seldom meet in one task.
SEARCHES = 96


def component_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, cycle): cycles in each strong component, as ` -> ` paths.

    The order of a depth-first search is one task's work for each component. It holds the component's edges as numbers and
    only notes its steps; where their cycles' text grows long, they are cut into blocks, which other tasks turn into text.
    """
    members = _counted(components.select("id", "component"))[0]
    e = edges.select("src", "dst").distinct().join(members.select(F.col("id").alias("src"), F.col("component")), "src")
    e = e.join(members.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")

    most = BLOCK_BYTES
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.int64())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, near in _adjacencies(batches):
            for block in search_blocks(*near, most):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, *block), kinds)], ["component", "names", "ranks", "depth", "steps", "size"])

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, names, ranks, depth, steps in zip(*(batch.column(i) for i in range(5))):
                for cycles in block_cycles(names.as_py(), ranks.values.to_numpy(), depth.as_py(), steps.values.to_numpy().tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(cycles), pa.string()), cycles], ["component", "cycle"])

    parts = max(SEARCHES, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = e.select("component", "src", "dst").repartition(parts, "component").sortWithinPartitions("component", "src", "dst")
    blocks = written(own.mapInArrow(search, "component string, names array<string>, ranks array<int>, depth int, steps array<int>, size long"), "blocks")
    n = blocks.agg(F.sum("size")).first()[0] or 0
    return blocks.repartition(1 + n // most).mapInArrow(text, "component string, cycle string")


def _adjacencies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple[list[str], np.ndarray, np.ndarray]]]:
    """Each component of rows in order of (component, src, dst): its name, and the nodes, edges' first places and targets.

    In a strong component each node is a source, so sources in order are all nodes, and a node's number is its rank.
    """
    name, nodes, first, ends, n = None, [], [], [], 0

    def done() -> tuple[str, tuple[list[str], np.ndarray, np.ndarray]]:
        rank = {x: i for i, x in enumerate(nodes)}
        return name, (nodes, np.array([*first, n]), np.array([rank[x] for x in ends], np.int32))

    for batch in batches:
        for c, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if c != name:
                if name is not None:
                    yield done()
                name, nodes, first, ends, n = c, [], [], [], 0
            if not nodes or nodes[-1] != a:
                nodes.append(a)
                first.append(n)
            ends.append(b)
            n += 1
    if name is not None:
        yield done()


#: Steps of a search besides closing a cycle at a place of the path.
BACK, ON = -1, -2


def search_blocks(nodes: list[str], first: np.ndarray, targets: np.ndarray, most: int) -> Iterator[tuple[list[str], list[int], int, list[int], int]]:
    """The search of `cycles_of` over sorted numbers of nodes, in blocks: names, ranks, depth, steps and bytes of text.

    The names (and ranks) are those of the path where the block begins, `depth` of them, then of each node that it goes ON
    to. Other steps go BACK, or close the cycle from a place of the path on. A block ends beyond `most` bytes of text and eight
    times its path.

    Each back edge of a search closes one cycle, and no other has that edge as its only one outside the tree, so that none
    is found twice.
    """
    place = [-1] * len(nodes)  # on the path, or -2: done
    at, end, targets = first[:-1].tolist(), first[1:].tolist(), targets.tolist()
    width = [len(x.encode()) + 4 for x in nodes]
    path, starts, total = [], [], 0  # starts: bytes of the path before each place
    base, depth, went, steps, size = [], 0, [], [], 0

    def block() -> tuple[list[str], list[int], int, list[int], int]:
        ranks = base + went
        return [nodes[x] for x in ranks], ranks, depth, steps, size

    for root in range(len(nodes)):
        if place[root] != -1:
            continue
        nxt = root
        while True:
            if nxt is not None:
                place[nxt] = len(path)
                path.append(nxt)
                starts.append(total)
                total += width[nxt]
                went.append(nxt)
                steps.append(ON)
            if not path:
                break
            last, nxt = path[-1], None
            while at[last] < end[last]:
                to = targets[at[last]]
                at[last] += 1
                if place[to] >= 0:
                    steps.append(place[to])
                    size += total - starts[place[to]]
                    if size > most and size > 8 * total:
                        yield block()
                        base, depth, went, steps, size = list(path), len(path), [], [], 0
                elif place[to] == -1:
                    nxt = to
                    break
            if nxt is None:
                place[path.pop()] = -2
                total = starts.pop()
                steps.append(BACK)
    if size:
        yield block()


def block_cycles(names: list[str], ranks: np.ndarray, depth: int, steps: list[int]) -> Iterator[pa.StringArray]:
    """The cycles of a block in batches, each turned to its smallest node and closed by it again.

    The path's text is kept as it goes, so a cycle is two pieces of it.
    """
    raw = [x.encode() + b" -> " for x in names]
    path, text, starts = np.empty(len(names), np.int32), bytearray(), []
    n, come = 0, 0

    def cycles(out: bytearray, lengths: list[int]) -> pa.StringArray:
        offsets = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(out))

    out, lengths = bytearray(), []
    for step in [ON] * depth + steps:
        if step == ON:
            path[n] = ranks[come]
            starts.append(len(text))
            text += raw[come]
            n, come = n + 1, come + 1
        elif step == BACK:
            n -= 1
            del text[starts.pop() :]
        else:
            least = step + int(path[step:n].argmin())
            stop = (starts[least + 1] if least + 1 < n else len(text)) - 4
            out += memoryview(text)[starts[least] :]
            out += memoryview(text)[starts[step] : stop]
            lengths.append(len(text) - starts[least] + stop - starts[step])
            if len(out) > BATCH_BYTES:
                yield cycles(out, lengths)
                out, lengths = bytearray(), []
    if lengths:
        yield cycles(out, lengths)
