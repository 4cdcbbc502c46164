"""Operator 12: the trie of conversation prefixes, by union-find over sorted neighbours.

A turn is a unit of 24 bytes: 16 of the SHA-256 of its role and text, and the bytes
of its text.  A conversation is the key of its units; equal keys become one row with
a count.  Keys are dealt to tasks by range and sorted.  Within a task each neighbour
pair is an edge of depth LCP; edges are taken in descending depth, and every merge
of two components makes a branching node, or hangs a component onto one of the same
depth.  What lies on the path of a task's first or last key may go on in another
task: such a forest is contracted to these two paths, with what hangs on them summed
up, and contracted forests of neighbouring tasks are merged by the same union-find,
64 at a time, until one is left.  Nodes that end within a task never move again;
those directly below a boundary path get their parent by its place (a digest) later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

UNIT = 24
#: Turns that a task sorts and links, about, and boundary forests that one task merges.
TASK_TURNS = 1 << 20
MERGED = 64
#: Bytes of a key by which keys are dealt to tasks.
DEALT_BYTES = 32 * UNIT
#: Members of a sequence that are listed in one row.
LISTED = 1 << 16
NOBODY = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind: 0 a node, 1 a node whose parent is at `place` of the task's boundary paths, 2 the contracted forest of a task, 3 a place of it, 4 a place and its node's conv_id.
_FOREST = f"{_NODE}, kind int, part long, place binary, paths binary"


def conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, units): the turns of each conversation in order, as hex units; null turns first, equal turns by their unit."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    token = F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    unit = F.concat(token, F.lower(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    turns = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), unit.alias("unit")).alias("t"))
    return turns.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["unit"]).alias("units"))


def rebuilt(convs: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv, key): conversation c as the first h turns of conversation c - c % family and its own turns after its first h; h is crc32(c) % heads."""
    base = F.col("conv") - F.col("conv") % family
    own = convs.select("conv", "units", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    first = convs.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("units", 1, heads - 1).alias("head"))
    none = F.array().cast("array<string>")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("units", F.col("h") + 1, F.greatest(F.size("units") - F.col("h"), F.lit(0)))
    return own.join(first, "base", "left").select("conv", F.unhex(F.array_join(F.concat(head, rest), "")).alias("key"))


def sequences(keyed: DataFrame) -> DataFrame:
    """(key, n, least, ends) of the distinct keys of (conv, key): members, the smallest, and the SHA-256 of their ascending list.

    Members are listed in rows of bounded size; the digest of a longer list runs over
    its rows in order, in a task that holds one of them at a time.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = materialise(
        keyed.groupBy("key", F.floor(F.col("conv") / LISTED).alias("list")).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), ids.alias("ids")), "trie-lists"
    )
    whole = lists.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.count(F.lit(1)).alias("lists"), F.min("ids").alias("ids"))
    whole = whole.select("key", "n", "least", F.when(F.col("lists") == 1, F.sha2("ids", 256)).alias("ends"))
    long = lists.join(whole.where("ends is null").select("key"), "key", "left_semi").select(F.sha2("key", 256).alias("of"), "list", "ids")

    def digest(batches: Iterator):
        import pyarrow as pa

        now, running = None, hashlib.sha256()
        for batch in batches:
            of, found = batch.column("of").to_pylist(), []
            for i, k in enumerate(of):
                if k != now:
                    if now is not None:
                        found.append((now, running.hexdigest()))
                    now, running = k, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(batch.column("ids")[i].as_py().encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.string()) for j in (0, 1)], names=["of", "long_ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], names=["of", "long_ends"])

    digests = long.repartition("of").sortWithinPartitions("of", "list").mapInArrow(digest, "of string, long_ends string")
    out = materialise(whole.join(digests, F.sha2(whole["key"], 256) == F.col("of"), "left").select("key", "n", "least", F.coalesce("ends", "long_ends").alias("ends")), "trie-sequences")
    discard(lists)
    return out


def shared_units(a: bytes, b: bytes) -> int:
    """Units that two keys start with alike."""
    n = min(len(a), len(b))
    other = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(other[0] if len(other) else n) // UNIT


def places(key: bytes, depths: list[int]) -> dict[int, bytes]:
    """The digest of the key's prefix at each of the depths."""
    running, at, out = hashlib.sha256(), 0, {}
    for d in sorted(set(depths)):
        running.update(key[at * UNIT : d * UNIT])
        out[d], at = running.copy().digest()[:16], d
    return out


class Forest:
    """The trie over sorted distinct keys and the items on them, by union-find.

    lcp: units shared by each key and the next.  Items, in order: row (its key), depth
    (the node it is at), n and least (members), leaves, saved and kids (of what hangs
    below it and is done), ends (digest of the members that end there).  Every key has
    an item at its full depth.
    """

    def __init__(self, keys: list[bytes], lcp: list[int], items: list[tuple]):
        self.keys, self.items = keys, items
        units = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, UNIT)
        self.size = np.array([len(k) // UNIT for k in keys], np.int64)
        total = np.concatenate([[0], np.cumsum(units[:, 16:].copy().view(">u8").ravel().astype(np.int64))])
        first = np.cumsum(self.size) - self.size
        self.at = first + np.arange(len(keys))  # a key of s units has s + 1 running totals
        row = np.repeat(np.arange(len(keys)), self.size + 1)
        self.bytes = total[np.arange(len(row)) - row] - total[first[row]]
        # units that each key shares with the first and with the last one
        far = np.iinfo(np.int64).max
        between = np.array(lcp, np.int64)
        self.left = np.minimum.accumulate(np.concatenate([[far], between]))
        self.right = np.minimum.accumulate(np.concatenate([[far], between[::-1]]))[::-1]
        self._link(lcp)

    def _link(self, lcp: list[int]) -> None:
        row, depth, n, least, leaves, saved, kids = ([x[j] for x in self.items] for j in range(7))
        k = len(row)
        parent, item, at, size = [-1] * k, list(range(k)), self.at.tolist(), self.bytes

        def attach(child: int, v: int) -> None:
            parent[child] = v
            if not kids[child]:
                leaves[child] = 1
            n[v] += n[child]
            least[v] = min(least[v], least[child])
            leaves[v] += leaves[child]
            o = at[row[child]]
            saved[v] += saved[child] + (n[child] - 1) * int(size[o + depth[child]] - size[o + depth[v]])
            kids[v] += 1

        def above(child: int, d: int) -> int:
            row.append(row[child])
            depth.append(d)
            n.append(0)
            least.append(least[child])
            for x in (leaves, saved, kids):
                x.append(0)
            parent.append(-1)
            item.append(-1)
            attach(child, len(row) - 1)
            return len(row) - 1

        edges = [min(depth[i], depth[i + 1], lcp[row[i]] if row[i] != row[i + 1] else depth[i]) for i in range(k - 1)]
        joined, top = list(range(k)), list(range(k))

        def find(i: int) -> int:
            while joined[i] != i:
                joined[i] = joined[joined[i]]
                i = joined[i]
            return i

        for e in np.argsort(-np.array(edges, np.int64), kind="stable").tolist():
            a, b = find(e), find(e + 1)
            if depth[top[a]] != edges[e]:
                top[a] = above(top[a], edges[e])
            attach(top[b], top[a])
            joined[b] = a
        root = top[find(0)]
        if depth[root]:
            root = above(root, 0)
        if not kids[root]:
            leaves[root] = 1
        self.node = {c: np.array(v, np.int64) for c, v in (("row", row), ("depth", depth), ("n", n), ("least", least), ("leaves", leaves), ("saved", saved), ("kids", kids), ("parent", parent), ("item", item))}

    def rows(self, part: int, last: bool):
        """Arrow batches of _FOREST: the nodes that are done, and the contracted forest unless this is the last one."""
        import pickle

        import pyarrow as pa

        v = self.node
        high = np.where(v["parent"] < 0, -1, v["depth"][v["parent"]])
        left, right = self.left[v["row"]], self.right[v["row"]]
        cut = np.full(len(high), -1) if last else np.maximum(left, right)
        side = np.where(left >= right, 0, len(self.keys) - 1)
        low = np.maximum(high, np.minimum(cut, v["depth"]))  # done are the depths below
        count = v["depth"] - low
        hangs = (count > 0) & (cut >= 0) & (high <= cut)
        at = lambda w, d: self.bytes[self.at[v["row"][w]] + d]
        paths: dict[tuple[int, int], list] = {}

        def add(where: tuple[int, int], n: int, least: int, leaves: int, saved: int, kids: int, ends: str) -> None:
            x = paths.setdefault(where, [0, least, 0, 0, 0, NOBODY])
            paths[where] = [x[0] + n, min(x[1], least), x[2] + leaves, x[3] + saved, x[4] + kids, ends if ends != NOBODY else x[5]]

        below = v["saved"] + (v["n"] - 1) * (at(np.arange(len(high)), v["depth"]) - at(np.arange(len(high)), np.maximum(low, 0)))
        for w in np.flatnonzero(hangs).tolist():
            add((int(side[w]), int(cut[w])), int(v["n"][w]), int(v["least"][w]), int(v["leaves"][w]), int(below[w]), 1, NOBODY)
        for w in np.flatnonzero((v["item"] >= 0) & (v["depth"] <= cut)).tolist():
            add((0 if left[w] >= v["depth"][w] else len(self.keys) - 1, int(v["depth"][w])), *self.items[int(v["item"][w])][2:])
        spots = {(r, d): p for r in {r for r, _ in paths} for d, p in places(self.keys[r], [d for q, d in paths if q == r]).items()}

        ends = np.array([x[7] for x in self.items] + [NOBODY], object)
        step = max(1, 100_000)
        starts = np.concatenate([[0], np.cumsum(count)])
        for lo in range(0, int(starts[-1]), step):
            flat = np.arange(lo, min(lo + step, int(starts[-1])))
            w = np.searchsorted(starts, flat, side="right") - 1
            d = low[w] + 1 + flat - starts[w]
            own, top = d == v["depth"][w], d == low[w] + 1
            known = ~top | (~hangs[w] & (high[w] >= 0))
            yield self._batch(
                conv_id=v["least"][w], depth=d,
                parent_conv_id=pa.array(np.where(top, v["least"][v["parent"][w]], v["least"][w]), pa.int64(), mask=~known),
                n_convs=v["n"][w], n_children=np.where(own, v["kids"][w], 1), n_leaves=v["leaves"][w],
                saved_tokens=v["saved"][w] + np.where(d > 0, (v["n"][w] - 1) * (at(w, v["depth"][w]) - at(w, np.maximum(d - 1, 0))), 0),
                ends_sha256=pa.array(np.where(own, ends[v["item"][w]], NOBODY), pa.string()), kind=(top & hangs[w]).astype(np.int32), part=np.full(len(w), part),
                place=pa.array([spots[int(side[x]), int(cut[x])] if t and hangs[x] else None for x, t in zip(w.tolist(), top.tolist(), strict=True)], pa.binary()),
            )
        if not last:
            rows = sorted({0, len(self.keys) - 1})
            blob = pickle.dumps(([self.keys[r] for r in rows], [(rows.index(r), d, *x) for (r, d), x in sorted(paths.items())]), 5)
            yield self._batch(kind=np.array([2], np.int32), part=np.array([part]), paths=pa.array([blob], pa.binary()))
            held = list(spots.values())
            yield self._batch(kind=np.full(len(held), 3, np.int32), part=np.full(len(held), part), place=pa.array(held, pa.binary()))

    def spots(self, cut_off: bool):
        """The places of all items whose node is done, with their conv_id."""
        import pyarrow as pa

        v = self.node
        cut = np.maximum(self.left[v["row"]], self.right[v["row"]]) if cut_off else np.full(len(v["row"]), -1)
        done = np.flatnonzero((v["item"] >= 0) & (v["depth"] > cut))
        by_row: dict[int, list[int]] = {}
        for w in done.tolist():
            by_row.setdefault(int(v["row"][w]), []).append(int(v["depth"][w]))
        found = {(r, d): p for r, ds in by_row.items() for d, p in places(self.keys[r], ds).items()}
        held = [found[int(v["row"][w]), int(v["depth"][w])] for w in done.tolist()]
        return self._batch(kind=np.full(len(done), 4, np.int32), conv_id=v["least"][done], place=pa.array(held, pa.binary()))

    @staticmethod
    def _batch(**columns):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        n = len(next(iter(columns.values())))
        schema = [x.split() for x in _FOREST.split(", ")]
        made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in schema]
        return pa.RecordBatch.from_arrays(made, names=[c for c, _ in schema])


def _sorted_task(batches: Iterator):
    """Task code: the forest of a task's sorted keys."""
    from pyspark import TaskContext

    keys, items = [], []
    for batch in batches:
        n, least, ends = (batch.column(c).to_pylist() for c in ("n", "least", "ends"))
        for i, k in enumerate(batch.column("key").to_pylist()):
            items.append((len(keys), len(k) // UNIT, n[i], least[i], 0, 0, 0, ends[i]))
            keys.append(k)
    if keys:
        yield from Forest(keys, [shared_units(a, b) for a, b in zip(keys, keys[1:], strict=False)], items).rows(TaskContext.get().partitionId(), last=False)


def merged(parts: list[bytes]) -> Forest:
    """The forest of neighbouring contracted forests, in order."""
    import pickle

    keys: list[bytes] = []
    given: list[tuple] = []
    for blob in parts:
        own, items = pickle.loads(blob)
        given += [(len(keys) + r, *x) for r, *x in items]
        keys += own
    lcp = [shared_units(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    found: dict[tuple[int, int], tuple] = {}
    for r, d, n, least, leaves, saved, kids, ends in given:
        while r and lcp[r - 1] >= d:  # the first key that the place is on
            r -= 1
        x = found.get((r, d), (0, least, 0, 0, 0, NOBODY))
        found[r, d] = (x[0] + n, min(x[1], least), x[2] + leaves, x[3] + saved, x[4] + kids, ends if ends != NOBODY else x[5])
    return Forest(keys, lcp, [(*k, *x) for k, x in sorted(found.items())])


def _merge(level: int, last: bool):
    """Task code: neighbouring contracted forests become one."""

    def run(key, table):
        import pyarrow as pa

        order = np.argsort(table.column("part").to_numpy())
        forest = merged([table.column("paths")[int(i)].as_py() for i in order])
        return pa.Table.from_batches([*forest.rows((level << 40) + key[0].as_py(), last), forest.spots(not last)])

    return run


def prefix_trie(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, heads: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt as the first h turns of c - c % family (all if fewer,
    none if absent) and its own turns after its first h; h is crc32 of decimal c, modulo
    heads.  A null turn number comes first; turns of equal number are ordered by the
    SHA-256 of role and text, and repeated rows are turns of their own.  Null role or
    text is empty.  Rows without a conv_id belong to no conversation.  No conversations,
    no nodes.  Extra columns are ignored.  Texts of any length go by digest and size: a
    conversation takes 24 bytes a turn in one row.  Turns are equal when 128 bits of the
    SHA-256 of role and text are.

    A node is a distinct sequence of turns; conv_id is the smallest of its n_convs
    members.  saved_tokens sums, over the node's subtree, (n_convs - 1) times the bytes of
    the last text.
    """
    spark = df.sparkSession
    keyed = materialise(rebuilt(conversations(df, conv_col, turn_col, role_col, text_col), family, heads), "trie-keys")
    found = sequences(keyed)
    turns = found.agg(F.coalesce(F.sum(F.octet_length("key") / UNIT), F.lit(0)).cast("long").alias("n")).first()["n"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TASK_TURNS))
    dealt = found.repartitionByRange(n, F.substring("key", 1, DEALT_BYTES)).sortWithinPartitions("key")
    levels = [materialise(dealt.mapInArrow(_sorted_task, _FOREST), "trie-forest")]
    parts = int(levels[0].agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("n")).first()["n"])
    while parts:
        last = parts <= MERGED
        paths = levels[-1].where("kind = 2").select((F.col("part").bitwiseAND((1 << 40) - 1) / MERGED).cast("long").alias("group"), F.col("part"), "paths")
        levels.append(materialise(paths.groupBy("group").applyInArrow(_merge(len(levels), last), _FOREST), "trie-merged"))
        parts = 0 if last else -(-parts // MERGED)
    discard(keyed, found)
    forest = levels[0]
    for x in levels[1:]:
        forest = forest.union(x)
    nodes = [c.split()[0] for c in _NODE.split(", ")]
    spots = forest.where("kind = 3").select("part", "place").join(forest.where("kind = 4").select("place", F.col("conv_id").alias("above")), "place")
    open_ = forest.where("kind = 1").join(spots, ["part", "place"]).withColumn("parent_conv_id", F.col("above"))
    return forest.where("kind = 0").select(*nodes).union(open_.select(*nodes))
