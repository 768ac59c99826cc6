"""Similarity join on word shingles: globally ordered sets in a prefix tree, pruned by bounds on what remains."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm import workers
from kohort.llm.dealing import BASE, BYTE_VALUES, GROUP_ITEMS, SPREAD, counts_of, deal, gathered, key_of, mix, shared, spread
from kohort.operators.components import connected_components
from kohort.session import cut, ship, shuffle_partitions

WORDS = 5  # of a shingle
PERCENT = 80  # of the union that two sets must have in common
BLOCK_ITEMS = 300_000  # n-grams of the sets that meet in one task
CHUNK = 1 << 18  # bytes hashed at a time
NONE = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, BASE)]), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, np.uint64(pow(int(BASE), -1, 1 << 64)))]), dtype=np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (what stands between spaces 0x20 and 0x09-0x0D), A-Z lower-cased."""
    out = []
    at = 0
    while at < len(text):
        stop = min(len(text), at + CHUNK)
        if stop < len(text):  # cut at a space, if there is one
            back = max(text.rfind(c, at, stop) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if back <= at:
                ahead = [p for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") if (p := text.find(c, stop)) >= 0]
                stop = min(ahead, default=len(text))
            else:
                stop = back
        out.append(_words(np.frombuffer(text, np.uint8, stop - at, at)))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64)
    if len(data) > CHUNK:  # one word longer than a chunk
        return np.array([int.from_bytes(hashlib.blake2b(_LOWER[data[a:b]].tobytes(), digest_size=8).digest(), "little") if b - a > CHUNK else int(_words(data[a:b])[0]) for a, b in zip(first, last)], np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[_LOWER[data]] * _POWERS[: len(data)], dtype=np.uint64)])
    return mix((sums[last] - sums[first]) * _INVERSE[first] + (last - first).astype(np.uint64))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of that many words; of fewer words, the whole sequence is one."""
    h = word_hashes(text)
    n = min(words, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, np.uint64(n))
    for j in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : len(h) - n + 1 + j]
    return np.unique(mix(out))


def least_common(n: int, percent: int) -> int:
    """What a set of n must share at least with any set that it links with."""
    return -(-percent * n // 100)


class _Node:
    __slots__ = ("token", "children", "tail", "item", "low", "high", "part")

    def __init__(self, token):
        self.token, self.children, self.tail, self.item = token, {}, None, -1
        self.low = self.high = 0  # sizes of the sets below
        self.part = -1  # an item of the component that all sets below belong to, -2 if there are several


class PrefixTree:
    """Sets as paths of tokens in one global order; a path without branches is kept as a tail.

    A search walks the tree with the overlap so far, so that sets with a common beginning share it. A subtree is left
    out if no size below it can reach the threshold with what remains of both sets, and, as only components are asked
    for, if all its sets are in the searcher's component already.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.root = _Node(None)
        self.up: list[int] = []
        self.sizes: list[int] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def add(self, tokens: list) -> int:
        item = len(self.up)
        self.up.append(item)
        self.sizes.append(len(tokens))
        return item

    def insert(self, item: int, tokens: list) -> None:
        node, depth, n = self.root, 0, len(tokens)
        while True:
            if node.part == -1:
                node.low = node.high = n
                node.part = item
            else:
                node.low, node.high = min(node.low, n), max(node.high, n)
                if node.part != -2 and self.find(node.part) != self.find(item):
                    node.part = -2
            if node.tail is not None:  # a leaf opens up by one token
                held, rest = node.item, node.tail
                node.tail, node.item = None, -1
                if not rest:
                    node.children[None] = self._leaf(None, held, ())
                else:
                    node.children[rest[0]] = self._leaf(rest[0], held, rest[1:])
            token = tokens[depth] if depth < n else None
            child = node.children.get(token)
            if child is None:
                node.children[token] = self._leaf(token, item, tuple(tokens[depth + 1 :]))
                return
            node = child
            if token is None:  # an equal set stands here
                self.link(node.item, item)
                return
            depth += 1

    def _leaf(self, token, item: int, tail: tuple) -> _Node:
        leaf = _Node(token)
        leaf.item, leaf.tail, leaf.part = item, tail, item
        leaf.low = leaf.high = self.sizes[item]
        return leaf

    def _part(self, node: _Node) -> int:
        if node.part == -2:
            roots = {self._quick(c) for c in node.children.values()}
            if len(roots) == 1 and -2 not in roots:
                node.part = next(iter(roots))
        return node.part if node.part == -2 else self.find(node.part)

    def _quick(self, node: _Node) -> int:
        return -2 if node.part == -2 else self.find(node.part)

    def search(self, item: int, tokens: list, rank: dict) -> None:
        """Link item with a set of every component that has one close enough; tokens are in order, rank their places."""
        q, percent = len(tokens), self.percent
        stack = [(self.root, 0, 0, -1)]  # node, its depth, overlap, place of the last token in common or passed
        while stack:
            node, depth, common, place = stack.pop()
            if self._part(node) == self.find(item):
                continue
            left = q - place - 1
            # With s more of a set of size m in common at most: common + min(left, m - depth) of the union.
            best_m = min(max(node.low, depth + left), node.high)
            best = common + min(left, best_m - depth)
            if 100 * best < percent * (q + best_m - best):
                continue
            if node.tail is not None:
                both = common + sum(map(rank.__contains__, node.tail))
                if 100 * both >= percent * (q + self.sizes[node.item] - both):
                    self.link(node.item, item)
                continue
            ahead = []
            for token, child in node.children.items():
                if token is None:
                    ahead.insert(0, (child, depth, common, place))
                elif (at := rank.get(token)) is None:
                    ahead.insert(0, (child, depth + 1, common, place))
                else:
                    ahead.append((child, depth + 1, common + 1, at))
            stack.extend(ahead)



def _tokens(raw: bytes) -> list:
    return np.frombuffer(raw, "<u8").tolist()


def _join_blocks(percent: int):
    """Components inside each candidate group of a task (side 0), and links from visitors (side 1) to its sets."""

    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, list] = {}
        for cc, side, cid, raw in zip(*(table.column(c).to_pylist() for c in ("cc", "side", "cid", "tokens"))):
            groups.setdefault(cc, []).append((side, cid, raw))
        a, b, inside = [], [], []
        for members in groups.values():
            members.sort(key=lambda x: (x[0], len(x[2]), x[1]))
            tree, cids = PrefixTree(percent), []
            for side, cid, raw in members:
                tokens = _tokens(raw)
                item = tree.add(tokens)
                cids.append(cid)
                tree.search(item, tokens, {t: i for i, t in enumerate(tokens)})
                if side == 0:
                    tree.insert(item, tokens)
            low: dict[int, int] = {}
            for i, cid in enumerate(cids):
                r = tree.find(i)
                low[r] = min(low.get(r, NONE), cid)
            for i, (side, cid, _) in enumerate(members):
                a.append(cid), b.append(low[tree.find(i)]), inside.append(side)
        return pa.table({"cid": pa.array(a, pa.int64()), "root": pa.array(b, pa.int64()), "side": pa.array(inside, pa.int32())})

    return run


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_items: int = BLOCK_ITEMS, uid: str | None = None) -> DataFrame:
    """``uid, doc_id, n_shingles, component_id, first_uid`` for each row of docs.

    Words are what stands between ASCII spaces, A-Z lower-cased; a set is the distinct runs of words of a whole text, by
    64-bit hashes; with fewer words the whole sequence is its one member; null and word-less texts have an empty set
    that links with nothing. Two rows link when 100 * common >= percent * union. component_id is the least doc_id
    reachable by links, the row's own included. Rows with a null doc_id come after all others and name no component
    unless alone in it (null). Repeated rows link as copies do. first_uid is the uid of a component's first row, by doc_id
    and uid; it alone tells components apart, as doc_ids can repeat or be null. uid: a column of docs that numbers its rows; without it one is made here. An empty
    table gives no rows.

    Plan: texts are dealt evenly into buckets; distinct hashes of a bucket (four bytes each) are counted by hash. A set
    can link only if percent of it occurs elsewhere: all other texts end here. Equal sets become one class. Of the
    others the rarest-first prefix (n - ceil(percent * n / 100) + 1) gives keys; classes with a key in common form
    candidate groups, by components. Each group's sets meet once in a prefix tree, most frequent n-gram first. A group
    of more than block_items is dealt into blocks, each with the group's first set; sets that are then in one component
    with it need no further pair, and the rest visit all other blocks. No link between different sets is lost, and no
    pairs are listed.
    """
    ship(docs.sparkSession)
    rows, _, total = deal(docs, uid=uid)
    groups = max(shuffle_partitions(docs.sparkSession), math.ceil(total / 5 / GROUP_ITEMS))

    def grams(table: pa.Table) -> pa.Table:
        workers.drop()
        bucket = table.column("bucket")[0].as_py()
        sets = {s.tobytes(): s for s in (shingles(x.as_py(), words) for x in table.column("text"))}
        every = np.concatenate(list(sets.values()))
        codes, n = np.unique(every, return_counts=True)
        return spread(codes, n, bucket, groups)

    common = rows.groupBy("bucket").applyInArrow(grams, SPREAD).groupBy("grp").applyInArrow(shared, SPREAD)

    def candidates(own: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = gathered(known)
        out: list[list] = [[] for _ in range(4)]
        done: dict[bytes, tuple] = {}
        for text in own.column("text"):
            s = shingles(text.as_py(), words)
            n = len(s)
            raw = s.tobytes()
            own_hash = hashlib.blake2b(raw, digest_size=16).digest()
            if n and own_hash in done:
                row = (n, own_hash, None, None)
            else:
                df = counts_of(key_of(s, groups), keys, counts)
                row = (n, None, None, None)
                if n and int((df >= 2).sum()) >= least_common(n, percent):
                    order = np.lexsort((s, df))  # rarest first
                    prefix = order[: n - least_common(n, percent) + 1]
                    row = (n, own_hash, s[order[::-1]].astype("<u8").tobytes(), s[prefix[df[prefix] >= 2]].view(np.int64).tolist())
                elif n:
                    row = (n, own_hash, raw, [])
                done[own_hash] = row
            for x, v in zip(out, row):
                x.append(v)
        # A set that met no equal one here and can't link anywhere needs no class.
        times: dict[bytes, int] = {}
        for h in out[1]:
            times[h] = times.get(h, 0) + 1
        for i, h in enumerate(out[1]):
            if h is not None and times[h] == 1 and out[3][i] == []:
                out[1][i] = out[2][i] = out[3][i] = None
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([own.column("uid"), own.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["uid", "doc_id", "n", "cls", "tokens", "keys"])

    schema = "uid long, doc_id long, n long, cls binary, tokens binary, keys array<long>"
    judged = cut(rows.groupBy("bucket").cogroup(common.groupBy("bucket")).applyInArrow(candidates, schema))
    id_ = F.coalesce("doc_id", F.lit(NONE))
    member = judged.where(F.col("cls").isNotNull()).select("uid", "doc_id", "n", id_.alias("id"), "cls", "tokens", "keys")
    least = member.groupBy("cls").agg(F.min(F.struct("id", "uid")).alias("m"))
    held = member.where(F.col("tokens").isNotNull()).groupBy("cls").agg(F.first("tokens").alias("tokens"), F.first("keys").alias("keys"))
    # cid numbers a class by its least row; low is that row's doc_id.
    classes = cut(least.join(held, "cls").select("cls", F.col("m.uid").alias("cid"), F.col("m.id").alias("low"), "tokens", "keys"))
    keyed = classes.select("cid", F.explode("keys").alias("key"))
    roots = keyed.groupBy("key").agg(F.min("cid").alias("root"), F.max("cid").alias("top")).where("root < top").select("key", "root")
    stars = keyed.join(roots, "key").where("cid <> root").select("cid", "root").distinct()
    cc = connected_components(stars, "cid", "root").select(F.col("node").alias("cid"), F.col("component").alias("cc"))
    sets = cut(cc.join(classes.select("cid", "tokens"), "cid").select("cc", "cid", "tokens"))
    size = sets.groupBy("cc").agg(F.sum(F.octet_length("tokens") / 8).alias("items"))
    size = size.select("cc", F.ceil(F.col("items") / block_items).cast("int").alias("nb"))
    every = size.agg(F.count("*").alias("n"), F.max("nb").alias("nb")).first()
    spread_to = max(shuffle_partitions(docs.sparkSession), math.ceil((every.n or 0) / 200))
    placed = sets.join(size, "cc").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    # Small groups share tasks; a large one has a task for each block.
    task = lambda *more: F.when(F.col("nb") == 1, F.pmod(F.xxhash64("cc"), F.lit(spread_to))).otherwise(F.xxhash64("cc", *more))
    first = placed.where((F.col("cid") == F.col("cc")) & (F.col("nb") > 1))
    guests = first.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("b <> block").drop("block").withColumnRenamed("b", "block")
    kind = "cid long, root long, side int"
    home = placed.unionByName(guests).select(task("block").alias("task"), "cc", F.lit(0).alias("side"), "cid", "tokens")
    local = home.groupBy("task").applyInArrow(_join_blocks(percent), kind)
    links = local.select("cid", "root")
    if every.nb and every.nb > 1:
        links = cut(links)
        rest = placed.where("nb > 1").join(links.groupBy("cid").agg(F.min("root").alias("root")), "cid").where("root <> cc")
        if not rest.isEmpty():
            rest = rest.withColumn("rb", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("nb")).cast("int"))
            visit = rest.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("b <> block")
            visit = visit.select(F.xxhash64("cc", "rb", "b").alias("task"), "cc", F.lit(1).alias("side"), "cid", "tokens")
            asked = visit.select("task").distinct()
            hosts = placed.where("nb > 1").withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            hosts = hosts.select(F.xxhash64("cc", "rb", "block").alias("task"), "cc", F.lit(0).alias("side"), "cid", "tokens").join(asked, "task", "left_semi")
            links = links.union(hosts.union(visit).groupBy("task").applyInArrow(_join_blocks(percent), kind).select("cid", "root"))
    parts = connected_components(links.where("cid <> root"), "cid", "root").select(F.col("node").alias("cid"), F.col("component").alias("part"))
    named = classes.select("cls", "cid", "low").join(parts, "cid", "left").select("cls", "low", F.coalesce("part", "cid").alias("part"), "cid")
    head = named.groupBy("part").agg(F.min(F.struct("low", "cid")).alias("m"))
    named = named.join(head, "part").select("cls", F.col("m.low").alias("component"), F.col("m.cid").alias("first_uid"))
    found = member.join(named, "cls").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") < NONE, F.col("component")).alias("component_id"), "first_uid")
    alone = judged.where(F.col("cls").isNull()).select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("uid").alias("first_uid"))
    return found.union(alone)
