"""N-gram Jaccard self-join with signature trees: which texts share so many word n-grams that they're one group.

A document's set holds its distinct word n-grams (ASCII letters lower-cased). Documents with equal sets are one class,
held by its smallest id. Classes that may link are routed to one another without loss: for a size class, n-grams are
dealt by hash into more parts than two linked sets can differ in, so linked sets agree in some part, and parts are
compared by digest; each set passes over its most frequent digests, as many as linked sets have to spare, so that
passages which many documents share connect nothing. What the other agreements connect is joined by one signature tree: its nodes hold OR-combined token
bitmaps and size ranges, and a dual traversal prunes pairs of nodes by the overlap that is still possible, or because
they're connected already. Remaining pairs are verified exactly.

A text with fewer words than n is one n-gram; a null text, or one without words, has an empty set and is linked with
nothing. Rows that share a doc_id count as one document, linked with all that any of its texts is linked with; a null
doc_id has the component null. Repeated rows are given back as often as they come; an empty table gives no rows. Texts may
be of any length: one is held whole by a task, with its n-grams. Other columns don't disturb, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, passes, tidied, utf8, window_hashes, with_text, word_hashes
from corpusloom.llm.substring_dedup import BLOCK_BYTES, growth, pack, pack_sorted, ranged, unpack, unpack_sorted
from corpusloom.operators.graph import connected_components as components
from corpusloom.plans.storage import cut_lineage, drop

NGRAM, PERCENT = 3, 90
#: Keys that one range holds, documents that one tree holds before its group is dealt into pieces, bits of a bitmap.
RANGE_KEYS, TREE, BITS = 1 << 20, 1000, 4096
PIVOTS = 16
#: A group's rows that meet what is known of the group in one place, at least; groups with more rows, at most.
SHARE, HOT = 1 << 16, 1 << 16
FANOUT = 8


def ordered(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal n-grams side by side, and in it where a new one begins."""
    order = np.argsort(grams[0], kind="stable")
    one, two = grams[:, order]
    new = np.ones(len(order), bool)
    new[1:] = one[1:] != one[:-1]
    if (~new[1:] & (two[1:] != two[:-1])).any():  # unlike n-grams that agree in the first hash
        order = np.lexsort((grams[1], grams[0]))
        one, two = grams[:, order]
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return order, new


def sets(part: pa.Table | pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Distinct n-grams of each text in the slice: two rows of hashes, 128 bits for each n-gram, ascending."""
    data, offsets = utf8(part.column("text"))
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    one, two, first = word_hashes(data, offsets)
    grams, at = window_hashes(one, first, n)
    grams = np.stack([grams, window_hashes(two, first, n, 5)[0]])
    bounds = np.searchsorted(at, first)
    out = []
    for i in range(len(first) - 1):
        a, b, k = bounds[i], bounds[i + 1], int(first[i + 1] - first[i])
        if k >= n:
            order, new = ordered(grams[:, a:b])
            out.append(grams[:, a:b][:, order[new]])
        elif k:
            whole = [window_hashes(x[first[i] : first[i + 1]], np.array([0, k]), k, 1000 * seed + k)[0] for x, seed in ((one, 1), (two, 2))]
            out.append(np.stack(whole))
        else:
            out.append(np.zeros((2, 0), np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    return int((mix(s[0], 21).sum() + np.uint64(s.shape[1])).view(np.int64)), int(mix(s[1], 22).sum().view(np.int64))


class Classes:
    """Size classes: a set links only within its own class or with its neighbour's. Parts by class, and how many of
    them a linked pair can differ in."""

    def __init__(self, percent: int):
        self.percent, edges = percent, [1]
        while edges[-1] < 1 << 48:
            edges.append(edges[-1] * 100 // percent + 1)
        self.edges = np.array(edges)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def parts(self, c: int) -> tuple[int, int]:
        """Parts, and the spare ones: parts less the largest difference less one."""
        differ = 2 * (int(self.edges[c + 1]) - 1) * (100 - self.percent) // (100 + self.percent)
        spare = 1 + differ // 3
        return (differ + 1 + spare if differ else 0), spare


#: Bits of a part's digest. Shorter digests agree by chance more often, which only sends more to the trees.
KEY_BITS = 48


def keys(s: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Part digests of a set in the joins of its class and of the next one, and these classes.

    In a class's join, linked sets agree in at least one part more than there are spare ones. So each set may pass
    over its most frequent digests, as many as are spare (by frequency, then digest, which is the same order for all):
    the rarest one that a linked pair shares has that many shared ones before it, and stays with both."""
    s = s[0]
    own, out, of = classes.of(len(s)), [], []
    for c in (own, own + 1):
        m, _ = classes.parts(c)
        if not m:
            continue
        part = (mix(s, 31 + c) % np.uint64(m)).astype(np.int64)
        low, high = (np.bincount(part, (mix(s, 41) >> np.uint64(shift)) & np.uint64(0xFFFFFFFF), m) for shift in (0, 32))
        value = mix(low.astype(np.uint64) ^ mix(high.astype(np.uint64), 43) ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 32), 44))
        out.append(value >> np.uint64(64 - KEY_BITS))
        of.append(np.full(m, c))
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _block_keys(docs: pa.Table, reps: pa.Table, n: int, classes: Classes):
    """Keys, their classes and documents for the block's class holders."""
    held, seen = set(reps.column("rep").to_pylist()), set()
    out = ([], [], [])
    for part in passes(docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])):
        for id_, s in zip(part.column("doc_id").to_pylist(), sets(part, n)):
            if id_ in held and s.shape[1] and (d := digest(s)) not in seen:
                seen.add(d)
                k, c = keys(s, classes)
                for o, x in zip(out, (k, c, np.full(len(k), id_))):
                    o.append(x)
    kinds = (np.uint64, np.int64, np.int64)
    k, c, ids = (np.concatenate(o).astype(t) if o else np.zeros(0, t) for o, t in zip(out, kinds))
    order = np.lexsort((ids, k))
    return k[order], c[order], ids[order]


def _table(rows: list, names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def _firsts(k: np.ndarray) -> np.ndarray:
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return np.flatnonzero(new)


def _signatures(n: int, percent: int, n_ranges: int):
    span = -(-(1 << KEY_BITS) // n_ranges)

    def run(key, docs, reps):
        rows = []
        if docs.num_rows and reps.num_rows:
            k, _, ids = _block_keys(docs, reps, n, Classes(percent))
            first = _firsts(k)
            count = np.diff(np.append(first, len(k)))
            k, ids = k[first], ids[first]
            edges = ranged(k, n_ranges, span)
            for i in np.flatnonzero(np.diff(edges)):
                a, b = edges[i], edges[i + 1]
                mine, at = np.unique(ids[a:b], return_inverse=True)
                rows.append((key[0].as_py(), int(i), pack_sorted(k[a:b] - np.uint64(i * span)), pack(mine), pack(at.astype(np.uint32 if len(mine) > 1 << 16 else np.uint16)), pack(np.minimum(count[a:b], 255).astype(np.uint8))))
        return _table(rows, ["block", "range", "keys", "docs", "at", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _hubs(key, table):
    """Keys of one range from all blocks: how many documents have each (as a power of two), and the smallest of these."""
    k = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    ids = [(d := unpack(x, np.int64))[unpack(a, np.uint32 if len(d) > 1 << 16 else np.uint16)] for x, a in zip(table.column("docs").to_pylist(), table.column("at").to_pylist())]
    every, owner, many = np.concatenate(k), np.concatenate(ids), np.concatenate([unpack(x, np.uint8) for x in table.column("n").to_pylist()])
    order = np.lexsort((owner, every))
    first = _firsts(every[order])
    group = np.zeros(len(order), np.int64)
    group[first] = 1
    group = np.cumsum(group) - 1
    total = np.add.reduceat(many[order].astype(np.int64), first)
    count, hub = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
    count[order], hub[order] = np.minimum(255, np.floor(16 * np.log2(total)))[group], owner[order][first][group]
    rows, a = [], 0
    for block, x in zip(table.column("block").to_pylist(), k):
        mine = slice(a, a + len(x))
        a += len(x)
        if count[mine].any():
            rows.append((block, int(key[0].as_py()), pack(count[mine]), pack(hub[mine][count[mine] > 0])))
    return _table(rows, ["block", "range", "counts", "hubs"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _agreements(n: int, percent: int, n_ranges: int):
    span = -(-(1 << KEY_BITS) // n_ranges)

    def run(key, docs, both):
        names, kinds = ["c", "hub", "doc"], [pa.int32(), pa.int64(), pa.int64()]
        is_reply = np.asarray(both.column("range").fill_null(-1)) >= 0
        reps, replies = both.filter(pa.array(~is_reply)), both.filter(pa.array(is_reply))
        if not docs.num_rows or not reps.num_rows or not replies.num_rows:
            return _table([], names, kinds)
        classes = Classes(percent)
        k, c, ids = _block_keys(docs, reps, n, classes)
        first = _firsts(k)
        edges = ranged(k[first], n_ranges, span)
        count, hub = np.zeros(len(first), np.uint8), np.zeros(len(first), np.int64)
        for i, counts, hubs in zip(*(replies.column(x).to_pylist() for x in ("range", "counts", "hubs"))):
            a, b = edges[i], edges[i + 1]
            count[a:b] = unpack(counts, np.uint8)
            hub[a:b][count[a:b] > 0] = unpack(hubs, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        # each document's digests in each class, the most frequent ones first: the spare ones are passed over
        count = count[group]
        order = np.lexsort((k, count, c, ids))[::-1]
        start = np.ones(len(order), bool)
        start[1:] = (ids[order[1:]] != ids[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        spare = {x: classes.parts(x)[1] for x in np.unique(c).tolist()}
        kept = np.zeros(len(k), bool)
        kept[order] = place >= np.array([spare[x] for x in c[order].tolist()], np.int64) if len(order) else False
        mine = kept & (count > 0) & (hub[group] != ids)
        found = np.unique(np.stack([c[mine], hub[group][mine], ids[mine]], 1), axis=0)
        return pa.table([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1]), pa.array(found[:, 2])], names=names)

    return run


class Tree:
    """A signature tree over sets; leaves are in an order that puts like sets together."""

    def __init__(self, items: list[np.ndarray]):
        least = np.array([(int(mix(s[0], 51).min()), int(mix(s[0], 52).min())) for s in items], np.uint64)
        self.order = np.lexsort((least[:, 1], least[:, 0]))
        self.items = [items[i] for i in self.order]
        size = np.array([s.shape[1] for s in self.items])
        bits = np.zeros((len(items), BITS // 64), np.uint64)
        for i, s in enumerate(self.items):
            at = np.unique(mix(s[0], 53) % np.uint64(BITS))
            np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        excess = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][1]) > FANOUT:
            b, low, high, e = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Pairs of nodes whose size ranges and largest possible overlap allow a link."""
        bits, low, high, excess = self.levels[level]
        sizes = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        overlap = np.bitwise_count(bits[i] & bits[j]).sum(1) + np.minimum(excess[i], excess[j])
        return sizes & ((100 + percent) * np.minimum(overlap, np.minimum(high[i], high[j])) >= percent * (low[i] + low[j]))

    def labels(self, percent: int) -> np.ndarray:
        """For each item the first item, in the given order, that it's connected with by links."""
        n = len(self.items)
        self.label = np.arange(n)
        every = np.concatenate(self.items, 1)
        order, new = ordered(every)
        tokens, start = np.empty(len(order), np.int64), np.concatenate([[0], np.cumsum([s.shape[1] for s in self.items])])
        tokens[order] = np.cumsum(new) - 1
        self.tokens, self.start, self.mark = tokens, start, np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, bool)
        top = len(self.levels) - 1
        m = len(self.levels[top][1])
        i, j = np.triu_indices(m)
        self._visit(top, i, j, percent)
        least = np.full(n, n)
        np.minimum.at(least, self.label, self.order)
        out = np.empty(n, np.int64)
        out[self.order] = least[self.label]
        return out

    def _visit(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> None:
        keep = self._open(level, i, j)
        i, j = i[keep], j[keep]
        keep = self.possible(level, i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        if level == 0:
            self._verify(i, j, percent)
            return
        below = len(self.levels[level - 1][1])
        for a in range(0, len(i), 64):  # children of a bounded number of pairs at a time
            x = (i[a : a + 64, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            y = (j[a : a + 64, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
            ok = (x <= y) & (x < below) & (y < below)
            self._visit(level - 1, x[ok], y[ok], percent)

    def _open(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of nodes that aren't connected already through and through."""
        if level == 0:
            return self.label[i] != self.label[j]
        at = np.arange(0, len(self.label), FANOUT**level)
        low, high = np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)
        return ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))

    def _verify(self, i: np.ndarray, j: np.ndarray, percent: int) -> None:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        at = _firsts(i)
        for a, b in zip(at, np.append(at[1:], len(i))):
            x, ys = i[a], j[a:b]
            ys = ys[self.label[ys] != self.label[x]]
            if not len(ys):
                continue
            mine = self.tokens[self.start[x] : self.start[x + 1]]
            self.mark[mine] = True
            size = self.start[ys + 1] - self.start[ys]
            base = np.cumsum(size) - size
            index = np.repeat(self.start[ys] - base, size) + np.arange(size.sum())
            both = np.add.reduceat(self.mark[self.tokens[index]].astype(np.int64), base)
            self.mark[mine] = False
            for y in ys[100 * both >= percent * (size + len(mine) - both)]:
                p, q = sorted((self.label[x], self.label[y]))
                if p != q:
                    self.label[self.label == q] = p


def _tree_links(n: int, percent: int):
    """One task's groups: each is joined by its own tree; links are given as stars."""

    def run(key, table):
        table = table.sort_by([("group", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        groups, ids = np.asarray(table.column("group")), np.asarray(table.column("doc_id"))
        at = _firsts(groups)
        src, dst = [], []
        held: list[np.ndarray] = []
        for part in passes(table):
            held += sets(part, n)
        for a, b in zip(at, np.append(at[1:], len(groups))):
            own = [i for i in range(a, b) if held[i].shape[1]]
            if len(own) > 1:
                label = Tree([held[i] for i in own]).labels(percent)
                mine = ids[own]
                far = mine[label] != mine
                src.append(mine[label][far])
                dst.append(mine[far])
        return pa.table([pa.array(np.concatenate(src) if src else np.zeros(0, np.int64)), pa.array(np.concatenate(dst) if dst else np.zeros(0, np.int64))], names=["src", "dst"])

    return run


SENT = ["doc_id", "text", "group", "piece", "again", "pieces"]


def _send(key, docs, own):
    """The block's documents, once for each group that they're in; a document has one group of a size class at most."""
    if not docs.num_rows or not own.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32())], names=SENT)
    return docs.select(["doc_id", "text"]).join(own.select(["d", *SENT[2:]]), "doc_id", "d", "inner").combine_chunks().select(SENT)


def _known(rows: DataFrame, few: DataFrame, key: str, doc: str, share: int) -> DataFrame:
    """rows with the columns of few, one row for each key, in which _rows counts the key's rows; null where there's none.

    Keys with more than `share` rows, of which there are HOT at most, are spread over as many places as that needs."""
    hot = few.where(F.col("_rows") > share).select(F.col(key).alias("_key"), F.ceil(F.col("_rows") / share).cast("int").alias("_salts"))
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_rows") / share).cast("int") - 1)))).drop("_rows")
    named = rows.withColumn("_join", F.expr(key)).join(F.broadcast(hot), F.col("_join") == F.col("_key"), "left")
    placed = named.withColumn("_salt", F.expr(f"cast(coalesce(pmod(xxhash64({doc}, 5), _salts), 0) as int)")).drop("_key", "_salts", "_join")
    return placed.join(salted, [key, "_salt"], "left").drop("_salt")


def join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, tree: int = TREE) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row."""
    rows = with_text(docs)
    spark = docs.sparkSession

    def tag(batches):
        for batch in batches:
            for part in passes(batch):
                s = sets(part, n)
                d = np.array([digest(x) for x in s], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.shape[1] for x in s], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["doc_id", "n_shingles", "one", "two"])

    tagged = cut_lineage(rows.mapInArrow(tidied(tag), "doc_id long, n_shingles long, one long, two long"))
    reps = cut_lineage(tagged.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total, n_docs = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    share = max(SHARE, -(-n_docs // HOT))
    n_blocks = max(1, int(-(-total // (BLOCK_BYTES * growth(total)))))
    n_ranges = max(1, int(-(-total // 16 // (RANGE_KEYS * growth(total)))))
    block = lambda c: F.expr(f"cast(pmod(xxhash64({c}), {n_blocks}) as int)").alias("block")
    by_block = rows.where("doc_id IS NOT NULL").select("doc_id", "text", block("doc_id")).groupBy("block")
    held = reps.select("rep", block("rep")).distinct()
    signed = by_block.cogroup(held.groupBy("block")).applyInArrow(tidied(_signatures(n, percent, n_ranges)), "block int, range int, keys binary, docs binary, at binary, n binary")
    hubs = signed.groupBy("range").applyInArrow(tidied(_hubs), "block int, range int, counts binary, hubs binary")
    back = held.unionByName(hubs, allowMissingColumns=True)
    agreed = cut_lineage(by_block.cogroup(back.groupBy("block")).applyInArrow(tidied(_agreements(n, percent, n_ranges)), "c int, hub long, doc long"))
    # groups that may hold links, by join class; the tree's task gets their texts
    node = lambda x: F.struct("c", F.col(x).alias("id"))
    maybe = components(agreed.select(node("hub").alias("src"), node("doc").alias("dst")))
    sizes = maybe.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > tree).withColumn("_rows", F.col("size"))
    grouped = cut_lineage(_known(maybe, sizes, "label", "node.id", share).select(F.col("node.id").alias("doc_id"), F.xxhash64("label").alias("group"), "size"))
    drop(agreed)
    large = grouped.where("size IS NOT NULL")
    pieces = lambda: F.expr(f"cast(ceil(size / {tree / 2}) as int)")
    piece = lambda: F.expr(f"cast(pmod(xxhash64(doc_id, 7), ceil(size / {tree / 2})) as int)")
    # a large group's pieces share a few documents, which connect most of what is linked; each task ranks its own first
    rank = Window.partitionBy("group").orderBy("mark", "doc_id")
    few = large.withColumn("mark", F.xxhash64("doc_id", F.lit(3))).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= PIVOTS)
    tasks = grouped.where("size IS NULL").select("doc_id", "group", F.lit(0).alias("piece"), F.lit(False).alias("again"), F.lit(None).cast("int").alias("pieces"))
    some = not large.isEmpty()
    if some:
        marked = few.select(F.col("doc_id").alias("_d"), F.col("group").alias("_g"), pieces().alias("pieces"))
        own = large.select("doc_id", "group", piece().alias("piece"), F.lit(True).alias("again"))
        tasks = tasks.unionByName(own.join(marked, (F.col("doc_id") == F.col("_d")) & (F.col("group") == F.col("_g")), "left").drop("_d", "_g"))
    sent = _sent(rows, tasks, n_blocks)
    if some:
        sent = cut_lineage(sent)
    links = cut_lineage(_run_trees(sent, n, percent))
    if some:
        # what the pieces left apart from the bulk of its group is compared with all of the group
        first = components(links)
        named = large.join(first, F.col("doc_id") == F.col("node"), "left").select("doc_id", "group", "size", F.coalesce("label", "doc_id").alias("label"))
        counts = named.groupBy("group", "label").agg(F.count("*").alias("m"))
        bulk = counts.groupBy("group").agg(F.max(F.struct("m", "label"))["label"].alias("bulk"), F.sum("m").alias("_rows"))
        split = cut_lineage(_known(named, bulk, "group", "doc_id", share).select("doc_id", "group", (F.col("label") != F.col("bulk")).alias("apart")))
        every = cut_lineage(links.unionByName(_run_trees(_sent_again(sent, _paired(split, tree, share)), n, percent)))
        drop(links, split, sent)
        links = every
    drop(grouped)
    found = components(links)
    drop(links)
    placed = reps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("one").alias("_1"), F.col("two").alias("_2"), F.coalesce("label", "rep").alias("component"))
    out = tagged.join(placed, (F.col("one") == F.col("_1")) & (F.col("two") == F.col("_2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _paired(docs: DataFrame, tree: int, share: int) -> DataFrame:
    """doc_id, group, piece: tasks of some `tree` documents in which each document that's apart meets all of its group.

    docs: doc_id, group, apart. Both kinds are dealt into pieces of half a tree, those apart first; each pair of pieces
    of which one at least is apart is a task."""
    sizes = docs.groupBy("group").agg(*[F.ceil(F.count_if(c) / (tree / 2)).cast("int").alias(n) for n, c in (("m", F.col("apart")), ("k", ~F.col("apart")))], F.count("*").alias("_rows")).where("m > 0")
    at = _known(docs, sizes, "group", "doc_id", share).where("m > 0").withColumn("p", F.expr("cast(if(apart, pmod(xxhash64(doc_id, 11), m), m + pmod(xxhash64(doc_id, 11), k)) as int)"))
    others = F.expr("if(apart, filter(sequence(0, m + k - 1), q -> q <> p), sequence(0, m - 1))")
    pair = at.select("doc_id", "group", "p", F.explode(others).alias("q"))
    return pair.select("doc_id", "group", F.struct(F.least("p", "q").alias("one"), F.greatest("p", "q").alias("two")).alias("piece"))


def _sent(rows: DataFrame, tasks: DataFrame, n_blocks: int) -> DataFrame:
    """Texts with their group and task, for tasks of doc_id, group, piece, again and pieces (in how many pieces of its group a
    document is, null: only this one). Texts leave their block once for each group and are copied row by row. Small groups
    share a task."""
    block = lambda c: F.expr(f"cast(pmod(xxhash64({c}), {n_blocks}) as int)").alias("block")
    own = tasks.select(F.col("doc_id").alias("d"), "group", "piece", "again", "pieces", block("doc_id"))
    named = rows.where("doc_id IS NOT NULL").select("doc_id", "text", block("doc_id"))
    once = named.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(tidied(_send), "doc_id long, text string, group long, piece int, again boolean, pieces int")
    every = F.when(F.col("pieces").isNull(), F.array("piece")).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
    copied = once.select("doc_id", "text", "group", (F.col("again")).alias("_again"), F.col("piece").alias("_own"), F.explode(every).alias("_piece"))
    sent = copied.select("doc_id", "text", F.xxhash64("group", "_piece").alias("group"), (F.col("_again") & (F.col("_piece") == F.col("_own"))).alias("again"))
    return sent.withColumn("task", F.expr(f"pmod(xxhash64(group, 9), {4 * n_blocks})"))


def _sent_again(sent: DataFrame, tasks: DataFrame) -> DataFrame:
    """Texts of large groups, sent to further tasks; each one is a task alone."""
    own = tasks.select(F.col("doc_id").alias("d"), F.xxhash64("group", "piece").alias("group"))
    return sent.where("again").select("doc_id", "text").join(own, F.col("doc_id") == F.col("d")).select("doc_id", "text", "group", F.col("group").alias("task"))


def _run_trees(sent: DataFrame, n: int, percent: int) -> DataFrame:
    """src and dst: the links that the trees find, as stars."""
    return sent.groupBy("task").applyInArrow(tidied(_tree_links(n, percent)), "src long, dst long")
