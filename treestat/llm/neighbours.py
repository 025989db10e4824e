"""Near-duplicate embeddings by NN-descent.

Equal vectors of one label are one node. Neighbour lists start from buckets of random hyperplane signs and are refined
by NN-descent: the forward and reverse neighbours of each node are compared with one another, and what is closer than
the last of a list enters it, until few lists change. Then fresh starts, with other hyperplanes each, are searched for links
between different components, until one adds none. Recall is audited node by node against all vectors for samples of
bounded size, of all nodes and of those in no or a small component; if any link of theirs is missing, the search starts
again from the lists so far. If the last search falls short, too, all nodes of a label are compared.

List entries with a cosine (in double precision) of ``least`` or more are links, and components of links are the
groups. A list that is full of links is saturated: it may hide links that leave its component. Saturated lists are
enlarged (12 to 48 entries) and the descent goes on with them; nodes whose lists are full of links even at ``LONGEST`` are
compared with all nodes of their label, in pieces of bounded size, and the components that are found linked are joined.
Then inside every component all pairs are compared, in blocks, and only each node's number of links is kept. So a large
group of copies or near copies costs neither a list of its pairs nor a task of its size.

Defined cases: vectors that are NULL, of length or norm zero, or with NULL, NaN or infinite parts, and rows without
label, link with nothing (n_links 0, alone in their component). Only vectors of one label and one length are compared;
labels of any type are compared as they are.
vec_id is taken as unique; repeated rows count as copies. Rows without vec_id link with nothing and have no component.
Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treestat.llm.graph import components
from treestat.llm.tables import by_group
from treestat.session import written

LEAST = 0.98
#: Length of a neighbour list, members compared around a node, least hyperplane rounds of a start, descent rounds.
LIST, AROUND, STARTS, ROUNDS = 12, 30, 4, 6
#: Factor by which lists that are full of links are enlarged, and the length up to which they are.
LONGER, LONGEST = 4, 48
#: Wanted size of a start bucket and of a block of exact comparison.
BUCKET, BLOCK = 96, 512
#: Vectors of one side of a piece in which nodes are compared with all of their label.
PIECE = 2048
#: Chance that a pair at ``LEAST`` shares no bucket of a start, which sets the hyperplane rounds of large labels. A pair with no
#: link but this one is lost if the first start and the last of the fresh ones both miss it: with a chance of 1e-6.
APART = 0.001
#: Signs beyond those of the label by which a crowded bucket is split before chance splits it.
DEEPER = 8
#: Vectors of the audit, those outside large components, wanted recall, searches and fresh starts of a search at most.
AUDIT, OUTSIDE, RECALL, SEARCHES, FRESH = 256, 1024, 1.0, 4, 6


def _padded(pdf: pd.DataFrame, key: str, vectors: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similarities inside groups, groups of like size together: places (groups x size), their validity, cosines."""
    keys = pdf[key].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    lengths = pdf[vectors].map(len).to_numpy()
    top = 1 << np.ceil(np.log2(np.maximum(2, size))).astype(int)
    for width in np.unique(top):
        for dim in np.unique(lengths[start[top == width]]):
            pick = np.flatnonzero((top == width) & (lengths[start] == dim))
            for part in np.array_split(pick, max(1, int(len(pick) * width * width // 4_000_000))):
                at = start[part][:, None] + np.arange(width)
                ok = np.arange(width) < size[part][:, None]
                at = np.where(ok, at, start[part][:, None])
                ok &= lengths[at] == dim
                flat = pdf[vectors].to_numpy()[at.ravel()]
                x = np.frombuffer(b"".join(v if len(v) == dim else bytes(dim) for v in flat), np.float32).reshape(len(part), width, -1)
                yield at, ok, x @ x.transpose(0, 2, 1)


def _best(pdf: pd.DataFrame, key: str, k: int) -> Iterator[pd.DataFrame]:
    """The k nearest others of every row inside its group."""
    ids = pdf["v"].to_numpy()
    for at, ok, sim in _padded(pdf, key, "x"):
        sim = np.where(ok[:, None, :] & ok[:, :, None], sim, -9)
        i = np.arange(sim.shape[1])
        sim[:, i, i] = -9
        m = min(k, sim.shape[1] - 1)
        top = np.argpartition(-sim, m - 1, axis=2)[:, :, :m]
        s = np.take_along_axis(sim, top, 2)
        g, a, b = np.nonzero(s > -5)
        yield pd.DataFrame({"v": ids[at[g, a]], "u": ids[at[g, top[g, a, b]]], "s": s[g, a, b].astype(float)})


def _local_join(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs around a node, one of them new there, that are closer than the last of either list."""
    ids, fresh, last = pdf["v"].to_numpy(), pdf["fresh"].to_numpy(), pdf["last"].to_numpy()
    for at, ok, sim in _padded(pdf, "center", "x"):
        pair = ok[:, None, :] & ok[:, :, None] & (fresh[at][:, None, :] | fresh[at][:, :, None]) & (ids[at][:, None, :] != ids[at][:, :, None])
        g, a, b = np.nonzero(pair & (sim > last[at][:, :, None] + 1e-6))
        yield pd.DataFrame({"v": ids[at[g, a]], "u": ids[at[g, b]], "s": sim[g, a, b].astype(float)})


def _rounds(bits: int) -> int:
    """Hyperplane rounds after which a pair at ``LEAST`` has shared a bucket of so many signs, but for ``APART``."""
    share = (1 - np.arccos(LEAST) / np.pi) ** bits
    return max(STARTS, int(np.ceil(np.log(APART) / np.log1p(-share)))) if bits else STARTS


def _start(nodes: DataFrame, seed: int) -> DataFrame:
    """Neighbour candidates (v, u, s) from buckets of hyperplane signs.

    A crowded bucket is split by ``DEEPER`` more signs, and what is crowded even then at random: near copies of one
    another, whose lists the descent fills.
    """
    most = nodes.agg(F.coalesce(F.max("bits"), F.lit(0))).first()[0]
    rounds, signs = _rounds(most), most + DEEPER

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in frames:
            for dim, part in pdf.groupby("dim", sort=False):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed * 1009 + dim).normal(size=(int(dim), rounds * signs)).astype(np.float32)
                x = np.frombuffer(b"".join(part["x"]), np.float32).reshape(len(part), -1)
                side = (x @ planes[dim] > 0).astype(np.int64).reshape(len(part), rounds, signs)
                used = part["bits"].to_numpy(np.int64)
                value = (side[:, :, DEEPER:] * (1 << np.arange(most, dtype=np.int64)) * (np.arange(most) < used[:, None, None])).sum(2)
                more = (side[:, :, :DEEPER] * (1 << np.arange(DEEPER, dtype=np.int64))).sum(2)
                own = np.array([_rounds(b) for b in range(most + 1)])[used]
                for t in range(rounds):
                    coded = pd.DataFrame({"v": part["v"], "t": t, "label": part["label"], "dim": part["dim"], "code": value[:, t], "more": more[:, t], "x": part["x"]})
                    yield coded[own > t]

    coded = nodes.select("v", "label", "bits", "dim", "x").mapInPandas(codes, "v long, t int, label long, dim int, code long, more long, x binary")
    coded = coded.withColumn("bucket", F.xxhash64("t", "label", "dim", "code"))
    crowd = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * BUCKET)
    finer = coded.join(crowd(coded, "bucket"), "bucket", "left").withColumn("fine", F.when(F.col("n").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "more"))).drop("n")
    dealt = finer.join(crowd(finer, "fine"), "fine", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v", F.lit(seed)), F.ceil(F.col("n") / BUCKET)), F.lit(0)))
    return by_group(dealt.select("v", "x", F.xxhash64("fine", "part").alias("g")), "g", lambda pdf: _best(pdf, "g", LIST), "v long, u long, s double")


def _lists(candidates: DataFrame, old: DataFrame | None, least: float, caps: DataFrame | None = None) -> DataFrame:
    """The best of each node, LIST of them or as many as ``caps`` (v, cap) says: v, u, s, fresh (not in the old lists).

    What a longer list holds beyond LIST are links only: it is there to show the links that a full list hides.
    """
    both = candidates.withColumn("fresh", F.lit(True))
    if old is not None:
        both = both.unionByName(old.select("v", "u", "s", F.lit(False).alias("fresh")))
    once = both.repartition("v").groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    ranked = _capped(once.withColumn("rank", F.row_number().over(w)), caps).filter("rank <= cap")
    return ranked.filter((F.col("rank") <= LIST) | (F.col("s") >= least - 1e-4)).drop("rank", "cap")


def _capped(rows: DataFrame, caps: DataFrame | None, key: str = "v") -> DataFrame:
    """``rows`` with ``cap``, the length of the list of the node in the column ``key``."""
    if caps is None:
        return rows.withColumn("cap", F.lit(LIST))
    return rows.join(caps.select(F.col("v").alias(key), "cap"), key, "left").withColumn("cap", F.coalesce("cap", F.lit(LIST)))


def _descend(nodes: DataFrame, lists: DataFrame, least: float, caps: DataFrame | None = None) -> DataFrame:
    """NN-descent rounds until less than a thousandth of the entries is new."""
    for _ in range(ROUNDS):
        around = lists.select(F.col("v").alias("center"), F.col("u").alias("v"), "fresh").unionByName(lists.select(F.col("u").alias("center"), "v", "fresh"))
        # dealt by center once, for the aggregation and both windows
        around = around.repartition("center").groupBy("center", "v").agg(F.max("fresh").alias("fresh"))
        # a center with nothing new around it yields no pair, so its vectors need not move
        around = around.withColumn("any", F.max("fresh").over(Window.partitionBy("center"))).filter("any").drop("any")
        w = Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("center", "v"))
        around = _capped(around.withColumn("rank", F.row_number().over(w)), caps, "center").filter(F.col("rank") * LIST <= F.col("cap") * AROUND).drop("rank", "cap")
        last = _capped(lists.groupBy("v").agg(F.count("*").alias("n"), F.min("s").alias("s")), caps)
        # a long list with room takes links, and what is better than the last of its first LIST
        last = last.select("v", F.expr(f"CASE WHEN n >= cap THEN s WHEN n >= {LIST} THEN least(s, {least!r}D - 1e-4D) ELSE -2D END").alias("last"))
        known = nodes.select("v", "x").join(last, "v", "left").select("v", "x", F.coalesce("last", F.lit(-2.0)).alias("last"))
        found = by_group(around.join(known, "v").select("center", "v", "fresh", "last", "x"), "center", _local_join, "v long, u long, s double")
        lists = written(_lists(found, lists, least, caps), "lists")
        new, all_ = lists.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= 0.001 * all_:
            break
    return lists


def _enlarged(nodes: DataFrame, lists: DataFrame, caps: DataFrame | None, least: float) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Refined lists, their lengths, and the nodes whose lists are full of links even at LONGEST."""
    lists = _descend(nodes, lists, least, caps)
    size = LIST
    while True:
        full = written(_saturated(lists, caps, least), "saturated")
        if size >= LONGEST or full.isEmpty():
            return lists, caps, full
        size *= LONGER
        longer = full.withColumn("cap", F.lit(size))
        caps = written(longer if caps is None else longer.unionByName(caps).groupBy("v").agg(F.max("cap").alias("cap")), "caps")
        again = lists.drop("fresh").join(full.withColumn("fresh", F.lit(True)), "v", "left").select("v", "u", "s", F.coalesce("fresh", F.lit(False)).alias("fresh"))
        lists = _descend(nodes, again, least, caps)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of rows of ``a`` with rows of ``b``."""
    return (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)


def _doubles(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _links(lists: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """List entries a < b that are links in double precision."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                ok = np.zeros(len(pdf), bool)
                for _, part in pdf.reset_index(drop=True).groupby(pdf["xa"].map(len).to_numpy()):
                    a, b = _doubles(part["xa"]), _doubles(part["xb"])
                    ok[part.index] = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1) >= least
                yield pdf.loc[ok, ["a", "b"]]

    near = lists.filter(F.col("s") >= least - 1e-4).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    a = nodes.select(F.col("v").alias("a"), F.col("x64").alias("xa"), F.col("label").alias("la"))
    b = nodes.select(F.col("v").alias("b"), F.col("x64").alias("xb"), F.col("label").alias("lb"))
    both = near.join(b, "b").join(a, "a").filter("la = lb")  # keys of buckets are hashes, so labels are compared here
    return both.select("a", "xa", "b", "xb").mapInPandas(run, "a long, b long")


def _fresh_links(nodes: DataFrame, member: DataFrame, seed: int, least: float) -> DataFrame:
    """Links between different components that a start of its own finds."""
    root = lambda key: member.select(F.col("v").alias(key), F.col("root").alias(f"r{key}"))
    pairs = _start(nodes, seed).filter(F.col("s") >= least - 1e-4).select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u"), "s").distinct()
    apart = pairs.join(root("v"), "v", "left").join(root("u"), "u", "left").filter(F.coalesce("rv", "v") != F.coalesce("ru", "u"))
    return _links(apart.select("v", "u", "s"), nodes, least)


def _audit(nodes: DataFrame, member: DataFrame, least: float) -> float:
    """Mean share of a node's links, found by comparison with all, whose ends share a component: the lesser one of a
    bounded sample of all nodes and of one of the nodes whose component (if any) has no more nodes than a list."""
    large = member.groupBy("root").count().filter(F.col("count") > LIST).select("root")
    rows = nodes.join(member, "v", "left").select("v", "label", "dim", "x64", F.coalesce("root", "v").alias("root"))
    some = lambda df, n: df.select("v").orderBy(F.xxhash64("v"), "v").limit(n)
    outside = some(rows.join(large, "root", "left_anti"), OUTSIDE).withColumn("of", F.lit(1))
    sample = some(nodes, AUDIT).withColumn("of", F.lit(0)).unionByName(outside).groupBy("v").agg(F.collect_set("of").alias("of"))
    asked = rows.join(F.broadcast(sample), "v").collect()  # at most AUDIT + OUTSIDE
    asked = [(r["v"], r["label"], r["dim"], bytes(r["x64"]), r["root"], r["of"]) for r in asked]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for (label, dim), group in pdf.groupby(["label", "dim"]):
                qs = [q for q in asked if q[1] == label and q[2] == dim]
                if not qs:
                    continue
                v, root, x = np.array([q[0] for q in qs]), np.array([q[4] for q in qs]), _doubles([q[3] for q in qs])
                for k in range(0, len(group), PIECE):
                    part = group.iloc[k : k + PIECE]
                    link = (_cosines(x, _doubles(part["x64"])) >= least) & (v[:, None] != part["v"].to_numpy())
                    hit = (link & (root[:, None] == part["root"].to_numpy())).sum(1)
                    yield pd.DataFrame({"v": v, "n": link.sum(1), "hit": hit})[link.any(1)]

    shares = {r["v"]: r["hit"] / r["n"] for r in rows.mapInPandas(run, "v long, n long, hit long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).collect()}
    means = []
    for of in (0, 1):
        known = [shares[q[0]] for q in asked if of in q[5] and q[0] in shares]
        means.append(sum(known) / len(known) if known else 1.0)
    return min(means)


def _saturated(lists: DataFrame, caps: DataFrame | None, least: float) -> DataFrame:
    """v of the nodes whose whole list is links, as far as single precision can tell."""
    ends = lists.groupBy("v").agg(F.count("*").alias("n"), F.min("s").alias("last"))
    return _capped(ends, caps).filter((F.col("n") >= F.col("cap")) & (F.col("last") >= least - 1e-4)).select("v")


def _across(asked: DataFrame, nodes: DataFrame, member: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of roots of different components that a link of an ``asked`` node joins.

    Every asked node is compared with all nodes of its label, piece by piece; links themselves are not listed.
    """
    rows = nodes.join(member, "v", "left").select("v", "label", "dim", "x64", F.coalesce("root", "v").alias("root"))
    left = rows.join(asked.select("v"), "v", "left_semi")
    pieces = lambda df, name: df.groupBy("label", "dim").agg(F.ceil(F.count("*") / PIECE).alias(name))
    sizes = pieces(left, "lefts").join(pieces(rows, "rights"), ["label", "dim"])

    def dealt(df: DataFrame, side: bool) -> DataFrame:
        own, other = ("lefts", "rights") if side else ("rights", "lefts")
        df = df.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("v"), F.col(own)))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        i, j = ("own", "other") if side else ("other", "own")
        return df.select(F.xxhash64("label", "dim", i, j).alias("g"), F.lit(side).alias("side"), "root", "x64")

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g, side, root, x = (pdf[c].to_numpy() for c in ("g", "side", "root", "x64"))
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for a, b in zip(start, np.append(start[1:], len(g))):
            left, right = np.flatnonzero(side[a:b]) + a, np.flatnonzero(~side[a:b]) + a
            if not len(left) or not len(right):
                continue
            other = _doubles(x[right])
            for part in np.array_split(left, -(-len(left) // BLOCK)):
                p, q = np.nonzero((_cosines(_doubles(x[part]), other) >= least) & (root[part][:, None] != root[right]))
                pairs = pd.DataFrame({"a": root[part[p]], "b": root[right[q]]})
                yield pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).drop_duplicates()

    return by_group(dealt(left, True).unionByName(dealt(rows, False)), "g", run, "a long, b long").distinct()


def _members(links: DataFrame) -> DataFrame:
    """v, root of all nodes that have links."""
    found = components(links)
    roots = found.select(F.col("root").alias("v"), "root").distinct()
    return written(found.select(F.col("node").alias("v"), "root").unionByName(roots), "member")


def _counts(nodes: DataFrame, member: DataFrame, least: float) -> DataFrame:
    """v, n: copies linked with each node, from all pairs inside its component, block by block."""
    inside = nodes.join(member, "v").select("v", "copies", "x64", "root")
    sizes = inside.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = inside.join(sizes, "root").withColumn("i", F.pmod(F.xxhash64("v"), F.col("blocks")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("v", "copies", "x64", "i", F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("g"))

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g, v, i, copies, x = (pdf[c].to_numpy() for c in ("g", "v", "i", "copies", "x64"))
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out_v, out_n = [], []
        for a, b in zip(start, np.append(start[1:], len(g))):
            one = i[a:b] == i[a]
            left, right = np.flatnonzero(one) + a, np.flatnonzero(~one) + a
            if not len(right):
                right = left
            link = _cosines(_doubles(x[left]), _doubles(x[right])) >= least
            link &= v[left][:, None] != v[right]
            out_v.append(v[left])
            out_n.append(link @ copies[right])
            if right is not left:
                out_v.append(v[right])
                out_n.append(link.T @ copies[left])
        yield pd.DataFrame({"v": np.concatenate(out_v), "n": np.concatenate(out_n)})

    return by_group(rows, "g", run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def links(vectors: DataFrame, embedding: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    e = F.col(embedding)
    good = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(e.isNotNull() & (F.size(e) > 0))
    good = good.select("vec_id", "label", e.cast("array<double>").alias("e"))
    good = good.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("e", lambda x: x != 0))
    # a label is its least vec_id from here on; bits of a start bucket go by the label's number of different vectors
    labels = good.groupBy("label").agg(F.min("vec_id").alias("of"), F.approx_count_distinct(F.xxhash64("e")).alias("n"))
    labels = labels.select("label", "of", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET))).cast("int").alias("bits"))
    good = good.join(labels, "label").select("vec_id", F.col("of").alias("label"), "bits", "e")
    classes = good.groupBy("label", "bits", "e").agg(F.min("vec_id").alias("v"), F.count("*").alias("copies"))
    of_class = good.drop("bits").join(classes, ["label", "e"]).select("vec_id", "v", "copies")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = [np.asarray(a, np.float64) for a in pdf["e"]]
            x = [a / np.abs(a).max() for a in x]  # so that no square overflows
            unit = [(a / np.linalg.norm(a)).astype(np.float32).tobytes() for a in x]
            yield pdf[["v", "label", "bits", "copies"]].assign(dim=[len(a) for a in x], x=unit, x64=[a.tobytes() for a in x])

    nodes = written(classes.mapInPandas(pack, "v long, label long, bits int, copies long, dim int, x binary, x64 binary"), "nodes")
    lists, caps, member = None, None, None
    for search in range(SEARCHES):
        lists = written(_lists(_start(nodes, search), lists, least, caps), "lists")
        lists, caps, full = _enlarged(nodes, lists, caps, least)
        near = written(_links(lists, nodes, least), "links")
        member = _members(near)
        if not full.isEmpty():
            more = written(_across(full, nodes, member, least), "across")
            if not more.isEmpty():
                near = near.unionByName(more)
                member = _members(near)
        for fresh in range(FRESH):
            more = written(_fresh_links(nodes, member, 1000 * (search + 1) + fresh, least), "fresh")
            if more.isEmpty():
                break
            near = near.unionByName(more)
            member = _members(near)
        if _audit(nodes, member, least) >= RECALL:
            break
    else:  # no search was good enough
        member = _members(near.unionByName(written(_across(nodes, nodes, member, least), "across")))
    counts = _counts(nodes, member, least)
    per_class = of_class.join(member, "v", "left").join(counts, "v", "left")
    per_class = per_class.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "v").alias("component_id"))
    rows = vectors.select("vec_id")
    rest = rows.join(of_class.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return per_class.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())
