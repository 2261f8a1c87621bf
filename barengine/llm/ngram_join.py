"""Near duplicates by a grouped prefix join on word shingles (exact Jaccard threshold).

1. Every text becomes the set of its k-word shingles (64-bit hashes). Equal sets
   are one *node*.
2. Shingles are put in one global order, rare ones first: the shingles found most
   often, in a table of bounded size, come last by their counts, all others by
   hash. The order only steers the work; any order gives the same links.
3. Two sets with Jaccard similarity of at least t share a shingle among the first
   n - ceil(t n) + 1 of each. Nodes with the same prefix and size form one *group*,
   and only groups post their prefixes. Group pairs that meet at a shingle are filtered
   by size and by the places of the shingle; postings without a partner are dropped.
4. The groups are expanded to their members, which are filtered by the parity bitmaps
   of the sets (their Hamming distance bounds the sets' difference from below).
5. A node proposes its smallest untried partners, one in the first round and four
   times as many in each next one; proposals are verified on the whole sets and linked nodes
   drawn together by a star step. Pairs that hang on one node need no check, so a group of a
   thousand copies costs about a thousand checks, not a million. The rounds end
   when no node has an untried partner that hangs elsewhere: every link between
   different components has then been refuted. The stars are joined up at the end.

Shingles posted by more than ``BLOCK`` nodes are dealt in pairs of blocks, so no
task holds such a bucket as a whole.

Defined results
* null, empty or blank text: no shingles, linked with nothing, its component is its own key;
* equal texts are linked, whatever their number; repeated rows too;
* a null key counts as no key when the smallest of a component is taken;
* empty table: empty result; columns besides key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import materialize, partitions, settings
from .components import connected_components, nearest, star_step

PIECE = 4 << 20
#: Bound of the table of frequent shingles, and the count within a piece of text from which one is a candidate.
HEAVY = 1 << 16
HEAVY_IN_PIECE = 4
#: Bits of a set's parity bitmap; sets of at least so many shingles have a wider one, which folds to the narrower.
BITS = 512
WIDER = ((1500, 2048), (6000, 8192), (24000, 32768))
#: Members of a bucket that one task compares.
BLOCK = 1024
#: Rows up to which the keys of wanted texts are sent to all executors (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_KEYS = 500_000

_SETS = "key_ long, hash_ long, n long, node long, gid long, prefix array<bigint>, sig binary"


def _pieces(batch: pa.RecordBatch, text: str, k: int):
    """(rows from, list of distinct shingle arrays) of a batch, a few MB at a time."""
    off, data = T.text_buffer(batch.column(text))
    for a, z in T.row_pieces(off, PIECE):
        _, h, counts = T.range_words(off, data, a, z)
        ends = np.cumsum(counts)
        yield a, [T.shingle_hashes(h[e - c:e], k) for c, e in zip(counts.tolist(), ends.tolist())]


def _node(s: np.ndarray) -> int:
    """Hash of a set."""
    with np.errstate(over="ignore"):
        total = np.sum(T.mix64(s + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
        both = T.pair_hash(np.array([total]), np.array([np.bitwise_xor.reduce(s) + np.uint64(len(s))]))
    return int(both.view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles per hash value modulo the width."""
    bits = max([BITS, *[w for least, w in WIDER if len(s) >= least]])
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)
                       .astype(np.uint8)).tobytes()


def _bitmaps(sigs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per width: (row in the matrix or -1, matrix of 64-bit words), wider bitmaps folded."""
    out = []
    width = np.array([8 * len(x) for x in sigs], dtype=np.int64)
    for bits in (BITS, *[w for _, w in WIDER]):
        rows = np.flatnonzero(width >= bits)
        if not len(rows):
            break
        matrix = np.zeros((len(rows), bits // 64), dtype=np.uint64)
        for w in np.unique(width[rows]).tolist():
            at = np.flatnonzero(width[rows] == w)
            flat = np.frombuffer(b"".join(sigs[r] for r in rows[at]), np.uint64).reshape(len(at), w // bits, bits // 64)
            matrix[at] = np.bitwise_xor.reduce(flat, axis=1)
        place = np.full(len(sigs), -1, np.int64)
        place[rows] = np.arange(len(rows))
        out.append((place, matrix))
    return out


def frequent_shingles(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY shingles with the highest counts: (hashes ascending, their counts).

    All texts are counted; the counts of a piece of text are summed before the
    shuffle, and the smallest power of two that leaves at most HEAVY shingles
    is the lower limit.
    """
    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for _, sets in _pieces(b, "t", k):
                h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0), np.empty(0))
                often = c >= HEAVY_IN_PIECE
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often])],
                                                     names=["h", "c"])
    with settings(docs.sparkSession):
        counts = materialize(docs.select(F.col(text).alias("t")).mapInArrow(count, "h long, c long")
                             .groupBy("h").agg(F.sum("c").alias("c")), "ngram-heavy")
    levels = sorted(((int(r.p), r.n) for r in counts.groupBy(F.floor(F.log2("c")).alias("p"))
                     .agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for p, n in levels:
        total += n
        if total > HEAVY:
            break
        least = p
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(F.col("c") >= float(2 ** least)).collect()
    h = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    c = np.array([r.c for r in rows], dtype=np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def shingle_sets(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Per row: key_, hash_ (checksum of the text), n (set size), node (hash of the set), gid (hash of prefix and size), prefix, sig."""
    heavy, often = frequent_shingles(docs, text, k)
    shared = docs.sparkSession.sparkContext.broadcast((heavy, often))  # HEAVY entries of 16 bytes at most

    def ordered(s: np.ndarray) -> np.ndarray:
        heavy, often = shared.value
        if not len(heavy):
            return s
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        is_heavy = heavy[at] == s
        if not is_heavy.any():
            return s
        late = s[is_heavy]
        return np.concatenate([s[~is_heavy], late[np.argsort(often[at[is_heavy]], kind="stable")]])

    def sets(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys, sums = b.column("key_"), b.column("hash_")
            for a, group in _pieces(b, "t", k):
                n, node, gid, prefix, sig = [], [], [], [], []
                for s in group:
                    m = len(s)
                    n.append(m)
                    if not m:
                        for x in (node, gid, prefix, sig):
                            x.append(None)
                        continue
                    first = ordered(s)[:m - -(-percent * m // 100) + 1]
                    node.append(_node(s))
                    gid.append(_node(np.append(first, np.uint64(m))))
                    prefix.append(first.view(np.int64))
                    sig.append(_bitmap(s))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, len(group)), sums.slice(a, len(group)), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(gid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["key_", "hash_", "n", "node", "gid", "prefix", "sig"])
    slim = docs.select(F.col(key).cast("long").alias("key_"), F.xxhash64(text).alias("hash_"), F.col(text).alias("t"))
    with settings(docs.sparkSession):
        return materialize(slim.mapInArrow(sets, _SETS), "ngram-sets")


# -- candidate pairs ---------------------------------------------------------

def _pass(rows: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Mask of the pairs that may be links and are still to be tried."""
    n, pos = rows["n"], rows["pos"]
    ni, nj = n[i], n[j]
    least = -(-percent * (ni + nj) // (100 + percent))
    ok = np.minimum(ni, nj) * 100 >= np.maximum(ni, nj) * percent
    ok &= np.minimum(ni - pos[i], nj - pos[j]) >= least
    if "node" not in rows:  # postings of groups
        return ok
    node, comp = rows["node"], rows["comp"]
    ok &= comp[i] != comp[j]
    split = (rows["bi"][i] == rows["bj"][i]) | (rows["blk"][i] != rows["blk"][j])
    ok &= split
    v = np.where(node[i] > node[j], i, j)
    u = np.where(node[i] > node[j], j, i)
    ok &= node[u] > rows["floor"][v]
    for place, sig in rows["sig"]:
        at = np.flatnonzero(ok & (place[i] >= 0) & (place[j] >= 0))
        if not len(at):
            break
        diff = np.bitwise_count(sig[place[i[at]]] ^ sig[place[j[at]]]).sum(axis=1, dtype=np.int64)
        ok[at[diff > (ni + nj)[at] - 2 * least[at]]] = False
    return ok


def _chunk_pairs(rows: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the candidate pairs within the buckets of ``rows`` (sorted by bucket)."""
    key = rows["bucket"]
    m = len(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, m))
    found_i, found_j = [], []
    run_end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= 64, sizes)
    i = np.flatnonzero(small)
    d = 1
    while True:
        i = i[i + d < run_end[i]]
        if not len(i):
            break
        ok = _pass(rows, i, i + d, percent)
        found_i.append(i[ok])
        found_j.append(i[ok] + d)
        d += 1
    for s, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for a in range(s, s + size, 64):
            ii, jj = np.meshgrid(np.arange(a, min(a + 64, s + size)), np.arange(a, s + size), indexing="ij")
            up = jj > ii
            ii, jj = ii[up], jj[up]
            ok = _pass(rows, ii, jj, percent)
            found_i.append(ii[ok])
            found_j.append(jj[ok])
    if not found_i:
        e = np.empty(0, np.int64)
        return e, e
    return np.concatenate(found_i), np.concatenate(found_j)


def _bucket_numbers(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    if not t.num_rows:
        return np.empty(0, np.int64)
    change = np.zeros(t.num_rows - 1, bool)
    for k in keys:
        x = t.column(k).to_numpy()
        change |= x[1:] != x[:-1]
    return np.concatenate([[0], np.cumsum(change)])


def _rows_of(t: pa.Table) -> dict:
    out = {c: t.column(c).to_numpy() for c in ("bi", "bj", "blk", "node", "n", "pos", "comp", "floor")}
    out["sig"] = _bitmaps(t.column("sig").to_pylist())
    out["bucket"] = _bucket_numbers(t, ("sh", "bi", "bj"))
    return out


def _by_bucket(fn, keys: tuple[str, ...], rows: int = 1 << 14):
    """mapInArrow function that calls ``fn`` with tables of whole buckets; the input is sorted by ``keys``."""
    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.Table] = []
        n = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held.append(t)
            n += t.num_rows
            if n < rows:
                continue
            whole = pa.concat_tables(held)
            number = _bucket_numbers(whole, keys)
            last = int(np.searchsorted(number, number[-1]))
            if last:  # the last bucket may go on in the next batch
                out = fn(whole.slice(0, last))
                if out is not None:
                    yield out
            held, n = [whole.slice(last)], whole.num_rows - last
        if held:
            out = fn(pa.concat_tables(held))
            if out is not None:
                yield out
    return run


def _partnered_posts(percent: int):
    """Postings of groups (sh, gid, n, pos), in order of sh -> those with a partner that may be a link.

    A bucket of more than BLOCK postings is kept whole here; it is split when its members meet.
    """
    def fn(t: pa.Table):
        number = _bucket_numbers(t, ("sh",))
        size = np.bincount(number)[number] if len(number) else number
        keep = size > BLOCK
        mid = np.flatnonzero((size > 1) & ~keep)
        if len(mid):
            rows = {"n": t.column("n").to_numpy()[mid], "pos": t.column("pos").to_numpy()[mid], "bucket": number[mid]}
            i, j = _chunk_pairs(rows, percent)
            keep[mid[i]] = True
            keep[mid[j]] = True
        return t.select(["sh", "gid", "pos"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] \
            if keep.any() else None
    return _by_bucket(fn, ("sh",))


def _partnered_members(percent: int):
    """Members in their buckets -> those (sh, node, pos) with a partner that may be a link."""
    def fn(t: pa.Table):
        i, j = _chunk_pairs(_rows_of(t), percent)
        at = np.unique(np.concatenate([i, j]))
        if not len(at):
            return None
        return t.select(["sh", "node", "pos"]).take(pa.array(at)).combine_chunks().to_batches()[0]
    return _by_bucket(fn, ("sh", "bi", "bj"))


def _proposals(percent: int, tries: int):
    """Members in their buckets -> (v, u, more), the smallest partners u < v of each v."""
    def smallest(t: pa.Table):
        rows = _rows_of(t)
        i, j = _chunk_pairs(rows, percent)
        if not len(i):
            return None
        u, v = np.minimum(rows["node"][i], rows["node"][j]), np.maximum(rows["node"][i], rows["node"][j])
        order = np.lexsort((u, v))
        u, v = u[order], v[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v = u[new], v[new]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        rank = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
        more = np.repeat(np.diff(np.append(first, len(v))) > tries, np.diff(np.append(first, len(v))))
        keep = rank < tries
        return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(u[keep]), pa.array(more[keep])],
                                          names=["v", "u", "more"])

    return _by_bucket(smallest, ("sh", "bi", "bj"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose whole sets reach the threshold."""
    both = (pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v"))

    def check(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ok = []
            for x, y in zip(b.column("su"), b.column("sv")):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both_ = np.concatenate([x, y])
                both_.sort()
                inter = int((both_[1:] == both_[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(mask)
    return both.select("u", "v", "su", "sv").mapInArrow(check, "u long, v long")


def _whole_sets(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """The whole shingle sets of the nodes in ``wanted`` (node, rep), computed anew from their texts."""
    keys = wanted.select(F.col("rep").alias("key_")).distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    slim = docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("t")).alias("d")
    slim = slim.join(keys.alias("w"), F.col("d.key_").eqNullSafe(F.col("w.key_")), "left_semi").select("t")

    def sets(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for _, group in _pieces(b, "t", k):
                group = [s for s in group if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in group], pa.int64()),
                                                  pa.array([s.tobytes() for s in group], pa.binary())],
                                                 names=["node", "shingles"])
    found = slim.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])
    return found.join(wanted.select("node"), "node", "left_semi")


def _in_buckets(meeting: DataFrame, state: DataFrame) -> DataFrame:
    """Members (sh, node, pos) with their state, dealt out and sorted by bucket.

    A bucket of more than BLOCK members is dealt in pairs of blocks (bi, bj).
    """
    sizes = meeting.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK)
    rows = meeting.join(sizes, "sh", "left")
    rows = rows.withColumn("nb", F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("int"))
    rows = (rows.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("sh", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "node", "pos"))
    rows = rows.join(state, "node").select("sh", "bi", "bj", "blk", "node", "n", "pos", "comp", "floor", "sig")
    return rows.repartition(partitions(meeting.sparkSession), "sh", "bi", "bj").sortWithinPartitions("sh", "bi", "bj")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3,
                    percent: int = 90) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links).

    Two rows link when 100 * shared shingles >= percent * shingles of both together.
    """
    per_doc, comp = _components(docs, key, text, k, percent)
    least = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = comp.join(least, "comp").select("node", "component_id")
    out = per_doc.select("key_", "n", "node").join(ids, "node", "left")
    return out.select(F.col("key_").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key_")).alias("component_id"))


def _components(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``shingle_sets``; per node: node, rep (its smallest key), comp)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in 1..100")
    spark = docs.sparkSession
    per_doc = shingle_sets(docs, key, text, k, percent)
    some = per_doc.where("n > 0")
    members = materialize(some.groupBy("node").agg(F.min("key_").alias("rep"), F.first("n").alias("n"),
                                                   F.first("gid").alias("gid"), F.first("sig").alias("sig")),
                          "ngram-nodes")
    groups = some.select("gid", "n", "prefix").dropDuplicates(["gid"])
    posts = groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "sh"))
    posts = posts.repartition(partitions(spark), "sh").sortWithinPartitions("sh")
    shared = posts.select("sh", "gid", "n", "pos").mapInArrow(_partnered_posts(percent), "sh long, gid long, pos int")
    # members of one group meet as well: they have a bucket of their own
    own = (members.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
           .select(F.col("gid").alias("sh"), "gid", F.lit(0).alias("pos")))
    meeting = materialize(shared.union(own).join(members.select("gid", "node"), "gid").select("sh", "node", "pos"),
                          "ngram-meeting")
    state = members.select("node", "n", "sig", F.col("node").alias("comp"), F.lit(-2 ** 63).cast("long").alias("floor"))
    posted = _in_buckets(meeting, state).mapInArrow(_partnered_members(percent), "sh long, node long, pos int")
    posted = materialize(posted.distinct(), "ngram-posts")
    state = materialize(state.join(posted.select("node").distinct(), "node", "left_semi"), "ngram-state")

    edges, labels, floors, active, tries = None, None, None, None, 1
    while True:
        rows = posted if active is None else posted.join(active, "sh", "left_semi")
        now = state
        if labels is not None:
            now = (state.drop("comp", "floor").join(labels, "node", "left").join(floors, "node", "left")
                   .select("node", "n", "sig", F.coalesce("comp", "node").alias("comp"),
                           F.coalesce("floor", F.lit(-2 ** 63).cast("long")).alias("floor")))
        rows = _in_buckets(rows, now)
        found = rows.mapInArrow(_proposals(percent, tries), "v long, u long, more boolean")
        best = found.groupBy("v", "u").agg(F.max("more").alias("more"))
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("u")))
        best = materialize(best.where(F.col("r") <= tries + 1), "ngram-tries")
        pairs = best.where(F.col("r") <= tries).select("u", "v")
        if pairs.isEmpty():
            break
        wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        wanted = materialize(wanted.join(members.select("node", "rep"), "node"), "ngram-wanted")
        # not written: one shuffle of the sets by node then serves both joins
        links = materialize(_verify(pairs, _whole_sets(docs, key, text, k, wanted), percent), "ngram-links")
        tried = best.groupBy("v").agg(F.max(F.when(F.col("r") <= tries, F.col("u"))).alias("floor"),
                                      F.max((F.col("r") > tries) | F.col("more")).alias("more"))
        if floors is not None:
            old = floors.select(F.col("node").alias("v"), F.col("floor").alias("was"))
            floors = tried.select("v", "floor").join(old, "v", "full").select(
                F.col("v").alias("node"), F.coalesce(F.greatest("floor", "was"), "floor", "was").alias("floor"))
        else:
            floors = tried.select(F.col("v").alias("node"), "floor")
        floors = materialize(floors, "ngram-floors")
        # edges keep the components of all links so far; one step a round is enough to skip most pairs
        new = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
        edges = star_step(new if edges is None else edges.union(new))
        labels = materialize(nearest(edges), "ngram-labels")
        still = tried.where("more").select(F.col("v").alias("node")).distinct()
        active = materialize(posted.join(still, "node", "left_semi").select("sh").distinct(), "ngram-active")
        if active.isEmpty():
            break
        tries *= 4
    comp = members.select("node", "rep")
    if edges is not None:
        comp = comp.join(connected_components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        comp = comp.withColumn("comp", F.col("node"))
    return per_doc, comp


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates: that with the smallest key.

    Rows with a null key are kept only if no row of their group has a key; of rows that share the
    key of their group's representative, one stays.
    """
    comps = near_duplicates(docs, key, text, k, percent)
    own = F.col(key).eqNullSafe(F.col("component_id")).cast("long")
    odd = materialize(comps.groupBy(F.col(key).alias("key_")).agg(F.sum(own).alias("rows_")).where("rows_ <> 1"),
                      "ngram-odd")
    # texts are shuffled only if the keys that go, fewer than the documents, are too many to send to all tasks
    few = odd.count() <= BROADCAST_KEYS

    def keyed(how: str, keys: DataFrame) -> DataFrame:
        keys = F.broadcast(keys) if few else keys
        return docs.alias("d").join(keys.alias("s"), F.col(f"d.{key}").cast("long").eqNullSafe(F.col("s.key_")), how)
    single = keyed("left_anti", odd.select("key_"))
    again = odd.where("rows_ > 1").select("key_")
    if again.isEmpty():
        return single
    return single.union(keyed("left_semi", again).dropDuplicates([key]))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                      percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates, whatever their keys.

    The smallest key of a group stays (null last), then the smallest checksum of the text. Rows without a
    shingle are linked with nothing: all stay but repeats of one key and text.
    """
    per_doc, comp = _components(docs, key, text, k, percent)
    order = F.struct(F.col("key_").isNull().alias("none"), "key_", "hash_")
    first = per_doc.where("n > 0").groupBy("node").agg(F.min(order).alias("m"))
    first = comp.select("node", "comp").join(first, "node")
    least = first.groupBy("comp").agg(F.min("m").alias("least"))
    least = first.join(least, "comp").select("node", "least")
    rows = per_doc.select("key_", "hash_", "n", "node").join(least, "node", "left")
    stays = (F.col("n") == 0) | (F.col("least") == order)
    odd = materialize(rows.groupBy("key_", "hash_").agg(F.count(F.lit(1)).alias("rows_"), F.first(stays).alias("stays"))
                      .where("rows_ > 1 OR NOT stays"), "ngram-odd")
    # texts are shuffled only if the rows that go are too many to send their keys and checksums to all tasks
    few = odd.count() <= BROADCAST_KEYS
    d = docs.withColumn("__h", F.xxhash64(text))

    def keyed(how: str, pairs: DataFrame) -> DataFrame:
        pairs = (F.broadcast(pairs) if few else pairs).alias("s")
        return d.alias("d").join(pairs, F.col(f"d.{key}").cast("long").eqNullSafe(F.col("s.key_"))
                                 & (F.col("d.__h") == F.col("s.hash_")), how)
    single = keyed("left_anti", odd.select("key_", "hash_"))
    again = odd.where("stays").select("key_", "hash_")
    if not again.isEmpty():
        single = single.union(keyed("left_semi", again).dropDuplicates([key, "__h"]))
    return single.select(*docs.columns)
