"""Most similar vectors for every vector by shifted space-filling curves.

Each of several curves projects all vectors at random onto a few dimensions, shifts the grid and orders them by their
Hilbert key. Spark range-partitions each ordering; in it every vector is compared with those at most ``window`` places
away, across the borders of partitions too, and the best of all curves are merged and compared exactly. Copies of a vector are one point of the curves. Vectors
that share a key have no order on the curve, so runs of one key too long for the window are compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.vectors import bound, dot
from loomtext.scratch import written
from loomtext.skew import join_per_key

_BLOCK = 256
#: Vectors travel along the curves in bytes; their cosines are off by about 0.001, so what may be among the best is kept
#: within this margin and compared exactly afterwards.
MARGIN = 0.01
#: Rows of a block of a run of equal keys; each pair of blocks is one group of Spark's.
_RUN_BLOCK = 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates below ``2**bits``; dimensions times bits is at most 63."""
    axes = cells.T.astype(np.uint64).copy()
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for x in axes:
            hit = (x & q) != 0
            swap = np.where(hit, np.uint64(0), (axes[0] ^ x) & p)
            axes[0] = np.where(hit, axes[0] ^ p, axes[0] ^ swap)
            x ^= swap
        q >>= one
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        flip = np.where((axes[-1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    axes ^= flip
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for x in axes:
            key = (key << one) | ((x >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(arr.flatten(), dtype=np.float32).reshape(-1, dim)


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows as binary values of one signed byte a number, each row scaled to its largest."""
    q = np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))).astype(np.int8)
    offsets = np.arange(0, q.size + 1, q.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(q))])


def _from_bytes(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of what :func:`_bytes` made."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    x = np.frombuffer(column.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _best_in_window(ids: np.ndarray, vectors: np.ndarray, asks: np.ndarray, window: int, k: int, least: float, first: int, last: int, split: int | None = None):
    """Rows ``(id, other, cosine)``: of the asking ones of rows first..last-1 at least the k best among the rows at most
    ``window`` away; with ``split``, among those on the other side of it."""
    out_a, out_b, out_c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    for lo in range(first, last, _BLOCK):
        hi = min(lo + _BLOCK, last)
        own = lo + np.flatnonzero(asks[lo:hi])
        if not len(own):
            continue
        a, b = max(0, lo - window), min(len(ids), hi + window)
        cos = vectors[own] @ vectors[a:b].T
        away = np.abs(own[:, None] - np.arange(a, b)[None, :])
        out = (away > window) | (away == 0)
        if split is not None:
            out |= (own[:, None] < split) == (np.arange(a, b)[None, :] < split)
        cos[out] = -2
        if cos.shape[1] > k:
            cols = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            least_kept = np.take_along_axis(cos, cols, 1).min(axis=1, keepdims=True) - MARGIN
        else:
            least_kept = np.full((len(own), 1), -1.5)
        rows, cols = np.nonzero((cos >= least_kept) & (cos >= least - MARGIN) & (cos > -1.5))
        out_a.append(ids[own][rows])
        out_b.append(ids[a:b][cols])
        out_c.append(cos[rows, cols])
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_c)


def _across_border(dim: int, window: int, k: int, least: float):
    """Of a group, the last rows of one range partition and the first of the next, the pairs across the border."""

    def best(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("nth").to_numpy(), kind="stable")
        group = group.take(pa.array(order)).combine_chunks()
        ids, on, nth, asks = (group.column(c).to_numpy() for c in ("head", "curve", "nth", "ask"))
        x = _from_bytes(group.column("packed").combine_chunks(), dim)
        found = [(ids[:0], ids[:0], np.empty(0, np.float32))]
        for curve in np.unique(on):
            here = on == curve
            split = int((nth[here] < 0).sum())
            found.append(_best_in_window(ids[here], x[here], asks[here], window, k, least, 0, int(here.sum()), split))
        a, b, c = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.table({"head": a, "other": b, "cosine": np.round(c.astype(np.float64), 6)})

    return best


class _LongRuns:
    """Of rows in order of curve and key, those in runs of one curve and key of more than ``most`` rows."""

    def __init__(self, most: int):
        self.most, self.at, self.n, self.ids = most, None, 0, []

    def of(self, on: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Curves, keys and ids of the rows now known to be in such runs; only the start of the last run is held back."""
        starts = np.concatenate([[0], np.flatnonzero((on[1:] != on[:-1]) | (keys[1:] != keys[:-1])) + 1])
        sizes = np.diff(np.concatenate([starts, [len(ids)]]))
        out = []
        for start, size in zip(starts[sizes > self.most], sizes[sizes > self.most]):
            if 0 < start < starts[-1]:
                out.append((on[start], keys[start], ids[start : start + size]))
        for start, size in dict.fromkeys([(starts[0], sizes[0]), (starts[-1], sizes[-1])]):
            if self.at != (on[start], keys[start]):
                self.at, self.n, self.ids = (on[start], keys[start]), 0, []
            self.n += size
            self.ids.append(ids[start : start + size])
            if self.n > self.most:
                out.append((*self.at, np.concatenate(self.ids)))
                self.ids = []
        sizes = [len(x[2]) for x in out]
        return np.repeat([x[0] for x in out], sizes), np.repeat([x[1] for x in out], sizes), np.concatenate([np.empty(0, np.int64), *(x[2] for x in out)])


def _best_in_block(ids: np.ndarray, vectors: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int, least: float):
    """Rows ``(id, other)``: of each of ``ids`` the k best of ``other_ids``, itself left out, equal cosines by smaller id."""
    order = np.argsort(other_ids)
    other_ids, others = other_ids[order], others[order].astype(np.float64).T
    place = np.arange(len(other_ids))
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, len(ids), _BLOCK):
        some = ids[lo : lo + _BLOCK]
        cos = np.rint((vectors[lo : lo + _BLOCK].astype(np.float64) @ others) * 1e6).astype(np.int64)
        own = some[:, None] == other_ids[None, :]
        ranks = np.where(own, np.int64(2**62), place - cos * len(other_ids))
        cols = np.argpartition(ranks, k - 1, axis=1)[:, :k] if len(other_ids) > k else np.broadcast_to(place, ranks.shape)
        fits = ~np.take_along_axis(own, cols, 1) & (np.take_along_axis(cos, cols, 1) >= least * 1e6 - 1)
        out_a.append(some[np.nonzero(fits)[0]])
        out_b.append(other_ids[cols[fits]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _in_runs(runs: DataFrame, head: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """``(head, other)``: of every row of each run ``(curve, key, head)`` its k best of that run, and further ones of it.

    Work grows with the square of a run, spread over pairs of blocks. Runs of the same heads on several curves count once.
    """
    same = runs.groupBy("curve", "key").agg(F.count("*").alias("n"), F.min("head").alias("first"), F.bit_xor(F.xxhash64("head")).alias("sum"))
    once = same.groupBy("n", "first", "sum").agg(F.min(F.struct("curve", "key")).alias("at")).select("at.curve", "at.key", "n")
    rows = join_per_key(runs, written(once, "vector-runs"), ["curve", "key"], "n").join(head, "head")
    blocks = F.ceil(F.col("n") / _RUN_BLOCK)
    own = rows.select("curve", "key", "head", "v", F.pmod(F.xxhash64("head"), blocks).alias("b"), blocks.alias("blocks"))
    pairs = own.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")}).select("curve", "key", "i", "j", "b", "head", "v")

    def best(group: pa.Table) -> pa.Table:
        ids, b, i, j = (group.column(c).to_numpy() for c in ("head", "b", "i", "j"))
        x = _matrix(group.column("v"), dim)
        one, two = b == i, b == j
        found = [_best_in_block(ids[one], x[one], ids[two], x[two], k, least)]
        if i[0] != j[0]:
            found.append(_best_in_block(ids[two], x[two], ids[one], x[one], k, least))
        return pa.table({"head": np.concatenate([f[0] for f in found]), "other": np.concatenate([f[1] for f in found])})

    return pairs.groupBy("curve", "key", "i", "j").applyInArrow(best, "head long, other long")


def similar_vectors(
    vectors: DataFrame, item: str, vector: str, dim: int, k: int = 5, least: float = -1.0,
    curves: int = 16, window: int = 64, axes: int = 12, bits: int = 4, seed: int = 7, asks: Column | None = None,
) -> DataFrame:
    """``(item, other, cosine, place)``: of every vector the ``k`` others with the highest cosine found, if at least ``least``.

    Equal cosines (to six decimals) go by smaller id. Vectors that are null, hold a null, NaN or infinity, have not
    ``dim`` values or a norm of zero take no part; rows with a null id don't either; a repeated id counts once, always with
    the same of its vectors (the one of least hash). With ``asks``, a condition on the rows, only those that fulfil it are
    answered, against all rows. Exact copies of a vector, however many, are compared once and see the copies of smallest id first.
    Other columns are ignored; an empty table gives no rows.

    The search is approximate: ``curves`` and ``window`` trade recall for time, which grows with asking rows times both.
    What is near is found by few; neighbours that are hardly nearer than the rest need a window that grows with the rows.
    Nothing is sampled: every vector is on every curve. Pairs across the border of two range partitions are compared too.
    Vectors with the same key on some curve, such as near copies or scaled ones, are all compared, however many they are.
    """
    if axes * bits > 63 or axes > dim:
        raise ValueError("axes * bits must be at most 63 and axes at most dim")
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = vectors.where(F.col(item).isNotNull() & v.isNotNull()).where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    # the norm is computed once a vector, not once a value
    unit = bound(norm, lambda n: F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: (x / n).cast("float"))))
    ask = F.coalesce(asks, F.lit(False)) if asks is not None else F.lit(True)
    rows = usable.select(F.col(item).cast("long").alias("item"), unit.alias("v"), ask.alias("ask")).where("v is not null")
    once = rows.groupBy("item").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.hash("v").alias("g"), "v")).alias("r"), F.max("ask").alias("ask"))
    rows = written(once.select("item", "ask", "r.*"), "vectors")

    counted = rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("item").alias("head"), F.max("ask").alias("ask"))
    counted = written(counted, "vector-classes")
    firsts_ = counted.select(F.col("head").alias("item"), F.col("ask").alias("any"), "h", "g")
    head = rows.join(firsts_, ["item", "h", "g"]).select(F.col("item").alias("head"), "v", F.col("any").alias("ask"))
    head = written(head, "vector-heads")
    found = _on_curves(head, dim, k, least, curves, window, axes, bits, seed)

    # copies: the first k + 1 members of each class that has more than one
    many = counted.where("n > 1")
    copies = join_per_key(rows.select("item", "h", "g", F.col("ask").alias("asks")), many, ["h", "g"], "n").select("item", "head", "asks")
    copies = written(copies, "vector-copies")
    order = Window.partitionBy("head").orderBy("item")
    firsts = copies.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("head").agg(F.sort_array(F.collect_list("item")).alias("members"))
    other = found.join(firsts.select(F.col("head").alias("other"), F.col("members").alias("other_members")), "other", "left")
    entry = F.transform(F.coalesce("other_members", F.array("other")), lambda m: F.struct((-F.col("cosine")).alias("minus"), m.alias("other")))
    near = other.groupBy("head").agg(F.flatten(F.collect_list(entry)).alias("near"))
    own = firsts.where(F.lit(least <= 1.0)).select("head", F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("minus"), m.alias("other"))).alias("own"))
    lists = near.join(own, "head", "full").select("head", F.slice(F.array_sort(F.concat(F.coalesce("own", F.array()), F.coalesce("near", F.array()))), 1, k + 1).alias("best"))
    lists = written(lists, "vector-lists")

    sized = counted.where("ask").select("head", "n").join(lists, "head")
    single = sized.where("n = 1").select(F.col("head").alias("item"), "best")
    several = join_per_key(copies.where("asks"), sized.where("n > 1"), ["head"], "n").select("item", "best")
    each = single.unionByName(several).select("item", F.posexplode(F.slice(F.filter("best", lambda x: x["other"] != F.col("item")), 1, k)).alias("p", "x"))
    return each.select("item", "x.other", (-F.col("x.minus")).alias("cosine"), (F.col("p") + 1).alias("place"))


def _on_curves(head: DataFrame, dim: int, k: int, least: float, curves: int, window: int, axes: int, bits: int, seed: int) -> DataFrame:
    """``(head, other, cosine)``: of every asking head at least its k best found on any curve, each once, with the exact cosine."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(np.float64)
            n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim), "n": np.full(dim, n), "s": s, "ss": ss})

    sums = head.mapInArrow(moments, "i long, n long, s double, ss double").groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("i").collect()
    n = max(1, sums[0][1] if sums else 1)
    mean = np.array([r[2] / n for r in sums]) if sums else np.zeros(dim)
    width = float(np.sqrt(max(1e-12, sum(r[3] / n for r in sums) - float(mean @ mean)) / dim)) if sums else 1.0
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes].astype(np.float32) for _ in range(curves)]
    shifts = [rng.random(axes).astype(np.float32) for _ in range(curves)]
    centre = mean.astype(np.float32)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            packed = _bytes(x)
            x = x - centre
            for curve in range(curves):
                # three standard deviations either way, and a shift of up to a quarter of that range
                z = ((x @ bases[curve]) / (6 * width) + 0.5 + 0.25 * shifts[curve]) / 1.25
                cells = np.clip(z * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), curve, dtype=np.int32)), pa.array(hilbert_keys(cells, bits)), batch.column("head"), packed, batch.column("ask")],
                    names=["curve", "key", "head", "packed", "ask"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of curve and key; a row is compared once the ``window`` rows after it are there. The first and
        last rows of a partition are also put out as they are, to be compared across its borders."""
        context = TaskContext.get()
        here_part = context.partitionId() if context else 0
        ids, vecs, on, ask, done = np.empty(0, np.int64), np.empty((0, dim), np.float32), np.empty(0, np.int32), np.empty(0, bool), 0
        long_runs = _LongRuns(window + 1)
        begun, tail = 0, None

        def flush(upto: int):
            a, b, c = _best_in_window(ids, vecs, ask, window, k, least, done, upto)
            return rows(head=a, other=b, cosine=np.round(c.astype(np.float64), 6))

        def rows(**columns) -> pa.RecordBatch:
            n = len(columns["head"])
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

        def border(part: pa.Table, border: int, first: int) -> pa.RecordBatch:
            columns = {c: part.column(c).combine_chunks() for c in ("head", "curve", "packed", "ask")}
            return rows(**columns, border=np.full(len(part), border), nth=np.arange(first, first + len(part)))

        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([batch])
            if begun < window:
                yield border(part.slice(0, window - begun), here_part - 1, begun)
                begun += len(part.slice(0, window - begun))
            tail = pa.concat_tables([tail, part]) if tail is not None else part
            tail = tail.slice(max(0, len(tail) - window))
            new_on, new_ask = np.asarray(batch.column("curve")), batch.column("ask").to_numpy(zero_copy_only=False)
            new_ids, new_vecs = np.asarray(batch.column("head")), _from_bytes(batch.column("packed"), dim)
            run_on, run_keys, run_ids = long_runs.of(new_on, np.asarray(batch.column("key")), new_ids)
            if len(run_ids):
                yield rows(curve=run_on, key=run_keys, head=run_ids)
            for curve in np.unique(new_on):
                here = new_on == curve
                if len(on) and on[-1] != curve:
                    if done < len(ids):
                        yield flush(len(ids))
                    ids, vecs, on, ask, done = ids[:0], vecs[:0], on[:0], ask[:0], 0
                ids, vecs, on, ask = (np.concatenate(x) for x in ((ids, new_ids[here]), (vecs, new_vecs[here]), (on, new_on[here]), (ask, new_ask[here])))
                upto = len(ids) - window
                if upto > done:
                    yield flush(upto)
                    keep = max(0, upto - window)
                    ids, vecs, on, ask, done = ids[keep:], vecs[keep:], on[keep:], ask[keep:], upto - keep
        if done < len(ids):
            yield flush(len(ids))
        if tail is not None:
            yield border(tail, here_part, -len(tail))

    schema = "head long, other long, cosine double, curve int, key long, packed binary, ask boolean, border int, nth int"
    types = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    out = pa.schema([(n, types[t]) for n, t in (f.split() for f in schema.split(", "))])
    ordered = head.mapInArrow(keyed, "curve int, key long, head long, packed binary, ask boolean").repartitionByRange("curve", "key").sortWithinPartitions("curve", "key", "head")
    # pairs have a cosine, rows of long runs a curve and key, rows at borders a border
    raw = written(ordered.mapInArrow(compared, schema), "vector-windows")
    at_border = raw.where("border >= 0").select("border", "nth", "curve", "head", "packed", "ask")
    across = at_border.groupBy("border").applyInArrow(_across_border(dim, window, k, least), "head long, other long, cosine double")
    near = raw.where("other is not null").select("head", "other", "cosine").unionByName(across)
    near = written(near.groupBy("head", "other").agg(F.max("cosine").alias("cosine")), "vector-near")
    # bounded by the curves times k and what is within the margin
    cut = near.groupBy("head").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("all"))
    cut = cut.select("head", F.coalesce(F.try_element_at("all", F.lit(k)), F.lit(-2.0)).alias("kth"))
    kept = near.join(cut, "head").where(F.col("cosine") >= F.col("kth") - MARGIN).select("head", "other")
    runs = raw.where("key is not null").select("curve", "key", "head")
    if not runs.isEmpty():
        kept = kept.union(_in_runs(runs, head, dim, k, least).join(head.where("ask").select("head"), "head", "left_semi")).distinct()
    one, two = head.select("head", F.col("v").alias("a")), head.select(F.col("head").alias("other"), F.col("v").alias("b"))
    exact = kept.join(one, "head").join(two, "other").select("head", "other", F.round(dot(F.col("a"), F.col("b")), 6).alias("cosine"))
    return written(exact.where(F.col("cosine") >= least), "vector-pairs")
