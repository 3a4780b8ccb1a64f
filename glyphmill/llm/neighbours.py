"""Problem 6: the most similar vectors of every vector."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.runtime import stage

#: Vectors that the index is fitted on, for each model and dim.
SAMPLE = 20_000
#: Vectors whose nearest list is the same, lists a vector is put into, how far a list's centre may lie behind the
#: nearest one's (in cosine), and the most lists (their centres are broadcast).
LIST_SIZE, SPILL, BEHIND, MAX_LISTS = 4096, 3, 0.25, 8192
#: Vectors of a sub-list, and sub-lists that a vector is compared with.
SUBLIST_SIZE, PROBES = 256, 6
#: Vectors of one list that are compared in one group; a larger list is compared in pairs of parts.
MAX_GROUP = 50_000
#: Bytes of vectors, before compression, of one partition of lists.
PARTITION_BYTES = 32 << 20
#: Share of the dimensions that is coded, and standard deviations of a table sum's error that the scan leaves room for.
CODED, DEVIATIONS = 0.7, 5.0
#: Cosine below which the order of neighbours matters less to the quantiser.
ANISOTROPY = 0.2
#: Levels of a table entry, such that four entries add up in a byte.
LEVELS, ADDENDS = 63, 4
#: Share of pairs left by the table scan from which a block is scored as a whole.
DENSE = 0.03
#: Candidates that are scored exactly for each query and batch of :func:`nearest`.
RERANK = 64
QUERY_BLOCK, KNN_BLOCK = 256, 4096


@dataclass
class Quantiser:
    """Four-bit product codes of two dimensions each, fitted with the score-aware loss, of the leading ``turn`` of a vector."""

    books: np.ndarray  # (subspaces, 16, 2)
    eta: float
    turn: np.ndarray  # (dims, leading dims), orthonormal columns
    error: float = 0.0  # standard deviation of a table sum from the inner product of the leading parts

    def leading(self, x: np.ndarray) -> np.ndarray:
        """The part of ``x`` that is coded, padded to whole subspaces."""
        head = x @ self.turn
        return np.pad(head, ((0, 0), (0, 2 * len(self.books) - head.shape[1])))

    def encode(self, head: np.ndarray, rounds: int = 1) -> np.ndarray:
        """(rows, subspaces) codes: nearest first, then coordinate descent on the score-aware loss.

        The loss of a residual r of x is |r|^2 + (eta - 1) (r.x)^2 / |x|^2: what is parallel
        to x changes the scores of its nearest neighbours most.
        """
        parts = head.reshape(len(head), -1, 2)
        unit = parts / np.maximum(np.linalg.norm(head, axis=1), 1e-12)[:, None, None]
        codes = np.empty(parts.shape[:2], dtype=np.uint8)
        along = np.empty(parts.shape[:2], dtype=np.float32)
        for m, book in enumerate(self.books):
            far = (book**2).sum(1) - 2 * parts[:, m] @ book.T
            codes[:, m] = far.argmin(1)
            along[:, m] = ((parts[:, m] - book[codes[:, m]]) * unit[:, m]).sum(1)
        total = along.sum(1)
        for _ in range(rounds):
            for m, book in enumerate(self.books):
                inner, mine = unit[:, m] @ book.T, (parts[:, m] * unit[:, m]).sum(1, keepdims=True)
                rest = (total - along[:, m])[:, None]
                loss = (book**2).sum(1) - 2 * parts[:, m] @ book.T + (self.eta - 1) * (rest + mine - inner) ** 2
                best = loss.argmin(1)
                codes[:, m] = best
                new = mine[:, 0] - inner[np.arange(len(best)), best]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The leading parts that the codes stand for."""
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)

    def tables(self, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of subspaces, 256, queries) table entries of LEVELS levels, and each query's step and sum of offsets."""
        parts = np.ascontiguousarray(head.T).reshape(len(self.books), 2, 1, -1)
        single = self.books[:, :, :1] * parts[:, 0] + self.books[:, :, 1:] * parts[:, 1]
        if len(single) % 2:
            single = np.concatenate([single, np.zeros_like(single[:1])])
        single -= (low := single.min(axis=1, keepdims=True))
        step = np.maximum(single.max(axis=1).max(axis=0), 1e-12) / (LEVELS // 2)
        entries = np.rint(single / step).astype(np.uint8)
        pair = entries[0::2, :, None, :] + entries[1::2, None, :, :]
        return pair.reshape(len(pair), 256, -1), step, low.sum(axis=(0, 1))

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte, (rows, pairs)."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
        return codes[:, 0::2] * np.uint8(16) + codes[:, 1::2]

    def scan(self, packed: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """(rows, queries) sums of table entries."""
        total = np.zeros((len(packed), entries.shape[2]), dtype=np.uint16)
        one, some = np.empty(total.shape, dtype=np.uint8), np.empty(total.shape, dtype=np.uint8)
        places = packed.T.astype(np.intp)
        for first in range(0, len(entries), ADDENDS):
            np.take(entries[first], places[first], axis=0, out=some, mode="clip")
            for k in range(first + 1, min(first + ADDENDS, len(entries))):
                np.take(entries[k], places[k], axis=0, out=one, mode="clip")
                np.add(some, one, out=some)
            total += some
        return total

    def deviation(self, queries: np.ndarray, rows: np.ndarray, cosine: np.ndarray) -> float:
        """Deviation of the table sums of all pairs, or of those with a cosine of 0.6 or more where it is larger."""
        entries, step, low = self.tables(queries)
        gap = self.scan(self.packed(self.encode(rows)), entries).T * step[:, None] + low[:, None] - queries @ rows.T
        near = gap[cosine >= 0.6]
        return float(max(np.sqrt((gap**2).mean()), np.sqrt((near**2).mean()) if len(near) > 50 else 0.0))


def fit_quantiser(sample: np.ndarray, share: float = 1.0, rounds: int = 3) -> Quantiser:
    """Books of 16 points per two dimensions by alternating score-aware codes and least squares.

    Coded is the leading ``share`` of the dimensions after a turn to the sample's principal axes.
    """
    d = sample.shape[1]
    few = max(2, round(d * share))
    turn = np.linalg.eigh(sample.T.astype(np.float64) @ sample)[1][:, ::-1][:, :few].astype(np.float32)
    eta = max((few - 1) * ANISOTROPY**2 / (1 - ANISOTROPY**2), 1.0)
    m = (few + 1) // 2
    rng = np.random.default_rng(5)
    q = Quantiser(np.zeros((m, 16, 2), dtype=np.float32), eta, turn)
    head = q.leading(sample)
    parts = head.reshape(len(head), -1, 2)
    unit = (parts / np.maximum(np.linalg.norm(head, axis=1), 1e-12)[:, None, None]).astype(np.float64)
    q.books = np.ascontiguousarray(parts[rng.choice(len(sample), 16, replace=len(sample) < 16)].transpose(1, 0, 2))
    for turned in range(rounds + 1):
        codes = q.encode(head, rounds=int(turned > 0))
        along = ((parts - q.decode(codes).reshape(parts.shape)) * unit).sum(2)
        rest = along.sum(1, keepdims=True) - along
        for j in range(m):
            x, u = parts[:, j].astype(np.float64), unit[:, j]
            outer = np.eye(2) + (eta - 1) * u[:, :, None] * u[:, None, :]
            right = x + (eta - 1) * u * (rest[:, j] + (x * u).sum(1))[:, None]
            a, b = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(a, codes[:, j], outer)
            np.add.at(b, codes[:, j], right)
            used = np.bincount(codes[:, j], minlength=16) > 0
            q.books[j][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
    q.error = q.deviation(head[:256], head[:4096], sample[:256] @ sample[:4096].T)
    return q


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 2) -> np.ndarray:
    """Unit centres of ``lists`` lists by spherical k-means over the sample."""
    rng = np.random.default_rng(3)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        centres[near[order][first]] = np.add.reduceat(sample[order], first, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at unit length."""
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))).astype(np.float32)


def _packed_vectors(x: np.ndarray) -> bytes:
    """Lossless: the bytes of all numbers by place (equal places look alike), compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True) + x.nbytes.to_bytes(8, "little")


def _unpacked_vectors(block: bytes, dim: int) -> np.ndarray:
    size = int.from_bytes(block[-8:], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(block[:-8], size, asbytes=True), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.float32).reshape(-1, dim)


def _unit(column: pa.Array, dims: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors of ``dim``."""
    at, x = _raw(column, dims, dim)
    return at, _normal(x)


def _raw(column: pa.Array, dims: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of the usable vectors of ``dim``: right length, finite, not zero."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    right = (lengths == dim) & (dims == dim)
    flat = column.filter(pa.array(right)).flatten().fill_null(float("nan"))
    x = np.asarray(flat, dtype=np.float32).reshape(-1, dim)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(size) & (size > 0)
    return np.flatnonzero(right)[good], x[good]


def usable(vectors: DataFrame) -> DataFrame:
    """(model, dim, chunk_id, vec) of rows whose vec has dim finite elements, not all zero."""
    vec = F.col("vec")
    odd = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(vec, lambda v: v != 0)
    rows = vectors.select("model", F.col("dim").cast("int").alias("dim"), F.col("chunk_id").cast("long").alias("chunk_id"), "vec")
    return rows.where(vec.isNotNull() & (F.size(vec) == F.col("dim")) & (F.col("dim") > 0) & ~odd & some & F.col("chunk_id").isNotNull())


def _sample(rows: DataFrame, kinds: list) -> dict[tuple, np.ndarray]:
    """Unit vectors of up to SAMPLE rows per (model, dim), the first by a hash of the id, so the same on each run."""
    out: dict[tuple, np.ndarray] = {}
    for kind in kinds:
        share = min(1.0, 1.3 * SAMPLE / max(kind["n"], 1))
        own = rows.where(F.col("model").eqNullSafe(F.lit(kind["model"])) & (F.col("dim") == kind["dim"]))
        place = F.xxhash64("chunk_id")
        own = own.where(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(place, "chunk_id", F.xxhash64("vec")).limit(SAMPLE)
        table = own.select("vec").toArrow().combine_chunks()
        column = table.column(0).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32()))
        _, x = _unit(column, np.full(len(column), kind["dim"]), kind["dim"])
        out[kind["model"], kind["dim"]] = x
    return out


def _best(q: np.ndarray, x: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best candidates of each query: by score, then the smaller id, an id once."""
    order = np.lexsort((ids[x], -score, q))
    q, n = q[order], ids[x][order]
    seen = np.lexsort((n, q))
    once = np.zeros(len(order), dtype=bool)
    # of equal (query, id) the first in score order stays; lexsort is stable
    once[seen[np.flatnonzero((np.diff(q[seen], prepend=-1) != 0) | (np.diff(n[seen], prepend=np.iinfo(np.int64).min) != 0))]] = True
    order, q = order[once], q[once]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


class Group:
    """The vectors of one list, compared within sub-lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, quantiser: Quantiser, k: int, least: float) -> None:
        self.ids, self.x, self.packed, self.quantiser, self.k, self.least = ids, x, quantiser.packed(codes), quantiser, k, least
        self.head = quantiser.leading(x)
        self.size = np.linalg.norm(self.head, axis=1)
        # the length of what the codes do not show of a vector
        self.rest = np.sqrt(np.maximum(1 - np.linalg.norm(self.head, axis=1).astype(np.float64) ** 2, 0)).astype(np.float32) + np.float32(1e-4)

    def _left(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``rows``, places in ``q``) of the pairs that the table scan leaves.

        What is not coded adds at most the product of its lengths to a cosine; with that and
        DEVIATIONS of a table sum's error, a pair left out does not reach ``least``.
        """
        entries, step, low = self.quantiser.tables(self.head[q])
        floor = self.least - DEVIATIONS * self.quantiser.error
        found = []
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            lowest = np.ceil((floor - self.rest[q] * self.rest[own].max() - low) / step)
            total = self.quantiser.scan(self.packed[own], entries)
            hit = np.flatnonzero(total >= np.clip(lowest, 0, 65535).astype(np.uint16))
            if len(hit) < DENSE * total.size:
                a, b = np.divmod(hit, len(q))
                kept = step[b] * total.ravel()[hit] + low[b] + self.rest[q[b]] * self.rest[own[a]] >= floor
                a, b = a[kept], b[kept]
            else:
                a, b = self._whole(own, q)
            found.append((a + at, b))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _whole(self, rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _left, where many pairs are similar: those that can be among the ``k`` best of either side in this block."""
        score = self.x[rows] @ self.x[q].T
        score[self.ids[rows][:, None] == self.ids[q]] = -2
        keep = np.zeros(score.shape, dtype=bool)
        for axis in (0, 1):
            k = min(self.k, score.shape[axis])
            least = -np.partition(-score, k - 1, axis=axis).take([k - 1], axis=axis)
            keep |= score >= np.maximum(least, self.least) - 1e-5
        return np.nonzero(keep & (score >= self.least - 1e-5))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, id, cosine) of up to ``k`` others for every vector with a cosine of ``least`` or more."""
        n = len(self.ids)
        lists = max(1, n // SUBLIST_SIZE)
        if lists > 1:
            rng = np.random.default_rng(11)
            few = self.x[np.sort(rng.choice(n, min(n, 24 * lists), replace=False))]
            near = self.x @ fit_lists(few, lists).T
            p = min(PROBES, near.shape[1])
            probed = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < near.shape[1] else np.tile(np.arange(p), (n, 1))
            home = near.argmax(1)
        else:
            probed, home = np.zeros((n, 1), dtype=np.int64), np.zeros(n, dtype=np.int64)
        order = np.argsort(probed.ravel(), kind="stable")
        edges = np.searchsorted(probed.ravel()[order], np.arange(lists + 1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        waiting = 0
        for s in range(lists):
            members = order[edges[s] : edges[s + 1]] // probed.shape[1]
            own = members[home[members] == s]
            members = members[np.argsort(self.rest[members], kind="stable")]
            for at in range(0, len(own), QUERY_BLOCK):
                q = own[at : at + QUERY_BLOCK]
                a, b = self._left(q, members)
                a, b = members[a], q[b]
                # two vectors at home here are met from both sides
                once = (home[a] != s) | (a < b)
                a, b = a[once], b[once]
                score = np.empty(len(a), dtype=np.float32)
                for part in range(0, len(a), 100_000):
                    c = slice(part, part + 100_000)
                    score[c] = np.einsum("ij,ij->i", self.x[a[c]], self.x[b[c]])
                good = (score >= self.least - 1e-6) & (self.ids[a] != self.ids[b])
                a, b, score = a[good], b[good], score[good]
                out.append((np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])))
                waiting += 2 * len(a)
                if waiting > 1_000_000:
                    out, waiting = [self._top(out)], 0
        a, b, score = self._top(out)
        return self.ids[a], self.ids[b], score

    def _top(self, found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
        best = _best(a, b, score, self.ids, self.k)
        return a[best], b[best], score[best]


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.8, list_size: int = LIST_SIZE) -> DataFrame:
    """(model, dim, chunk_id, neighbour, cosine, rank): up to k neighbours of every vector with a cosine of at least ``least``.

    The index: unit vectors are put into up to SPILL of N / ``list_size`` lists, the
    nearest ones (k-means on a sample of at most SAMPLE vectors per model and dim; every
    vector is indexed). The vectors of a list are put into sub-lists of about
    SUBLIST_SIZE, each into its nearest one, and compared with the sub-lists that are
    their PROBES nearest: by sums of table entries of four-bit score-aware codes of the
    leading half of the dimensions, which leave out only what cannot reach ``least``, and
    then exactly. So the work for a vector does not grow with the table, but for the
    choice of its list and sub-list, up to MAX_LISTS lists of MAX_GROUP vectors. A list
    that the sample shows to be larger is compared in pairs of parts, so no group grows
    with the table. A task sends what it has for a list as one compressed block. Two
    vectors are found if they share a list and in it one has its place in a sub-list
    that the other is compared with; the README gives the measured recall.

    Of more than k + 1 exact copies of a vector, the k + 1 smallest ids are indexed and
    the others get these as neighbours, so that a list does not grow with copies. Ties
    go to the smaller id. Unusable vectors do not take part; a repeated row counts once.
    """
    rows = vectors.select("model", F.col("dim").cast("int").alias("dim"), F.col("chunk_id").cast("long").alias("chunk_id"), "vec")
    rows = rows.where("vec IS NOT NULL AND dim > 0 AND chunk_id IS NOT NULL")
    kinds = rows.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy("model", "dim").collect()
    samples = _sample(rows, kinds)
    index = {}
    for kind in kinds:
        x = samples[kind["model"], kind["dim"]]
        if len(x):
            centres = fit_lists(x, int(np.clip(kind["n"] // list_size, 1, MAX_LISTS)), 3)
            share = np.bincount(_lists_of(x, centres)[0], minlength=len(centres)) / len(x)
            parts = np.ceil(share * kind["n"] / (MAX_GROUP / 2)).astype(np.int64)
            index[kind["model"], kind["dim"]] = (centres, np.where(share * kind["n"] > MAX_GROUP, parts, 1), fit_quantiser(x[:8000], CODED))
    fitted = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column("model").to_pylist(), dtype=object)
            dims = np.asarray(batch.column("dim"))
            ids = np.asarray(batch.column("chunk_id"))
            for (model, dim), (centres, parts, quantiser) in fitted.value.items():
                at, x = _raw(batch.column("vec"), np.where(models == model, dims, -1), dim)
                if not len(at):
                    continue
                unit = _normal(x)
                lists, row = _lists_of(unit, centres)
                codes = quantiser.packed(quantiser.encode(quantiser.leading(unit)))
                keys = [np.stack([lists, np.zeros_like(lists), np.zeros_like(lists), row], axis=1)]
                if (parts[lists] > 1).any():
                    keys[0] = keys[0][parts[lists] == 1]
                    own = (ids[at[row]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts[lists]
                    for other in range(int(parts[lists].max())):
                        some = (parts[lists] > other) & (parts[lists] > 1) & (own != other)
                        pair = np.stack([own, np.full_like(own, other)], axis=1)[some]
                        keys.append(np.stack([lists[some], pair.min(1), pair.max(1), row[some]], axis=1))
                table = np.concatenate(keys)
                table = table[np.lexsort((table[:, 3], table[:, 2], table[:, 1], table[:, 0]))]
                edges = np.flatnonzero(np.append(True, (np.diff(table[:, :3], axis=0) != 0).any(1)))
                groups = np.split(table[:, 3], edges[1:])
                n = len(groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([model] * n, pa.string()), pa.array(np.full(n, dim, np.int32)),
                        *[pa.array(table[edges, c].astype(np.int32)) for c in range(3)],
                        pa.array([ids[at[g]].tobytes() for g in groups], pa.binary()), pa.array([codes[g].tobytes() for g in groups], pa.binary()),
                        pa.array([_packed_vectors(x[g]) for g in groups], pa.binary()),
                    ],
                    ["model", "dim", "list", "one", "two", "ids", "codes", "block"],
                )

    def search(table: pa.Table) -> pa.Table:
        model, dim = (table.column(c)[0].as_py() for c in ("model", "dim"))
        quantiser = fitted.value[model, dim][2]
        ids = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in table.column("ids").to_pylist()])
        packed = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(-1, (len(quantiser.books) + 1) // 2) for b in table.column("codes").to_pylist()])
        x = np.concatenate([_unpacked_vectors(b, dim) for b in table.column("block").to_pylist()])
        ids, where = np.unique(ids, return_index=True)
        codes = np.stack([packed[where] >> 4, packed[where] & 15], axis=2).reshape(len(ids), -1)[:, : len(quantiser.books)]
        a, b, score = Group(ids, _normal(x[where]), codes, quantiser, k, least).pairs()
        return pa.table({"model": pa.array([model] * len(a), pa.string()), "dim": pa.array(np.full(len(a), dim, np.int32)), "chunk_id": a, "neighbour": b, "cosine": score.astype(np.float64)})

    # counts of equal vectors, repeated rows included: where none is large, nothing has to be looked at more closely
    hashed = rows.select("model", "dim", "chunk_id", "vec", F.xxhash64("vec", "model").alias("h"))
    crowded = stage(hashed.groupBy("model", "dim", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("dim", "h"))
    kept, rest = rows, None
    if not crowded.isEmpty():
        copies = usable(hashed.join(crowded, ["dim", "h"], "left_semi")).select("model", "dim", "chunk_id", F.xxhash64("vec", "model").alias("h")).distinct()
        place = F.row_number().over(Window.partitionBy("model", "dim", "h").orderBy("chunk_id"))
        # only the first of each task are sorted together
        first = stage(copies.withColumn("r", place).where(F.col("r") <= k + 1))
        more = stage(copies.join(first.select("chunk_id", "h"), ["chunk_id", "h"], "left_anti"))
        kept = rows.join(more.select("dim", "chunk_id", F.col("model").alias("m")), [rows["dim"] == more["dim"], rows["chunk_id"] == more["chunk_id"], rows["model"].eqNullSafe(F.col("m"))], "left_anti")
        head = first.where(F.col("r") <= k).select("dim", "h", F.col("chunk_id").alias("neighbour"))
        rest = more.join(head, ["dim", "h"]).select("model", "dim", "chunk_id", "neighbour", F.lit(1.0).alias("cosine"))
    listed = kept.mapInArrow(assign, "model string, dim int, list int, one int, two int, ids binary, codes binary, block binary")
    # as many partitions as the vectors' bytes ask for, so that no task's input grows with the table
    size = sum(4 * SPILL * kind["n"] * (kind["dim"] or 0) for kind in kinds)
    most = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    listed = listed.repartition(most, "model", "dim", "list", "one", "two")
    found = listed.groupBy("model", "dim", "list", "one", "two").applyInArrow(search, "model string, dim int, chunk_id bigint, neighbour bigint, cosine double")
    if rest is not None:
        found = found.union(rest)
    once = found.groupBy("model", "dim", "chunk_id", "neighbour").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("model", "dim", "chunk_id").orderBy(F.desc("cosine"), "neighbour")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _lists_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, row) of up to SPILL lists of every unit vector: the nearest, and others not BEHIND it by more."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    a = min(SPILL, len(centres))
    for at in range(0, len(x), 4096):
        score = x[at : at + 4096] @ centres.T
        top = np.argpartition(-score, a - 1, axis=1)[:, :a] if a < len(centres) else np.tile(np.arange(a), (len(score), 1))
        own = np.take_along_axis(score, top, axis=1)
        row, place = np.nonzero(own >= own.max(axis=1, keepdims=True) - BEHIND)
        out.append((top[row, place], row + at))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(vectors: DataFrame, every: int = 100, k: int = 5) -> DataFrame:
    """(model, dim, chunk_id, neighbour, cosine, rank): k nearest of all vectors for ids divisible by ``every``.

    The queries are taken in blocks of KNN_BLOCK rows per model and dim; each block is
    broadcast (its size is bounded by that number) and scanned against all rows with
    four-bit codes, RERANK candidates of each task's batch are scored exactly, and the
    best k of all batches stay.
    """
    rows = usable(vectors)
    kinds = rows.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy("model", "dim").collect()
    samples = _sample(rows, kinds)
    context = rows.sparkSession.sparkContext
    parts = []
    for kind in kinds:
        model, dim = kind["model"], kind["dim"]
        own = rows.where(F.col("model").eqNullSafe(F.lit(model)) & (F.col("dim") == dim))
        asked = own.where(F.col("chunk_id") % every == 0)
        n = asked.select("chunk_id").distinct().count()
        if not n or not len(samples[model, dim]):
            continue
        quantiser = fit_quantiser(samples[model, dim][:8000])
        blocks = -(-n // KNN_BLOCK)
        for b in range(blocks):
            mine = asked.where(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == b)
            table = mine.select("chunk_id", "vec").dropDuplicates(["chunk_id"]).toArrow().combine_chunks()
            if not table.num_rows:
                continue
            at, q = _unit(table.column("vec").combine_chunks(), np.full(table.num_rows, dim), dim)
            shared = context.broadcast((np.asarray(table.column("chunk_id"))[at], q, quantiser))

            def scan(batches: Iterable[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
                q_ids, q, quantiser = shared.value
                for batch in batches:
                    at, x = _unit(batch.column("vec"), np.full(len(batch), dim), dim)
                    if not len(at):
                        continue
                    ids, where = np.unique(np.asarray(batch.column("chunk_id"))[at], return_index=True)
                    x = x[where]
                    packed = quantiser.packed(quantiser.encode(quantiser.leading(x)))
                    for start in range(0, len(q), QUERY_BLOCK):
                        block, names = q[start : start + QUERY_BLOCK], q_ids[start : start + QUERY_BLOCK]
                        entries, step, low = quantiser.tables(quantiser.leading(block))
                        approx = quantiser.scan(packed, entries) * step + low
                        r = min(RERANK + 1, len(x))
                        top = np.argpartition(-approx, r - 1, axis=0)[:r] if r < len(x) else np.tile(np.arange(r)[:, None], (1, len(block)))
                        cand, who = top.T.ravel(), np.repeat(np.arange(len(block)), r)
                        other = ids[cand] != names[who]
                        cand, who = cand[other], who[other]
                        score = np.einsum("ij,ij->i", block[who], x[cand])
                        best = _best(who, cand, score, ids, k)
                        yield pa.RecordBatch.from_pydict(
                            {"chunk_id": names[who[best]], "neighbour": ids[cand[best]], "cosine": score[best].astype(np.float64)}
                        )

            found = own.select("chunk_id", "vec").mapInArrow(scan, "chunk_id bigint, neighbour bigint, cosine double")
            parts.append(found.select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "*"))
    if not parts:
        return rows.select("model", "dim", "chunk_id", F.col("chunk_id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).where("false")
    every_part = parts[0]
    for p in parts[1:]:
        every_part = every_part.union(p)
    once = every_part.groupBy("model", "dim", "chunk_id", "neighbour").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("model", "dim", "chunk_id").orderBy(F.desc("cosine"), "neighbour")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
