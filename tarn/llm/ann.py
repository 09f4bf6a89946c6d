"""Maximum-inner-product search: score-aware product quantisation, four-bit table scans, exact reranking.

Index: vectors are cut into subspaces of two dimensions, each coded by one of 16 centroids; what that leaves of a
vector is coded the same way again, LEVELS times in all, which tells vectors apart that lie close together. First codebooks and codes
minimise the anisotropic loss |r|^2 + (eta - 1) (u.r)^2 of a vector's residual r, u its direction: error along
the vector changes large inner products most, so it costs eta times as much. Codebooks are fitted on the driver
to FIT vectors at most, those with the smallest id hashes; every vector is coded.

Search: distinct query vectors and codes meet in blocks (QUERY_BLOCK by CODE_BLOCK), so no task holds more than
one of each. A code is sent once for each block of queries and a query once for each block of codes; blocks are as large as a task's
memory comfortably holds (some 10 MB each at 64 components), which keeps these copies few. A scan adds up table entries (two four-bit codes share a table of 256). A code comes with a bound of what it leaves
of its vector, so a score has an error bound; every vector whose score plus bound reaches the block's TOP + 1st best lower
bound is ranked by the exact inner product, however many they are. No neighbour is lost, and a block passes on TOP + 1.

Equal vectors are one entry. Only the TOP + 1 smallest ids of an entry can reach a result (larger ones lose the
tie, one may be the query's own), so that many are kept for the answer, cut before the shuffle; this loses nothing.

Defined results: null ids take no part. Vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another length than the most common one (the longest, if lengths tie). Of rows with
one id the smallest vector counts. Ties go to the smaller id. Fewer candidates than TOP are all returned. An empty
table gives an empty table; extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from tarn.llm.work import written
from tarn.session import ship

TOP = 20
FIT = 16_384
CODE_BLOCK, QUERY_BLOCK = 16_384, 8_192
WIDTH, CENTROIDS, LEVELS = 2, 16, 3
#: Cosine above which scores matter; eta follows from it and the dimension.
THRESHOLD = 0.2


class Quantiser:
    def __init__(self, books: np.ndarray, dim: int, eta: float):
        self.books, self.dim, self.eta = books, dim, eta  # books: subspace, centroid, WIDTH

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, seed: int = 0, aware: bool = True) -> "Quantiser":
        n, dim = x.shape
        parts = _parts(x)
        m = parts.shape[1]
        rnd, eta = np.random.default_rng(seed), max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)) if aware else 1.0
        books = np.stack([parts[rnd.integers(0, n, CENTROIDS), j] for j in range(m)]).astype(np.float32)
        q = cls(books, dim, 1.0)
        for step in range(2 * rounds):
            q.eta = 1.0 if step < rounds else eta  # plain rounds first: a good start for the coupled loss
            codes = q.codes(x)
            q._update(parts, codes, _direction(x))
        return q

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Centroid of each subspace: nearest ones, then coordinate descent on the anisotropic loss."""
        parts, u = _parts(x), _direction(x)
        n, m, _ = parts.shape
        out = np.empty((n, m), np.uint8)
        along = np.zeros(n, np.float32)
        for j in range(m):
            d = ((parts[:, j, None, :] - self.books[j]) ** 2).sum(-1)
            out[:, j] = d.argmin(1)
            along += (u[:, j] * (parts[:, j] - self.books[j][out[:, j]])).sum(-1)
        if self.eta > 1:
            for _ in range(sweeps):
                for j in range(m):
                    r = parts[:, j, None, :] - self.books[j]
                    own = np.einsum("nd,nkd->nk", u[:, j], r)
                    rest = along - own[np.arange(n), out[:, j]]
                    out[:, j] = ((r**2).sum(-1) + (self.eta - 1) * (rest[:, None] + own) ** 2).argmin(1)
                    along = rest + own[np.arange(n), out[:, j]]
        return out

    def _update(self, parts: np.ndarray, codes: np.ndarray, u: np.ndarray) -> None:
        """Each subspace's centroids at the minimum of the loss, codes and other subspaces fixed."""
        n, m, w = parts.shape
        r = parts - np.stack([self.books[j][codes[:, j]] for j in range(m)], axis=1)
        along = (u * r).sum((1, 2))
        for j in range(m):
            own = (u[:, j] * r[:, j]).sum(-1)
            a, b = np.zeros((CENTROIDS, w, w)), np.zeros((CENTROIDS, w))
            outer = np.eye(w) + (self.eta - 1) * u[:, j, :, None] * u[:, j, None, :]
            want = parts[:, j] + (self.eta - 1) * u[:, j] * (along - own + (u[:, j] * parts[:, j]).sum(-1))[:, None]
            np.add.at(a, codes[:, j], outer)
            np.add.at(b, codes[:, j], want)
            used = np.bincount(codes[:, j], minlength=CENTROIDS) > 0
            self.books[j][used] = np.linalg.solve(a[used] + 1e-6 * np.eye(w), b[used][..., None])[..., 0]
            r[:, j] = parts[:, j] - self.books[j][codes[:, j]]
            along += (u[:, j] * r[:, j]).sum(-1) - own

    def left(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes leave of the vectors."""
        return x - np.concatenate([self.books[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)[:, : x.shape[1]]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Scores of each byte of packed codes: two subspaces share a table of 256."""
        t = np.einsum("md,mkd->mk", _parts(query[None])[0], self.books).astype(np.float32)
        return (t[0::2, :, None] + t[1::2, None, :]).reshape(len(t) // 2, 256)


class Levels:
    """A score-aware quantiser, and plain ones for what those before leave."""

    def __init__(self, levels: list[Quantiser]):
        self.levels = levels

    @classmethod
    def fit(cls, x: np.ndarray, levels: int = LEVELS) -> "Levels":
        out = []
        for k in range(levels):
            out.append(Quantiser.fit(x, aware=not k))
            x = out[-1].left(x, out[-1].codes(x))
        return cls(out)

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes, and for each vector a bound of the score's error for a query of length one."""
        out, size, terms = [], np.zeros(len(x)), 0
        for q in self.levels:
            codes = q.codes(x)
            out.append(_pack(codes))
            rest = q.left(x, codes)
            size += np.linalg.norm(x, axis=1) + np.linalg.norm(rest, axis=1)  # no less than the length of what is coded
            terms += codes.shape[1]
            x = rest
        rounding = (terms + 8) * 2.0**-22  # of single-precision tables and sums
        return np.concatenate(out, axis=1), np.linalg.norm(x, axis=1) * (1 + 1e-9) + rounding * size

    def tables(self, query: np.ndarray) -> np.ndarray:
        return np.concatenate([q.tables(query) for q in self.levels])


def _parts(x: np.ndarray) -> np.ndarray:
    """n, subspaces (even in number), WIDTH; zeros fill the last ones."""
    n, dim = x.shape
    m = -(-dim // (2 * WIDTH)) * 2
    return np.pad(x.astype(np.float32), ((0, 0), (0, m * WIDTH - dim))).reshape(n, m, WIDTH)


def _direction(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return _parts(x / np.where(norm > 0, norm, 1))


def _pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): one valid vector of the common length for each id."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    ok = ok.where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    sizes = ok.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 1
    return ok.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components."""
    out = np.zeros(len(x))
    for j, w in enumerate(query):
        out += x[:, j].astype(np.float64) * w
    return out


def _scan(q: Levels, top: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "rep": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = right.column("rep").to_numpy()
            order = np.argsort(ids)  # a stable sort then gives ties to the smaller id
            ids, error = ids[order], right.column("error").to_numpy()[order]
            packed = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T.copy()
            exact = right.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
            for query, v in zip(left.column("query").to_pylist(), _vectors(left.column("v").combine_chunks()), strict=True):
                near = np.arange(len(ids))
                if len(ids) > top:
                    table = q.tables(v)
                    score = table[0][packed[0]]
                    for t, codes in zip(table[1:], packed[1:], strict=True):
                        score += t[codes]
                    bound = error * np.linalg.norm(v)
                    low = score - bound
                    cut = np.partition(low, len(low) - top)[len(low) - top]
                    near = np.flatnonzero(~(score + bound < cut))  # what overflows stays
                product = _products(exact[near], v)
                best = np.argsort(-product, kind="stable")[:top]
                out["query"] += [query] * len(best)
                out["rep"] += ids[near[best]].tolist()
                out["score"] += product[best].tolist()
        return pa.Table.from_pydict(out, pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())]))

    return run


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for ids where is_query(column) holds, against all rows but the query's own."""
    ship(vectors.sparkSession)
    rows = written(usable(vectors, key, vector), "vectors")
    by_vector = Window.partitionBy("v").orderBy("id")
    first = rows.groupBy("v").agg(F.min("id").alias("rep"))
    least = rows.withColumn("k", F.row_number().over(by_vector)).where(F.col("k") <= top + 1)
    reps = written(first.select("rep", "v"), "entries")
    members = written(least.join(first, "v").select("rep", "id"), "members")
    queries = written(rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "v").join(first, "v").select("query_id", F.col("rep").alias("query")), "queries")
    asked = reps.join(queries.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").withColumnRenamed("rep", "query")

    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(FIT).select("v").toArrow()
    if not sample.num_rows:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    q = Levels.fit(_vectors(sample.column("v").combine_chunks()))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed, error = q.packed(_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(error, pa.float64())], ["rep", "w", "code", "error"])

    n_codes, n_queries = reps.count(), asked.count()
    code_blocks, query_blocks = _blocks(n_codes, CODE_BLOCK), _blocks(n_queries, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    codes = written(reps.select("rep", F.col("v").alias("w")).mapInArrow(code, StructType([StructField("rep", LongType()), StructField("w", reps.schema["v"].dataType), StructField("code", BinaryType()), StructField("error", DoubleType())])), "codes")
    codes = codes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(code_blocks))).withColumn("group", every(query_blocks))
    sent = asked.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(query_blocks))).withColumn("block", every(code_blocks))
    found = sent.groupBy("group", "block").cogroup(codes.groupBy("group", "block")).applyInArrow(_scan(q, top + 1), "query long, rep long, score double")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = found.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= top + 1)
    items = near.join(members, "rep").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("k") <= top + 1)
    items = written(items.select("query", F.col("id").alias("vec_id"), "score"), "nearest")
    answers = queries.join(items, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return answers.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
