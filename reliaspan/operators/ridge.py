"""Leave-one-subject-out ridge from one edge vector to another, by block conjugate gradients on Spark.

With K the Gram matrix of the centred predictors, G = (K + alpha I)^-1 and Gc = alpha G - 1/n, the
prediction for a held-out subject s with an unpenalised intercept is y_s - (Gc y)_s / (Gc)_ss, so the
columns of G serve every fold. With fewer edges than subjects, alpha G = I - X (X^T X + alpha I)^-1 X^T gives the
same from the system of the edges, so the solved system is as large as the fewer of both.
The columns are solved for without forming K: the predictors are a table of
dense blocks (subjects x edges), a product with K is two block products by joins and grouped sums, and
all columns of G advance together, those of a block of subjects sharing their directions. Coefficients
are block x block and stay in the table, too; the driver sees residual norms only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliaspan.operators.connectivity import moment_corr
from reliaspan.session import materialise, spread

#: Subjects or edges of a block at most.
BLOCK = 256
#: Blocks that a task adds up at a time before it hands them on.
HELD = 48
#: Largest residual norm of a solved column; a right-hand side has norm 1.
TOLERANCE = 1e-11


def complete_edges(pairs: DataFrame, key: str = "subject_id") -> DataFrame:
    """The usable cells of the edges that every subject with a usable cell has."""
    usable = usable_cells(pairs)
    per_edge = usable.groupBy("i", "j").agg(F.count(F.lit(1)).alias("_n"))
    cohort = usable.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return usable.join(per_edge.join(cohort, "_n").select("i", "j"), ["i", "j"], "left_semi")


def usable_cells(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~F.isnan(F.col("short").cast("double")) & ~F.isnan(F.col("long").cast("double"))).filter("short IS NOT NULL AND long IS NOT NULL")


def completeness(pairs: DataFrame, key: str = "subject_id") -> DataFrame:
    """(i, j, n_usable, n_subjects, used) for each edge of pairs: what `held_out_ridge` leaves out, and why."""
    usable = usable_cells(pairs)
    n = usable.agg(F.count_distinct(key).alias("n_subjects"))
    counts = usable.groupBy("i", "j").agg(F.count(F.lit(1)).alias("_n"))
    rows = pairs.select("i", "j").distinct().join(counts, ["i", "j"], "left").select("i", "j", F.coalesce("_n", F.lit(0)).cast("long").alias("n_usable"))
    return rows.join(F.broadcast(n)).withColumn("used", (F.col("n_usable") > 0) & (F.col("n_usable") == F.col("n_subjects")))


def _numbered(rows: DataFrame, cols: list[str], n: int, block: int, block_name: str, place: str) -> DataFrame:
    """The distinct rows of `cols` with a block and a place in it, in the order of the columns."""
    ranges = max(1, n // (16 * block))
    ordered = rows.select(*cols).distinct().repartitionByRange(ranges, *cols).sortWithinPartitions(*cols)
    numbered = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return numbered.select(*cols, F.expr(f"_id div {block}").alias(block_name), F.expr(f"cast(_id % {block} AS int)").alias(place))


def _pack(cells: DataFrame, value: str, block: int) -> DataFrame:
    """(sb, eb, m): dense blocks, a row for each subject and a column for each edge, zeros elsewhere."""

    def dense(part: pa.Table) -> pa.Table:
        m = np.zeros((block, block))
        m[part.column("sp").to_numpy(), part.column("ep").to_numpy()] = part.column("v").to_numpy()
        return pa.table({"sb": part.column("sb").slice(0, 1), "eb": part.column("eb").slice(0, 1), "m": pa.array([m.tobytes()], pa.binary())})

    return cells.select("sb", "eb", "sp", "ep", F.col(value).alias("v")).groupBy("sb", "eb").applyInArrow(dense, "sb long, eb long, m binary")


def _summed(rows: DataFrame, keys: list[str], block: int, multiply, n_in: int, n_out: int) -> DataFrame:
    """For each key the sums of multiply(matrices of a row) -> matrices, added up in tasks before and after the shuffle.

    A task holds HELD keys at a time, so it needs no more memory where a key has very many rows.
    """
    inside, outside = [f"a{i}" for i in range(n_in)], [f"m{i}" for i in range(n_out)]
    schema = ", ".join([*(f"{k} long" for k in keys), *(f"{c} binary" for c in outside)])

    def add(names, change):
        def run(batches):
            held: dict[tuple, list[np.ndarray]] = {}

            def flush():
                rows = list(held.items())
                columns = [pa.array([k[i] for k, _ in rows], pa.int64()) for i in range(len(keys))]
                columns += [pa.array([v[i].tobytes() for _, v in rows], pa.binary()) for i in range(n_out)]
                held.clear()
                return pa.RecordBatch.from_arrays(columns, [*keys, *outside])

            for b in batches:
                for r in range(b.num_rows):
                    key = tuple(b.column(k)[r].as_py() for k in keys)
                    values = [b.column(c)[r].as_buffer() for c in names]
                    new = change([None if v is None else np.frombuffer(v).reshape(block, -1) for v in values])
                    if key in held:
                        for old, x in zip(held[key], new, strict=True):
                            old += x
                    else:
                        if len(held) >= HELD:
                            yield flush()
                        held[key] = [np.array(x) for x in new]
            yield flush()

        return run

    parts = rows.select(*keys, *inside).mapInArrow(add(inside, multiply), schema)
    whole = spread(parts, *keys).sortWithinPartitions(*keys)
    # equal keys follow each other now, so none is cut by a flush
    return whole.mapInArrow(add(outside, lambda m: m), schema)


def _changed(rows: DataFrame, keys: list[str], block: int, names: list[str], into: list[str], change) -> DataFrame:
    """rows with the matrices `into` = change(matrices `names`); NULL matrices are zero."""
    schema = ", ".join([*(f"{k} long" for k in keys), *(f"{c} binary" for c in into)])

    def run(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                values = [b.column(c)[r] for c in names]
                out.append(change([np.frombuffer(v.as_buffer()).reshape(block, -1) if v.is_valid else np.zeros((block, block)) for v in values]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array([o[i].tobytes() for o in out], pa.binary()) for i in range(len(into)))], [*keys, *into])

    return rows.select(*keys, *names).mapInArrow(run, schema)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least solution of a x = b for a symmetric semidefinite matrix; dependent directions get 0."""
    scale = np.sqrt(np.maximum(np.diag(a), 0.0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh((a + a.T) / 2 / np.outer(scale, scale))
    keep = values > 1e-13 * max(values[-1], 1e-300)
    v = vectors[:, keep] / scale[:, None]
    return v @ ((v.T @ b) / values[keep][:, None])


def _inverse_columns(x: DataFrame, subjects: DataFrame, alpha: float, block: int, rounds: int) -> DataFrame:
    """(rb, sb, z): the columns of (X X^T + alpha I)^-1 by blocks; rb the block of columns, sb that of rows.

    Breakdown-safe block conjugate gradients: directions that become dependent are left out of a
    step by the pseudo-inverse of their block x block system.
    """

    def identity(places: pa.Table) -> pa.Table:
        m = np.zeros((block, block))
        at = places.column("sp").to_numpy()
        m[at, at] = 1.0
        one = places.column("sb").slice(0, 1)
        return pa.table({"rb": one, "sb": one, "p": pa.array([m.tobytes()], pa.binary())})

    first = subjects.select("sb", "sp").groupBy("sb").applyInArrow(identity, "rb long, sb long, p binary")
    state = materialise(first.select("rb", "sb", "p", F.col("p").alias("r"), F.lit(None).cast("binary").alias("z")))
    x = x.select("sb", "eb", F.col("m").alias("a0"))
    best, waited = np.inf, 0
    for _ in range(rounds):
        half = _summed(x.join(state.select("rb", "sb", F.col("p").alias("a1")), "sb"), ["rb", "eb"], block, lambda m: [m[0].T @ m[1]], 2, 1)
        full = _summed(x.join(half.select("rb", "eb", F.col("m0").alias("a1")), "eb"), ["rb", "sb"], block, lambda m: [m[0] @ m[1]], 2, 1)
        joined = full.join(state, ["rb", "sb"], "left")
        keys = ["rb", "sb"]
        moved = materialise(_changed(joined, keys, block, ["m0", "p", "r", "z"], ["q", "p", "r", "z"], lambda m: [m[0] + alpha * m[1], *m[1:]]))
        grams = _summed(moved.select("rb", F.col("p").alias("a0"), F.col("q").alias("a1"), F.col("r").alias("a2")), ["rb"], block, lambda m: [m[0].T @ m[1], m[0].T @ m[2]], 3, 2)
        grams = materialise(grams.withColumnsRenamed({"m0": "pq", "m1": "pr"}))

        def step(m: list[np.ndarray]) -> list[np.ndarray]:
            pq, pr, p, q, r, z = m
            c = _solve(pq, pr)
            return [p, q, r - q @ c, z + p @ c]

        stepped = materialise(_changed(moved.join(grams, "rb"), keys, block, ["pq", "pr", "p", "q", "r", "z"], ["p", "q", "r", "z"], step))
        sums = _summed(stepped.select("rb", F.col("q").alias("a0"), F.col("r").alias("a1")), ["rb"], block, lambda m: [m[0].T @ m[1], (m[1] * m[1]).sum(0, keepdims=True).repeat(block, 0)], 2, 2)
        sums = materialise(_changed(sums, ["rb"], block, ["m0", "m1"], ["qr", "left"], lambda m: [m[0], np.sqrt(m[1][:1].max(keepdims=True))]))
        left = np.frombuffer(max(sums.select("left").toLocalIterator(), key=lambda row: np.frombuffer(row[0])[0])[0])[0]
        if left <= TOLERANCE:
            return stepped.select("rb", "sb", "z")
        best, waited = (left, 0) if left < 0.9 * best else (best, waited + 1)
        if waited >= 20 and best <= 1e3 * TOLERANCE:  # as exact as the numbers allow
            return stepped.select("rb", "sb", "z")
        turned = stepped.join(grams.select("rb", "pq"), "rb").join(sums.select("rb", "qr"), "rb")
        state = materialise(_changed(turned, keys, block, ["pq", "qr", "p", "r", "z"], ["p", "r", "z"], lambda m: [m[3] - m[2] @ _solve(m[0], m[1]), m[3], m[4]]))
    raise RuntimeError(f"the ridge system is not solved after {rounds} rounds; residual {left:.2g}")


def held_out_ridge(pairs: DataFrame, alpha: float = 1.0, key: str = "subject_id", block: int = BLOCK, rounds: int | None = None) -> DataFrame:
    """(key, i, j, predicted, actual) from (key, i, j, short, long).

    Any number of subjects and edges. The rounds needed are about the rank over `block`, one where all
    subjects or all edges fit a block. A cell is usable if both values are numbers. Only subjects with a usable
    cell take part, and only edges usable in all of them, as predictor and as target; other edges give no
    rows (`completeness` tells which and why), and so does an empty table. A cell may come once only. The
    prediction of a single subject is NULL. alpha has to be above 0.
    """
    if alpha <= 0:
        raise ValueError("alpha has to be above 0")
    cells = materialise(complete_edges(pairs, key).select(key, "i", "j", F.col("short").cast("double").alias("short"), F.col("long").cast("double").alias("long")))
    n, m = cells.select(key).distinct().count(), cells.select("i", "j").distinct().count()
    if n < 2:
        return cells.select(key, "i", "j", F.lit(None).cast("double").alias("predicted"), F.col("long").alias("actual"))
    few = min(n, m)
    block = -(-few // -(-few // block))  # blocks of even size, as few columns share few directions
    rounds = rounds or 60 + 6 * (few // block)
    subjects = _numbered(cells, [key], n, block, "sb", "sp")
    means = cells.groupBy("i", "j").agg(F.avg("short").alias("_x"), F.avg("long").alias("_y"))
    edges = _numbered(cells, ["i", "j"], m, block, "eb", "ep")
    placed = cells.join(subjects, key).join(edges.join(means, ["i", "j"]), ["i", "j"])
    placed = materialise(placed.select(key, "i", "j", "sb", "sp", "eb", "ep", (F.col("short") - F.col("_x")).alias("x"), (F.col("long") - F.col("_y")).alias("y"), "long"))
    x, y = materialise(_pack(placed, "x", block)), _pack(placed, "y", block)
    if m < n:
        shares = _shares_by_edges(x, y, edges, alpha, n, block, rounds)
    else:
        shares = _shares_by_subjects(x, y, subjects, alpha, n, block, rounds)
    out = placed.join(shares, ["sb", "eb", "sp", "ep"])
    return out.select(key, "i", "j", (F.col("long") - F.col("share")).alias("predicted"), F.col("long").alias("actual"))


def _shares_by_edges(x: DataFrame, y: DataFrame, edges: DataFrame, alpha: float, n: int, block: int, rounds: int) -> DataFrame:
    """(sb, eb, sp, ep, share): (Gc y)_s / (Gc)_ss from the system of the edges, as alpha G = I - X (X^T X + alpha I)^-1 X^T."""
    turned = _changed(x, ["sb", "eb"], block, ["m"], ["m"], lambda m: [m[0].T]).select(F.col("eb").alias("sb"), F.col("sb").alias("eb"), "m")
    places = edges.select(F.col("eb").alias("sb"), F.col("ep").alias("sp"))
    inverse = _inverse_columns(materialise(turned), places, alpha, block, rounds).select(F.col("sb").alias("eb"), F.col("rb").alias("fb"), F.col("z").alias("a1"))
    left = x.select("sb", "eb", F.col("m").alias("a0"))
    solved = materialise(_summed(left.join(inverse, "eb"), ["sb", "fb"], block, lambda m: [m[0] @ m[1]], 2, 1)).select("sb", F.col("fb").alias("eb"), F.col("m0").alias("a1"))
    own = _summed(left.join(solved, ["sb", "eb"]), ["sb"], block, lambda m: [(m[0] * m[1]).sum(1, keepdims=True)], 2, 1).withColumnRenamed("m0", "h")
    y = materialise(y).select("sb", F.col("eb").alias("fb"), F.col("m").alias("y"))
    cross = _summed(left.join(y.withColumnRenamed("y", "a1"), "sb"), ["eb", "fb"], block, lambda m: [m[0].T @ m[1]], 2, 1).withColumnRenamed("m0", "c")
    fitted = _summed(solved.withColumnRenamed("a1", "a0").join(cross.withColumnRenamed("c", "a1"), "eb"), ["sb", "fb"], block, lambda m: [m[0] @ m[1]], 2, 1)
    ready = fitted.join(y, ["sb", "fb"]).join(own, "sb")
    # y is centred, so the mean in Gc takes nothing from it
    moved = _changed(ready, ["sb", "fb"], block, ["m0", "y", "h"], ["s", "d"], lambda m: [m[1] - m[0], 1 - m[2][:, 0] - 1 / n])
    return _unpacked(moved.withColumnRenamed("fb", "eb").withColumnRenamed("s", "m0"), block)


def _shares_by_subjects(x: DataFrame, y: DataFrame, subjects: DataFrame, alpha: float, n: int, block: int, rounds: int) -> DataFrame:
    """(sb, eb, sp, ep, share): (Gc y)_s / (Gc)_ss from the system of the subjects."""
    inverse = _inverse_columns(x, subjects, alpha, block, rounds)

    def centred(m: list[np.ndarray]) -> list[np.ndarray]:
        return [alpha * m[0] - m[1][:, :1] / n * m[2][:, :1].T]

    def present(places: pa.Table) -> pa.Table:  # which places of a block are subjects
        v = np.zeros((block, 1))
        v[places.column("sp").to_numpy()] = 1.0
        return pa.table({"b": places.column("sb").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    there = materialise(subjects.select("sb", "sp").groupBy("sb").applyInArrow(present, "b long, v binary"))
    both = inverse.join(there.select(F.col("b").alias("sb"), F.col("v").alias("vs")), "sb").join(there.select(F.col("b").alias("rb"), F.col("v").alias("vr")), "rb")
    weights = materialise(_changed(both, ["rb", "sb"], block, ["z", "vs", "vr"], ["w"], centred))
    own = _changed(weights.filter("rb = sb"), ["sb"], block, ["w"], ["d"], lambda m: [np.diag(m[0]).copy()])
    moved = _summed(weights.select("rb", "sb", F.col("w").alias("a0")).join(y.select(F.col("sb").alias("rb"), "eb", F.col("m").alias("a1")), "rb"), ["sb", "eb"], block, lambda m: [m[0] @ m[1]], 2, 1)

    return _unpacked(moved.join(own, "sb"), block)


def _unpacked(rows: DataFrame, block: int) -> DataFrame:
    """A row for each cell from blocks (sb, eb, m0) and the divisors d of their rows; rows with divisor 0 have no subject."""

    def unpack(batches):
        for b in batches:
            for r in range(b.num_rows):
                d, s = np.frombuffer(b.column("d")[r].as_buffer()), np.frombuffer(b.column("m0")[r].as_buffer()).reshape(block, block)
                at = np.flatnonzero(d)
                share = s[at] / d[at][:, None]
                columns = [np.full(share.size, b.column(c)[r].as_py()) for c in ("sb", "eb")]
                columns += [np.repeat(at, block).astype(np.int32), np.tile(np.arange(block, dtype=np.int32), len(at)), share.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sb", "eb", "sp", "ep", "share"])

    return rows.select("sb", "eb", "m0", "d").mapInArrow(unpack, "sb long, eb long, sp int, ep int, share double")


def prediction_r2(predictions: DataFrame, key: str = "subject_id") -> DataFrame:
    """Squared correlation of predicted and actual edges per held-out subject."""
    r = moment_corr("predicted", "actual")
    return predictions.groupBy(key).agg((r * r).alias("r2"))
