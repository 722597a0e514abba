"""A grid of classifications: strata x repeats x feature kinds x models, as tables.

Every (stratum, repeat, kind, fold) is a split with a number. All splits advance together: a pass over
the rows adds up what their fits need (sums and products of features, never more than the square of the
feature dimension for a split), a small step per split solves, and a pass scores the rows. So neither a
cohort nor a cell is gathered in one task, and there are no driver jobs per cell.

Permuted label vectors are packed columns beside the observed labels. The discriminant's scatter matrix does
not depend on labels, so one factorisation of a split serves all its columns; what it scores for permuted
labels stays in the task that measures it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.functions.hashing import seeded_hash
from reliaspan.operators.cluster import contingency, counted_agreement, counted_flip_accuracy
from reliaspan.operators.evaluate import fold_covariates, gate_rows, reliability_weight, score_metrics
from reliaspan.operators.permutations import CELLS, HELD_BYTES, Codes, permuted_codes, permuted_counts
from reliaspan.operators.ranking import number_by_hash
from reliaspan.operators.sampling import balanced_downsample
from reliaspan.operators.stats import permutation_p
from reliaspan.operators.sums import add_up
from reliaspan.session import materialise

MODELS = ("discriminant", "logistic_l2")
CELL = ["stratum", "repeat", "kind", "model"]
SCORES = ("balanced_acc", "roc_auc", "auprc")
#: Bytes of fitted state that a pass has in each worker; more splits than fit are worked off in several passes.
STATE_BYTES = 64 << 20
#: Newton steps of the logistic fits, the step that counts as settled, ridge of the scatter matrix over its mean diagonal.
STEPS, SETTLED, SHRINK = 60, 1e-8, 1e-3


def members(subjects: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Adds `stratum`: one row for each named condition that a subject meets."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]))
    return subjects.withColumn("stratum", F.explode(names))


def assign(member: DataFrame, repeats: int = 1, seed: int = 42, scheme: str = "stratified_kfold", k: int = 5, balance: bool = False, key: str = "subject_id") -> DataFrame:
    """(stratum, repeat, member columns, own): the analysis subjects of each repeat with their own fold.

    balance keeps equally many of each class, drawn anew in each repeat. `stratified_kfold` deals each
    class into k folds by hash; with `loso` the site is the fold.
    """
    rows = member.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    if balance:
        rows = balanced_downsample(rows, F.concat_ws(":", F.lit(seed), "repeat"), "label", key, ["stratum", "repeat"])
    if scheme == "loso":
        return rows.withColumn("own", F.col("site").cast("string"))
    if scheme != "stratified_kfold":
        raise ValueError(f"unknown scheme {scheme!r}")
    order = seeded_hash(F.col(key), seed, F.col("repeat"), "fold")
    ranked = number_by_hash(rows, ["stratum", "repeat", "label"], order, [key])
    return ranked.withColumn("own", ((F.col("rn") - 1) % k).cast("string")).drop("rn")


def splits(assigned: DataFrame, gate: float | None = None, min_train: int = 1, min_test: int = 0, covariates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of every split: the rows with fold, is_train and cov; the report with counts and a reason to skip.

    gate keeps, on both sides, rows at or above that quantile of the training side's rho. A split is skipped with fewer
    than two classes in training, or fewer rows of a class than min_train or min_test.
    """
    by = ["stratum", "repeat", "fold"]
    folds = assigned.select("stratum", "repeat", F.col("own").alias("fold")).distinct()
    rows = assigned.join(folds, ["stratum", "repeat"]).withColumn("is_train", F.col("own") != F.col("fold"))
    sizes = rows.groupBy(*by).agg(F.count(F.when(~F.col("is_train"), 1)).alias("n_test_all"))
    if gate is not None:
        rows = gate_rows(rows, gate, by)
    side = lambda train, label: F.count(F.when((F.col("is_train") == train) & (F.col("label") == label), 1))
    counts = rows.groupBy(*by).agg(*[side(t, c).alias(f"{n}{c}") for n, t in (("train", True), ("test", False)) for c in (0, 1)])
    counts = sizes.join(counts, by, "left").na.fill(0)
    few = lambda side, least: F.least(f"{side}0", f"{side}1") < least
    reason = F.when(few("train", 1), "one class in training").when(few("train", min_train), "few training rows of a class").when(few("test", min_test), "few test rows of a class")
    report = counts.withColumn("skipped", reason)
    kept = rows.join(report.filter("skipped IS NULL").select(*by), by, "left_semi")
    if covariates:
        kept = fold_covariates(kept, by)
        kept = kept.withColumn("cov", F.concat(F.array("age_z", "sex_m"), "site_onehot")).drop("age_z", "sex_m", "site_onehot")
    else:
        kept = kept.withColumn("cov", F.array().cast("array<double>"))
    return kept, report


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _in_passes(state: DataFrame, size: int):
    """Dictionaries {split: matrices} of the state's rows, each within STATE_BYTES (or one split), by ranges of split numbers."""
    sizes = state.agg(F.count(F.lit(1)), F.max("split")).first()
    if not sizes[0]:
        return
    passes = max(1, -(-sizes[0] * size // STATE_BYTES))
    for p in range(passes):
        part = state.filter(F.pmod("split", F.lit(passes)) == p) if passes > 1 else state
        yield p, passes, {r["split"]: [np.frombuffer(v) for v in r[1:]] for r in part.collect()}


def _applied(rows: DataFrame, state: DataFrame, size: int, columns: Sequence[str], fn: Callable, out: str) -> DataFrame:
    """rows with the array column `out`: fn(state of the split, columns...) -> a row of numbers each; only splits with a state."""
    spark, done = rows.sparkSession, None
    keep = [f for f in rows.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"{out} array<double>"])
    names = rows.columns
    for p, passes, held in _in_passes(state, size):
        shared = spark.sparkContext.broadcast(held)

        def run(batches, shared=shared):
            for b in batches:
                which = b.column("split").to_numpy()
                for s in np.unique(which):
                    if int(s) in shared.value:
                        at = b.take(pa.array(np.flatnonzero(which == s)))
                        got = fn(shared.value[int(s)], *(at.column(c) for c in columns))
                        yield pa.RecordBatch.from_arrays([*at.columns, pa.array(list(got), pa.list_(pa.float64()))], [*names, out])

        part = rows.filter(F.pmod("split", F.lit(passes)) == p) if passes > 1 else rows
        part = part.mapInArrow(run, schema)
        done = part if done is None else done.unionByName(part)
    return done if done is not None else rows.withColumn(out, F.array().cast("array<double>")).limit(0)


def reduced(rows: DataFrame, variance: float = 0.9) -> DataFrame:
    """rows(split, is_train, vec, cov, ...) with z: vec standardised and projected by its split's training rows, then cov.

    The components with the given share of the variance are kept; with under four rows or columns, or
    variance 1, all are. Columns that are constant in training become 0.
    """
    rows = rows.withColumn("width", F.size("vec"))

    def part(_, vec):
        x = _matrix(vec)
        return [np.array([len(x)]), x.sum(0), x.T @ x]

    sums = materialise(add_up(rows.filter("is_train"), ["vec"], part, ["n", "total", "squares"]))

    def solve(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                n, total, squares = (np.frombuffer(b.column(c)[r].as_buffer()) for c in ("n", "total", "squares"))
                n, d = n[0], len(total)
                mean = total / n
                cov = squares.reshape(d, d) / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
                scale = np.where(sd > 1e-12 * (1 + np.abs(mean)), 1 / np.where(sd > 0, sd, 1.0), 0.0)
                turn = np.diag(scale)
                if variance < 1 and n >= 4 and d >= 4:
                    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
                    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
                    few = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), variance)) + 1
                    turn = turn @ vectors[:, : min(few, d)]
                out.append((mean, turn))
            yield pa.RecordBatch.from_arrays([b.column("split"), *(pa.array([o[i].tobytes() for o in out], pa.binary()) for i in (0, 1))], ["split", "mean", "turn"])

    fitted = materialise(sums.mapInArrow(solve, "split long, mean binary, turn binary"))
    size = fitted.agg(F.max(F.length("turn") + F.length("mean"))).first()[0] or 1

    def project(state, vec, cov):
        mean, turn = state
        z = (_matrix(vec) - mean) @ turn.reshape(len(mean), -1)
        return np.hstack([z, _matrix(cov)]) if len(cov.flatten()) else z

    return materialise(_applied(rows, fitted, size, ["vec", "cov"], project, "z").drop("vec", "cov", "width"))


def discriminant(rows: DataFrame, codes: Codes | None = None) -> tuple[DataFrame, DataFrame]:
    """(test rows with `scores`, one number of the observed labels; the fits of all label columns, observed first).

    The direction is (S + shrink)^-1 (mean of class 1 - mean of class 0) with the weighted total scatter S
    of a split's training rows, the cut half-way between the means. A label column with one class in training scores NaN.
    """

    def part(_, z, label, w, permuted):
        x, w, own = _matrix(z), w.to_numpy()[:, None], label.to_numpy().astype(float)[:, None]
        out = [w.sum(keepdims=True), (w * x).sum(0), (w * x).T @ x, 0.0, 0.0]
        step = max(1, CELLS // (1 + codes.n_perm if codes else 1))
        for s in (slice(i, i + step) for i in range(0, len(x), step)):
            y = np.hstack([own[s], _classes(codes, permuted[s])]) if codes else own[s]
            out[3] = out[3] + (w[s] * y).sum(0)
            out[4] = out[4] + (w[s] * x[s]).T @ y
        return out

    sums = materialise(add_up(rows.filter("is_train"), ["z", "label", "w", "permuted"], part, ["n", "total", "squares", "ones", "moments"]))

    def solve(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                n, total, squares, ones, moments = (np.frombuffer(b.column(c)[r].as_buffer()) for c in ("n", "total", "squares", "ones", "moments"))
                p, n = len(total), n[0]
                s = squares.reshape(p, p) / n - np.outer(total / n, total / n)
                with np.errstate(invalid="ignore", divide="ignore"):
                    up = moments.reshape(p, -1) / ones
                    down = (total[:, None] - moments.reshape(p, -1)) / (n - ones)
                    bad = (ones <= 0) | (ones >= n * (1 - 1e-12))
                up, down = np.where(bad, np.nan, up), np.where(bad, np.nan, down)
                level = max(np.trace(s) / p, 1e-300)
                factor = np.linalg.cholesky(s + SHRINK * level * np.eye(p))
                w = np.linalg.solve(factor.T, np.linalg.solve(factor, up - down))
                c = -(w * (up + down) / 2).sum(0)
                out.append((np.ascontiguousarray(w[:, 0]), c[:1], w, c))
            yield pa.RecordBatch.from_arrays([b.column("split"), *(pa.array([o[i].tobytes() for o in out], pa.binary()) for i in range(4))], ["split", "w0", "c0", "w", "c"])

    fitted = materialise(sums.mapInArrow(solve, "split long, w0 binary, c0 binary, w binary, c binary"))
    own = fitted.select("split", "w0", "c0")
    size = own.agg(F.max(F.length("w0") + F.length("c0"))).first()[0] or 1
    return _applied(rows.filter("NOT is_train"), own, size, ["z"], lambda m, z: (_matrix(z) @ m[0] + m[1])[:, None], "scores"), fitted


def _classes(codes: Codes, permuted: pa.Array, first: int = 0, last: int | None = None) -> np.ndarray:
    return np.array(codes.classes, float)[codes.unpack(permuted, first, last)]


def _curve(score: np.ndarray, label: np.ndarray) -> tuple:
    """The numbers of `score_metrics` for one run, None each with a single class."""
    p, q = int((label == 1).sum()), int((label == 0).sum())
    if not p or not q:
        return None, None, None
    right = ((score[label == 1] > 0).sum() / p + (score[label == 0] <= 0).sum() / q) / 2
    order = np.argsort(-score)
    starts = np.flatnonzero(np.diff(score[order], prepend=np.nan) != 0)
    pos, neg = (np.add.reduceat((label[order] == c).astype(float), starts) for c in (1, 0))
    tp, fp = np.cumsum(pos), np.cumsum(neg)
    return right, (pos * (q - fp + 0.5 * neg)).sum() / (p * q), (pos * tp / (tp + fp)).sum() / p


def permuted_metrics(tests: DataFrame, fitted: DataFrame, numbered: DataFrame, codes: Codes) -> DataFrame:
    """(stratum, repeat, kind, perm, balanced_acc, roc_auc, auprc) of every permuted label column over the test rows of a cell.

    The test rows of a cell are stored in blocks; a task takes a chunk of permutations with their fits, reads the blocks of a
    cell where they lie, and scores, sorts and measures. A task holds HELD_BYTES of scores or those of one permutation,
    and scores are never rows.
    """
    places = materialise(numbered.select("stratum", "repeat", "kind").distinct().withColumn("cell", F.monotonically_increasing_id()))
    rows = tests.select("split", "z", "permuted").join(numbered, "split").join(places, ["stratum", "repeat", "kind"]).select("cell", "split", "z", "permuted")

    def pack(batches):
        for b in batches:
            which = b.column(1).to_numpy()
            for s in np.unique(which):
                at = b.take(pa.array(np.flatnonzero(which == s)))
                bits = at.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays([at.column(0)[:1], at.column(1)[:1], pa.array([_matrix(at.column(2)).tobytes()], pa.binary()), pa.array([bits], pa.list_(pa.binary()))], ["cell", "split", "z", "bits"])

    cells = max(1, places.count())
    blocks = materialise(rows.repartitionByRange(cells, "cell").sortWithinPartitions("cell", "split").mapInArrow(pack, "cell long, split long, z binary, bits array<binary>"))
    most = blocks.groupBy("cell").agg(F.sum(F.size("bits")).alias("n")).agg(F.max("n")).first()[0] or 1
    cores = tests.sparkSession.sparkContext.defaultParallelism
    step = max(1, min(-(-codes.n_perm * cells // cores), codes.n_perm, HELD_BYTES // (16 * most)))

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = np.frombuffer(b.column(2)[i].as_buffer())
                w = np.frombuffer(b.column(1)[i].as_buffer()).reshape(-1, len(c))
                for k, at in enumerate(range(1, len(c), step)):
                    out = [pa.array([x.tobytes()], pa.binary()) for x in (w[:, at : at + step], c[at : at + step])]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), b.column(0)[i : i + 1], *out], ["chunk", "of", "w", "c"])

    chunks = -(-codes.n_perm // step)
    fits = fitted.select("split", "w", "c").mapInArrow(cut, "chunk int, of long, w binary, c binary").groupBy("chunk").agg(F.collect_list(F.struct("of", "w", "c")).alias("fits"))
    fits = materialise(fits.repartition(chunks, "chunk"))

    def measure(batches):
        chunk, state, held = None, {}, {}

        def flush():
            for cell, parts in held.items():
                scores, labels = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
                out = [_curve(s[~np.isnan(s)], y[~np.isnan(s)]) for s, y in zip(scores.T, labels.T, strict=True)]
                perms = np.arange(chunk * step, chunk * step + len(out))
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(out), pa.int64()), pa.array(perms, pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], ["cell", "perm", *SCORES])

        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != chunk:
                    yield from flush()
                    chunk, held = b.column(0)[i].as_py(), {}
                    state = {f["of"]: (np.frombuffer(f["w"]), np.frombuffer(f["c"])) for f in b.column(1)[i].as_py()}
                cell, split = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if split not in state:
                    continue
                w, c = state[split]
                bits = b.column(5)[i].values
                z = np.frombuffer(b.column(4)[i].as_buffer()).reshape(len(bits), -1)
                held.setdefault(cell, []).append((z @ w.reshape(-1, len(c)) + c, _classes(codes, bits, chunk * step, (chunk + 1) * step)))
        yield from flush()

    # a chunk meets the cells as they are stored: the size of the tables must not turn this into a broadcast
    met = fits.crossJoin(blocks.hint("shuffle_replicate_nl")).mapInArrow(measure, "cell long, perm int, " + ", ".join(f"{m} double" for m in SCORES))
    return materialise(met).join(places, "cell").drop("cell")


def logistic(rows: DataFrame) -> DataFrame:
    """Test rows with `scores` (one number): class-balanced logistic regression, penalty 1/2 |b|^2, intercept free.

    Newton steps of all splits together, each a grouped sum of gradients and Hessians, until no step
    exceeds SETTLED; a step longer than 4 is cut to 4, which keeps the first ones from overshooting.
    """
    train = rows.filter("is_train")
    sides = train.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1"))
    cw = F.when(F.col("label") == 1, F.col("n") / (2 * F.col("n1"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("n1"))))
    train = materialise(train.join(sides, "split").withColumn("cw", F.col("w") * cw).select("split", "z", "label", "cw"))
    state = materialise(train.groupBy("split").agg(F.max(F.size("z")).alias("p")).select("split", F.transform(F.sequence(F.lit(0), "p"), lambda _: F.lit(0.0)).alias("b")))
    size = 8 * (state.agg(F.max(F.size("b"))).first()[0] or 1)

    def binary(rows):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x, float).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["split", "b"])

        return rows.mapInArrow(run, "split long, b binary")

    state = binary(state)
    for _ in range(STEPS):
        held = {s: v[0] for _, _, part in _in_passes(state, size) for s, v in part.items()}
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def part(split, z, label, cw, shared=shared):
            x = np.hstack([_matrix(z), np.ones((len(z), 1))])
            mu = 1 / (1 + np.exp(-np.clip(x @ shared.value[split], -500, 500)))
            w = cw.to_numpy()
            return [x.T @ (w * (mu - label.to_numpy())), (x * (w * mu * (1 - mu))[:, None]).T @ x]

        sums = add_up(train, ["z", "label", "cw"], part, ["g", "h"])

        def move(batches, shared=shared):
            for b in batches:
                out, most = [], []
                for r in range(b.num_rows):
                    g, h = (np.frombuffer(b.column(c)[r].as_buffer()) for c in ("g", "h"))
                    old = shared.value[b.column("split")[r].as_py()]
                    penalty = np.append(np.ones(len(g) - 1), 0.0)
                    step = np.linalg.solve(h.reshape(len(g), -1) + np.diag(penalty + 1e-12), g + penalty * old)
                    length = float(np.abs(step).max())
                    out.append(old - step * min(1.0, 4.0 / max(length, 1e-300)))
                    most.append(length)
                yield pa.RecordBatch.from_arrays([b.column("split"), pa.array([o.tobytes() for o in out], pa.binary()), pa.array(most, pa.float64())], ["split", "b", "step"])

        moved = materialise(sums.mapInArrow(move, "split long, b binary, step double"))
        state = moved.select("split", "b")
        if (moved.agg(F.max("step")).first()[0] or 0.0) <= SETTLED:
            break
    else:
        raise RuntimeError(f"logistic fits have not settled after {STEPS} steps")
    return _applied(rows.filter("NOT is_train"), state, size, ["z"], lambda m, z: (_matrix(z) @ m[0][:-1] + m[0][-1])[:, None], "scores")


def run_grid(
    member: DataFrame, features: DataFrame, repeats: int = 1, seed: int = 42, scheme: str = "stratified_kfold", k: int = 5, balance: bool = False, gate: float | None = None, gamma: float = 0.0,
    covariates: bool = False, variance: float = 0.9, models: Sequence[str] = MODELS, n_perm: int = 0, min_train: int = 1, min_test: int = 0, key: str = "subject_id",
) -> tuple[DataFrame, DataFrame]:
    """(cells, report): one row for each stratum, repeat, kind and model; and the splits with their counts.

    `member` is (stratum, key, label 0/1, site, rho[, age, sex]), `features` (kind, key, vec), one length
    within a kind. Metrics are out of fold over all used splits and NULL without any. With n_perm, the discriminant
    has p values from permuted labels, within sites if the folds are sites. Subjects without features take no part.
    """
    assigned = materialise(assign(member, repeats, seed, scheme, k, balance, key))
    kept, report = splits(assigned, gate, min_train, min_test, covariates)
    report = materialise(report)
    numbered = materialise(features.select("kind").distinct().join(report.filter("skipped IS NULL").select("stratum", "repeat", "fold")).withColumn("split", F.monotonically_increasing_id()))
    weight = reliability_weight("rho", gamma) if gamma > 0 else F.lit(1.0)
    rows = kept.withColumn("w", weight).join(features, key).join(numbered, ["kind", "stratum", "repeat", "fold"])
    rows = rows.select("split", key, "is_train", F.col("label").cast("int").alias("label"), F.col("w").cast("double").alias("w"), F.col("vec").cast("array<double>").alias("vec"), "cov", "stratum", "repeat")
    z = reduced(materialise(rows), variance)
    if n_perm:
        within = ["stratum", "repeat", *(["site"] if scheme == "loso" else [])]
        packed, codes = permuted_codes(assigned.select(key, "label", *within), n_perm, seed, "label", key, within)
        z = z.join(packed.select("stratum", "repeat", key, "permuted").hint("merge"), ["stratum", "repeat", key])
    else:
        z, codes = z.withColumn("permuted", F.lit(None).cast("binary")), None
    z = materialise(z)
    found = fitted = None
    for name in models:
        if name == "discriminant":
            scored, fitted = discriminant(z, codes)
        else:
            scored = logistic(z.drop("permuted"))
        scored = scored.select("split", key, "label", F.lit(name).alias("model"), "scores")
        found = scored if found is None else found.unionByName(scored)
    found = materialise(found.join(numbered, "split"))
    score = F.col("scores")[0]
    observed = score_metrics(found.withColumn("score", score).withColumn("prediction", (score > 0).cast("int")), CELL)
    used = found.groupBy(*CELL).agg(F.count_distinct("split").alias("splits_used"), F.count(F.lit(1)).alias("n_eval"))
    dims = z.groupBy("split").agg(F.max(F.size("z")).alias("dim")).join(numbered, "split").groupBy("stratum", "repeat", "kind").agg(F.median("dim").alias("feature_dim"))
    sizes = assigned.groupBy("stratum", "repeat").agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("label").cast("long").alias("n_cases"), F.count_distinct("site").alias("n_sites"), F.avg("rho").alias("rho_mean"))
    totals = report.groupBy("stratum", "repeat").agg(F.count(F.lit(1)).alias("splits"), F.count("skipped").alias("splits_skipped"))
    grid = sizes.join(totals, ["stratum", "repeat"]).join(features.select("kind").distinct()).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    cells = grid.join(used, CELL, "left").join(observed.drop("n"), CELL, "left").join(dims, ["stratum", "repeat", "kind"], "left")
    cells = cells.na.fill(0, ["splits_used", "n_eval"]).withColumn("coverage", F.col("n_eval") / F.col("n_subjects"))
    if n_perm and "discriminant" in models:
        nulls = permuted_metrics(z.filter("NOT is_train"), fitted, numbered, codes).withColumn("model", F.lit("discriminant"))
        for m in SCORES:
            p = permutation_p(observed, nulls, m, CELL).select(*CELL, F.col("p").alias(f"{m}_p"))
            cells = cells.join(p, CELL, "left")
    return cells, report


def clustering_p(labels: DataFrame, n_perm: int, seed: int, within: Sequence[str] = (), truth: str = "label", cluster: str = "cluster", key: str = "subject_id") -> DataFrame:
    """(metric, observed, p) for ari, nmi and balanced_acc of a clustering against permuted truths, free or within sites.

    All permutations are scored from one contingency table keyed by permutation, counted from packed labels; nulls
    that are not finite are left out. No rows give no rows.
    """
    metrics = ("ari", "nmi", "balanced_acc")

    def long(cell: DataFrame, by: Sequence[str]) -> DataFrame:
        scored = counted_agreement(cell, truth, cluster, by).join(counted_flip_accuracy(cell, truth, cluster, by), list(by))
        return scored.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("e")).select(*by, "e.metric", "e.value")

    packed, codes = permuted_codes(labels, n_perm, seed, truth, key, within, [cluster])
    cell = materialise(permuted_counts(packed, codes, cluster, truth))
    nulls = long(cell.filter("perm > 0"), ["perm"])
    observed = long(contingency(labels.withColumn("one", F.lit(1)), truth, cluster, ["one"]), ["one"]).drop("one")
    return permutation_p(observed, nulls, "value", ["metric"])
