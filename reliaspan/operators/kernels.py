"""Small NumPy bodies that run inside Spark tasks on Arrow batches.

Each one sees a batch of rows that Spark partitioned, and returns rows; none holds state between
batches, so a batch boundary never changes a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NORM_CHANNEL = 2**31 - 1  # virtual channel: squared row norm


PART_PAIRS = 1024  # sums of products in one partial row
EMITTED_PAIRS = 1 << 18  # pair rows handed over at once


def _runs(batch: pa.RecordBatch, keys: list[str], *more: np.ndarray) -> np.ndarray:
    """Start offsets of maximal runs of equal keys (and equal values of ``more``), plus the end."""
    n = batch.num_rows
    change = np.zeros(max(0, n - 1), bool)
    for values in more:
        change |= values[1:] != values[:-1]
    for k in keys:
        col = batch.column(k)
        after, before = col.slice(1), col.slice(0, n - 1)
        change |= pc.coalesce(pc.not_equal(after, before), pc.xor(after.is_null(), before.is_null())).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def _row_sets(chan: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each row that changes where its channels differ from those of the row before."""
    if len(lengths) and (lengths == lengths[0]).all():
        ids = chan.reshape(len(lengths), -1)
        differs = (ids[1:] != ids[:-1]).any(axis=1)
    else:
        rows = np.split(chan, np.cumsum(lengths)[:-1])
        differs = [not np.array_equal(a, b) for a, b in zip(rows[:-1], rows[1:])]
    return np.concatenate([[0], np.cumsum(differs)])


def _lists(values: np.ndarray, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def gram_kernel(keys: list[str], norm: bool, weighted: bool):
    """Partial sums of products of every channel pair i <= j, packed: one set per run of equal keys.

    A row holds the run's channels, weight, sums, and PART_PAIRS at most of its sums of products in triangle
    order. Partial rows add up, so runs may be cut anywhere; ``pair_kernel`` sums them afterwards.
    """

    def emit(batch, starts, parts):
        cols = [batch.column(k).take(pa.array(starts)) for k in keys]
        part, ids, total, sums, gram = zip(*parts)
        cols += [
            pa.array(part, pa.int32()), _lists(np.concatenate(ids), [len(v) for v in ids]), pa.array(total, pa.float64()),
            _lists(np.concatenate(sums), [len(v) for v in sums]), _lists(np.concatenate(gram), [len(v) for v in gram]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "part", "ids", "n", "sums", "gram"])

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xcol, ccol = batch.column("x"), batch.column("channels")
            lengths = xcol.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            flat = xcol.flatten().to_numpy(zero_copy_only=False)
            chan = ccol.flatten().to_numpy(zero_copy_only=False)
            w = batch.column("w").to_numpy(zero_copy_only=False) if weighted else None
            bounds = _runs(batch, keys, _row_sets(chan, lengths))
            starts, parts, size = [], [], 0
            for s, e in zip(bounds[:-1], bounds[1:]):
                p = int(lengths[s])
                x = flat[ends[s]:ends[e]].reshape(e - s, p)
                ids = chan[ends[s]:ends[s + 1]].astype(np.int32)
                if norm:
                    x = np.column_stack([x, (x * x).sum(axis=1)])
                    ids = np.append(ids, np.int32(NORM_CHANNEL))
                wx = x if w is None else x * w[s:e, None]
                total = float(e - s) if w is None else float(w[s:e].sum())
                gram, sums = (wx.T @ x)[np.triu_indices(len(ids))], wx.sum(axis=0)
                for k in range(-(-len(gram) // PART_PAIRS)):
                    starts.append(s)
                    parts.append((k, ids, total, sums, gram[k * PART_PAIRS:(k + 1) * PART_PAIRS]))
                size += len(gram)
                if size > EMITTED_PAIRS:
                    yield emit(batch, starts, parts)
                    starts, parts, size = [], [], 0
            if parts:
                yield emit(batch, starts, parts)

    return run


def shrinkage_terms(i: np.ndarray, j: np.ndarray, n: np.ndarray, si: np.ndarray, sj: np.ndarray, sij: np.ndarray) -> list[np.ndarray]:
    """For each row of sums over channel pairs the terms that give its shrinkage weight."""
    real, diag = j < NORM_CHANNEL, i == j
    mi, mj = si / n, sj / n
    c = sij / n - mi * mj
    pair = np.where(diag, 1.0, 2.0)
    return [
        np.full(len(c), float((real & diag).sum())),
        (c * (real & diag)).sum(axis=1),
        (pair * real * c * c).sum(axis=1),
        (c * n * (~real & diag)).sum(axis=1),
        (mi * c * n * (~real & ~diag)).sum(axis=1),
        (pair * real * mi * mj * c * n).sum(axis=1),
    ]


TERMS = ("p", "tr", "d2", "uu", "mu_u", "mcm")
SUMS = ("n", "si", "sj", "sii", "sjj", "sij")


def pair_kernel(keys: list[str], terms: bool, cumulate: bool):
    """Partial rows of ``gram_kernel``, sorted by keys -> one row per channel pair of every key, with the key's shrinkage
    terms beside them if asked for. With ``cumulate`` the last key counts upwards from 0, and its sums are running
    ones; negative values stand for themselves.

    A task holds the sums of one key (with ``cumulate`` of the keys that differ in the last one only) from one
    batch to the next.
    """
    group = keys[:-1] if cumulate else keys
    names = [*keys, "i", "j", *SUMS, *(f"_{t}" for t in TERMS if terms)]

    def slots(batch):
        """Per row of a batch: key, part, channels."""
        out = []
        at = _runs(batch, keys)
        ids = batch.column("ids").to_pylist()
        part = batch.column("part").to_pylist()
        for k, (s, e) in enumerate(zip(at[:-1], at[1:])):
            out += [(k, part[r], tuple(ids[r])) for r in range(s, e)]
        return out

    def plain(batch):
        """Channels of all rows if these are the same and none is cut into parts, else None."""
        lengths = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
        if lengths.min() != lengths.max() or pc.max(batch.column("part")).as_py():
            return None
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        width = batch.column("gram").value_lengths().to_numpy(zero_copy_only=False)
        p = ids.shape[1]
        return ids[0] if (ids == ids[0]).all() and (width == p * (p + 1) // 2).all() else None

    def table(batch, name):
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def beside(kept, data):
        """Rows with new sums, in the schema that batches come with: the next batch is put behind them."""
        columns = [*(kept.column(c) for c in (*keys, "part", "ids")), *data]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kept.schema, strict=True)], schema=kept.schema)

    def fold(batch):
        """The rows of equal key, part and channels added up."""
        if plain(batch) is not None:
            first = _runs(batch, keys)[:-1]
            if len(first) == batch.num_rows:
                return batch
            n = np.add.reduceat(batch.column("n").to_numpy(zero_copy_only=False), first)
            sums, gram = (np.add.reduceat(table(batch, c), first, axis=0) for c in ("sums", "gram"))
            kept = batch.take(pa.array(first))
            data = [pa.array(n), _lists(sums.ravel(), [sums.shape[1]] * len(n)), _lists(gram.ravel(), [gram.shape[1]] * len(n))]
            return beside(kept, data)
        held: dict[tuple, list] = {}
        n, sums, gram = (batch.column(c) for c in ("n", "sums", "gram"))
        for r, slot in enumerate(slots(batch)):
            values = [n[r].as_py(), *(v[r].values.to_numpy(zero_copy_only=False) for v in (sums, gram))]
            if slot in held:
                held[slot][1] = [x + y for x, y in zip(held[slot][1], values)]
            else:
                held[slot] = [r, values]
        rows, values = zip(*held.values())
        kept = batch.take(pa.array(rows))
        n, sums, gram = zip(*values)
        data = [pa.array(n, pa.float64()), *(_lists(np.concatenate(v), [len(x) for x in v]) for v in (sums, gram))]
        return beside(kept, data)

    def emit(batch, rows, i, j, values):
        """``values`` are (rows, pairs) arrays of SUMS."""
        count = len(i)
        taken = pa.array(np.repeat(rows, count))
        cols = [batch.column(k).take(taken) for k in keys] + [pa.array(np.tile(c, len(rows)), pa.int32()) for c in (i, j)]
        cols += [pa.array(np.broadcast_to(v, (len(rows), count)).ravel()) for v in values]
        if terms:
            n, si, sj, _, _, sij = values
            cols += [pa.array(np.repeat(t, count)) for t in shrinkage_terms(i, j, n, si, sj, sij)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def running(batch, values):
        """Arrays of a row for each key, added up along the last key inside its group."""
        step = batch.column(keys[-1]).to_numpy(zero_copy_only=False)
        bounds = _runs(batch, group)
        place = np.arange(batch.num_rows) - np.repeat(bounds[:-1], np.diff(bounds))
        for k in range(1, place.max(initial=0) + 1):
            at = np.flatnonzero(place == k)
            at = at[step[at - 1] >= 0]
            for v in values:
                v[at] += v[at - 1]

    def even(batch, ids):
        n, sums, gram = batch.column("n").to_numpy(zero_copy_only=False)[:, None].copy(), table(batch, "sums").copy(), table(batch, "gram").copy()
        if cumulate:
            running(batch, (n, sums, gram))
        a, b = np.triu_indices(len(ids))
        square = gram[:, a == b]
        step = max(1, EMITTED_PAIRS // len(a))
        for s in range(0, batch.num_rows, step):
            at = slice(s, s + step)
            yield emit(batch, np.arange(batch.num_rows)[at], ids[a], ids[b], [n[at], sums[at][:, a], sums[at][:, b], square[at][:, a], square[at][:, b], gram[at]])

    def uneven(batch):
        """Keys whose rows have other channels, or parts: a key's pairs are put together first."""
        found = slots(batch)
        step = batch.column(keys[-1]).to_pylist() if cumulate else None
        bounds = np.searchsorted([k for k, _, _ in found], np.arange(found[-1][0] + 2))
        fresh = set(_runs(batch, group)[:-1].tolist())
        before: dict[tuple[int, int], np.ndarray] = {}
        for s, e in zip(bounds[:-1], bounds[1:]):
            sets: dict[tuple, dict[int, int]] = {}
            for r in range(s, e):
                sets.setdefault(found[r][2], {})[found[r][1]] = r
            pairs: dict[tuple[int, int], np.ndarray] = {}
            for ids, parts in sets.items():
                gram = np.concatenate([batch.column("gram")[parts[k]].values.to_numpy(zero_copy_only=False) for k in sorted(parts)])
                sums = batch.column("sums")[parts[0]].values.to_numpy(zero_copy_only=False)
                a, b = np.triu_indices(len(ids))
                square = gram[a == b]
                n = batch.column("n")[parts[0]].as_py()
                for x, y, v in zip(a, b, np.column_stack([np.full(len(a), n), sums[a], sums[b], square[a], square[b], gram])):
                    at = (ids[x], ids[y])
                    pairs[at] = pairs[at] + v if at in pairs else v
            if cumulate:
                if s in fresh or step[s] < 0 or step[s - 1] < 0:
                    before = {}
                for at, v in before.items():
                    pairs[at] = pairs[at] + v if at in pairs else v
                before = pairs
            order = sorted(pairs)
            i, j = np.array(order, np.int32).T
            yield emit(batch, np.array([s]), i, j, list(np.array([pairs[at] for at in order]).T[:, None, :]))

    def expand(batch):
        ids = plain(batch)
        if ids is not None and len(_runs(batch, keys)) == batch.num_rows + 1:
            yield from even(batch, ids)
        else:
            yield from uneven(batch)

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch = fold(batch if held is None else pa.concat_batches([held, batch]))
            last = int(_runs(batch, group)[-2])
            held = batch.slice(last)
            if last:
                yield from expand(batch.take(pa.array(np.arange(last))))
        if held is not None:
            yield from expand(held.take(pa.array(np.arange(held.num_rows))))

    return run


def segment_fc(x: np.ndarray, kind: str = "ledoit_wolf", fisher: bool = False) -> np.ndarray:
    """Upper-triangle connectivity of bounded segments (pearson, ledoit_wolf or partial).

    ``x`` is (..., rows, channels); leading axes are independent segments handled in one sweep.
    """
    n, p = x.shape[-2:]
    a, b = np.triu_indices(p, 1)
    if n < 3:
        return np.zeros((*x.shape[:-2], len(a)))
    size = (x * x).mean(axis=-2, keepdims=True)
    x = x - x.mean(axis=-2, keepdims=True)
    # The rounding residue of a constant channel is not variation.
    x = np.where((x * x).mean(axis=-2, keepdims=True) <= 1e-12 * size, 0.0, x)
    cov = np.swapaxes(x, -1, -2) @ x / n
    if kind != "pearson":
        d = np.arange(p)
        mu = cov[..., d, d].mean(axis=-1)
        total = (cov * cov).sum(axis=(-1, -2))
        fourth = ((x * x).sum(axis=-1) ** 2).sum(axis=-1)
        beta = (fourth / n - total) / (p * n)
        delta = total / p - mu * mu
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where((beta <= 0) | (delta <= 0), 0.0, np.minimum(beta, delta) / delta)
        cov = (1 - s)[..., None, None] * cov
        cov[..., d, d] += (s * mu)[..., None]
    r = (partial_corr(cov) if kind == "partial" else _scale(cov))[..., a, b]
    if kind == "ledoit_wolf":
        r = np.nan_to_num(r, nan=0.0)
    return np.arctanh(np.clip(r, -0.9999, 0.9999)) if fisher else r


def _scale(m: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diagonal(m, axis1=-2, axis2=-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(m / (d[..., :, None] * d[..., None, :]), -1, 1)


def partial_corr(cov: np.ndarray, pseudo: bool = False) -> np.ndarray:
    """Negated, scaled inverse of a covariance (or correlation) matrix."""
    theta = np.linalg.pinv(cov) if pseudo else np.linalg.inv(cov)
    d = np.sqrt(np.abs(np.diagonal(theta, axis1=-2, axis2=-1)))
    d = np.where(d == 0, 1e-10, d)
    return -theta / (d[..., :, None] * d[..., None, :])


#: Values whose variance is not above this count as constant.
LEAST_VARIANCE = 1e-14


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation along the last axis; NaN where either side is constant."""
    a, b = a - a.mean(axis=-1, keepdims=True), b - b.mean(axis=-1, keepdims=True)
    va, vb = (a * a).mean(axis=-1), (b * b).mean(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((va > LEAST_VARIANCE) & (vb > LEAST_VARIANCE), (a * b).mean(axis=-1) / np.sqrt(va * vb), np.nan)


REPLICATE_CELLS = 1 << 22  # covariance cells held at once, whatever the number of replicates


def _alike(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """The rows of a batch by equal values of some columns."""
    rows: dict[tuple, list[int]] = {}
    for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
        rows.setdefault(key, []).append(r)
    return [np.array(v) for v in rows.values()]


def _stacked(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> np.ndarray:
    """List values of equal length as one array, a row each."""
    return batch.column(name).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def ar1_kernel(batches):
    """Recordings with n_rows and ar1 beside them: the mean over channels of the correlation of neighbouring rows, 0 if no channel varies."""
    for batch in batches:
        p = batch.column("p").to_numpy(zero_copy_only=False)
        size = batch.column("rec").value_lengths().to_numpy(zero_copy_only=False)
        n, ar1 = size // np.maximum(p, 1), np.zeros(batch.num_rows)
        for width, length in set(zip(p.tolist(), n.tolist())):
            if length < 2:
                continue
            every = np.flatnonzero((p == width) & (n == length))
            for at in np.array_split(every, -(-len(every) * width * length // REPLICATE_CELLS)):
                x = _stacked(batch, "rec", at).reshape(len(at), length, width)
                a, b = x[:, :-1], x[:, 1:]
                a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
                va, vb = (a * a).mean(axis=1), (b * b).mean(axis=1)
                usable = (va > 1e-10) & (vb > 1e-10)
                r = np.where(usable, (a * b).mean(axis=1) / np.sqrt(np.where(usable, va * vb, 1.0)), 0.0)
                ar1[at] = r.sum(axis=1) / np.maximum(usable.sum(axis=1), 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int32)), pa.array(ar1)], names=[*batch.schema.names, "n_rows", "ar1"])


def replicate_kernel(keys: list[str], fisher: bool):
    """Per bootstrap replicate of one bounded short recording: similarity to the reference vector
    and similarity between its two halves, in the connectivity kind the row asks for. Rows of one shape are handled
    in one sweep. Everything downstream is column arithmetic in Spark."""

    def run(batches):
        for batch in batches:
            sizes = [(c, pc.list_value_length(batch.column(c))) for c in ("rec", "ref", "starts")]
            shapes = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("p", "kind", "block_len", "n_blocks")), *(v for _, v in sizes)], names=["p", "kind", "block_len", "n_blocks", *(c for c, _ in sizes)])
            src, rep, r_obs, r_split = [], [], [], []
            for alike in _alike(shapes, shapes.schema.names):
                width, kind, length, n_blocks = (batch.column(c)[int(alike[0])].as_py() for c in ("p", "kind", "block_len", "n_blocks"))
                half_kind = "pearson" if kind == "pearson" else "ledoit_wolf"
                replicates = len(batch.column("starts")[int(alike[0])]) // n_blocks
                cells = replicates * max(width * width, width * length * n_blocks)
                for at in np.array_split(alike, -(-len(alike) * cells // REPLICATE_CELLS)):
                    if not len(at):
                        continue
                    x = _stacked(batch, "rec", at).reshape(len(at), -1, width)
                    ref = _stacked(batch, "ref", at)
                    starts = _stacked(batch, "starts", at).reshape(len(at), replicates, n_blocks)
                    index = (starts[..., None] + np.arange(length)).reshape(len(at), replicates, -1)
                    half = index.shape[2] // 2
                    step = max(1, REPLICATE_CELLS // (width * max(width, index.shape[2])))
                    for first in range(0, replicates, step):  # one row's replicates may be more than are held at once
                        xb = x[np.arange(len(at))[:, None, None], index[:, first:first + step]]
                        whole = segment_fc(xb, kind, fisher)
                        halves = segment_fc(xb[:, :, :half], half_kind), segment_fc(xb[:, :, half:], half_kind)
                        count = xb.shape[1]
                        src.append(np.repeat(at, count))
                        rep.append(np.tile(np.arange(first, first + count, dtype=np.int32), len(at)))
                        r_obs.append(_corr(whole, ref[:, None, :]).ravel())
                        r_split.append(_corr(*halves).ravel())
            if src:
                taken = pa.array(np.concatenate(src))
                cols = [batch.column(k).take(taken) for k in keys]
                data = [pa.array(np.concatenate(v)) for v in (rep, r_obs, r_split)]
                yield pa.RecordBatch.from_arrays(cols + data, names=keys + ["b", "r_obs", "r_split"])

    return run


def replicate_edge_kernel(keys: list[str], kind: str, fisher: bool):
    """Connectivity of every bootstrap replicate of one bounded short recording, a row per replicate and channel pair."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("channels")[row].values.to_numpy(zero_copy_only=False)
                x = batch.column("rec")[row].values.to_numpy(zero_copy_only=False).reshape(-1, len(ids))
                starts = batch.column("starts")[row].values.to_numpy(zero_copy_only=False)
                starts = starts.reshape(-1, batch.column("n_blocks")[row].as_py())
                index = (starts[:, :, None] + np.arange(batch.column("block_len")[row].as_py())).reshape(len(starts), -1)
                step = max(1, REPLICATE_CELLS // len(ids) ** 2)
                a, b = np.triu_indices(len(ids), 1)
                for first in range(0, len(index), step):
                    r = segment_fc(x[index[first:first + step]], kind, fisher)
                    taken = pa.array(np.full(r.size, row))
                    data = [np.repeat(np.arange(first, first + len(r)), len(a)), np.tile(ids[a], len(r)), np.tile(ids[b], len(r))]
                    cols = [batch.column(k).take(taken) for k in keys] + [pa.array(v.astype(np.int32)) for v in data]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(r.ravel(), from_pandas=True)], names=[*keys, "b", "i", "j", "r"])

    return run


def unpack_symmetric(packed: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    a, b = np.triu_indices(p)
    m[a, b] = packed
    m[b, a] = packed
    return m


def matrix_kernel(keys: list[str], fn, diagonal: bool, argument: str | None = None):
    """Apply ``fn`` to the small symmetric matrix packed in each row and return its upper triangle."""

    def run(batches):
        for batch in batches:
            rows, ii, jj, rr = [], [], [], []
            for row in range(batch.num_rows):
                ids = batch.column("channels")[row].values.to_numpy(zero_copy_only=False)
                packed = batch.column("packed")[row].values.to_numpy(zero_copy_only=False)
                given = () if argument is None else (batch.column(argument)[row].as_py(),)
                out = fn(unpack_symmetric(packed, len(ids)), *given)
                a, b = np.triu_indices(len(ids), 0 if diagonal else 1)
                rows.append(np.full(len(a), row))
                ii.append(ids[a])
                jj.append(ids[b])
                rr.append(out[a, b])
            if rows:
                taken = pa.array(np.concatenate(rows))
                cols = [batch.column(k).take(taken) for k in keys]
                data = [
                    pa.array(np.concatenate(ii).astype(np.int32)),
                    pa.array(np.concatenate(jj).astype(np.int32)),
                    pa.array(np.concatenate(rr), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols + data, names=keys + ["i", "j", "r"])

    return run


def scalar_kernel(keys: list[str], fn, name: str):
    """Apply ``fn`` (matrix -> number) to the small symmetric matrix packed in each row."""

    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                p = len(batch.column("channels")[row])
                packed = batch.column("packed")[row].values.to_numpy(zero_copy_only=False)
                out.append(float(fn(unpack_symmetric(packed, p))))
            cols = [batch.column(k) for k in keys] + [pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=keys + [name])

    return run


def solve_kernel(keys: list[str]):
    """Solve the small packed normal equations of each row (minimum-norm when rank deficient)."""

    def run(batches):
        for batch in batches:
            betas = []
            for row in range(batch.num_rows):
                xty = batch.column("xty")[row].values.to_numpy(zero_copy_only=False)
                xtx = batch.column("xtx")[row].values.to_numpy(zero_copy_only=False)
                betas.append(np.linalg.pinv(unpack_symmetric(xtx, len(xty)), hermitian=True) @ xty)
            cols = [batch.column(k) for k in keys] + [pa.array([b.tolist() for b in betas], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=keys + ["beta"])

    return run


def labels_kernel(keys: list[str], fn):
    """Apply ``fn`` (matrix -> integer labels) to the small symmetric matrix packed in each row."""

    def run(batches):
        for batch in batches:
            rows, nodes, labels = [], [], []
            for row in range(batch.num_rows):
                ids = batch.column("channels")[row].values.to_numpy(zero_copy_only=False)
                packed = batch.column("packed")[row].values.to_numpy(zero_copy_only=False)
                rows.append(np.full(len(ids), row))
                nodes.append(ids)
                labels.append(fn(unpack_symmetric(packed, len(ids))))
            if rows:
                taken = pa.array(np.concatenate(rows))
                cols = [batch.column(k).take(taken) for k in keys]
                data = [pa.array(np.concatenate(v).astype(np.int32)) for v in (nodes, labels)]
                yield pa.RecordBatch.from_arrays(cols + data, names=keys + ["node", "community"])

    return run


def spectral_labels(corr: np.ndarray, k: int) -> np.ndarray:
    """Normalised-Laplacian embedding of the (r + 1)/2 affinity and a deterministic k-means on it."""
    a = np.clip((corr + 1) / 2, 0, 1)
    np.fill_diagonal(a, 0)
    d = np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    _, vecs = np.linalg.eigh(np.eye(len(a)) - a / np.outer(d, d))
    x = vecs[:, :k] / d[:, None]
    centres = [x[0]]  # farthest-point start
    while len(centres) < k:
        centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(1) for c in centres], axis=0))])
    centres = np.array(centres)
    while True:
        labels = np.argmin(((x[:, None] - centres[None]) ** 2).sum(-1), axis=1)
        new = np.array([x[labels == c].mean(0) if np.any(labels == c) else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return labels


def _hops(adj: np.ndarray) -> np.ndarray:
    """Least steps between all nodes of a small 0/1 matrix, -1 where there is no path."""
    far = np.where(np.eye(len(adj), dtype=bool), 0, -1)
    frontier, k = far == 0, 0
    while frontier.any():
        k += 1
        frontier = (frontier.astype(np.float32) @ adj > 0) & (far < 0)
        far[frontier] = k
    return far


def _part(adj: np.ndarray) -> np.ndarray:
    """The nodes of the largest component, that of the smallest node among equals."""
    first = (_hops(adj) >= 0).argmax(axis=1)
    return first == np.bincount(first).argmax()


def _clustering_and_path(adj: np.ndarray) -> tuple[float, float]:
    """Mean clustering coefficient and path length of a connected network."""
    k, s = adj.sum(axis=1), len(adj)
    local = ((adj @ adj) * adj).sum(axis=1) / np.maximum(k * (k - 1), 1)
    return sum(local.tolist()) / s, float(_hops(adj).sum() / (s * (s - 1))) if s > 1 else 0.0


def small_world(i: np.ndarray, j: np.ndarray, kept: np.ndarray, u: np.ndarray) -> tuple:
    """(n_nodes, clustering, path_length, sigma) of one network of listed pairs; ``u`` are their uniform numbers."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]

    def matrix(taken):
        m = np.zeros((len(nodes), len(nodes)), np.float32)
        m[a[taken], b[taken]] = m[b[taken], a[taken]] = 1
        return m

    real = matrix(kept)
    main = _part(real)
    n = int(main.sum())
    if n < 3:
        return n, None, None, None
    inside = main[a] & main[b]
    drawn = matrix(inside & (u < 2 * (kept & inside).sum() / (n * (n - 1))))[np.ix_(main, main)]
    part = _part(drawn)
    (c, l), (c0, l0) = _clustering_and_path(real[np.ix_(main, main)].astype(float)), _clustering_and_path(drawn[np.ix_(part, part)].astype(float))
    c_ratio, l_ratio = c / c0 if c0 > 0 else 1.0, l / l0 if l0 > 0 else 1.0
    return n, c, l, c_ratio / l_ratio if l_ratio else None


def small_world_kernel(keys: list[str]):
    """Rows with a small network each, its pairs as lists i, j, kept and u -> its small-world measures."""

    def run(batches):
        for b in batches:
            columns = [b.column(c) for c in ("i", "j", "kept", "u")]
            found = [small_world(*(c[r].values.to_numpy(zero_copy_only=False) for c in columns)) for r in range(b.num_rows)]
            out = [pa.array(v, t) for v, t in zip(zip(*found), (pa.int32(), pa.float64(), pa.float64(), pa.float64()))] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *out], [*keys, "n_nodes", "clustering", "path_length", "sigma"])

    return run
