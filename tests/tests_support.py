"""Plain versions that tests compare with."""

import numpy as np

from reliaspan.operators.kernels import NORM_CHANNEL


def brute_moments(rows, cumulate):
    """{(subject, bin, i, j): n, si, sj, sii, sjj, sij} of (subject, bin, t, channels, x) rows, with the norm channel."""
    out = {}
    bins = {}
    for s, b, *_ in rows:
        bins.setdefault(s, set()).add(b)
    for s, b, _, ids, x in rows:
        values = dict(zip(ids, x)) | {NORM_CHANNEL: float(np.square(x).sum())}
        for into in [c for c in bins[s] if c == b or cumulate and 0 <= b <= c]:
            for i in values:
                for j in values:
                    if i <= j:
                        u, v = values[i], values[j]
                        key = (s, into, i, j)
                        out[key] = out.get(key, 0) + np.array([1, u, v, u * u, v * v, u * v])
    return out
