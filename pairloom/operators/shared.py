"""Pairs of nodes that share a key, scored by arrays: all of a group of keys at once, each pair at its best key.

A side is an Arrow table, a row for each key of a node: key, owners (sorted), the node's entries as lists
(ek key, es specificity, ep pos, eu unit, er roles as bits: 1 concept, 2 head, 4 head or tail) and its parts as lists (pp pos, ph head, pt tail, pn nouns).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Kinds of a shared key and directions, by number.
KINDS, WAYS = ("eurovoc", "head", "tail", "noun"), ("", "same", "a_narrower", "b_narrower")
#: Pairs that are scored at once.
PAIRS = 400_000


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list starts (one more at the end), and what the lists hold."""
    c = _column(t, name)
    starts = c.offsets.to_numpy()
    return starts - starts[0], c.flatten()


def _codes(*arrays: pa.Array, sort: bool = False) -> list[np.ndarray]:
    """One number for each value, the same in all arrays, -1 for null."""
    whole = pa.concat_arrays(arrays).to_pandas()
    codes = pd.factorize(whole, sort=sort)[0].astype(np.int64)
    return np.split(codes, np.cumsum([len(a) for a in arrays])[:-1])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1 and on, counts[k] of each, one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)


def _rows(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


class _Side:
    """One side's rows; `mine` are the entries of a row's own key, each with the parts at its place."""

    def __init__(self, t: pa.Table) -> None:
        self.owners_at, self.owners = _lists(t, "owners")
        self.at, _ = _lists(t, "ek")
        self.row = _rows(self.at)
        self.es = _lists(t, "es")[1].to_numpy(zero_copy_only=False)
        self.er = _lists(t, "er")[1].to_numpy(zero_copy_only=False)
        self.unit = _lists(t, "eu")[1]
        self.parts_at, self.heads = _lists(t, "ph")
        self.part_row = _rows(self.parts_at)
        nouns = _lists(t, "pn")[1]  # a list a part, or null
        self.nouns_at = np.r_[0, np.cumsum(nouns.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        self.nouns = nouns.flatten()

    def settle(self, key: np.ndarray, ek: np.ndarray, pos: np.ndarray, place: np.ndarray, unit: np.ndarray, noun: np.ndarray) -> None:
        self.key, self.ek, self.pos, self.unit_code = key, ek, pos, unit
        self.mine = np.flatnonzero(ek == key[self.row])
        self.mine_row = self.row[self.mine]
        self.mine_at = np.searchsorted(self.mine_row, np.arange(len(key) + 1))
        # The parts at an entry's place: part numbers by row and place.  A null place has none.
        width = max(int(pos.max(initial=0)), int(place.max(initial=0))) + 2
        code = self.part_row * width + place + 1
        order = np.argsort(code, kind="stable")
        order = order[place[order] >= 0]
        want = self.mine_row * width + pos[self.mine] + 1
        low = np.searchsorted(code[order], want)
        self.part_order, self.part_low = order, low
        self.part_n = np.where(pos[self.mine] >= 0, np.searchsorted(code[order], want, side="right") - low, 0)
        # Each part's different nouns.
        of = _rows(self.nouns_at)
        once = np.unique(of * (noun.max(initial=-1) + 2) + noun + 1) if len(noun) else np.zeros(0, np.int64)
        self.noun_part, self.noun_code = np.divmod(once, noun.max(initial=-1) + 2)
        self.noun_n = np.bincount(self.noun_part, minlength=len(place))

    def kinds_of_row(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of what a row's own entries are (places, roles, order of units), and for each number one row that is so."""
        seen: dict[bytes, int] = {}
        first, out = [], np.empty(len(self.key), np.int64)
        fields = np.stack([self.pos[self.mine], self.er[self.mine]], axis=1).astype(np.int64)
        again = np.zeros(len(self.mine), bool)  # places with several units: their order counts
        if len(self.mine) > 1:
            same = (self.mine_row[1:] == self.mine_row[:-1]) & (fields[1:, 0] == fields[:-1, 0])
            again[1:] |= same
            again[:-1] |= same
        fields = np.concatenate([fields, np.where(again, self.unit_code[self.mine], -1)[:, None]], axis=1)
        for k in range(len(out)):
            name = fields[self.mine_at[k] : self.mine_at[k + 1]].tobytes()
            if name not in seen:
                seen[name] = len(first)
                first.append(k)
            out[k] = seen[name]
        return out, np.array(first, np.int64)


def _kind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a & 1, 0, np.where(a & b & 2, 1, np.where(a & b & 4, 2, 3)))


def _own_best(a: _Side, b: _Side, fa: np.ndarray, fb: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each two kinds of rows the entries (their numbers in a row) and the kind of match that are best at the rows' own key."""
    order = np.unique(-weight, return_inverse=True)[1]
    na, nb = np.diff(a.mine_at)[fa], np.diff(b.mine_at)[fb]
    shape = (len(fa), len(fb))
    best, t_, u_, k_ = [np.full(shape, -1, np.int64) for _ in range(4)]
    places, units = 2 + max(a.pos.max(initial=0), b.pos.max(initial=0)), 2 + max(a.unit_code.max(initial=0), b.unit_code.max(initial=0))
    second = np.full(shape, -1, np.int64)
    for t in range(na.max(initial=0)):
        x = a.mine[np.minimum(a.mine_at[fa] + t, len(a.mine) - 1)]
        for u in range(nb.max(initial=0)):
            y = b.mine[np.minimum(b.mine_at[fb] + u, len(b.mine) - 1)]
            kind = _kind(a.er[x][:, None], b.er[y][None, :])
            one = (order[kind] * places + a.pos[x][:, None] + 1) * places + b.pos[y][None, :] + 1
            two = (a.unit_code[x][:, None] + 1) * units + b.unit_code[y][None, :] + 1
            better = (t < na)[:, None] & (u < nb)[None, :] & ((best < 0) | (one < best) | ((one == best) & (two < second)))
            best, second = np.where(better, one, best), np.where(better, two, second)
            t_, u_, k_ = np.where(better, t, t_), np.where(better, u, u_), np.where(better, kind, k_)
    return t_, u_, k_


def _joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in left and right of all equal values; right is sorted."""
    low = np.searchsorted(right, left)
    count = np.searchsorted(right, left, side="right") - low
    return np.repeat(np.arange(len(left)), count), _spread(low, count)


def best_matches(left: pa.Table, right: pa.Table, weights: dict[str, float], schema: pa.Schema) -> pa.Table:
    """owners_i, owners_j, unit_i, unit_j, key, kind, specificity, way: the pairs of rows of one key whose best shared key that is.

    Best is the greatest specificity times weight, then the first places, then the lesser key, then the lesser units.  Pairs of a left row
    with one result are one row.
    """
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    a, b = _Side(left), _Side(right)
    weight = np.array([weights[k] for k in KINDS])
    flat = lambda name: (_lists(left, name)[1], _lists(right, name)[1])
    keys = [_column(left, "key"), _column(right, "key"), *flat("ek")]
    ka, kb, ea, eb = _codes(*keys)
    names = pd.unique(pa.concat_arrays(keys).to_pandas())
    word = pd.factorize(np.array([k.split(":", 1)[1] for k in names], object), sort=True)[0] * 2 + np.array([not k.startswith("ev:") for k in names])
    pa_, pb_, qa, qb = _codes(*flat("ep"), *flat("pp"), sort=True)
    ua, ub = _codes(a.unit, b.unit, sort=True)
    ha, hb, ta, tb = _codes(a.heads, b.heads, *flat("pt"))
    na, nb = _codes(a.nouns, b.nouns)
    a.settle(ka, ea, pa_, qa, ua, na)
    b.settle(kb, eb, pb_, qb, ub, nb)
    low, high = _codes(a.owners.take(pa.array(a.owners_at[:-1])), b.owners.take(pa.array(b.owners_at[1:] - 1)), sort=True)
    kind_a, fa = a.kinds_of_row()
    kind_b, fb = b.kinds_of_row()
    best_t, best_u, best_k = _own_best(a, b, fa, fb, weight)
    order = np.argsort(kb, kind="stable")
    spot = np.empty(len(kb), np.int64)  # where a right row stands among those sorted
    spot[order] = np.arange(len(kb))
    starts = np.searchsorted(kb[order], ka)
    counts = np.searchsorted(kb[order], ka, side="right") - starts
    specific = a.es[a.mine[a.mine_at[:-1]]]
    wide = len(names)
    # Right entries of other keys, and right nouns, by the row's key and their own.
    other_b = np.flatnonzero(eb != kb[b.row])
    other_b = other_b[np.argsort(kb[b.row[other_b]] * wide + eb[other_b], kind="stable")]
    other_code = kb[b.row[other_b]] * wide + eb[other_b]
    nouns = 2 + max(na.max(initial=-1), nb.max(initial=-1))
    noun_b = np.argsort(kb[b.part_row[b.noun_part]] * nouns + b.noun_code, kind="stable")
    noun_code = (kb[b.part_row[b.noun_part]] * nouns + b.noun_code)[noun_b]
    out = []
    ends = np.cumsum(counts)
    first = 0
    while first < len(ka):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        took = np.arange(first, last)
        n, at = counts[took], np.r_[0, np.cumsum(counts[took])]
        ia = np.repeat(took, n)
        ib = order[_spread(starts[took], n)]
        t, u, k = (m[kind_a[ia], kind_b[ib]] for m in (best_t, best_u, best_k))
        la, lb = a.mine_at[ia] + t, b.mine_at[ib] + u
        keep = low[ia] < high[ib]
        index = lambda x, y: at[x - first] + spot[y] - starts[x]  # where the pair of two rows stands  # noqa: E731, B023
        # Another key that is better takes the pair.
        mine = np.arange(a.at[first], a.at[last])
        mine = mine[ea[mine] != ka[a.row[mine]]]
        x, y = _joined(ka[a.row[mine]] * wide + ea[mine], other_code)
        if len(x):
            x, y = mine[x], other_b[y]
            p = index(a.row[x], b.row[y])
            kind = _kind(a.er[x], b.er[y])
            ours = [-(specific[ia[p]] * weight[k[p]]), pa_[a.mine[la[p]]], pb_[b.mine[lb[p]]], word[ka[ia[p]]]]
            less = np.zeros(len(p), bool)
            tie = np.ones(len(p), bool)
            for theirs, own in zip([-(a.es[x] * weight[kind]), pa_[x], pb_[y], word[ea[x]]], ours):
                less |= tie & (theirs < own)
                tie &= theirs == own
            keep[p[less]] = False
        p = np.flatnonzero(keep)
        for r in range(int(a.part_n[la[p]].max(initial=0))):  # a place has one part, but for places given twice
            for s in range(int(b.part_n[lb[p]].max(initial=0))):
                w = p[(r < a.part_n[la[p]]) & (s < b.part_n[lb[p]])]
                x, y = a.part_order[a.part_low[la[w]] + r], b.part_order[b.part_low[lb[w]] + s]
                way = np.where((ta[x] == hb[y]) & (ta[x] >= 0), 2, np.where((tb[y] == ha[x]) & (tb[y] >= 0), 3, 0))
                alike = ha[x] == hb[y]
                if alike.any():
                    chosen_x, chosen_y = np.full(len(ia), -1), np.full(len(ia), -1)
                    chosen_x[w[alike]], chosen_y[w[alike]] = x[alike], y[alike]
                    mine = np.arange(np.searchsorted(a.noun_part, a.parts_at[first]), np.searchsorted(a.noun_part, a.parts_at[last]))
                    mine = mine[np.isin(a.noun_part[mine], x[alike])]
                    f, g = _joined(ka[a.part_row[a.noun_part[mine]]] * nouns + a.noun_code[mine], noun_code)
                    f, g = a.noun_part[mine[f]], b.noun_part[noun_b[g]]
                    q = index(a.part_row[f], b.part_row[g])
                    common = np.bincount(q[(chosen_x[q] == f) & (chosen_y[q] == g)], minlength=len(ia))[w]
                    sa, sb = a.noun_n[x], b.noun_n[y]
                    by_nouns = np.where((sa == sb) & (common == sa), 1, np.where((common == sb) & (sa > sb), 2, np.where((common == sa) & (sb > sa), 3, 0)))
                    way = np.where(alike, by_nouns, way)
                out += _grouped(a, b, la[w], lb[w], ib[w], k[w], way, specific, left, schema)
        first = last
    return pa.concat_tables(out) if out else schema.empty_table()


def _grouped(a: _Side, b: _Side, la: np.ndarray, lb: np.ndarray, ib: np.ndarray, kind: np.ndarray, way: np.ndarray, specific: np.ndarray, left: pa.Table, schema: pa.Schema) -> Iterator[pa.Table]:
    """Pairs of one left row with one result in a row."""
    if not len(la):
        return
    unit = b.unit_code[b.mine[lb]] + 1
    code = ((la * 4 + kind) * 4 + way) * (unit.max() + 1) + unit
    order = np.argsort(code, kind="stable")
    heads = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    one = order[heads]
    row = a.mine_row[la[one]]
    n = b.owners_at[ib[order] + 1] - b.owners_at[ib[order]]
    sizes = np.add.reduceat(n, heads)
    j = b.owners.take(pa.array(_spread(b.owners_at[ib[order]], n)))
    width = a.owners_at[row + 1] - a.owners_at[row]
    i = a.owners.take(pa.array(_spread(a.owners_at[row], width)))
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)
    made = [lists(i, width), lists(j, sizes), a.unit.take(pa.array(a.mine[la[one]])), b.unit.take(pa.array(b.mine[lb[one]])), _column(left, "key").take(pa.array(row)), pa.array(kind[one], pa.int32()), pa.array(specific[row], pa.float64()), pa.array(way[one], pa.int32())]
    yield pa.Table.from_arrays([m.cast(f.type) for m, f in zip(made, schema)], schema=schema)
