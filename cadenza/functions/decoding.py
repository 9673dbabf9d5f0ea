"""Roles of a text's units: the best labelling as a whole, and weights learned from labelled texts.

A unit has a kind, which says what roles it may take, and features with values.  A role's score is
its bias plus the weights of the unit's features, and a labelling adds the weights of neighbouring
roles.  All texts of an Arrow batch are decoded together: the units' scores are one sparse product,
and step i of the max-plus recursion handles the i-th unit of every text that has one.

Learning mixes parameters: in each epoch every shard runs the perceptron over its texts in a seeded
order, from the same weights, and the shards' results are averaged.  Only weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = -np.inf
#: A text's units, in order.
UNITS = "array<struct<kind: string, feats: map<string, double>>>"
DECODED = "array<struct<role: string, score: double, runner_up: string, margin: double>>"


@dataclass(frozen=True)
class Weights:
    """roles; allowed[kind] = roles; needs[role] = the feature without which it cannot be; and the weights."""

    roles: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]]
    needs: dict[str, str] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    emission: dict[tuple[str, str], float] = field(default_factory=dict)
    start: dict[str, float] = field(default_factory=dict)
    transition: dict[tuple[str, str], float] = field(default_factory=dict)

    def keys(self, features: list[str]) -> list[tuple]:
        """All parameters there are with these features, in a fixed order."""
        out = [("bias", r) for r in self.roles] + [("start", r) for r in self.roles]
        return out + [("step", a, b) for a in self.roles for b in self.roles] + [("emit", f, r) for f in features for r in self.roles]

    def vector(self, features: list[str]) -> np.ndarray:
        of = {"bias": self.bias, "start": self.start, "step": self.transition, "emit": self.emission}
        return np.array([of[k[0]].get(k[1] if len(k) == 2 else k[1:], 0.0) for k in self.keys(features)])

    def with_vector(self, features: list[str], vector: np.ndarray) -> Weights:
        parts: dict[str, dict] = {"bias": {}, "start": {}, "step": {}, "emit": {}}
        for k, v in zip(self.keys(features), vector.tolist()):
            if v:
                parts[k[0]][k[1] if len(k) == 2 else k[1:]] = v
        return replace(self, bias=parts["bias"], start=parts["start"], transition=parts["step"], emission=parts["emit"])


class Model:
    """Weights as arrays: b (roles), s (roles), t (roles, roles), e (features, roles)."""

    def __init__(self, weights: Weights, features: list[str], vector: np.ndarray | None = None):
        self.weights, self.features = weights, features
        self.n = n = len(weights.roles)
        self.vector = weights.vector(features) if vector is None else vector
        self.b, self.s = self.vector[:n], self.vector[n : 2 * n]
        self.t = self.vector[2 * n : 2 * n + n * n].reshape(n, n)
        self.e = self.vector[2 * n + n * n :].reshape(len(features), n)
        self.row = {f: i for i, f in enumerate(features)}
        place = {r: i for i, r in enumerate(weights.roles)}
        self.allowed = {kind: np.isin(np.arange(n), [place[r] for r in roles]) for kind, roles in weights.allowed.items()}
        self.needs = [(place[r], f) for r, f in weights.needs.items()]


class Texts:
    """The units of all texts of a batch, end to end: off (first unit of each text), sparse features, and allowed roles."""

    def __init__(self, model: Model, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.off = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        flat = column.flatten()
        kinds, feats = flat.field("kind").dictionary_encode(), flat.field("feats")
        may = np.array([model.allowed.get(k, np.zeros(model.n, bool)) for k in [*kinds.dictionary.to_pylist(), None]], bool).reshape(-1, model.n)
        self.may = may[pc.fill_null(kinds.indices, len(may) - 1).to_numpy(zero_copy_only=False).astype(np.int64)]
        # the entries of all units' maps, end to end
        entries = feats.offsets.to_numpy()
        n = np.where(feats.is_null().to_numpy(zero_copy_only=False), 0, np.diff(entries))
        at = np.arange(n.sum()) + np.repeat(entries[:-1] - (np.cumsum(n) - n), n)
        keys = feats.keys.dictionary_encode()
        names = keys.dictionary.to_pylist()
        value = pc.fill_null(feats.items, 0.0).to_numpy(zero_copy_only=False)[at]
        of, unit = keys.indices.to_numpy(zero_copy_only=False)[at].astype(np.int64), np.repeat(np.arange(len(n)), n)
        for r, needed in model.needs:
            lacks = np.ones(len(n), bool)
            if needed in names:
                lacks[unit[(of == names.index(needed)) & (value != 0)]] = False
            self.may[lacks, r] = False
        feature = np.array([model.row.get(f, -1) for f in names], np.int64)[of] if names else of
        used = (feature >= 0) & (value != 0)
        self.unit, self.feature, self.value = unit[used], feature[used], value[used]

    def scores(self, model: Model) -> np.ndarray:
        out = np.tile(model.b, (len(self.may), 1))
        np.add.at(out, self.unit, model.e[self.feature] * self.value[:, None])
        out[~self.may] = NEVER
        return out


class Present:
    """Units whose features are there or not: off (first unit of each text), has (units, features), and allowed roles."""

    def __init__(self, model: Model, off: np.ndarray, kinds: Sequence[str], kind: np.ndarray, features: Sequence[str], has: np.ndarray):
        self.off = off
        self.may = np.array([model.allowed.get(k, np.zeros(model.n, bool)) for k in kinds], bool)[kind]
        place = {f: i for i, f in enumerate(features)}
        for r, needed in model.needs:
            self.may[~has[:, place[needed]] if needed in place else slice(None), r] = False
        used = [f for f in model.features if f in place]
        self.has, self.row = has[:, [place[f] for f in used]], [model.row[f] for f in used]

    def scores(self, model: Model) -> np.ndarray:
        out = self.has.astype(float) @ model.e[self.row] + model.b
        out[~self.may] = NEVER
        return out


def best_paths(scores: np.ndarray, off: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The role of every unit on its text's best path; the first of equal ones.  Units without any role get -1."""
    lengths = np.diff(off)
    longest = int(lengths.max(initial=0))
    by = np.argsort(-lengths, kind="stable")
    first, alive = off[:-1][by], np.searchsorted(-lengths[by], -np.arange(longest), "left")
    back = np.full(scores.shape, -1, np.int64)
    best = np.empty((len(start), len(by)))  # by role, so that all texts of a role lie side by side
    for i in range(longest):
        k = int(alive[i])
        at = first[:k] + i
        now = best[:, :k]
        if i == 0:
            now[:] = (scores[at] + start).T
            continue
        most, of = now[0] + step[0][:, None], np.zeros((len(start), k), np.int64)
        for a in range(1, len(start)):
            way = now[a] + step[a][:, None]
            of[way > most] = a  # the first of equal ones stays
            np.maximum(most, way, most)
        back[at] = of.T
        now[:] = most + scores[at].T
    path = np.full(len(scores), -1, np.int64)
    last = by[lengths[by] > 0]
    role = best[:, : len(last)].argmax(0)
    role[~np.isfinite(best[:, : len(last)].max(0, initial=NEVER))] = -1
    for i in range(longest - 1, -1, -1):
        k = int(alive[i])
        at = first[:k] + i
        path[at] = role[:k]
        role[:k] = np.where(role[:k] >= 0, back[at, np.maximum(role[:k], 0)], -1) if i else role[:k]
    return path


def local_scores(path: np.ndarray, scores: np.ndarray, off: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """What every role would score at each unit, its neighbours as they are."""
    begins, ends = np.zeros(len(path), bool), np.zeros(len(path), bool)
    full = np.diff(off) > 0
    begins[off[:-1][full]], ends[off[1:][full] - 1] = True, True
    out = scores + np.where(begins[:, None], start, step[np.roll(path, 1)])
    return out + np.where(ends[:, None], 0.0, step[:, np.roll(path, -1)].T)


def decoded(texts: DataFrame, key: str, units: str, weights: Weights, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns to keep, decoded: role, score, runner-up and its distance of every unit, one array a text (null and empty ones give an empty one).

    A text in which some unit can take no role has null roles throughout.
    """
    features = sorted({f for f, _ in weights.emission})
    key_type = texts.schema[key].dataType.simpleString()
    kind = pa.list_(pa.struct([("role", pa.string()), ("score", pa.float64()), ("runner_up", pa.string()), ("margin", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, features)
        names = np.array([*weights.roles, None], object)
        for batch in batches:
            found = Texts(model, batch.column(1))
            scores = found.scores(model)
            path = best_paths(scores, found.off, model.s, model.t)
            local = local_scores(path, scores, found.off, model.s, model.t)
            every = np.arange(len(path))
            own = local[every, path]
            local[every, path] = NEVER
            other = local.argmax(1) if len(path) else path
            gap = own - local[every, other]
            good = (path >= 0) & np.isfinite(gap)
            fields = [
                pa.array(names[path], pa.string()),
                pa.array(own, mask=path < 0),
                pa.array(names[np.where(good, other, -1)], pa.string()),
                pa.array(np.where(good, gap, 0.0), mask=~good),
            ]
            out = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
            kept = [batch.column(2 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.ListArray.from_arrays(found.off.astype(np.int32), out)], names=[key, *keep, "decoded"])

    also = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return texts.select(key, units, *keep).mapInArrow(run, f"`{key}` {key_type}, {also}decoded {DECODED}")


def _counts(model: Model, found: Texts, a: int, b: int, path: np.ndarray, sign: float, out: np.ndarray) -> None:
    """Add the parameters that the path of units a..b uses."""
    n = model.n
    roles = path[a:b]
    np.add.at(out, roles, sign)
    out[n + roles[0]] += sign
    np.add.at(out, 2 * n + roles[:-1] * n + roles[1:], sign)
    lo, hi = np.searchsorted(found.unit, [a, b])
    np.add.at(out, 2 * n + n * n + found.feature[lo:hi] * n + path[found.unit[lo:hi]], sign * found.value[lo:hi])


def fit(
    texts: DataFrame, key: str, units: str, gold: str, weights: Weights, epochs: int = 4, shards: int = 8, rate: float = 1.0, margin: float = 1.0, shrink: float = 10.0, cap: float = 3.0, seed: int = 7, written=None
) -> Weights:
    """Averaged perceptron; ``gold`` holds, for each unit, the roles it may have (null or empty: any).

    Rows without units, or without any labelling that gold allows, teach nothing.  A parameter moves by its
    averaged change, shrunk by n / (n + shrink) for n texts that touched it, at most by ``cap``.
    Shards are dealt by a hash of the key, so that the weights do not depend on files or partitions.
    ``written`` (a function of a DataFrame) stores what an epoch's shards give; without it the epoch is
    computed again for the texts that it touched.
    """
    keep = written or (lambda df: df)
    feats = texts.select(F.explode(units).alias("u")).select(F.explode(F.map_keys("u.feats")).alias("f")).distinct()
    features = sorted({r.f for r in feats.collect()} | {f for f, _ in weights.emission})
    first = weights.vector(features)
    dealt = texts.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("string").alias("text"), units, gold)
    schema = "shard int, text string, at int, weight double, total double, steps long"
    current, total, steps, touched = first, np.zeros(len(first)), 0, None
    for epoch in range(epochs):
        now = current

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            state: dict[int, tuple] = {}
            for batch in batches:
                shard, names, golds = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
                for s in np.unique(shard).tolist():
                    if s not in state:
                        state[s] = (Model(weights, features, now.copy()), np.zeros(len(now)), [1], [])
                    model, lag, clock, marks = state[s]
                    rows = np.flatnonzero(shard == s)
                    found = Texts(model, batch.column(2).take(pa.array(rows)))
                    for i, row in enumerate(rows.tolist()):
                        a, b = found.off[i], found.off[i + 1]
                        changed = _learn(model, found, a, b, golds[row], rate, margin) if a < b else None
                        if changed is not None:
                            lag += clock[0] * changed
                            marks.append((names[row], np.flatnonzero(changed)))
                        clock[0] += 1
            for s, (model, lag, clock, marks) in state.items():
                c, size = clock[0], len(model.vector)
                # the sum of the weights after every step, from their changes and when they came
                yield _rows(s, [None] * size, np.arange(size), model.vector, c * model.vector - lag, c)
                for name, at in marks:
                    yield _rows(s, [name] * len(at), at, None, None, 0)

        order = F.xxhash64("text", F.lit(seed + epoch))
        result = keep(dealt.repartition(shards, "shard").sortWithinPartitions("shard", order, "text").mapInArrow(run, schema))
        sums = result.filter("text IS NULL").groupBy("at").agg(F.avg("weight").alias("w"), F.sum("total").alias("t"), F.sum("steps").alias("n")).collect()
        for r in sums:
            total[r.at] += r.t
        if sums:
            current = np.array([r.w for r in sorted(sums, key=lambda r: r.at)])
            steps += sums[0].n
        seen = result.filter("text IS NOT NULL").select("at", "text")
        touched = seen if touched is None else touched.unionByName(seen)
    if not steps:
        return weights
    count = np.zeros(len(first))
    for r in touched.distinct().groupBy("at").count().collect():
        count[r["at"]] = r["count"]
    moved = np.clip((total / steps - first) * count / (count + shrink), -cap, cap)
    return weights.with_vector(features, first + moved)


def _learn(model: Model, found: Texts, a: int, b: int, gold, rate: float, margin: float):
    """One text: the change of the weights, or None if its labelling is right by the margin or gold allows none."""
    roles = model.weights.roles
    right = np.array([[not g or r in g for r in roles] for g in (gold or [None] * int(b - a))], bool)
    off = np.array([0, b - a])
    lo, hi = np.searchsorted(found.unit, [a, b])
    scores = np.tile(model.b, (b - a, 1))
    np.add.at(scores, found.unit[lo:hi] - a, model.e[found.feature[lo:hi]] * found.value[lo:hi, None])
    scores[~found.may[a:b]] = NEVER
    guess = best_paths(scores + margin * ~right, off, model.s, model.t)
    if guess[0] < 0 or right[np.arange(b - a), guess].all():
        return None
    want = best_paths(np.where(right, scores, NEVER), off, model.s, model.t)
    if want[0] < 0:
        return None
    change = np.zeros(len(model.vector))
    whole = np.full(int(b), -1, np.int64)
    for path, sign in ((want, rate), (guess, -rate)):
        whole[a:b] = path
        _counts(model, found, a, b, whole, sign, change)
    model.vector += change
    return change


def _rows(shard: int, names: list, at: np.ndarray, weight, total, steps: int) -> pa.RecordBatch:
    n = len(names)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * n, pa.int32()),
            pa.array(names, pa.string()),
            pa.array(at.astype(np.int32)),
            pa.nulls(n, pa.float64()) if weight is None else pa.array(weight),
            pa.nulls(n, pa.float64()) if total is None else pa.array(total),
            pa.array([steps] * n, pa.int64()),
        ],
        names=["shard", "text", "at", "weight", "total", "steps"],
    )
