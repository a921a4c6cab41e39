"""Values that each row of a key takes from the rows before it, with no window over a key.

Rows are range-sorted by key and order, so a key with half of all rows lies in many partitions. Each partition is walked once; what
its last key has gathered is one summary. The summaries, one a partition, are folded on the driver, and a row whose key began in an
earlier partition takes on what came before. The partitions are stored between the two steps, since their borders are sampled.

Nulls are a key of their own; a null order comes first. Rows equal in key and order go to one partition, in no fixed order: the order
should name a row. An empty table gives an empty result."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.scratch import stored


def _breaks(columns: list[pa.Array], last: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Where another key begins, and the key of the last row. ``last``: the key of the row before these."""
    n = len(columns[0]) if columns else 0
    if not n:
        return np.zeros(0, bool), last
    new = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    first = tuple(c[0].as_py() for c in columns)
    new[0] = last is None or first != last
    return new, tuple(c[n - 1].as_py() for c in columns)


def _carried(df: DataFrame, keys: list[str], order: list[str], walker: Callable, added: str, needs: list[str]) -> tuple[DataFrame, list[tuple[int, dict]]]:
    """The stored rows with ``added`` columns, ``_part`` and ``_open`` (the key may have begun in an earlier partition), and the
    summaries by partition. ``walker()`` makes an object with ``walk(values of needs, new) -> arrays`` and ``tail()``."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumns({k: F.col(c) for k, c in zip(keyed, keys)})
    by = [*keyed, *order] if keys else order
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    names, n_keys = ranged.columns, len(keys)
    at = [names.index(c) for c in needs]
    key_at = [names.index(k) for k in keyed]
    kept = [i for i in range(len(names)) if i not in key_at]
    new_names = [c.split()[0] for c in added.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, last, first, one = TaskContext.get().partitionId(), walker(), None, None, True
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield held(None)
            if n_keys:
                new, key = _breaks([b.column(i) for i in key_at], last)
            else:
                new, key = np.zeros(b.num_rows, bool), ()
                new[0] = last is None
            if first is None:
                first = tuple(b.column(i)[0].as_py() for i in key_at)
            more = np.flatnonzero(new[1:] if last is None else new)
            open_ = np.zeros(b.num_rows, bool)
            if one:
                stop = int(more[0]) + (last is None) if len(more) else b.num_rows
                open_[:stop] = True
                one = not len(more)
            last = key
            out = [*[b.column(i) for i in kept], *state.walk([b.column(i) for i in at], new), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(open_)]

            def held(tail: bytes | None, out=out, n=b.num_rows) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*out, pa.array([None] * (n - 1) + [tail], pa.binary())], names=[*[names[i] for i in kept], *new_names, "_part", "_open", "_tail"])

        if held is not None:  # the partition's last row carries its summary
            yield held(pickle.dumps({"first": first, "last": last, "one": one, "tail": state.tail()}))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema if f.name not in keyed)
    out = stored(ranged.mapInArrow(work, f"{kinds}, {added}, _part int, _open boolean, _tail binary"), "scan")
    tails = sorted((r._part, pickle.loads(r._tail)) for r in out.where("_tail is not null").select("_part", "_tail").collect())  # one a partition
    return out.drop("_tail"), tails


def _before(tails: list[tuple[int, dict]], then: Callable) -> list[tuple[int, object]]:
    """(partition, what its first key has gathered before it), for partitions that go on with a key. ``then(a, b)``: b after a."""
    out, last, gathered = [], None, None
    for part, t in tails:
        goes_on = gathered is not None and t["first"] == last
        if goes_on:
            out.append((part, gathered))
        gathered = then(gathered, t["tail"]) if goes_on and t["one"] else t["tail"]
        last = t["last"]
    return out


class _Running:
    """Sums, first and last values of the key so far."""

    def __init__(self, kinds: list[str], inclusive: bool):
        self.kinds, self.inclusive = kinds, inclusive
        self.now: list = [0 if k == "sum" else None for k in kinds]

    def tail(self) -> list:
        return self.now

    def walk(self, columns: list[pa.Array], new: np.ndarray) -> list[pa.Array]:
        n = len(new)
        # For each row the first row of its key here; -1: the key came with the rows before.
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        out = []
        for i, (kind, c) in enumerate(zip(self.kinds, columns, strict=True)):
            out.append(self._sum(i, c, begin) if kind == "sum" else self._value(i, c, begin, kind))
        return out

    def _sum(self, i: int, c: pa.Array, begin: np.ndarray) -> pa.Array:
        v = pc.fill_null(c, 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(v)
        before = upto - v
        base = np.where(begin >= 0, before[begin], -self.now[i])
        got = (upto if self.inclusive else before) - base
        self.now[i] = (upto[-1] - base[-1]).item()
        return pa.array(got)

    def _value(self, i: int, c: pa.Array, begin: np.ndarray, kind: str) -> pa.Array:
        n = len(begin)
        valid = pc.is_valid(c).to_numpy(zero_copy_only=False)
        place = np.arange(n)
        if kind == "last":
            at = np.maximum.accumulate(np.where(valid, place, -1))
            at = np.where(at >= begin, at, -1)  # of another key
        else:
            # The first valid row at or after the key's beginning, once it is reached.
            following = np.minimum.accumulate(np.where(valid, place, n)[::-1])[::-1]
            at = following[np.maximum(begin, 0)]
            at = np.where(at <= place, at, -1)
        if kind == "first" and self.now[i] is not None:
            at = np.where(begin < 0, n, at)  # set before these rows
        elif kind == "last":
            at = np.where((at < 0) & (begin < 0), n, at)
        full = pa.concat_arrays([c, pa.array([self.now[i]], c.type)])
        taken = lambda x: full.take(pa.array(np.where(x < 0, 0, x), mask=x < 0))
        got = taken(at)
        if not self.inclusive:
            at = np.where(begin == place, -1, np.concatenate([[n], at[:-1]]))
        self.now[i] = got[n - 1].as_py()
        return taken(at) if not self.inclusive else got


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, firsts: dict[str, str] | None = None, lasts: dict[str, str] | None = None, inclusive: bool = True) -> DataFrame:
    """Adds columns: for each row the sum (0 for none), first or last non-null value of a column over its key's rows up to it, or
    before it unless ``inclusive``."""
    wanted = [(name, c, kind) for kind, given in (("sum", sums), ("first", firsts), ("last", lasts)) for name, c in (given or {}).items()]
    sql = {c: "bigint" if kind == "sum" and df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") else df.schema[c].dataType.simpleString() for _, c, kind in wanted}
    kinds = [k for _, _, k in wanted]
    typed = df.withColumns({f"_in{i}": F.col(c).cast(sql[c]) for i, (_, c, _) in enumerate(wanted)})
    out, tails = _carried(typed, keys, order, lambda: _Running(kinds, inclusive), ", ".join(f"_v{i} {sql[c]}" for i, (_, c, _) in enumerate(wanted)), [f"_in{i}" for i in range(len(wanted))])

    def then(a: list, b: list) -> list:
        pick = {"sum": lambda x, y: x + y, "first": lambda x, y: y if x is None else x, "last": lambda x, y: x if y is None else y}
        return [pick[k](x, y) for k, x, y in zip(kinds, a, b, strict=True)]

    carry = _before(tails, then)
    columns = [pa.array([g[i] for _, g in carry], to_arrow_type(typed.schema[f"_in{i}"].dataType)) for i in range(len(wanted))]
    carried = pa.table([pa.array([part for part, _ in carry], pa.int32()), *columns], names=["_part", *[f"_c{i}" for i in range(len(wanted))]])
    out = out.join(F.broadcast(df.sparkSession.createDataFrame(carried)), "_part", "left")  # a row a partition at most
    value = {}
    for i, (name, _, kind) in enumerate(wanted):
        came, own = F.when(F.col("_open"), F.col(f"_c{i}")), F.col(f"_v{i}")
        value[name] = own + F.coalesce(came, F.lit(0)) if kind == "sum" else F.coalesce(came, own) if kind == "first" else F.coalesce(own, came)
    return out.select(*[c for c in df.columns if c not in value], *[v.alias(n) for n, v in value.items()])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the row's number in its key (in the whole table without keys), from 1."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, sums={name: "_one"}).drop("_one")


class _Machine:
    """The state before each row, for every state that the key may have come with."""

    def __init__(self, moves: np.ndarray, start: int):
        # moves[target, state]: the state after; the last target is one that is not known.
        self.moves, self.start = moves, start
        self.now, self.begun = tuple(range(moves.shape[1])), False

    def tail(self) -> tuple:
        return self.now

    def walk(self, columns: list[pa.Array], new: np.ndarray) -> list[pa.Array]:
        targets = columns[0].to_numpy(zero_copy_only=False).tolist()
        moves, known = self.moves.tolist(), self.start
        states, now, out = range(len(self.now)), self.now, []
        fixed = len(set(now)) == 1
        for target, begins in zip(targets, new.tolist(), strict=True):
            if begins and self.begun:
                now, fixed = (known,) * len(now), True
            out.append(bytes(now))
            self.begun = True
            move = moves[target]
            # All hypotheses have met: one look-up is enough.
            now = (move[now[0]],) * len(now) if fixed else tuple(move[now[s]] for s in states)
            fixed = fixed or len(set(now)) == 1
        self.now = now
        return [pa.array(out, pa.binary())]


def states(df: DataFrame, keys: list[str], order: list[str], target: str, names: list[str], edges: dict[str, list[str]], start: str) -> DataFrame:
    """Adds state_before, accepted and state_after: each key begins in ``start``; a request for a state that the present one leads
    to (by ``edges``, or itself) is accepted, any other, a null or an unknown one too, is refused and leaves the state as it was.

    A row is a map from each state to the one after it. Maps compose, so partitions of one key are walked side by side: all
    states that it may come with at once, until they meet."""
    n = len(names)
    number = {s: i for i, s in enumerate(names)}
    moves = np.tile(np.arange(n), (n + 1, 1))
    for s, targets in edges.items():
        for t in targets:
            moves[number[t], number[s]] = number[t]
    of = F.create_map(*[x for s, i in number.items() for x in (F.lit(s), F.lit(i))])
    coded = df.withColumn("_target", F.coalesce(F.try_element_at(of, F.col(target)), F.lit(n)))
    begin = number[start]
    out, tails = _carried(coded, keys, order, lambda: _Machine(moves, begin), "_maps binary", ["_target"])
    came = dict(_before(tails, lambda a, b: tuple(b[x] for x in a)))
    carried = pa.table({"_part": pa.array([part for part, _ in tails], pa.int32()), "_from": pa.array([came[part][begin] if part in came else begin for part, _ in tails], pa.int32())})
    out = out.join(F.broadcast(df.sparkSession.createDataFrame(carried)), "_part")  # a row a partition
    at = F.conv(F.hex(F.substring(F.col("_maps"), F.when(F.col("_open"), F.col("_from")).otherwise(F.lit(begin)) + 1, F.lit(1))), 16, 10).cast("int")
    listed = F.array(*[F.lit(s) for s in names])
    before = F.get(listed, at)
    allowed = F.array(*[F.array(*[F.lit(bool(t == s or t in edges.get(s, []))) for t in [*names, None]]) for s in names])
    out = out.withColumn("accepted", F.get(F.get(allowed, at), F.col("_target"))).withColumn("state_before", before)
    return out.withColumn("state_after", F.when(F.col("accepted"), F.col(target)).otherwise(F.col("state_before"))).select(*[c for c in df.columns if c not in ("accepted", "state_before", "state_after")], "state_before", "accepted", "state_after")
