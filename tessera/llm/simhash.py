"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words are runs of bytes other than ASCII white
space, shingles of ``shingle`` words joined by a space (fewer words: all of
them as one shingle), XXH64 with seed 42 of each; a bit is set if more than
half of the hashes have it. No words, or a null text: fingerprint zero, linked
like any other.

Search: the 64 bits are grouped into partitions of correlated bits, and each
partition i gets a threshold t_i >= -1 (-1: not searched) with
sum(t_i) = distance - partitions + 1, so any two fingerprints within the
distance are within t_i on some partition i. A dynamic programme picks the
thresholds, and the number of partitions, that make the fewest estimated
candidates and probes. Equal fingerprints are one node from the start. Entries
(partition, bits, fingerprint) are range-sorted and cut into blocks of bounded
size; each block is verified by itself, and blocks that share a bucket meet
pairwise, so that neither a bucket nor its pairs have to fit a task: a block
gives at most one link for each row. Components come from those links.

Verification may ask for more than the fingerprint's distance: with ``verify``
= (shingle, bits) each text also carries a signature of 256 bits, the
fingerprint's rule over shingles of that many words with four hashes made from
each, and two texts link only if their signatures differ in at most ``bits``
bits as well. Short shingles find candidates whose long shingles then decide.

With ``verify`` = (shingle, bits, least) two texts link only if the exact
Jaccard similarity of their sets of shingles (as 64-bit hashes) is at least
``least``. No distance on 64 bits holds nearly all such pairs and few others,
so the search runs over ``WORDS64`` words of fingerprint bits: the same
partitions of correlated bits and thresholds by dynamic programming, but the
thresholds are the cheapest that find a pair of just that similarity with a
chance of ``FOUND`` or more (nearer pairs nearly always; partitions grow wider
with the number of texts). In a bucket, rows whose signatures differ in at
most ``bits`` bits are joined by their forest of least distances, so a group of
near copies proposes about one pair a text and never all its pairs; each
proposed pair within the fingerprint's distance is decided by its exact
similarity. Texts with the same set are one node. What the fingerprints found
are groups; every link between groups that they missed, and no other, is then
found by prefix filtering over the sets (``overlap``), so the components are
those of all pairs of the least similarity.

Defined results: repeated rows each get their row; rows whose id is null take
part like all others and get the smallest id of their component (null if none
has one); an empty table gives an empty result; other columns, whatever
their names, are not read. Texts of any length take bounded memory, but for the sets, which hold eight bytes a word.
"""

from __future__ import annotations

import re
from functools import partial, reduce
from itertools import islice, tee
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import overlap
from tessera.llm.common import Scratch, connected_components, table

BITS, SEED = 64, 42
#: Rows of a block; groups up to SMALL rows are compared by shifted arrays; shingles hashed at once.
BLOCK, SMALL, AT_ONCE = 4096, 24, 1 << 15
#: Search by exact similarity: rows of a block, words of fingerprint bits, and the chance to find a pair of just the least similarity.
WIDE, WORDS64, FOUND = 2048, 8, 0.995
#: Probes a text that are on disk at once in that search (or so many in all, if that is more), blocks of a bucket that meet in one
#: cell, and proposed pairs for each text that are decided at once.
PROBES, PROBES_LEAST, TOGETHER, PART = 8, 2_000_000, 8, 1 / 8
#: A sieve's bits for each id, its bits at most, and how many of them an id sets.
SIEVE, SIEVE_MOST, SIEVE_SET = 12, 1 << 25, 4
#: Bytes above which a text's words are found one after the other instead of all at once.
LONG = 1 << 22
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Cost of a probe row against that of one comparison.
PROBE_COST = 500.0


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as an unsigned integer."""
    return int(signature(text, shingle, 1)[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of hashes: for k = 0 themselves, else the finaliser of splitmix64 after a step of k."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _words(data: bytes):
    return (m[0] for m in _WORD.finditer(data))


def signature(text: str | None, shingle: int, words64: int) -> np.ndarray:
    """``words64`` words of 64 bits by the fingerprint's rule; the first is the fingerprint."""
    return _majority(_parts(_hashes(text, shingle)), words64)


def _hashes(text: str | None, shingle: int):
    """The hash of each shingle, in order; none if there are no words."""
    import xxhash

    data = (text or "").encode("utf-8").lower()
    first = list(islice(_words(data), shingle))
    if not first:
        return iter(())
    h = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(first) < shingle:
        return iter([h(b" ".join(first))])
    # the same words shifted by 0..shingle-1 give the shingles
    streams = [data.split()] * shingle if len(data) <= LONG else tee(_words(data), shingle)
    return map(h, map(b" ".join, zip(*(islice(words, k, None) for k, words in enumerate(streams)), strict=False)))


def _parts(hashes):
    while len(part := np.fromiter(islice(hashes, AT_ONCE), dtype="<u8")):
        yield part


def _majority(parts, words64: int) -> np.ndarray:
    counts, n = np.zeros((words64, BITS), dtype=np.int64), 0
    for part in parts:
        n += len(part)
        for k in range(words64):
            bits = np.unpackbits(_mixed(part, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


#: Columns of a signature used for verification.
SIGNATURE = ["s0", "s1", "s2", "s3"]
#: Columns of the words of fingerprint bits that the search by exact similarity runs over.
WIDE_BITS = [f"w{k}" for k in range(WORDS64)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, verify: int | None = None) -> DataFrame:
    """(doc_id, fp, ...): fp holds the fingerprint's 64 bits as a signed bigint; with ``verify``, the words of its
    shingle, s0..s3 hold the signature."""
    more = SIGNATURE if verify else []

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(1).to_pylist()
                fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
                sig = np.stack([signature(t, verify, len(more)) for t in texts]) if more else np.zeros((len(texts), 0), np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in sig.T]], names=["doc_id", "fp", *more])

    schema = "".join(f", {c} bigint" for c in more)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id bigint, fp bigint{schema}")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.fromiter(_hashes(text, shingle), dtype="<u8"))


def _set_key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), seed=SEED)


def keyed(docs: DataFrame, id_col: str, text_col: str, shingle: int, long: int, least: float) -> DataFrame:
    """(doc_id, fp, key, s0..s3, w0.., need, head): key stands for the set of ``long``-word shingles, s0..s3 are its signature,
    w0.. the words of fingerprint bits, of which the first is fp; head and need see ``overlap.head`` for ``least``."""
    names = ["key", *SIGNATURE, *WIDE_BITS]

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out, heads = np.zeros((part.num_rows, len(names)), dtype=np.uint64), []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = shingle_set(t, long)
                    out[i, 0], out[i, 1 : 1 + len(SIGNATURE)] = _set_key(found), _majority((found[k : k + AT_ONCE] for k in range(0, len(found), AT_ONCE)), len(SIGNATURE))
                    out[i, 1 + len(SIGNATURE) :] = signature(t, shingle, WORDS64)
                    heads.append(overlap.head(found, least))
                cols = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out.T]
                more = [pa.array([n for _, n in heads], pa.int64()), pa.array([h for h, _ in heads], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), cols[1 + len(SIGNATURE)], *cols, *more], names=["doc_id", "fp", *names, "need", "head"])

    schema = "".join(f", {c} bigint" for c in [*names, "need"]) + ", head binary"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id bigint, fp bigint{schema}")


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    """The bits of a sieve of ``size`` bits that each id sets, a row for each of them."""
    return np.stack([_mixed(ids.view(np.uint64), k) for k in range(1, SIEVE_SET + 1)]) & np.uint64(size - 1)


def sieve(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids of a table of one column, null ones left out. It has at most SIEVE_MOST bits, 4 MB: up to two
    million ids one other in a hundred passes at most, with more of them more pass; none of the ids is ever held back."""
    ids = ids.toDF("id").where("id is not null")
    size = min(SIEVE_MOST, 1 << max(6, (SIEVE * ids.count() - 1).bit_length()))

    def work(batches):
        for b in batches:
            at = _places(b.column(0).to_numpy(zero_copy_only=False), size).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = ids.mapInArrow(work, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def passes(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids, len(held) * 64)
    return ((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def in_sieve(held: np.ndarray):
    """A predicate on an id column: whether the id passes the sieve; null ones count as 0."""

    @F.arrow_udf("boolean")
    def told(ids: pa.Array) -> pa.Array:
        return pa.array(passes(held, ids.fill_null(0).to_numpy(zero_copy_only=False)))

    return told


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, held: np.ndarray) -> DataFrame:
    """(key, shingles) of each row whose id passes the sieve ``held`` or is null."""

    def work(batches):
        for b in batches:
            ids = b.column(0)
            b = b.filter(pa.array(passes(held, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)))
            for at in range(0, b.num_rows, 1000):
                sets = [shingle_set(t, shingle) for t in b.slice(at, 1000).column(1).to_pylist()]
                keys = np.array([_set_key(x) for x in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "key bigint, shingles array<bigint>")


# --- partitions and thresholds -------------------------------------------------


def bit_statistics(nodes: DataFrame, columns: tuple[str, ...] = ("fp",)) -> tuple[int, list[np.ndarray]]:
    """Number of rows and, for each column and all pairs of its bits, how many rows have both set."""
    cells = BITS * BITS

    def work(batches):
        total, n = np.zeros((len(columns), BITS, BITS), dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for k in range(len(columns)):
                fp = b.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fp), 1 << 16):
                    x = np.unpackbits(fp[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    total[k] += np.rint(x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(total.size)]), pa.array(np.r_[n, total.ravel()])], names=["cell", "n"])

    # 4,097 rows, or 4,096 a word
    got = {r.cell: r.n for r in nodes.select(*columns).mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), [np.array([got.get(i, 0) for i in range(k * cells, (k + 1) * cells)], dtype=float).reshape(BITS, BITS) for k in range(len(columns))]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        sub = corr[np.ix_(free, free)]
        group = [free[int(sub.sum(axis=1).argmax())]]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].mean(axis=1).argmax())])
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def _near(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0..most of these bits, taken as independent."""
    d = np.zeros(most + 2)
    d[0] = 1.0
    for q in 2 * p * (1 - p):
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return np.cumsum(d)[: most + 1]


def ball(width: int, radius: int) -> list[int]:
    """Masks over ``width`` bits with at most ``radius`` set, the empty one first."""
    from itertools import combinations

    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to search, of least estimated cost."""
    from math import comb

    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (np.inf, [])
    for parts in range(max(1, min(distance, 3)), distance + 2):
        groups, need = group_bits(n, both, parts), distance - parts + 1
        top = min(3, max(need, 0) + parts - 1)
        # state: sum of thresholds + 1 so far -> (cost, thresholds)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            near, new = _near(p[g], top), {}
            for used, (cost, chosen) in state.items():
                for t in range(-1, top + 1):
                    probes = 0 if t < 0 else sum(comb(len(g), r) for r in range(t + 1))
                    c = cost + (0 if t < 0 else n * probes * PROBE_COST + n * n * near[t] / 2)
                    s = used + t + 1
                    if s <= need + parts and (s not in new or c < new[s][0]):
                        new[s] = (c, [*chosen, t])
            state = new
        if need + parts in state and state[need + parts][0] < best[0]:
            best = (state[need + parts][0], [(g, t) for g, t in zip(groups, state[need + parts][1], strict=True) if t >= 0])
    return best[1]


def differing(least: float) -> float:
    """Chance that a fingerprint bit differs between two texts of this Jaccard similarity: the angle of their sets, in half turns."""
    return float(np.arccos(min(1.0, 2 * least / (1 + least))) / np.pi)


def plan_wide(n: int, both: list[np.ndarray], share: float, found: float = FOUND) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to search, bits numbered over all words: of least estimated cost such that
    two texts whose bits differ with chance ``share`` come together in some partition with chance ``found``."""
    from math import comb, log, log1p

    need, unit = -log(1 - found), -log(1 - found) / 200
    best: tuple[float, list] = (np.inf, [])
    for parts in range(2, 9):
        groups = [(w, g) for w, m in enumerate(both) for g in group_bits(n, m, parts)]
        goal = ceil(need / unit)
        # state: units of -log(chance to miss) so far -> cost, and how it was reached
        cost = np.full(goal + 1, np.inf)
        cost[0], chosen = 0.0, []
        for w, g in groups:
            p = np.diag(both[w])[g] / max(n, 1)
            near, new, pick = _near(p, 2), cost.copy(), np.full(goal + 1, -1)
            for t in range(3):
                meet = sum(comb(len(g), r) * share**r * (1 - share) ** (len(g) - r) for r in range(t + 1))
                gain = int(-log1p(-min(meet, 1 - 1e-9)) / unit)
                c = n * sum(comb(len(g), r) for r in range(t + 1)) * PROBE_COST + n * n * near[t] / 2
                at = np.minimum(np.arange(goal + 1) + gain, goal)
                for i in np.flatnonzero(np.isfinite(cost)):
                    if cost[i] + c < new[at[i]]:
                        new[at[i]], pick[at[i]] = cost[i] + c, i * 4 + t
            cost = new
            chosen.append(pick)
        if cost[goal] < best[0]:
            i, out = goal, []
            for k in range(len(groups) - 1, -1, -1):
                if chosen[k][i] >= 0:
                    w, g = groups[k]
                    out.append(([BITS * w + b for b in g], int(chosen[k][i] % 4)))
                    i = chosen[k][i] // 4
            best = (cost[goal], out[::-1])
    return best[1]


# --- probe and verify ----------------------------------------------------------


def _extract(words: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each row, side by side; ``words``: one array, or one for each 64 bits."""
    words = words[None] if words.ndim == 1 else words
    out = np.zeros(words.shape[1], dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((words[b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)).astype(np.int64) << k
    return out


def entries(nodes: DataFrame, searched: list[tuple[list[int], int]], words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(part, bits, fp, rep, home, signature): each node's own bucket in every partition, and its probes."""
    balls = [np.array(ball(len(bits), t), dtype=np.int64) for bits, t in searched]
    more = [c for c in SIGNATURE if c in nodes.columns]

    def work(batches):
        for b in batches:
            data = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            for at in range(0, b.num_rows, 1 << 13):
                fp, rep, *rest = (c[at : at + (1 << 13)] for c in data)
                sig, wide = rest[: len(more)], np.stack([c.view(np.uint64) for c in rest[len(more) :]])
                for k, (bits, _) in enumerate(searched):
                    own, masks = _extract(wide, bits), balls[k]
                    m = len(masks)
                    cols = [np.full(len(fp) * m, k, dtype=np.int32), (own[:, None] ^ masks).ravel(), fp.repeat(m), rep.repeat(m), np.tile(masks == 0, len(fp)), *[c.repeat(m) for c in sig]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "bits", "fp", "rep", "home", *more])

    wide = [F.col(c).alias(f"_{c}") for c in words]
    return nodes.select("fp", "rep", *more, *wide).mapInArrow(work, "part int, bits bigint, fp bigint, rep bigint, home boolean" + "".join(f", {c} bigint" for c in more))


class Rule:
    """When two entries may link: distance of fingerprints, and of signatures where there are any;
    with ``forest``, which of those are proposed: see ``forest``."""

    def __init__(self, distance: int, bits: int | None = None, forest: bool = False):
        self.distance, self.bits, self.forest = distance, bits, forest

    def also(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= self.bits


def _links_of_small(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, home: np.ndarray, sig: np.ndarray, size: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Links within runs of equal keys of at most SMALL rows: each row against those 1, 2, ... behind."""
    out = []
    for d in range(1, SMALL):
        keep = size > d
        if not keep.any():
            break
        key, fp, rep, home, sig, size = (x[keep] for x in (key, fp, rep, home, sig, size))
        near = (key[d:] == key[:-d]) & (home[d:] | home[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= rule.distance)
        i = np.flatnonzero(near)
        if rule.bits is not None:
            i = i[rule.also(sig[i], sig[i + d])]
        if len(i):
            out.append(np.stack([rep[i], rep[i + d]]))
    return out


def spanning(fp: np.ndarray, rep: np.ndarray, home: np.ndarray, sig: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Links that join every two rows linked within this block, at most one for each row:
    a home row is compared with all, and links inside a group already joined are not repeated."""
    if rule.forest:
        return forest(fp, rep, sig, rule)
    mark, out = np.arange(len(fp)), []
    for i in np.flatnonzero(home):
        other = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= rule.distance)
        other = other[mark[other] != mark[i]]
        if rule.bits is not None and len(other):
            other = other[rule.also(sig[other], sig[i])]
        if len(other):
            marks, first = np.unique(mark[other], return_index=True)
            to = other[first]
            out.append(np.stack([np.full(len(to), rep[i]), rep[to]]))
            mark[np.isin(mark, marks)] = mark[i]
            if (mark == mark[0]).all():
                break
    return out


def forest(fp: np.ndarray, rep: np.ndarray, sig: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """The forest of least signature distances over the rows of a block, without edges beyond the rule: at every
    similarity it joins what all pairs of the block would join, as single linkage does."""
    n = len(rep)
    some = np.zeros(n, dtype=bool)  # rows that have a partner at all
    step = max(1, (1 << 18) // n)
    for at in range(0, n - 1, step):
        near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, at + 1 :]) <= rule.distance
        i, j = np.nonzero(near)
        keep = j >= i
        i, j = i[keep] + at, j[keep] + at + 1
        for k in range(0, len(i), 1 << 20):
            a, b = i[k : k + (1 << 20)], j[k : k + (1 << 20)]
            ok = rule.also(sig[a], sig[b])
            some[a[ok]], some[b[ok]] = True, True
    rows = np.flatnonzero(some)
    m = len(rows)
    if m < 2:
        return []
    fp, rep, s = fp[rows], rep[rows], np.ascontiguousarray(sig[rows].T)
    far = np.int64(1 << 20)
    best, parent, todo = np.full(m, far), np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    at, u, v = 0, [], []
    todo[0] = False
    for _ in range(m - 1):
        d = np.bitwise_count(s[0] ^ s[0, at]).astype(np.int64)
        for w in s[1:]:
            d += np.bitwise_count(w ^ w[at])
        d[np.bitwise_count(fp ^ fp[at]) > rule.distance] = far
        closer = todo & (d < best)
        best[closer], parent[closer] = d[closer], at
        at = int(np.where(todo, best, far + 1).argmin())
        todo[at] = False
        if best[at] <= rule.bits:
            u.append(parent[at])
            v.append(at)
    return [np.stack([rep[u], rep[v]])] if u else []


def _pack(part: int, bits: int, block: int, fp: np.ndarray, rep: np.ndarray, home: np.ndarray, sig: np.ndarray) -> dict:
    return {"part": part, "bits": bits, "block": block, "u": None, "v": None, "fps": fp.astype("<u8").tobytes(), "reps": rep.astype("<i8").tobytes(), "homes": np.packbits(home).tobytes(), "sigs": np.ascontiguousarray(sig).astype("<u8").tobytes()}


_FOUND = pa.schema([("part", pa.int32()), ("bits", pa.int64()), ("block", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("fps", pa.binary()), ("reps", pa.binary()), ("homes", pa.binary()), ("sigs", pa.binary())])
_FOUND_SQL = "part int, bits bigint, block bigint, u bigint, v bigint, fps binary, reps binary, homes binary, sigs binary"


def _links_batch(links: list[np.ndarray]):
    if links:
        u, v = np.concatenate(links, axis=1)
        n = len(u)
        none = [pa.nulls(n, f.type) for f in _FOUND]
        none[3], none[4] = pa.array(u), pa.array(v)
        yield pa.RecordBatch.from_arrays(none, schema=_FOUND)


def _first_pass(rule: Rule):
    """Over rows sorted by bucket: links inside blocks, and the blocks of buckets that may go on elsewhere."""

    def work(batches):
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        held: tuple | None = None  # rows of the last bucket seen, which may go on in the next batch
        at_start, spilled = True, None
        size = WIDE if rule.forest else BLOCK

        def block(cols, open_bucket: bool):
            """One block of one bucket: its links, and itself if the bucket has other blocks."""
            nonlocal serial
            part, bits, fp, rep, home, sig = cols
            serial += 1
            yield from _links_batch(spanning(fp, rep, home, sig, rule))
            if open_bucket:
                yield pa.RecordBatch.from_pylist([_pack(int(part[0]), int(bits[0]), (task << 32) + serial, fp, rep, home, sig)], schema=_FOUND)

        for b in batches:
            data = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            sig = np.stack([c.view(np.uint64) for c in data[5:]], axis=1) if len(data) > 5 else np.zeros((len(data[0]), 0), np.uint64)
            cols = (data[0], data[1], data[2].view(np.uint64), data[3], data[4].astype(bool), sig)
            if not len(cols[0]):
                continue
            if held is not None:
                cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(new)]
            # The last bucket is held back; the first of the task, or one cut already, is open to the left.
            sizes, last = ends - starts, len(starts) - 1
            small = (sizes > 1) & (sizes <= SMALL)
            small[last] = False
            small[0] &= not at_start
            if small.any():
                take = np.flatnonzero(small.repeat(sizes))
                gid = np.arange(len(starts)).repeat(sizes)[take]
                yield from _links_batch(_links_of_small(gid, cols[2][take], cols[3][take], cols[4][take], cols[5][take], sizes[gid], rule))
            large = sizes > SMALL
            large[0] |= at_start
            for g in np.flatnonzero(large[:last]):
                one = tuple(x[starts[g] : ends[g]] for x in cols)
                many = (g == 0 and at_start) or spilled == (int(one[0][0]), int(one[1][0])) or sizes[g] > size
                for k in range(0, sizes[g], size):
                    yield from block(tuple(x[k : k + size] for x in one), many)
            at_start &= last == 0
            held = tuple(x[starts[-1] :].copy() for x in cols)
            while len(held[0]) > 2 * size:  # a bucket larger than memory should hold goes out block by block
                spilled = (int(held[0][0]), int(held[1][0]))
                yield from block(tuple(x[:size] for x in held), True)
                held = tuple(x[size:].copy() for x in held)
        if held is not None and len(held[0]):
            for k in range(0, len(held[0]), size):
                yield from block(tuple(x[k : k + size] for x in held), True)

    return work


def _second_pass(rule: Rule):
    """Over blocks sorted by (part, bits, low, high, block), low and high being a cell's two shares: pairs of blocks of one
    bucket, each in one cell."""

    def met(cell: list[dict]):
        for k, one in enumerate(cell):
            for other in cell[k + 1 :]:
                if one["low"] != one["high"] and one["share"] == other["share"]:
                    continue  # they meet in the cell of their own share
                links = spanning(*(np.concatenate(x) for x in zip(one["cols"], other["cols"], strict=True)), rule)
                if links:
                    u, v = np.concatenate(links, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def work(batches):
        cell: list[dict] = []
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                n = len(row["fps"]) // 8
                fp, rep, sig = np.frombuffer(row["fps"], dtype="<u8"), np.frombuffer(row["reps"], dtype="<i8"), np.frombuffer(row["sigs"], dtype="<u8").reshape(n, -1)
                cols = (fp, rep, np.unpackbits(np.frombuffer(row["homes"], dtype=np.uint8))[:n].astype(bool), sig)
                row = {k: row[k] for k in ("part", "bits", "low", "high", "share")} | {"cols": cols}
                if cell and any(cell[0][k] != row[k] for k in ("part", "bits", "low", "high")):
                    yield from met(cell)
                    cell = []
                cell.append(row)
        yield from met(cell)

    return work


def _at_once(searched: list[tuple[list[int], int]], n: int) -> list[list[tuple[list[int], int]]]:
    """The partitions in groups of at most PROBES probes a row, or PROBES_LEAST of all ``n`` rows; one partition at least."""
    groups, probes, most = [[]], 0, max(PROBES, PROBES_LEAST // n)
    for bits, t in searched:
        more = len(ball(len(bits), t))
        if groups[-1] and probes + more > most:
            groups.append([])
            probes = 0
        groups[-1].append((bits, t))
        probes += more
    return groups


def _block_pairs(blocks: DataFrame, rule: Rule) -> DataFrame:
    """(u, v): links across the blocks of a bucket. A bucket's blocks are dealt into shares of about TOGETHER, and a cell holds
    two shares, so a block travels once for each share and not for each other block."""
    shares = blocks.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1").select("part", "bits", F.ceil(F.col("n") / TOGETHER).alias("shares"))
    rows = blocks.join(shares, ["part", "bits"]).withColumn("share", F.pmod(F.xxhash64("block", F.lit("share")), F.col("shares")).cast("bigint"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    rows = rows.select("part", "bits", F.least("share", "other").alias("low"), F.greatest("share", "other").alias("high"), "block", "share", "fps", "reps", "homes", "sigs")
    cells = rows.repartition("part", "bits", "low", "high").sortWithinPartitions("part", "bits", "low", "high", "block")
    return cells.mapInArrow(_second_pass(rule), "u bigint, v bigint")


def links(nodes: DataFrame, distance: int, scratch: Scratch, bits: int | None = None, least: float | None = None) -> DataFrame:
    """(u, v): links between nodes (fp, rep) that join all within ``distance``; with ``bits``, nodes also have a signature,
    and linked ones differ in at most so many of its bits; with ``least`` proposals for pairs of at least that similarity."""
    spark = nodes.sparkSession
    words = tuple(WIDE_BITS) if least else ("fp",)
    n, both = bit_statistics(nodes, words)
    if n < 2:
        return spark.createDataFrame([], "u bigint, v bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    searched = plan_wide(n, both, differing(least)) if least else plan(n, both[0], distance)
    rule = Rule(distance, bits, least is not None)
    out = []
    # The search by exact similarity takes a few partitions after the other: entries and blocks of all at once would be many times the texts.
    for k, some in enumerate(_at_once(searched, n) if least else [searched]):
        rows = entries(nodes, some, words).repartitionByRange(parts, "part", "bits", "fp", "home").sortWithinPartitions("part", "bits", "fp", "home")
        found = scratch.put(f"found{k}", rows.mapInArrow(_first_pass(rule), _FOUND_SQL))
        met = _block_pairs(found.where("block is not null").select("part", "bits", "block", "fps", "reps", "homes", "sigs"), rule)
        out.append(found.where("u is not null").select("u", "v").unionAll(met))
        if least:
            out[-1] = scratch.put(f"linked{k}", out[-1].select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
            scratch.drop(f"found{k}")
    return reduce(DataFrame.unionAll, out)


def similar(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, nodes: DataFrame, distance: int, verify: tuple[int, int, float], scratch: Scratch) -> DataFrame:
    """(u, v): links between nodes (fp, rep, signature, words, need, least) of ``rows``, rep being the set's key, that join all of
    a Jaccard similarity of verify[2] or more and no others. The table ``rows`` is deleted once it has been read."""
    shingle, bits, least = verify
    found = links(nodes, distance, scratch, bits, least)
    pairs = scratch.put("pairs", found.distinct())
    scratch.drop(*[n for n in scratch.schemas if n.startswith("linked")])

    def sets_of(keys: DataFrame) -> DataFrame:
        # Only texts that a sieve of the keys' least ids lets pass are worked out and travel, one for each key and few others.
        held = sieve(nodes.join(keys.select(F.col("key").alias("rep")), "rep", "left_semi").select("least"))
        return shingle_sets(docs, id_col, text_col, shingle, held)

    # Sets are larger than texts, and each travels once a pair: the pairs are decided slice by slice.
    slices, found = max(1, ceil(pairs.count() / (PART * max(1, nodes.count())))), []
    for k in range(slices):
        mine = pairs.where(F.pmod(F.xxhash64("u", F.lit("slice")), F.lit(slices)) == k)
        needed = scratch.put(f"needed{k}", mine.select(F.col("u").alias("key")).unionAll(mine.select("v")).distinct())
        sets = sets_of(needed).join(needed, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))
        sets = scratch.put(f"sets{k}", sets)
        a, b = (sets.select(F.col("key").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "uv")
        both = F.size(F.array_intersect("u_set", "v_set"))
        near = mine.join(a, "u").join(b, "v").where(both + 1e-9 >= least * (F.size("u_set") + F.size("v_set") - both))
        found.append(scratch.put(f"near{k}", near.select("u", "v")))
        scratch.drop(f"needed{k}", f"sets{k}")
    near = reduce(DataFrame.unionAll, found)
    scratch.drop("pairs")
    # What the fingerprints joined is a group; links that they missed are looked for between groups alone.
    known = scratch.put("known", connected_components(near, scratch).toDF("key", "component"))
    group = F.coalesce("component", "key").alias("grp")
    # Heads of sets outside of any group, most of them, need no join.
    some = in_sieve(sieve(known.select("key")))
    heads = rows.where(some("key")).join(known, "key", "left").select("key", group, "head")
    heads = rows.where(~some("key")).select("key", F.col("key").alias("grp"), "head").unionAll(heads)
    open_ = overlap.suspects(heads, nodes.select(F.col("rep").alias("key"), "need"), scratch)
    open_ = scratch.put("open", open_.join(known, "key", "left").select("key", group))
    scratch.drop("rows")
    sets = sets_of(open_).join(open_, "key").groupBy("key").agg(F.first("grp").alias("grp"), F.first("shingles").alias("shingles"))
    further = overlap.links(scratch.put("sets", sets), least, scratch)
    scratch.drop("open", "sets", *[f"near{k}" for k in range(slices)])
    return known.select(F.col("key").alias("u"), F.col("component").alias("v")).unionAll(further)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, verify: tuple | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest id reachable by links. With a least similarity
    ``docs`` is read three times, so a text must have the same id each time."""
    scratch = Scratch(docs.sparkSession, "simhash")
    many = [F.min("doc_id").alias("least"), F.count("*").alias("n")]
    if verify and len(verify) == 3:
        rows = scratch.put("rows", keyed(docs, id_col, text_col, shingle, verify[0], verify[2]))
        # A node is a set of shingles; rows that share it may differ in their fingerprints, of which the least counts.
        first = F.min(F.struct("fp", *WIDE_BITS)).alias("w")
        nodes = rows.groupBy("key", *SIGNATURE).agg(first, F.min("need").alias("need"), *many).select(F.col("key").alias("rep"), *SIGNATURE, "w.*", "need", "least", "n")
        nodes = scratch.put("nodes", nodes)
        told = scratch.put("ids", rows.select("doc_id", "fp", F.col("key").alias("rep")))
        return _told(told, nodes, similar(docs, id_col, text_col, rows, nodes, distance, verify, scratch), scratch)
    rows = scratch.put("rows", fingerprints(docs, id_col, text_col, shingle, verify[0] if verify else None))
    # A node is a fingerprint, or a fingerprint and a signature.
    more = [c for c in SIGNATURE if c in rows.columns]
    rows = rows.withColumn("rep", F.xxhash64("fp", *more) if more else F.col("fp"))
    nodes = scratch.put("nodes", rows.groupBy("rep", "fp", *more).agg(*many))
    return _told(rows, nodes, links(nodes, distance, scratch, verify[1] if verify else None), scratch)


def _told(rows: DataFrame, nodes: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, fp, rep) with their component's smallest id; nodes without ids join others all the same."""
    found = scratch.put("components", connected_components(linked, scratch).toDF("rep", "component"))
    least = found.join(nodes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("c"))
    of_node = found.join(least, "component").select("rep", "c")
    # Only nodes of several rows, or with links, change an id; both inputs of the join are scans.
    told = nodes.join(of_node, "rep", "left").select("rep", F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("c")).alias("c"), "n", F.col("c").isNotNull().alias("linked"))
    told = scratch.put("told", told.where("n > 1 or linked").select("rep", "c"))
    return rows.join(told, "rep", "left").select("doc_id", "fp", F.coalesce("c", "doc_id").alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
