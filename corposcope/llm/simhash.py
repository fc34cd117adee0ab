"""Near-duplicate documents by SimHash and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 21, 21 and 22 bits. A
segment, padded to 23 bits, is decoded with the perfect binary Golay code
(23, 12): every word lies within 3 bits of exactly one codeword. Its keys are
the indices of all codewords within 4 bits, which is the decoded one alone, or
for a word at distance 3 the decoded one and five more. Two segments that
differ in at most one bit always share a key: the codeword of the one is at
most 4 bits from the other.

With at most 3 differing bits over three segments one of two cases holds.

* Every segment differs in at most one bit: all three share a Golay key.
* One segment differs in two or three bits: of the other two, one is equal and
  one differs in at most one bit.

So a fingerprint gets keys of the first kind (a Golay key for each of the three
segments) and of the second kind (for each ordered pair of segments, the first
one's bits and a Golay key of the second one). They hold 33 bits or more, so
the lists behind a key stay short. Every pair within 3 bits meets under a key;
pairs that meet are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.llm.common import durable, plain_name

SEGMENTS = ((0, 21), (21, 21), (42, 22))
RADIUS = 3
# The generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


# Signatures of word shingles: so many least hashes, of which bands of so many rows are keys.
HASHES, BANDS, ROWS = 128, 14, 5
_SEEDS = np.random.default_rng(20).integers(0, 2**63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each word shingle of UTF-8 ``text``; of the whole sequence where there are fewer words."""
    words = text.lower().split()  # on bytes: A-Z alone is lowered, and the six ASCII blanks part words
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: -width + 1].tolist() if width > 1 else starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def signature(every: np.ndarray) -> bytes:
    """Of a set of shingle hashes: band keys (8 bytes each), then two bits of each least hash, all first bits before all second ones."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(every), 2048):
        np.minimum(least, (every[i : i + 2048, None] * _SEEDS[0] + _SEEDS[1]).min(axis=0), out=least)
    keys = b"".join(xxhash.xxh64_digest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS))
    low = (least >> np.uint64(32)).astype(np.uint8)
    return keys + np.packbits(np.concatenate((low & 1, low >> 1 & 1))).tobytes()


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the word shingles of UTF-8 ``text``, as an unsigned 64-bit integer."""
    return folded(shingle_hashes(text, width))


def folded(hashes: list[int]) -> int:
    """The bits set in over half of ``hashes``; 0 without any."""
    if not hashes:
        return 0
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.array(hashes[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int, name: str) -> DataFrame:
    """``docs`` with the long column ``name``: the fingerprint of its text (null text: 0)."""

    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(bytes(t) if t is not None else b"", width) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(name, F.pandas_udf(of, "long")(F.col("text").cast("binary")))


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns to take off, and how many there are.

    A word's codewords within 4 bits are the word minus each of these patterns;
    the first is the coset leader.
    """
    one = np.int64(1)

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
        return x

    bits = one << np.arange(23)
    patterns = [np.zeros(1, np.int64)]
    last, top = np.zeros(1, np.int64), np.full(1, -1)
    for _ in range(4):  # all patterns of weight 1, 2, 3, 4
        grown = [(p | bits[b], b) for p, t in zip(last.tolist(), top.tolist(), strict=True) for b in range(t + 1, 23)]
        last, top = np.array([g[0] for g in grown], np.int64), np.array([g[1] for g in grown])
        patterns.append(last)
    every = np.concatenate(patterns)
    of = syndrome(every)
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for p, s in zip(every.tolist(), of.tolist(), strict=True):
        table[s, count[s]] = p
        count[s] += 1
    return table, count


_TABLES: list[np.ndarray] = []


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: up to six 12-bit codeword indices, and how many of them count."""
    if not _TABLES:
        table, count = _golay_tables()
        remainder = np.arange(1 << 23, dtype=np.int32)
        for bit in range(22, 10, -1):
            np.bitwise_xor(remainder, GENERATOR << (bit - 11), out=remainder, where=(remainder >> bit & 1).astype(bool))
        _TABLES.extend((table, count, remainder.astype(np.int16)))
    table, count, remainder = _TABLES
    s = remainder[segment]
    return (segment[:, None] ^ table[s]) >> 11, count[s]


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of every key of every fingerprint (unsigned 64-bit)."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    golay = [golay_keys(p) for p in parts]
    position = np.arange(len(fingerprints))
    keys, owners = [], []

    def add(kind: int, key: np.ndarray, valid: np.ndarray) -> None:
        keys.append((key | (kind << 59))[valid])
        owners.append(np.broadcast_to(position.reshape((-1,) + (1,) * (key.ndim - 1)), key.shape)[valid])

    six = np.arange(6)
    ok = [six < n[:, None] for _, n in golay]
    (a, _), (b, _), (c, _) = golay
    add(0, a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :], ok[0][:, :, None, None] & ok[1][:, None, :, None] & ok[2][:, None, None, :])
    kind = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, parts[i][:, None] << 12 | golay[j][0], ok[j])
                kind += 1
    return np.concatenate(keys), np.concatenate(owners)


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the members (distinct fingerprints) linked within ``radius`` bits.

    Grown from a frontier: each step compares one fingerprint with those not
    reached yet, so at most len - 1 edges leave and memory stays linear.
    """
    edges, rest = [], members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                frontier += list(found)
                rest = rest[~near]
    return edges


def _candidate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(all_fps), 2000):
            fps = all_fps[i : i + 2000]
            keys, owners = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owners].view(np.int64))], ["key", "fp"])


def _verified(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; the last key of a batch waits for the next one."""
        held_key, held = None, []

        def edges_of(groups: list[np.ndarray], pairs: np.ndarray | None = None) -> pa.RecordBatch:
            found = [e for g in groups for e in _forest(g, radius)]
            both = np.array(found, dtype=np.uint64).reshape(-1, 2)
            if pairs is not None:  # lists of two, all at once
                both = np.concatenate((both, pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]))
            both = both.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            groups = []
            if held_key is not None and keys[0] == held_key:
                held.append(fps[: ends[0]].copy())
                starts, ends = starts[1:], ends[1:]
                if not len(starts):
                    continue
            if len(held) > 1 or held and len(held[0]) > 1:
                groups.append(np.unique(np.concatenate(held)))
            sizes, first = ends[:-1] - starts[:-1], starts[:-1]
            groups += [fps[starts[i] : ends[i]] for i in np.flatnonzero(sizes > 2)]
            two = first[sizes == 2]
            held_key, held = keys[starts[-1]], [fps[starts[-1] :].copy()]
            yield edges_of(groups, np.stack((fps[two], fps[two + 1]), axis=1))
        if held:
            yield edges_of([np.unique(np.concatenate(held))])

    return run


def _alike(marks: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of the shingle sets behind rows of ``marks`` with that behind ``one``; unequal hashes agree in two bits one time in four."""
    apart = marks ^ one
    half = marks.shape[1] // 2
    differing = np.bitwise_count(apart[:, :half] | apart[:, half:]).sum(axis=1)
    return 1 - differing / HASHES / 0.75


def _proposals(ids: np.ndarray, marks: np.ndarray, least: float, stand_in: float, tries: int) -> tuple[list[tuple[int, int]], np.ndarray, bool]:
    """Pairs of members (sorted by id) that may be alike, which members still stand for themselves, and whether a comparison was left out.

    Grown from a frontier: each step compares one member with those that want
    partners yet. A member has enough with ``tries`` of them, or with one
    estimated at ``stand_in`` or more, which then stands for it in other steps. So
    at most ``tries`` pairs a member leave, and memory stays linear.
    """
    pairs, rest = [], np.arange(len(ids))
    had, kept, cut = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), False
    while len(rest) > 1:
        frontier = [rest[0]]
        while frontier and len(rest):
            x = frontier.pop()
            rest = rest[rest != x]
            like = _alike(marks[rest], marks[x])
            found = rest[like >= least]
            pairs += [(int(ids[x]), int(ids[y])) for y in found]
            frontier += list(found[had[found] == 0])
            had[found] += 1
            same = like >= stand_in
            kept[rest[same]] = False
            stay = ~(same | (had[rest] >= tries))
            cut |= not stay.all() and len(rest) > 1
            rest = rest[stay]
    return pairs, kept, cut


SIMILAR_SCHEMA = "key long, a long, b long, marks binary"


def _similar_rows(least: float, stand_in: float, tries: int, fresh: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs (key null), members (b null) of lists by key, and keys (marks null too) of lists in which a comparison was left out.

    ``fresh``: rows (id, sig) get their band keys, and lists are thinned within
    a batch, before the shuffle, so a key that very many rows share leaves few.
    Otherwise rows come sorted by key; lists are read as a stream, and of those
    read only the kept members stay in memory.
    """

    def lists(key: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list, bool]]:
        order = np.lexsort((ids, key))
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for at in np.split(order, cuts):
            pairs, kept, cut = _proposals(ids[at], marks[at], least, stand_in, tries) if len(at) > 1 else ([], np.ones(1, bool), False)
            yield int(key[at[0]]), at, kept, pairs, cut or not kept.all()  # who does not stand for itself meets nobody of other batches

    def frame(keys: list[np.ndarray], ids: list[np.ndarray], marks: list[bytes], pairs: list[tuple[int, int]], cut: list[int]) -> pd.DataFrame:
        n, m, k = sum(map(len, keys)), len(pairs), len(cut)
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "key": pd.Series([*np.concatenate([np.zeros(0, np.int64), *keys]).tolist(), *[None] * m, *cut], dtype="Int64"),
            "a": np.concatenate([*ids, both[:, 0], np.zeros(k, np.int64)]).astype(np.int64),
            "b": pd.Series([*[None] * n, *both[:, 1].tolist(), *[None] * k], dtype="Int64"),
            "marks": [*marks, *[None] * (m + k)],
        })

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            every = f["id"].to_numpy(np.int64)
            raw = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(len(f), -1)
            band, marks = raw[:, : 8 * BANDS].copy().view(">i8").astype(np.int64), raw[:, 8 * BANDS :].copy().view(np.uint64)
            whole = [m.tobytes() for m in marks]
            for i in range(BANDS):
                keys, ids, sent, found, less = [], [], [], [], []
                for key, at, kept, pairs, cut in lists(band[:, i], every, marks):
                    found += pairs
                    less += [key] * cut
                    keys.append(np.full(kept.sum(), key, np.int64))
                    ids.append(every[at[kept]])
                    sent += [whole[j] for j in at[kept]]
                yield frame(keys, ids, sent, found, less)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            if not len(f):
                continue
            key, ids = f["key"].to_numpy(np.int64), f["a"].to_numpy(np.int64)
            marks = np.frombuffer(b"".join(f["marks"]), np.uint64).reshape(len(f), -1)
            if held is not None and held[0][0] == key[0]:
                key, ids, marks = (np.concatenate(x) for x in zip(held, (key, ids, marks), strict=True))
            found, less = [], []
            for k, at, kept, pairs, cut in lists(key, ids, marks):
                found += pairs
                less += [k] * cut
                last = at[kept]
            held = (key[last], ids[last], marks[last].copy())
            yield frame([], [], [], found, less)

    return begin if fresh else finish


#: How far below the similarity asked for an estimate may lie.
MARGIN = 0.12


def proposed_pairs(signatures: DataFrame, similarity: float, stand_in: float = 0.95, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets that may be alike, from (id, sig), and the keys of the lists in which comparisons were left out (see ``left_out``).

    Signatures that agree in a band meet; at 0.8 a pair shares one with
    probability 0.996. Proposed are those whose estimate, from two bits of 128
    hashes with a standard error of 0.04 at 0.8, is at most ``MARGIN`` below
    ``similarity``. Pairs are proposals: ``similar_classes`` verifies them.
    """
    first = durable(signatures.mapInPandas(_similar_rows(similarity - MARGIN, stand_in, tries, True), SIMILAR_SCHEMA))
    met = first.filter("marks IS NOT NULL").repartition("key").sortWithinPartitions("key")
    later = durable(met.mapInPandas(_similar_rows(similarity - MARGIN, stand_in, tries, False), SIMILAR_SCHEMA).select("key", "a", "b"))
    both = first.filter("marks IS NULL").select("key", "a", "b").unionByName(later)
    return both.filter("b IS NOT NULL").select("a", "b"), both.filter("b IS NULL").select("key").distinct()


# Members of a list outside its largest class, of which about so many are held at a time, with sets of about so many bytes.
CELL, CELL_BYTES = 1024, 1 << 24


def _as_like(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` are ``similarity`` alike or more with ``one``: sorted sets, none of them empty."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    hits = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    common = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
    return common >= similarity * (len(one) + sizes - common) - 1e-9


def _class_links(similarity: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of a spanning forest between the classes of each cell, from rows sorted by key and cell, those to hold first.

    A row meets all held ones of other classes, estimated by marks and then verified by the sets. A link makes one class of two,
    so of a cell fewer links leave than it has classes, however many of its members are alike or nearly so.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, roots, marks, sets, joined = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES // 32), np.uint64), [], {}

        def class_of(root: int) -> int:
            while root in joined:
                root = joined[root]
            return root

        for f in frames:
            found = []
            for place, rows in f.groupby(["key", "cell"], sort=False):
                if place != last:
                    last, ids, roots, marks, sets, joined = place, ids[:0], roots[:0], marks[:0], [], {}
                new = rows["id"].to_numpy(np.int64), rows["root"].to_numpy(np.int64), np.frombuffer(b"".join(rows["marks"]), np.uint64).reshape(len(rows), -1)
                own, passing, before = [np.frombuffer(h, np.uint32) for h in rows["held"]], rows["passing"].to_numpy(bool), len(ids)
                ids, marks = (np.concatenate((x, y[~passing])) for x, y in zip((ids, marks), new[::2], strict=True))
                roots = np.concatenate((roots, np.fromiter(map(class_of, new[1][~passing].tolist()), np.int64)))
                sets += [x for x, p in zip(own, passing, strict=True) if not p]
                # held ones meet the earlier held ones, passing ones meet all held
                order, until = np.argsort(passing, kind="stable"), np.concatenate((np.arange(before, len(ids)), np.full(passing.sum(), len(ids))))
                for j, most in zip(order, until, strict=True):
                    mine = class_of(int(new[1][j]))
                    at = np.flatnonzero((_alike(marks[:most], new[2][j]) >= similarity - MARGIN) & (roots[:most] != mine))
                    if not len(at):
                        continue
                    for i in at[_as_like(own[j], [sets[i] for i in at], similarity)]:
                        if (theirs := int(roots[i])) != mine:
                            found.append((int(ids[i]), int(new[0][j])))
                            joined[theirs] = mine
                            roots[roots == theirs] = mine
            both = np.array(found, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": both.min(axis=1, initial=2**63 - 1), "b": both.max(axis=1, initial=-(2**63))})

    return run


def left_out(signatures: DataFrame, keys: DataFrame, roots: DataFrame, similarity: float, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) that lists by ``keys`` hold between different classes (node, root) and that may be alike: none is left out.

    Links within a class change nothing. So of a list only members outside its
    largest class have to meet others: these are dealt to cells by a hash of the
    id, about ``CELL`` to one, and held there while the list's other members
    pass. Work grows with such members times members, memory does not.

    With ``sets_of``, which gives (set_id, held) for set_ids, pairs are verified where they meet, and only those that
    a spanning forest between the classes of a cell needs are returned: rows grow with members, not with pairs.
    """
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.conv(F.hex(F.substring("sig", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    every = signatures.select("id", F.substring("sig", 8 * BANDS + 1, HASHES).alias("marks"), F.explode(F.array_distinct(bands)).alias("key"))
    classed = every.join(keys, "key", "left_semi").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = durable(classed)
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    cells = F.ceil(F.col("others") / CELL)
    if sets_of is not None:
        members = durable(members.join(sizes, "key", "left_semi"))
        sets = sets_of(members.select(F.col("id").alias("set_id")).distinct()).withColumnRenamed("set_id", "id")
        lengths = members.join(sizes, "key").filter("root != top").join(sets.select("id", F.octet_length("held").alias("length")), "id")
        sizes = sizes.join(lengths.groupBy("key").agg(F.sum("length").alias("bytes")), "key")
        cells = F.greatest(cells, F.ceil(F.col("bytes") / CELL_BYTES))
    met = members.join(sizes, "key").withColumn("cells", cells.cast("int")).withColumn("own", F.when(F.col("root") != F.col("top"), F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")))
    # A member outside the largest class passes its own cell and the later ones, so a pair meets once.
    passed = met.select("key", "id", "root", "marks", "own", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("cells") - 1)).alias("cell"))
    passed = passed if sets_of is None else passed.join(sets, "id")
    dealt = passed.withColumn("passing", (~F.col("cell").eqNullSafe(F.col("own"))).cast("int")).drop("own").repartition("key", "cell").sortWithinPartitions("key", "cell", "passing")
    if sets_of is not None:
        return dealt.mapInPandas(_class_links(similarity), "a long, b long").distinct()

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, roots, marks = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES // 32), np.uint64)
        for f in frames:
            for place, rows in f.groupby(["key", "cell"], sort=False):
                if place != last:
                    last, ids, roots, marks = place, ids[:0], roots[:0], marks[:0]
                new = rows["id"].to_numpy(np.int64), rows["root"].to_numpy(np.int64), np.frombuffer(b"".join(rows["marks"]), np.uint64).reshape(len(rows), -1)
                passing, before = rows["passing"].to_numpy(bool), len(ids)
                ids, roots, marks = (np.concatenate((x, y[~passing])) for x, y in zip((ids, roots, marks), new, strict=True))
                # held ones meet the earlier held ones, passing ones meet all held
                order, until = np.argsort(passing, kind="stable"), np.concatenate((np.arange(before, len(ids)), np.full(passing.sum(), len(ids))))
                found = []
                for j, most in zip(order, until, strict=True):
                    at = np.flatnonzero((_alike(marks[:most], new[2][j]) >= similarity - MARGIN) & (roots[:most] != new[1][j]))
                    found.append(np.stack((ids[at], np.full(len(at), new[0][j])), axis=1))
                both = np.concatenate(found)
                yield pd.DataFrame({"a": both.min(axis=1, initial=2**63 - 1), "b": both.max(axis=1, initial=-(2**63))})

    return dealt.mapInPandas(pairs, "a long, b long").distinct()


def _shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _set_id(every: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(every.tobytes()) - (1 << 63)


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, most_keys: int) -> DataFrame:
    """(set_id, held): 32 bits of each hash, in order, of the ``wanted`` (set_id) of ``nodes`` (set_id, row), from the texts of docs (row, text)."""
    asked = durable(nodes.join(wanted, "set_id").select("set_id", "row"))
    rows = F.broadcast(asked) if asked.count() <= most_keys else asked  # else a shuffle join
    held = F.pandas_udf(lambda texts: texts.map(lambda t: np.unique(_shingle_set(bytes(t), width).astype(np.uint32)).tobytes()), "binary")
    return durable(docs.join(rows, "row").select("set_id", held(F.col("text").cast("binary")).alias("held")))


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, width: int, most_keys: int) -> DataFrame:
    """Those ``pairs`` (a, b) of ``nodes`` (set_id, row) whose sets are ``similarity`` alike or more, read from the texts of docs (row, text)."""
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    sets = shingle_sets(docs, nodes, ends, width, most_keys)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            return common >= similarity * (len(both) - common) - 1e-9
        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    first, second = sets.select(F.col("set_id").alias("a"), F.col("held").alias("held_a")), sets.select(F.col("set_id").alias("b"), F.col("held").alias("held_b"))
    # Few sizes fit: sets whose sizes differ too much are not alike, and are not compared.
    size = lambda c: F.octet_length(c)
    met = pairs.join(first, "a").join(second, "b").filter(F.least(size("held_a"), size("held_b")) >= similarity * F.greatest(size("held_a"), size("held_b")) - 1e-9)
    return met.filter(alike("held_a", "held_b")).select("a", "b")


def similar_classes(docs: DataFrame, similarity: float, width: int = 5, most_keys: int = 1_000_000) -> DataFrame:
    """(row, doc_id, class) from (row, doc_id, text): texts linked where their sets of ``width``-word shingles are ``similarity`` alike or more.

    Texts of equal sets are one node. Pairs are proposed by fingerprints (the
    Golay keys, 3 bits) and by ``proposed_pairs``; each is verified by the
    sets themselves, of whose hashes 32 bits are compared, so no link is below
    ``similarity``. What a list leaves out because a text has partners enough is
    compared and verified afterwards, between classes alone (``left_out``). class is the least row of the nodes reached; row has to tell
    rows apart. Texts without words have the empty set and are alike.
    """
    schema = "fp long, set_id long, sig binary"

    @F.pandas_udf(schema)
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = shingle_hashes(bytes(t) if t is not None else b"", width)
            every = np.unique(np.array(hashes, np.uint64))
            out.append((int(np.uint64(folded(hashes)).view(np.int64)), _set_id(every), signature(every) if len(every) else None))
        return pd.DataFrame(out, columns=["fp", "set_id", "sig"])

    marked = durable(docs.select("row", "doc_id", marks(F.col("text").cast("binary")).alias("m")).select("row", "doc_id", "m.*"))
    nodes = durable(marked.filter("sig IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("row"), F.first("sig").alias("sig")))
    prints = durable(marked.filter("sig IS NOT NULL").select("fp", "set_id").distinct())
    one = prints.groupBy("fp").agg(F.min("set_id").alias("one"))
    near = fingerprint_edges(prints.select("fp").distinct(), RADIUS)
    left, right = one.select(F.col("fp").alias("a"), F.col("one").alias("x")), one.select(F.col("fp").alias("b"), F.col("one").alias("y"))
    by_print = near.join(left, "a").join(right, "b").select("x", "y").unionByName(prints.join(one, "fp").select(F.col("one").alias("x"), F.col("set_id").alias("y")))
    signatures = nodes.select(F.col("set_id").alias("id"), "sig")
    by_bands, cut = proposed_pairs(signatures, similarity)
    met = by_print.unionByName(by_bands.select(F.col("a").alias("x"), F.col("b").alias("y")))
    pairs = durable(met.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = durable(similar_pairs(docs, nodes, pairs, similarity, width, most_keys))
    roots = durable(connected_components(links))
    # What lists left out is made up for between the classes found so far.
    more = durable(left_out(signatures, cut, roots, similarity, lambda wanted: shingle_sets(docs, nodes, wanted, width, most_keys)))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    roots = roots.withColumnRenamed("node", "set_id")
    sized = marked.select("row", "doc_id", "set_id").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = nodes.select("set_id", "row").unionByName(marked.filter("sig IS NULL").groupBy("set_id").agg(F.min("row").alias("row")))
    named = least.join(roots, "set_id", "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("row").alias("class"))
    return sized.join(named, "root").select("row", "doc_id", "class")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of undirected ``edges`` (a, b: long); root is the least node reached.

    Alternates the large-star and small-star steps until nothing changes; each
    round is a written table. Steps need a least neighbour for each node, which
    is aggregated before the shuffle, and a join on the node, which Spark splits
    where a node has very many neighbours.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Links each larger neighbour (and, in the symmetric form, every one) to the least of its set."""
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return pairs.join(least, "a")

    links = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = durable(links)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now every link runs from a larger node to a smaller one; small-star ties each node's smaller ones together.
        small = star(large)
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        links = durable(small)
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = seen


def fingerprint_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) of the different fingerprints ``fp``, of a spanning forest of each key's list."""
    # The keys of a fingerprint are near two hundred; few partitions of fingerprints would make few long tasks.
    dealt = distinct.repartition("fp")
    keys = dealt.mapInArrow(_candidate_keys, "key long, fp long")
    # A key's list comes together sorted and is read as a stream; only one list is in memory.
    met = keys.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_verified(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` without its text, with ``fp`` (long) and ``component_id`` (long).

    Texts are linked when their fingerprints differ in at most ``radius`` (at
    most 3) bits; ``component_id`` is the least doc_id reached over links.
    Equal fingerprints are one node, so copies cost one row each however many
    there are. Null and empty texts have fingerprint 0 and are linked like any
    other. A very long text is hashed whole, in memory of some times its size. Rows that repeat a doc_id keep a row each. A null doc_id never
    becomes a component_id unless the whole component has none. An empty table
    gives an empty result. Other columns are kept; of a clash with ``fp`` or
    ``component_id`` the operator's own column wins.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the Golay keys guarantee 3 differing bits at most")
    rest = [c for c in docs.columns if c not in ("text", "fp", "component_id")]
    marked = durable(with_fingerprints(docs.select(*(f"`{c}`" for c in rest), "text"), width, "fp").drop("text"))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_edges(distinct.select("fp"), radius))
    least = (
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    label = least.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = least.join(label, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp", "left")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, most_keys: int = 500_000) -> DataFrame:
    """``docs`` with one document of each class of texts alike (see ``similar_classes``): the one of the least doc_id, null last.

    Of rows that share it the one of the least hash of all columns stays; rows equal in all
    columns are one row. A class without any doc_id keeps one row too. Null and
    empty texts are alike. An empty table stays empty; all columns pass.
    """
    columns = docs.columns
    tag = plain_name(docs, "row_key")
    # The order of rows: doc_id, null last, then a hash of all columns.
    keyed = docs.withColumn(tag, F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in columns)).alias("h")))
    found = durable(similar_classes(keyed.select(F.col(tag).alias("row"), "doc_id", "text"), similarity, width))
    others = found.filter("row != class").select(F.col("row").alias(tag)).distinct()
    same = [F.col(f"d.{tag}.{c}").eqNullSafe(F.col(f"o.{tag}.{c}")) for c in ("last", "id", "h")]
    # Texts stay where they are while the list of rows that go is small; beyond that both sides are shuffled.
    left = keyed.alias("d").join((F.broadcast(others) if others.count() <= most_keys else others).alias("o"), same, "left_anti")
    if not found.filter("row = class").groupBy("row").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([tag])
    return left.select(*(f"`{c}`" for c in columns))
