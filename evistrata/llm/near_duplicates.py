"""Texts that share most of their content (problem 5).

Texts are compared as sets of word shingles by the Jaccard index. Equal sets are one class from the start.
Each class gets minhash values: their low bits are its fingerprint, and triples of them are the bands by
which classes meet. Within a band, tiles of at most TILE classes, ordered by set size, are compared
exactly with exclusive-or and bit counts of fingerprints: tile pairs, and pairs, are skipped when the
population counts of their sets differ beyond the radius that the threshold leaves. What is within the
fingerprints' radius is checked on the whole texts.

Of two sets of Jaccard index J a band of R minhashes agrees with chance J^R. With 32 bands of 3, a pair
at 0.6 is missed with chance 4e-4, at 0.65 with 3e-5, at 0.7 with 2e-6; a fingerprint of 192 bits is over
the radius with chance below 1e-6 at 0.6.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evistrata.session import materialize, release

BANDS, ROWS, BITS = 32, 3, 192
#: Standard deviations that the fingerprint radius lies above the mean distance at the threshold.
SAFETY = 5.0
#: Classes of a tile; larger bands are cut into tiles that are compared by tasks of their own.
TILE = 1_024
#: Keys of a block, as classes are written as all pairs.
DEALT = 256
#: Bytes of shingle sets that are held at once as candidate pairs are checked.
HELD = 32 << 20

_U = np.uint64
#: Columns of a fingerprint, 64 bits each.
PRINT = [f"f{i}" for i in range(BITS // 64)]
_PRINT = ", ".join(f"{f} long" for f in PRINT)


@functools.cache
def _word_characters() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_250_101)
    n = max(BANDS * ROWS, BITS)
    return rng.integers(1, 1 << 63, n, dtype=np.int64).astype(_U) | _U(1), rng.integers(0, 1 << 63, n, dtype=np.int64).astype(_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted hashes of 40 bits, one text after another, and how many each has.

    Words are maximal runs of letters and digits of the lower-cased text. All texts go through the same
    few array operations: characters are classified by a table, word hashes are sums over characters
    that depend on their place in the word.
    """
    low = [t.lower() if t else "" for t in texts]
    joined = "\n".join(low) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_characters()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, ends - starts)
    letter = _mix(codes[at].astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U) * _U(0xD1B54A32D192ED03))
    first = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    word = _mix(np.add.reduceat(letter, first) + (ends - starts).astype(_U))
    borders = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    text_of = np.searchsorted(borders, starts, side="right")
    n = len(word) - words + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    shingle = np.zeros(n, _U)
    for k in range(words):
        shingle = _mix(shingle * _U(3) + word[k : k + n])
    same = text_of[:n] == text_of[words - 1 :]
    shingle, owner = shingle[same] >> _U(24), text_of[:n][same]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], np.bincount(owner[new], minlength=len(texts))


def packed(shingles: np.ndarray) -> bytes:
    """Hashes of 40 bits as five bytes each; ``unpacked`` gives them back."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    wide = np.zeros((len(stored) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(stored, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty set: a hash of the set, its fingerprint as 64-bit words, and its band hashes."""
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, _U), np.zeros((0, BITS // 64), _U), np.zeros((0, BANDS), _U)
    first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    whole = _mix(np.add.reduceat(_mix(shingles), first) ^ (sizes[full].astype(_U) * _U(0x9E3779B97F4A7C15)))
    factors, terms = _numbers()
    bits = np.zeros((len(full), BITS), bool)
    bands = np.zeros((len(full), BANDS), _U)
    for k in range(max(BANDS * ROWS, BITS)):
        least = np.minimum.reduceat((shingles ^ terms[k]) * factors[k] >> _U(16), first)
        if k < BITS:
            bits[:, k] = _mix(least) & _U(1)
        if k < BANDS * ROWS:
            bands[:, k // ROWS] = _mix(bands[:, k // ROWS] * _U(5) + least + _U(k // ROWS))
    return whole, np.packbits(bits, axis=1).view(_U), bands


def radius(threshold: float) -> int:
    """Fingerprint distance within which a pair at the threshold lies but for a chance below 1e-6."""
    p = (1 - threshold) / 2
    return int(BITS * p + SAFETY * (BITS * p * (1 - p)) ** 0.5)


def population(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints).sum(1, dtype=np.int64)


def tile_pairs(n_a, fp_a, n_b, fp_b, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of close pairs of two tiles, each ordered by set size.

    The distance of two fingerprints is no less than the difference of their population counts, so tiles
    whose counts differ beyond the radius are skipped. Likewise sets of sizes x <= y have a Jaccard index
    of at most x / y, so rows meet only a slice of the other tile, and tiles too far apart do not meet.
    """
    most = radius(threshold)
    if not len(n_a) or not len(n_b) or n_a[-1] < threshold * n_b[0] or n_b[-1] < threshold * n_a[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pop_a, pop_b = population(fp_a), population(fp_b)
    if pop_a.min() > pop_b.max() + most or pop_b.min() > pop_a.max() + most:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = [], []
    low = np.searchsorted(n_b, np.ceil(threshold * n_a - 1e-9), side="left")
    high = np.searchsorted(n_b, np.floor(n_a / threshold + 1e-9), side="right")
    for i in range(len(n_a)):
        a, b = (max(low[i], i + 1) if same else low[i]), high[i]
        if a < b:
            near = np.bitwise_count(fp_a[i] ^ fp_b[a:b]).sum(1) <= most
            if near.any():
                found = np.flatnonzero(near) + a
                left.append(np.full(len(found), i))
                right.append(found)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


_BAND = pa.schema([("band", pa.int64()), ("n", pa.int32()), ("id", pa.int64()), *((f, pa.int64()) for f in PRINT)])
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int64()), ("tile", pa.int32()), ("n", pa.int32()), *((f, pa.int64()) for f in PRINT)])


def _arrays(batch) -> tuple[np.ndarray, ...]:
    band, n, ids, *prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return band, n, ids, np.stack([f.view(_U) for f in prints], 1)


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    pair = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    none = lambda kind: pa.nulls(len(pair), kind)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64()), *(none(f.type) for f in list(_MET)[2:])], schema=_MET)


def _meet(threshold: float):
    """Over rows ordered by band and size: close pairs of small bands; rows of large ones, by tile."""
    most = radius(threshold)

    def small(band, n, ids, fp) -> pa.RecordBatch:
        # Each run is one tile that meets itself. All runs at once: each row against the one o places on.
        left, right, pop = [], [], population(fp)
        for o in range(1, len(band)):
            same = np.flatnonzero(band[o:] == band[:-o])
            if not len(same):
                break
            same = same[n[same] >= threshold * n[same + o] - 1e-9]  # ordered by size within the band
            same = same[np.abs(pop[same] - pop[same + o]) <= most]
            near = np.bitwise_count(fp[same] ^ fp[same + o]).sum(1) <= most
            left.append(ids[same[near]])
            right.append(ids[same[near] + o])
        return _pairs_batch(np.concatenate(left), np.concatenate(right)) if left else _pairs_batch(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = dealt = 0  # rows held; rows of the band that is being dealt out as tiles

        def deal(band, n, ids, fp, start: int) -> pa.RecordBatch:
            tile = ((start + np.arange(len(band))) // TILE).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(band), pa.array(tile), pa.array(n, pa.int32()), *(pa.array(f.copy().view(np.int64)) for f in fp.T)], schema=_MET
            )

        def flush(parts, final: bool):
            nonlocal held, size, dealt
            band, n, ids, fp = (np.concatenate([p[i] for p in parts]) for i in range(4))
            at = 0
            if dealt and len(band):  # goes on with the large band of before
                end = int(np.searchsorted(band != held_band[0], True)) if (band != held_band[0]).any() else len(band)
                if end:
                    yield deal(band[:end], n[:end], ids[:end], fp[:end], dealt)
                    dealt += end
                at = end
                if end < len(band):
                    dealt = 0
            rest = slice(at, None)
            band, n, ids, fp = band[rest], n[rest], ids[rest], fp[rest]
            if not len(band):
                held, size = [], 0
                return
            runs = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
            last = runs[-2]
            end = len(band) if final or len(band) - last >= TILE else last
            lengths = np.diff(runs)
            large = lengths > TILE
            if end == len(band) and not final:
                large[-1] = True  # may go on, so it is dealt out
            keep = np.repeat(~large, lengths)
            keep[end:] = False
            if keep.any():
                yield small(band[keep], n[keep], ids[keep], fp[keep])
            for r in np.flatnonzero(large):
                a, b = runs[r], min(runs[r + 1], end)
                if a < b:
                    yield deal(band[a:b], n[a:b], ids[a:b], fp[a:b], 0)
            if end == len(band) and not final:
                held_band[0], dealt = band[-1], int(lengths[-1])
                held, size = [], 0
            else:
                held = [(band[end:], n[end:], ids[end:], fp[end:])] if end < len(band) else []
                size = len(band) - end

        held_band = [0]
        for batch in batches:
            if batch.num_rows:
                held.append(_arrays(batch))
                size += batch.num_rows
                if size >= 65_536:
                    yield from flush(held, False)
        if held:
            yield from flush(held, True)

    return run


def near_duplicates(texts: DataFrame, *, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Close pairs of classes, and the classes of all texts.

    ``texts`` has ``kind``, ``key`` and ``text``; only texts of one kind are compared. Returns

    * pairs ``kind, a, b, similarity`` of class ids whose Jaccard index is ``threshold`` or more, all of
      them, each once (a < b);
    * members ``kind, key, id``: the class of each text.

    Defined cases: texts without a shingle (null, empty, under ``words`` words) are members of no class and
    in no pair; rows without a key are left out; a repeated key is one member; if its rows have different
    texts, it is a member of each of their classes.
    """
    rows = texts.where(F.col("key").isNotNull()).select(F.col("kind").cast("string"), F.col("key").cast("string"), F.col("text").cast("string"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                shingles, sizes = shingle_sets(part.column(2).to_pylist(), words)
                whole, prints, bands = signatures(shingles, sizes)
                full = pa.array(np.flatnonzero(sizes))
                offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS)
                sets = np.split(shingles, np.cumsum(sizes[sizes > 0])[:-1]) if len(full) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(full), part.column(1).take(full), pa.array(whole.view(np.int64)), pa.array(sizes[sizes > 0].astype(np.int32)),
                        *(pa.array(f.copy().view(np.int64)) for f in prints.T),
                        pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64))),
                        pa.array([packed(s) for s in sets], pa.binary()),
                    ],
                    ["kind", "key", "sethash", "n", *PRINT, "bands", "shingles"],
                )

    signed = rows.mapInArrow(sign, f"kind string, key string, sethash long, n int, {_PRINT}, bands array<long>, shingles binary")
    signed = signed.withColumn("id", F.xxhash64("kind", "sethash", "n"))
    signed = materialize(signed.select("kind", "key", "id", "n", *PRINT, "bands", "shingles"))
    members = signed.select("kind", "key", "id").distinct()
    # Equal sets have equal bands, so one row of each goes on; copies collapse in each task before the shuffle.
    single = signed.select("kind", "id", "n", *PRINT, "bands").dropDuplicates(["id"])
    salted = single.select(
        F.explode(F.transform("bands", lambda b: F.xxhash64("kind", b))).alias("band"), "n", "id", *PRINT
    )
    met = salted.repartition("band").sortWithinPartitions("band", "n").mapInArrow(_meet(threshold), f"a long, b long, band long, tile int, n int, {_PRINT}")
    met = materialize(met)
    candidates = met.where("band IS NULL").select("a", "b").union(_tiles(met.where("band IS NOT NULL"), threshold)).distinct()
    return _verified(materialize(candidates), signed, threshold), members


def _tiles(dealt: DataFrame, threshold: float) -> DataFrame:
    """Close pairs of large bands: every pair of tiles of a band whose sizes allow it, a task each."""
    ends = dealt.groupBy("band", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = ends.select("band", F.col("tile").alias("tile_b"), F.col("least").alias("least_b"), F.col("most").alias("most_b"))
    # Rows here are tiles, not texts. Tile pairs beyond the radius are skipped before any data moves.
    met = ends.join(other, "band").where("tile <= tile_b").where((F.col("most") >= threshold * F.col("least_b")) & (F.col("most_b") >= threshold * F.col("least")))
    sides = met.select("band", F.explode(F.array(F.struct(F.col("tile").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("tile_b").alias("tile"), F.lit(1).alias("side")))).alias("s"), F.col("tile").alias("ta"), F.col("tile_b").alias("tb"))
    sides = sides.select("band", "ta", "tb", "s.tile", "s.side").distinct()
    rows = dealt.withColumnRenamed("a", "id").join(sides, ["band", "tile"]).select("band", "ta", "tb", "side", "n", "id", *PRINT)

    def compare(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        same = group["ta"][0].as_py() == group["tb"][0].as_py()
        n, ids = group["n"].to_numpy(), group["id"].to_numpy()
        fp = np.stack([group[f].to_numpy().view(_U) for f in PRINT], 1)
        parts = []
        for s in (0, 0 if same else 1):
            mine = np.flatnonzero(side == s)
            mine = mine[np.argsort(n[mine], kind="stable")]
            parts.append((n[mine], ids[mine], fp[mine]))
        (na, ia, fa), (nb, ib, fb) = parts
        left, right = tile_pairs(na, fa, nb, fb, threshold, same)
        found = _pairs_batch(ia[left], ib[right])
        return pa.table({"a": found.column(0), "b": found.column(1)})

    return rows.groupBy("band", "ta", "tb").applyInArrow(compare, "a long, b long")


def _verified(candidates: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The exact Jaccard index of candidate pairs (a, b), from the shingle sets of the whole texts.

    Pairs are gathered around the least class that their ends are candidates with, so the classes of a
    family of near-equal texts go to one place, each once, not once a pair. A gathering of more than TILE
    classes, or of more than HELD bytes of sets, is dealt into parts by hash and its pairs to pairs of parts,
    so what is held at once is bounded.
    """
    least = candidates.union(candidates.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("home"))
    home = lambda x: least.select(F.col("a").alias(x), F.col("home").alias(f"home_{x}"))
    at = materialize(candidates.join(home("a"), "a").join(home("b"), "b").select("a", "b", F.least("home_a", "home_b").alias("home")))
    ends = at.select("home", F.explode(F.array("a", "b")).alias("id")).distinct()
    size = signed.select("id", "n").groupBy("id").agg(F.first("n").alias("n"))
    parts = ends.join(size, "id").groupBy("home").agg(F.greatest(F.ceil(F.sum(F.col("n").cast("long") * 8) / (HELD // 2)), F.ceil(F.count("*") / TILE)).cast("int").alias("parts"))
    part = lambda x: F.pmod(F.xxhash64(x), F.col("parts")).cast("int")
    placed = materialize(at.join(parts, "home").select("a", "b", F.xxhash64("home", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("place")))
    wanted = placed.select("place", F.explode(F.array("a", "b")).alias("id")).distinct()
    # Copies of a class collapse in each task before its set is moved.
    sets = signed.groupBy("id").agg(F.first("kind").alias("kind"), F.first("shingles").alias("shingles"))
    held = wanted.join(sets, "id").select("place", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "kind", "shingles")
    asked = placed.select("place", "a", "b", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("shingles"))
    both = held.union(asked).repartition("place").sortWithinPartitions("place", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kinds, known = None, {}, {}
        for batch in batches:
            out: list[tuple[str, int, int, float]] = []
            places, ids, others = (batch.column(i).to_pylist() for i in range(3))
            names, shingles = batch.column(3), batch.column(4)
            for i, (p, a, b) in enumerate(zip(places, ids, others)):
                if p != place:
                    place, kinds, known = p, {}, {}
                if b is None:
                    kinds[a], known[a] = names[i].as_py(), unpacked(shingles[i].as_py())
                    continue
                x, y = known[a], known[b]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and shared >= threshold * (len(x) + len(y) - shared):
                    out.append((kinds[a], a, b, shared / (len(x) + len(y) - shared)))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["kind", "a", "b", "similarity"])

    return both.mapInArrow(run, "kind string, a long, b long, similarity double")


def close_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``kind, key_a < key_b`` of all texts whose similarity reaches the threshold, copies included, each once.

    Classes of any size are written as all pairs. Their keys are dealt to blocks of about DEALT by hash;
    pairs of blocks are joined, so no row or task holds a class. The rows are quadratic in the largest
    class; ``duplicate_groups`` is the form with one row a text.
    """
    sizes = members.groupBy("kind", "id").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    blocks = materialize(members.join(sizes, ["kind", "id"]).groupBy("kind", "id", "blocks", block).agg(F.collect_list("key").alias("keys")))
    other = lambda n: blocks.select("kind", F.col("id").alias(n), F.col("block").alias(f"block_{n}"), F.col("keys").alias(f"keys_{n}"))

    several = blocks.where((F.col("blocks") > 1) | (F.size("keys") > 1)).withColumnRenamed("block", "i")
    left = several.select("kind", F.col("id").alias("a"), "i", F.col("keys").alias("xs"), F.explode(F.sequence("i", F.col("blocks") - 1)).alias("block_a"))
    inside = left.join(other("a"), ["kind", "a", "block_a"]).select("i", "block_a", "kind", F.explode("xs").alias("x"), "keys_a")
    inside = inside.select("i", "block_a", "kind", "x", F.explode("keys_a").alias("y")).where("i < block_a OR x < y")

    # Of a pair of classes every block of one meets every block of the other; the blocks come by joins.
    between = pairs.select("kind", "a", "b").join(other("a"), ["kind", "a"]).join(other("b"), ["kind", "b"])
    between = between.select("kind", F.explode("keys_a").alias("x"), "keys_b").select("kind", "x", F.explode("keys_b").alias("y")).where("x <> y")
    return between.union(inside.select("kind", "x", "y")).select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``kind, key, group``: classes linked by ``pairs`` (kind, a, b), each with its group's least id.

    Alternating star operations: every id is tied to the least key around it, first its larger
    neighbours, then its smaller ones. No step gathers a group; the links, of which there never are more
    than at the start, are grouped by key with a minimum. It ends after about log of the longest chain.
    """
    links = materialize(pairs.select("kind", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select("kind", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("kind", "u").agg(F.min("v").alias("m")).select("kind", "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, ["kind", "u"]).select("kind", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("kind", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["kind", "u"]).select("kind", F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        last, links = links, materialize(small.select("kind", "x.u", "x.v").where("u <> v").distinct())
        release(last)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("kind", "u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select("kind", F.col("u").alias("key"), F.col("v").alias("group")).union(links.select("kind", F.col("v").alias("key"), F.col("v").alias("group")).distinct())


def duplicate_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per text that has a class: ``kind, key, representative, group, links``.

    ``group`` is the least key of the connected classes, ``links`` the number of texts that are close to
    it: the copies of its own class and all members of linked classes. A key with several texts has a row
    for each of their classes.
    """
    pairs = materialize(pairs.select("kind", "a", "b"))
    classes = members.groupBy("kind", "id").agg(F.min("key").alias("representative"), F.count("*").alias("copies"))
    ends = pairs.union(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select("kind", F.col("id").alias("b"), "copies")
    around = ends.join(copies, ["kind", "b"]).groupBy("kind", F.col("a").alias("id")).agg(F.sum("copies").alias("near"))
    of = components(pairs).select("kind", F.col("key").alias("id"), F.col("group").alias("component"))
    per_class = classes.join(around, ["kind", "id"], "left").join(of, ["kind", "id"], "left").withColumn("component", F.coalesce("component", "id"))
    names = per_class.groupBy("kind", "component").agg(F.min("representative").alias("group"))
    per_class = per_class.join(names, ["kind", "component"]).select("kind", "id", "representative", "group", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(per_class, ["kind", "id"]).select("kind", "key", "representative", "group", "links")


def evidence_texts(chunks: DataFrame, risks: DataFrame) -> DataFrame:
    """Chunk texts and risk quotes as ``kind, key, text``."""
    a = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text")
    b = risks.select(F.lit("quote").alias("kind"), F.col("risk_id").alias("key"), F.col("evidence_quote").alias("text"))
    return a.unionByName(b)
