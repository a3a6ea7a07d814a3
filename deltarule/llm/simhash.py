"""Operator 6, SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has four segments of 16 bits. If two fingerprints differ in at most three
bits, then for some segment i they agree on i and differ in at most one bit of segment
i + 1 (cyclic): with two or three equal segments at most one of these is followed by the
segment with two or more errors, and a single equal segment leaves one error to each of
the others. Segment i + 1, padded to 23 bits, is decoded with the perfect binary Golay
code; words at distance one share a codeword index if one side looks up the indices of
all its neighbours (one index, or six if the word lies three bits from its codeword).
A key is thus 16 exact bits, a 12-bit index and the segment's number.

``near_duplicates`` links at three bits. ``representatives`` links at a Jaccard similarity
of 0.8, far more than three bits can bridge: further pairs come from least-shingle
samples, and from exact prefixes of short sets. A parity sketch rules out pairs that
cannot reach 0.8, never one that can, and every other pair is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltarule.llm.common import NO_ID, join_totals, mix, small_batches, steps, table, with_checkpoints
from deltarule.llm.components import components

SEGMENTS, SEGMENT_BITS, ERRORS = 4, 16, 3
#: Samples of a shingle set, and shingles in each. Sets of similarity 0.8 share one of 20
#: samples of 4 with probability 1 - (1 - 0.8**4)**20 > 0.9999.
SAMPLES, SAMPLE_SIZE = 20, 4
#: Sets of up to so many shingles have exact keys: of n shingles in one fixed order, the first
#: n - ceil(0.8 n) + 1. Two sets of similarity 0.8 always share one of these.
SHORT = 40
#: Words of 64 bits in a parity sketch: each bit is the parity of the shingles that hash to it, so
#: two sketches differ in at most as many bits as the sets have shingles that are not in both.
PARITY = 8
PARITIES = [f"m{i}" for i in range(PARITY)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _codewords() -> np.ndarray:
    """The 4096 words of the [23, 12] Golay code, generated by x^11+x^9+x^7+x^6+x^5+x+1."""
    words = np.zeros(4096, np.int64)
    for i in range(12):
        words[(np.arange(4096) >> i & 1) == 1] ^= 0b101011100011 << i
    return words


def decoder() -> np.ndarray:
    """Index of the codeword within three bits of each 16-bit word (padded with seven zeros)."""
    words = _codewords()
    out = np.full(1 << SEGMENT_BITS, -1, np.int64)
    flips = [0, *(1 << i for i in range(23))]
    patterns = {a | b | c for a in flips for b in flips for c in flips}
    for pattern in patterns:
        near = words ^ pattern
        index = np.flatnonzero(near < 1 << SEGMENT_BITS)
        out[near[index]] = index
    return out


def fuzzy_indices() -> tuple[np.ndarray, np.ndarray]:
    """The index of each 16-bit word, and (padded with -1) those of itself and its 16 neighbours."""
    exact = decoder()
    around = np.stack([exact, *(exact[np.arange(1 << SEGMENT_BITS) ^ 1 << i] for i in range(SEGMENT_BITS))], axis=1)
    around.sort(axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    around.sort(axis=1)
    widest = int((around >= 0).sum(1).max())
    return exact, around[:, ::-1][:, :widest].copy()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, a 64-bit SimHash of word shingles, repeats included, of whole texts.

    A-Z is lower-cased; shingles are ``width`` words joined by spaces, or all words of a
    shorter text; a bit is one if more than half of the shingles' XXH64 (seed 42) have it.
    A text without words, or null, has fingerprint 0.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            raw = _LOWER[data].tobytes()
            fps = np.zeros(rows.num_rows, np.uint64)
            for i in range(rows.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                if words:
                    fps[i] = simhash(words, width)[0]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def simhash(words: list[bytes], width: int, copies: int = 1) -> list[int]:
    return bits(shingle_hashes(words, width), copies)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in turn; of all words if there are fewer than ``width``."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    count = max(1, len(words) - width + 1)
    begins = [0, *ends[: count - 1].tolist()]
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(text)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], 42) for a, b in zip(begins, stops)), np.uint64, count)


def bits(hashes: np.ndarray, copies: int) -> list[int]:
    """The bits that more than half of the hashes have, and those of further, scrambled copies."""
    out = []
    for copy in range(copies):
        ones = np.zeros(64, np.int64)
        for part in np.array_split(mix(hashes + np.uint64(copy)) if copy else hashes, -(-len(hashes) // 8192)):
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little"))
    return out


_ODD = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


def samples(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of distinct hashes: the SAMPLE_SIZE least in each of SAMPLES orders, or for a short set its exact prefix.

    A set up to SHORT has prefix keys, one over SHORT samples; sets up to SHORT / 0.8, which
    may be similar to one of either kind, have both.
    """
    keys = [np.zeros(0, np.uint64)]
    if len(hashes) <= SHORT * 5 // 4:
        keys.append(mix(np.sort(hashes)[: len(hashes) - -(-4 * len(hashes) // 5) + 1]))
    if len(hashes) > SHORT:
        least = np.stack([np.sort(np.partition(hashes * odd, SAMPLE_SIZE - 1)[:SAMPLE_SIZE]) for odd in _ODD])
        found = np.arange(SAMPLES, dtype=np.uint64)
        for column in least.T:
            found = mix(found * np.uint64(0x9E3779B97F4A7C15) + column)
        keys.append(found)
    return np.concatenate(keys)


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY words, bit by bit the parity of the number of distinct hashes that fall on it."""
    odd = np.bincount((mix(hashes ^ np.uint64(SAMPLES)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """For every row doc_id, th, and of its set of distinct shingles: n, fp (its fingerprint), a name, parity words, keys and all hashes.

    A hash in ``shingles`` is four bytes, ascending. A null text, or one without words, is
    the empty set; it has no keys, and only equals other empty sets.
    """
    small_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), *((w, pa.int64()) for w in PARITIES), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            raw = _LOWER[data].tobytes()
            sizes, names, sets = [], [], []
            fps, marks, keys = np.zeros(rows.num_rows, np.uint64), np.zeros((rows.num_rows, PARITY), np.uint64), [np.zeros(0, np.int64)] * rows.num_rows
            for i in range(rows.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                hashes = np.unique(shingle_hashes(words, width)) if words else np.zeros(0, np.uint64)
                if words:
                    fps[i], marks[i], keys[i] = bits(hashes, 1)[0], parity(hashes), samples(hashes).view(np.int64)
                sizes.append(len(hashes))
                names.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
            marks = marks.view(np.int64)
            columns = [rows.column("doc_id").cast(pa.int64()), rows.column("th"), pa.array(sizes), pa.array(fps.view(np.int64)), pa.array(np.array(names, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in marks.T), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    words = ", ".join(f"{w} long" for w in PARITIES)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(of, f"doc_id long, th long, n long, fp long, node long, {words}, keys array<long>, shingles binary")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, p, q) those whose sets p and q of shingles have a similarity of 0.8."""
    for rows in batches:
        keep = []
        for p, q in zip(rows.column("p"), rows.column("q")):
            p, q = np.frombuffer(p.as_py(), np.uint32), np.frombuffer(q.as_py(), np.uint32)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(5 * both >= 4 * (len(p) + len(q) - both))
        yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _keys(every: bool):
    """Keys of fingerprints (fp, group): one for each segment, or all of the neighbourhood."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, around = fuzzy_indices()
        mask = np.uint64((1 << SEGMENT_BITS) - 1)
        for rows in batches:
            fp, group = rows.column("fp").to_numpy(), rows.column("group").to_numpy()
            parts = [(fp.view(np.uint64) >> np.uint64(SEGMENT_BITS * i) & mask).astype(np.int64) for i in range(SEGMENTS)]
            keys, owners = [], []
            for i in range(SEGMENTS):
                following = parts[(i + 1) % SEGMENTS]
                index = around[following] if every else exact[following][:, None]
                row, column = np.nonzero(index >= 0)
                keys.append((i << 28) | parts[i][row] << 12 | index[row, column])
                owners.append(row)
            at = np.concatenate(owners)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[at]), pa.array(group[at])], ["key", "fp", "group"])

    return of


def links(seen: DataFrame) -> DataFrame:
    """Pairs a < b of different groups that hold fingerprints at three or fewer differing bits.

    seen: distinct fingerprints (fp) and a group for each. Every such link is found. A key
    holds few distinct fingerprints by chance (28 bits for each segment); adaptive
    execution splits the join where near copies crowd one key.
    """
    small_batches(seen.sparkSession)
    kind = "key long, fp long, group long"
    one = seen.select("fp", "group").mapInArrow(_keys(False), kind).withColumnsRenamed({"fp": "x", "group": "a"})
    several = seen.select("fp", "group").mapInArrow(_keys(True), kind).withColumnsRenamed({"fp": "y", "group": "b"})
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= ERRORS)
    return one.join(several, (one["key"] == several["key"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id that links reach, for every row.

    docs: any frame with doc_id and text; other columns are ignored. Documents with one
    fingerprint are collapsed first (their smallest id stands for all), so copies are never
    paired. A null id counts as larger than every id and is never a component_id unless
    its component has no other; repeated rows give repeated results.
    """
    with_checkpoints(docs.sparkSession)
    rows = fingerprints(docs, width).checkpoint()
    classes = rows.groupBy("fp").agg(F.min(_ids()).alias("least"))
    found = components(links(classes.select("fp", F.col("fp").alias("group")))).withColumnRenamed("node", "fp")
    classes = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = classes.groupBy("group").agg(F.min("least").alias("least"))
    return rows.join(join_totals(classes.select("fp", "group"), least, ["group"]).select("fp", "least"), "fp").select("doc_id", "fp", F.expr(f"nullif(least, {NO_ID})").alias("component_id"))


def representatives(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of docs, whole, for each group of near duplicates: that with the smallest doc_id.

    Documents link if the Jaccard similarity of their sets of word shingles is 0.8 or more;
    fingerprints and sample keys only propose pairs. Equal sets are one class, empty ones
    included. Of rows that share the smallest id, one stays; a null id counts as
    larger than every id. Other columns pass through.
    """
    least = _similar_groups(docs, width).groupBy("group").agg(F.min("least").alias("least"))
    kept = least.select(F.col("least.id").alias("id"), F.col("least.th").alias("th")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), _ids().alias("id"), F.xxhash64("text").alias("th"), F.xxhash64(F.to_json(row)).alias("place"))
    first = F.row_number().over(Window.partitionBy("id", "th").orderBy("place"))
    return keyed.join(kept, ["id", "th"], "left_semi").withColumn("first", first).filter("first = 1").select("row.*")


def _similar_groups(docs: DataFrame, width: int) -> DataFrame:
    """Classes of documents with equal sets (node, least, group): least is the id and text hash of the first of them.

    Every link is verified on whole sets. First each class meets one class, the leader, of
    every sample key, which ties a group of near copies together with a pair a member and key
    at most, and the first class of its fingerprint. Then classes that share a key, or have fingerprints
    within three bits, meet each other if they are still apart, so no pair is left out. Pairs
    inside a group that is already linked are never made.
    """
    with_checkpoints(docs.sparkSession)
    rows = sketches(docs, width).checkpoint().withColumn("row", F.monotonically_increasing_id())
    kinds = ["node", "n", "fp", *PARITIES]
    classes = rows.groupBy(*kinds).agg(F.min(F.struct(_ids().alias("id"), "th", "row")).alias("least"))
    classes = classes.withColumn("group", F.col("node")).checkpoint()
    firsts = classes.select("node", F.col("least.row").alias("row"))
    seen = classes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("rep")).checkpoint()
    reps = classes.select("node", "fp").join(seen, "fp").select("node", "rep")
    close = links(seen.select("fp", F.col("rep").alias("group"))).checkpoint()
    first = reps.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    members = rows.select("row", "keys").join(firsts, "row").select("node", F.explode("keys").alias("key")).checkpoint()

    sets = None
    for led in (True, False):
        met = members.join(classes.select("node", "group"), "node")
        groups = met.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("node").alias("leader"))
        mixed = join_totals(met, groups.filter("low <> high").select("key", "leader"), ["key"]).checkpoint()
        if sets is None:  # later rounds need no others, as groups only grow
            wanted = firsts.join(mixed.select("node").unionByName(close.unionByName(first).select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "node")
            sets = rows.select("row", "shingles").join(wanted, "row").select("node", "shingles").checkpoint()
        side = lambda rows, c: rows.select(*(F.col(x).alias(c if x == "node" else f"{x}_{c}") for x in rows.columns))
        known = classes.select(*(x for x in kinds if x != "fp"), "group")
        if led:
            pairs = mixed.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
            pairs = pairs.join(side(known, "a"), "a").join(side(known, "b"), "b").filter(_may_link())
        else:
            # all open keys of a class, at most 31, so that a pair is made at the first that both have
            held = known.join(mixed.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("held")), "node")
            mixed = mixed.select("node", "key").join(held, "node").checkpoint()
            first_key = F.col("key_a").eqNullSafe(F.element_at(F.array_intersect("held_a", "held_b"), 1))
            pairs = side(mixed, "a").join(side(mixed, "b"), (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & _may_link() & first_key)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.unionByName(first if led else _apart(classes, reps, close)).distinct()
        classes = _linked(classes, pairs, sets, kinds)
    return classes


def _linked(classes: DataFrame, pairs: DataFrame, sets: DataFrame, kinds: list[str]) -> DataFrame:
    """classes with the groups joined that a pair (a, b) of nodes with a verified similarity of 0.8 connects."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("p"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("q"))
    near = pairs.join(one, "a").join(other, "b").select("a", "b", "p", "q").mapInArrow(_similar, "a long, b long").checkpoint()
    label = lambda c: classes.select(F.col("node").alias(c), F.col("group").alias(f"group_{c}"))
    edges = near.join(label("a"), "a").join(label("b"), "b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
    found = components(edges).withColumnRenamed("node", "group")
    return classes.join(found, "group", "left").select(*kinds, "least", F.coalesce("component", "group").alias("group")).checkpoint()


def _apart(classes: DataFrame, reps: DataFrame, close: DataFrame) -> DataFrame:
    """Pairs of classes whose fingerprints are equal or in a pair of close, but whose groups still differ."""
    held = reps.join(classes.drop("least", "fp"), "node")
    span = held.groupBy("rep").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    equal = span.filter("low <> high").select(F.col("rep").alias("r"), F.col("rep").alias("s"))
    side = lambda c: span.select(F.col("rep").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))
    some = close.join(side("a"), "a").join(side("b"), "b").filter("least(low_a, low_b) <> greatest(high_a, high_b)")
    both = equal.unionByName(some.select(F.col("a").alias("r"), F.col("b").alias("s")))
    member = lambda r, c: held.select(F.col("rep").alias(r), F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ["n", *PARITIES, "group"]))
    x, y = both.join(member("r", "a"), "r"), member("t", "b")
    met = x.join(y, (F.col("s") == F.col("t")) & (F.col("a") != F.col("b")) & _may_link())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _may_link() -> Column:
    """Of a pair in different groups: sizes and parities allow a similarity of 0.8.

    At 0.8 the shingles that are not in both sets are at most a ninth of n_a + n_b."""
    apart = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in PARITIES)
    return (F.col("group_a") != F.col("group_b")) & _sizes() & (9 * apart <= F.col("n_a") + F.col("n_b"))


def _sizes() -> Column:
    return (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))


def _ids() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
