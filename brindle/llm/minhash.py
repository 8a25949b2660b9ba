"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

The sketch (Dahlgaard, Knudsen, Thorup: "Fast Similarity Sketching") places every element in one
hashed bin a round and stops once all bins are filled; from round t on, round t + j puts
every element in bin j, so each coordinate is filled after 2t rounds at most. A coordinate holds
the smallest (round, value), and two sets agree in it with a probability of their
similarity, with concentration as good as independent coordinates.

1. Texts with equal shingle sets form one class (any number of copies costs one row a task).
2. Classes are banded. With 28 bands of 5 coordinates a pair at similarity 0.85 shares no band
   with a probability of 7e-8.
3. In every bucket all members are verified on their full sets against one leader, the
   member that shares most buckets over all (the likely origin), and linked ones become components.
   Later rounds pick other leaders and take only members of other components.
4. Pairs of a bucket that are still in different components are then verified one by one. So
   no link between components is lost, and a group of thousands of near copies costs one
   verification a member and round, not all pairs.
   Before any text is fetched, pairs are dropped whose sizes or bitmaps rule a link out: the
   bitmap holds the parity of the elements hashed to each bit, so two sets differ in at least as many
   elements as their bitmaps do in bits. That bound is exact, so it loses no link.
5. Components end in a table; the smallest document id stands for each.

Links are confirmed on whole sets of 64-bit hashes of the shingles. Two different shingles of a pair of texts of n shingles
each are taken for one with a probability of about n^2 / 2^64, 5e-12 for 10,000 of them, and even then one shingle would have to decide.
Sets are the same class if their size and two 64-bit sums of mixed hashes agree.

A text with fewer words than a shingle is one shingle. Null, empty and blank texts have the empty
set and link with nothing. Very long texts are read whole, each by itself. Rows with a null id take no part: their component is
null and they are kept. Rows that repeat an id are one node, linked by any of its texts. Ties between leaders go by a hash of the
row. Extra columns, also ones with names of the result, are ignored; an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._joins import join_split
from ._scratch import materialise
from ._textvec import U, Words, encoded, groups, mix, slices

SHINGLE = 3
BANDS, ROWS = 28, 5
LEADER_ROUNDS = 2
#: 64-bit words of the parity bitmap that bounds the similarity of a pair from above.
BITMAP = 8
BITS = [f"b{k}" for k in range(BITMAP)]
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, A-Z lower-cased."""
    w = Words(texts, lower=True)
    h, n = w.hash, len(w.hash)
    if n >= k:
        s = mix(h[: n - k + 1] + U(k))
        for j in range(1, k):
            s = mix(s * U(0x9FB21C651E98DF25) ^ h[j : n - k + 1 + j])
    else:
        s = np.empty(0, np.uint64)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            x = np.array([b - a + 0x51ED270B], np.uint64)
            for i in range(a, b):
                x = mix(x * U(0x9FB21C651E98DF25) ^ h[i : i + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """t coordinates of each set (all ones for the empty set)."""
    out = np.full((len(sets), t), FULL, np.uint64)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    for r in range(2 * t):
        g = mix(elements + U((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((g >> U(32)) * U(t) >> U(32)).astype(np.int64) if r < t else r - t
        np.minimum.at(flat, owner * t + place, U(r << 32) | (g & U(0xFFFFFFFF)))
        open_ = (out == FULL).any(axis=1)
        more = open_[owner]
        if not more.all():
            elements, owner = elements[more], owner[more]
        if not len(elements):
            break
    return out


def band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = coords.reshape(len(coords), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(0xA24BAED4963EE407), x.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U(0x9FB21C651E98DF25) ^ x[:, :, j])
    return key


def sketch_table(rows: DataFrame, kind: str, shingle: int, bands: int, per: int) -> DataFrame:
    """(id, th, n, s1, s2, bands): set size, 128-bit set hash and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, 2):
                i, j = 0, len(raw)
                sets = shingle_sets(raw, shingle)
                n = np.array([len(s) for s in sets])
                # Each set ends in an absent element, so that none of the sums is over nothing.
                flat = np.concatenate([np.append(s, U(0)) for s in sets])
                at = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
                lanes = [pa.array(np.add.reduceat(mix(flat ^ U(x)), at).view(np.int64)) for x in (0x1234567, 0x89ABCDEF)]
                keys = band_keys(sketch(sets, bands * per), bands, per).view(np.int64).reshape(-1)
                # Every element's place is hashed; a bit is the parity of the elements there (the absent element's bit is the same in all).
                place = np.repeat(np.arange(j - i), n + 1) * (64 * BITMAP) + (mix(flat ^ U(0xB17)) & U(64 * BITMAP - 1)).astype(np.int64)
                odd = (np.bincount(place, minlength=(j - i) * 64 * BITMAP) & 1).astype(np.uint8)
                words = np.packbits(odd).view(np.int64).reshape(j - i, BITMAP)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), *lanes, lists, *(pa.array(words[:, k]) for k in range(BITMAP))], ["id", "th", "n", "s1", "s2", "bands", *BITS])

    return rows.mapInArrow(run, f"id {kind}, th bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, " + ", ".join(f"{b} bigint" for b in BITS))


def _possible(percent: int) -> Column:
    """Sizes and bitmaps of a pair (the other side's under o_) that allow the similarity."""
    apart = F.lit(0)
    for b in BITS:
        apart = apart + F.bit_count(F.col(b).bitwiseXOR(F.col(f"o_{b}")))
    both = F.col("n") + F.col("o_n")
    return (100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")) & (100 * (both - apart) >= percent * (both + apart))


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the similarity. texts: row, t."""
    right = pairs.join(texts.select(F.col("row").alias("b"), F.col("t").alias("tb")), "b")
    full = right.join(texts.select(F.col("row").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            ta, tb, a = encoded(batch.column(2).to_pylist()), encoded(batch.column(3).to_pylist()), batch.column(0).to_pylist()
            for i, j in groups(list(map(len, tb))):
                keep = []
                for k, y in zip(range(i, j), shingle_sets(tb[i:j], shingle)):
                    if a[k] != last[0]:  # pairs come sorted by a from a merge join
                        last = (a[k], shingle_sets([ta[k]], shingle)[0])
                    x = last[1]
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                yield batch.slice(i, j - i).select([0, 1]).filter(pa.array(keep))

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return full.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept, text_hash) for each row of ``df``."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"))
    sk = materialise(sketch_table(docs, kind, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    live = sk.where("n > 0 and id is not null")
    grouped = live.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "row", "th")).alias("r"), *(F.first(c).alias(c) for c in ("bands", *BITS)))
    classes = materialise(grouped.select("s1", "s2", "n", F.col("r.row").alias("row"), F.col("r.id").alias("id"), F.col("r.th").alias("th"), "bands", *BITS), "classes")

    banded = classes.select("row", "n", *BITS, F.explode("bands").alias("key"))
    crowded = banded.select("key").groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = materialise(join_split(banded, crowded, ["key"]), "members")
    involved = members.select("row").distinct().join(classes.select("row", "id", "th"), "row")
    texts = materialise(docs.join(involved, ["id", "th"]).dropDuplicates(["row"]).select("row", "t"), "texts")

    # Texts of one id belong together even where their sets differ.
    members_of = live.join(classes.select("s1", "s2", "n", F.col("row").alias("class"), F.col("id").alias("rep")), ["s1", "s2", "n"]).select("id", "class", "rep", "row")
    per_id = members_of.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("id", "a")
    edges = materialise(members_of.join(per_id, "id").where("class <> a").select("a", F.col("class").alias("b")).distinct(), "links")
    degree = members.groupBy("row").agg(F.sum("c").alias("degree"))
    ranked = materialise(members.join(degree, "row"), "ranked")

    labels = components(edges)
    done: DataFrame | None = None
    for turn in range(LEADER_ROUNDS + 1):
        now = ranked.join(labels, ranked.row == labels.id, "left").select("key", "row", "n", "degree", *BITS, F.coalesce("comp", "row").alias("comp"))
        mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
        # Written: the rounds that follow start from here, and only buckets of several components matter.
        now = materialise(join_split(now, mixed, ["key"]), "mixed")
        if now.limit(1).count() == 0:
            break
        if turn < LEADER_ROUNDS:
            rank = ["degree"] if turn == 0 else []
            lead = F.max(F.struct(*rank, F.xxhash64("row", F.lit(turn)).alias("h"), "row", "n", "comp", *BITS))
            other = now.groupBy("key").agg(lead.alias("l")).select("key", *(F.col(f"l.{c}").alias(f"o_{c}") for c in ("row", "n", "comp", *BITS)))
            pairs = join_split(now, other, ["key"]).where((F.col("comp") != F.col("o_comp")) & _possible(percent))
        else:
            other = now.select("key", *(F.col(c).alias(f"o_{c}") for c in ("row", "n", "comp", *BITS)))
            pairs = now.join(other, "key").where((F.col("o_comp") < F.col("comp")) & _possible(percent))
        pairs = pairs.select(F.col("o_row").alias("a"), F.col("row").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() if turn else pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        found = materialise(verify(pairs, texts, shingle, percent), "links")
        tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        done = tried if done is None else done.union(tried)
        if found.limit(1).count():
            edges = edges.union(found.select("a", "b"))
            labels = components(edges)

    comps = classes.join(labels, classes.row == labels.id, "left").select(classes["row"].alias("class"), classes["id"].alias("rep"), F.coalesce("comp", classes["row"]).alias("comp"))
    least = comps.groupBy("comp").agg(F.min("rep").alias("least"))
    of_class = comps.join(least, "comp").select("class", "least")
    of_row = members_of.join(of_class, "class").select("row", "least")
    out = sk.select("row", "id", "n", "th").join(of_row, "row", "left")
    comp = F.coalesce("least", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"), F.col("th").alias("text_hash"))
