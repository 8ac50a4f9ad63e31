"""MinHash near-duplicate detection.

One-permutation hashing with optimal densification gives each distinct shingle set a signature of
``bands * rows`` bins. Bands form buckets; each bucket proposes star edges from a centre, candidates are
confirmed on the full shingle sets, and connected components follow. Rows with equal sets collapse
first, so a group of exact copies of any size costs one signature.

Round one confirms, for every set, the edge to the smallest centre among its buckets; round two the other
star edges whose ends are still apart. After that a bucket can only hide a link if it holds three or more
sets in two or more components. Of those, shingles that only one set holds are counted: a set of n shingles,
m of them held by others too, shares at most m with any, which rules out sets with many edits of their own.
Buckets that still hold sets apart from each other form families (sets connected by buckets). Round three
compares, in blocks of 1,024 sets and 4 MB of compressed text at most, those outside a family's largest component with the whole family; a block
pair is one matrix product and emits only links that join components. So no cap applies and no pairs are
listed, and members that star edges have linked already cost nothing more.

A link between sets of Jaccard similarity 0.8 is missed only if none of 40 bands of 5 rows collide:
(1 - 0.8**5)**40 < 2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, id_text, mapped, stored
from .components import connected

BANDS, ROWS, SHINGLE = 40, 5, 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_WORDS_KEPT = 100_000
_BLOCK_ROWS, _BLOCK_BYTES = 1024, 4 << 20
_SALTS = 16


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of distinct words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z and split at the ASCII white space 0x20, 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than size make one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        h = _mix(h * _A + w[j : n - k + 1 + j])
    return np.unique(h)


def _permutations(bins: int) -> np.ndarray:
    rng = np.random.default_rng(20140512)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(sorted_set: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty set; an empty bin copies the first filled bin of its own random order."""
    at = ((sorted_set >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    filled = np.zeros(bins, bool)
    sig = np.zeros(bins, np.uint64)
    where = at[first].astype(np.int64)
    filled[where] = True
    sig[where] = sorted_set[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        source = orders[empty, filled[orders[empty]].argmax(axis=1)]
        sig[empty] = sig[source]
    return sig


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, orders = WordHashes(), _permutations(bands * rows)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _A)
        for batch in batches:
            n, digests, buckets = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(words_of(text), hashes, size)
                n.append(len(s))
                if not len(s):
                    digests.append(None)
                    buckets.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s, bands * rows, orders).reshape(bands, rows)
                h = salt.copy()
                for j in range(rows):
                    h = _mix(h * _A + sig[:, j])
                buckets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), batch.column(2)],
                ["doc_id", "n_shingles", "digest", "buckets", "text_digest"],
            )

    return run


def _text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [zip_.compress(t.encode("utf-8", "surrogatepass").lower()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["node", "blob"])


def _exploded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [shingle_set(unzip.decompress(b).split(), hashes, size) for b in part.column(1).to_pylist()]
                nodes = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["node", "shingle"])

    return run


def _confirm(size: int, share: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip = WordHashes(), zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last[0] != b:
                    last = (b, shingle_set(unzip.decompress(b).split(), hashes, size))
                x, y = shingle_set(unzip.decompress(a).split(), hashes, size), last[1]
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if both * share.denominator >= share.numerator * (len(x) + len(y) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _with_ends(df: DataFrame, column: str, apart: bool = False) -> DataFrame:
    """df (bucket, node) with lo and hi, the least and greatest value of the column in the bucket; apart: only where they differ.

    Counted within salts first and joined by salt: a bucket that many sets share is no single task's.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)))
    part = salted.groupBy("bucket", "_salt").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ends = part.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = ends.where("lo < hi") if apart else ends
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("_salt")
    return salted.join(ends.select("bucket", "lo", "hi", every).hint("merge"), ["bucket", "_salt"]).drop("_salt")


def _between(able: DataFrame, texts: DataFrame, size: int, share: Fraction) -> DataFrame:
    """Links (u, v) that join components of a family. able: bucket, node, c (its component)."""
    low = _with_ends(able, "node").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    family = connected(low).select("node", F.col("component").alias("family"))
    sizes = texts.groupBy("node").agg(F.max(F.octet_length("blob")).alias("size"))
    sets = able.select("node", "c").distinct().join(family, "node").join(sizes, "node")
    sets = stored(sets, "neardup-families")
    parts = sets.groupBy("family", "c").agg(F.count("*").alias("k"), F.sum("size").alias("size"))
    about = parts.groupBy("family").agg(
        F.max_by(F.struct("c", "k", "size"), F.struct("k", -F.col("c"))).alias("m"), F.sum("k").alias("all"), F.sum("size").alias("bytes")
    )
    blocks = lambda k, size: F.greatest(F.ceil(k / _BLOCK_ROWS), F.ceil(size / _BLOCK_BYTES), F.lit(1))
    about = about.where("m.k < all").select(
        "family", F.col("m.c").alias("main"), blocks(F.col("all") - F.col("m.k"), F.col("bytes") - F.col("m.size")).alias("xs"), blocks(F.col("m.k"), F.col("m.size")).alias("ys")
    )
    sets = sets.join(about, "family").withColumn("x", F.col("c") != F.col("main"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("x"), F.col("xs")).otherwise(F.col("ys"))))
    sets = sets.select("node", "c", "family", "x", "block", "xs", "ys").join(texts, "node")
    column = ["family", "i", "other", "j", "asks", "node", "c", "blob"]
    every = lambda first, last: F.explode(F.sequence(first, last))
    outside, zero = sets.where("x"), F.lit(0).cast("long")
    asks_x = outside.select("*", F.col("block").alias("i"), F.lit(True).alias("other"), F.lit(True).alias("asks"), every(F.col("block"), F.col("xs") - 1).alias("j"))
    asks_y = outside.select("*", F.col("block").alias("i"), F.lit(False).alias("other"), F.lit(True).alias("asks"), every(zero, F.col("ys") - 1).alias("j"))
    told_x = outside.select("*", F.col("block").alias("j"), F.lit(True).alias("other"), F.lit(False).alias("asks"), every(zero, F.col("block")).alias("i"))
    told_y = sets.where("not x").select("*", F.col("block").alias("j"), F.lit(False).alias("other"), F.lit(False).alias("asks"), every(zero, F.col("xs") - 1).alias("i"))
    rows = asks_x.select(column).unionAll(asks_y.select(column)).unionAll(told_x.select(column)).unionAll(told_y.select(column))
    return rows.groupBy("family", "i", "other", "j").applyInArrow(_block_links(size, share), "u long, v long")


def _block_links(size: int, share: Fraction):
    def run(table: pa.Table) -> pa.Table:
        hashes, unzip = WordHashes(), zstandard.ZstdDecompressor()
        asks = np.array(table.column("asks").to_pylist(), bool)
        node, comp = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "c"))
        sets = [shingle_set(unzip.decompress(b).split(), hashes, size) for b in table.column("blob").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        us: list[int] = []
        vs: list[int] = []
        if len(a) and len(b):
            both = np.intersect1d(np.unique(np.concatenate([sets[k] for k in a])), np.unique(np.concatenate([sets[k] for k in b])), assume_unique=True)
            shared = np.zeros((len(a), len(b)), np.float32)
            for at in range(0, len(both), 4096):
                chunk = both[at : at + 4096]
                grids = [np.zeros((len(side), len(chunk)), np.float32) for side in (a, b)]
                for grid, side in zip(grids, (a, b), strict=True):
                    for row, k in enumerate(side):
                        inside = sets[k][np.searchsorted(sets[k], chunk[0]) : np.searchsorted(sets[k], chunk[-1], side="right")]
                        where = np.minimum(np.searchsorted(chunk, inside), len(chunk) - 1)
                        grid[row, where[chunk[where] == inside]] = 1
                shared += grids[0] @ grids[1].T
            linked = shared.astype(np.int64) * (share.numerator + share.denominator) >= share.numerator * (sizes[a][:, None] + sizes[b][None, :])
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for i, j in zip(*np.nonzero(linked & (comp[a][:, None] != comp[b][None, :])), strict=True):
                x, y = find(int(comp[a[i]])), find(int(comp[b[j]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    us.append(int(node[a[i]]))
                    vs.append(int(node[b[j]]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id) for every row.

    Options: similarity (0.8), shingle_words (5), bands (40), rows (5). Words are maximal runs outside ASCII white space,
    A-Z lower-cased; a set holds the distinct shingles, a shorter text is one shingle, and a text without words (null or
    empty) has no set, links with nothing and is kept. Rows that share a doc_id count as one document: each has the class
    of its own text, in which all texts of the id take part. Rows with a null doc_id get the class of documents with an
    equal set, else null, and are kept only in the latter case. An empty table gives an empty result; other columns are
    ignored.
    """
    return _classes(docs, **options).drop("digest", "text_digest")


def _classes(docs: DataFrame, *, similarity: float = 0.8, shingle_words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates() with digest (of the set) and text_digest."""
    share = Fraction(similarity).limit_denominator(1000)
    base = id_text(docs)
    rows_ = stored(base.withColumn("text_digest", _text_digest(F.col("text"))).transform(mapped, _signatures(shingle_words, bands, rows), "doc_id long, n_shingles long, digest binary, buckets array<long>, text_digest binary"), "neardup-rows")
    # one node per distinct set, named by its smallest doc_id
    sets = rows_.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    sets = stored(sets, "neardup-sets")
    in_bands = sets.where("node is not null").select("node", "n", F.explode("buckets").alias("bucket"))
    # written by itself, so that the join with it can split a bucket that many sets share
    centres = in_bands.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("top")).where("c.node < top").select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    centres = stored(centres, "neardup-centres")
    fits = F.least("n", "centre_n") * share.denominator >= F.greatest("n", "centre_n") * share.numerator
    # members of buckets with two sets or more; the centres themselves included
    members = stored(in_bands.join(centres, "bucket"), "neardup-members")
    stars = members.where(F.col("node") != F.col("centre")).where(fits).groupBy("node", "centre").agg(F.lit(1).alias("one"))
    stars = stored(stars.select(F.col("node").alias("u"), F.col("centre").alias("v")), "neardup-stars")
    ids = stars.select(F.explode(F.array("u", "v")).alias("node")).unionAll(members.where("node <> centre").select("node")).distinct()
    texts = base.where("doc_id is not null").transform(mapped, _packed, "node long, blob binary")
    texts = stored(texts.join(ids, "node", "left_semi").dropDuplicates(["node", "blob"]), "neardup-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_u = pairs.join(texts.select(F.col("node").alias("u"), F.col("blob").alias("a")), "u")
        with_v = with_u.join(texts.select(F.col("node").alias("v"), F.col("blob").alias("b")), "v").select("u", "v", "a", "b")
        return with_v.transform(mapped, _confirm(shingle_words, share), "u long, v long")

    def labelled(df: DataFrame, comps: DataFrame, column: str, out: str) -> DataFrame:
        c = comps.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return df.join(c, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")

    first = stars.groupBy("u").agg(F.min("v").alias("v"))
    links = stored(confirmed(first), "neardup-links")
    comps = stored(connected(links), "neardup-components")

    def apart(pairs: DataFrame) -> DataFrame:
        p = labelled(labelled(pairs, comps, "u", "cu"), comps, "v", "cv")
        return p.where("cu <> cv").select("u", "v")

    def extend(new: DataFrame) -> DataFrame:
        found = stored(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(new), "neardup-links")
        return stored(connected(found), "neardup-components")

    rest = stored(apart(stars.join(first, ["u", "v"], "left_anti")), "neardup-pairs")
    if not rest.isEmpty():
        comps = extend(confirmed(rest))
    # pairs without a centre: only in buckets that still hold members apart from each other
    def unsettled(df: DataFrame) -> DataFrame:
        return _with_ends(df, "c", apart=True).drop("lo", "hi")

    mixed = stored(unsettled(labelled(members.where("node <> centre").select("bucket", "node", "n"), comps, "node", "c")), "neardup-mixed")
    # shingles that no other of these sets holds bound what a set can share with any of them
    nodes = mixed.select("node").distinct()
    held = texts.join(nodes, "node", "left_semi").transform(mapped, _exploded(shingle_words), "node long, shingle long")
    lone = held.groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("lone"))
    able = mixed.join(lone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    able = able.where(F.col("shared") * share.denominator >= F.col("n") * share.numerator).select("bucket", "node", "c")
    able = stored(unsettled(able), "neardup-able")
    if not able.isEmpty():
        comps = extend(_between(able, texts, shingle_words, share))

    labels = labelled(sets.select("digest", "node"), comps, "node", "component_id").select("digest", "component_id")
    out = rows_.select("doc_id", "n_shingles", "digest", "text_digest").join(labels, "digest", "left")
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest", "text_digest")


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one of each near-duplicate class, all columns kept.

    That is a row of the class's smallest doc_id, of several texts under that id the one of least digest, of equal rows
    one. Texts without words form a class per doc_id. Rows with a null doc_id stay, one per set, where no document
    with an id has an equal set.
    """
    marks = _classes(docs, **options).where("kept")
    group = F.struct("component_id", F.when(F.col("component_id").isNull() | F.col("digest").isNull(), F.coalesce("digest", "text_digest")))
    kept = marks.groupBy(group.alias("g")).agg(F.min(F.struct("doc_id", "text_digest")).alias("one"), F.count("*").alias("times"))
    kept = stored(kept.select("one.doc_id", "one.text_digest", "times"), "neardup-marks")
    digest = free_name(docs, "text_digest")
    rows = docs.withColumn(digest, _text_digest(docs["text"]))
    # the same merge join at every size: no table of kept ids is ever sent to all executors
    marked = kept.select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest")).hint("merge")
    same = (rows[digest] == marked["_digest"]) & rows["doc_id"].cast("long").eqNullSafe(marked["_id"])
    out = rows.join(marked, same, "left_semi")
    if not kept.where("times > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", digest])
    return out.select(docs.columns)
