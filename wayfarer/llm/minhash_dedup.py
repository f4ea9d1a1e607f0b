"""MinHash near-dedup with b-bit signatures.

A document is the set of its distinct five-word shingles.  ``bands`` x ``ROWS``
minima give band keys; of each minimum only the low ``BITS`` bits are retained,
packed into one signature.  Documents of equal sets are one class.  Candidates
are classes that share a band key; their similarity is estimated from the bit
counts of the signatures, corrected for chance agreement of the low bits, and
pairs that may reach the bound are confirmed on the full sets.

No bucket is expanded into all its pairs.  First every member is compared with
the smallest one of all its buckets.  Confirmed links make components; next come
the smallest members of its other buckets, as far as they lie in another
component, and only buckets that still hold several components are searched
further: their signatures are compared in blocks, and where an estimate allows it
the full sets, until a member has a link into the component.  In the end every
candidate pair is either inside one component or was rejected.  At the bound of
80 percent a pair shares no band with probability (1 - 0.80^6)^48, about 5e-7 (op7:
(1 - 0.85^6)^32, about 3e-7), and the estimate's slack is six standard errors.

Defined results: null and empty texts, or texts without words, have an empty set
and link with nothing; fewer than five words make one shingle of them all.  Rows of
one id with different texts are one document for ``near_duplicates``: its texts are
linked, so its rows with words share a component.  ``drop_near_duplicates`` takes them
as documents of their own, so that a text that is like no other stays whatever its id.
Equal rows are one; rows with a null id link with nothing and are kept.  An empty
table gives an empty result.  Only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.components import connected_components
from wayfarer.llm.tables import drop, fresh, store
from wayfarer.llm.text_arrays import Hasher, flat, lower_ascii, mix, pieces, windows, words

SHINGLE = 5
#: Bands for PERCENT; a multiple of eight, so that signatures are whole words.
BANDS, ROWS, BITS = 48, 6, 4
HASHES = BANDS * ROWS
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: op7's contract has a bound of its own, for which fewer bands do.
OP7 = {"percent": 85, "bands": 32}
ERRORS = 6.0
BLOCK = 512
#: Members confirmed against one copy of a leader's text.
MEMBERS = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a piece."""
    data = lower_ascii(data)
    starts, ends, doc = words(data, offsets)
    hashes = hasher.ranges(hasher.prefix(data), starts, ends)
    grams, _, of = windows(hashes, doc, SHINGLE)
    n = len(offsets) - 1
    bounds = np.searchsorted(of, np.arange(n + 1))
    word_bounds = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for i in range(n):
        some = grams[bounds[i]:bounds[i + 1]]
        count = word_bounds[i + 1] - word_bounds[i]
        if 0 < count < SHINGLE:
            some, _, _ = windows(hashes[word_bounds[i]:word_bounds[i + 1]], np.zeros(count, int), int(count))
            some = mix(some + np.uint64(count))
        out.append(distinct(some))
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def permutations(seed: int = 7, hashes: int = HASHES):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        h = x[lo:lo + 1024, None] * a
        h += b
        np.minimum(best, h.min(axis=0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    """(documents, bands) keys of (documents, bands x ROWS) minima."""
    part = m.reshape(len(m), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, part.shape[1] + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key.view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    low = (m & 15).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity from packed signatures (words of 64 bits)."""
    differ = one ^ many
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    differ &= np.uint64(0x1111111111111111)
    same = 1.0 - np.bitwise_count(differ).sum(axis=-1) / (one.shape[-1] * 64 // BITS)
    chance = 2.0 ** -BITS
    return (same - chance) / (1 - chance)


def lowest_estimate(percent: int, bands: int) -> float:
    j = percent / 100
    return j - ERRORS * float(np.sqrt(j * (1 - j) / (bands * ROWS))) / (1 - 2.0 ** -BITS)


SIGNED = "doc_id long, row long, n long, a long, b long, sig binary, bands array<long>"


def identity(doc_id: str, text: str) -> F.Column:
    """64-bit hash of a row's id and text: rows that share it are equal, and of one class."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int = BANDS) -> DataFrame:
    """(doc_id, row identity, set size, 128-bit set digest, packed signature, band keys)."""
    def run(batches):
        hasher, (mul, add) = Hasher(7), permutations(hashes=bands * ROWS)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids = batch.column(0)
            for first, d, o in pieces(data, offsets):
                sets = shingle_sets(d, o, hasher)
                m = np.stack([minima(s, mul, add) for s in sets])
                n = np.array([len(s) for s in sets], np.int64)
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets],
                               np.uint64).view(np.int64)
                keys = band_keys(m)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)).cast(pa.int64()), batch.column(2).slice(first, len(sets)),
                     pa.array(n), pa.array(one), pa.array(two),
                     pa.array([r.tobytes() for r in pack(m)], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands,
                                              pa.array(keys.reshape(-1)))],
                    ["doc_id", "row", "n", "a", "b", "sig", "bands"])

    return docs.select(F.col(doc_id).cast("long"), text, identity(doc_id, text).alias("_row")).mapInArrow(run, SIGNED)


def plausible(pairs: DataFrame, percent: int, bands: int) -> DataFrame:
    """Pairs (x, xa, y, ya) whose packed signatures allow the bound; drops the signatures."""
    least = lowest_estimate(percent, bands)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64)
                        .reshape(batch.num_rows, -1) for c in ("sx", "sy")]
            yield batch.select(["x", "xa", "y", "ya"]).filter(pa.array(agreement(one, two) >= least))

    return pairs.mapInArrow(run, "x long, xa long, y long, ya long")


def keep_texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rep, a, z): compressed text of each wanted class, from the row that stands for it."""
    rows = docs.filter(F.col(doc_id).isNotNull()).select(identity(doc_id, text).alias("rep"), F.col(text).alias("t")).join(
        wanted.select(F.col("rep"), F.col("a").alias("wanted_a")), "rep")

    def run(batches):
        import zstandard

        hasher, packer = Hasher(7), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = flat(batch.column("t"))
            asked = batch.column("wanted_a").to_pylist()
            keep, found = [], []
            for first, d, o in pieces(data, offsets):
                for i, s in enumerate(shingle_sets(d, o, hasher)):
                    if int(np.array([s.sum(dtype=np.uint64)]).view(np.int64)[0]) == asked[first + i]:
                        keep.append(first + i)
                        found.append(packer.compress(d[o[i]:o[i + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(pa.array(keep, pa.int64())),
                 batch.column("wanted_a").take(pa.array(keep, pa.int64())), pa.array(found, pa.binary())],
                ["rep", "a", "z"])

    return rows.mapInArrow(run, "rep long, a long, z binary").dropDuplicates(["rep", "a"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(x, y) of the pairs (x, xa, y, ya) whose full sets reach the bound.

    Members stream past their leader's set; a leader of many members is dealt
    out in parts.
    """
    parts = pairs.groupBy("x", "xa").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    leaders = parts.join(texts.select(F.col("rep").alias("x"), F.col("a").alias("xa"), "z"), ["x", "xa"])
    leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "x", "xa", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("y"), "z")
    members = pairs.join(parts, ["x", "xa"]).withColumn(
        "part", F.pmod(F.xxhash64("y", "ya"), F.col("parts")).cast("int")).join(
        texts.select(F.col("rep").alias("y"), F.col("a").alias("ya"), "z"), ["y", "ya"]).select(
        "x", "xa", "part", F.lit(1).alias("kind"), "y", "z")
    dealt = leaders.unionByName(members).repartition("x", "xa", "part").sortWithinPartitions(
        "x", "xa", "part", "kind")

    def run(batches):
        import zstandard

        hasher, unpack, key, leader = Hasher(7), zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("x", "xa", "part", "kind", "y", "z")]
            for x, xa, part, kind, y, z in zip(*columns):
                raw = np.frombuffer(unpack.decompress(z), np.uint8)
                found = shingle_sets(raw, np.array([0, len(raw)]), hasher)[0]
                if kind == 0:
                    key, leader = (x, xa, part), found
                elif key == (x, xa, part):
                    if reaches(leader, found, percent):
                        out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()),
                                                  pa.array([p[1] for p in out], pa.int64())], ["x", "y"])

    return dealt.mapInArrow(run, "x long, y long")


class Bucket:
    """One block of a bucket's members; their sets are unpacked when first needed."""

    def __init__(self, rows):
        self.rep, self.a, self.n = [np.array([r[i] for r in rows], np.int64) for i in range(3)]
        self.component = np.array([r[3] for r in rows], np.int64)
        self.sig = np.stack([np.frombuffer(r[4], np.uint64) for r in rows])
        self.bands = np.stack([np.array(r[5], np.int64) for r in rows])
        self.z, self.sets = [r[6] for r in rows], {}

    def set_of(self, i: int, unpack) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = unpack(self.z[i])
        return self.sets[i]

    def links(self, band: int, query, percent: int, least: float, unpack):
        """Ids of members that ``query`` links, one a component it is not in.

        A pair is looked at in the first band that it shares, by its greater id.
        """
        rep, a, n, component, sig, bands, z = query
        at = np.flatnonzero((self.component != component) & ((self.rep < rep) | ((self.rep == rep) & (self.a < a))))
        sizes = self.n[at]
        at = at[100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)]
        at = at[(self.bands[at, :band] != bands[:band]).all(axis=1)]
        if not len(at):
            return
        estimate = agreement(sig, self.sig[at])
        order = np.argsort(-estimate, kind="stable")
        own, joined = None, set()
        for i in at[order][estimate[order] >= least].tolist():
            if self.component[i] in joined:
                continue
            if own is None:
                own = unpack(z)
            if reaches(own, self.set_of(i, unpack), percent):
                joined.add(self.component[i])
                yield int(self.rep[i])


def reaches(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as ``percent``."""
    if len(one) > len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    both = int((two[at] == one).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def across(members: DataFrame, percent: int, bands: int) -> DataFrame:
    """Links (x, y) between components that share a bucket.

    ``members`` has band, key, rep, a, n, component, sig, bands and the
    compressed text z.  A bucket is dealt out in blocks of ``BLOCK`` members; its
    members stream past each block.  Pairs whose sizes and signatures allow the
    bound are confirmed on the full sets where they meet; only links leave.
    """
    least = lowest_estimate(percent, bands)
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sized = members.join(sizes, "key")
    entries = sized.withColumn("block", F.pmod(F.xxhash64("rep", "a"), F.col("blocks")).cast("int")) \
        .withColumn("kind", F.lit(0))
    asked = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("kind", F.lit(1))
    columns = ["key", "block", "kind", "band", "rep", "a", "n", "component", "sig", "bands", "z"]
    dealt = entries.select(*columns).unionByName(asked.select(*columns)).repartition(
        "key", "block").sortWithinPartitions("key", "block", "kind")

    def run(batches):
        import zstandard

        hasher, packer = Hasher(7), zstandard.ZstdDecompressor()

        def unpack(z):
            raw = np.frombuffer(packer.decompress(z), np.uint8)
            return shingle_sets(raw, np.array([0, len(raw)]), hasher)[0]

        key, rows, bucket = None, [], None
        for batch in batches:
            out = []
            for k, part, kind, band, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, part) != key:
                    key, rows, bucket = (k, part), [], None
                if kind == 0:
                    rows.append(member)
                    continue
                if bucket is None and rows:
                    bucket = Bucket(rows)
                if bucket is not None:
                    rep, a, n, component, sig, bands, z = member
                    query = (rep, a, n, component, np.frombuffer(sig, np.uint64), np.array(bands, np.int64), z)
                    out.extend((x, rep) for x in bucket.links(band, query, percent, least, unpack))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64())
                                                  for i in range(2)], ["x", "y"])

    return dealt.mapInArrow(run, "x long, y long")


def texts_of_one_id(worded: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y): links between the classes of every id that has several."""
    kind = F.struct("a", "b")
    several = worded.groupBy("doc_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).filter("low <> high")
    own = worded.join(several, "doc_id").select("doc_id", "a", "b", "low").distinct()
    reps = classes.select("a", "b", F.col("rep").alias("y"))
    low = classes.select(F.col("a").alias("low_a"), F.col("b").alias("low_b"), F.col("rep").alias("x"))
    return own.withColumn("low_a", F.col("low.a")).withColumn("low_b", F.col("low.b")).join(
        reps, ["a", "b"]).join(low, ["low_a", "low_b"]).filter("x <> y").select("x", "y")


def grouped(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
            bands: int = BANDS, one_id: bool = True) -> tuple[DataFrame, str]:
    """(doc_id, row, n, first_id, first_row), one row per row of ``docs``, and its path.

    ``first_id`` and ``first_row`` are the smallest id of a row's component and the row
    that stands for it; null without words or id.  ``one_id`` links the texts of an id.
    """
    if bands % 8:
        raise ValueError("bands must be a multiple of eight")
    spark = docs.sparkSession
    signed, signed_path = store(signatures(docs, doc_id, text, bands), "signatures")
    worded = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = worded.groupBy("a", "b").agg(
        F.min("row").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands"))
    classes, classes_path = store(classes, "classes")
    banded = classes.select(F.posexplode("bands").alias("band", "key"), "rep", "a")
    heads = banded.groupBy("key").agg(F.min(F.struct("rep", "a")).alias("head"), F.count("*").alias("size"))
    # Stored, so that the join has an exchange of its own and can split a hot key.
    heads, heads_path = store(heads.filter(F.col("size") > 1), "heads")
    shared, shared_path = store(banded.join(heads, "key").select("band", "key", "rep", "a", "head"), "buckets")

    sig = classes.select("rep", "a", "sig")
    with_sig = lambda pairs: pairs.join(
        sig.select(F.col("rep").alias("x"), F.col("a").alias("xa"), F.col("sig").alias("sx")), ["x", "xa"]).join(
        sig.select(F.col("rep").alias("y"), F.col("a").alias("ya"), F.col("sig").alias("sy")), ["y", "ya"])
    texts, texts_path = store(keep_texts(docs, shared.select("rep", "a").distinct(), doc_id, text), "texts")
    paths = [signed_path, classes_path, heads_path, shared_path, texts_path]
    other = (F.col("x") != F.col("y")) | (F.col("xa") != F.col("ya"))
    member = None

    def settle(found: DataFrame) -> None:
        """Bring the components up to date with newly confirmed links."""
        nonlocal member
        found, path = store(found, "links")
        paths.append(path)
        # What is known already stands for the links behind it.
        member, path = connected_components(found if member is None else found.unionByName(member.toDF("x", "y")))
        paths.append(path)

    def likely(pairs: DataFrame) -> DataFrame:
        """Those pairs whose signatures allow the bound, stored."""
        pairs, path = store(plausible(with_sig(pairs), percent, bands), "pairs")
        paths.append(path)
        return pairs

    def placed(rows: DataFrame, rep: str, out: str) -> DataFrame:
        return rows.join(member.select(F.col("node").alias(rep), F.col("component").alias(out)), rep, "left") \
            .withColumn(out, F.coalesce(out, rep))

    # 1. Every member with the smallest head of its buckets.
    stars = shared.select(F.col("head.rep").alias("x"), F.col("head.a").alias("xa"),
                          F.col("rep").alias("y"), F.col("a").alias("ya")).filter(other)
    least = stars.groupBy("y", "ya").agg(F.min(F.struct("x", "xa")).alias("h")).select(
        "h.x", "h.xa", "y", "ya")
    links = confirm(likely(least), texts, percent)
    if one_id:
        links = links.unionByName(texts_of_one_id(worded, classes))
    settle(links)

    def still_open() -> DataFrame:
        """Members of the buckets that hold several components."""
        rows = placed(shared, "rep", "component")
        keys = rows.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        return rows.join(keys, "key", "left_semi")

    # 2. With its other buckets' heads, where they lie in another component.
    apart = still_open().select(F.col("head.rep").alias("x"), F.col("head.a").alias("xa"),
                                F.col("rep").alias("y"), F.col("a").alias("ya"), "component").distinct()
    apart = placed(apart, "x", "cx").filter("cx != component").select("x", "xa", "y", "ya")
    settle(confirm(likely(apart), texts, percent))
    # 3. Whatever else shares a bucket that still holds several components.
    settle(across(still_open().join(classes.select("rep", "a", "n", "sig", "bands"), ["rep", "a"]).join(
        texts, ["rep", "a"]), percent, bands))

    per_class = classes.select("a", "b", "rep").join(
        member.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "a", "b", F.coalesce("component", "rep").alias("component"))
    placed_rows, path = store(worded.select("doc_id", "row", "n", "a", "b").join(per_class, ["a", "b"]).select(
        "doc_id", "row", "n", "component"), "members")
    paths.append(path)
    first = placed_rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    # Stored, so that the join has an exchange of its own and can split a large component.
    first, path = store(first, "firsts")
    paths.append(path)
    named = placed_rows.join(first, "component").select(
        "doc_id", "row", "n", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))
    none = F.lit(None).cast("long")
    rest = signed.filter((F.col("n") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "row", "n", none.alias("first_id"), none.alias("first_row"))
    result, path = store(named.unionByName(rest), "minhash")
    drop(spark, *paths)
    return result, path


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    percent: int = PERCENT, bands: int = BANDS) -> tuple[DataFrame, str]:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``, and its path.

    A lower ``percent`` than the default needs more ``bands``.
    """
    rows, path = grouped(docs, doc_id=doc_id, text=text, percent=percent, bands=bands)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first_id", "doc_id").alias(
        "component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), path


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each group, that with the smallest id; rows without words or id stay, equal rows are one."""
    rows, _ = grouped(docs, doc_id=doc_id, text=text, one_id=False, **settings)
    row, kept_row = fresh(docs, "row", "kept_row")
    kept = rows.filter(F.col("doc_id").isNotNull() & (F.col("first_row").isNull() | (
        F.col("first_row") == F.col("row")))).select(F.col("row").alias(kept_row)).distinct()
    one = docs.filter(F.col(doc_id).isNotNull()).withColumn(row, identity(doc_id, text)).join(
        kept, F.col(row) == F.col(kept_row), "left_semi").dropDuplicates([row]).drop(row)
    return one.unionByName(docs.filter(F.col(doc_id).isNull()))


def query(spark, sf_dir) -> DataFrame:
    """op7: component of every document."""
    from wayfarer.session import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, **OP7)[0]
