"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature is SYMBOLS minima of BITS bits. Two documents are candidates when at most DISTANCE symbols differ.
The signature is split into CHUNKS chunks of four symbols; if at most DISTANCE symbols differ, the pigeonhole
principle leaves a chunk with at most one error (none would mean at least 2 * CHUNKS = 40 errors). The allowed error
of a chunk is enumerated: each of its four symbols is left out in turn, so a chunk gives four keys, and every pair
under the threshold meets in one of them.

At a similarity of exactly 0.75 a symbol differs with probability 1/4; more than 37 of 80 differ with a
probability of about 5e-6, and far less often above. Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navloom.llm.components import components, with_more_links
from navloom.llm.membership import written_with
from navloom.llm.texts import as_bytes, mixed, rows_pass, shingles, word_hashes, words
from navloom.session import cut_lineage

SYMBOLS, CHUNKS, DISTANCE = 80, 20, 37
#: a key with more documents than this is not joined with itself but thinned out and linked by stars
WIDE = 24
#: rounds of stars before what is left of wide keys is compared by prefixes of the full sets
STARS = 2
#: keys that are counted in one task
KEYS_EACH = 300_000
#: places of the table of shingle counts that orders them
COUNTS = 1 << 20
FACTORS = np.random.default_rng(8).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: shingles taken at once; bounds memory for very long documents
BLOCK = 4_096


def signature(sets: np.ndarray) -> np.ndarray:
    """SYMBOLS minima under multiply-shift hashes, 16 low bits of each mixed minimum."""
    low = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for i in range(0, len(sets), BLOCK):
        block = sets[i:i + BLOCK]
        np.minimum(low, (block[None, :] * FACTORS[:, None]).min(axis=1), out=low)
    return mixed(low).astype("<u2")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature its keys as (signatures, CHUNKS * 4): chunk and three of its four symbols in 64 bits."""
    parts = sig.reshape(len(sig), CHUNKS, 4).astype(np.uint64)
    chunk = np.arange(CHUNKS, dtype=np.uint64)[None, :]
    out = []
    for left_out in range(4):
        a, b, c = (parts[:, :, i] for i in range(4) if i != left_out)
        out.append((chunk * np.uint64(4) + np.uint64(left_out)) << np.uint64(48) | a << np.uint64(32)
                   | b << np.uint64(16) | c)
    return np.stack(out, axis=2).reshape(len(sig), -1)


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (names the whole set), sig (empty sets have neither)."""

    def per_batch(batch):
        for i, data in zip(batch["k"].to_pylist(), as_bytes(batch["t"])):
            found = shingles(word_hashes(words(data)))
            if len(found):
                yield (i, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(),
                       signature(found).tobytes())
            else:
                yield i, 0, None, None

    return rows_pass(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), per_batch,
                     "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def key_counts(reps: DataFrame) -> DataFrame:
    """(k, c): the keys that stand in several representatives, and in how many.

    Most keys are unique, so they are dealt out before they are counted: a table of them on the map side would hold
    nearly every key of a task. The parts are of KEYS_EACH keys, whatever the input.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                keys = mixed(chunk_keys(stacked(batch["sig"].slice(i, 1_000))))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64))], names=["k"])

    parts = reps.count() * CHUNKS * 4 // KEYS_EACH + 1
    return reps.select("sig").mapInArrow(run, "k bigint").repartition(parts, "k").groupBy("k").agg(
        F.count("*").alias("c")).where("c > 1")


def key_rows(reps: DataFrame, wanted) -> DataFrame:
    """(k, and the columns of reps but sig): a row for each key of a document that the filter lets through."""
    kept = [c for c in reps.columns if c != "sig"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                keys = mixed(chunk_keys(stacked(part.column("sig"))))
                row, place = np.nonzero(wanted.value.may_hold(keys.ravel()).reshape(keys.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row, place].view(np.int64)), *(part.column(c).take(pa.array(row)) for c in kept)],
                    names=["k", *kept])

    return reps.select(*kept, "sig").mapInArrow(run, ", ".join(["k bigint", *(f"{c} bigint" for c in kept)]))


def shared_keys(reps: DataFrame, counts: DataFrame) -> DataFrame:
    """(k, d, n, c): the rows of keys that several representatives have.

    A filter of fixed size drops most other keys in their task; the equi-join decides.
    """
    return written_with(counts, "k", lambda wanted: key_rows(reps.select("d", "n", "sig"), wanted).join(
        counts, "k"))


def stacked(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def narrow_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key, a < b; a key has at most WIDE rows.

    rows: k, d, n, root, shared (null for documents without a wide key). A key's rows become one list of at most
    WIDE entries, which is matched with itself.
    """
    listed = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("d", "n", "root", "shared"))).alias("l"))

    def fits(x, y):
        return ((y.n * 100 >= x.n * percent) & (x.n * 100 >= y.n * percent) & (x.root != y.root)
                & (x.shared.isNull() | y.shared.isNull() | can_link(x.n, y.n, x.shared, y.shared, percent)))

    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(
        F.filter(F.slice(F.col("l"), i + 2, F.size("l")), lambda y: fits(x, y)),
        lambda y: F.struct(x.d.alias("a"), y.d.alias("b")))))
    return listed.where(F.size("l") > 1).select(F.inline(pairs))


def near_by_signature(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Of distinct pairs those with at most DISTANCE differing symbols."""
    both = pairs.join(sigs.select(F.col("d").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("d").alias("b"), F.col("sig").alias("sb")), "b")

    def per_batch(batch):
        a, b = stacked(batch["sa"]), stacked(batch["sb"])
        keep = np.flatnonzero((a != b).sum(axis=1) <= DISTANCE)
        yield from zip(*(batch[c].to_numpy()[keep].tolist() for c in ("a", "b")))

    return rows_pass(both.select("a", "b", "sa", "sb"), per_batch, "a bigint, b bigint")


def sets_of(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """(d, s): the shingle sets of the documents in `ids` (d).

    A filter of fixed size keeps the other texts from leaving their task; what passes it by chance does no harm.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(key).alias("x"))

    def made(wanted):
        def per_batch(batch):
            keep = np.flatnonzero(wanted.value.may_hold(batch["x"].to_numpy()))
            for i, data in zip(batch["k"].take(pa.array(keep)).to_pylist(), as_bytes(batch["t"].take(pa.array(keep)))):
                yield i, shingles(word_hashes(words(data))).tobytes()

        return rows_pass(source, per_batch, "d bigint, s binary").dropDuplicates(["d"])

    return written_with(ids.select(F.xxhash64("d").alias("x")), "x", made)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    both = pairs.join(sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")

    def check(batch):
        for a, b, sa, sb in zip(*(batch[c].to_pylist() for c in ("a", "b", "sa", "sb"))):
            sa, sb = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            common = len(np.intersect1d(sa, sb, assume_unique=True))
            if 100 * common >= percent * (len(sa) + len(sb) - common):
                yield a, b

    return rows_pass(both.select("a", "b", "sa", "sb"), check, "a bigint, b bigint")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(s, c): the shingles that several of the sets have, and how many have them."""

    def exploded(batches):
        for batch in batches:
            for one in batch["s"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(one, np.int64))], names=["s"])

    return cut_lineage(sets.select("s").mapInArrow(exploded, "s bigint").groupBy("s").agg(
        F.count("*").alias("c")).where("c > 1"))


def shared_counts(sets: DataFrame, common: DataFrame) -> DataFrame:
    """(d, n, shared): how many shingles a document has, and how many of them some other of `sets` has too.

    Two documents have at most the smaller of their shared counts in common, whatever passage they share with
    thousands. A filter of fixed size holds the shingles that several sets have.
    """

    def made(wanted):
        def per_batch(batch):
            for d, one in zip(batch["d"].to_pylist(), batch["s"].to_pylist()):
                hit = wanted.value.may_hold(np.frombuffer(one, np.uint64))
                yield d, len(hit), int(hit.sum())

        return rows_pass(sets, per_batch, "d bigint, n bigint, shared bigint")

    return written_with(common.select("s"), "s", made)


def rare_pairs(crowd: DataFrame, sets: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components that a prefix filter on the full sets can't rule out.

    crowd: d, n, shared, root. With all shingles in one order, two sets of the similarity share one among the first
    n - ceil(percent * n / 100) + 1 of each. The order goes from rare to frequent: shingles that no other set has come
    first, then by a table of counts whose size is fixed (counts that fall together only make the order worse), so what
    thousands of documents share is outside the prefixes of all that have anything else.
    """
    spark = crowd.sparkSession
    places = F.col("s").bitwiseAND(F.lit(COUNTS - 1)).cast("int")
    table = common.groupBy(places.alias("p")).agg(F.max("c").alias("c")).toArrow()
    counts = np.zeros(COUNTS, np.int64)
    counts[table["p"].to_numpy()] = table["c"].to_numpy()
    held = spark.sparkContext.broadcast(counts)

    def prefixes(wanted):
        def per_batch(batch):
            given = (batch[c].to_pylist() for c in ("d", "n", "shared", "root", "s"))
            for d, n, shared, root, one in zip(*given):
                found = np.frombuffer(one, np.uint64)
                known = wanted.value.may_hold(found)
                order = np.lexsort((found, np.where(known, held.value[found & np.uint64(COUNTS - 1)], 0)))
                first = order[:n - (percent * n + 99) // 100 + 1]
                for place in np.flatnonzero(known[first]).tolist():
                    yield int(found[first[place]].view(np.int64)), d, n, shared, root, place

        return rows_pass(crowd.join(sets, "d").select("d", "n", "shared", "root", "s"), per_batch,
                         "s bigint, d bigint, n bigint, shared bigint, root bigint, place bigint")

    rows = written_with(common.select("s"), "s", prefixes)
    held.destroy()
    several = rows.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    rows = cut_lineage(rows.join(several, "s"))
    other = rows.toDF("s", "e", "m", "shared2", "root2", "place2")
    # what is shared from the first common shingle on is enough
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2"))
    return cut_lineage(rows.join(other, "s").where(
        (F.col("d") < F.col("e")) & (F.col("root") != F.col("root2"))
        & can_link(F.col("n"), F.col("m"), F.col("shared"), F.col("shared2"), percent)
        & ((100 + percent) * most >= percent * (F.col("n") + F.col("m")))).select(
        F.col("d").alias("a"), F.col("e").alias("b")).distinct())


def can_link(n, m, shared, other, percent: int):
    """Whether sets of n and m shingles, of which so many are shared with any others, can reach the similarity."""
    most = F.least(shared, other)
    return 100 * most >= percent * (n + m - most)


def linked(reps: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """(node, root) over all confirmed links between representatives (d, n, sig).

    Of the documents of wide keys those stay that share enough with others of them; keys that are narrow by then are
    treated as such. The documents of a key that is still wide are compared with one of them, and those that stay alone
    once more among each other; what such stars join needs no further pairs. Narrow keys give all their pairs across components, and what wide keys
    still hold in several components is compared in full across them.

    Between the steps a crowded document is one row with its signature; its keys are made from that when they are
    needed, and only those that are.
    """
    spark = reps.sparkSession
    counts = cut_lineage(key_counts(reps))
    keyed = shared_keys(reps, counts)
    narrow = keyed.where(F.col("c") <= WIDE).select("k", "d", "n")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    shared = spark.createDataFrame([], "d bigint, shared bigint")
    crowded = counts.where(F.col("c") > WIDE)
    crowd = None
    if not crowded.isEmpty():
        wide_sets = sets_of(docs, keyed.where(F.col("c") > WIDE).select("d").distinct(), text, key)
        common = shared_shingles(wide_sets)
        shared = shared_counts(wide_sets, common)
        stay = shared.where(100 * F.col("shared") >= percent * F.col("n")).select("d", "shared")
        crowd = cut_lineage(reps.join(stay, "d"))
        rows = written_with(crowded.select("k"), "k", lambda wanted: key_rows(crowd, wanted))
        counts = cut_lineage(rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"))
        narrow = narrow.unionByName(rows.join(counts.where(F.col("c") <= WIDE), "k").select("k", "d", "n"))
        crowded = cut_lineage(counts.where(F.col("c") > WIDE).select("k"))
        for round_ in range(STARS):
            if round_:  # documents that no star has linked yet
                alone = crowd.join(roots, F.col("d") == F.col("node"), "left_anti")
                rows = written_with(crowded, "k", lambda wanted: key_rows(alone, wanted))  # noqa: B023
            # first the document that shares most with others, then others at random
            rank = F.col("shared") / F.col("n") if not round_ else F.xxhash64("d", F.lit(round_))
            middle = rows.groupBy("k").agg(
                F.max(F.struct(rank.alias("r"), "d", "n", "shared")).alias("m"), F.count("*").alias("c")).where(
                F.col("c") > (1 if round_ else WIDE)).select("k", "m.d", "m.n", "m.shared")
            star = rows.join(middle.toDF("k", "m", "mn", "ms"), "k").where(
                (F.col("d") != F.col("m")) & can_link(F.col("n"), F.col("mn"), F.col("shared"), F.col("ms"), percent))
            star = cut_lineage(star.select(F.least("d", "m").alias("a"), F.greatest("d", "m").alias("b")).distinct())
            if star.isEmpty():
                break
            # most of a star's pairs are linked, so they go to the full sets at once
            roots = with_more_links(roots, cut_lineage(confirmed(star, wide_sets, percent)))
    rows = narrow.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").join(
        shared.select("d", "shared"), "d", "left").select("k", "d", "n", F.coalesce("root", "d").alias("root"), "shared")
    pairs = cut_lineage(near_by_signature(cut_lineage(narrow_pairs(rows, percent).distinct()), reps))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    more = cut_lineage(confirmed(pairs, sets_of(docs, ids, text, key), percent))
    roots = with_more_links(roots, more)
    if crowd is None:
        return roots
    pairs = rare_pairs(rooted(crowd, roots).drop("sig"), wide_sets, common, percent)
    return roots if pairs.isEmpty() else with_more_links(roots, cut_lineage(confirmed(pairs, wide_sets, percent)))


def rooted(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(d, n, shared, root, sig) of the crowded documents."""
    return crowd.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").select(
        "d", "n", "shared", F.coalesce("root", "d").alias("root"), "sig")


def near_groups(docs: DataFrame, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their 5-word shingle sets (words
    `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer words make one shingle). Null and empty texts have no shingle and
    are linked with nothing. Documents with one set are one class and joined by its smallest id, without pairs.
    Repeated rows of an id share its verdict, and where different texts stand under one id one of them stands for
    all; rows without an id link with nothing. An empty table gives no rows; only the key and text are read.
    """
    made = cut_lineage(signatures(docs, text, key))
    full = made.where("n_shingles > 0")
    classes = cut_lineage(full.groupBy("set_key").agg(F.min("doc_id").alias("d")))
    # the smallest id of a class may stand in several rows; one stands for the class
    reps = full.join(classes, [full.set_key == classes.set_key, full.doc_id == classes.d]).groupBy("d").agg(
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    reps = cut_lineage(reps)
    roots = linked(reps, docs, text, key, percent)
    named = classes.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").select(
        "set_key", F.coalesce("root", "d").alias("component_id"))
    return made.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
