"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from navloom.llm.membership import written_with
from navloom.llm.texts import as_bytes, mixed, rows_pass, word_hashes, words
from navloom.session import cut_lineage

#: items with fewer words than this are searched for as whole sequences
LEAST_WORDS = 5
#: items with fewer words than this are searched for through the short masks
SPAN = 10
#: Fixed masks; a 0 ignores the word there. Found by a covering search: wherever a quarter of an item's words are
#: replaced, one mask meets only kept words at some place. That is enumerated for 10 to 19 words (5 to 9 for the short
#: masks); a longer item is cut into such parts, one of which has no more than a quarter of its words replaced.
MASKS = ("110111", "1101000011", "11100011", "110000001011")
SHORT_MASKS = ("11011", "1111", "11000011", "11101", "10111")
#: masks of items under five words: every word counts
WHOLE_MASKS = tuple("1" * n for n in range(1, LEAST_WORDS))
ALL_MASKS = MASKS + SHORT_MASKS + WHOLE_MASKS
#: words a passage of an item has at least, and a piece of one that is added up
PASSAGE, PIECE = 13, 4
#: shifts at which the pieces of an item with words put in or left out are added up
NEAR = 5
#: words of documents that are hashed at once
BLOCK_WORDS = 200_000
#: odd factors of the places in a window
FACTORS = np.random.default_rng(3).integers(
    1, 2**63, max(map(len, ALL_MASKS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: the result's columns
FOUND = "doc_id bigint, item_id bigint, n_matches int, n_words int, first_word int, end_word int, similarity double"
FOUND_NAMES = [field.split()[0] for field in FOUND.split(", ")]


def bare_words(text: bytes) -> list[bytes]:
    """Words without the ASCII signs around them; words of signs only are dropped."""
    stripped = (w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in words(text))
    return [w for w in stripped if w]


def seeds(hashes: np.ndarray, lens: np.ndarray, masks, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every window under the masks of these numbers, for texts one behind the other.

    `hashes` are the words of all texts and `lens` how many each has. `keep`, if given, says which hashes are of
    interest.
    """
    ends = np.cumsum(lens)
    weighted = [hashes * f for f in FACTORS]
    out = []
    for number in masks:
        mask = ALL_MASKS[number]
        n = len(hashes) - len(mask) + 1
        if n > 0:
            total = np.full(n, number + 1, np.uint64)
            for i, on in enumerate(mask):
                if on == "1":
                    total += weighted[i][i:i + n]
            total = mixed(total)
            at = np.arange(n) if keep is None else np.flatnonzero(keep(total))
            text = np.searchsorted(ends, at, "right")
            whole = at + len(mask) <= ends[text]
            out.append((total[at[whole]], text[whole], (at - ends[text] + lens[text])[whole]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def masks_for(n_words: int) -> range:
    """Numbers of the masks an item of so many words is searched for through."""
    if n_words < LEAST_WORDS:
        return range(len(ALL_MASKS) - LEAST_WORDS + n_words, len(ALL_MASKS) - LEAST_WORDS + n_words + 1)
    return range(len(MASKS)) if n_words >= SPAN else range(len(MASKS), len(MASKS + SHORT_MASKS))


def item_seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the seeds that stand for an item."""
    h, _, at = seeds(hashes, np.array([len(hashes)]), masks_for(len(hashes)))
    return h, at


def items_of(benchmark: DataFrame, text: str, key: str) -> DataFrame:
    """(item_id, seeds, places, words) of the items with words; equal items keep one row."""

    def per_batch(batch):
        for i, data in zip(batch["k"].to_pylist(), as_bytes(batch["t"])):
            hashes = word_hashes(bare_words(data))
            if len(hashes):
                h, at = item_seeds(hashes)
                yield i, h.view(np.int64).tolist(), at.tolist(), hashes.tobytes()

    made = rows_pass(benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")), per_batch,
                     "item_id bigint, seeds array<bigint>, places array<bigint>, words binary")
    return made.groupBy("words").agg(
        F.min("item_id").alias("item_id"), F.first("seeds").alias("seeds"), F.first("places").alias("places"))


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(matches, first, end) of the item laid on the document at `shift`: its words that agree, place by place."""
    first, end = max(shift, 0), min(shift + len(item), len(doc))
    same = np.flatnonzero(doc[first:end] == item[first - shift:end - shift])
    return len(same), first, end


def laid_on(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int, int]:
    """(matches, first, end) of the shift with most matches, then the first."""
    n, first, end = max((n, -first, end) for n, first, end in (overlap(doc, item, s) for s in set(shifts)))
    return n, -first, end


def stretch(same: np.ndarray, least: int, percent: int) -> tuple[int, int] | None:
    """(first, end) of the longest run of at least `least` places of which `percent` are true, from true to true."""
    ends = np.flatnonzero(same) + 1
    if not len(ends) or len(same) < least:
        return None
    sums = np.concatenate([[0], np.cumsum(np.where(same, 100, 0) - percent)])
    low = np.minimum.accumulate(np.where(same, sums[:-1], 100 * len(same)))
    # for every end, the first start whose sum is no higher
    starts = np.searchsorted(-low, -sums[ends], "left")
    longest = int((ends - starts).argmax())
    first, end = int(starts[longest]), int(ends[longest])
    return (first, end) if end - first >= least else None


def pieces(same: np.ndarray, least: int, percent: int) -> np.ndarray:
    """The true places that lie in a window of `least` places of which `percent` are true."""
    if len(same) < least:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(same)])
    dense = np.flatnonzero(100 * (sums[least:] - sums[:-least]) >= percent * least)
    places = np.unique((dense[:, None] + np.arange(least)).ravel())
    return places[same[places]]


def passage(doc: np.ndarray, item: np.ndarray, shifts: list[int], percent: int) -> tuple[int, int, int] | None:
    """(matches, first, end) of a passage of the item in the document, none if there is none.

    A passage is a stretch of at least PASSAGE places (the whole item, if it is shorter) of which `percent` agree at
    one of the shifts, or pieces at shifts next to one of them that hold `percent` of the item's words together.
    """
    best = None
    for s in sorted(set(shifts)):
        first, end = max(s, 0), min(s + len(item), len(doc))
        same = doc[first:end] == item[first - s:end - s]
        run = stretch(same, min(PASSAGE, len(item)), percent)
        if run:
            n = int(same[run[0]:run[1]].sum())
            best = max(best or (0, 0, 0), (n, -(first + run[0]), first + run[1]))
    if best:
        return best[0], -best[1], best[2]
    held: dict[int, np.ndarray] = {}
    for s in sorted(set(shifts)):
        found, low, high = np.zeros(len(item), bool), len(doc), 0
        for near in range(s - NEAR, s + NEAR + 1):
            first, end = max(near, 0), min(near + len(item), len(doc))
            if end - first < PIECE:
                continue
            if near not in held:
                held[near] = pieces(doc[first:end] == item[first - near:end - near], PIECE, percent) + first
            if len(held[near]):
                found[held[near] - near] = True
                low, high = min(low, int(held[near][0])), max(high, int(held[near][-1]) + 1)
        if 100 * found.sum() >= percent * len(item):
            best = max(best or (0, 0, 0), (int(found.sum()), -low, high))
    return best and (best[0], -best[1], best[2])


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, text: str = "text", key: str = "doc_id",
                 item_text: str = "text", item_key: str = "item_id", passages: bool = True) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, n_matches, n_words, first_word,
    end_word, similarity.

    An item is found where at least `percent` of its words stand in the document in its order, others being
    replaced one for one; an item under five words, where it stands as a whole. Words are lower-cased and bare of
    signs. Fixed masks hash windows of words, each leaving out other places; test and training hashes are joined, and
    the words around each hit are compared. No placement of replaced words escapes the masks at 75 percent or more.

    With `passages`, an item is also found where only a passage of it stands: PASSAGE running words (or the whole of
    a shorter item) of which `percent` agree, or pieces that words put in or left out have moved by up to NEAR places
    and that hold `percent` of the item together. Matches, first and end are then those of the passage.

    Null and empty texts hold nothing; equal items are reported under the smallest id; rows of one id are one document,
    whose best place is reported, and each row without an id is a document of its own; of several places the one with
    most matches, then the first, is reported. Other columns are not read.

    Only documents with a hash that a filter of fixed size may hold leave their task, as word hashes.
    """
    items = cut_lineage(items_of(benchmark, item_text, item_key))
    tests = items.select("item_id", F.inline(F.arrays_zip("seeds", "places"))).toDF("item_id", "h", "at")
    # masks no item is searched for through aren't laid on documents
    lengths = [r["n"] for r in items.select(
        F.least(F.length("words") / 8, F.lit(SPAN)).cast("int").alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_for(n)})
    if not masks:
        return docs.sparkSession.createDataFrame([], FOUND)
    least = min(len(ALL_MASKS[m]) for m in masks)

    def hits_of(wanted, ids: list, texts: list[np.ndarray]):
        lens = np.array([len(t) for t in texts])
        h, text, place = seeds(np.concatenate(texts), lens, masks, wanted.value.may_hold)
        order = np.argsort(text, kind="stable")
        starts = np.flatnonzero(np.diff(text[order], prepend=-1))
        for part in np.split(order, starts[1:]) if len(order) else []:
            t = int(text[part[0]])
            yield ids[t], h[part].view(np.int64).tolist(), place[part].tolist(), texts[t].tobytes()

    def made(wanted):
        def per_batch(batch):
            ids, texts, n = [], [], 0
            for i, data in zip(batch["k"].to_pylist(), as_bytes(batch["t"])):
                hashes = word_hashes(bare_words(data))
                if len(hashes) >= least:
                    ids.append(i)
                    texts.append(hashes)
                    n += len(hashes)
                if n >= BLOCK_WORDS:
                    yield from hits_of(wanted, ids, texts)
                    ids, texts, n = [], [], 0
            if texts:
                yield from hits_of(wanted, ids, texts)

        return rows_pass(
            docs.select(F.col(key).alias("k"), F.col(text).alias("t")), per_batch,
            "doc_id bigint, seeds array<bigint>, places array<bigint>, words binary").withColumn(
            "row", F.monotonically_increasing_id())

    found = written_with(tests.select("h").distinct(), "h", made)
    hits = found.select("row", F.inline(F.arrays_zip("seeds", "places"))).toDF("row", "h", "place")
    laid = hits.join(tests, "h").groupBy("row", "item_id").agg(
        F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    around = laid.join(found.select("row", "doc_id", F.col("words").alias("doc")), "row").join(
        items.select("item_id", F.col("words").alias("item")), "item_id")

    def verify(batch):
        for r, d, i, shifts, doc, item in zip(*(batch[c].to_pylist() for c in
                                                ("row", "doc_id", "item_id", "shifts", "doc", "item"))):
            doc, item = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
            n, first, end = laid_on(doc, item, shifts)
            if 100 * n < percent * len(item):
                part = passage(doc, item, shifts, percent) if passages else None
                if part is None:
                    continue
                n, first, end = part
            yield r, d, i, n, len(item), first, end, n / len(item)

    rows = rows_pass(around, verify, f"row bigint, {FOUND}")
    document = F.when(F.col("doc_id").isNull(), F.col("row"))
    best = F.struct(F.col("n_matches").alias("m"), (-F.col("first_word")).alias("p"), *FOUND_NAMES[2:])
    return rows.groupBy("doc_id", document.alias("row"), "item_id").agg(F.max(best).alias("best")).select(
        "doc_id", "item_id", *[F.col(f"best.{c}").alias(c) for c in FOUND_NAMES[2:]])
