"""Language identification with bit-sliced Bloom filters over character n-grams.

*Fit.*  Lower-cased letters, with runs of anything else as one blank, are cut
into n-grams.  An n-gram belongs to a language when its share of that
language's n-grams is at least ``ratio`` of its largest share in any language.
N-grams as rare as accidents are left out: in a large sample those seen fewer
than ``RARE`` times, in a small one none (see ``least_count``).
All languages share one Bloom filter whose slot ``j`` is a bit mask: bit ``l``
is slot ``j`` of language ``l``'s own filter.  A mask has as many 64-bit words as
the languages need, and the filter as many slots as its largest language needs.

*Decide.*  ANDing the slots of an n-gram's hashes returns every language that
contains it.  The popcount of a language over a text is corrected for its false
positives, from the fill of its slice: ``(hits - n * p) / (1 - p)``.  The
largest count decides, ties by language name; its part of all counts is the
score.

The fit takes a sample of at most about ``per_language`` documents a language
(chosen by a hash of the id, so reruns agree); decisions read whole texts.
The sample is read once; its n-gram counts are a written table, and executors
set the filter's bits, so that the driver gets only the filter.

Defined cases: null text, or text without a letter, is ``und`` with score 0; if
no language was learned, as from an empty table, everything is ``und``; a
language whose sampled texts have no letter is not learned; a text with no known
n-gram is the first language by name with score 0; documents with a null id are
decided but not learned from; repeated rows are each decided, and learned from as
often as they occur; texts of any length are read whole, in slices.  Columns of
the documents are kept, whatever their names; ``into`` replaces one of that name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import short_batches, spare_name, written

PER_LANGUAGE = 1500
SLOTS = 1 << 18
HASHES = 3
GRAMS = (2, 3, 4)
RATIO = 0.4
#: Count below which an n-gram of a large sample is left out, and the n-grams of a sample for each such count.
RARE = 3
PER_COUNT = 1_000_000
UNKNOWN = "und"
#: Languages in one word of a mask.
WORD = 64
#: Most characters worked on at once.
SLICE_CHARS = 1 << 19

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, words parted and surrounded by one blank."""
    out, before, any_ = [], True, False  # in slices, as four bytes a character add up
    text = f" {text.lower()} "
    for at in range(0, len(text), SLICE_CHARS):
        points = np.frombuffer(text[at : at + SLICE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of blanks
        keep[0] |= before
        before, any_ = bool(letter[-1]), any_ or bool(letter.any())
        out.append(np.where(letter, points, 32)[keep].astype(np.uint32))
    return np.concatenate(out) if any_ else np.empty(0, np.uint32)


def grams(points: np.ndarray, sizes=GRAMS) -> np.ndarray:
    """64-bit hashes of all n-grams."""
    wide, out = points.astype(np.uint64), []
    for n in sizes:
        if len(wide) < n:
            continue
        count = len(wide) - n + 1
        h = np.full(count, np.uint64(n))
        for i in range(n):
            h = (h ^ wide[i : i + count]) * _ODD[0]
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _all_grams(points: np.ndarray, sizes) -> Iterator[np.ndarray]:
    """The n-grams of a long text in slices; slices overlap so that none is lost."""
    for n in sizes:
        for at in range(0, max(0, len(points) - n + 1), SLICE_CHARS):
            yield grams(points[at : at + SLICE_CHARS + n - 1], (n,))


def _counted(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of about ``SLICE_CHARS`` n-grams at a time; sums over all are exact."""
    held: list[np.ndarray] = []
    size = 0
    for h in parts:
        held.append(h)
        size += len(h)
        if size >= SLICE_CHARS:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


class BitSlicedBloom:
    """One Bloom filter a language, held as a mask of languages in each slot: ``masks`` is [words, slots], or [slots] for one word."""

    def __init__(self, languages: list[str], masks: np.ndarray, hashes: int = HASHES):
        self.languages, self.masks, self.hashes = languages, masks, hashes
        words = np.atleast_2d(masks)
        fill = np.array([((words[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false_rate = fill**hashes

    @staticmethod
    def slots(h: np.ndarray, k: int, size: int) -> np.ndarray:
        x = (h ^ (h >> np.uint64(31))) * _ODD[k + 1]
        return ((x ^ (x >> np.uint64(27))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, languages: list[str], members: dict[str, np.ndarray], size: int = SLOTS, hashes: int = HASHES):
        masks = np.zeros((max(1, -(-len(languages) // WORD)), size), np.uint64)
        for i, name in enumerate(languages):
            for k in range(hashes):
                masks[i // WORD, np.unique(cls.slots(members[name], k, size))] |= np.uint64(1 << i % WORD)
        return cls(languages, masks[0] if len(masks) == 1 else masks, hashes)

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages of each n-gram, by word first if there are several."""
        size = self.masks.shape[-1]
        out = self.masks[..., self.slots(h, 0, size)]
        for k in range(1, self.hashes):
            out &= self.masks[..., self.slots(h, k, size)]
        return out

    def counts(self, text: str, sizes=GRAMS) -> tuple[np.ndarray, int]:
        """Popcounts by language, corrected, and the number of n-grams."""
        hits, n = np.zeros(len(self.languages)), 0
        for h in _all_grams(codes(text), sizes):
            words = np.atleast_2d(self.containing(h))
            n += len(h)
            for i in range(len(self.languages)):
                hits[i] += np.count_nonzero(words[i // WORD] & np.uint64(1 << i % WORD))
        return np.clip((hits - n * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)), 0, None), n

    def decide(self, text: str | None, sizes=GRAMS) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        counts, n = self.counts(text, sizes)
        if not n:
            return UNKNOWN, 0.0
        best = int(np.argmax(counts))
        return self.languages[best], float(counts[best] / counts.sum()) if counts.sum() > 0 else 0.0


def held_out(doc_id: str = "doc_id"):
    """The fold that the fit never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def least_count(total: int) -> int:
    """Count that an n-gram needs in a language's sample of ``total`` n-grams: ``RARE`` in large samples, 1 in small ones."""
    return max(1, min(RARE, total // PER_COUNT))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, ratio: float = RATIO, slots: int | None = None) -> BitSlicedBloom:
    """Learn from the text and non-null language of the documents outside the held-out fold."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("l").isNotNull() & ~held_out("i"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # reads no text
    nothing = BitSlicedBloom([], np.zeros(1, np.uint64))
    if not sizes:
        return nothing
    rate = F.create_map(*(x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))))
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(F.col("t").isNotNull() & (draw < F.element_at(rate, F.col("l"))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, part in rows.groupby("l"):
                for h, n in _counted(h for t in part["t"] for h in _all_grams(codes(t), GRAMS)):
                    yield pd.DataFrame({"l": name, "h": h.view(np.int64), "n": n})

    counts, _ = written(sample.select("l", "t").mapInPandas(count, "l string, h long, n long").groupBy("h", "l").agg(F.sum("n").alias("n")), "gram-counts")
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return nothing
    names = sorted(totals)
    known = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.struct(F.lit(i).alias("at"), F.lit(float(totals[name])).alias("total"), F.lit(least_count(totals[name])).alias("least")))))
    shares = counts.withColumn("k", F.element_at(known, F.col("l"))).where(F.col("n") >= F.col("k.least")).select("h", F.col("k.at").alias("at"), (F.col("n") / F.col("k.total")).alias("share"))
    best = shares.groupBy("h").agg(F.max("share").alias("top"), F.collect_list(F.struct("share", "at")).alias("all"))  # at most one a language
    members, _ = written(best.select("h", F.explode(F.filter("all", lambda x: x["share"] >= F.lit(ratio) * F.col("top"))).alias("x")).select("h", "x.at"), "gram-languages")
    largest = members.groupBy("at").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    size = slots or 1 << max(SLOTS.bit_length() - 1, (2 * largest - 1).bit_length())

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            h, at = rows["h"].to_numpy(np.int64).view(np.uint64), rows["at"].to_numpy(np.int64)
            for k in range(HASHES):
                made = pd.DataFrame({"word": at // WORD, "slot": BitSlicedBloom.slots(h, k, size), "mask": (np.uint64(1) << (at % WORD).astype(np.uint64)).view(np.int64)})
                yield made.drop_duplicates()

    marked = members.mapInPandas(mark, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most a row a slot and word
    masks = np.zeros((max(1, -(-len(names) // WORD)), size), np.uint64)
    masks[marked["word"].to_numpy(), marked["slot"].to_numpy()] = marked["mask"].to_numpy(np.int64).view(np.uint64)
    return BitSlicedBloom(names, masks[0] if len(masks) == 1 else masks)


def identifier(docs: DataFrame, model: BitSlicedBloom):
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.hashes))

    @F.pandas_udf("lang_pred string, score double")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = BitSlicedBloom(*held.value)
        for texts in batches:
            yield pd.DataFrame([model.decide(t) for t in texts], columns=["lang_pred", "score"])

    return decide.asNondeterministic()  # or a filter on its result would run it twice


def identify(docs: DataFrame, model: BitSlicedBloom, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score."""
    short_batches(docs.sparkSession)
    return docs.withColumn(into, identifier(docs, model)(F.col(text)))


def keep_identified(docs: DataFrame, model: BitSlicedBloom, *, languages: list[str] | None = None, min_score: float | None = None, **options) -> DataFrame:
    """The documents in one of ``languages`` (all learned ones if None) with at least ``min_score``.

    A score is a share among all learned languages, so the default is 0.3, or
    twice an equal share where there are more than six.
    """
    min_score = min(0.3, 2 / max(1, len(model.languages))) if min_score is None else min_score
    name = spare_name(docs, "language")
    found = identify(docs, model, into=name, **options)
    known = F.col(f"{name}.lang_pred").isin(*(languages or model.languages or [""]))
    return found.where(known & (F.col(f"{name}.score") >= min_score)).drop(name)
