"""Subject areas of documents by distributed latent Dirichlet allocation.

Each language has its own topics, fitted without labels: variational Bayes with Dirichlet priors on the topics of a
document and on the words of a topic. The first topic has a greater prior and stands for words that any text may hold.
Topics start from groups of words that keep company in all documents, found by subspace iteration; every pass of it and
every round after is one map over all documents, whose sums are combined by word and dimension or topic. Words are
numbered by hash into a fixed number of buckets, so that none is left out and the model's size doesn't grow with the
corpus.

Labels, all of them, only serve to read the topics: a topic stands for the subject whose labelled documents hold most of its top
terms, or for none where no subject stands out. Sentences, list items and table rows treat a subject when the topic
proportions of their document give at least half a word of theirs to topics of that subject; documents are assigned
from the shares of their sentences.
"""

from __future__ import annotations

import html
import io
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.runtime import arrow_map, cut_lineage, read_bytes, write_bytes

#: Topics of a language, word buckets of a language, rounds over all documents.
TOPICS, BUCKETS, ROUNDS = 24, 1 << 16, 3
#: Of the start: dimensions of a word's company, passes over all documents, what is added to the number of documents of
#: a word and of words of a document (times their means), beginnings of the grouping.
DIMENSIONS, PASSES, EVEN, TRIES = 24, 4, 0.3, 8
#: Dirichlet priors: of the general topic and the others in a document, of a word in a topic.
GENERAL, ALPHA, BETA = 2.0, 0.1, 0.01
SHARE = 0.25
#: Part of a topic's top terms that a subject's labelled documents must hold, and its lead over the next subject.
HELD, LEAD = 0.3, 1.5
#: Words (expected) by which a sentence treats a subject.
TREATED = 0.5
#: Characters of texts, and documents, that are worked on at a time.
CHUNK_CHARS, CHUNK_DOCUMENTS = 2 << 20, 1000

# Frequent function words by language, by which languages are told apart; they are no terms.
FUNCTION_WORDS = {
    "en": "the of and to in is was that it for on with as at by from this be are or an not which has have its".split(),
    "de": "der die das und ist nicht ein eine den dem des zu mit auf für von im sich auch es wie bei noch aus wird sind".split(),
    "fr": "le les des et est une un du dans que qui pour pas sur au aux par avec ce cette ne se sont plus ou à été où".split(),
    "es": "el los las y es una un del en que por con para no se su al lo como más pero esta fue sobre está son".split(),
}
LANGUAGES = list(FUNCTION_WORDS)
# Letters that French joins to the next word by an apostrophe.
ELIDED = "cdjlns"

_LINE = re.compile(r"\r\n|[\r\n\u2028\u2029\x0b\x0c\x85]")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+")
_FENCE = re.compile(r"`{3,}|~{3,}")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
_MARKER = re.compile(r"^\s*(?:>\s*)*(?:[-*+•‣]\s+|\d{1,4}[.)]\s+|\[[ xX]\]\s+)*")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_RULE = re.compile(r"[\s|:=_*+-]*$")


def sentences(text: str) -> list[str]:
    """Sentences, list items and table rows of a text; headings, rules and closed fenced code are none."""
    text = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
    fenced = "```" in text or "~~~" in text
    out: list[str] = []
    held: list[str] | None = None  # lines since a fence opened
    for line in _LINE.split(text):
        for k, part in enumerate(_FENCE.split(line) if fenced else (line,)):
            if k:
                if held is None:
                    held = []
                    continue  # what follows an opening fence names a language
                held = None
            if held is not None:
                held.append(part)
            elif part:
                out += _units(part)
    return out + [s for line in held or () for s in _units(line)]


def _units(line: str) -> list[str]:
    if _RULE.match(line) or _HEADING.match(line):
        return []
    body = _MARKER.sub("", line)
    return [body] if body.startswith("|") else [s for s in _SENTENCE.split(body) if s.strip()]


LETTER, HIDDEN, END = 1, 2, 3
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point: letter, invisible format sign, line feed or other."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x30000):  # the planes that have letters
        if chr(code).isalpha():
            out[code] = LETTER
        elif unicodedata.category(chr(code)) == "Cf":
            out[code] = HIDDEN
    out[10] = END
    return out


def _hash_words(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of letters: its unit, its hash, its length, and whether it is a letter joined by an apostrophe.
    Case, compatibility forms and invisible signs don't count."""
    text = "\n".join(units).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    if (kind == HIDDEN).any():
        codes, kind = codes[kind != HIDDEN], kind[kind != HIDDEN]
    letter = kind == LETTER
    edge = np.diff(np.r_[0, letter.astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - begin
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(bool)
    first = np.cumsum(length) - length
    place = np.minimum(np.arange(int(length.sum())) - np.repeat(first, length), 63)
    mixed = np.add.reduceat(codes[letter].astype(np.uint64) * _POWERS[place], first)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    after = np.r_[codes, 0][end]
    joined = (length == 1) & ((after == 0x27) | (after == 0x2019)) & np.isin(codes[begin], [ord(c) for c in ELIDED])
    return np.cumsum(kind == END)[begin], mixed, length, joined


@lru_cache(maxsize=1)
def _function_hashes() -> list[np.ndarray]:
    return [np.sort(_hash_words([" ".join(words)])[1]) for words in FUNCTION_WORDS.values()]


def bucket_of(words: list[str]) -> np.ndarray:
    """Bucket of each word (one run of letters each)."""
    return (_hash_words(words)[1] % np.uint64(BUCKETS)).astype(np.int64)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


@dataclass
class Terms:
    """Terms of a batch: document and language of each sentence, sentence and bucket of each term. Sentences are in
    order of documents, terms in order of sentences."""

    doc: np.ndarray
    language: np.ndarray
    sentence: np.ndarray
    bucket: np.ndarray


def terms_of(texts: list[str]) -> Terms:
    """Terms of texts: words of at least two letters that are no function words of the sentence's language. That is
    the language with most function words in the sentence, or in the document where the sentence doesn't tell."""
    rows = [sentences(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
    units = [u for r in rows for u in r]
    sizes = np.cumsum([len(u) + 1 for u in units]) if units else np.zeros(0, np.int64)
    parts, at = [], 0
    while at < len(units):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_CHARS)))
        sentence, *rest = _hash_words(units[at:stop])
        parts.append((sentence + at, *rest))
        at = stop
    sentence, hashes, length, joined = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, bool))
    function = [_among(hashes, marks) for marks in _function_hashes()]
    votes = np.stack([np.bincount(sentence[f], minlength=len(units)) for f in function], 1)
    votes[:, LANGUAGES.index("fr")] += np.bincount(sentence[joined], minlength=len(units))
    whole = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    np.add.at(whole, doc, votes)
    common = whole.argmax(1)[doc] if len(doc) else doc
    best = (votes * (whole.max(initial=0) + 1) + whole[doc]).argmax(1) if len(doc) else doc
    each = np.arange(len(units))
    language = np.where(votes[each, best] >= votes[each, common] + 2, best, common).astype(np.int64)
    own = np.zeros(len(hashes), bool)
    for k, f in enumerate(function):
        own |= f & (language[sentence] == k)
    keep = (length > 1) & ~own
    return Terms(doc, language, sentence[keep], (hashes[keep] % np.uint64(BUCKETS)).astype(np.int64))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND text != ''")


#: Types of the numbers in encoded documents; a term is a bucket.
LENGTH, MARK, TERM = np.dtype("<i4"), np.dtype("i1"), np.dtype("<u2")


def encode(documents: DataFrame) -> DataFrame:
    """`doc_id`, `lengths` (terms of each sentence), `marks` (its language) and `terms` (buckets) of every text that
    isn't empty, each a run of numbers as bytes, which is cheaper to read than arrays; written, as every round starts
    from it."""
    schema = pa.schema([("doc_id", pa.int64()), ("lengths", pa.binary()), ("marks", pa.binary()), ("terms", pa.binary())])

    def runs(counts: np.ndarray, numbers: np.ndarray) -> pa.Array:
        ends = np.r_[0, np.cumsum(counts) * numbers.itemsize].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, by_text=1):
            t = terms_of(batch.column(1).to_pylist())
            lengths = np.bincount(t.sentence, minlength=len(t.doc))
            sentences_of = np.bincount(t.doc, minlength=batch.num_rows)
            terms_in = np.bincount(t.doc, weights=lengths, minlength=batch.num_rows)
            lists = [(sentences_of, lengths.astype(LENGTH)), (sentences_of, t.language.astype(MARK)), (terms_in, t.bucket.astype(TERM))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[runs(n, v) for n, v in lists]], schema=schema)

    return cut_lineage(arrow_map(_texts(documents), run, "doc_id bigint, lengths binary, marks binary, terms binary"), "encoded")


def _slices(batches: Iterator[pa.RecordBatch], by_text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is held at a time stays small: of a bounded number of rows and, with the number
    of a text column, of bounded text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(by_text)), 0).to_numpy() if by_text is not None else np.ones(batch.num_rows, np.int64)
        most = CHUNK_CHARS if by_text is not None else CHUNK_DOCUMENTS
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            stop = min(max(stop, at + 1), at + CHUNK_DOCUMENTS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def _arrays(batch: pa.RecordBatch) -> Terms:
    lengths, _ = _numbers(batch.column("lengths"), LENGTH)
    marks, sentences_of = _numbers(batch.column("marks"), MARK)
    terms, _ = _numbers(batch.column("terms"), TERM)
    return Terms(np.repeat(np.arange(batch.num_rows), sentences_of), marks, np.repeat(np.arange(len(lengths)), lengths), terms)


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of runs, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return np.frombuffer(held.tobytes(), kind).astype(np.int64), np.diff(ends) // kind.itemsize


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by its recurrence and asymptotic series."""
    out = np.zeros_like(x)
    for k in range(5):
        out -= 1 / (x + k)
    y = x + 5
    f = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f / 252))


@dataclass
class Topics:
    """Topics of one language: buckets that were seen and, for each, the expected counts by topic."""

    bucket: np.ndarray
    counts: np.ndarray

    def weights(self) -> np.ndarray:
        """Exponent of the expected logarithm of each word's share of a topic, for all buckets."""
        total = self.counts.sum(0) + BETA * BUCKETS
        out = np.zeros((BUCKETS, self.counts.shape[1]), np.float32)
        out[self.bucket] = np.exp(_digamma(self.counts + BETA) - _digamma(total))
        return out


def infer(doc: np.ndarray, bucket: np.ndarray, documents: int, weights: np.ndarray, *, rounds: int = 8, sums: np.ndarray | None = None) -> np.ndarray:
    """Variational parameters of the documents' topic proportions, by matrix products over blocks of documents.
    With `sums` the expected counts by bucket and topic are added there. `doc` must be sorted."""
    topics = weights.shape[1]
    alpha = np.full(topics, ALPHA, np.float32)
    alpha[0] = GENERAL
    out = np.tile(alpha, (documents, 1))
    for rows, seen, counts in _blocks(doc, bucket, documents):
        words = weights[seen]
        gamma = alpha + counts.sum(1, keepdims=True) / topics
        for _ in range(rounds):
            mixed = np.exp(_digamma(gamma))
            gamma = alpha + mixed * ((counts / (mixed @ words.T + 1e-30)) @ words)
        mixed = np.exp(_digamma(gamma))
        if sums is not None:
            sums[seen] += words * ((counts / (mixed @ words.T + 1e-30)).T @ mixed)
        out[rows] = gamma
    return out


def _blocks(doc: np.ndarray, bucket: np.ndarray, documents: int, size: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of documents that have terms: their rows, the buckets in them, and the counts of documents by buckets.
    `doc` must be sorted."""
    cuts = np.searchsorted(doc, np.arange(0, documents + size, size))
    there, code = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low == high:
            continue
        first, number = k * size, min(size, documents - k * size)
        there[bucket[low:high]] = True
        seen = np.flatnonzero(there)
        there[seen] = False
        code[seen] = np.arange(len(seen))
        counts = np.bincount((doc[low:high] - first) * len(seen) + code[bucket[low:high]], minlength=number * len(seen)).reshape(number, len(seen))
        yield slice(first, first + number), seen, counts.astype(np.float32)


def _by_language(t: Terms) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: its number, the documents that have terms of it, and of each such term which of these
    documents it is in and its own number."""
    language, doc = t.language[t.sentence], t.doc[t.sentence]
    for k in np.flatnonzero(np.bincount(language)):
        term = np.flatnonzero(language == k)
        first = np.r_[True, np.diff(doc[term]) > 0]  # documents are in order
        yield int(k), doc[term][first], np.cumsum(first) - 1, term


def _sums(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], width: int) -> dict[int, Topics]:
    """What `function` counts in each task by language, bucket and column (of `width`), summed up over all tasks; at most
    one row a bucket of each language leaves a task or reaches the driver."""
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, sums in function(batches):
            seen = np.flatnonzero(sums.any(1))
            columns = [pa.array(c) for c in np.ascontiguousarray(sums[seen].T, np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), language, np.int32)), pa.array(seen.astype(np.int32)), *columns], names=["language", "bucket", *names])

    rows = arrow_map(df, run, ", ".join(["language int, bucket int", *(f"{n} double" for n in names)]))
    table = rows.groupBy("language", "bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    language, bucket, *columns = (c.to_numpy() for c in table.columns)
    order = np.lexsort((bucket, language))
    language, bucket, counts = language[order], bucket[order].astype(np.int64), np.stack(columns, 1)[order]
    return {int(k): Topics(bucket[language == k], counts[language == k]) for k in np.unique(language)}


def first_topics(coded: DataFrame, topics: int = TOPICS) -> dict[int, Topics]:
    """Topics of every language to start from: groups of words that keep company in all documents.

    A word's company is its place in the leading dimensions of correspondence analysis of documents and words, which
    subspace iteration finds (fixed seed): a pass gives each document the mean of its words' places and each word the
    mean of its documents'. Words of few documents and documents of few words are drawn to the middle. A word starts in
    its group's topic by its nearness to the group's centre, else in the general topic."""
    known = _sums(coded, _spreads, 3)
    dice = np.random.default_rng(7)
    root, common, place, added = {}, {}, {}, {}
    for k, t in sorted(known.items()):
        spread = t.counts[:, 1]
        root[k] = np.sqrt(spread + EVEN * spread.mean())
        common[k] = np.sqrt(spread / spread.sum())  # the dimension that tells only how frequent words are
        place[k] = dice.standard_normal((len(spread), DIMENSIONS))
        added[k] = EVEN * spread.sum() / t.counts[:, 2].sum()
    for _ in range(PASSES):
        now = {}
        for k, t in known.items():
            base = np.linalg.qr(place[k] - np.outer(common[k], common[k] @ place[k]))[0]
            scaled = np.zeros((len(base), DIMENSIONS), np.float32)
            scaled[:, : base.shape[1]] = base / root[k][:, None]  # fewer dimensions where a language has fewer words
            now[k] = Topics(t.bucket, scaled)
        moved = _sums(coded, lambda batches, now=now: _meet(batches, now, added), DIMENSIONS)
        for k, t in known.items():
            place[k] = np.zeros((len(t.bucket), DIMENSIONS))
            if k in moved:
                place[k][np.searchsorted(t.bucket, moved[k].bucket)] = moved[k].counts
            place[k] /= root[k][:, None]
            place[k] -= np.outer(common[k], common[k] @ place[k])
    out = {}
    for k, t in known.items():
        group, near = _groups(place[k] / root[k][:, None], t.counts[:, 1], topics - 1)
        start = np.zeros((len(t.bucket), topics))
        start[:, 0] = t.counts[:, 0] * (1 - near)
        start[np.arange(len(start)), group + 1] += t.counts[:, 0] * near
        out[k] = Topics(t.bucket, start)
    return out


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Of one task's documents, by bucket: its terms, the documents that hold it, and its part of these documents (one
    by their number of buckets), which sums up to the number of documents."""
    sums: dict[int, np.ndarray] = {}
    for batch in _slices(batches):
        t = _arrays(batch)
        for k, docs, code, term in _by_language(t):
            for _, seen, counts in _blocks(code, t.bucket[term], len(docs)):
                held = np.minimum(counts, 1)
                columns = [counts.sum(0), held.sum(0), (1 / np.maximum(held.sum(1), 1)) @ held]
                sums.setdefault(k, np.zeros((BUCKETS, 3)))[seen] += np.stack(columns, 1)
    yield from sums.items()


def _meet(batches: Iterator[pa.RecordBatch], now: dict[int, Topics], added: dict[int, float]) -> Iterator[tuple[int, np.ndarray]]:
    """Of one task's documents, by bucket: the sum over documents that hold it of the mean place of their buckets.
    `added` goes to a document's number of buckets."""
    places: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in _slices(batches):
        t = _arrays(batch)
        for k, docs, code, term in _by_language(t):
            if k not in places:
                places[k] = np.zeros((BUCKETS, DIMENSIONS), np.float32)
                places[k][now[k].bucket] = now[k].counts
                sums[k] = np.zeros((BUCKETS, DIMENSIONS))
            for _, seen, counts in _blocks(code, t.bucket[term], len(docs)):
                held = np.minimum(counts, 1)
                mean = held @ places[k][seen] / (held.sum(1, keepdims=True) + np.float32(added[k]))
                sums[k][seen] += held.T @ mean
    yield from sums.items()


def _groups(rows: np.ndarray, weight: np.ndarray, groups: int, moves: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Group of each row by its direction and its nearness to the group's centre, from 0 to 1. Centres are drawn far
    apart (fixed seed) and then moved; of `TRIES` beginnings the one whose rows are nearest to their centres counts."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 1e-12)
    weight = weight * (norm[:, 0] > 1e-12)
    dice, best = np.random.default_rng(7), (-1.0, np.zeros(len(rows), np.int64), np.zeros(len(rows)))
    for _ in range(TRIES):
        centres, far = [], np.ones(len(rows))
        for _ in range(groups):
            chance = weight * np.maximum(far, 0) ** 2
            if chance.sum() <= 0:
                break
            chosen = dice.choice(len(rows), p=chance / chance.sum())
            centres.append(rows[chosen])
            far = np.minimum(far, 1 - rows @ rows[chosen])
        if not centres:
            break
        centre = np.array(centres)
        for _ in range(moves):
            near = rows @ centre.T
            own = near.argmax(1)[:, None] == np.arange(len(centre))
            moved = own.T.astype(np.float64) @ (rows * (weight * near.max(1))[:, None])
            length = np.linalg.norm(moved, axis=1, keepdims=True)
            centre = np.where(length > 0, moved / np.maximum(length, 1e-12), centre)
        near = rows @ centre.T
        if (total := float(weight @ near.max(1))) > best[0]:
            best = (total, near.argmax(1), np.clip(near.max(1), 0, 1))
    return best[1:]


@dataclass
class Model:
    """Topics by language and the subject (number, -1 for none) that each stands for."""

    subjects: list[str]
    topics: dict[int, Topics]
    stands_for: dict[int, np.ndarray] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as one file, through the file system that Spark sees."""
        arrays = {f"{name}{k}": a for k, t in self.topics.items() for name, a in (("bucket", t.bucket), ("counts", t.counts), ("stands", self.stands_for[k]))}
        out = io.BytesIO()
        np.savez_compressed(out, subjects=np.array(self.subjects), **arrays)
        write_bytes(spark, path, out.getvalue())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """The model of a file that `save` wrote."""
        with np.load(io.BytesIO(read_bytes(spark, path))) as held:
            languages = [int(n.removeprefix("bucket")) for n in held.files if n.startswith("bucket")]
            return Model(held["subjects"].tolist(), {k: Topics(held[f"bucket{k}"], held[f"counts{k}"]) for k in languages}, {k: held[f"stands{k}"] for k in languages})


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, rounds: int = ROUNDS, topics: int = TOPICS) -> tuple[Model, DataFrame]:
    """The model fitted on all documents, and the encoded documents.

    Topics start from the company that words keep in all documents and are refitted in `rounds` rounds over all.
    `labels` name subjects in any case and with blanks around, unknown names don't count; all labelled documents take
    part in the map of topics to subjects.
    """
    coded = encode(documents)
    found = first_topics(coded, topics)
    for _ in range(rounds):
        found = _sums(coded, lambda batches, now=found: _round(batches, now), topics)

    names = [r["subject"] for r in subjects.select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    keys = {name.strip().lower(): k for k, name in enumerate(names)}
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isin(list(keys)))
    sets = known.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("named"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            weight = np.zeros((batch.num_rows, len(names)))
            for d, named in enumerate(batch.column("named").to_pylist()):
                weight[d, [keys[n] for n in named]] = 1 / len(named) ** 2
            t = _arrays(batch)
            for k, docs, code, term in _by_language(t):
                for rows, seen, counts in _blocks(code, t.bucket[term], len(docs)):
                    sums.setdefault(k, np.zeros((BUCKETS, len(names))))[seen] += np.minimum(counts, 1).T @ weight[docs[rows]]
        yield from sums.items()

    held = _sums(coded.join(sets, "doc_id").select("doc_id", "lengths", "marks", "terms", "named"), count, max(len(names), 1))
    model = Model(names, found)
    for k, t in found.items():
        model.stands_for[k] = mapped(t, held.get(k, Topics(np.zeros(0, np.int64), np.zeros((0, len(names))))))
    return model, coded


def _round(batches: Iterator[pa.RecordBatch], now: dict[int, Topics]) -> Iterator[tuple[int, np.ndarray]]:
    """Expected counts of one task's documents."""
    weights: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in _slices(batches):
        t = _arrays(batch)
        for k, docs, code, term in _by_language(t):
            if k not in weights:
                weights[k] = now[k].weights()
                sums[k] = np.zeros_like(weights[k])
            infer(code, t.bucket[term], len(docs), weights[k], sums=sums[k])
    yield from sums.items()


def top_terms(topics: Topics, k: int, top: int = 20) -> np.ndarray:
    """Rows of `topics` with the terms that are frequent in topic `k` and particular to it."""
    part = topics.counts[:, k] / np.maximum(topics.counts.sum(1), 1e-9)
    score = topics.counts[:, k] * part**2
    order = np.lexsort((topics.bucket, -score))[:top]
    return order[score[order] > 0.5]


def mapped(topics: Topics, labelled: Topics) -> np.ndarray:
    """The subject that each topic stands for: the one whose labelled documents hold most of its top terms, each term
    counting by its share of the subject (`labelled`: counts by bucket and subject). A topic whose top terms are spread
    over subjects, stand in no labelled document or aren't there stands for none (-1); so does the general one."""
    out = np.full(topics.counts.shape[1], -1)
    if not labelled.counts.size:
        return out
    totals = labelled.counts.sum(0)
    shares = labelled.counts / np.where(totals > 0, totals, 1)
    shares /= np.maximum(shares.sum(1, keepdims=True), 1e-300)
    table = np.zeros((BUCKETS, shares.shape[1]))
    table[labelled.bucket] = shares
    for k in range(1, len(out)):
        terms = topics.bucket[top_terms(topics, k)]
        if not len(terms):
            continue
        held = table[terms].mean(0)
        best = int(held.argmax())
        if held[best] >= HELD and held[best] >= LEAD * np.delete(held, best).max(initial=0):
            out[k] = best
    return out


def topic_terms(documents: DataFrame, model: Model, top: int = 12) -> DataFrame:
    """For inspection: `language`, `topic`, `subject` (null for none), `place` and `term` of each topic's top terms. A
    bucket reads as its most frequent word; one pass over the texts."""
    wanted = [(k, topic, place, int(t.bucket[row])) for k, t in model.topics.items() for topic in range(t.counts.shape[1]) for place, row in enumerate(top_terms(t, topic, top), 1)]
    buckets = np.unique([w[3] for w in wanted]) if wanted else np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, by_text=1):
            words = pc.value_counts(pa.array(re.findall(r"[^\W\d_]{2,}", unicodedata.normalize("NFKC", " ".join(batch.column(1).to_pylist()).casefold())), pa.string()))
            names, counts = words.field("values"), words.field("counts")
            if not len(names):
                continue
            hashed = _hash_words(names.to_pylist())
            bucket = np.full(len(names), -1)
            bucket[hashed[0]] = (hashed[1] % np.uint64(BUCKETS)).astype(np.int64)
            at = pa.array(np.flatnonzero(_among(bucket, buckets)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket).take(at), names.take(at), counts.take(at)], names=["bucket", "term", "n"])

    words = arrow_map(_texts(documents), run, "bucket bigint, term string, n bigint").groupBy("bucket", "term").agg(F.sum("n").alias("n"))
    named = words.groupBy("bucket").agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    rows = [(LANGUAGES[k], topic, model.subjects[model.stands_for[k][topic]] if model.stands_for[k][topic] >= 0 else None, place, bucket) for k, topic, place, bucket in wanted]
    return documents.sparkSession.createDataFrame(rows, "language string, topic int, subject string, place int, bucket bigint").join(named, "bucket").select("language", "topic", "subject", "place", "term")


def proportions(coded: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `subject`, `n_sentences` and `share` among the document's sentences that treat any subject."""
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("n_sentences", pa.int64()), ("share", pa.float64())])
    names = model.subjects

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            t = _arrays(batch)
            score = np.zeros((len(t.doc), len(names)))
            for k, docs, code, term in _by_language(t):
                if k not in model.topics:
                    continue
                if k not in weights:
                    weights[k] = model.topics[k].weights()
                mixed = np.exp(_digamma(infer(code, t.bucket[term], len(docs), weights[k])))
                part = mixed[code] * weights[k][t.bucket[term]]
                total = part.sum(1, keepdims=True)
                part = np.divide(part, total, out=np.zeros_like(part), where=total > 0)
                stands = (model.stands_for[k][:, None] == np.arange(len(names))).astype(part.dtype)
                first = np.flatnonzero(np.r_[True, np.diff(t.sentence[term]) > 0])  # sentences are in order
                score[t.sentence[term][first]] += np.add.reduceat(part @ stands, first)
            counts = np.zeros((batch.num_rows, len(names)), np.int64)
            treats = np.flatnonzero(score.max(1, initial=0) >= TREATED)
            np.add.at(counts, (t.doc[treats], score[treats].argmax(1) if len(names) else treats), 1)
            total = counts.sum(1)
            d, s = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([names[x] for x in s], pa.string()), pa.array(counts[d, s]), pa.array(counts[d, s] / total[d])], schema=schema)

    return arrow_map(coded, assign, "doc_id bigint, subject string, n_sentences bigint, share double")


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, share: float = SHARE) -> DataFrame:
    """`doc_id` and `subject` of every document and each subject that at least `share` of its sentences, list
    items and table rows that treat any subject treat. Documents that treat none, null and empty texts have no
    row; repeated rows give repeated results; without labels or subjects the result is empty."""
    model, coded = fit(documents, labels, subjects)
    return proportions(coded, model).filter(F.col("share") >= share - 1e-9).select("doc_id", "subject")


def corpus_composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, share: float = SHARE) -> DataFrame:
    """Share of each subject in the corpus: documents that have it, and its part of all treated sentences."""
    model, coded = fit(documents, labels, subjects)
    return composition(proportions(coded, model), share=share)


def composition(rows: DataFrame, *, share: float = SHARE) -> DataFrame:
    """`corpus_composition` of rows of `proportions`."""
    per = rows.groupBy("subject").agg(F.count_if(F.col("share") >= share - 1e-9).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
    total = F.sum("n_sentences").over(Window.partitionBy(F.lit(0)))  # over one row per subject
    return per.select("subject", "n_documents", "n_sentences", (F.col("n_sentences") / total).alias("corpus_share"))
