"""Benchmark decontamination: every training passage queries a BM25 index of the test items with block-max WAND;
items above the threshold are confirmed by the overlap of question and answer.

Scores are BM25 with each term of a passage counted once, divided by the item's own score, so that 1 means that
the passage holds every word of the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import buffers, shingles, slices, word_hashes

WIDTH = 5
OVERLAP = 0.8
THRESHOLD = 0.6
K1, B = 1.2, 0.75
# Items in a block, and postings' texts that are indexed and broadcast at a time; more items take more passes.
BLOCK = 8
SHARD_BYTES = 32 << 20
# Bytes of text that are searched at a time, and (query, posting) cells that are summed at a time, more only for one query.
_BYTES = 1 << 18
_CELLS = 1 << 18
_MARKS = 1 << 18

# ASCII bytes other than letters and digits part words, as white space does.
_PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(texts)
    words, _, _, bounds = word_hashes(_PLAIN[data], offsets)
    return words, bounds


@dataclass
class Item:
    key: int
    terms: np.ndarray
    counts: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    question_shingled: bool
    length: int


def _item(key: int, question: np.ndarray, answer: np.ndarray) -> Item:
    terms, counts = np.unique(np.concatenate([question, answer]), return_counts=True)
    shingled = len(question) >= WIDTH
    first = shingles(question, np.array([0, len(question)]), WIDTH)[0] if shingled else question
    return Item(key, terms, counts, np.unique(first), np.unique(answer), shingled, len(question) + len(answer))


@dataclass
class Statistics:
    """What the weights need to know of all items, whichever of them an index holds."""

    n_items: int
    mean_length: float
    longest: int
    # How many items have each term of the index's sorted vocabulary.
    frequency: np.ndarray


def _own_statistics(items: list[Item]) -> Statistics:
    lengths = [i.length for i in items]
    terms = np.concatenate([i.terms for i in items]) if items else np.zeros(0, np.uint64)
    return Statistics(
        len(items), float(np.mean(lengths)) if items else 1.0, max(lengths, default=1), np.unique(terms, return_counts=True)[1]
    )


def _lost(n: int) -> int:
    return int(n - np.ceil(OVERLAP * n))


class BlockMaxIndex:
    """Postings of the items in blocks, with the largest weight of each term in each block."""

    def __init__(self, items: list[Item], threshold: float = THRESHOLD, statistics: Statistics | None = None):
        # Items with like words share blocks, which keeps the maxima of other blocks low.
        self.items = sorted((i for i in items if i.length), key=lambda i: tuple(sorted(i.terms.tolist()))[:4])
        n = len(self.items)
        known = statistics or _own_statistics(self.items)
        self.vocabulary = np.unique(np.concatenate([i.terms for i in self.items])) if n else np.zeros(0, np.uint64)
        idf = np.log1p((known.n_items - known.frequency + 0.5) / (known.frequency + 0.5))
        mean = known.mean_length
        self.n_blocks = -(-n // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        self.weights = []
        for at, item in enumerate(self.items):
            place = np.searchsorted(self.vocabulary, item.terms)
            w = idf[place] * item.counts * (K1 + 1) / (item.counts + K1 * (1 - B + B * item.length / mean))
            # No item that would be confirmed falls short: the heaviest words that may be missing are left out.
            missing = _lost(len(item.question)) + _lost(len(item.answer))
            kept = np.sort(w)[: len(w) - missing].sum() if missing < len(w) else 0.0
            bound = min(threshold, kept / w.sum() - 1e-6)
            w = w / w.sum()
            self.weights.append((dict(zip(place.tolist(), w.tolist())), bound))
            for t, x in zip(place.tolist(), (w / max(bound, 1e-6)).tolist()):
                postings[t].append((at, x))
        self.in_block: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for t, x in enumerate(postings):
            for at, w in x:
                self.in_block.setdefault((t, at // BLOCK), []).append((at, w))
        # A posting list with a weight in each block that it meets; the rest of the matrix is never stored.
        self.block_of, self.block_max, ends = [], [], [0]
        for x in postings:
            w = np.array([y for _, y in x], np.float32)
            blocks, first = np.unique(np.array([at for at, _ in x]) // BLOCK, return_index=True)
            self.block_of.append(blocks)
            self.block_max.append(np.maximum.reduceat(w, first))
            ends.append(ends[-1] + len(blocks))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.block_of, self.block_max = join(self.block_of, np.int64), join(self.block_max, np.float32)
        self.block_ends = np.array(ends)
        self.term_max = np.array([max(w for _, w in x) for x in postings], np.float32)
        self.marks = np.zeros(_MARKS, bool)
        self.marks[self.vocabulary & np.uint64(_MARKS - 1)] = True
        self.longest = known.longest

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of the words that occur in the index."""
        at = np.flatnonzero(self.marks[words & np.uint64(_MARKS - 1)])
        if not len(self.vocabulary):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[term] == words[at]
        return at[same], term[same]

    def open_blocks(self, query: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) whose block maxima reach the threshold. ``query`` is sorted, its terms are distinct.

        A query whose list maxima do not reach it has no pivot, so its blocks are not looked at.
        """
        reach = np.bincount(query, self.term_max[term], minlength=n) >= 1
        alive = reach[query]
        query, term = query[alive], term[alive]
        sizes = np.diff(self.block_ends)[term]
        starts = np.append(np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))[: len(query)], len(query))
        upto = np.concatenate([[0], np.cumsum(sizes)])[starts]
        hits, blocks, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + _CELLS, side="right")) - 1)
            part = slice(starts[at], starts[to])
            hit, block = self._open_of(query[part], term[part], sizes[part])
            hits.append(hit)
            blocks.append(block)
            at = to
        return np.concatenate(hits), np.concatenate(blocks)

    def _open_of(self, query: np.ndarray, term: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The open blocks of some queries; ``sizes`` are those of their terms' posting lists."""
        rows = np.repeat(query, sizes)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.block_ends[term], sizes)
        live, rows = np.unique(rows, return_inverse=True)
        # Sums of the cells that occur: queries times blocks may be far more.
        cells, place = np.unique(rows * self.n_blocks + self.block_of[at], return_inverse=True)
        found = cells[np.bincount(place, self.block_max[at], minlength=len(cells)) >= 1]
        return live[found // max(self.n_blocks, 1)], found % max(self.n_blocks, 1)

    def search(self, terms: list[int], blocks: list[int]) -> list[int]:
        """Items of the open blocks whose scores reach the threshold; only the postings in these blocks are read."""
        found = []
        for block in blocks:
            scores: dict[int, float] = {}
            for t in terms:
                for at, w in self.in_block.get((t, block), ()):
                    scores[at] = scores.get(at, 0.0) + w
            found += [at for at, score in scores.items() if score >= 1 - 1e-6]
        return found


def _overlap(part: np.ndarray, of: np.ndarray) -> float:
    return float(np.isin(of, part).mean()) if len(of) else 1.0


def leaks_in(index: BlockMaxIndex, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(row, item key, score, question overlap, answer overlap) of the confirmed items of a slice of documents.

    Passages are windows of twice the longest item that begin at its multiples, so every stretch as long as an item
    lies in one.
    """
    step = index.longest
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n_windows = np.maximum(-(-np.diff(bounds) // step) - 1, 1)
    first = np.concatenate([[0], np.cumsum(n_windows)])
    at, term = index.lookup(words)
    row = row_of[at]
    window = (at - bounds[row]) // step
    here = window < n_windows[row]
    before = window > 0
    n_terms = max(len(index.vocabulary), 1)
    cells = np.concatenate([((first[row] + window) * n_terms + term)[here], ((first[row] + window - 1) * n_terms + term)[before]])
    cells.sort()
    if len(cells):
        cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])]
    query, term = cells // n_terms, cells % n_terms
    hit, block = index.open_blocks(query, term, int(first[-1]))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for q in np.unique(hit).tolist():
        terms = term[np.searchsorted(query, q) : np.searchsorted(query, q + 1)].tolist()
        found = index.search(terms, block[np.searchsorted(hit, q) : np.searchsorted(hit, q + 1)].tolist())
        if not found:
            continue
        r = int(np.searchsorted(first, q, side="right")) - 1
        start = bounds[r] + (q - first[r]) * step
        passage = words[start : min(start + 2 * step, bounds[r + 1])]
        runs = shingles(passage, np.array([0, len(passage)]), WIDTH)[0]
        present = set(terms)
        for i in found:
            item = index.items[i]
            asked = _overlap(runs if item.question_shingled else passage, item.question)
            answered = _overlap(passage, item.answer)
            if asked >= OVERLAP and answered >= OVERLAP:
                score = sum(w for t, w in index.weights[i][0].items() if t in present)
                best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), (score, asked, answered))
    return [(r, index.items[i].key, min(s, 1.0), q, a) for (r, i), (s, q, a) in sorted(best.items())]


def _items(batch: pa.RecordBatch | pa.Table) -> list[Item]:
    """The items of (question, answer) rows, each with the number of its row as key."""
    asked, asked_at = plain_words(_texts(batch, "question"))
    told, told_at = plain_words(_texts(batch, "answer"))
    return [
        _item(i, asked[asked_at[i] : asked_at[i + 1]], told[told_at[i] : told_at[i + 1]]) for i in range(batch.num_rows)
    ]


def _texts(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    return pa.array(batch.column(name).to_pylist(), pa.string())


def split_items(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(id, question, answer) of items that are one text: the last third of the words, at least one, is the answer."""
    words = F.split(F.trim(F.regexp_replace(text_column, r"[\x20\x09-\x0D]+", " ")), " ")
    n = F.size("words")
    k = F.greatest(F.floor(n / 3), F.lit(1)).cast("int")
    return items.select(F.col(id_column).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("words")).select(
        "id",
        F.array_join(F.slice("words", F.lit(1), F.greatest(n - k, F.lit(0))), " ").alias("question"),
        F.array_join(F.slice("words", F.greatest(n - k + 1, F.lit(1)), k), " ").alias("answer"),
    )


@dataclass
class Shard:
    index: BlockMaxIndex
    # The ids of the items by their keys, in their own type.
    ids: pa.Array


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many items of a batch each term occurs."""
    for batch in batches:
        items = [i for i in _items(batch) if i.length]
        terms, n = np.unique(np.concatenate([i.terms for i in items] or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([i.length for i in _items(batch) if i.length], pa.int64())], names=["length"])


def _shards(items: DataFrame, threshold: float) -> Iterator[Shard]:
    """Indexes of the items, each of at most about ``SHARD_BYTES`` of text, all weighed by the statistics of all items.

    The driver holds one shard at a time, and of the frequencies those of the shard's terms.
    """
    lean = items.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")]).distinct()
    size = lean.agg(F.sum(F.octet_length("question") + F.octet_length("answer"))).first()[0]
    n = max(1, -(-(size or 0) // SHARD_BYTES))
    if n > 1:
        lean = written(lean, "items")
        texts = lean.select("question", "answer")
        frequency = written(
            texts.mapInArrow(_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "frequencies"
        )
        total = texts.mapInArrow(_lengths, "length bigint").agg(
            F.count("length").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")
        ).first()
    for shard in range(n):
        mine = lean.filter(F.pmod(F.xxhash64("question", "answer"), F.lit(n)) == shard)
        table = mine.toArrow()
        found = _items(table)
        # Rows come in any order; the index is that of their contents.
        place = sorted(zip(*(table.column(c).to_pylist() for c in ("question", "answer")), map(repr, table.column("id").to_pylist()), range(len(found))))
        found = [found[row[-1]] for row in place]
        known = None
        if n > 1:
            own = mine.select("question", "answer").mapInArrow(_terms, "term bigint, n bigint").select("term").distinct()
            counts = frequency.join(own, "term").toArrow()
            terms = counts.column("term").to_numpy().view(np.uint64)
            known = Statistics(
                total.n, total.mean or 1.0, total.longest or 1, counts.column("n").to_numpy()[np.argsort(terms)]
            )
        ids = table.column("id").combine_chunks()
        yield Shard(BlockMaxIndex(found, threshold, known), ids)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) for each item that a passage of a document contains.

    ``items`` has (id, question, answer). A leak needs 0.8 of the question's five-word shingles (of its words, if it
    has fewer than five) and 0.8 of the answer's words in one passage; the threshold on the score is lowered for an
    item where a confirmed leak could miss it. Case and ASCII punctuation do not count. Null or empty texts leak
    nothing, items without words match nothing, repeated items count once, rows with equal or null ids are searched
    one by one, other columns are not read. Ids of documents and items may have any type that can be compared. Items
    beyond ``SHARD_BYTES`` of text are indexed in several shards, each with its own pass over the documents; scores
    are the same, since all shards are weighed by the statistics of all items.
    """
    lean = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type, item_type = lean.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, item_id {item_type}, score double, question_overlap double, answer_overlap double"
    found = None
    for shard in _shards(items, threshold):

        def search(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", _BYTES):
                    rows = leaks_in(shard.index, *plain_words(part.column("text")))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array([r[0] for r in rows], pa.int64())),
                            shard.ids.take(pa.array([r[1] for r in rows], pa.int64())),
                            *(pa.array([r[i] for r in rows], pa.float64()) for i in (2, 3, 4)),
                        ],
                        names=["id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        part = lean.mapInArrow(search, schema)
        found = part if found is None else found.unionAll(part)
    return found.withColumnRenamed("id", id_column)


def with_leaks(docs: DataFrame, items: DataFrame, column: str = "n_leaks", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the number of items that each document leaks, as in :func:`find_leaks`; rows keep their other columns."""
    marked = docs.withColumn(column, F.lit(0).cast("bigint"))
    for shard in _shards(items, threshold):

        def count(batches: Iterator[pa.RecordBatch], index=shard.index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_column, _BYTES):
                    rows = [r[0] for r in leaks_in(index, *plain_words(part.column(text_column)))]
                    n = np.bincount(np.array(rows, np.int64), minlength=part.num_rows) + part.column(column).to_numpy()
                    yield part.set_column(part.schema.get_field_index(column), column, pa.array(n.astype(np.int64)))

        marked = marked.mapInArrow(count, marked.schema)
    return marked
