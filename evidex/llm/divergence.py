"""How sources of a language differ in their words: counts in mergeable radix tries, divergences in whole numbers.

A task counts its documents' terms in one trie a language: a leaf has the number of documents and a counter for each
source, and the root counts documents. Tries that have grown are written out in byte order and new ones begun, so a
task's memory is bounded. The tries of all tasks are merged by prefix: the subtries below a prefix meet in one task, in
byte order, where equal leaves are neighbours, so a merge holds one leaf at a time. A word that is
in every document is one leaf a trie, whatever the number of rows.

Merged leaves in at least ``LEAST`` documents are kept. Every language's figures (sources, counts) go to its leaves, and
one more walk in byte order adds each block of leaves to the language's matrix of pairs and to the bounded list of each
source's best terms. Both are sums and bests that meet in small groups.

Defined results: a null text, language or source is an empty one. Every (language, source) that occurs is a group, with
or without terms; a language without kept terms has pairs of value 0 and no terms. All figures are whole and exact.
Repeated rows count each; rows without an id count; an empty table gives an empty table; other columns are not read.
The pairs of a language are as many as the square of its sources: that is the report.
"""

from __future__ import annotations

import gc
import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, parallelism, release

#: The fewest documents of a kept term, the parts that a probability of 1 has, and the most terms reported of a group.
LEAST, WHOLE, TERMS = 3, 1_000_000_000, 200
#: Leaves' counters of a task's tries before they are written out; suffixes in a map before it bursts; bytes of a text counted at a time; cells of a block of leaves.
COUNTERS, BURST, PIECE, CELLS = 600_000, 4096, 1 << 22, 1 << 19
#: Bytes of a term that say which subtries are merged together.
PREFIX = 8
#: The most groups whose figures are sent to every task; those of more are joined by a shuffle.
SENT = 100_000

#: Bytes that make no term become spaces, capital letters small ones. Bytes from 0x80 on are parts of other characters.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Trie:
    """A radix trie of byte strings that bursts: inner nodes branch on a byte, and hold what lies below in maps from suffixes until one has too many.

    An inner node is [next byte to what is below, its own leaf]; a leaf is [documents, counts by source].
    """

    def __init__(self):
        self.root: list = [{}, None]
        self.counters = 0

    def leaf(self, term: bytes) -> list:
        """The leaf of ``term``, made if it is not there."""
        node, at = self.root, 0
        while type(node) is list:
            if at == len(term):
                if node[1] is None:
                    node[1] = [0, {}]
                return node[1]
            above, byte, at = node[0], term[at], at + 1
            node = above.get(byte)
            if node is None:
                node = above[byte] = {}
        suffix = term[at:]
        leaf = node.get(suffix)
        if leaf is None:
            leaf = node[suffix] = [0, {}]
            if len(node) > BURST:
                above[byte] = self._burst(node)
        return leaf

    def add_document(self, source: str, counts: dict[bytes, int]) -> None:
        """One more document of ``source``, with its terms' counts."""
        find, new = self.leaf, 0
        for term, n in counts.items():
            leaf = find(term)
            leaf[0] += 1
            own = leaf[1]
            if source in own:
                own[source] += n
            else:
                own[source] = n
                new += 1
        self.counters += new

    @staticmethod
    def _burst(leaves: dict) -> list:
        below: dict = {}
        for suffix, leaf in leaves.items():
            if suffix:
                below.setdefault(suffix[0], {})[suffix[1:]] = leaf
        return [below, leaves.get(b"")]

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """(term, leaf) in byte order."""
        todo: list = [(b"", self.root)]
        while todo:
            term, node = todo.pop()
            if type(node) is dict:
                for suffix in sorted(node):
                    yield term + suffix, node[suffix]
            else:
                if node[1] is not None:
                    yield term, node[1]
                todo.extend((term + bytes((byte,)), node[0][byte]) for byte in sorted(node[0], reverse=True))

    def merge(self, other: Trie) -> Trie:
        """Add all of ``other``'s leaves."""
        for term, (documents, counts) in other.walk():
            leaf = self.leaf(term)
            leaf[0] += documents
            self.counters -= len(leaf[1])
            for source, n in counts.items():
                leaf[1][source] = leaf[1].get(source, 0) + n
            self.counters += len(leaf[1])
        return self


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, in lists of bounded size: a long text is cut where no term is."""
    at = 0
    while at < len(text):
        end = at + PIECE
        folded = text[at:end].translate(FOLD)
        if end < len(text):
            cut = folded.rfind(b" ")
            if cut < 0:  # one term over the whole piece: on to its end
                while end < len(text) and text[end : end + 1].translate(FOLD) != b" ":
                    end += 1
                folded = text[at:end].translate(FOLD)
            else:
                folded, end = folded[:cut], at + cut + 1
        yield folded.split()
        at = end


def _table(langs: list, terms: list, names: list, counts: list, ends: list, documents: list | None = None) -> pa.RecordBatch:
    """Leaves as Arrow columns; ``names`` and ``counts`` are those of all leaves, one after the other, up to ``ends``."""
    ends = pa.array([0, *ends], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(names, pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
    columns = {"lang": pa.array(langs, pa.string()), "term": pa.array(terms, pa.binary())} | ({} if documents is None else {"documents": pa.array(documents, pa.int64())})
    return pa.RecordBatch.from_arrays([*columns.values(), *lists], names=[*columns, "sources", "counts"])


def _written(tries: dict[str, Trie]) -> pa.RecordBatch:
    langs, terms, documents, names, counts, ends = [], [], [], [], [], []
    for lang, trie in sorted(tries.items()):
        before = len(terms)
        for term, (d, own) in trie.walk():
            terms.append(term)
            documents.append(d)
            names.extend(own)
            counts.extend(own.values())
            ends.append(len(names))
        langs += [lang] * (len(terms) - before)
    return _table(langs, terms, names, counts, ends, documents)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to leaves."""
    tries: dict[str, Trie] = {}
    gc.disable()  # leaves hold no cycles, and looking for some among millions takes longer than counting
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for lang, source, text in zip(*(batch.column(i).slice(at, 64).to_pylist() for i in range(3))):
                    counts = Counter((b"",))
                    for some in pieces(text):
                        counts.update(some)
                    tries.setdefault(lang, Trie()).add_document(source, counts)
                if sum(t.counters for t in tries.values()) > COUNTERS:
                    yield _written(tries)
                    tries = {}
        if tries:
            yield _written(tries)
    finally:
        gc.enable()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves in order of (lang, term) to merged ones: the root, and terms in enough documents. Of a batch, the last leaf waits for the next one."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        whole = pa.Table.from_batches([*left, batch]).combine_chunks()
        lang, term = whole["lang"].chunk(0), whole["term"].chunk(0)
        n = len(whole)
        new = np.ones(n, bool)
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield _joined(whole.slice(0, last), new[:last])
        # equal leaves are joined while they wait, so one is held however many there are
        left = [_joined(whole.slice(last), new[last:], 0)]
    if left:
        yield _joined(pa.Table.from_batches(left), np.ones(left[0].num_rows, bool))


def _joined(leaves: pa.Table, new: np.ndarray, least: int | None = LEAST) -> pa.RecordBatch:
    """Runs of equal leaves (a run begins where ``new`` is true) as one leaf each; with ``least``, those in so many documents and roots, without that number."""
    leaves = leaves.combine_chunks()
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    lists, counts = leaves["sources"].chunk(0), leaves["counts"].chunk(0).flatten().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(group, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    documents = np.add.reduceat(leaves["documents"].to_numpy(), first)
    key, place = np.unique(owner * len(names) + codes, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, counts)
    owner, codes = np.divmod(key, max(1, len(names)))
    lang, term = leaves["lang"].chunk(0).take(pa.array(first)), leaves["term"].chunk(0).take(pa.array(first))
    kept = np.ones(len(first), bool) if not least else (documents >= least) | (pc.binary_length(term).to_numpy(zero_copy_only=False) == 0)
    own = kept[owner]
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first))[kept])]), pa.int32())
    which = pa.array(kept)
    columns = [lang.filter(which), term.filter(which)] + ([] if least else [pa.array(documents)])
    columns += [pa.ListArray.from_arrays(ends, names.take(pa.array(codes[own]))), pa.ListArray.from_arrays(ends, pa.array(total[own]))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", *([] if least else ["documents"]), "sources", "counts"])


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * count / total), for counts no greater than totals below 2^53: three digits of a thousand, by long division."""
    rest, out = count, np.zeros(np.broadcast(count, total).shape, np.int64)
    whole, rest = np.divmod(rest, total)
    out += whole * WHOLE
    for digit in (1_000_000, 1_000, 1):
        whole, rest = np.divmod(rest * 1000, total)
        out += whole * digit
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most WHOLE + 1, whose square a long holds."""
    return (p - q) ** 2 // q


class Language:
    """What a walk adds up for one language: a matrix of pairs, and the best terms of each source."""

    def __init__(self, names: list[str], totals: list[int], kept: int):
        self.names, self.totals = names, np.array(totals, np.int64)
        self.kept, self.all = kept, int(self.totals.sum())
        self.pairs = np.zeros((len(names), len(names)), np.int64)
        self.best: list[list] = [[] for _ in names]
        self.root = False

    def add(self, terms: pa.Array, count: np.ndarray) -> None:
        """Leaves in byte order, and their counts by the language's sources."""
        step = max(1, CELLS // len(self.names))
        for at in range(0, len(terms), step):
            self._block(terms[at : at + step], count[at : at + step])

    def _block(self, terms: pa.Array, count: np.ndarray) -> None:
        p = shares(count + 1, self.totals + self.kept)
        for t in range(len(self.names)):
            self.pairs[:, t] += excess(p, p[:, t : t + 1]).sum(0)
        q = shares(count.sum(1) + 1, np.int64(self.all + self.kept))[:, None]
        value = np.where((count > 0) & (p > q), excess(p, q), -1)
        for s, best in enumerate(self.best):
            least = max(0, -best[-1][0] if len(best) == TERMS else 0)
            rows = np.flatnonzero(value[:, s] >= least)
            if len(rows) > TERMS:  # those that no tie with the last of the best keeps out
                least = np.partition(value[rows, s], -TERMS)[-TERMS]
                rows = rows[value[rows, s] >= least]
            if len(rows):
                best += zip((-value[rows, s]).tolist(), terms.take(pa.array(rows)).to_pylist())
                self.best[s] = heapq.nsmallest(TERMS, best)

    def rows(self, lang: str) -> list[tuple]:
        """(lang, source, part, item, value). The pairs are there if anything was added, or the root was met."""
        out = [(lang, self.names[s], "pair", self.names[t], int(self.pairs[s, t])) for s in range(len(self.names)) for t in range(len(self.names)) if s != t and (self.root or self.pairs[s, t])]
        return out + [(lang, self.names[s], "term", term.decode(), -v) for s, best in enumerate(self.best) for v, term in best]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, counts by the language's sources, its figures), in order of lang and term, to sums and candidates."""
    lang, own = None, None

    def batch_of(rows):
        kinds = [pa.string()] * 4 + [pa.int64()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000]), kinds)], names=["lang", "source", "part", "item", "value"])

    for batch in batches:
        names, rows = batch.column(0), batch.num_rows
        cuts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), rows] if rows else []
        for start, end in pairwise(cuts):
            part = batch.slice(start, end - start)
            if lang != names[start].as_py():
                if own:
                    yield from batch_of(own.rows(lang))
                lang, own = names[start].as_py(), Language(*(part.column(c)[0].as_py() for c in (3, 4, 5)))
            terms, count = part.column(1), part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            roots = int(pc.binary_length(terms[:1])[0].as_py() == 0)  # the root is the first of its language
            own.root |= bool(roots)
            own.add(terms[roots:], count[roots:])
    if own:
        yield from batch_of(own.rows(lang))


def audited(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    n = max(parallelism(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    leaf = "lang string, term binary, documents long, sources array<string>, counts array<long>"
    ranges = rows.mapInArrow(_count, leaf).repartition(n, "lang", F.substring("term", 1, PREFIX)).sortWithinPartitions("lang", "term")
    merged = keep(ranges.mapInArrow(_merge, "lang string, term binary, sources array<string>, counts array<long>"), "terms")
    # one row a group: the root has them all, whatever their terms
    counts = merged.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.when(F.length("term") > 0, F.col("x.counts")).otherwise(F.lit(0)).alias("n"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = merged.groupBy("lang").agg(F.count_if(F.length("term") > 0).alias("kept"))
    figures = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("x")).join(kept, "lang").select("lang", F.col("x.source").alias("names"), F.col("x.n").alias("totals"), "kept")
    figures = keep(figures, "language-figures")
    number = figures.agg(F.sum(F.size("names"))).first()[0] or 0
    held = F.map_from_arrays("sources", "counts")
    dense = F.transform("names", lambda s: F.coalesce(F.element_at(held, s), F.lit(0)))
    each = merged.join(F.broadcast(figures) if number <= SENT else figures, "lang").select("lang", "term", dense.alias("counts"), "names", "totals", "kept")
    found = keep(each.sortWithinPartitions("lang", "term").mapInArrow(_walk, "lang string, source string, part string, item string, value long"), "divergences")
    for df in (merged, figures):
        release(df)
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = [x.withColumn("rank", F.row_number().over(group).cast("int")) for x in (pairs, found.filter("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= TERMS))
