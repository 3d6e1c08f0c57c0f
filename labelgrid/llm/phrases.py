"""Collocations: phrases of two to four words that occur more often together than their parts alone.

Words get 64-bit ids from their letters and their language. Each task counts phrases in a trie of hash containers: inner nodes, few levels deep, tell phrases apart by digits of their
words' ids, one word after the other; at the leaves lie containers, open hash tables over word ids, and one that grows past ``BURST`` entries bursts into
an inner node with smaller ones. When a task's tries outgrow ``ROOM`` entries, their largest subtrees are put out whole as sorted runs and start
empty; runs of all tasks are merged by partitions of their first words. Memory is bounded whatever the text, and all
occurrences are counted.

A part of a frequent phrase is at least as frequent. So words are counted first, then pairs of frequent words, then phrases of three and four words
made of frequent pairs. Which words and pairs are frequent is told by a bit map of fixed size; on a corpus that fills it more
phrases are counted, none is lost. If two words have one id, ids are made anew from another seed.

A null text is empty, a null language is ``und``. Repeated rows count again. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.llm.common import Block, blocks_of, mix, small_batches, through_table
from labelgrid.llm.superstrings import _bitmap, admits

MIN_COUNT, TOP, COVER, MAX_WORDS = 30, 2000, 80, 4
BURST, ROOM, FAN_BITS = 1 << 14, 1 << 20, 4
# Fixed values of the contract: what parts pieces, and what parts words within them.
BREAKS, SPACES = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACES[[0x20, 0x09]] = True
_FACTOR = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64)) for i in range(MAX_WORDS)]
KEYS = ["w1", "w2", "w3", "w4"]
RUNS = "lang string, w1 bigint, w2 bigint, w3 bigint, w4 bigint, n bigint"


def phrase_hash(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for i in range(keys.shape[1]):
        out += keys[:, i] * _FACTOR[i]
    return mix(out)


class Container:
    """Open hash table from rows of word ids to counts."""

    def __init__(self, width: int, slots: int = 64):
        self.keys, self.counts, self.n = np.zeros((slots, width), np.uint64), np.zeros(slots, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        slots = len(self.counts)
        while slots < 2 * (self.n + len(keys)):
            slots *= 2
        if slots > len(self.counts):
            old = self.rows()
            self.keys, self.counts, self.n = np.zeros((slots, keys.shape[1]), np.uint64), np.zeros(slots, np.int64), 0
            if len(old[0]):
                self._put(*old, phrase_hash(old[0]))
        self._put(keys, counts, hashes)

    def _put(self, keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        mask = np.uint64(len(self.counts) - 1)
        slot, left = (hashes & mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.counts[at] == 0
            # Of several rows that claim a free slot one stays; the others look on.
            self.keys[at[free]] = keys[left[free]]
            same = (self.keys[at] == keys[left]).all(axis=1)
            taken = at[same]
            self.n += len(np.unique(taken[free[same]]))
            np.add.at(self.counts, taken, counts[left[same]])
            left = left[~same]
            slot[left] = (slot[left] + 1) & int(mask)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.counts)
        return self.keys[used], self.counts[used]


class Node:
    """A leaf with a container, or an inner node with a child for each digit of a word id."""

    def __init__(self, width: int, depth: int = 0):
        self.width, self.depth, self.box, self.children = width, depth, Container(width), None

    def add(self, keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        if self.box is not None:
            if self.box.n + len(keys) <= BURST or self.depth == 2 * self.width:
                self.box.add(keys, counts, hashes)
                return
            old = self.box.rows()
            self.box, self.children = None, [Node(self.width, self.depth + 1) for _ in range(1 << FAN_BITS)]
            if len(old[0]):
                self._deal(*old, phrase_hash(old[0]))
        self._deal(keys, counts, hashes)

    def _deal(self, keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        """To the children: two digits of each word, from the highest bits of its id down."""
        digit = (keys[:, self.depth // 2] >> np.uint64(64 - FAN_BITS * (1 + self.depth % 2))) & np.uint64((1 << FAN_BITS) - 1)
        order = np.argsort(digit, kind="stable")
        ends = np.searchsorted(digit[order], np.arange((1 << FAN_BITS) + 1))
        for child, a, b in zip(self.children, ends[:-1].tolist(), ends[1:].tolist()):
            if a < b:
                some = order[a:b]
                child.add(keys[some], counts[some], hashes[some])

    def size(self) -> int:
        return self.box.n if self.box is not None else sum(c.size() for c in self.children)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        if self.box is not None:
            return self.box.rows()
        made = [c.rows() for c in self.children]
        return np.concatenate([k for k, _ in made]), np.concatenate([n for _, n in made])


class PhraseTrie:
    """Counts of phrases of up to ``width`` words of one language; ``size`` tells how many entries it holds."""

    def __init__(self, width: int):
        self.width, self.root, self.size = width, Node(width), 0

    def add(self, keys: np.ndarray) -> None:
        """Count the rows of ``keys``; equal ones of a call are added up before they reach the containers."""
        if not len(keys):
            return
        hashes = phrase_hash(keys)
        order = np.argsort(hashes)
        keys, hashes = keys[order], hashes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
        at = np.flatnonzero(fresh)
        self.root.add(keys[at], np.diff(np.append(at, len(keys))), hashes[at])
        self.size = self.root.size()

    def subtrees(self) -> list[Node]:
        return self.root.children or [self.root]

    def take(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a subtree in the order of their word ids; the subtree starts empty."""
        keys, counts = node.rows()
        node.box, node.children = Container(self.width), None
        self.size -= len(keys)
        order = np.lexsort(keys.T[::-1])
        return keys[order], counts[order]


class Tokens:
    """Words of a block of one language: the ids of its distinct words, which of them each place holds, and the piece of each place."""

    def __init__(self, block: Block, lang: str, seed: int):
        block = block.lowered()
        words = block.words(BREAKS | SPACES)
        inside = ~(BREAKS | SPACES)[block.view]
        ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int32)
        letters = np.ascontiguousarray(block.view[inside])
        column = pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
        self.words, self.code = column.dictionary, column.indices.to_numpy()
        own = xxhash.xxh64_intdigest(lang.encode(), seed)
        self.ids = np.array([xxhash.xxh64_intdigest(w, own) or 1 for w in self.words.to_pylist()], np.uint64)
        # Both numbers only grow, so their sum changes where one of them does.
        self.piece = np.cumsum(BREAKS[block.view])[words.start] + words.doc() if len(words) else np.zeros(0, np.int64)

    def together(self, n: int) -> np.ndarray:
        """Places where ``n`` words of one piece begin."""
        last = len(self.code) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)


def _by_language(docs: DataFrame, fn: Callable[[Iterator[tuple[str, Block]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``fn`` over the blocks of a task's texts, each of one language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for _, block in blocks_of(batch.take(pa.array(np.flatnonzero(code == i)))):
                    yield lang, block
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(lambda batches: fn(blocks(batches)), schema)


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, id, n of all words."""

    def run(blocks: Iterator[tuple[str, Block]]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks:
            own = Tokens(block, lang, seed)
            n = np.bincount(own.code, minlength=len(own.ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), own.words, pa.array(own.ids.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "word", "id", "n"]
            )

    return _by_language(docs, run, "lang string, word string, id bigint, n bigint").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, seed: int, width: int, room: int, chosen: Callable[[Tokens], Iterator[np.ndarray]]) -> DataFrame:
    """lang, w1 to w4, n of the phrases that ``chosen`` yields as rows of ``width`` word ids; places behind a phrase hold 0."""

    def run(blocks: Iterator[tuple[str, Block]]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, PhraseTrie] = {}

        def spill(bound: int) -> Iterator[pa.RecordBatch]:
            held = sum(t.size for t in tries.values())
            if held <= 2 * bound:
                return
            parts = sorted(((node.size(), lang, i) for lang, t in tries.items() for i, node in enumerate(t.subtrees())), reverse=True)
            for size, lang, i in parts:
                if held <= bound:
                    break
                yield from runs(lang, *tries[lang].take(tries[lang].subtrees()[i]))
                held -= size

        def runs(lang: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 1 << 16):
                own, n = keys[a : a + (1 << 16)], counts[a : a + (1 << 16)]
                ids = [pa.array(np.ascontiguousarray(own[:, j]).view(np.int64)) if j < width else pa.array(np.zeros(len(n), np.int64)) for j in range(MAX_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *ids, pa.array(n)], names=["lang", *KEYS, "n"])

        for lang, block in blocks:
            trie = tries.setdefault(lang, PhraseTrie(width))
            for keys in chosen(Tokens(block, lang, seed)):
                trie.add(keys)
            yield from spill(room // 2)
        yield from spill(0)

    parts = ["w1", "w2", "w3"][: width - 1] if width > 2 else ["w1", "w2"]
    # Phrases that begin alike meet in one partition; the sums need no further shuffle.
    return _by_language(docs, run, RUNS).repartition(*parts).groupBy("lang", *KEYS).agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, room: int = ROOM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, id, n), all of them; then phrases of two and of three to four words (lang, w1 to w4, n) with ``min_count`` occurrences."""
    context, seed = docs.sparkSession.sparkContext, 0
    while True:
        words = through_table(count_words(docs, seed), "words")
        if words.groupBy("id").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            break
        seed += 1
    known = context.broadcast(_bitmap(words.where(F.col("n") >= min_count).select(F.col("id").alias("m"))))

    def pairs(tokens: Tokens) -> Iterator[np.ndarray]:
        yes = admits(known.value, tokens.ids)[tokens.code]
        at = tokens.together(2)
        at = at[yes[at] & yes[at + 1]]
        yield tokens.ids[np.stack([tokens.code[at], tokens.code[at + 1]], 1)]

    two = through_table(count_phrases(docs, seed, 2, room, pairs).where(F.col("n") >= min_count), "word-pairs")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2")], 1)
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(keys).view(np.int64))], names=["m"])

    joined = context.broadcast(_bitmap(two.select("w1", "w2").mapInArrow(hashes, "m bigint")))

    def longer(tokens: Tokens) -> Iterator[np.ndarray]:
        at, yes = tokens.together(2), np.zeros(len(tokens.code), bool)
        yes[at] = admits(joined.value, phrase_hash(tokens.ids[np.stack([tokens.code[at], tokens.code[at + 1]], 1)]))
        for n in (3, 4):
            at = tokens.together(n)
            for j in range(n - 1):
                at = at[yes[at + j]]
            keys = np.zeros((len(at), MAX_WORDS), np.uint64)
            for j in range(n):
                keys[:, j] = tokens.ids[tokens.code[at + j]]
            yield keys

    more = through_table(count_phrases(docs, seed, MAX_WORDS, room, longer).where(F.col("n") >= min_count), "long-phrases")
    return words, two, more


def _key(names: list[str], words: list[Column]) -> list[Column]:
    return [c.alias(n) for n, c in zip(names, [*words, *[F.lit(0).cast("bigint")] * 3])]


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER, room: int = ROOM) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    A phrase is left out if a longer one with ``min_count`` occurrences holds it and has ``cover`` hundredths of its occurrences or more. Scores are exact whatever the counts.
    """
    words, two, more = frequent(docs, min_count, room)
    w = [F.col(c) for c in KEYS]
    size = F.when(w[2] == 0, 2).when(w[3] == 0, 3).otherwise(4)
    wide = lambda c: c.cast("decimal(20,0)")

    inner = [(i, j) for n in (3, 4) for i in range(n) for j in range(i + 2, n + 1) if (i, j) != (0, n)]
    inner = sorted(set(inner))
    subs = F.filter(F.array(*[F.struct(*_key(["s1", "s2", "s3"], w[i:j]), F.lit(j).alias("last"), F.lit(j - i).alias("words")) for i, j in inner]), lambda s: (s["last"] <= size) & (s["words"] < size))
    held = more.select(F.explode(subs).alias("s"), "n").groupBy("s.s1", "s.s2", "s.s3").agg(F.max("n").alias("longer"))
    phrases = two.unionByName(more).withColumnRenamed("n", "a")
    on = (F.col("w1") == F.col("s1")) & (F.col("w2") == F.col("s2")) & (F.col("w3") == F.col("s3")) & (F.col("w4") == 0)
    left = phrases.join(held, on, "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * cover)).select("lang", *KEYS, "a")

    counts = words.where(F.col("n") >= min_count).select(F.col("id").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.lit(0).cast("bigint").alias("k3"), "n")
    counts = through_table(counts.unionByName(two.unionByName(more.where("w4 = 0")).select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("w3").alias("k3"), "n")), "phrase-parts")
    cuts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), *_key(["l1", "l2", "l3"], w[:k]), *_key(["r1", "r2", "r3"], w[k:])) for k in (1, 2, 3)]), lambda c: c["k"] < size)
    cut = left.select("lang", *KEYS, "a", F.explode(cuts).alias("c")).select("lang", *KEYS, "a", "c.*")
    for side in "lr":
        part = counts.select(*[F.col(f"k{i}").alias(f"{side}{i}") for i in (1, 2, 3)], F.col("n").alias(side))
        cut = cut.join(part, [f"{side}{i}" for i in (1, 2, 3)])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cut.select("lang", *KEYS, "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", *KEYS, "a").agg(F.min("cut").alias("cut"))
    best = best.select("lang", *KEYS, "a", "cut.score", "cut.l", "cut.r")

    # Ties at the last rank stay until the words decide.
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = through_table(best.withColumn("near", F.rank().over(near)).where(F.col("near") <= top).drop("near"), "best-phrases")
    each = best.select("lang", *KEYS, "a", "score", "l", "r", F.posexplode(F.array(*KEYS)).alias("at", "id")).where("id <> 0").join(words.select("id", "word"), "id")
    spelt = each.groupBy("lang", *KEYS, "a", "score", "l", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
