"""SentencePiece encoding and decoding over the piece table of a public model.

A text is led by one space and cut into words: a run of spaces with what follows it, or a line end; no
piece of the model crosses such a cut (this is checked). Encoding a word takes the segmentation with the
greatest sum of piece scores (ties: the longer last piece); a character that no piece covers becomes
the byte pieces of its UTF-8 form. Decoding joins pieces and bytes and drops the leading space, so it gives
back every text exactly.

Words are encoded once each by a relational lattice: substrings of bounded length are exploded, equi-joined to
the piece table, grouped by word and folded by a higher-order aggregate. The most frequent words, at most
HEAD_WORDS of them, are broadcast from there. The tasks that encode texts take the rarer ones, which are most of
the distinct words, through the same lattice column by column (`Lattice`): all substrings of a batch of words, by
hash, are matched with the piece table, and a forward pass over word ends keeps the best edge into each. Bringing
the relational result back to every text that holds a rare word would shuffle texts and word lists, some 1.9 times
the input against a disk limit of 1.5 times; see the README. Results do not depend on which way a word takes.

The pieces are the best-scoring ones of the model file's scores. That file was built by merges, so its own library,
which repeats the merges, cuts many words otherwise.

Defined results: a null or empty text has no pieces; repeated rows are encoded each; a null doc_id is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import texts_of, written
from .textnum import chunks

#: Words that are broadcast with their pieces, at most.
HEAD_WORDS = 1 << 17
#: Rarer words that a task remembers, at most.
REMEMBERED = 200_000
#: Characters of a word that goes through the lattice, at most.
LATTICE_CHARS = 48
_WORD = re.compile(r"\n| *[^ \n]+| +")
#: Score of a character that no piece covers: under any piece's.
UNKNOWN = -1e5
#: Pieces scored below this are never better than their parts.
USELESS = -1e6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """The lattice over the columns of a batch of words: substrings by hash, edges to pieces, the best edge into each end."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, table: dict[str, tuple[int, float]], longest: int):
        pieces = sorted(table)
        cp = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        size = np.diff(start)
        key = np.zeros(len(pieces), np.uint64)
        for n in range(longest):
            has = size > n
            key[has] = key[has] * self._BASE + cp[start[:-1][has] + n] + np.uint64(1)
        order = np.argsort(key)
        self.key, self.longest = key[order], longest
        if len(np.unique(key)) != len(key):
            raise ValueError("two pieces have one hash")
        self.id, self.score = (np.array([table[pieces[i]][k] for i in order], t) for k, t in ((0, np.int32), (1, np.float64)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)

    def paths(self, words: list[str]) -> list[bytes]:
        """The ids of each word's best path; none for a word with a character that no piece covers. Words of few characters."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")  # words that reach an end come first
        size = size[order]
        cp = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        most = int(size[0]) if len(size) else 0
        many = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # words of at least so many characters
        ends = np.repeat(start + size, size)  # of the word of each character
        at, key = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        edge = np.full((min(self.longest, most), len(cp)), -1, np.int32)
        for n in range(len(edge)):
            fits = at + n < ends[at]
            at = at[fits]
            key = key[fits] * self._BASE + cp[at + n] + np.uint64(1)
            hit = np.flatnonzero(self.maybe[self._slot(key)])
            k = np.minimum(np.searchsorted(self.key, key[hit]), len(self.key) - 1)
            real = self.key[k] == key[hit]
            edge[n, at[hit[real]]] = k[real]
        best = np.zeros((most + 1, len(words)))
        back, by = np.zeros((most + 1, len(words)), np.int8), np.zeros((most + 1, len(words)), np.int32)
        for e in range(1, most + 1):
            w = many[e - 1]
            top = np.full(w, -np.inf)
            for n in range(min(e, len(edge)), 0, -1):  # ties: the longer last piece
                k = edge[n - 1, start[:w] + (e - n)]
                value = np.where(k >= 0, best[e - n, :w] + self.score[k], -np.inf)
                better = value > top
                top[better] = value[better]
                back[e, :w][better], by[e, :w][better] = n, k[better]
            best[e, :w] = top
        ids = np.zeros((len(words), most), np.int32)
        left, used = size.copy(), np.zeros(len(words), np.int64)
        fine = np.isfinite(best[size, np.arange(len(words))]) & (size > 0)
        going = np.flatnonzero(fine)
        while len(going):
            end = left[going]
            used[going] += 1
            ids[going, most - used[going]] = self.id[by[end, going]]
            left[going] = end - back[end, going]
            going = going[left[going] > 0]
        out = [b""] * len(words)
        for i, row, n, ok in zip(order.tolist(), ids, used.tolist(), fine.tolist()):
            if ok:
                out[i] = row[most - n :].tobytes()
        return out


class Pieces:
    """What a model file holds: piece (spaces as such) to (id, score), bytes of each id, the id of byte 0."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table: dict[str, tuple[int, float]] = {}
        self.bytes = [b""] * m.vocab_size()
        self.byte_from = m.piece_to_id("<0x00>")
        for i in range(m.vocab_size()):
            if m.is_byte(i):
                self.bytes[i] = bytes([i - self.byte_from])
            elif not (m.is_control(i) or m.is_unknown(i)):
                piece = m.id_to_piece(i).replace("▁", " ")
                if re.search(r"[^ ] |\n", piece):
                    raise ValueError(f"piece {i} crosses words")
                self.bytes[i] = piece.encode()
                if m.get_score(i) > USELESS:
                    self.table[piece] = (i, m.get_score(i))
        self.longest = max(map(len, self.table))
        self.lattice = Lattice(self.table, self.longest)

    def fold(self, word: str) -> list[int]:
        """The best pieces of one word."""
        table, longest = self.table, self.longest
        best, back = [0.0], [(0, [])]
        for end in range(1, len(word) + 1):
            top, choice = None, None
            for start in range(max(0, end - longest), end):
                hit = table.get(word[start:end])
                if hit and (top is None or best[start] + hit[1] > top):
                    top, choice = best[start] + hit[1], (start, hit[0])
            if word[end - 1] not in table and (top is None or best[end - 1] + UNKNOWN > top):
                top, choice = best[end - 1] + UNKNOWN, (end - 1, -1)
            best.append(top)
            back.append(choice)
        out, end = [], len(word)
        while end:
            start, i = back[end]
            out += [i] if i >= 0 else [self.byte_from + b for b in reversed(word[start:end].encode())]
            end = start
        return out[::-1]

    def fold_all(self, words: list[str]) -> list[bytes]:
        """The best pieces of each word as 4-byte integers, by the lattice of all words; longer words and those with bytes one by one."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LATTICE_CHARS]
        for lo in range(0, len(short), 1 << 15):
            some = short[lo : lo + (1 << 15)]
            for i, ids in zip(some, self.lattice.paths([words[i] for i in some])):
                out[i] = ids
        for i, ids in enumerate(out):
            if not ids:
                out[i] = np.array(self.fold(words[i]), np.int32).tobytes()
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()[1:]


@cache
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def cut(text: str) -> list[str]:
    return _WORD.findall(" " + text) if text else []


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def run(batches):
        count: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                count.update(cut(t))
                if len(count) > 150_000:
                    yield out()
                    count.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count level that leaves at most `most` of them."""
    level = F.floor(F.log2("n") * 16)
    counts = written(counts.where(F.length("word") <= LATTICE_CHARS), "words")
    levels = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    kept, least = 0, None
    for r in levels:
        kept += r["count"]
        if kept > most:
            break
        least = r["level"]
    return counts.where(level >= least).select("word") if least is not None else counts.limit(0).select("word")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids: the relational lattice. The piece table is a model file's, of fixed size, so it is broadcast."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.table.items()], "piece string, id int, score double")
    size = F.length("word")
    parts = words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    parts = parts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("at") + 1))).alias("n"))
    parts = parts.select("word", "at", "n", F.expr("substring(word, at, n)").alias("piece"))
    edge = parts.join(F.broadcast(table), "piece", "left").where("id is not null or n = 1")
    code = F.hex(F.encode("piece", "UTF-8"))
    as_bytes = F.transform(
        F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1),
        lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + pieces.byte_from,
    )
    edge = edge.select(
        "word",
        F.struct((F.col("at") - 1 + F.col("n")).alias("end"), F.col("n"), F.coalesce("score", F.lit(UNKNOWN)).alias("score"),
                 F.when(F.col("id").isNull(), as_bytes).otherwise(F.array("id")).alias("ids")).alias("edge"),
    )
    edges = edge.groupBy("word").agg(F.collect_list("edge").alias("edges"))

    def step(best, end):
        mine = F.filter("edges", lambda e: e["end"] == end)
        ways = F.transform(
            mine,
            lambda e: F.struct(
                (F.element_at(best, end - e["n"] + 1)["score"] + e["score"]).alias("score"), e["n"].alias("n"), F.concat(F.element_at(best, end - e["n"] + 1)["ids"], e["ids"]).alias("ids")
            ),
        )
        return F.concat(best, F.array(F.array_max(ways)))

    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids")))
    path = F.aggregate(F.sequence(F.lit(1), size), none, step)
    return edges.select("word", F.element_at(path, -1)["ids"].alias("ids"))


def encode(docs: DataFrame, model_file: str | None = None, head: int = HEAD_WORDS) -> DataFrame:
    """doc_id, ids, n_pieces for every document."""
    spark: SparkSession = docs.sparkSession
    pieces = load(model_file or default_model())
    texts = texts_of(docs)
    known = encode_words(head_words(word_counts(texts), head), pieces).toArrow()
    lists = known.column("ids").combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    shared = spark.sparkContext.broadcast(({w: values[i:j].tobytes() for w, i, j in zip(known.column("word").to_pylist(), at, at[1:])}, pieces))
    del known, lists, values

    def run(batches):
        known, pieces = shared.value
        rare: dict[str, bytes] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                words = [cut(t) for t in texts[lo:hi]]
                fresh = list({w for each in words for w in each if w not in known and w not in rare})
                if len(rare) + len(fresh) > REMEMBERED:
                    rare.clear()
                    fresh = list({w for each in words for w in each if w not in known})
                rare.update(zip(fresh, pieces.fold_all(fresh)))
                flat = [b"".join([known.get(w) or rare[w] for w in each]) for each in words]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in flat])))
                values = pa.array(np.frombuffer(b"".join(flat), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids, pa.array(np.diff(ends).astype(np.int32))], names=["doc_id", "ids", "n_pieces"])

    return texts.mapInArrow(run, "doc_id long, ids array<int>, n_pieces int")


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    pieces = load(model_file or default_model())
    shared = encoded.sparkSession.sparkContext.broadcast(pieces.bytes)

    def run(batches):
        table = shared.value
        for b in batches:
            texts = [b"".join([table[i] for i in ids or ()])[1:].decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
