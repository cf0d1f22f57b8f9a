"""Language-model scores of documents.

Learns from one part of the corpus and scores all of it:

1. One scan splits texts into words and writes them as numbers of a dictionary
   per block of about 12 MB of text, and the texts to learn from as subword ids of
   a public tokenizer, so no text is shuffled.
2. Dictionary words meet by word for their counts over the whole training part.
3. A causal self-attention model (``attention``) is trained in numpy on the subword
   ids of all texts to learn from, each in one of four rounds, by several trainers
   in parallel whose results are averaged each round.
4. Blocks get their words' counts back and are scored: overlapping context windows
   score each subword once.  A word's probability mixes three: the model's for its
   subwords and for a word's end after them; the model's for its first subword,
   times the word's frequency among words that begin so; and its frequency alone.
   The probabilities of all words add up to one at most.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm import attention
from caseweave.llm.common import ascii_lower, pieces
from caseweave.runtime import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# The pre-tokenizer that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256  # free in the vocabulary
BLOCK_BYTES = 12 << 20
CODED_TOGETHER = 1 << 14  # words of one call of the tokenizer
TRAINER_TOKENS = 8 << 20  # of one trainer and round
ROUNDS, RATE = 4, 0.02
# Weights of a word's spelling in subwords, of its frequency among words that begin alike, and of its frequency.
SPELLED, ALIKE, FREQUENT = 0.5, 0.4, 0.1
FAN_IN = 4


def read_vocabulary(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(n) for a, n in (line.split() for line in vocabulary.splitlines() if line)}


def word_beginnings(vocabulary: bytes) -> np.ndarray:
    """Whether an id begins a word (a space before it) or ends a text, by id."""
    begins = np.zeros(END + 1, bool)
    begins[[n for piece, n in read_vocabulary(vocabulary).items() if piece.startswith(b" ")] + [END]] = True
    return begins


class Subwords:
    """Subword ids of words."""

    def __init__(self, vocabulary: bytes):
        ranks = read_vocabulary(vocabulary)
        self.size = np.zeros(END + 1, np.int64)
        for piece, n in ranks.items():
            self.size[n] = len(piece)
        self.coder = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def text(self, words: list[bytes]) -> np.ndarray:
        """Ids of words in a row, each with a space before it."""
        line = b"".join(b" " + w for w in words).decode("utf-8", "replace")
        return self.coder.encode_to_numpy(line, disallowed_special=()).astype(np.uint16)

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has.  Words are coded in one call where the pieces end
        at the words' ends."""
        if not words:
            return np.empty(0, np.uint16), np.empty(0, np.int64)
        if len(words) <= CODED_TOGETHER:
            ids = self.text(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            piece_ends = np.cumsum(self.size[ids])
            at = np.searchsorted(piece_ends, ends)
            if len(piece_ends) and at[-1] < len(piece_ends) and (piece_ends[at] == ends).all():
                return ids, np.diff(at, prepend=-1)
            if len(words) == 1:
                return ids, np.array([len(ids)])
        half = len(words) // 2
        return tuple(np.concatenate(x) for x in zip(self.flat(words[:half]), self.flat(words[half:])))

    def each(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word."""
        ids, size = self.flat(words)
        return np.split(ids, np.cumsum(size)[:-1])


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value per ``size`` of ``flat``."""
    ends = np.concatenate([[0], np.cumsum(size * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all values of a binary column in one array, and the places at which values begin and the last ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] // 2
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint16)[: at[-1]] if raw and at[-1] else np.empty(0, np.uint16)), at


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which compress better."""
    return np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _batch(kind: str, block: int, n: int, **columns) -> pa.RecordBatch:
    values = {"kind": pa.array([kind] * n), "block": pa.array(np.full(n, block)), **columns}
    return pa.RecordBatch.from_arrays(
        [values.get(f, pa.nulls(n, t)) for f, t in _FIELDS.items()], names=list(_FIELDS))


_FIELDS = {"kind": pa.string(), "block": pa.int64(), "id": pa.int64(), "learn": pa.bool_(), "round": pa.int32(),
           "data": pa.binary(), "tokens": pa.binary(), "number": pa.int32(), "learned": pa.int64(), "ids": pa.binary()}
_SCHEMA = ("kind string, block long, id long, learn boolean, round int, data binary, tokens binary, number int, "
           "learned long, ids binary")
_END = np.array([END], np.uint16)


def encode(docs: DataFrame, vocabulary: bytes, id_col: str, text_col: str, learn) -> DataFrame:
    """Documents as word numbers, with the subwords of those to learn from (``doc``), and block dictionaries (``word``).

    Each document to learn from is dealt to one training round by its hash.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), learn.alias("learn"),
                         F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(ROUNDS)).cast("int").alias("round"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Subwords(shared.value)
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        index: dict[bytes, int] = {}
        numbered: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            block = part << 24 | nth
            total, learned = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            for _, own, _, numbers in numbered:
                count = np.bincount(numbers, minlength=0)
                total[: len(count)] += count
                if own:
                    learned[: len(count)] += count
            order = np.argsort(-total, kind="stable")  # frequent words get small numbers, which compress
            rank = np.empty(len(index), np.int32)
            rank[order] = np.arange(len(index), dtype=np.int32)
            words = list(index)
            flat, size = coder.flat(words)
            begin = np.cumsum(size) - size

            def tokens(numbers: np.ndarray) -> bytes:
                parts = size[numbers]
                at = np.cumsum(parts) - parts
                ids = flat[np.arange(parts.sum()) + np.repeat(begin[numbers] - at, parts)]
                return np.concatenate([_END, ids, _END]).tobytes()

            for lo in range(0, len(numbered), 512):
                some = numbered[lo: lo + 512]
                yield _batch("doc", block, len(some), id=pa.array([d[0] for d in some], pa.int64()),
                             learn=pa.array([d[1] for d in some]), round=pa.array([d[2] for d in some], pa.int32()),
                             data=pa.array([_pack(rank[d[3]]) for d in some], pa.binary()),
                             tokens=pa.array([tokens(d[3]) if d[1] else None for d in some], pa.binary()))
            for lo in range(0, len(words), 1 << 16):
                hi = min(len(words), lo + (1 << 16))
                yield _batch("word", block, hi - lo, data=pa.array(words[lo:hi], pa.binary()),
                             number=pa.array(rank[lo:hi]), learned=pa.array(learned[lo:hi]),
                             ids=_binary(flat[begin[lo]: begin[hi - 1] + size[hi - 1]], size[lo:hi]))
            index.clear()
            numbered.clear()

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("id", "learn", "round")]
            for id_, own, nth_round, t in zip(*columns, b.column("text")):
                raw = t.as_buffer().to_pybytes()
                numbers = np.array([index.setdefault(w, len(index)) for w in raw.split()], np.int32)
                numbered.append((id_, own, nth_round, numbers))
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield from flush()
                    nth, held = nth + 1, 0
        yield from flush()

    return picked.mapInArrow(run, _SCHEMA)


def _tree_sum(parts: DataFrame, n: int) -> np.ndarray | None:
    """Elementwise sum of ``(part, blob)`` rows of float32 arrays, ``FAN_IN`` at a time; one array reaches the driver."""
    def add(group: pa.Table) -> pa.Table:
        total = None
        for blob in group.column("blob"):
            values = np.frombuffer(blob.as_buffer(), np.float32)
            total = values.astype(np.float64) if total is None else total + values
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int64()),
                         "blob": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while n > 1:
        n = -(-n // FAN_IN)
        parts = (parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
                 .groupBy("part").applyInArrow(add, "part long, blob binary"))
    rows = parts.collect()  # one row
    return np.frombuffer(rows[0].blob, np.float32) if rows else None


def _per_trainer(texts: DataFrame, run: Callable[[Iterator[list[np.ndarray]]], np.ndarray]) -> DataFrame:
    """``(part, blob)``: one array per partition that has texts; ``run`` gets the token ids of a few texts at a time."""
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[np.ndarray]]:
            for b in batches:
                column = b.column("tokens")
                for lo, hi in pieces([len(t.as_buffer()) for t in column], 1 << 18):
                    yield [np.frombuffer(t.as_buffer(), np.uint16) for t in column[lo:hi]]

        some = groups()
        first = next(some, None)
        if first is not None:
            blob = run(chain([first], some)).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([blob], pa.binary())], names=["part", "blob"])

    return texts.select("tokens").mapInArrow(call, "part long, blob binary")


class Block:
    """Subword ids of the words of one block, and of one end after them, by word number."""

    def __init__(self, words: pa.Table):
        order = np.argsort(words.column("number").to_numpy())
        self.c = words.column("c").to_numpy()[order]
        flat, offsets = _flat(words.column("ids").combine_chunks())
        self.flat = np.append(flat, np.uint16(END)).astype(np.int64)
        self.size = np.append(np.diff(offsets)[order], 1)
        self.begin = np.append(offsets[:-1][order], len(self.flat) - 1)

    def texts(self, blobs: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pieces of texts: words and first word of each text, word numbers, first subword of each word, subwords."""
        end = np.array([len(self.c)])
        for lo, hi in pieces([len(t) for t in blobs], limit):
            mine = [np.concatenate([_unpack(t), end]) for t in blobs[lo:hi]]
            length = np.array([len(m) for m in mine])
            first = np.cumsum(length) - length
            number = np.concatenate(mine)
            parts = self.size[number]
            part_first = np.cumsum(parts) - parts
            tokens = self.flat[np.arange(parts.sum()) + np.repeat(self.begin[number] - part_first, parts)]
            yield length, first, number, part_first, tokens


def train(texts: DataFrame, counts: np.ndarray) -> tuple[attention.Weights, np.ndarray, attention.Coding]:
    """Gate weights, expert tables and coding, from ``texts(round, tokens)`` and corpus counts of subwords.

    One pass counts bigrams of all texts.  Each round then takes its own part of
    the texts, so all of them train the gate, and all transitions are counted,
    once.  The trainers of a round start from the same model, a trainer for about
    eight million tokens; gate weights are averaged by tokens.  The transitions
    the experts were responsible for add up over trainers; those of an earlier
    round, from a less trained gate, weigh a quarter.
    """
    code = attention.coding(counts)
    shape = (code.rows, attention.CLASSES)
    cells = shape[0] * shape[1] * attention.EXPERTS
    tokens = {r["round"]: r["n"] for r in texts.groupBy("round").agg(F.sum(F.octet_length("tokens") / 2).alias("n")).collect()}

    def trainers(n: float) -> int:
        return 1 + int(n) // TRAINER_TOKENS

    def bigrams(groups: Iterator[list[np.ndarray]]) -> np.ndarray:
        total = np.zeros(shape[0] * shape[1])
        for mine in groups:
            ids = np.concatenate(mine)
            cell = code.row[ids[:-1]].astype(np.int64) * shape[1] + code.cls[ids[1:]]
            inside = np.ones(len(cell), bool)
            inside[np.cumsum([len(t) for t in mine])[:-1] - 1] = False
            total += np.bincount(cell[inside], minlength=len(total))
        return total

    n = trainers(sum(tokens.values()))
    found = _tree_sum(_per_trainer(texts.coalesce(n), bigrams), n)
    bigram = attention.bigram_table(np.bincount(code.cls, counts, attention.CLASSES),
                                    np.zeros(shape) if found is None else found.reshape(shape).astype(float))
    weights, table = attention.initial(code, bigram)
    seen = np.zeros((*shape, attention.EXPERTS))
    for nth in sorted(tokens):
        shared = texts.sparkSession.sparkContext.broadcast((weights, table))

        def learn(groups: Iterator[list[np.ndarray]]) -> np.ndarray:
            trainer = attention.Trainer(*shared.value, code, RATE)
            for mine in groups:
                trainer.learn(mine)
            return np.concatenate([trainer.counts.ravel(), attention.pack(trainer.weights) * trainer.seen,
                                   [trainer.seen]])

        n = trainers(tokens[nth])
        total = _tree_sum(_per_trainer(texts.filter(F.col("round") == nth).coalesce(n), learn), n)
        seen = 0.25 * seen + total[:cells].reshape(seen.shape)
        table = attention.expert_tables(seen, bigram)
        weights = attention.unpack(total[cells:-1] / total[-1], weights)
        shared.unpersist()
    return weights, table, code


def score_documents(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
                    tokenizers: str = TOKENIZERS) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    ``learn`` is a boolean column: rows to learn from.  Tokens are words (runs of
    non-space bytes, A-Z lower-cased) and one end per text.  ``base_score`` is
    the smoothed unigram log10 probability of the tokens; ``score`` the model's.

    A null text counts as empty (one token, its end); a null ``learn`` is false;
    a null id is scored like any row; repeated rows count and score each for
    itself; without training rows all counts are 0 and the model is uniform; an
    empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    with open(f"{tokenizers}/{VOCABULARY}", "rb") as file:
        vocabulary = file.read()
    encoded = materialize(encode(docs, vocabulary, id_col, text_col, F.coalesce(learn, F.lit(False))), codec="zstd")
    texts = encoded.filter("kind = 'doc'").select("block", "id", "learn", "data")
    by_word = Window.partitionBy("word").orderBy("block")
    whole = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = (encoded.filter("kind = 'word'").select("block", "number", F.col("data").alias("word"), "learned", "ids")
             .withColumn("c", F.sum("learned").over(whole))
             .withColumn("first", F.row_number().over(by_word) == 1))
    vocab = materialize(words.select("block", "number", "c", "first", "ids", "learned"), codec="zstd")

    n_docs = texts.filter("learn").count()
    n_words, distinct = vocab.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.count_if(F.expr("first AND c > 0"))).first()
    n, v = n_words + n_docs, distinct + (n_docs > 0)

    def subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, heads = np.zeros(END + 1), np.zeros(END + 1)
        for b in batches:
            flat, at = _flat(b.column("ids"))
            learned = b.column("learned").to_numpy()
            total += np.bincount(flat[at[0]:], np.repeat(learned, np.diff(at)), END + 1)
            heads += np.bincount(flat[at[:-1]], learned, END + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(heads[seen])],
                                         names=["id", "n", "heads"])

    counts, heads = np.zeros(END + 1), np.zeros(END + 1)
    counts[END] = heads[END] = n_docs
    own = encoded.filter("kind = 'word' AND learned > 0").select("ids", "learned")
    found = own.mapInArrow(subword_counts, "id long, n double, heads double")
    for id_, k, words_of in found.groupBy("id").agg(F.sum("n"), F.sum("heads")).collect():
        counts[id_], heads[id_] = k, words_of  # one row per id of the vocabulary at most
    weights, table, code = train(encoded.filter("kind = 'doc' AND learn").select("round", "tokens"), counts)
    begins = word_beginnings(vocabulary)
    model = spark.sparkContext.broadcast((weights, table, code, begins, heads))

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        weights, table, code, begins, heads = model.value
        scorer = attention.Scorer(weights, table, code, END, begins=begins)
        block = Block(words)
        c = np.append(block.c, n_docs).astype(np.float64)
        with np.errstate(divide="ignore"):
            base_log = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            frequent = np.log(FREQUENT * c / max(n, 1))
            alike = np.log(ALIKE * c / np.maximum(heads[block.flat[block.begin]], 1))
        spelling = np.log(SPELLED) if n else 0.0
        columns: list[list] = [[], [], [], []]
        for length, first, number, part_first, tokens in block.texts(texts.column("data").to_pylist(), 1 << 18):
            parts = block.size[number]
            said, begin = scorer.score(tokens, np.add.reduceat(parts, first))
            # A word is given that one begins here, and ends where the next one or the end begins.
            begin = begin[part_first]
            after = np.append(begin[1:], 0.0)
            after[first + length - 1] = 0.0
            head = said[part_first] - begin
            rest = np.add.reduceat(said, part_first) - said[part_first] + after
            mixed = np.logaddexp(head + np.logaddexp(spelling + rest, alike[number]), frequent[number])
            columns[0].append(length)
            columns[1].append(np.add.reduceat((c[number] > 0).astype(np.int64), first))
            columns[2].append(np.add.reduceat(base_log[number], first))
            columns[3].append(np.add.reduceat(mixed, first) / np.log(10))
        values = [np.concatenate(x) if x else np.empty(0) for x in columns]
        learnt = texts.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        return pa.table({"id": texts.column("id"), "held_out": pa.array(~learnt),
                         "n_tokens": pa.array(values[0].astype(np.int64)), "n_known": pa.array(values[1].astype(np.int64)),
                         "train_tokens": pa.array(np.full(len(learnt), n, np.int64)),
                         "base_score": pa.array(values[2].astype(float)), "score": pa.array(values[3].astype(float))})

    schema = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double")
    out = (texts.groupBy("block").cogroup(vocab.select("block", "number", "c", "ids").groupBy("block"))
           .applyInArrow(score, schema))
    return out.withColumnRenamed("id", id_col)
