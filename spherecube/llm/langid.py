"""Language identification with unigrams of pieces, marginalised over segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over all ways
to cut it into pieces, by the forward algorithm; a text's is the product over its words. The distributions come from
expectation maximisation: forward and backward sums give the expected count of every piece in every word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spherecube.runtime import materialise

from .common import bounded_batches, free_name, held_by_worker, in_slices, is_fold, text_slices
from .words import word_hashes

#: The vocabulary; only its list of pieces is used.
VOCABULARY = "piece_bpe_32k.model"
#: About how many documents a language is learnt from, those of smallest hashed id.
MAX_DOCS = 1000
ROUNDS = 3
#: Words remembered with their probabilities by one worker.
MAX_CACHE = 400_000
#: Characters of one forward pass, places between two rescalings (longer words teach in parts), letters of a word.
PASS_CHARS, RESCALE, LONGEST = 60_000, 24, 256

#: Bytes between words: every ASCII character that is no letter.
APART = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LETTERS = re.compile(r"[^\W\d_]+")
BEGIN = "▁"


def pieces(path: str | None = None) -> list[str]:
    """The pieces of the vocabulary file at `path`, without control symbols and bytes."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return sorted({model.id_to_piece(i).lower() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def parts_of(run: str, most: int) -> list[str]:
    """A run of letters in parts of `most` at most."""
    return [run] if len(run) <= most else [run[i : i + most] for i in range(0, len(run), most)]


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text; very long ones, as of scripts without spaces, in parts that count as words."""
    return [w for run in LETTERS.findall(text.lower()) for w in parts_of(run, LONGEST)] if text else []


class Lattice:
    """All segmentations of words over a list of pieces; a character that is no piece is the unknown piece, the last one.

    Pieces are looked up by a 64-bit hash of their characters, for all words of a pass, start places and lengths at once.
    """

    FACTOR, BITS = np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, known: list[str]):
        self.unknown = len(known)
        self.longest = max(map(len, known), default=1)
        self.hashes = np.array([self._hash(p) for p in known] + [0], dtype=np.uint64)
        # A piece whose first slot is taken goes to the second table, with a factor that brings no clash there.
        slots = self._slot(self.hashes[:-1], self.FACTOR)
        first = np.unique(slots, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(known)), first)
        self.tables, self.factors = [self._table(slots[first], first)], [self.FACTOR]
        factor = self.FACTOR
        again = slots[rest]
        while len(np.unique(again)) < len(rest) or factor == self.FACTOR:
            factor = np.uint64(int(factor) * int(self.FACTOR) % 2**64)
            again = self._slot(self.hashes[rest], factor)
        self.tables.append(self._table(again, rest))
        self.factors.append(factor)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.FACTOR) + ord(c)) % 2**64
        return h

    def _slot(self, hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(32))) * factor) >> np.uint64(64 - self.BITS)

    def _table(self, slots: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        out = np.full(1 << self.BITS, self.unknown, dtype=np.int32)
        out[slots] = pieces
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths of the words with the mark of a word's begin, and by piece length the piece at each start.

        Where no piece is, there is the number after the unknown one.
        """
        marked = [BEGIN + w for w in words]
        lengths = np.array([len(w) for w in marked])
        codes = np.array(marked).view(np.uint32).reshape(len(words), -1).astype(np.uint64)
        width, none, out = codes.shape[1], self.unknown + 1, []
        h = np.zeros_like(codes)
        for n in range(1, min(width, self.longest) + 1):
            h = h[:, : width - n + 1] * self.FACTOR + codes[:, n - 1 :]
            found = np.full(h.shape, none, dtype=np.int32)
            for table, factor in zip(self.tables, self.factors, strict=True):
                piece = table[self._slot(h, factor)]
                hit = (self.hashes[piece] == h) & (piece != self.unknown)
                found[hit] = piece[hit]
            if n == 1:
                found[(found == none) & (np.arange(width) < lengths[:, None])] = self.unknown
            out.append(found)
        return lengths, out

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability (words x languages) of each word, over all its segmentations; table: pieces x languages."""
        return self._forward(*self.edges(words), np.vstack([table, np.zeros(table.shape[1])]))[0]

    def _forward(self, lengths: np.ndarray, pieces: list[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Also the forward sums. Every RESCALE places, those that are still needed are scaled so that the last is 1."""
        width = pieces[0].shape[1]
        sums = np.zeros((width + 1, len(lengths), table.shape[1]))
        scale, out = np.zeros(sums.shape[1:]), np.zeros(sums.shape[1:])
        sums[0] = 1
        for j in range(1, width + 1):
            for n in range(1, min(j, len(pieces)) + 1):
                sums[j] += sums[j - n] * table[pieces[n - 1][:, j - n]]
            done = lengths == j
            if done.any():
                out[done] = np.log(sums[j][done]) + scale[done]
            if j % RESCALE == 0:
                by = np.where(sums[j] > 0, sums[j], 1)
                sums[max(0, j - len(pieces)) : j + 1] /= by
                scale += np.log(by)
        return out, sums

    def expected(self, words: list[str], table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts (pieces x languages) of words shorter than RESCALE that occur `counts` (words x languages) times."""
        lengths, pieces = self.edges(words)
        table = np.vstack([table, np.zeros(table.shape[1])])
        total, sums = self._forward(lengths, pieces, table)
        weight = counts / np.exp(total)
        width, out = pieces[0].shape[1], np.zeros(table.shape)
        back = np.zeros(sums.shape)
        back[lengths, np.arange(len(words))] = 1
        for i in range(width - 1, -1, -1):
            for n in range(1, min(width - i, len(pieces)) + 1):
                at = pieces[n - 1][:, i]
                held = np.flatnonzero(at <= self.unknown)
                if len(held):
                    after = table[at[held]] * back[i + n, held]
                    back[i, held] += after
                    share = sums[i, held] * after * weight[held]
                    for k in range(table.shape[1]):
                        out[:, k] += np.bincount(at[held], share[:, k], len(out))
        return out[:-1]


def by_length(words: list[str]) -> list[list[int]]:
    """Numbers of the words, in passes of similar length and PASS_CHARS characters."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    passes, now, most = [], [], 0
    for k in order:
        most = max(most, len(words[k]) + 1)
        if now and (len(now) + 1) * most > PASS_CHARS:
            passes.append(now)
            now, most = [], len(words[k]) + 1
        now.append(k)
    return [*passes, now] if now else passes


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and the probability table (pieces and the unknown one x languages).

    docs: doc_id, text, lang; rows with a null lang, or a text without letters, teach nothing. A language is learnt from
    about `max_docs` documents. The table's size is bounded by the vocabulary and the number of languages.
    """
    docs = docs.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, known = sorted(sizes), pieces(path)
    if not languages:
        return [], known, np.empty((len(known) + 1, 0))
    share = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max_docs / n)])
    sample = docs.where(share < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in in_slices(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(w for long in words_of(text) for w in parts_of(long, RESCALE - 2))
            for lang, words in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"]
                )

    place = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    counts = bounded_batches(sample).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(
        counts.groupBy("word").agg(F.collect_list(F.struct(place[F.col("lang")].alias("l"), "n")).alias("seen"))
        .repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), F.xxhash64("word"))
    )

    lattice, width = Lattice(known), len(languages)
    start = np.array([1.0 / (len(known) + 1)] * (len(known) + 1))[:, None].repeat(width, 1)
    table = start
    for _ in range(rounds):

        def expect(batches, table=table):
            total = np.zeros(table.shape)
            for batch in batches:
                found = batch.column("word").to_pylist()
                times = np.zeros((len(found), width))
                for k, seen in enumerate(batch.column("seen").to_pylist()):
                    for s in seen:
                        times[k, s["l"]] = s["n"]
                for group in by_length(found):
                    total += lattice.expected([found[k] for k in group], table, times[group])
            p, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(lang), pa.array(total[p, lang])], names=["p", "l", "n"])

        gained = words.mapInArrow(expect, "p long, l long, n double").groupBy("p", "l").agg(F.sum("n").alias("n")).toPandas()
        table = np.full(start.shape, 0.01)  # what a piece that was not seen counts
        table[gained["p"], gained["l"]] += gained["n"]
        table /= table.sum(axis=0)
    return languages, known, table


class Scorer:
    """Log probabilities of texts, with a bounded memory of words.

    Texts are cut at every ASCII character that is no letter; what is between may hold several words, or none.
    """

    def __init__(self, known: list[str], table: np.ndarray):
        self.lattice, self.table = Lattice(known), table
        self.reset()

    def reset(self) -> None:
        self.index: dict[int, int] = {}
        self.logs = np.empty((0, self.table.shape[1] + 1))

    def _learn(self, cuts: list[bytes]) -> np.ndarray:
        """Log probability by language, and number of words, of each cut."""
        words = [words_of(c.decode(errors="ignore")) for c in cuts]
        different = list(dict.fromkeys(w for found in words for w in found))
        logs = np.zeros((len(different), self.table.shape[1]))
        for group in by_length(different):
            logs[group] = self.lattice.forward([different[k] for k in group], self.table)
        place = {w: k for k, w in enumerate(different)}
        counts = np.array([len(found) for found in words])
        flat = np.array([place[w] for found in words for w in found], dtype=np.int64)
        out = np.zeros((len(cuts), self.table.shape[1] + 1))
        np.add.at(out[:, :-1], np.repeat(np.arange(len(cuts)), counts), logs[flat])
        out[:, -1] = counts
        return out

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability by language of each text, and its number of words."""
        data = b"\n".join(texts)
        starts, hashes = word_hashes(np.frombuffer(data, np.uint8), APART)
        out = np.zeros((len(texts), self.table.shape[1] + 1))
        if not len(starts):
            return out[:, :-1], out[:, -1]
        codes, different = pd.factorize(hashes)
        if len(self.index) + len(different) > MAX_CACHE:
            self.reset()
        known = [self.index.get(h, -1) for h in different.tolist()]
        new = [k for k, at in enumerate(known) if at < 0]
        if new:
            first = np.zeros(len(different), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            bounds = np.append(starts, len(data))
            cuts = [data[bounds[k] : bounds[k + 1]] for k in first[new].tolist()]
            for k in new:
                known[k] = self.index[int(different[k])] = len(self.index)
            self.logs = np.concatenate([self.logs, self._learn(cuts)])
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        begins = np.concatenate([[0], ends[:-1]])
        full = np.flatnonzero(ends > begins)
        values = self.logs[np.array(known)[codes]]
        out[full] = np.add.reduceat(values, begins[full])
        return out[:, :-1], out[:, -1]


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], lang: str = "lang_pred", name: str = "score") -> DataFrame:
    """`docs` with the predicted language and its probability among the languages of the model, all equally likely before.

    A text that is null or has no letter, and every text where no language was learnt, is `und` with score 0. Columns of
    `docs` that are named like the new ones are an error. Only texts go to Python, and only the two values come back.
    """
    if {lang, name} & set(docs.columns):
        raise ValueError(f"there is a column named {lang} or {name}")
    languages, known, table = model
    shared = docs.sparkSession.sparkContext.broadcast((known, table))

    @arrow_udf("struct<lang: string, p: double>")
    def found(texts: pa.Array) -> pa.Array:
        scorer, names, shares = worker_scorer(shared), [], []
        for piece in text_slices(texts):
            logs, counts = scorer.texts(piece)
            if languages:
                logs = np.exp(logs - logs.max(axis=1, keepdims=True))
                best, top = logs.argmax(axis=1).tolist(), (logs.max(axis=1) / logs.sum(axis=1)).tolist()
            names += [languages[best[k]] if languages and n else "und" for k, n in enumerate(counts)]
            shares += [top[k] if languages and n else 0.0 for k, n in enumerate(counts)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["lang", "p"])

    both = free_name(docs, "found")
    # Not deterministic for Spark, so that a filter on the result does not run it a second time.
    scored = bounded_batches(docs).withColumn(both, found.asNondeterministic()("text"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(both)["lang"].alias(lang), F.col(both)["p"].alias(name))


def worker_scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model; a worker runs many tasks one after the other."""
    known, table = shared.value
    name = f"scorer {hashlib.blake2b(table.tobytes()).hexdigest()}"
    return held_by_worker(name, lambda: Scorer(known, table))


def fit_held_out(docs: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """The model of the documents that crc32 of the id does not hold out (remainder 2 of 4)."""
    return fit(docs.select("doc_id", "text", "lang").where(~is_fold(F.col("doc_id"), 4, 2)))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang); repeated rows are scored each."""
    found = predict(docs.select("doc_id", "text"), fit_held_out(docs))
    return found.select("doc_id", is_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
