"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding by the byte table.

The rank file lists byte strings; the library wants merges of two known strings, in which each byte is one character of
a fixed mapping. A token's merge is the last step of its own bytes' encoding by the ranks below its own.

Between a character and a word, a single space always starts a new match of the splitting pattern, and so does a single line
end with what follows. Texts are cut there with numpy; every worker remembers the ids of the pieces it has seen, and only new
ones go to the library, many in one call; the bytes that each id stands for tell where one piece ends and the next begins.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, give_back, held_by_worker
from .units import GAP, ODD, PieceIds, byte_classes, expand, joined_calls, per_text, spread

#: The rank file of the registered queries.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces of one call of the library.
CALL = 200
#: Bytes of text encoded at a time: an array of places takes eight times as many, and there are several.
SLICE_BYTES = 500_000
#: Fixed value: the letter that stands for the space byte.
SPACE_LETTER = "\u0120"


def _marked(*values: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


#: Bytes that are no white space for certain, and those white space beyond ASCII may start with, have last but one, end in.
PRINTABLE = _marked(*range(0x21, 0x7F))
STARTS_SPACE, LEADS_SPACE = _marked(0xC2, 0xE1, 0xE2, 0xE3), _marked(0xC2, 0x9A, 0x80, 0x81)
ENDS_SPACE = _marked(0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(free))
        free += b not in printable
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that `token` consists of before its own rank is merged; two, if merging makes it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, ranks[token]), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(found)
        if rank >= ranks[token]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's own description of the vocabulary, as text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letter = byte_characters()
    spelt = lambda token: "".join(letter[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        parts = last_merge(token, ranks) if len(token) > 1 else []
        if len(parts) == 2:
            merges.append((spelt(parts[0]), spelt(parts[1])))
    model = models.BPE(vocab={spelt(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    out = Tokenizer(model)
    bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), bytes_])
    return out.to_str()


class Vocabulary:
    """What workers need of a rank file: the library's description and the bytes of each id. About 3 MB."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        ranks = read_ranks(path or public_tokenizers.path(RANKS))
        self.json = tokenizer_json(ranks, pattern or public_tokenizers.PATTERN)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.table = table
        self.key = hashlib.sha256(self.json.encode()).hexdigest()


class Encoder:
    """Encodes texts, with a bounded memory of pieces. One per Python worker.

    Cuts of printable ASCII without apostrophes fall further into runs of letters, digits and the rest, each with the space
    before it, as the splitting pattern has them. Such runs need no splitting and go to the bare merges, many in a call.
    """

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary.json)
        model = json.loads(vocabulary.json)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, ignore_merges=True, cache_capacity=0))
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lengths = np.array([len(t) for t in vocabulary.table], dtype=np.int64)
        self.classes = byte_classes(gaps=b" ")
        self.pieces = PieceIds(self._learn)

    def _together(self, tokenizer, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow each other in the texts, and how many each has, by the bytes that ids stand for."""
        found = [np.array(e.ids, dtype="<i4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, "<i4")
        return ids, np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(lengths), side="right") if len(ids) else [], prepend=0)

    def _learn(self, spelt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum(lengths) - lengths
        kind = self.classes[spelt]
        first = np.minimum(starts + (kind[starts] == GAP), starts + lengths - 1)
        inside = np.arange(len(spelt)) >= np.repeat(first, lengths)
        like = (kind == np.repeat(kind[first], lengths)) | ~inside
        plain = np.logical_and.reduceat(like, starts) & (kind[first] != GAP) & (kind[first] != ODD)
        runs = spelt[expand(starts[plain], lengths[plain])]
        calls = joined_calls(np.where(runs == 0x20, 1, runs), lengths[plain], CALL)
        runs_ids, runs_counts = self._together(self.bare, [c.replace("\1", SPACE_LETTER) for c in calls], lengths[plain])
        rest = np.flatnonzero(~plain)
        texts = [spelt[starts[k] : starts[k] + lengths[k]].tobytes().decode() for k in rest.tolist()]
        # In a row, a single space between characters that are none always starts a new match.
        joins = np.array([t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace() for t in texts], dtype=bool)
        grouped, alone = rest[joins], rest[~joins]
        chosen = [t for t, j in zip(texts, joins, strict=True) if j]
        rows = ["".join(chosen[i : i + CALL]) for i in range(0, len(chosen), CALL)]
        grouped_ids, grouped_counts = self._together(self.tokenizer, rows, lengths[grouped])
        found = self.tokenizer.encode_batch_fast([t for t, j in zip(texts, joins, strict=True) if not j], add_special_tokens=False)
        found = [np.array(e.ids, dtype="<i4") for e in found]
        order = np.concatenate([np.flatnonzero(plain), grouped, alone])
        counts, at = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        counts[order] = np.concatenate([runs_counts, grouped_counts, [len(f) for f in found]])
        at[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([runs_ids, grouped_ids, *found]), at, counts

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces start in texts that start at `begins` of one array of bytes."""
        near = lambda by: np.concatenate([np.zeros(by, np.uint8), data, np.zeros(by, np.uint8)])
        last, before = near(1)[: len(data)], near(2)[: len(data)]
        after = near(1)[2:]
        solid = (PRINTABLE[last] | ((last >= 0x80) & ~(LEADS_SPACE[before] & ENDS_SPACE[last]))) & (PRINTABLE[after] | ((after >= 0xC0) & ~STARTS_SPACE[after]))
        text_start = np.zeros(len(data) + 1, dtype=bool)
        text_start[begins] = True
        solid &= ~text_start[:-1] & ~text_start[1:]
        line = solid & (data == 0x0A)
        starts = text_start[:-1] | (solid & (data == 0x20)) | line
        starts[1:] |= line[:-1]
        first = np.flatnonzero(starts)
        ends = np.append(first[1:], len(data))
        kind = self.classes[data]
        odd = np.logical_or.reduceat((kind == ODD) | ((kind == GAP) & ~starts), first)
        runs = np.concatenate([[False], (kind[1:] != kind[:-1]) & (kind[:-1] != GAP)])
        return np.flatnonzero(starts | (runs & ~spread(odd, first, ends, len(data))))

    def encode(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        texts = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        begins = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return [np.empty(0, dtype="<i4")] * len(texts)
        starts = self.cuts(data, begins[:-1])
        ids, counts = self.pieces.encode(data, starts, np.append(starts[1:], len(data)))
        return np.split(ids, per_text(ids, counts, starts, begins[:-1])[:-1]) if len(texts) > 1 else [ids]


def worker_encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; a worker runs many tasks one after the other."""
    return held_by_worker(f"encoder {shared.value.key}", lambda: Encoder(shared.value))


def slices(sizes: list[int], most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            out.append((start, i))
            start, total = i, 0
        total += size
    return [*out, (start, len(sizes))] if sizes else out


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), pa.int32()))


def encode_texts(encoder: Encoder, texts: pa.Array) -> pa.Array:
    """Token ids of each text of an Arrow batch, in slices of bounded size.

    Then memory that is free goes back to the system: workers of several stages share an executor with its heap.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out = [id_lists(encoder.encode(texts.slice(a, b - a).cast(pa.binary()).to_pylist())) for a, b in slices(sizes)]
    give_back()
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def decode_lists(table: list[bytes], lists: pa.Array) -> pa.Array:
    """The bytes of each list of ids of an Arrow batch; null lists stand for none, an unknown id is an error."""
    values = lists.values.to_numpy(zero_copy_only=False) if len(lists) else np.empty(0, np.int32)
    if len(values) and (values.min() < 0 or values.max() >= len(table)):
        raise ValueError("an id is not in the vocabulary")
    piece, bounds, valid = table.__getitem__, lists.offsets.to_pylist(), lists.is_valid().to_pylist()
    return pa.array([b"".join(map(piece, values[a:b].tolist())) if v else b"" for a, b, v in zip(bounds, bounds[1:], valid, strict=False)], pa.binary())


def encoded(docs: DataFrame, text: str = "text", name: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """`docs` with the token ids of a text column; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_texts(worker_encoder(shared), texts)

    return bounded_batches(docs).withColumn(name, encode(F.col(text)))


def offsets(docs: DataFrame, ids: str = "ids", name: str = "spans", vocabulary: Vocabulary | None = None) -> DataFrame:
    """`docs` with the first and the last character + 1 of each token's text, as an array of pairs.

    Tokens that hold parts of one character all span that character.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary or Vocabulary()).table)

    @arrow_udf("array<struct<start: int, end: int>>")
    def spans(lists: pa.Array) -> pa.Array:
        out = []
        for tokens in lists.to_pylist():
            pieces = [shared.value[t] for t in tokens or []]
            data = np.frombuffer(b"".join(pieces), np.uint8)
            ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
            character = np.cumsum((data & 0xC0) != 0x80)
            out.append([{"start": int(character[e - len(p)]) - 1, "end": int(character[e - 1])} for p, e in zip(pieces, ends, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return bounded_batches(docs).withColumn(name, spans(F.col(ids)))


def decoded(docs: DataFrame, ids: str = "ids", name: str = "bytes", vocabulary: Vocabulary | None = None) -> DataFrame:
    """`docs` with the bytes that an array of ids stands for; null ids stand for none, an unknown id is an error.

    The bytes of characters that are split over tokens join again; ids cut off within a character give its first bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary or Vocabulary()).table)

    @arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        return decode_lists(shared.value, lists)

    return bounded_batches(docs).withColumn(name, decode(F.col(ids)))


def readable(name: str | Column) -> Column:
    """Decoded bytes as text; bytes of a character cut off become the replacement character."""
    return F.make_valid_utf8((F.col(name) if isinstance(name, str) else name).cast("string"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs` (doc_id, text); other columns are not looked at."""
    # In one function: of two in a row, Spark would run the first one again for the second.
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())

    @arrow_udf("struct<ids: array<int>, bytes: binary>")
    def both(texts: pa.Array) -> pa.Array:
        ids = encode_texts(worker_encoder(shared), texts)
        return pa.StructArray.from_arrays([ids, decode_lists(shared.value.table, ids)], names=["ids", "bytes"])

    tokens = bounded_batches(docs).select("doc_id", both("text").alias("both")).select("doc_id", "both.ids", "both.bytes")
    written = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
