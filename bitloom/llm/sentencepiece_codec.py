"""SentencePiece encoding and decoding by a shared-prefix dynamic program over sorted words.

White space becomes the mark, each text is cut before runs of marks, and the distinct marked words of a batch are
sorted. Sorted order is a depth-first walk through their trie: a word keeps the forward states of the prefix it shares
with the word before and computes only the rest.

Two forward states exist. For unigram vocabularies it is the Viterbi score: the best path's score and last piece at
each position. Byte-pair vocabularies (the public ``piece_bpe_32k.model`` is one) don't choose the best-scoring path,
so there the state is the last piece of the prefix's own encoding. It is unique: a sequence of pieces is a byte-pair
encoding exactly when each neighbouring pair is, because merges inside a span don't depend on what lies outside until
one crosses its border. A piece is therefore the last one when the pair of the state before it and the piece encodes
to itself; those pair decisions are remembered.

No piece of the model has a mark after another character, so words never merge and the result equals that of encoding
the whole text (the tests compare with the library).

Defined results: null and empty texts have no pieces and decode to the empty text. Characters outside the vocabulary
become byte pieces. A mark character in a text decodes to a space, as in the library. Repeated rows give repeated
results, null ids stay null, an empty table gives an empty result, other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_path

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LONE = re.compile("[\udc80-\udcff]")
#: Words of at most so many characters whose pieces a worker remembers between batches; then it starts anew. Longer ones
#: (texts without spaces) are encoded in each batch.
REMEMBERED_WORDS, REMEMBERED_LENGTH = 150_000, 48
#: Pair decisions that a worker remembers; then it starts anew.
REMEMBERED_PAIRS = 250_000


class Vocabulary:
    """Pieces with scores, and the forward states of words."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], unigram: bool = False) -> None:
        self.ids, self.scores, self.unigram = pieces, scores, unigram
        self.endings = {p[i:] for p in pieces for i in range(len(p))}
        self.floor = min(scores.values(), default=0.0) - 10.0
        if unigram:
            return
        ordered = sorted(scores, key=lambda p: -scores[p])
        self.rank = {p: n for n, p in enumerate(ordered)}
        once = {}
        for p in ordered:
            once[scores[p]] = scores[p] not in once
        self.tied = {p for p in ordered if not once[scores[p]]}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair encoding of a short string: always the best pair, the leftmost of equals. Stops at ``least`` parts."""
        parts = list(text)
        while len(parts) > least:
            found = [(-self.scores[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece is made of last; none if it doesn't encode to itself."""
        if piece not in self.halves:
            parts = self.merged(piece, 2)
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces together encode to themselves. Undoes their merges, the latest first, and looks
        whether the parts at the border would have merged before that time."""
        if len(right) > 1 and self.last_merge(right) is None:
            return False
        if not left:
            return True
        if left in self.tied or right in self.tied:
            return self.merged(left + right) == [left, right]
        rank, limit = self.rank, 1 << 60
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            made_left = rank[left] if len(left) > 1 else -1
            made_right = rank[right] if len(right) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, self.last_merge(left)[1]
            else:
                limit, right = made_right + 1, self.last_merge(right)[0]

    def _last_piece(self, word: str, end: int, states: list) -> str:
        """The last piece of the byte-pair encoding of ``word[:end]``."""
        endings, ids, pairs = self.endings, self.ids, self.pairs
        starts, at = [end - 1], end - 2
        while at >= 0 and (part := word[at:end]) in endings:
            if part in ids:
                starts.append(at)
            at -= 1
        for start in reversed(starts):
            piece, left = word[start:end], states[start]
            known = pairs.get(left)
            if known is None:
                known = pairs[left] = {}
            if piece not in known:
                self.n_pairs += 1
                known[piece] = self.fits(left, piece)
            if known[piece]:
                return piece
        raise AssertionError("a prefix always has a last piece")

    def _best_path(self, word: str, end: int, states: list) -> tuple[float, str]:
        """Score and last piece of the best path to ``end``; of equal scores the longest last piece."""
        found = [(states[end - 1][0] + self.scores.get(word[end - 1], self.floor), word[end - 1])]
        at = end - 2
        while at >= 0 and (part := word[at:end]) in self.endings:
            if part in self.ids:
                found.append((states[at][0] + self.scores[part], part))
            at -= 1
        return max(found, key=lambda p: (p[0], len(p[1])))

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each distinct word, in sorted order, with its pieces."""
        step = self._best_path if self.unigram else self._last_piece
        before, states = "", [(0.0, "") if self.unigram else ""]
        for word in sorted(set(words)):
            if not self.unigram and self.n_pairs > REMEMBERED_PAIRS:
                self.pairs, self.n_pairs = {}, 0
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(step(word, end, states))
            pieces, end = [], len(word)
            while end:
                piece = states[end][1] if self.unigram else states[end]
                pieces.append(piece)
                end -= len(piece)
            yield word, pieces[::-1]
            before = word


class Codec:
    """Encodes and decodes texts with a SentencePiece model given as bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        normal = [i for i in range(len(names)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.bytes = {int(names[i][1:-1], 16): i for i in range(len(names)) if lib.is_byte(i)}
        self.vocabulary = Vocabulary({names[i]: i for i in normal}, {names[i]: lib.get_score(i) for i in normal})
        self.unknown = lib.unk_id()
        self.texts = [n.replace(MARK, " ") for n in names]
        for b, i in self.bytes.items():  # bytes of longer characters stand as lone surrogates until they are joined
            self.texts[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.known: dict[str, tuple[int, ...]] = {}

    def _ids(self, pieces: list[str]) -> tuple[int, ...]:
        whole = tuple(map(self.vocabulary.ids.get, pieces))
        if None not in whole:
            return whole
        out: list[int] = []
        for piece in pieces:
            if (i := self.vocabulary.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return tuple(out)

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[array]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        known, split = self.known, [self.words(t) for t in texts]
        new = {MARK + w for words in split for w in words if w not in known}
        known.update((w[1:], self._ids(p)) for w, p in self.vocabulary.segment(new))
        found = [array("I", chain.from_iterable(map(known.__getitem__, words))) for words in split]
        for word in new:
            if len(word) > REMEMBERED_LENGTH:
                del known[word[1:]]
        return found

    def decode(self, ids: Iterable[int]) -> str:
        whole = "".join(map(self.texts.__getitem__, ids))
        if _LONE.search(whole):
            whole = whole.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def _mapped(docs: DataFrame, id_col: str, value: str, schema: str, fill: Callable) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield from fill(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), value).mapInArrow(batches, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id and ids, the piece ids of the whole text."""
    model = open(model_path or tokenizer_path("piece_bpe_32k.model"), "rb").read()

    def fill(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = _codec(model).encode(part.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([memoryview(x).tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _mapped(docs.withColumn("__text", text_or_empty(text_col)), id_col, "__text", "ids array<int>", fill)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """doc_id and text, from the piece ids."""
    model = open(model_path or tokenizer_path("piece_bpe_32k.model"), "rb").read()

    def fill(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        texts = [codec.decode(x or ()) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _mapped(encoded, id_col, ids_col, "text string", fill)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids),
    decoded_sha256 and exact (the decoded text equals the text)."""
    model = open(model_path or tokenizer_path("piece_bpe_32k.model"), "rb").read()

    def fill(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec, texts = _codec(model), part.column(1).to_pylist()
        rows: list[list] = [[], [], [], []]
        for text, ids in zip(texts, codec.encode(texts)):
            back = codec.decode(ids)
            for column, x in zip(rows, (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text)):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "exact"]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=names)

    schema = "n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean"
    return _mapped(docs.withColumn("__text", text_or_empty(text_col)), id_col, "__text", schema, fill)
