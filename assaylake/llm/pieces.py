"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_text, read, small_batches

#: The mark that stands for a space, how far below the lowest score an unknown character scores, segments whose pieces a
#: worker remembers beside those of the texts at hand (then the memory starts anew), characters of the longest of
#: these, and characters that the automaton of many segments at once knows.
SPACE, UNKNOWN_PENALTY, REMEMBERED, LONGEST, COMMON = "▁", 10.0, 150_000, 64, 160
#: Piece types of the model format.
NORMAL, CONTROL, USER_DEFINED, BYTE = 1, 3, 4, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and types of a model file. It crosses to the workers as plain lists; each builds its own automaton."""

    def __init__(self, pieces: list[tuple[str, float, int]], add_prefix: bool = True):
        self.pieces, self.add_prefix = pieces, add_prefix
        self.digest = hashlib.sha256(repr((pieces, add_prefix)).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models of the identity normaliser that keep white space are known here")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix)


class Coder:
    """Encodes and decodes texts with a vocabulary.

    A text is taken as it is, with a space put before it (if the model says so) and spaces shown by a mark. The best
    segmentation has the highest sum of scores; of equal ones, each position prefers its longest last piece. A character
    that is in no piece of its own scores UNKNOWN_PENALTY below the lowest score, and is spelt in byte pieces, or as the
    unknown piece if the model has none. A mark in the text itself is spelt in bytes too, so that decoding gives it back."""

    def __init__(self, vocabulary: Vocabulary):
        self.add_prefix = vocabulary.add_prefix
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.unknown = next((i for i, (_, _, kind) in enumerate(vocabulary.pieces) if kind == 2), 0)
        lowest, texts = 0.0, []
        for i, (piece, score, kind) in enumerate(vocabulary.pieces):
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(b"" if kind != NORMAL and kind != USER_DEFINED else piece.replace(SPACE, " ").encode())
            if kind in (NORMAL, USER_DEFINED) and piece:
                self.automaton.add_word(piece, (i, len(piece), score))
                lowest = min(lowest, score)
                texts.append(piece)
                if len(piece) == 1:
                    self.single.add(piece)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        if texts:
            self.automaton.make_automaton()
        self.any = bool(texts)
        # a text falls apart where no piece can reach across: before a run of marks, and around line feeds
        no_inner = not any(SPACE in p.lstrip(SPACE) for p in texts)
        line_feed = not any("\n" in p for p in texts)
        self.cut = re.compile((r"▁+[^▁\n]*|[^▁\n]+|\n" if line_feed else r"▁+[^▁]*|[^▁]+")) if no_inner else re.compile(r"(?s).+")
        self.memory = _Memory(self)
        self.lockstep = Lockstep([(p, i, s) for p, (i, _, s) in self.automaton.items()] if texts else [])

    def spell(self, character: str) -> list[int]:
        if len(self.byte_id) < 256:
            return [self.unknown]
        return [self.byte_id[b] for b in character.encode("utf-8", "surrogatepass")]

    def viterbi(self, s: str) -> list[int]:
        """One pass over s: at each end position the automaton's state and its output links give every piece that ends
        there, and each relaxes the position's best score."""
        n = len(s)
        best, came, length = [0.0] + [-np.inf] * n, [-1] * (n + 1), [1] * (n + 1)
        single, unknown, filled = self.single, self.unknown_score, 0
        for end, (piece, size, score) in self.automaton.iter(s) if self.any else ():
            end += 1
            while filled < end:
                filled += 1
                if s[filled - 1] not in single:
                    best[filled] = best[filled - 1] + unknown
            total = best[end - size] + score
            if total > best[end] or (total == best[end] and came[end] < 0):
                best[end], came[end], length[end] = total, piece, size
        out, at = [], n
        while at:
            if came[at] < 0:
                out.extend(reversed(self.spell(s[at - 1])))
                at -= 1
            else:
                out.append(came[at])
                at -= length[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for null and for an empty text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text. Segments not met before are segmented together."""
        mark = array("i", self.spell(SPACE)).tobytes()
        parts = [[self.cut.findall((" " * (self.add_prefix and not i) + part).replace(" ", SPACE)) for i, part in enumerate(t.split(SPACE))] if t else [] for t in texts]
        every = set().union(*(segments for ps in parts for segments in ps))
        memory = self.memory
        new = [x for x in every if x not in memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(every)
        common = self.lockstep.known.issuperset
        memory.update(self.lockstep.segment([x for x in new if len(x) <= LONGEST and common(x)]))
        recall = self.memory.__getitem__
        return [np.frombuffer(mark.join([b"".join(map(recall, segments)) for segments in ps]), np.int32) for ps in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: encode's inverse. Bytes that are no UTF-8 give replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


class Lockstep:
    """The same automaton and Viterbi over many short segments at once: step j takes the j-th character of each.

    It holds the pieces made of the COMMON characters that most pieces have, one state for each of their prefixes, a full
    table of transitions, and for each state the longest piece that ends there and, as output link, the state of the next."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        often = Counter(c for p, _, _ in pieces for c in p)
        alone = {p for p, _, _ in pieces if len(p) == 1}
        chars = [c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0])) if c in alone][:COMMON]
        self.known, self.code = set(chars), np.full(0x110000, -1, np.int16)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        children: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, int, float]] = {}
        for piece, i, score in pieces:
            if self.known.issuperset(piece):
                at = 0
                for c in piece:
                    at = children[at].setdefault(c, len(children))
                    if at == len(children):
                        children.append({})
                ends[at] = (i, len(piece), score)
        n = len(children)
        self.go = np.zeros((n, max(1, len(chars))), np.int32)
        self.piece, self.size, self.score = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n)
        for at, (i, size, score) in ends.items():
            self.piece[at], self.size[at], self.score[at] = i, size, score
        self.link, self.first = np.zeros(n, np.int32), np.zeros(n, np.int32)
        level, fail = [0], np.zeros(n, np.int32)
        while level:  # by depth: what a state lacks it has from the state of its longest proper suffix
            below = []
            for at in level:
                own = children[at]
                row = self.go[fail[at]].copy() if at else self.go[0]
                for c, child in own.items():
                    k = self.code[ord(c)]
                    fail[child] = row[k] if at else 0
                    below.append(child)
                for c, child in own.items():
                    row[self.code[ord(c)]] = child
                self.go[at] = row
            for at in below:
                self.link[at] = self.first[fail[at]]
                self.first[at] = at if self.piece[at] >= 0 else self.link[at]
            level = below

    def segment(self, segments: list[str]) -> dict[str, bytes]:
        """The bytes of each segment's ids, as 32-bit numbers."""
        out: dict[str, bytes] = {}
        segments = sorted(segments, key=len, reverse=True)
        for at in range(0, len(segments), 1 << 13):
            part = segments[at : at + (1 << 13)]
            out.update(zip(part, self._segment(part), strict=True))
        return out

    def _segment(self, segments: list[str]) -> list[bytes]:
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        n, longest = len(segments), int(lengths[0])
        codes = self.code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        text = np.zeros((longest, n), np.int16)
        text.T[np.arange(longest)[None, :] < lengths[:, None]] = codes
        best = np.full((longest + 1, n), -np.inf)
        came = np.zeros((longest + 1, n), np.int32)
        best[0], state = 0.0, np.zeros(n, np.int32)
        for j in range(1, longest + 1):
            live = int(np.searchsorted(-lengths, -j, "right"))  # segments are in order of falling length
            state = self.go[state[:live], text[j - 1, :live]]
            who, node = np.arange(live), self.first[state]
            while len(who):
                total = best[j - self.size[node], who] + self.score[node]
                better = total > best[j, who]
                best[j, who[better]], came[j, who[better]] = total[better], node[better]
                node = self.link[node]
                more = node > 0
                who, node = who[more], node[more]
        ids = np.zeros((n, longest), np.int32)
        at, to, who = lengths.copy(), np.full(n, longest), np.arange(n)
        while len(who):
            node = came[at[who], who]
            to[who] -= 1
            ids[who, to[who]] = self.piece[node]
            at[who] -= self.size[node]
            who = who[at[who] > 0]
        raw, width = ids.tobytes(), 4 * longest
        return [raw[i * width + 4 * k : (i + 1) * width] for i, k in enumerate(to.tolist())]


class _Memory(dict):
    """Segments and the bytes of their ids as 32-bit numbers."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, segment: str) -> bytes:
        out = array("i", self.coder.viterbi(segment)).tobytes()
        if len(segment) <= LONGEST:
            self[segment] = out
        return out


_coders: dict[str, Coder] = {}


def coder(vocabulary: Vocabulary) -> Coder:
    """This process's coder for a vocabulary."""
    if vocabulary.digest not in _coders:
        _coders.clear()
        _coders[vocabulary.digest] = Coder(vocabulary)
    return _coders[vocabulary.digest]


def forget() -> None:
    """Empties the memory of this process's coder."""
    for c in _coders.values():
        c.memory.clear()


def encode(docs: DataFrame, model: str | None = None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, ids, n_pieces, and round_trip: whether the ids decode to the text.

    Null texts have null ids, no pieces and a null round_trip; empty texts have empty ids. Texts are coded whole, however long;
    of equally good segmentations each position prefers its longest last piece; repeated rows give a row each; an empty table
    gives none. A carried column named as a result gets an underscore behind its name."""
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))  # the model's pieces, whatever the rows

    def of(texts: list[str | None]) -> dict:
        c = coder(shipped.value)
        ids = c.encode_all(texts)
        return {
            "ids": pa.array([None if t is None else i for t, i in zip(texts, ids, strict=True)], pa.list_(pa.int32())),
            "n_pieces": pa.array([len(i) for i in ids], pa.int64()),
            "round_trip": pa.array([None if t is None else c.decode(i) == t for t, i in zip(texts, ids, strict=True)], pa.bool_()),
        }

    return by_text(docs, of, "ids array<int>, n_pieces long, round_trip boolean", text, carry, 1 << 19, forget)


def decode(coded: DataFrame, model: str | None = None, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry and text, from ids. Null ids give null."""
    shipped = coded.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))

    def batches(it):
        for batch in it:
            c = coder(shipped.value)
            column = batch.column(len(carry))
            texts = pa.array([None if x.as_py() is None else c.decode(np.array(x.as_py(), np.int64)) for x in column], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), texts], [*carry, "text"])

    types = dict(coded.dtypes)
    return small_batches(coded).select(*carry, ids).mapInArrow(batches, ", ".join([*(f"`{c}` {types[c]}" for c in carry), "text string"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document's ids, and whether they decode to its text."""
    return encode(read(spark, sf_dir, "documents"))
