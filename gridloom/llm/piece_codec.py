"""SentencePiece BPE by a prefix table of last tokens.

What BPE makes of a text has a property that a left-to-right pass can use: the tokens of
any stretch between two token boundaries are what BPE makes of that stretch alone, and a
row of tokens is right as soon as every two neighbours are. So every prefix has one last
token, and the table of them is enough:

- An automaton over all pieces gives the pieces that end at a position.
- Of these, only one goes with the last token of the prefix before it; whether two tokens go
  together ("compatible") depends on them alone, and is remembered.
- From the end, the table's tokens lead back to the beginning.

Two tokens are compatible if merging their joined text, highest score first and leftmost of
equal scores, never merges across the border. That is replayed on the merges of each token
by itself and the symbols at the border: whichever of the three next merges is first.

In this model family any two neighbours whose joined text is a piece may merge. Characters
that are no piece never merge, so they part the text, and are written as byte pieces. So do
places where a blank follows something else, if no piece holds such a place. The stretches
between are words, mostly, and a bounded number of them is remembered.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ..sources.archives import wire_fields
from .textkit import ranges

#: Fixed values of the model format: the blank's symbol, model and piece types.
BLANK, BPE, NORMAL, UNKNOWN, CONTROL, BYTE = "▁", 2, 1, 2, 3, 6
#: Stretches remembered, of how many characters at most; pairs remembered; ids decoded at once.
WORDS, WORD_LENGTH, PAIRS, SLICE = 200_000, 40, 2_000_000, 1 << 20

codecs.register_error("bytewise", lambda e: ("�", e.start + 1))


class Codec:
    """Encodes and decodes texts with one model. Raises ValueError for models of other types
    (unigram, word), with pieces set by users, without bytes for unknown characters, or that
    fold blanks."""

    def __init__(self, path: str) -> None:
        self.library = SentencePieceProcessor(model_file=path)
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in wire_fields(self.library.serialized_model_proto()):
            if number == 1:
                piece = dict(wire_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kind.append(piece.get(3, NORMAL))
            elif number in (2, 3):
                (trainer if number == 2 else normalizer).update(wire_fields(value))
        if trainer.get(3, 1) != BPE or set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE} or self.kind.count(BYTE) != 256 or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("not a BPE model with byte pieces, a blank in front and blanks kept")
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        known = "".join(re.escape(t) for t in self.ids if len(t) == 1)
        self.runs = re.compile(f"[{known}]+|[^{known}]+", re.DOTALL)
        self.stretches = re.compile(self._stretches(), re.DOTALL)
        self.histories: dict[int, list[tuple[float, int, int]]] = {}
        self.start: dict[int, bool] = {}
        self.pairs: list[dict[int, bool]] = [{} for _ in self.text]
        self.judged = 0
        self.words: dict[str, bytes] = {}
        surface = [b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(BLANK, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.sizes = np.array([len(s) for s in surface])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.leads = np.array([k == NORMAL and t.startswith(BLANK) for t, k in zip(self.text, self.kind, strict=True)])

    def _stretches(self) -> str:
        """A pattern of stretches that no piece reaches over. A place parts the text where no
        piece holds its two characters side by side: before blanks and, of the characters
        other than letters and digits, before those that no piece has behind others."""
        beside = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        if any(b == BLANK != a for a, b in beside):
            return ".+"
        signs = {c for c in self.ids if len(c) == 1 and c != BLANK and not (c.isalpha() or c.isdecimal())}
        signs |= {chr(c) for c in range(128)} - set(self.ids)  # no pieces: written as bytes
        while joined := {b for a, b in beside if b in signs and a not in signs and a != BLANK}:
            signs -= joined
        some = re.escape("".join(sorted(signs)))
        return f"{BLANK}*[^{BLANK}{some}]+|{BLANK}*[{some}]+[^{BLANK}{some}]*|{BLANK}+" if signs else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"

    def history(self, token: int) -> list[tuple[float, int, int]]:
        """What merging a piece's own text does, step by step: the score of the step, then
        the symbols at its left and right border; the first entry is the state before."""
        if token not in self.histories:
            symbols = [self.ids[c] for c in self.text[token]]
            steps = [(np.inf, symbols[0], symbols[-1])]
            while len(symbols) > 1:
                joined = [self.ids.get(self.text[a] + self.text[b]) for a, b in zip(symbols, symbols[1:])]
                at = max((i for i, j in enumerate(joined) if j is not None), key=lambda i: (self.score[joined[i]], -i), default=None)
                if at is None:
                    break
                symbols[at : at + 2] = [joined[at]]
                steps.append((self.score[joined[at]], symbols[0], symbols[-1]))
            self.histories[token] = steps if symbols == [token] else []
        return self.histories[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined text is merged to just these two. Each has to come
        from its own text; of equal scores what stands further left is first."""
        a, b = self.history(left), self.history(right)
        if not a or not b:
            return False
        i = j = 0
        while True:
            across = self.ids.get(self.text[a[i][2]] + self.text[b[j][1]])
            border = -np.inf if across is None else self.score[across]
            own = a[i + 1][0] if i + 1 < len(a) else None
            other = b[j + 1][0] if j + 1 < len(b) else None
            if across is not None and (own is None or border > own) and (other is None or border >= other):
                return False
            if own is not None and (other is None or own >= other):
                i += 1
            elif other is not None:
                j += 1
            else:
                return True

    def _tokens(self, run: str) -> list[int]:
        """The tokens of a run of known characters."""
        last, size, near = [-1] * (len(run) + 1), [0] * (len(run) + 1), [self.start] * (len(run) + 1)
        for end, (token, length) in self.automaton.iter(run):
            end += 1
            if not size[end]:
                fits = near[end - length].get(token)
                if fits is None:
                    fits = self._judge(last[end - length], token, near[end - length])
                if fits:
                    last[end], size[end], near[end] = token, length, self.pairs[token]
        out, at = [], len(run)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _judge(self, before: int, token: int, known: dict[int, bool]) -> bool:
        """Whether a token may follow another one, or begin a text; remembered."""
        if self.judged >= PAIRS:
            for pairs in (self.start, *self.pairs):
                pairs.clear()
            self.judged = 0
        self.judged += 1
        known[token] = self.compatible(before, token) if before >= 0 else bool(self.history(token))
        return known[token]

    def _stretch(self, text: str) -> bytes:
        out: list[int] = []
        for run in self.runs.findall(text):
            out += self._tokens(run) if run[0] in self.ids else [self.byte[b] for b in run.encode()]
        return array("i", out).tobytes()

    def ids_of(self, text: str) -> bytes:
        """A text's ids, as little 32-bit integers."""
        out, words = [], self.words
        for stretch in self.stretches.findall(self.library.normalize(text)) if text else ():
            ids = words.get(stretch)
            if ids is None:
                ids = self._stretch(stretch)
                if len(stretch) <= WORD_LENGTH:
                    if len(words) >= WORDS:
                        words.clear()
                    words[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def text_of(self, ids: np.ndarray) -> str:
        """The text of ids: pieces' surfaces joined, without the blank that was put in front;
        bytes that are no UTF-8 become U+FFFD one by one."""
        parts = [self.surface[ranges(self.starts[some], self.sizes[some])].tobytes() for some in (ids[a : a + SLICE] for a in range(0, len(ids), SLICE))]
        data = b"".join(parts)
        shown = np.flatnonzero(self.sizes[ids[:SLICE]] > 0)
        if len(shown) and self.leads[ids[shown[0]]]:
            data = data[1:]
        return data.decode("utf-8", "bytewise")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, one a Python process; what it remembers is bounded."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoder(model: str) -> Callable[[Column | str], Column]:
    """A function of a text column that gives its ids, as ``array<int>``. Null and empty
    texts have none."""

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model)
        for batch in texts:
            found = [own.ids_of(t) if t else b"" for t in batch.to_pylist()]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return ids


def decoder(model: str) -> Callable[[Column | str], Column]:
    """A function of a column of ids that gives the text; of null it gives the empty text."""

    @F.arrow_udf("string")
    def texts(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model)
        for batch in ids:
            yield pa.array([own.text_of(np.asarray(row.values)) if row.is_valid else "" for row in batch], pa.string())

    return texts


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: how many ids its
    text has, the digest of the ids (decimal, joined by commas) and that of the text which
    decoding gives, in UTF-8.

    A row a document, in place: no shuffle. Null and empty texts have no ids and decode to
    the empty text. Texts are taken whole, of any length, with or without blanks; repeated
    rows and ids and null ids are rows like others; further columns are ignored whatever
    their names; an empty table gives no rows.
    """
    # The plan names its columns itself: the two Python steps run one after the other.
    found = docs.select("doc_id", encoder(model)(F.col("text")).alias("ids"))
    digests = found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), decoder(model)(F.col("ids")).alias("decoded"))
    return digests.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
