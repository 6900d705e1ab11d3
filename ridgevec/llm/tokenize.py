"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

The merges are compiled, as far as the corpus needs them, into a deterministic
transducer over bytes. It rests on two facts about a vocabulary whose merges
were learned in rank order:

* a sequence of tokens is what the merges yield exactly if each neighbouring
  pair is - no merge crosses the boundary of the two;
* so every prefix of a piece has one last token, and the encodings of all its
  prefixes form a tree.

A state holds the part of that tree which later bytes can still choose from:
the bytes since the last settled boundary and the last token at each position
where a longer token may have begun. Once all those positions agree on an
earlier boundary, the tokens up to it are emitted; tokens have bounded length,
so the lookahead has too. States and transitions are made when first met.

Null and empty texts give an empty list of ids.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgevec.session import table

#: Where the vocabulary is; a parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text falls into pieces before the merges (fixed by the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the memos, which are emptied beyond it; speed alone depends on it.
MEMO = 400_000
NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base-64 token and its rank; the rank is the id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    START = 0

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.begins = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks), default=0)
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: token before the boundary (-1: none), bytes since it, and
        # for each position after it the last token there (-1: not needed)
        self.states: list[tuple] = [(-1, b"", ())]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple]] = {}
        self.ends: dict[int, tuple] = {}

    # -- merges ---------------------------------------------------------
    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: what the merges of
        lower rank leave of its bytes."""
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= token:
                raise ValueError(f"token {token} can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _spine(self, token: int, memo: dict, side: int) -> tuple:
        """Pieces that stand at one end of ``token`` as its merges proceed,
        from the single byte to the token itself."""
        if token not in memo:
            memo[token] = (token,) if len(self.tokens[token]) == 1 else (*self._spine(self._halves(token)[side], memo, side), token)
        return memo[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes leave just a and b: at no
        time do the pieces beside the boundary merge before their own next
        merge. Of equal merges the left one goes first."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        xs, ys = self._spine(a, self.right, 1), self._spine(b, self.left, 0)
        i = j = 0
        ok = True
        while True:
            next_x = xs[i + 1] if i + 1 < len(xs) else NEVER
            next_y = ys[j + 1] if j + 1 < len(ys) else NEVER
            cross = self.ranks.get(self.tokens[xs[i]] + self.tokens[ys[j]], NEVER)
            if cross < next_x and cross <= next_y and cross < NEVER:
                ok = False
                break
            if next_x == next_y == NEVER:
                break
            if next_x <= next_y:
                i += 1
            else:
                j += 1
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    # -- states -----------------------------------------------------------
    def _make_move(self, state: int, byte: int) -> tuple[int, tuple]:
        before, text, last = self.states[state]
        text = text + bytes([byte])
        n = len(text)
        found = -1
        for k in range(max(0, n - self.longest), n):
            at = before if k == 0 else last[k - 1]
            if k and at < 0:
                continue
            token = self.ranks.get(text[k:], -1)
            if token >= 0 and (at < 0 or self.fits(at, token)):
                found = token
                break
        if found < 0:
            raise ValueError("the vocabulary lacks a byte")
        last = (*last, found)
        size = lambda k: len(self.tokens[last[k - 1]])
        # positions where a token that goes on may have begun, and the end
        open_at = [k for k in range(n) if (k == 0 or last[k - 1] >= 0) and text[k:] in self.begins] + [n]
        chains = []
        for k in open_at:
            chain = [k]
            while chain[-1] > 0:
                chain.append(chain[-1] - size(chain[-1]))
            chains.append(chain)
        common = set(chains[0]).intersection(*chains[1:])
        cut = max(common)
        out = []
        k = cut
        while k > 0:
            out.append(last[k - 1])
            k -= size(k)
        needed = set().union(*chains)
        rest = tuple(last[k - 1] if k in needed else -1 for k in range(cut + 1, n + 1))
        new = (last[cut - 1] if cut else before, text[cut:], rest)
        num = self.number.get(new)
        if num is None:
            num = self.number[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = (num, tuple(reversed(out)))
        return move

    def _make_end(self, state: int) -> tuple:
        _, text, last = self.states[state]
        out, k = [], len(text)
        while k > 0:
            out.append(last[k - 1])
            k -= len(self.tokens[last[k - 1]])
        self.ends[state] = end = tuple(reversed(out))
        return end

    def encode_piece(self, piece: bytes) -> tuple:
        if len(self.moves) > MEMO:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            state, emitted = moves.get(state << 8 | byte) or self._make_move(state, byte)
            if emitted:
                out.extend(emitted)
        end = self.ends.get(state)
        out.extend(self._make_end(state) if end is None else end)
        return tuple(out)


class Encoder:
    """Text to ids: pieces by pattern, each through the transducer once."""

    def __init__(self, data: bytes):
        import regex

        self.split = regex.compile(PIECES).findall
        self.fst = Transducer(read_ranks(data))
        self.known: dict[str, tuple] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.fst.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(known) > MEMO:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """One move of the UTF-8 state machine. A state is how many bytes are
    missing and the range of the next; ``None`` is the error state."""
    need, low, high = state
    if need:
        return (need - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


def decode_stream(ids, tokens: dict[int, bytes]):
    """Yields text as tokens arrive, never a part of a character; bytes that
    are no UTF-8 become U+FFFD, one for each longest broken start."""
    state, held = (0, 0, 0), bytearray()
    for i in ids:
        raw = tokens[i]
        if not held and raw.isascii():
            yield raw.decode("ascii")
            continue
        out = []
        for byte in raw:
            nxt = utf8_step(state, byte)
            if nxt is None and held:
                out.append("�")
                held.clear()
                nxt = utf8_step((0, 0, 0), byte)
            if nxt is None:
                out.append("�")
                state = (0, 0, 0)
                continue
            held.append(byte)
            state = nxt
            if not state[0]:
                out.append(held.decode())
                held.clear()
        if out:
            yield "".join(out)
    if held:
        yield "�"


def encoder_of(data: bytes) -> Encoder:
    """One encoder for each worker process and vocabulary, kept over tasks."""
    kept = sys.__dict__.setdefault("_ridgevec_encoders", {})
    key = hash(data)
    if key not in kept:
        kept[key] = Encoder(data)
    return kept[key]


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row; the vocabulary file is read once by the
    driver (under 1 MB, fixed) and travels with the tasks."""
    with open(vocabulary, "rb") as f:
        data = f.read()

    def run(batches):
        enc = encoder_of(data)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` back from ids; a null list gives an empty text."""
    with open(vocabulary, "rb") as f:
        data = f.read()

    def run(batches):
        tokens = encoder_of(data).fst.tokens
        for b in batches:
            texts = ["".join(decode_stream(x or (), tokens)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; equals the stored text."""
    return decoded(encoded(table(spark, sf_dir, "documents")))


ROUNDTRIP_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
