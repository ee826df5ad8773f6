"""Operator 10: exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import keyed, map_arrow, own_id

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches of at most LONG characters that a worker keeps, twice over: about 75 MB.
CACHED = 150_000
LONG = 64
#: Pairs of tokens whose compatibility a worker keeps: about 40 MB.
MOST_PAIRS = 300_000

_LOADED: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder of one model: identity normalisation, byte fallback, a space before the text."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("a BPE model with byte fallback and no user-defined or unused pieces is asked for")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a model with identity normalisation and a dummy prefix is asked for")
        pieces = list(proto.pieces)
        self.piece_id = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.bos, self.eos = (next(i for i, p in enumerate(pieces) if p.piece == s) for s in ("<s>", "</s>"))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.piece_id.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.text = {i: p.piece for i, p in enumerate(pieces) if p.type == NORMAL}
        self.byte = {i: b for b, i in self.byte_id.items()}
        # a piece that joins two characters somewhere; text can be cut wherever none does
        joined = {piece[k : k + 2] for piece in self.piece_id for k in range(len(piece) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in joined):
            raise ValueError("a model whose pieces have a space at the start only is asked for")
        self.joined = joined
        alone = "".join(c for c in map(chr, range(128)) if not any(c in pair for pair in joined))
        self.cut = re.compile(f"[{re.escape(alone)}]|{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+")
        self.chars = frozenset(piece for piece in self.piece_id if len(piece) == 1)
        self.size = [len(self.text.get(i, "")) for i in range(len(pieces))]
        self.shorter = [-1] * len(pieces)  # the longest piece that a piece begins with
        for piece, i in self.piece_id.items():
            self.shorter[i] = next((self.piece_id[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.piece_id), -1)
        raw = [self._bytes_of(i) for i in range(len(pieces))]
        self._piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._piece_sizes = np.array([len(r) for r in raw], np.int64)
        self._piece_starts = np.cumsum(self._piece_sizes) - self._piece_sizes
        self._begin, self._end = pack("<I", self.bos), pack("<I", self.eos)
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _bytes_of(self, token: int) -> bytes:
        if token in self.byte:
            return bytes([self.byte[token]])
        return self.text[token].replace(SPACE, " ").encode() if token in self.text else b""

    # --- one stretch of text

    def _merge(self, text: str) -> list[str]:
        """The stretch merged from its characters: best score first, of equal ones the leftmost. For short texts."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging both tokens' characters anew gives the two tokens back."""
        a, b = self.text[left], self.text[right]
        known = a[-1] + b[0] not in self.joined and self._own(left) and self._own(right) or self._merge(a + b) == [a, b]
        if len(self._fits) > MOST_PAIRS:
            self._fits.clear()
        self._fits[left << 32 | right] = known
        return known

    def _own(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self._merge(self.text[token]) == [self.text[token]]
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Tokens of characters that are all pieces: longest first, giving way where neighbours would merge otherwise.

        A bit for each position is cleared once no encoding of the text up to it can go on from there.
        """
        n = len(text)
        longest = [0] * n
        for end, (size, token) in self.automaton.iter(text):
            longest[end - size + 1] = token  # matches come by their ends, so the longest comes last
        open_at = bytearray(b"\1") * (n + 1)
        fits, size_of, shorter = self._fits, self.size, self.shorter
        tokens: list[int] = []
        pos, last, token = 0, -1, longest[0]
        while pos < n:
            while token >= 0:
                if open_at[pos + size_of[token]]:
                    if last < 0:
                        good = self._own(token)
                    else:
                        good = fits.get(last << 32 | token)
                        if good is None:
                            good = self._compatible(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                pos += size_of[token]
                last = token
                if pos < n:
                    token = longest[pos]
            else:
                open_at[pos] = 0
                if last < 0:
                    raise ValueError("no encoding")
                token = tokens.pop()
                pos -= size_of[token]
                last = tokens[-1] if tokens else -1
                token = shorter[token]
        return tokens

    def _stretch(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a stretch that nothing merges with."""
        if self.chars.issuperset(text):
            ids = self._backtrack(text)
        else:
            ids = []
            for known, part in groupby(text, self.chars.__contains__):
                ids += self._backtrack("".join(part)) if known else [self.byte_id[b] for b in "".join(part).encode()]
        return pack(f"<{len(ids)}I", *ids)

    # --- whole texts

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text with begin and end ids, as little-endian 32-bit integers."""
        out = [self._begin]
        if text:
            for part in self.cut.findall(SPACE + text.replace(" ", SPACE)):
                ids = self._known.get(part)
                if ids is None:
                    ids = self._older.pop(part, None) or self._stretch(part)
                    if len(part) <= LONG:
                        if len(self._known) >= CACHED:
                            self._known, self._older = {}, self._known
                        self._known[part] = ids
                out.append(ids)
        out.append(self._end)
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of ids whose byte tokens form whole characters, as those of an encoding do."""
        sizes = self._piece_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self._piece_starts[ids] - ends + sizes, sizes)
        out = self._piece_bytes[at].tobytes()
        return out[1:] if out[:1] == b" " else out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control tokens vanish, bytes that are not UTF-8 become U+FFFD, the first space goes."""
        out: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            if held:
                out.append(_shown(bytes(held)))
                held.clear()
            if i in self.text:
                piece = self.text[i]
                if not out and piece.startswith(SPACE):
                    piece = piece[1:]
                    if not piece:
                        out.append("")
                        continue
                out.append(piece.replace(SPACE, " "))
        return "".join(out)


def _shown(raw: bytes) -> str:
    """Bytes as text; each byte that no UTF-8 character holds becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in range(4, 0, -1):
            try:
                text = raw[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if len(text) == 1:
                out.append(text)
                at += len(raw[at : at + n])
                break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(path: str) -> PieceCodec:
    """The codec of a model file, which is at the same path on every machine, kept for each Python worker."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = PieceCodec(f.read())
    return _LOADED[path]


def _rows(batches: Iterator[pa.RecordBatch], path: str, outputs: bool) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        n, ids_sha, text_sha, ids, shown = [], [], [], [], []
        for text in batch.column("text"):
            a = own.encode_bytes(text.as_py() or "")
            b = own.decode_bytes(np.frombuffer(a, "<u4"))
            n.append(len(a) // 4)
            ids_sha.append(hashlib.sha256(a).hexdigest())
            text_sha.append(hashlib.sha256(b).hexdigest())
            if outputs:
                ids.append(np.frombuffer(a, "<u4").astype(np.int32))
                shown.append(b.decode())
        if not outputs:
            ids = shown = [None] * len(n)
        columns = [batch.column("k_id"), batch.column("k_tag"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(shown, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["k_id", "k_tag", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded, k_id, k_tag.

    ids and decoded are null unless ``outputs``. The ids are those of the sentencepiece library with begin and
    end ids and no sampling. Text is cut where no piece joins the two characters, and each stretch is encoded
    by itself: the longest match of an Aho-Corasick automaton is taken at each position if re-merging it with
    the token before gives both back, else a shorter one; positions from which none goes on are marked and not
    tried again. Stretches that recur are looked up. Characters without a piece become their bytes.

    A null or empty text has the begin and end ids alone, and decodes to the empty text. Rows that repeat get
    rows of their own. An empty table gives no rows. Other columns are ignored. A row is encoded in one task,
    in memory proportional to its text.
    """
    schema = "k_id long, k_tag long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    out = map_arrow(keyed(docs, id_col, text_col), lambda b: _rows(b, model_path, outputs), schema)
    return out.select(own_id().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded", "k_id", "k_tag")
