"""SentencePiece models run by the tokenizers library.

The model file is read field by field; normaliser, blank marker, pieces with their scores and
byte fallback are rebuilt as a tokenizer of that library. Texts are cut before every blank, as no
piece crosses one; distinct chunks are encoded in multithreaded batches, kept in a bounded cache,
and compared with the original library.
"""

from __future__ import annotations

import array
import re
import sys
import zlib

import numpy as np
from pyspark.sql import DataFrame

from raingrid.llm import frames

BLANK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_CHUNKS = 400_000


def _fields(data: bytes):
    """(number, value) of every field of a protobuf message: int, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says: pieces (text, score, type), kind, options and character map."""

    def __init__(self, data: bytes):
        self.pieces, self.kind, self.byte_fallback = [], UNIGRAM, False
        self.dummy_prefix = self.squeeze_blanks = self.escape_blanks = True
        self.charsmap = b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]
                self.pieces.append((piece.get(1, b"").decode(), float(score), piece.get(3, NORMAL)))
            elif number == 2:
                options = dict(_fields(value))
                self.kind = options.get(3, UNIGRAM)
                self.byte_fallback = bool(options.get(35, 0))
            elif number == 3:
                options = dict(_fields(value))
                self.charsmap = options.get(2, b"")
                self.dummy_prefix = bool(options.get(3, 1))
                self.squeeze_blanks = bool(options.get(4, 1))
                self.escape_blanks = bool(options.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def crosses_blanks(self) -> bool:
        """Whether a piece has a blank after something else, so that chunks may not be cut."""
        return any(BLANK in p.lstrip(BLANK) for p, _, kind in self.pieces if kind == NORMAL)


def build(model: Model):
    """A tokenizer of the tokenizers library that does what the model file says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    scores = [(p, s) for p, s, _ in model.pieces]
    if model.kind == UNIGRAM:
        core = models.Unigram(scores, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, (p, _) in enumerate(scores)}, merges(model),
            unk_token=scores[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_blanks:
        # Only U+0020 is squeezed; at the end of a text the blank marker goes with it.
        end = f"[ {BLANK}]+" if model.escape_blanks else " +"
        steps += [normalizers.Replace(Regex(rf"\A +|{end}\z"), ""),
                  normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", BLANK))
    out.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(BLANK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(parts)
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two, best score first, as merge rules of byte-pair encoding."""
    place = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in place.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in place and right in place:
                found.append((-model.pieces[i][1], i, place[left], place[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def _packed(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian bytes."""
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encode and decode with a model file; keeps a bounded cache of chunks."""

    def __init__(self, data: bytes, verify: bool = True, limit: int = CACHE_CHUNKS):
        self.model = Model(data)
        self.tokenizer = build(self.model)
        self.limit, self.cut = limit, self._can_cut()
        self.known: dict[str, bytes] = {}
        self.differing: set[str] = set()
        # Pieces that decode on their own: ordinary ones, and bytes of ASCII.
        single = {f"<0x{b:02X}>": chr(b) for b in range(128)}
        self.plain = np.array([k == NORMAL or k == BYTE and p in single
                               for p, _, k in self.model.pieces])
        self.shown = np.array([single[p] if k == BYTE and p in single else p.replace(BLANK, " ")
                               for p, _, k in self.model.pieces], object)
        # A unigram model of that library would take the text "<0x41>" for the byte piece of that
        # name; chunks with such text are left to the original library.
        names = [p for p, _, kind in self.model.pieces if kind in (UNKNOWN, CONTROL, BYTE)]
        self.literal = re.compile("|".join(map(re.escape, names))) \
            if self.model.kind == UNIGRAM and names else None
        self.original = None
        if verify or self.literal:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _can_cut(self) -> bool:
        m = self.model
        # A chunk is a word with the blank before it; cutting needs the blank to be put there by
        # the normaliser alone, and no piece to cross one. Texts with other blanks go whole.
        return m.dummy_prefix and m.escape_blanks and not m.charsmap and not m.crosses_blanks()

    def chunks_of(self, text: str) -> list[str] | None:
        if not self.cut or not text or text[0] == " " or text[-1] == " " or "  " in text:
            return None
        if self.model.squeeze_blanks and BLANK in text:
            return None
        return text.split(" ")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.literal:
            got = [self.original.encode(t) if self.literal.search(t) else g
                   for t, g in zip(texts, got)]
        return got

    def _learn(self, missing: list[str]) -> None:
        if len(self.known) + len(missing) > self.limit:
            self.known.clear()
        got = self._whole(missing)
        self.known.update(zip(missing, map(_packed, got)))
        if self.original:
            should = self.original.encode(missing, num_threads=1)
            self.differing.update(c for c, g, s in zip(missing, got, should) if g != s)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids (4 bytes each, little-endian) of every text, and whether the original agrees."""
        cut = [self.chunks_of(t) for t in texts]
        whole = [t for t, c in zip(texts, cut) if c is None]
        wanted = {x for c in cut if c for x in c}
        missing = sorted(wanted - self.known.keys())
        if missing:
            if len(self.known) + len(missing) > self.limit:
                missing = sorted(wanted)
            self._learn(missing)
        rest = iter(zip(
            self._whole(whole),
            self.original.encode(whole, num_threads=1) if self.original else [None] * len(whole)))
        out = []
        for c in cut:
            if c is None:
                got, should = next(rest)
                out.append((_packed(got), should is None or got == should))
            else:
                same = not self.differing or self.differing.isdisjoint(c)
                out.append((b"".join(map(self.known.__getitem__, c)), same))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of packed ids; what the normaliser changed stays changed."""
        out: list[str | None] = []
        rest = []
        for packed in ids:
            numbers = np.frombuffer(packed, "<u4")
            if self.plain[numbers].all():  # pieces that stand for themselves are only joined
                text = "".join(self.shown[numbers])
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            else:
                out.append(None)
                rest.append(numbers.tolist())
        slow = iter(self.tokenizer.decode_batch(rest, skip_special_tokens=False))
        return [next(slow) if x is None else x for x in out]


_codecs: dict[bytes, Codec] = {}


def codec(data: bytes) -> Codec:
    """The worker's codec of a model, made once per process."""
    if data not in _codecs:
        _codecs[data] = Codec(data)
    return _codecs[data]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little-endian) and parity of every row.

    parity: every chunk of the text gives the ids of the original library. A null or empty text
    has no ids. Repeated rows are encoded again; a null doc_id stays null; an empty table gives
    no rows; other columns of ``docs`` are ignored. The model file is read where this is called.
    """
    with open(path or default_path(), "rb") as f:
        data = f.read()
    model = docs.sparkSession.sparkContext.broadcast(data)  # the model file, about half a MB

    def run(cols):
        got = codec(model.value).encode([t or "" for t in cols["text"]])
        return {"doc_id": cols["doc_id"], "ids": [g[0] for g in got], "parity": [g[1] for g in got]}

    return frames.map_slices(docs.select("doc_id", "text"), run,
                             "doc_id long, ids binary, parity boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded rows; null ids give null."""
    with open(path or default_path(), "rb") as f:
        data = f.read()
    model = encoded.sparkSession.sparkContext.broadcast(data)

    def run(cols):
        texts = codec(model.value).decode([x or b"" for x in cols["ids"]])
        return {"doc_id": cols["doc_id"],
                "text": [None if x is None else t for x, t in zip(cols["ids"], texts)]}

    return frames.map_slices(encoded.select("doc_id", "ids"), run, "doc_id long, text string",
                             text="ids")


def op2_piece_codec(spark, sf: str) -> DataFrame:
    """All documents encoded and decoded again.

    round_trip: the decoded text is the text, but for the blank marker, which the format itself
    cannot tell from a blank.
    """
    docs = frames.documents(spark, sf)
    with open(default_path(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(cols):
        own = codec(model.value)
        texts = [t or "" for t in cols["text"]]
        got = own.encode(texts)
        back = own.decode([ids for ids, _ in got])
        return {
            "doc_id": cols["doc_id"], "n_ids": [len(ids) // 4 for ids, _ in got],
            "ids_crc32": [zlib.crc32(ids) for ids, _ in got], "parity": [same for _, same in got],
            "round_trip": [b == t.replace(BLANK, " ") for b, t in zip(back, texts)],
        }

    return frames.map_slices(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean")
