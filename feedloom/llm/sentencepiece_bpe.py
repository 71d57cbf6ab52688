"""SentencePiece merge-type (BPE) encoding and decoding, exact, without the library.

A merge-type tokenisation is the only sequence of vocabulary pieces in which every
two neighbours are *compatible*: merging their joined text again gives the same two
pieces back.  So a text is encoded from left to right: at each position the longest
piece found by an Aho-Corasick automaton is tried, then its shorter prefixes; a piece
is kept if it is compatible with the one before it; where none is, the last piece is
taken back and the position is marked in a bitfield so that it is never tried again.
The work is linear in the text.

White space (U+2581 after normalisation) only ever starts a piece, so a text is split
before each word and every distinct word is encoded once per worker.  Runs of white
space are pieces of their own with the lowest score; they merge last, from the left.

Decoding reads nothing but ids: each stands for some bytes in one table, and the text of many
rows is gathered from it at once.  Ids of single bytes are joined; what they spell that is no
UTF-8 becomes U+FFFD, one a byte, and the white space in front of a text goes, both as the library
has it.

Results: a null text counts as empty and gives the end id alone; very long words cost
linear time; repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, release, small_batches

by_value(__name__)

SPACE = "▁"
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


def packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Kept(dict):
    """What `make` gives for each key, in two generations of bounded size: what is asked for again stays."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:  # long ones are rare and would fill the memory
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class PieceModel:
    """The pieces of a BPE model file and the backtracking encoder over them."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model with identity normalisation is needed")
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.text_of: list[str | int] = []
        self.end = 2
        led = []
        for i, p in enumerate(proto.pieces):
            self.text_of.append("")
            led.append(p.piece.startswith(SPACE))
            if p.type in (NORMAL, USER, UNUSED):
                self.ids[p.piece], self.score[p.piece], self.text_of[i] = i, p.score, p.piece
            elif p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.text_of[i] = int(p.piece[3:5], 16)
            elif p.piece == proto.trainer_spec.eos_piece:
                self.end = i
            elif p.type == UNKNOWN:
                self.text_of[i] = proto.trainer_spec.unk_surface
        # for decoding: the bytes of every id, one after the other
        spelt = [bytes([t]) if isinstance(t, int) else t.replace(SPACE, " ").encode() for t in self.text_of]
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.size_of = np.array([len(b) for b in spelt], np.int32)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.led = np.array(led)
        #: Ids of single bytes, and those of no text; what stands between bytes parts them.
        self.is_byte, self.is_empty = np.array([isinstance(t, int) for t in self.text_of]), self.size_of == 0
        self.run = max(len(p) for p in self.ids if not p.strip(SPACE))
        self.rest = [tuple(self.ids[p] for p in self._merge(SPACE * n)) for n in range(self.run)]
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("white space inside a piece")
        self.known = {p for p in self.ids if len(p) == 1}
        words = [p for p in self.ids if p.strip(SPACE) or len(p) == 1]
        longer = [self.score[p] for p in words if len(p) > 1]
        if len(set(longer)) != len(longer) or not set().union(*map(set, words)) <= self.known:
            raise ValueError("scores must differ and characters must be pieces")
        self.whole = {p for p in words if self._merge(p) == [p]}
        self.auto = ahocorasick.Automaton()
        for p in self.whole:
            if len(p) > 1:
                self.auto.add_word(p, (len(p) - 1, p))
        self.auto.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        #: Neighbouring characters that some piece holds; between others nothing ever merges.
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.raw = {p: packed([i]) for p, i in self.ids.items()}
        self.words = Kept(self.encode_word)
        self.atoms = Kept(self.encode_atom, 50_000)

    def _merge(self, text: str) -> list[str]:
        """Merge from single characters: the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _prefix(self, piece: str) -> str | None:
        """The longest shorter piece that `piece` starts with."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.whole), None)
        return self.shorter[piece]

    def _fit(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            ok = self.fits[key] = a + b not in self.ids and self._merge(a + b) == [a, b]
        return ok

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text of known characters, with no white space but at its start."""
        if text in self.whole:
            return [text]
        longest = list(text)  # every character is a piece
        for end, (back, piece) in self.auto.iter(text):
            longest[end - back] = piece  # a later end is a longer piece
        open_at = bytearray(b"\xff") * (len(text) // 8 + 1)
        out: list[str] = []
        size, fits, shorter = len(text), self.fits, self.shorter
        pos, nxt, last = 0, longest[0], None
        while pos < size:
            piece = nxt
            while True:
                end = pos + len(piece)
                if open_at[end >> 3] >> (end & 7) & 1:
                    ok = last is None or fits.get((last, piece))
                    if ok is None:
                        ok = self._fit(last, piece)
                    if ok:
                        out.append(piece)
                        pos, last = end, piece
                        nxt = longest[pos] if pos < size else ""
                        break
                short = shorter.get(piece, "")
                if short == "":
                    short = self._prefix(piece)
                if short is None:
                    if last is None:
                        raise AssertionError("no tokenisation")
                    open_at[pos >> 3] &= ~(1 << (pos & 7)) & 0xFF
                    nxt = out.pop()
                    pos -= len(nxt)
                    last = out[-1] if out else None
                    break
                piece = short
        return out

    def encode_atom(self, text: str) -> bytes:
        """Ids, as 32-bit integers, of a text without inner breaks."""
        if text[0] in self.known:
            return b"".join([self.raw[p] for p in self._pieces(text)])
        return packed([self.byte_id[b] for b in text.encode("utf-8", "surrogatepass")])

    def encode_word(self, word: str) -> bytes:
        """The same of white space followed by `word`, which is broken where nothing merges."""
        text, inner = SPACE + word, self.inner
        if word.isalpha() and self.known.issuperset(word):  # as well whole, and nearly all letters do merge
            return self.encode_atom(text)
        if word[:-1].isalpha() and self.known.issuperset(word) and text[-2:] not in inner:  # a mark behind a word
            return self.words[word[:-1]] + self.atoms[word[-1]]
        return self._broken(text)

    def forget(self) -> None:
        for kept in (self.words, self.atoms):
            kept.clear()
            kept.old = {}

    def spaces(self, n: int) -> bytes:
        full, rest = divmod(n, self.run)
        return packed((self.ids[SPACE * self.run],) * full + self.rest[rest])

    def encode(self, text: str) -> bytes:
        """Ids, as 32-bit integers without the end id."""
        if not text:
            return b""
        if "\n" in text and "\n" not in self.known:  # nothing merges across a line's end
            first, *lines = text.split("\n")
            return self.atoms["\n"].join([self._line(first, True), *[self._line(x, False) for x in lines]])
        return self._line(text, True)

    def _line(self, text: str, led: bool) -> bytes:
        """Ids of a line; the first one has white space put in front."""
        parts = text.replace(" ", SPACE).split(SPACE)
        head = b""
        if not led:  # what comes before the line's first white space
            start = parts.pop(0)
            if start:
                head = self.atoms[start] if start.isalpha() and self.known.issuperset(start) else self._broken(start)
            if not parts:
                return head
        if "" not in parts:
            return head + b"".join(map(self.words.__getitem__, parts))
        groups, run, lone = [head], 0, packed([self.ids[SPACE]])
        for p in parts:
            if p:
                ids = self.words[p]
                if run and ids.startswith(lone):
                    groups.append(self.spaces(run + 1) + ids[4:])
                else:
                    groups.append(self.spaces(run) + ids)
                run = 0
            else:
                run += 1
        if run:
            groups.append(self.spaces(run))
        return b"".join(groups)

    def _broken(self, text: str) -> bytes:
        """A text broken where nothing merges."""
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inner]
        return b"".join([self.atoms[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of rows of ids; a row's ids end before ends[i], where the next one's begin."""
        size = self.size_of[ids]
        to = np.cumsum(size, dtype=np.int64)
        total = int(to[-1]) if len(to) else 0
        pick = np.repeat(self.start_of[ids] - (to - size), size)
        pick += np.arange(total)
        raw = self.flat[pick]
        before = np.concatenate(([0], to))
        stop = before[ends]
        start = np.concatenate(([0], stop[:-1]))
        # the white space before a row's first piece goes
        first = np.searchsorted(to, start, "right")
        some = np.flatnonzero(stop > start)
        lead = start[some[self.led[ids[first[some]]]]]
        if len(lead):
            raw = np.delete(raw, lead)
        gone = np.zeros(len(stop) + 1, np.int64)
        gone[1:] = np.searchsorted(lead, stop, "left")
        at = np.concatenate(([0], stop)) - gone
        texts = pa.StringArray.from_buffers(len(ends), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
        spelt = self.is_byte[ids]
        if not spelt.any():
            return texts
        # rows with single bytes: sound if they are UTF-8 and nothing but text stands among them
        row = np.searchsorted(ends, np.flatnonzero(spelt), "right")
        wrong = {}
        for i in np.unique(row).tolist():
            own = ids[(ends[i - 1] if i else 0) : ends[i]]
            try:
                raw[at[i] : at[i + 1]].tobytes().decode("utf-8")
                if not self.is_empty[own[:-1]].any():
                    continue
            except UnicodeDecodeError:
                pass
            wrong[i] = self.decode(own.tolist())
        return pa.array([wrong[i] if i in wrong else texts[i].as_py() for i in range(len(texts))], pa.string()) if wrong else texts

    def decode(self, ids) -> str:
        """The text of some ids, one by one."""
        out: list[str] = []
        raw = bytearray()
        for i in (*ids, -1):
            t = self.text_of[i] if i >= 0 else ""
            if isinstance(t, int):
                raw.append(t)
                continue
            if raw:
                out.append(loose(bytes(raw)))
                raw.clear()
            if t:
                said = t.replace(SPACE, " ")
                out.append(said[1:] if not out and self.led[i] else said)
        return "".join(out)


def loose(raw: bytes) -> str:
    """Bytes as UTF-8, with U+FFFD for each byte that belongs to no character."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            out.append(raw[i : i + n].decode("utf-8"))
            i += n
        except UnicodeDecodeError:
            out.append("\ufffd")
            i += 1
    return "".join(out)


def _loaded(path: str) -> PieceModel:
    """One model per worker process, whichever task asks for it."""
    kept = sys.__dict__.setdefault("_feedloom_pieces", {})
    if path not in kept:
        kept[path] = PieceModel(path)
    return kept[path]


#: Ids that are decoded at once.
PART = 400_000


def tokenized(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", rows: int = 500) -> DataFrame:
    """Add `ids` (array<int>, ended by the end id) and `decoded` (string; decoded from them) to every row of `docs`.

    model_path: a model file that every executor has, as installed tokenizers are.
    rows: rows handled at once, which with PART bounds a worker's memory.  An existing column of
    either name is replaced.  An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    src = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    names = [f.name for f in kept]

    def work(model, batches):
        end = packed([model.end])

        def answer(batch, flat, ends):
            values = np.frombuffer(b"".join(flat), np.int32)
            got = pa.ListArray.from_arrays(pa.array(np.array([0, *ends], np.int32)), pa.array(values))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], got, model.decode_rows(values, np.array(ends, np.int64))], names=[*names, ids, decoded])

        for batch in batches:
            flat, ends, start, n = [], [], 0, 0
            for i in range(batch.num_rows):
                got = model.encode(batch.column(len(names))[i].as_py())
                flat += (got, end)
                n += len(got) // 4 + 1
                ends.append(n)
                if n > PART or len(ends) == rows:
                    yield answer(batch.slice(start, len(ends)), flat, ends)
                    flat, ends, start, n = [], [], i + 1, 0
            if ends:
                yield answer(batch.slice(start), flat, ends)

    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return src.mapInArrow(_with_model(model_path, work), schema)


def decoded_ids(rows: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add `decoded`, the text of `ids` (array<int>; null: empty, and null ids in it have no text), to every row."""
    small_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != decoded]
    none = F.array().cast("array<int>")
    src = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.filter(F.col(f"`{ids}`"), lambda i: i.isNotNull()), none).alias("__ids"))

    def work(model, batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                lists = batch.column(len(kept))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], model.decode_rows(flat, ends)], names=[*(f.name for f in kept), decoded])

    schema = T.StructType([*kept, T.StructField(decoded, T.StringType())])
    return src.mapInArrow(_with_model(model_path, work), schema)


def _with_model(path: str, work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(path)
        try:
            yield from work(model, batches)
        finally:  # a worker outlives its task; its next one may be of another stage
            model.forget()
            release()

    return run
