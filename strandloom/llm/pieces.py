"""Operator 10: SentencePiece models on the ``tokenizers`` library.

The model's protobuf is parsed for its pieces, scores, types and normaliser
rules, from which a tokenizer is rebuilt: normaliser, the metaspace marker,
byte fallback, and a Unigram model with the pieces' scores or, where the
protobuf says that the model is byte-pair, a BPE model whose merges are
ordered by the scores (unigram scores give wrong ids for such a model).

Where no piece holds the marker after another character, no piece crosses the
beginning of a marked word, so a text is encoded word by word. New words of a
batch are encoded together by the library's threads and kept; each is also
encoded by the sentencepiece library, and a document's ``parity`` says whether
all its words agreed. Texts that can't go word by word are encoded whole by
both. Decoding turns pieces back into text and bytes.

Null and empty texts have no ids and decode to the empty text. Normalisers
with a compiled character map are rebuilt from that map. Repeated rows are
encoded each; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import tune

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
OUT = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean"
_WORDS = re.compile(" *[^ ]+| +")


def _fields(data: bytes):
    """(number, wire value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """pieces [(text, score, type)], model_type, unk_id, and the normaliser's rules of a model file.

    Field numbers are fixed values of the public model format.
    """
    out = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    for field, value in _fields(data):
        if field == 1:
            p = dict(_fields(value))
            out["pieces"].append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
        elif field == 2:
            t = dict(_fields(value))
            out |= {"model_type": t.get(3, UNIGRAM), "byte_fallback": bool(t.get(35, 0)), "unk_id": t.get(40, 0)}
        elif field == 3:
            n = dict(_fields(value))
            out |= {"charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)), "squeeze": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
    return out


def rebuild(plan: dict):
    """A ``tokenizers.Tokenizer`` of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = plan["pieces"]
    if plan["model_type"] == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=plan["unk_id"], byte_fallback=plan["byte_fallback"])
    elif plan["model_type"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        score = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        merges = sorted(((-score[p], len(p[:i]), p[:i], p[i:]) for p in score for i in range(1, len(p)) if p[:i] in score and p[i:] in score))
        model = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=pieces[plan["unk_id"]][0], fuse_unk=True, byte_fallback=plan["byte_fallback"])
    else:
        raise ValueError("word and character models aren't rebuilt")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(plan["charsmap"])] if plan["charsmap"] else []
    if plan["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if plan["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if plan["escape"] else " "))
    if plan["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    user = [AddedToken(p, normalized=True, special=False) for p, _, k in pieces if k == USER]
    if user:
        t.add_tokens(user)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Pieces:
    """Encoding and decoding by one model file."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as f:
            self.plan = parse_model(f.read())
        self.tokenizer = rebuild(self.plan)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = self.plan["pieces"]
        crossing = any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        user = any(k == USER for _, _, k in pieces)
        self.by_word = not (crossing or user or self.plan["squeeze"] or self.plan["charsmap"]) and self.plan["dummy_prefix"] and self.plan["escape"]
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.kept: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.most = most

    def _both(self, texts: list[str]):
        """(ids, whether both libraries agree) of each text."""
        mine = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [(array("I", a).tobytes(), a == b) for a, b in zip(mine, self.other.encode(texts, num_threads=1))]

    def _learn(self, words: set[str]) -> None:
        if len(self.kept) + len(words) > self.most:
            self.kept.clear()
            self.wrong.clear()
        #: A word's first space is the one that the model puts before every text.
        new = [w for w in words if w not in self.kept]
        for w, (ids, same) in zip(new, self._both([w[1:] for w in new])):
            self.kept[w] = ids
            if not same:
                self.wrong.add(w)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool]]:
        """(little-endian unsigned 32-bit ids, parity) of each text."""
        if not self.by_word:
            return [(b"", True) if not t else self._both([t])[0] for t in texts]
        split = []
        for t in texts:
            if not t:
                split.append(None)
            elif MARK in t or "\0" in t or (t[-1] == " " and t[-2:-1] != " "):  # one last space isn't the model's own
                split.append(t)
            elif "  " in t or t[0] == " " or t[-1] == " ":
                split.append(_WORDS.findall(" " + t))
            else:
                split.append((" " + t).replace(" ", "\0 ").split("\0")[1:])
        out: list[tuple[bytes, bool]] = []
        words = [s for s in split if isinstance(s, list)]
        self._learn({w for s in words for w in s if w not in self.kept})
        for s in split:
            if s is None:
                out.append((b"", True))
            elif isinstance(s, str):
                out.append(self._both([s])[0])
            else:
                try:
                    ids = b"".join(map(self.kept.__getitem__, s))
                except KeyError:  # emptied meanwhile
                    self._learn(set(s))
                    ids = b"".join(map(self.kept.__getitem__, s))
                out.append((ids, not self.wrong or self.wrong.isdisjoint(s)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of some ids: pieces and bytes joined, without the space put before the text."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.plan["dummy_prefix"] and text.startswith(" ") else text


_KEPT: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model per file and Python worker."""
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def _encode(batches, path):
    p = pieces(path)
    for b in batches:
        got = p.encode(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(i, "<u4") for i, _ in got], pa.list_(pa.int64())), pa.array([s for _, s in got], pa.bool_())], names=["doc_id", "ids", "parity"])


def _decode(batches, path):
    p = pieces(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else p.decode(np.array(i, "<u4").tobytes()) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def _digest(batches, path):
    p = pieces(path)
    for b in batches:
        texts = b.column(1).to_pylist()
        got = p.encode(texts)
        cols = [b.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([zlib.crc32(i) for i, _ in got], pa.int64()), pa.array([s for _, s in got], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([p.decode(i) == (t or "") for (i, _), t in zip(got, texts)], pa.bool_())], names=[x.split()[0] for x in OUT.split(", ")])


def _two(docs: DataFrame, id_col: str, value_col: str, kind: str) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).cast(kind).alias("value"))


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, parity of every row."""
    return _two(docs, id_col, text_col, "string").mapInArrow(partial(_encode, path=model), "doc_id long, ids array<long>, parity boolean")


def decode(encoded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row; null ids give a null text."""
    return _two(encoded, id_col, ids_col, "array<long>").mapInArrow(partial(_decode, path=model), "doc_id long, text string")


def digest(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, parity, round_trip of every row: its ids, and whether they decode to the text."""
    return _two(docs, id_col, text_col, "string").mapInArrow(partial(_digest, path=model), OUT)
