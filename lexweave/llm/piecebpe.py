"""Encoding and decoding with a BPE-type SentencePiece model by a merge-type prefix table.

For every prefix of a text exactly one token can be the last of the prefix's encoding.  An automaton gives all
tokens that end at a position; the right one is the one that starts at 0, or whose start has a last token with
which it is compatible, that is, the two stay two when merged alone.  The table of last tokens is filled once
from left to right and the ids are then read backwards.

No token crosses a pair of characters that stand side by side in no vocabulary piece, so a text is cut there
first, and the results of short cuts are kept in a bounded memo.

Defined cases: null is the empty text; the empty text is the begin and end ids alone and decodes to the empty
text; characters outside the vocabulary become byte pieces; repeated rows and ties do not matter, each row is
encoded for itself; extra columns are not read.
"""

from __future__ import annotations

import re
from array import array
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import _Memo
from .common import arrow_map, documents

MARK = "▁"
_CUT = re.compile(rf"(?<!{MARK})(?={MARK})")
#: Pairs of tokens whose compatibility is kept.
PAIRS = 600_000

_codecs: dict[str, "PieceBpe"] = {}


def codec(path: str | None = None) -> "PieceBpe":
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _codecs:
        _codecs[path] = PieceBpe(path)
    return _codecs[path]


class PieceBpe:
    """encode(text) gives ids with begin and end ids as little-endian 32-bit integers in bytes; decode(ids) the text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: model.get_score(i) for i in normal}
        self.byte_ids = [0] * 256
        self.bytes_of = [self.pieces[i].replace(MARK, " ").encode() for i in range(n)]
        for i in range(n):
            if model.is_byte(i):
                value = int(self.pieces[i][3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif model.is_control(i):
                self.bytes_of[i] = b""
            elif model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        self.side_by_side = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.compatible: dict[int, bool] = {}  # by left << 32 | right
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.words = _Memo(self._word)
        self.cuts = _Memo(self._prefix_table)

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose joint piece scores highest, the leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=(0, 1))
            if at == 1:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        a, b = self.pieces[left], self.pieces[right]
        known = self.merged(a + b) == [a, b]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[left << 32 | right] = known
        return known

    def _prefix_table(self, text: str) -> bytes:
        """Ids of a cut by the last token of each of its prefixes; a character outside the vocabulary stands alone in its cut."""
        if text in self.ids and len(text) == 1:
            return array("I", [self.ids[text]]).tobytes()
        if len(text) == 1:
            return array("I", [self.byte_ids[b] for b in text.encode()]).tobytes()
        last = [0] * len(text)  # of the prefix that ends at this character
        size = [0] * len(text)  # of that token; 0: not found yet
        kept = self.compatible.get
        for end, (length, token) in self.automaton.iter(text):
            if size[end]:
                continue
            start = end - length
            if start >= 0:
                if not size[start]:
                    continue
                fits = kept(last[start] << 32 | token)
                if fits is None:
                    fits = self.fits(last[start], token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return array("I", out[::-1]).tobytes()

    def _word(self, text: str) -> bytes:
        if len(text) > 1:
            together = self.side_by_side
            if cuts := [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in together]:
                return b"".join(self.cuts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))
        return self._prefix_table(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return array("I", [self.begin, self.end]).tobytes()
        if "  " in text or MARK in text or text[0] == " ":
            words = _CUT.split(MARK + text.replace(" ", MARK))
        else:
            words = (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return array("I", [self.begin]).tobytes() + b"".join(map(self.words.__getitem__, words)) + array("I", [self.end]).tobytes()

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        return out.removeprefix(b" ").decode("utf-8", "replace")


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the text that the ids decode to."""

    def make():
        c = codec(model)

        def batch(rows: dict) -> dict:
            ids = [c.encode(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "ids": ids, "decoded": [c.decode(i) for i in ids]}

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, SCHEMA)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text; sha2 and length run in the JVM."""
    coded = encode_decode(documents(spark, sf_dir))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
