"""The piece table of a SentencePiece model, read as a unigram vocabulary.

Pieces keep their own scores. A text is cut into words (with their space mark) that no piece can cross,
so the lattice of a text is the concatenation of its words' lattices and each distinct word needs to be
solved once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from kinweave.llm.batches import TOOLS

SPACE = "▁"
WORD = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
NORMAL, UNKNOWN, UNUSED, BYTE = 1, 2, 5, 6


@dataclass
class PieceTable:
    ids: dict[str, int]
    scores: list[float]
    texts: list[str]
    byte_ids: list[int]
    unk_score: float
    dummy_prefix: bool
    longest: int

    def normalise(self, text: str | None) -> str:
        """Spaces become the space mark; a leading mark is added as the model says. No other rule is supported."""
        t = (text or "").encode("utf-8", "replace").decode("utf-8").replace(" ", SPACE)
        return SPACE + t if self.dummy_prefix and t else t

    def words(self, text: str | None) -> list[str]:
        """The normalised text in parts that no piece crosses; mostly words with their space mark."""
        t = (text or "").encode("utf-8", "replace").decode("utf-8")
        if not t:
            return []
        if SPACE in t or "  " in t or t[0] == " ":
            return WORD.findall(self.normalise(t))
        out: list[str] = []
        lines = t.split("\n")
        for k, line in enumerate(lines):
            first, *rest = line.split(" ")
            if k or not self.dummy_prefix:
                if k:
                    out.append("\n")
                if first:
                    out.append(first)
            else:
                out.append(SPACE + first)
            if rest:
                out += (SPACE + (" " + SPACE).join(rest)).split(" ")
        return out

    def piece_bytes(self) -> list[bytes]:
        place = {x: bytes([b]) for b, x in enumerate(self.byte_ids)}
        return [place.get(i) or t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]

    def decode(self, ids, parts: list[bytes] | None = None) -> str:
        """Exact inverse of encoding, whatever the segmentation. parts: piece_bytes(), where it is at hand."""
        t = b"".join(map((parts or self.piece_bytes()).__getitem__, ids)).decode("utf-8")
        return t[1:] if self.dummy_prefix and t else t


def load(path: str) -> PieceTable:
    """Read on the driver; tasks get the table itself, so the file needs to be on one machine only."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback:
        raise ValueError("only identity normalisation with byte fallback is supported")
    if any(p.type not in (NORMAL, UNKNOWN, 3, UNUSED, BYTE) for p in m.pieces):
        raise ValueError("user-defined pieces are not supported")
    ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
        raise ValueError("a piece crosses a word border")
    lowest = min(p.score for p in m.pieces if p.type == NORMAL)
    return PieceTable(
        ids, [float(p.score) for p in m.pieces], [p.piece for p in m.pieces],
        [i for i, p in enumerate(m.pieces) if p.type == BYTE],
        float(lowest) - 10.0, m.normalizer_spec.add_dummy_prefix, max(map(len, ids)),
    )


def grouped(texts: list[str | None], chars: int):
    """Slices of about so many characters each, one text at least."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < chars):
            size += len(texts[hi] or "")
            hi += 1
        yield texts[lo:hi]
        lo = hi


def tool(kind: type, table: PieceTable, *args):
    key = (kind.__name__, len(table.texts), hash(tuple(table.scores)), hash(tuple(table.texts)), args)
    if key not in TOOLS:
        TOOLS[key] = kind(table, *args)
    return TOOLS[key]
