"""The vocabulary of a SentencePiece BPE model, and where its texts come apart."""

from __future__ import annotations

import re

SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Pieces with their identifiers and scores, byte identifiers, and the runs in which texts are segmented.

    No piece holds a space mark after another character, so nothing joins a
    word to the space after it, and runs of spaces with the word behind them
    are segmented alone; a line feed that no piece holds is a run of its own.
    """

    def __init__(self, model_bytes: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(model_bytes)
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.name != "identity" or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are can be used here")
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix: bool = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = [-1] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.n = len(model.pieces)
        self.longest = max(map(len, self.ids), default=0)
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        feed = "" if any("\n" in p for p in self.ids) else "\n"
        self._runs = re.compile(f"{feed}| *[^ {feed}]+| +" if feed else " *[^ ]+| +")

    def runs(self, text: str, marks_are_spaces: bool = True) -> list[str]:
        """The text's runs; spaces are not yet marked.

        The library takes a space mark in a text for a space; without
        ``marks_are_spaces`` it stays the character that it is.
        """
        if not text:
            return []
        text = " " + text if self.prefix else text
        if marks_are_spaces:
            text = text.replace(SPACE, " ")
        return self._runs.findall(text) if self.apart else [text]

    def byte_table(self) -> list[bytes]:
        """What each identifier decodes to."""
        out = [b""] * self.n
        for p, i in self.ids.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                out[i] = bytes([b])
        return out


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]
