"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type model joins the best-scored adjacent pair until none is left. The same pieces come out of a left-to-right
search: at each position take the longest piece (an Aho-Corasick automaton finds them all in one pass), accept it if
merging it again with the piece before leaves both as they are, else try its next shorter prefix, else step back. A
bitfield of the positions from which nothing fits keeps the search linear.

No merge crosses two neighbouring characters that no piece holds side by side, the start of a word in most models. Texts
are cut there, and the parts encoded one at a time and remembered. Characters without a piece become byte pieces, or the unknown piece in models
without these. Null texts count as empty and give the begin and end ids only; every row gives one row, repeated rows and null ids
too. Very long texts are encoded word by word, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from math import inf
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.llm.text import slices, text_bytes

SPACE = "▁"
#: words of a generation, and piece pairs, that a worker remembers from task to task, in entries
REMEMBERED = 150_000
_LONGEST_REMEMBERED = 64
_LETTERS = "0-9A-Za-z\u00c0-\u024f"
SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def remerge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """The plain definition: join the best-scored adjacent pair, the leftmost of equals, until none is left."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def last_merge(piece: str, scores: dict[str, float]) -> tuple[str, str] | None:
    """The two pieces that merging the characters of `piece` joins last; None for one character."""
    symbols, before = list(piece), None
    while len(symbols) > 1:
        best = max(range(len(symbols) - 1), key=lambda i: (scores.get(symbols[i] + symbols[i + 1], -inf), -i))
        if scores.get(symbols[best] + symbols[best + 1]) is None:
            return None
        before = (symbols[best], symbols[best + 1])
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return before


def compatible(left: str, right: str, ranks: dict[str, int], splits: dict[str, tuple[str, str]]) -> bool:
    """Whether merging the characters of both pieces gives the two pieces again.

    The merges are taken back one at a time, the latest first. At each point the pieces that touch are those that stood
    there then, so merging went across if they make a piece that comes before all merges taken back so far. `ranks`
    orders pieces by score, the best first; `splits` has the last merge of each piece.
    """
    limit = inf
    while True:
        joined = ranks.get(left + right)
        if joined is not None and joined < limit:
            return False
        a, b = ranks.get(left, -1), ranks.get(right, -1)
        # of equal merges the left one comes first, so it is the later to be taken back
        if (a > b and left in splits) or right not in splits:
            if left not in splits:
                return True
            limit, left = a, splits[left][1]
        else:
            limit, right = b + 1, splits[right][0]


def read_model(model: bytes) -> dict:
    """The model's pieces, and what follows from them alone; bounded by the vocabulary."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    if any(sp.is_unused(i) for i in range(n)):
        raise ValueError("models with unused pieces are not supported")
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not special(i)}
    byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    # pieces that merging their own characters does not give can never come out
    splits = {p: pair for p in scores if (pair := last_merge(p, scores))}
    by_score = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
    return {
        "model": model,
        "scores": scores,
        "ranks": {p: by_score[x] for p, x in scores.items()},
        "splits": splits,
        "ids": {p: sp.piece_to_id(p) for p in scores},
        "whole": [p for p in scores if len(p) == 1 or p in splits],
        "bytes": [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None,
        "unknown": sp.unk_id(),
        "ends": [[i] if i >= 0 else [] for i in (sp.bos_id(), sp.eos_id())],
        "words": not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores),
    }


def encoder(tables: dict) -> Callable[[str], bytes]:
    """A function from a normalised text to its ids, as little-endian unsigned 32-bit integers."""
    scores, ids, byte_ids = tables["scores"], tables["ids"], tables["bytes"]
    find = ahocorasick.Automaton()
    for piece in tables["whole"]:
        find.add_word(piece, piece)
    find.make_automaton()
    whole = set(tables["whole"])
    inner = {piece[i : i + 2] for piece in scores for i in range(len(piece) - 1)}
    ranks, splits = tables["ranks"], tables["splits"]
    longest: dict[str, int] = {}
    for piece in whole:
        longest[piece[0]] = max(len(piece), longest.get(piece[0], 1))

    def prefix(text: str, at: int, to: int) -> str | None:
        """The longest piece at `at` that ends by `to`; a single character always counts."""
        for end in range(min(at + longest.get(text[at], 1), to), at, -1):
            if text[at:end] in whole:
                return text[at:end]
        return text[at] if at < to else None

    class Shorter(dict):
        """The longest piece that starts a piece, but for itself."""

        def __missing__(self, piece: str) -> str | None:
            got = self[piece] = prefix(piece, 0, len(piece) - 1)
            return got

    class Fits(dict):
        """Whether a piece may follow the left one."""

        def __init__(self, left: str):
            super().__init__()
            self.left = left

        def __missing__(self, right: str) -> bool:
            got = self[right] = compatible(self.left, right, ranks, splits)
            after.size += 1
            return got

    class After(dict):
        size = 0

        def __missing__(self, left: str) -> Fits:
            if self.size > REMEMBERED:
                self.clear()
                self.size = 0
            got = self[left] = Fits(left)
            return got

    class Anything(dict):
        def __missing__(self, right: str) -> bool:
            return True

    shorter, after, start = Shorter(), After(), Anything()

    def pieces(text: str) -> list[str]:
        if text in whole:
            return [text]
        # the leftmost-longest matches, right as they are if they cover the text and all neighbours fit
        out, at, fits, size = [], 0, start, len(text)
        for end, piece in find.iter_long(text):
            if end + 1 - len(piece) != at or not fits[piece]:
                break
            out.append(piece)
            at = end + 1
            fits = after[piece]
        if at == size:
            return out
        failed = bytearray(size + 1)
        piece = prefix(text, at, size)
        while True:
            while piece:
                to = at + len(piece)
                if not failed[to] and fits[piece]:
                    break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                if to == size:
                    return out
                at, fits = to, after[piece]
                piece = prefix(text, at, size)
            else:
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
                fits = after[out[-1]] if out else start

    as_bytes = {piece: np.array([i], dtype="<u4").tobytes() for piece, i in ids.items()}.__getitem__

    def encoded(text: str) -> bytes:
        found = pieces(text)
        try:
            return b"".join(map(as_bytes, found))
        except KeyError:
            pass  # some character has no piece
        out = []
        for piece in found:
            i = ids.get(piece)
            if i is not None:
                out.append(i)
            elif byte_ids is None:
                # runs of unknown characters are one unknown piece
                if not out or out[-1] != tables["unknown"]:
                    out.append(tables["unknown"])
            else:
                out += [byte_ids[b] for b in piece.encode()]
        return np.array(out, dtype="<u4").tobytes()

    class Words(dict):
        """Two generations: what was not asked for while the younger filled up is forgotten."""

        old: dict[str, bytes] = {}

        def __missing__(self, text: str) -> bytes:
            if len(text) <= _LONGEST_REMEMBERED:
                got = self.old.get(text)
                if got is None:
                    got = encoded(text)
                if len(self) >= REMEMBERED:
                    self.old = dict(self)
                    self.clear()
                self[text] = got
                return got
            cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inner]
            if not cuts:
                return encoded(text)
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, None], strict=True)]
            return b"".join(self[p] if len(p) <= _LONGEST_REMEMBERED else encoded(p) for p in parts)

    word = Words().__getitem__
    # a word ends before a sign that no piece holds after a letter or digit
    letters = re.compile(f"[{_LETTERS}]").match
    held = {pair[1] for pair in inner if letters(pair)}
    signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in held) or SPACE
    in_words = re.compile(f"{SPACE}*[{_LETTERS}]++(?=[{signs}])|{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if not tables["words"] or tables["bytes"] is None:
            return encoded(text)
        return b"".join(map(word, in_words(text)))

    return encode


def _encoding(held, digests: bool):
    """(id, count, ids, decoded text) of the rows of (id, text); a part of a batch at a time."""

    def run(batches):
        tables = held.value
        sp = sentencepiece.SentencePieceProcessor(model_proto=tables["model"])
        encode = tables.get("encode") or tables.setdefault("encode", encoder(tables))
        begin, end = (np.array(x, dtype="<u4").tobytes() for x in tables["ends"])
        for batch in (part for whole in batches for part in slices(whole, 1)):
            counts, encoded, texts = [], [], []
            for text in batch.column(1):
                ids = begin + encode(sp.normalize(text.as_buffer().to_pybytes().decode("utf-8", "replace"))) + end
                counts.append(len(ids) // 4)
                text = sp.decode(np.frombuffer(ids, dtype="<u4").tolist())
                encoded.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string() if digests else pa.binary()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"],
            )

    return run


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """One row per document: id, number of ids with the begin and end ids, the ids, and the text they decode to.

    With `digests` the last two are lower-case hex SHA-256 strings, so that ids and texts need not leave the task.
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(read_model(f.read()))
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return docs.select(F.col(id_col).cast("bigint"), text_bytes(text_col)).mapInArrow(_encoding(held, digests), kind)
