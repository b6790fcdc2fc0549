"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Texts are marked (blank -> U+2581, one in front) and cut into words where no piece of the vocabulary reaches across. The
distinct words of a batch are sorted, which makes them a trie in depth-first order: the forward state of the prefix that
a word shares with the one before it is kept, and only the rest is computed.

Forward state: for each prefix its best score, last piece and its length. For a unigram model every piece is an arc and
the best sum of scores wins. The public model here is a BPE model, whose result is not the best-scoring path; there, an
arc from the last piece p to piece t is admissible only if the merges leave the text p + t as exactly [p, t]. The merges'
result of a prefix is then the only admissible path to it, so the same forward pass gives the exact ids of the library.

Characters in no piece stand alone and become byte pieces. Defined results: null text counts as empty and has no ids;
U+2581 in a text is decoded as a blank, as the library does; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumspark.llm.common import texts
from vellumspark.llm.packing import _slices

BLANK = "▁"
#: Bounds of a worker's caches: words with their ids, and pairs of pieces known to (not) stay apart.
WORDS, PAIRS = 500_000, 700_000


class PieceModel:
    """kind: 'bpe' or 'unigram'."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.unk = kind, sp.unk_id()
        self.text, self.ids, self.score, self.byte = [], {}, [], {}
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            self.text.append(piece)
            self.score.append(sp.get_score(k))
            if sp.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.ids[piece] = k
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.byte_of = {k: b for b, k in self.byte.items()}
        #: Pieces by their characters from the last to the first; the key "" holds the id of a piece that ends the walk.
        self.endings: dict = {}
        for piece, k in self.ids.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = k
        self.penalty = min(self.score) - 10
        # a word ends before a blank, around a line break, and before its closing points: no piece reaches across these
        newline = "" if any("\n" in p and p != "\n" for p in self.ids) else "\n"
        parts = [f"{BLANK}*[^{BLANK}{newline}]+", f"{BLANK}+"]
        if not any(re.search(r"[^\W\d_][.,]", p) for p in self.ids):
            closing = f"(?:{BLANK}|\n|$)" if newline else f"(?:{BLANK}|$)"
            parts = [f"{BLANK}*[^\\W\\d_]+(?=[.,]+{closing})", f"[.,]+(?={closing})", *parts]
        self.cutter = re.compile("|".join([*parts, newline]) if newline else "|".join(parts))
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges: always the best-scored neighbour pair that is a piece, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _starts(self, piece: int) -> bool:
        """The merges leave the piece's own text in one."""
        if (ok := self.alone.get(piece)) is None:
            ok = self.alone[piece] = len(self.merged(self.text[piece])) == 1
        return ok

    def _apart(self, p: int, t: int) -> bool:
        key = p << 24 | t
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.text[p] + self.text[t]) == [self.text[p], self.text[t]]
        return ok

    def forward(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words. Piece -1 is a character outside the vocabulary."""
        endings, bpe, score = self.endings, self.kind == "bpe", self.score
        starts, pairs = self._starts, self.pairs
        room = max(map(len, words), default=0) + 1
        last, size, best = [-1] * room, [0] * room, [0.0] * room
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            for i in range(shared + 1, len(word) + 1):
                piece, length, value = -1, 1, best[i - 1] + self.penalty
                node, j, arcs = endings, i, []
                while j:
                    node = node.get(word[j - 1])
                    if node is None:
                        break
                    j -= 1
                    if "" in node:
                        arcs.append((j, node[""]))
                if bpe:
                    for j, t in reversed(arcs):
                        p = last[j] if j else -1
                        ok = starts(t) if p < 0 else pairs.get(p << 24 | t)
                        if ok or ok is None and self._apart(p, t):
                            piece, length, value = t, i - j, best[j] + score[t]
                            break
                else:
                    for j, t in arcs:
                        if best[j] + score[t] > value:
                            piece, length, value = t, i - j, best[j] + score[t]
                last[i], size[i], best[i] = piece, length, value
            before = word
            out, i = [], len(word)
            while i:
                if last[i] >= 0:
                    out.append(last[i])
                elif self.byte:
                    out += [self.byte[b] for b in reversed(word[i - 1].encode("utf-8", "surrogatepass"))]
                else:
                    out.append(self.unk)
                i -= size[i]
            yield out[::-1]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.cutter.findall((BLANK + x).replace(" ", BLANK)) if x else [] for x in batch]
        new = {w for words in cut for w in words if w not in self.words}
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = {w for words in cut for w in words}
        ordered = sorted(new)
        for word, ids in zip(ordered, self.forward(ordered)):
            self.words[word] = np.array(ids, "<u4").tobytes()
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    @lru_cache(maxsize=1)  # noqa: B019
    def _surface(self) -> list[bytes]:
        return [bytes([self.byte_of[k]]) if k in self.byte_of else p.replace(BLANK, " ").encode("utf-8", "surrogatepass") for k, p in enumerate(self.text)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank in front."""
        surface = self._surface()
        return b"".join(map(surface.__getitem__, ids.tolist())).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str, kind: str = "bpe") -> PieceModel:
    return PieceModel(path, kind)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, ids (array<int>), n_pieces, ids_crc32, decoded_sha256 and round_trip of every row.

    The decoded text is computed from the ids; round_trip tells whether it is the text again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path or model_path(), kind)
        for batch in (part for whole in batches for part in _slices(whole, 1 << 21)):
            found = batch.column(1).to_pylist()
            raw = pieces.encode(found)
            decoded = [pieces.decode(np.frombuffer(x, "<u4")) for x in raw]
            lengths = np.array([len(x) // 4 for x in raw], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            columns = [
                batch.column(0), ids, pa.array(lengths), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                pa.array([a == b for a, b in zip(decoded, found)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
