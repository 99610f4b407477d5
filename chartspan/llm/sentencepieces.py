"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 10)."""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker's table of encoded words is emptied beyond so many.
MAX_WORDS = 400_000
MARK = "▁"


class Model:
    """Encodes and decodes as the library does, for models that mark spaces, have a byte fallback and keep pieces within words.

    Forward scores run over a word's prefixes. For unigram models the score of a prefix is the best sum of piece scores. For
    byte-pair models it is a reachability: a segmentation is the model's own if and only if the model encodes each two adjacent
    pieces, put together, as these two. So of the pieces that end a prefix, exactly one follows the last piece of the shorter
    prefix so, and the forward table holds, for each prefix, that piece. Either way the table of a prefix doesn't depend on what
    follows, and words that share a prefix share its table.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not spec.add_dummy_prefix or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only models with identity normalisation, spaces and starts marked, and byte fallback")
        self.unigram = trainer.model_type == 1
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses words")
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.text = np.array([b"" if p.type in (3,) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else p.piece.replace(MARK, " ").encode() for p in proto.pieces], dtype=object)
        self.lowest = min(self.scores[i] for i in self.ids.values()) - 10
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = [p.piece for p in proto.pieces]
        self.sizes = list(map(len, self.pieces))
        #: Pieces by their characters from the last to the first: character -> (next characters, piece that starts here or -1).
        self.ends: dict = {}
        for piece, k in self.ids.items():
            if self.unigram or self.merged(piece) == [piece]:
                node = self.ends
                for ch in reversed(piece):
                    node = node.setdefault(ch, {})
                node[""] = k

    def merged(self, word: str) -> list[str]:
        """Byte-pair merges, as defined: of the pairs that form a piece the one of best score, leftmost first. Pairs wait in a heap and
        parts are linked to their neighbours, so that n characters cost about n log n."""
        parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        ids, scores = self.ids, self.scores
        pairs = [(-scores[k], i, p) for i in range(len(parts) - 1) if (k := ids.get(p := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, piece = heapq.heappop(pairs)
            j = after[i]
            if not parts[i] or j == len(parts) or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
                continue  # one of the two has been merged since
            parts[i], parts[j] = piece, ""
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (n := ids.get(p := piece + parts[k])) is not None:
                    heapq.heappush(pairs, (-scores[n], i, p))
            h = before[i]
            if h >= 0 and (n := ids.get(p := parts[h] + piece)) is not None:
                heapq.heappush(pairs, (-scores[n], h, p))
        return [p for p in parts if p]

    def _name(self, k: int) -> str:
        """A piece's text; characters that are no piece have numbers below zero."""
        return self.pieces[k] if k >= 0 else chr(~k)

    def follows(self, a: int, b: int) -> bool:
        if len(self.pairs) > 8 * MAX_WORDS:
            self.pairs.clear()
        x, y = self._name(a), self._name(b)
        known = self.pairs[a << 32 | b + (1 << 31)] = self.merged(x + y) == [x, y]
        return known

    def _best_at_end(self, word: str, end: int, score: list[float]) -> tuple[int, float]:
        """The last piece of the best segmentation of word[:end] in a unigram model, and its score."""
        found, best, node, start = ~ord(word[end - 1]), score[end - 1] + self.lowest, self.ends, end
        while start and (node := node.get(word[start - 1])) is not None:
            start -= 1
            k = node.get("", -1)
            if k >= 0 and score[start] + self.scores[k] >= best:
                found, best = k, score[start] + self.scores[k]
        return found, best

    def encode_words(self, words: list[str]) -> None:
        """Adds to the table of words: sorted, they are the trie of their prefixes in depth-first order; the forward tables of
        the prefix that a word shares with the one before stay, and only those beyond it are made."""
        if self.unigram:
            return self._encode_words_by_score(words)
        before, last, sizes, table = "", [0], self.sizes, self.words
        pairs, ends, follows = self.pairs, self.ends, self.follows
        for key in sorted(words):
            word = MARK + key
            if key[:1] == MARK:  # pieces that are runs of marks have equal scores: merged as defined
                table[key] = self._bytes([self.ids.get(p, ~ord(p[0])) for p in self.merged(word)])
                continue
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            n = len(word)
            for end in range(shared, n):  # one step of the trie: the piece that ends word[: end + 1] in the model's own segmentation
                node, start, found = ends, end, None
                while (node := node.get(word[start])) is not None:
                    if "" in node:
                        k = node[""]
                        if not start:
                            found = k
                            break
                        pair = last[start] << 32 | k + 2147483648
                        if pairs[pair] if pair in pairs else follows(last[start], k):
                            found = k
                            break
                    if not start:
                        break
                    start -= 1
                last.append(~ord(word[end]) if found is None else found)
            before, out = word, []
            while n:
                k = last[n]
                out.append(k)
                n -= sizes[k] if k >= 0 else 1
            out.reverse()
            table[key] = self._bytes(out)

    def _encode_words_by_score(self, words: list[str]) -> None:
        before, last, score = "", [0], [0.0]
        for key in sorted(words):
            word = MARK + key
            shared = len(os.path.commonprefix((before, word)))
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                k, value = self._best_at_end(word, end, score)
                last.append(k)
                score.append(value)
            before, out, n = word, [], len(word)
            while n:
                out.append(last[n])
                n -= self.sizes[last[n]] if last[n] >= 0 else 1
            self.words[key] = self._bytes(out[::-1])

    def _bytes(self, pieces: list[int]) -> bytes:
        """The ids as little-endian int32; characters that are no piece become their bytes' pieces."""
        if min(pieces) < 0:
            pieces = [j for k in pieces for j in ([k] if k >= 0 else [self.bytes_[b] for b in chr(~k).encode("utf-8", "surrogatepass")])]
        return array("i", pieces).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. The distinct words of all that the table lacks are encoded first, in sorted order."""
        split = [self._split(t) for t in texts]
        new = set().union(*split)
        lack = new - self.words.keys()
        if len(self.words) + len(lack) > MAX_WORDS:
            self.words.clear()
            lack = new
        self.encode_words(list(lack))
        get = self.words.__getitem__
        for s in split:
            yield np.frombuffer(b"".join(map(get, s)), "<i4")

    def _split(self, text: str) -> list[str]:
        """Marked words, each without its first mark: a mark or a run of marks with what follows up to the next mark."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        words, marks = [], ""
        for p in parts[:-1]:
            if p:
                words.append(marks + p)
            marks = "" if p else marks + MARK
        return [*words, marks + parts[-1]]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(self.text[ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


@functools.lru_cache(2)
def _model(path: str) -> Model:
    return Model(path)


#: Texts encoded at once; bounds the distinct words in memory, and is many enough to share prefixes.
CHUNK = 512


def encode(docs: DataFrame, model_path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """docs with a column more, array<int>: the ids of the whole text, without begin or end, as the library gives them.

    A null or empty text has no ids. The vocabulary file is there on every executor. No row leaves its partition.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(model_path)
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([x for at in range(0, len(texts), CHUNK) for x in model.encode(texts[at : at + CHUNK])], dtype=object)

    return docs.withColumn(to, ids(F.col(text_col)))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with a column more: the text of the ids. Null or no ids give an empty text; control pieces give none."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(model_path)
        for s in batches:
            yield pd.Series(["" if x is None or not len(x) else model.decode(np.asarray(x, np.int64)) for x in s], dtype=object)

    return encoded.withColumn(to, texts(F.col(ids_col)))


def summary(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, ids_sha256 (of the ids as little-endian int32), round_trip (decoding gives the text).

    The same encoding and decoding as encode() and decode(), in one pass, so that ids and texts stay in the worker. A null text
    counts as empty. A very long text, word or run of spaces is encoded whole, in time about proportional to its length. A text that holds U+2581 itself comes back with spaces for it, so its round_trip is false. Null ids and
    repeated rows stay. Other columns are ignored. An empty table gives no rows. No row leaves its partition.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, round_trip boolean")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(model_path)
        for batch in batches:
            counts, digests, same = [], [], []
            for at in range(0, len(batch), CHUNK):  # no more texts than these are held as strings
                part = [t or "" for t in batch.slice(at, CHUNK).to_pylist()]
                for t, ids in zip(part, model.encode(part)):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    same.append(model.decode(ids) == t)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["n_tokens", "ids_sha256", "round_trip"])

    base = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), coded(F.col(text_col)).alias("m"))
    return base.select(id_col, "n_bytes", "m.*")
