"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each after a mark for the space before it.
The model gives a piece of rank r the score -log(r + 2), in whole millionths, so
that sums are exact; a pre-token is cut into the pieces of the highest sum, and
of equal sums into the fewest.  A character that is no piece counts as its UTF-8
bytes, at a score below that of any piece.

Each worker inserts the distinct pre-tokens of its texts in a trie.  A node holds
the best score of the prefix that leads to it and its number of pieces, found
from its ancestors when the node is made; so a shared prefix is computed once,
and the count of a pre-token is read at its last node.

Defined results: a null text is empty; an empty text has no pre-tokens and no
tokens; null and repeated doc_ids keep their rows; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import _shared, _words

#: Nodes of a worker's trie and pre-tokens whose counts it remembers, each begun anew beyond these; characters of a pre-token that become nodes.
MOST_NODES, REMEMBERED, LONGEST = 1_000_000, 1_000_000, 64
#: Bytes of text that are looked at together.
STRETCH = _words.STRETCH
SPACE = "▁"
#: White space beyond that of _words.
_WIDE_SPACE = "[\\x1c-\\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def piece_scores(path: str) -> dict[str, int]:
    """Scores of the plain pieces of a SentencePiece vocabulary, by their rank there."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    plain = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {x: -round(1e6 * math.log(r + 2)) for r, x in enumerate(plain)}


class Trie:
    """Prefixes with the score and the number of pieces of their best cut."""

    def __init__(self, scores: dict[str, int]) -> None:
        self.scores = scores
        self.by_byte = min(scores.values(), default=0) - 1_000_000
        #: Finds all pieces that end at each character.
        self.ends = ahocorasick.Automaton()
        for x, score in scores.items():
            self.ends.add_word(x, (score, len(x)))
        if scores:
            self.ends.make_automaton()
        self.longest = max(map(len, scores), default=1)
        self.known = _words.Pool("<i8", REMEMBERED)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0], [0]

    def insert(self, pretoken: str) -> int:
        """The number of pieces of a pre-token; of a very long one only the beginning stays in the trie."""
        child, node, score, count = self.child, 0, [0], [0]
        for c in pretoken:
            if (following := child.get((node, c))) is None:
                break
            node = following
            score.append(self.score[node])
            count.append(self.count[node])
        shared = len(score) - 1
        if shared == len(pretoken):
            return count[-1]
        by_end: dict[int, list[tuple[int, int]]] = {}
        if self.scores:
            for end, piece in self.ends.iter(pretoken, max(0, shared + 1 - self.longest)):
                if end >= shared:
                    by_end.setdefault(end, []).append(piece)
        for end in range(shared, len(pretoken)):
            c, best = pretoken[end], None
            for s, n in by_end.get(end, ()):
                found = (score[end + 1 - n] + s, -count[end + 1 - n] - 1)
                best = found if best is None or found > best else best
            if c not in self.scores:
                n = len(c.encode("utf-8", "surrogatepass"))
                found = (score[end] + n * self.by_byte, -count[end] - n)
                best = found if best is None or found > best else best
            score.append(best[0])
            count.append(-best[1])
            if end < LONGEST:
                child[node, c] = len(self.score)
                node = len(self.score)
                self.score.append(best[0])
                self.count.append(-best[1])
        return count[-1]

    def _learn(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of pieces of each word, as a string of that one number."""
        found = np.ones(len(words), np.int64)
        for i, w in enumerate(words.cast(pa.string()).to_pylist()):
            if len(self.score) > MOST_NODES:
                self.clear()
            found[i] = self.insert(SPACE + w)
        return found, np.ones(len(words), np.int64)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text; a null text is empty."""
        texts = texts.fill_null("")
        pretokens, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        wide = np.asarray(pc.match_substring_regex(texts, _WIDE_SPACE))
        for i in np.flatnonzero(wide).tolist():
            words = texts[i].as_py().split()
            pretokens[i], tokens[i] = len(words), self._pieces(pa.array(words, pa.string()).cast(pa.binary())).sum()
        plain = np.flatnonzero(~wide)
        x, offsets = _words.bytes_of(texts.take(pa.array(plain)))
        for part, mine, begins in _words.stretches(x, offsets, STRETCH):
            at, kind, first, runs, _ = _words.runs_of((_words.CLASSES[part] != _words.SPACE).astype(np.uint8), begins)
            if len(first):
                bounds = np.append(at, len(part))
                words = _words.strings(part, bounds).take(pa.array(first))
                pretokens[plain[mine]] += _words.per_text(np.ones(len(first), np.int64), at[first], begins)
                tokens[plain[mine]] += _words.per_text(self._pieces(words), at[first], begins)
        return pretokens, tokens

    def _pieces(self, words: pa.BinaryArray) -> np.ndarray:
        """The number of pieces of each word; long ones aren't remembered."""
        short, out = np.asarray(pc.less_equal(pc.binary_length(words), LONGEST)), np.empty(len(words), np.int64)
        coded = words.filter(pa.array(short)).dictionary_encode()
        at = self.known.places(coded.dictionary, self._learn)[np.asarray(coded.indices)]
        out[short] = self.known.ids[self.known.starts[at]]
        out[~short] = self._learn(words.filter(pa.array(~short)))[0]
        return out


_tries: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """One per worker process."""
    if path not in _tries:
        _tries[path] = Trie(piece_scores(path))
    return _tries[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_pretokens, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole, rows=whole.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, trie(path).counts(b.column(1)))], ["doc_id", "n_pretokens", "n_tokens"])

    return _shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_shared.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
