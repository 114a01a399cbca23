"""Word-piece token counts with a linear longest-match automaton.

Greedy longest match from the left needs, after a failed character, the pieces that the match so far is cut into. The
vocabulary trie holds word-initial pieces at one root and continuing pieces below another. Every state has a failure
link, the state after cutting off the longest pieces that are sure, and the number of pieces so cut off. A word is read
once: a character without an arc adds the popped count and follows the link, so counting is linear in the word and never
builds a piece. A word that can't be cut counts as one unknown token.

The vocabulary is one of bytes, and so is the automaton: it reads a word's UTF-8 bytes after a space byte. Pieces that
begin with a space are the word-initial ones, all others continue a word, and pieces that end within a character count
like any other. Where a vocabulary has all single bytes and the space, no word is unknown.

A text's words are its white-space separated parts. Each word of a batch is counted once, then counts are summed by text
in numpy.

Odd rows: a null or empty text has no words and no tokens; a word of any length is read to its end; repeated rows stay;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.token_index import _byte_letters, _slices

WORDS_REMEMBERED = 700_000


class LongestMatch:
    """The automaton of a vocabulary: pieces that begin a word, and pieces that continue one."""

    def __init__(self, initial: set[str], continuing: set[str]):
        self.arcs: list[dict[str, int]] = [{}, {}]  # state 0: a word's beginning; state 1: what continues it
        whole = [False, False]
        depth = [0, 0]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in sorted(pieces):
                state = root
                for c in piece:
                    nxt = self.arcs[state].get(c)
                    if nxt is None:
                        nxt = self.arcs[state][c] = len(self.arcs)
                        self.arcs.append({})
                        whole.append(False)
                        depth.append(depth[state] + 1)
                    state = nxt
                if piece:
                    whole[state] = True
        self.fail = [-1] * len(self.arcs)
        self.popped = [0] * len(self.arcs)
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for c, state in self.arcs[parent].items():
                    below.append(state)
                    if whole[state]:
                        self.fail[state], self.popped[state] = 1, 1
                        continue
                    at, n = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.arcs[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[state], self.popped[state] = self.arcs[at][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be cut into pieces; 0 for an empty word."""
        arcs, fail, popped = self.arcs, self.fail, self.popped
        state = n = 0
        for c in word:
            nxt = arcs[state].get(c)
            while nxt is None:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return -1
                nxt = arcs[state].get(c)
            state = nxt
        while state > 1:
            n += popped[state]
            state = fail[state]
            if state < 0:
                return -1
        return n


def pieces_of_byte_bpe(tokenizer_json: str) -> tuple[set[str], set[str]]:
    """Initial and continuing pieces of a byte-level BPE vocabulary: those that begin with a space, and the others.

    A piece is a string with a character below 256 for each byte; special tokens are no pieces.
    """
    spec = json.loads(tokenizer_json)
    back = {chr(v): chr(k) for k, v in _byte_letters().items()}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pieces = {"".join(back[c] for c in token) for token in spec["model"]["vocab"] if token not in special and all(c in back for c in token)}
    initial = {p for p in pieces if p.startswith(" ")}
    return initial, pieces - initial


def as_bytes(word: str) -> str:
    """What the automaton reads for a word: a space and the word's bytes."""
    return f" {word}" if word.isascii() else " " + word.encode("utf-8", "surrogatepass").decode("latin-1")


_automata: dict[int, tuple[LongestMatch, dict[str, int]]] = {}


def _automaton(spec: str) -> tuple[LongestMatch, dict[str, int]]:
    key = hash(spec)
    if key not in _automata:
        _automata.clear()
        _automata[key] = (LongestMatch(*pieces_of_byte_bpe(spec)), {})
    return _automata[key]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word counts 1) and n_unknown of every row. One pass without a shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the vocabulary file is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(sent.value)
        for batch in batches:
            for some in _slices(batch):
                split = pc.utf8_split_whitespace(pc.fill_null(some.column(1), ""))
                encoded = split.flatten().dictionary_encode()
                words = encoded.dictionary.to_pylist()
                if len(known) > WORDS_REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = automaton.count(as_bytes(w)) if w else 0
                sizes = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))
                each = sizes[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
                offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
                per = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (each != 0, np.abs(each), each < 0)]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(p.astype(np.int64)) for p in per)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
