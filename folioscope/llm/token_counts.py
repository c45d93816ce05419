"""Token counts under a unigram vocabulary, without making the tokens.

The text is written as the tokenizer sees it (a mark in front, spaces as marks). An Aho-Corasick automaton over the
vocabulary gives every piece that ends at a position; dynamic programming keeps, for each position, the best score and
the number of pieces on the best path. Ties and unknowns follow the tokenizer: among equal scores the piece that starts
first (the longest) wins, as later ones must be strictly better; a character that is no piece itself costs the worst
score less 10, and counts one token for each of its UTF-8 bytes (byte fallback).

Pieces hold the mark only in front, so words (runs of marks and what follows) are solved apart and remembered, and a
character that occurs in no piece stands alone. Scores are whole numbers, for which sums are exact. Defined results:
null counts 0, as does empty text; repeated rows count each; a word of any length is solved whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers; the memory starts afresh when full.
REMEMBERED = 400_000


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model, in id order."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary):
            raise ValueError("a piece holds the word mark after another character")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.memory: dict[str, int] = {}
        known = "".join(sorted({c for p, _ in vocabulary for c in p} - {MARK}))
        inside = f"[{re.escape(known)}]" if known else r"[^\s\S]"
        self.split = re.compile(f"{MARK}+{inside}*|{inside}+|[\\s\\S]").findall

    def solve(self, word: str) -> int:
        """Pieces on the best path of one word."""
        n = len(word)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, hit in self.automaton.iter(word):
            ends.setdefault(end + 1, []).append(hit)
        for end in range(1, n + 1):
            found = ends.get(end, [])
            for size, score in sorted(found, reverse=True):  # earliest start first
                before = best[end - size]
                if before is not None and (best[end] is None or before + score > best[end]):
                    best[end], count[end] = before + score, count[end - size] + 1
            c = word[end - 1]
            if c not in self.singles:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end], count[end] = score, count[end - 1] + len(c.encode("utf-8", "replace"))
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, memory = 0, self.memory
        for word in self.split(MARK + text.replace(" ", MARK)):
            n = memory.get(word)
            if n is None:
                n = self.solve(word)
                if len(word) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[word] = n
            total += n
        return total


@lru_cache(maxsize=1)
def _counter(sent) -> Counter:
    return Counter(sent.value)


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of each row. The vocabulary, a file of fixed size, is read by the driver and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        counter = _counter(sent)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
