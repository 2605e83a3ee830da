"""Token counts of a unigram tokenizer without making the tokens.

Vocabulary matches inside a word come from an Aho-Corasick automaton; a Viterbi pass over its
places carries only the best score and the number of pieces.  Words are independent (no piece crosses a
space, which is checked), so each distinct word is counted once for each Python worker.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, column, slices, texts_of

SPACE = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str = TOKENIZER) -> list[tuple[str, float]]:
    """(piece, score) by id, from a public sentencepiece file; id 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Pieces of a word by the tokenizer's rules.

    * best total score wins; among equal scores the longest last piece wins (a later candidate replaces an earlier one
      only if it is strictly better, and candidates come in order of their start);
    * a character without a piece of its own costs ``lowest score - 10`` and becomes one token for each of its
      UTF-8 bytes if all byte pieces exist, else one token for each run of such characters.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        crossing = [p for p, _ in vocabulary if SPACE in p[1:] and p.strip(SPACE)]
        if crossing:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        self.unknown = min(s for _, s in vocabulary) - 10
        self.pieces = {p for p, _ in vocabulary}
        self.known = {c for p in self.pieces for c in p}
        self.single = {p for p in self.pieces if len(p) == 1}
        self.bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __call__(self, word: str) -> int:
        if self.single.issuperset(word):
            return self.plain(word)
        if self.bytes and not self.known.issuperset(word):  # no piece reaches over a character that is in none
            total, part = 0, []
            for char in word:
                if char in self.known:
                    part.append(char)
                else:
                    total += len(char.encode("utf-8", "replace")) + (self("".join(part)) if part else 0)
                    part = []
            return total + (self("".join(part)) if part else 0)
        return self.general(word)

    def plain(self, word: str) -> int:
        """Every character is a piece, so no place is out of reach; matches come by end, then by start."""
        best, count = [float("-inf")] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for last, (size, score) in self.automaton.iter(word):
            start = last + 1 - size
            value = best[start] + score
            if value > best[last + 1]:
                best[last + 1], count[last + 1] = value, count[start] + 1
        return count[-1]

    def general(self, word: str) -> int:
        n = len(word)
        best, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # run: the last piece is unknown
        done = 0

        def settle(end: int, found: list) -> None:
            single, top, at = False, None, None
            for size, score in found:  # the longest, so the earliest start, first
                value = best[end - size] + score
                single = single or size == 1
                if top is None or value > top:
                    top, at = value, end - size
            if not single and (top is None or best[end - 1] + self.unknown > top):
                best[end], run[end] = best[end - 1] + self.unknown, True
                count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.bytes else int(not run[end - 1]))
            else:
                best[end], count[end] = top, count[at] + 1

        found: list = []
        for last, match in self.automaton.iter(word):
            if last + 1 != done + 1 or not found:
                if found:
                    settle(done + 1, found)
                    done, found = done + 1, []
                while done < last:
                    settle(done + 1, [])
                    done += 1
            found.append(match)
        if found:
            settle(done + 1, found)
            done += 1
        while done < n:
            settle(done + 1, [])
            done += 1
        return count[n]


_KNOWN: dict[str, Codes] = {}


def words_of(text: str) -> list[str]:
    """Words with their leading space mark, as the tokenizer splits them."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if parts[0] == "":
        parts = parts[1:]
    return [SPACE + w for w in parts]


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Null and empty texts have 0 of both.  Repeated rows are counted each; only doc_id and text are read.  The
    vocabulary (bounded by its file) travels to the executors once, as a broadcast.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        known = _KNOWN.get(path)
        if known is None:  # kept between the tasks of a Python worker
            known = _KNOWN[path] = Codes(Counter(vocabulary.value), limit=1_000_000)
        for batch in slices(batches):
            words, tokens = [], []
            for text in texts_of(batch):
                parts = words_of(text or "")
                words.append(len(parts))
                tokens.append(int(known.array(parts).sum()) if parts else 0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
