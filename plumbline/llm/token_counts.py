"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position; dynamic
programming keeps the best score and its number of pieces, never the pieces themselves. Words are
independent, so each distinct word of a task is solved once. Ties follow the unigram model of ``tokenizers``: at each end
the piece that starts first is tried first, and only a strictly better score replaces it. One pass,
no shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.tables import by_batch, key_name, read

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers; beyond that it forgets all and starts anew.
REMEMBERED_WORDS = 300_000
SCHEMA = "n_code_points long, n_tokens long"


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Pieces of a word, by word; computed when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        known = {piece for piece, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = count = self.solve(word)
        return count

    def solve(self, word: str) -> int:
        """Number of pieces of the best segmentation."""
        size = len(word)
        best, pieces, lost = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)

        def finish(end: int, found: float | None, start: int, single: bool) -> None:
            if not single:  # the character alone is unknown
                score = best[end - 1] + self.unknown
                if found is None or score > found:
                    best[end], lost[end] = score, True
                    if self.bytes:
                        pieces[end] = pieces[end - 1] + len(word[end - 1].encode())
                    else:  # neighbouring unknown characters are one piece
                        pieces[end] = pieces[end - 1] + (not lost[end - 1])
                    return
            best[end], pieces[end] = found, pieces[start] + 1

        found, start, single, at = None, 0, False, 1
        for last, (length, score) in self.pieces.iter(word):
            end = last + 1
            while at < end:
                finish(at, found, start, single)
                found, single, at = None, False, at + 1
            total = best[end - length] + score
            if found is None or total > found:
                found, start = total, end - length
            single = single or length == 1
        while at <= size:
            finish(at, found, start, single)
            found, single, at = None, False, at + 1
        return pieces[size]

    def text(self, text: str) -> int:
        """Pieces of a text cut before every blank, each word led by the mark."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        return sum([self[word] for word in words])


class _Marked(Counter):
    def solve(self, word: str) -> int:
        return super().solve(MARK + word)


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    """One automaton a Python worker."""
    return _Marked(load_vocabulary(path))


def count_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Number of unigram tokens of every row's whole text.

    ``vocabulary`` is the path of a sentencepiece file that every executor can open. A text is cut
    before every blank (U+0020) or mark; other white space belongs to its word. Characters no piece
    covers count by their UTF-8 bytes if the vocabulary has all byte pieces, else a run of them
    counts once. Null and empty texts have 0 tokens; repeated rows are counted each; the key may be
    null, and one named like a result column comes back with ``key_`` before its name; other columns
    are not read; an empty table gives an empty result. The default file holds a BPE model, whose
    pieces and scores are read as a unigram model here, so the counts are not that model's own.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    kind, name = df.schema[key].dataType.simpleString(), key_name(key, SCHEMA)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        solver = counter(path)
        texts = batch.column(1)
        counts, sizes = [], []
        for cell in texts:
            value = cell.as_py() or ""
            counts.append(solver.text(value))
            sizes.append(len(value))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            [name, "n_code_points", "n_tokens"],
        )

    frame = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return by_batch(frame, run, f"`{name}` {kind}, {SCHEMA}")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return count_tokens(read(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": (op6_token_counts, None)}
