"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character, longest
first; the best segmentation's score and number of pieces are carried along. Ties go as in the public
`tokenizers` library's unigram model: the piece that starts first wins and later ones must score higher, and
a character that no one-character piece covers costs ten below the lowest score. With byte pieces such a
character counts as many tokens as it has UTF-8 bytes, else a run of them counts as one. Texts are cut before
each space, as that library's Metaspace does, so words repeat and their counts are kept.

Defined results: a null or empty text has no tokens; repeated rows and rows with a null id are counted alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import prepare, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers, and the longest it does.
CACHE, LONG = 500_000, 64
_MODELS: dict[str, tuple] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores = {}
        for piece, score in pieces:
            if piece:
                scores[piece] = score
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{i:02X}>" in scores for i in range(256))
        self.seen: dict[str, int] = {}

    def word(self, text: str) -> int:
        """The number of pieces of a text without cuts."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches, ended = self.automaton.iter(text), None
        at, (size, score) = next(matches, (n, (0, 0.0)))
        for end in range(1, n + 1):
            found, single = None, False
            while at == end - 1:  # pieces that end here, longest first
                total = score + best[end - size]
                if found is None or total > found:
                    found, ended = total, end - size
                single = single or size == 1
                at, (size, score) = next(matches, (n, (0, 0.0)))
            own = False
            if not single:
                total = self.unknown + best[end - 1]
                if found is None or total > found:
                    found, ended, own = total, end - 1, True
            best[end], unknown[end] = found, own
            if not own:
                count[end] = count[ended] + 1
            elif self.bytes:
                count[end] = count[ended] + len(text[end - 1].encode())
            else:
                count[end] = count[ended] + (not unknown[ended])
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:
            marked = MARK + marked
        total, seen = 0, self.seen
        for w in CUT.findall(marked):
            got = seen.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= LONG:
                    seen[w] = got
            total += got
        if len(seen) > CACHE:
            seen.clear()
        return total


CUT = re.compile(f"{MARK}[^{MARK}]*")


def counter(path: str) -> Counter:
    if path not in _MODELS:
        _MODELS[path] = Counter(vocabulary(path))
    return _MODELS[path]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens)."""
    prepare(df.sparkSession)

    def run(batches):
        model = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([model.text(t) for t in b.column(1).to_pylist()], np.int64))], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars")), default_vocabulary())
    return found.select("doc_id", "n_tokens")
