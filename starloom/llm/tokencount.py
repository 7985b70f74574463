"""Token counts under a unigram vocabulary: the best segmentation's number of pieces, without building it.

Text is cut before every word mark (a space becomes the mark; one is put in front), as a metaspace pre-tokenizer does.
In each part an Aho-Corasick automaton enumerates the vocabulary's matches by where they end, and dynamic
programming carries the best score and its number of pieces. Tie rules are the tokenizer's: of equal scores the path whose last
piece starts first stays; a character without a piece of its own scores the least piece less 10; neighbouring ones
fuse and fall back to their UTF-8 bytes where the vocabulary has byte pieces.

Words repeat, so counts of words are kept in a bounded table per worker (a cache: it changes no result).

The pieces and scores are read from a file. The public one that is at hand lists a byte-pair vocabulary with its ranks as
scores: counted are the pieces of the best unigram segmentation under these scores, as the unigram model of the
``tokenizers`` library gives them for the same list (tests hold them equal), and not those of the byte-pair merges. Scores aren't
fitted here: tokenizers are never trained. Another file gives its own counts.

Defined results: a null text has null counts of nothing, that is 0; an empty text has no pieces; ties go as said above; a very long
text is counted whole; repeated rows are rows of their own; an empty table gives an empty result. Columns beyond doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 400_000
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids; read on the driver and sent along with the work."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of texts. ``unknown`` is the id of the piece for unknown characters."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.scores = dict(pieces)
        self.unknown = pieces[unknown][0]
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = sum(bool(_BYTE.fullmatch(p)) for p, _ in pieces) == 256
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        # a line break that is in no piece is an edge of every path; whole-number scores make sums exact in any grouping
        self.lines = self.bytes and not any("\n" in p for p, _ in pieces) and all(s == int(s) for _, s in pieces)
        self.seen: dict[str, int] = {}

    def best(self, part: str) -> tuple[list[float], list[int]]:
        """Best score up to each place of ``part``, and where the last piece of that path starts (negative: unknown)."""
        n = len(part)
        score, start = [0.0] * (n + 1), [0] * (n + 1)
        found: list[list] = [[] for _ in range(n + 1)]
        for end, hit in self.automaton.iter(part):
            found[end + 1].append(hit)
        for end in range(1, n + 1):
            best = None
            for length, s in sorted(found[end], reverse=True):  # the earliest start first
                value = s + score[end - length]
                if best is None or value > best:
                    best, start[end] = value, end - length
            if part[end - 1] not in self.singles:
                value = self.unknown_score + score[end - 1]
                if best is None or value > best:
                    best, start[end] = value, -end
            score[end] = best
        return score, start

    def pieces(self, part: str) -> list[str]:
        """The segmentation itself, neighbouring unknown characters fused."""
        _, start = self.best(part)
        out, end, fused = [], len(part), ""
        while end:
            begin = end - 1 if start[end] < 0 else start[end]
            piece = part[begin:end]
            if start[end] < 0 or piece == self.unknown:
                fused = piece + fused
            else:
                if fused:
                    out.append(fused)
                    fused = ""
                out.append(piece)
            end = begin
        return [*([fused] if fused else []), *out[::-1]] if fused else out[::-1]

    def _slow(self, part: str) -> int:
        return sum(1 if p in self.scores or not self.bytes else len(p.encode()) for p in self.pieces(part))

    def part(self, part: str) -> int:
        """Pieces of one part: score and count are carried together."""
        if self.unknown in part or not self.bytes:
            return self._slow(part)
        n = len(part)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        hits = iter(self.automaton.iter(part))
        end_of, hit = next(hits, (n, None))
        for end in range(1, n + 1):
            best, pieces = None, 0
            while end_of == end - 1:  # the automaton reports the longest match of a place first
                length, s = hit
                value = s + score[end - length]
                if best is None or value > best:
                    best, pieces = value, count[end - length] + 1
                end_of, hit = next(hits, (n, None))
            c = part[end - 1]
            if c not in self.singles:
                value = self.unknown_score + score[end - 1]
                if best is None or value > best:
                    best, pieces = value, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pieces
        return count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        words = text.split(MARK)
        parts = [MARK + w for w in words[1:]]
        if self.lines:
            parts = [x for p in parts for x in (p.split("\n") if "\n" in p else (p,))]
            total = text.count("\n")
        else:
            total = 0
        seen = self.seen
        for p in parts:
            k = seen.get(p)
            if k is None:
                if len(seen) >= CACHE:
                    seen.clear()
                k = seen[p] = self.part(p)
            total += k
        return total


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_tokens of every whole text. The vocabulary's size bounds what is sent to the workers."""
    pieces = load_pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols = [batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([count(t or "") for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint")


def op10_tokens(spark, sf_dir) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
