"""Token counts: unigram forward scores over a trie of distinct pre-tokens."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Marks the start of a pre-token.
START = "▁"


def unigram(path: str) -> dict[str, float]:
    """Pieces and log probabilities from a sentencepiece file. A file of merges has ranks only; by Zipf's law the piece of rank r gets -log(r + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(pieces)}


class Counter:
    """Tokens of pre-tokens by the best path of pieces (highest sum of scores, then fewest tokens).

    Pre-tokens are put into a trie; each node has the forward score and token count of its prefix, computed once from those of
    its ancestors, and the counts of whole pre-tokens are stored. The trie is emptied when it has MOST nodes. Pre-tokens over LONG
    characters get the same recurrence without being stored. A character that is no piece costs a token for each of its bytes.
    """

    MOST, LONG = 600_000, 48

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.ends = {p[i:] for p in pieces for i in range(len(p))}  # no piece reaches further back than these
        self.floor = min(pieces.values(), default=0.0) - 10.0
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.counts: dict[str, int] = {}

    def step(self, text: str, i: int, path: list[int]) -> None:
        """Appends the score and count of text[:i]; path has the nodes of its prefixes."""
        pieces, ends, score, tokens = self.pieces, self.ends, self.score, self.tokens
        last = text[i - 1]
        best, fewest = None, 0
        if last not in pieces:
            n = len(last.encode("utf-8", "surrogatepass"))
            best, fewest = score[path[i - 1]] + n * self.floor, tokens[path[i - 1]] + n
        for j in range(i - 1, -1, -1):
            piece = text[j:i]
            if piece not in ends:
                break
            s = pieces.get(piece)
            if s is not None:
                node = path[j]
                s += score[node]
                if best is None or s > best or (s == best and tokens[node] < fewest - 1):
                    best, fewest = s, tokens[node] + 1
        score.append(best)
        tokens.append(fewest)

    def __call__(self, word: str) -> int:
        """Tokens of one pre-token."""
        text = START + word
        if len(text) > self.LONG:  # the same steps on a trie of its own
            alone = Counter.__new__(Counter)
            alone.pieces, alone.ends, alone.floor = self.pieces, self.ends, self.floor
            alone.reset()
            path = list(range(len(text) + 1))
            for i in range(1, len(text) + 1):
                alone.step(text, i, path)
            return alone.tokens[-1]
        if len(self.score) > self.MOST:
            self.reset()
        child, path = self.child, [0]
        for i, c in enumerate(text, 1):
            key = path[-1] << 21 | ord(c)
            node = child.get(key)
            if node is None:
                node = child[key] = len(self.score)
                self.step(text, i, path)
            path.append(node)
        self.counts[word] = n = self.tokens[path[-1]]
        return n

    def total(self, words: list[str]) -> int:
        """Tokens of all words; those met before are looked up."""
        try:
            return sum([self.counts[w] for w in words])
        except KeyError:
            known = self.counts.get
            return sum([self(w) if (n := known(w)) is None else n for w in words])


@functools.cache
def counter(path: str) -> Counter:
    """One a Python worker, for all its tasks."""
    return Counter(unigram(path))


def count_tokens(docs: DataFrame, *, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Pre-tokens are runs of anything but ASCII white space, each with a start mark. A narrow pass without a shuffle: every worker
    keeps its own trie, of bounded size. Null and empty texts have no words and no tokens; null ids stay null; repeated rows are
    counted each; empty tables give no rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path)
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1):
                found = WORD.findall(t.as_py() or "")
                words.append(len(found))
                tokens.append(count.total(found))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, n_words long, n_tokens long")
