"""Token counts by heap-and-linked-list byte-pair merging: initial symbols less merges, no ids.

Words repeat, so each Python worker remembers the counts of up to `remembered` words and chunks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.symbols import byte_symbols
from lodestone.llm import word_bpe
from lodestone.llm.common import documents, gathered, tidied

LIMIT = 2048
#: Words and chunks that a worker keeps, and bytes of text looked at together: a batch tells its repeats apart faster than a large memory does.
REMEMBERED, BATCH = 120_000, 32 << 20


class WordCounts(dict):
    """Word to number of tokens; a missing word is merged."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        self.most = remembered
        self.chunks = word_bpe.Chunks(lambda chunks: [sum(map(self.__getitem__, words)) for words in chunks], remembered)
        self.symbols = byte_symbols()
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        for s in self.symbols:
            number(s), number(s + word_bpe.END_OF_WORD)
        #: pair -> (rank, merged symbol), symbols as numbers
        self.ranks = {(number(a), number(b)): (rank, number(a + b)) for (a, b), rank in word_bpe.merge_ranks(path).items()}
        self.first = [names[s] for s in self.symbols]
        self.last = [names[s + word_bpe.END_OF_WORD] for s in self.symbols]

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(self) < self.most:  # the frequent words are among the first
            self[word] = n
        return n

    def merged(self, data: bytes) -> int:
        ranks = self.ranks
        symbol = [*(self.first[b] for b in data[:-1]), self.last[data[-1]]]
        n = count = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := ranks.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has gone into another pair
            symbol[i], symbol[j] = into, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((into, symbol[k])):
                    heapq.heappush(heap, (found[0], i, into, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((symbol[h], into))):
                heapq.heappush(heap, (found[0], h, symbol[h], into, found[1]))
        return count

    def text(self, text: str) -> int:
        found = word_bpe.parts(text)
        return len(found) - 1 + sum(sum(map(self.__getitem__, word_bpe.split_words(p))) for p in found)

    def texts(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text: the sums of its chunks' counts; one by one where a text is odd."""
        odd = [i for i, t in enumerate(texts) if word_bpe.has_special(t) or not word_bpe.is_plain(t)]
        skip = set(odd)
        bounds, numbers, values = self.chunks(["" if i in skip else t for i, t in enumerate(texts)])
        upto = np.r_[0, np.cumsum(np.array(values, np.int64)[numbers.to_numpy()])] if values else np.zeros(1, np.int64)
        out = np.diff(upto[bounds])
        out[odd] = [self.text(texts[i]) for i in odd]
        return out


_counts: dict[str, WordCounts] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row per document: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have 0 bytes and 0 tokens; null ids are kept; repeated rows give repeated rows; a special
    string inside a text is one token, as by the library's default; an empty table gives no row; other columns are
    left aside. Memory: one batch and the remembered words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = WordCounts(path)
        tokens = _counts[path].texts
        for batch in gathered(batches, BATCH):
            yield from pa.Table.from_arrays([batch.column(0), batch.column(1), pa.array(tokens(batch.column(2).to_pylist()))], names=["_id", "n_bytes", "n_tokens"]).to_batches()

    rows = documents(docs, id_col, text_col).select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "_text")
    out = rows.mapInArrow(tidied(count), "_id long, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
