"""Token counts of a byte-pair model by merging in a heap over linked symbols, without making any identifier.

A text is normalised as the model asks for (a leading space mark, spaces as marks), and starts as one symbol for each
character of the vocabulary and one for each byte of any other character. The adjacent pair of the lowest rank (the
leftmost of equal ranks) is merged until no pair is a piece; the count is what the text started with less the merges.
No piece goes on with a space mark after another character, so merges never cross from one word to the next: words are
counted one by one, and equal words once while they are remembered. A text without spaces is one word; the heap takes
n log n steps for it. Counting is a projection: rows stay in their task, and nothing is shuffled or collected.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import byte_rows

#: The mark that stands for a space.
MARK = "▁"
#: A model file over this size is refused, as it is broadcast (public ones have under 10 MB).
MODEL_BYTES = 64 << 20
#: Words remembered by a worker, and the longest one that is; both only bound its memory.
MEMORY_WORDS, MEMORY_LENGTH = 300_000, 48


class Pieces:
    """Ranks of a model's pieces and the two facts that its normaliser leaves to know."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.rank = {sp.id_to_piece(i): round(-sp.get_score(i)) for i in plain if not sp.is_unused(i)}
        self.bytes = all(sp.piece_to_id(f"<0x{b:02X}>") != sp.unk_id() for b in range(256))
        ends = MARK + "a  b" + MARK
        if len(self.rank) + 259 < sp.get_piece_size() or not self.bytes or sp.normalize(ends) != MARK + ends.replace(" ", MARK):
            raise ValueError("only models with byte fallback, a leading space and spaces kept as they are can be counted")
        if any(sp.get_score(i) != round(sp.get_score(i)) or sp.get_score(i) > 0 for i in plain):
            raise ValueError("ranks of this model are no whole numbers")
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces of this model cross words")

    def count(self, word: str) -> int:
        """Tokens of one word: initial symbols less merges."""
        rank, n = self.rank, len(word)
        count = n
        for c in word:
            if c not in rank:
                count += len(c.encode()) - 1
        bits = n.bit_length()
        wide, ones = 2 * bits, (1 << bits) - 1
        # A heap entry is one number: rank, place of the left symbol, characters of the pair.
        heap = [rank[pair] << wide | i << bits | 2 for i in range(n - 1) if (pair := word[i : i + 2]) in rank]
        if not heap:
            return count
        heapq.heapify(heap)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # a symbol goes from its place to its end, where the next one is
        get, pop, push = rank.get, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            a = top >> bits & ones
            b = end[a]
            if not b or b == n or end[b] - a != top & ones:
                continue  # one of the two has been merged since
            c = end[b]
            end[a], end[b] = c, 0
            count -= 1
            if c < n:
                before[c] = a
                d = end[c]
                if (r := get(word[a:d])) is not None:
                    push(heap, r << wide | a << bits | d - a)
            if a and (r := get(word[(p := before[a]) : c])) is not None:
                push(heap, r << wide | p << bits | c - p)
        return count


def words_of(text: str) -> list[str]:
    """Words with the space marks before them (spaces at the end are a word); none for an empty text."""
    import re

    return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) if text else []


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, memory: int = MEMORY_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of documents: UTF-8 bytes and tokens of the whole text.

    Null text counts as empty, and empty text has no tokens; a null doc_id stays null; rows repeat as they do in the
    input; other columns are ignored. Strings of control tokens inside a text are ordinary text. ``memory`` bounds the
    words that a task remembers, and changes no result.
    """
    with open(model_path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{model_path} has more than {MODEL_BYTES} bytes, too many to broadcast")
    Pieces(raw)  # a model that can't be counted is refused here, not in a task
    model = docs.sparkSession.sparkContext.broadcast(raw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        known: dict[str, int] = {}
        for batch in batches:
            sizes, tokens = [], []
            for text in byte_rows(batch.column(1)):
                n = 0
                for word in words_of(text.decode(errors="replace")):
                    if (found := known.get(word)) is None:
                        found = pieces.count(word)
                        if len(word) <= MEMORY_LENGTH:
                            if len(known) >= memory:
                                known.clear()
                            known[word] = found
                    n += found
                sizes.append(len(text))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
