"""Byte-level BPE by prefix dynamic programming.

For each prefix of a pre-token there is exactly one token that can end its encoding. The table of these last tokens is
filled from left to right: a vocabulary token ending at a byte is the one if it may follow the last token of the prefix
before it. The encoding is read from the table backwards. Because an entry depends only on earlier bytes, appends
extend the table and edits recompute it from the edit until it agrees with the old table again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from math import inf

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import hold

# Entries a process keeps of encoded chunks, encoded pre-tokens and tested token pairs, before it starts afresh.
CACHE_CHUNKS, CACHE_PIECES, CACHE_PAIRS = 800_000, 400_000, 600_000

# What stands before the first token.
START = -1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Coder:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.digits = {rank: str(rank) for rank in self.token}
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        # finds all tokens that end at a byte, the longest first
        self._ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self._ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self._ends.make_automaton()
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._parents: dict[int, tuple[int, int] | None] = {}
        self._spines: tuple[dict[int, list | None], ...] = ({}, {})

    def merged(self, data: bytes, below: float = inf) -> list[int]:
        """The defining procedure: merge the adjacent pair of lowest rank, leftmost first, until none ``below`` is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= below or best == inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def parents(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one last; none for a byte, and for a token that merging never reaches."""
        if token not in self._parents:
            parts = self.merged(self.token[token], token) if self.sizes[token] > 1 else []
            self._parents[token] = tuple(parts) if len(parts) == 2 else None
        return self._parents[token]

    def reached(self, token: int) -> bool:
        return self.sizes[token] == 1 or self.parents(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]] | None:
        """The parts that stand at the left (0) or right (1) end of a token while it is merged, from the byte up, each with the
        rank of the merge that ends it; None if merging never reaches the token."""
        known = self._spines[side]
        if token not in known:
            chain_, at, whole = [(self.token[token], inf)], token, self.reached(token)
            while self.sizes[at] > 1 and whole:
                whole, before = self.reached(at), at
                at = self.parents(at)[side] if whole else at
                chain_.append((self.token[at], before))
            known[token] = chain_[::-1] if whole else None
        return known[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes; after ``START``, whether the right one alone is.

        They are unless, at some time while both are merged, the parts that meet at the border merge first. The ranks of
        merges inside rise towards the whole token, so both ends are walked in the order of their ranks.
        """
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self.reached(right) if left == START else self._apart(self.spine(left, 1), self.spine(right, 0))
        return known

    def _apart(self, left: list[tuple[bytes, float]] | None, right: list[tuple[bytes, float]] | None) -> bool:
        if left is None or right is None:
            return False
        rank, i, j = self.ranks.get, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = rank(x + y)
            # of equal ranks the leftmost pair is merged
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == inf:
                    return True
                i += 1
            else:
                j += 1

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each non-empty prefix; ``last`` may hold the entries of a shorter prefix, which are kept."""
        last = [] if last is None else last
        done, known = len(last), self._pairs.get
        for end, (token, size) in self._ends.iter(data.decode("latin-1"), max(0, done + 1 - self.longest)):
            if end < done:
                continue
            if end > done:
                break
            before = last[end - size] if size <= end else START
            fits = known((before, token))
            if fits or fits is None and self.may_follow(before, token):
                last.append(token)
                done += 1
        if done < len(data):
            raise ValueError("the rank file has no token for a byte")
        return last

    def replaced(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replace ``data[start:stop]``: the new bytes, their table, and the entries that had to be computed.

        Old entries are taken over once as many in a row as the longest token has bytes agree with the old table.
        """
        edited = data[:start] + new + data[stop:]
        shift, table, agree = len(new) - (stop - start), last[:start], 0
        for end in range(start + 1, len(edited) + 1):
            self.prefixes(edited[:end], table)
            old = end - shift
            agree = agree + 1 if end > start + len(new) and table[-1] == last[old - 1] else 0
            if agree >= self.longest:
                return edited, table + last[old:], end - start
        return edited, table, len(edited) - start

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        ids, end, sizes = [], len(data), self.sizes
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= sizes[token]
        ids.reverse()
        return ids

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self.read_back(data, self.prefixes(data)) if whole is None else [whole]

    def piece(self, piece: str) -> list[int]:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = self.encode_piece(piece.encode())
            if len(piece) <= 48:
                if len(self._pieces) >= CACHE_PIECES:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def _fresh(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.split(chunk))))

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a text without a pre-token that crosses its ends; repeated chunks are looked up."""
        ids = self._chunks.get(text)
        if ids is None:
            ids = self._fresh(text)
            if len(text) <= 64:
                if len(self._chunks) >= CACHE_CHUNKS:
                    self._chunks.clear()
                self._chunks[text] = ids
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cut before a space unless white space stands on both sides of the cut: no pre-token crosses such a place."""
        parts = text.split(" ")
        out, current = [], parts[0]
        for part in parts[1:]:
            if (part and not part[0].isspace()) or (current and not current[-1].isspace()):
                out.append(current)
                current = " " + part
            else:
                current += " " + part
        out.append(current)
        return out

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        found = list(map(self._chunks.get, chunks))
        if None in found:
            found = [self.chunk(chunk) if ids is None else ids for chunk, ids in zip(chunks, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder per process and rank file; its cache serves all tasks of a Python worker until another operator runs."""
    hold("bpe", _CODERS.clear)
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """Token ids of every whole text, and what they decode to, digested.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with ``ids`` the ids themselves as ``token_ids``. A null or empty
    text has no token and the digests of nothing. Repeated rows give repeated rows; an empty table gives none. One pass
    over the rows in the tasks that read them: nothing is shuffled.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"token_ids": []} if ids else {})
            for text in batch.column("text"):
                found = own.encode(text.as_py() or "")
                out["n_tokens"].append(len(found))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(own.digits.__getitem__, found)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    out["token_ids"].append(pa.array(found, pa.int32()))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(out["n_tokens"], pa.int64())}
            columns |= {name: pa.array(out[name], pa.string()) for name in ("ids_sha256", "decoded_sha256")}
            if ids:
                columns["token_ids"] = pa.array([x.to_pylist() for x in out["token_ids"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(docs: DataFrame, column: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, decoded)``: the bytes of the ids in ``column``; null ids give no bytes."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            texts = [own.decode(found.as_py() or []) for found in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(texts, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
